"""Labels, states and evidence where the tables don't reach: odd values, against plain versions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import labels as L
from lodestrata.operators import health, retrieval, snapshots
from lodestrata.registry import REGISTRY


def test_shown_score_is_exact(spark):
    scores = [72.35, 72.25, 0.05, 0.15, 99.95, 2.5, -0.04, 0.0, 100.0, 72.45, 1.005] + [i / 100 for i in range(0, 10001, 7)]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", L.shown_score(F.col("s")).alias("t")).collect()
    for s, t in rows:
        tie = s * 4 == int(s * 4) and s * 2 != int(s * 2)  # an exact half: away from zero
        assert t == f"{s + 0.01 if tie else s:.1f}", s


def test_shown_score_of_negative_zero_and_of_large_numbers(spark):
    scores = [-0.0, -0.001, 0.0, float("nan"), float("inf"), float("-inf"), 1e17, -1e18, 1e22, 9007199254740993.0, 4503599627370495.5]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(L.shown_score(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{s:.1f}" for s in scores]


def test_shown_score_of_halves_that_a_hundredth_does_not_move(spark):
    scores = [140968689464484.25, -140991552869606.75, 2.0**46 + 0.25, 2.0**51 + 0.75, 2.0**50 - 0.25, 9225823458939314176.0, -4998792514413499984732535513453428736.0, 2.0**53, 2.0**62, 2.0**63]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(L.shown_score(F.col("s")).alias("t")).collect()
    moved = lambda s: s + math.copysign(0.01, s) if s % 0.5 == 0.25 else s
    assert [r["t"] for r in rows] == [f"{moved(s):.1f}" for s in scores]


def test_shown_score_of_signed_nan_and_all_digits(spark):
    scores = [math.copysign(math.nan, -1), math.nan, 2.0**125, -1e40, 2.0**1023]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(L.shown_score(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["-nan", *(f"{s:.1f}" for s in scores[1:])]


@pytest.mark.parametrize("kind", ["double", "float", "decimal(15,2)", "bigint"])
def test_score_labels_of_other_types(spark, tmp_path, kind):
    con = duckdb.connect()
    odd = "union all select unnest([null, -('nan'::double), 'nan', 'inf', '-inf', -0.0, -1e-300, 1e22, 14096868946448425])" if kind == "double" else ""
    balances = f"select (i * 5 - 1000)::{kind} as b from range(2200) t(i) union all select (i * 0.37)::{kind} from range(500) t(i) {odd}"
    con.execute(f"copy (select row_number() over () as c_custkey, b as c_acctbal from ({balances})) to '{tmp_path}/customer.parquet'")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    query = REGISTRY["score_labels"]
    assert sorted(map(tuple, query.run(spark, str(tmp_path)).collect())) == sorted(con.execute(query.sql).fetchall())


def test_score_labels_of_scaled_copies(spark, tmp_path):
    """Copies with other keys, whose rounded balances hold negative zeros."""
    con = duckdb.connect()
    copies = "from '/root/testdata/sf0.01/customer.parquet', range(60) t(i)"
    con.execute(f"copy (select c_custkey + i * 15001 as c_custkey, round(c_acctbal * i / 10000, 2) as c_acctbal {copies}) to '{tmp_path}/customer.parquet'")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    query = REGISTRY["score_labels"]
    assert any("-0.0" == row[2] for row in con.execute(query.sql).fetchall())
    assert sorted(map(tuple, query.run(spark, str(tmp_path)).collect())) == sorted(con.execute(query.sql).fetchall())


def test_token_counts(spark):
    cases = {'{"n": 5}': 5, '{"n": {"a": 1}}': None, '{"n": 0}': 0, '{"n": -1}': None, '{"n": 5.0}': None, '{"n": true}': None, '{"n": "5"}': None, '{"n": null}': None, "{}": None, "[5]": None, "x": None, '{"n": 12345678901}': 12345678901}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "u string").select("u", L.token_count(F.col("u"), "n").alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == {**cases, None: None}


def test_odd_labels(spark):
    one = spark.range(1)
    nothing = F.lit(None).cast("string")
    row = one.select(
        L.language(nothing, L.CHUNK_ENDINGS, True).alias("lang"), L.clean_error(F.lit("")).alias("error"), L.clean_error(nothing).alias("none"), L.clean_status(F.lit("bad API_KEY")).alias("status"),
        L.short_url(F.lit("https://h/a/b.git")).alias("url"), L.short_sha(nothing).alias("sha"), L.iso_time(F.lit("2024-13-01")).alias("at"), L.matches_text(F.lit("Ab"), nothing).alias("all"), L.shown_score(F.lit(None).cast("double")).alias("score"),
    ).first()
    assert row.asDict() == {
        "lang": "unknown", "error": "Analysis execution failed", "none": "Analysis execution failed", "status": "bad API_KEY: environment variable is missing or invalid.",
        "url": "a/b", "sha": "—", "at": None, "all": True, "score": "N/A",
    }


@pytest.mark.parametrize("name", ["gpt", " "])
def test_unknown_provider(spark, name):
    with pytest.raises(Exception, match="unknown provider"):
        spark.createDataFrame([(name,)], "n string").select(L.provider(F.col("n"))).collect()


def test_unknown_status(spark):
    rows = spark.createDataFrame([(1, "success", True), (1, "odd", True)], "k int, status string, has_score boolean")
    with pytest.raises(Exception, match="unknown status odd"):
        health.overall_status(rows, "k").collect()


def _blocks(chunks, budget):
    """The rule, chunk by chunk."""
    used, out = 0, []
    for i, (cid, text) in enumerate(chunks, 1):
        head = f"[E{i}]\nFile: p\nLines: 1-2\nLanguage: unknown\nEntity: f\nChunkID: {cid}\n\n"
        room = budget - used
        if room <= 0:
            break
        if len(head) + len(text) > room:
            text = text[: max(0, room - len(head) - 12)] + "\n[truncated]"
        if len(head + text) > room and i != 1:
            break
        out.append((f"E{i}", cid, head + text))
        used += len(head + text)
    return out


@pytest.mark.parametrize("budget", [1, 60, 75, 130, 150, 160, 200, 235, 1000])
def test_labelled_evidence(spark, budget):
    chunks = [("a", "x" * 50), ("b", "né" * 20), ("c", ""), ("d", "z" * 300)]
    kind = "c array<struct<chunk_id:string,path:string,first:int,last:int,lang:string,entity:string,sha:string,text:string>>"
    df = spark.createDataFrame([([(c, "p", 1, 2, None, "f", None, t) for c, t in chunks],), ([],)], kind)
    got = [[tuple(b) for b in r["k"]] for r in df.select(retrieval.labelled_evidence(F.col("c"), budget).alias("k")).collect()]
    assert got == [_blocks(chunks, budget), []]


def test_tree_digest(spark):
    def digest(*files):
        rows = spark.createDataFrame([("t", *f) for f in files], "tree string, path string, text string")
        return [r["digest"] for r in snapshots.tree_digest(rows, "tree").collect()]

    base = digest(("a/b.py", "1"), ("c.py", "2"))
    assert base == digest(("c.py", "2"), ("a/b.py", "1"), ("a/.git/x", "3"), ("dist/y", "4"))
    others = [digest(("a/b.py", "2"), ("c.py", "1")), digest(("a/b.py", "1")), digest(("a/b.py", "1"), ("d.py", "2")), digest(("a/b.py", "1"), ("c.py", None)), digest(("a/b.py", "1"), ("c.py", "2"), ("c.py", "2"))]
    assert base not in others and len({*map(tuple, others)}) == len(others)


def test_file_ranking(spark):
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (1, 12, 0.9), (1, 13, 0.5), (2, 10, 0.1)], "query_id int, id int, score double")
    files = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (13, "c"), (14, "d")], "id int, file string")
    got = retrieval.file_ranking(scores, files).collect()
    assert sorted((r["query_id"], r["rank"], r["file"]) for r in got) == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "a")]
