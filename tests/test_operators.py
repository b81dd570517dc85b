"""Golden rows of single operators."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.urls import is_sha, normal_url, rejection
from lodestrata.operators import chunking, evaluation, graph, health, jobs, paging, retrieval
from lodestrata.sources.manifests import parse_package_json, parse_pyproject, parse_requirements
from lodestrata.streaming.rate_limit import admit, take


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_windows_of_a_long_text_and_ids(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"line {k}" for k in range(1, 151)) + "\n"), ("b.py", ""), ("c.py", "x\r\ny")], "file_path string, text string")
    rows = chunking.windows(files).orderBy("file_path", "start_line").collect()
    assert [(r["file_path"], r["start_line"], r["end_line"]) for r in rows] == [("a.py", 1, 50), ("a.py", 51, 100), ("a.py", 101, 150), ("c.py", 1, 2)]
    assert rows[3]["chunk_text"] == "x\ny" and rows[0]["chunk_id"].startswith("sc_") and len(rows[0]["chunk_id"]) == 35
    ids = [_one(spark, i=chunking.chunk_id(F.lit(None).cast("string"), F.lit("f"), F.lit(1), F.lit(2), F.lit("t"), v))["i"] for v in ("1", "2")]
    assert ids[0] != ids[1]


def test_entities_overlap_and_gaps_are_covered(spark):
    files = spark.createDataFrame([("a", "\n".join("abcdefghijkl"))], "file_path string, text string")
    entities = spark.createDataFrame([("a", 2, 6, "C"), ("a", 3, 4, "m"), ("a", 9, 9, "f")], "file_path string, start_line int, end_line int, name string")
    rows = chunking.entity_chunks(files, entities, size=3, whole=4).collect()
    assert sorted((r["start_line"], r["end_line"], r["name"], r["chunk_text"]) for r in rows if r["name"]) == [(2, 4, "C", "b\nc\nd"), (3, 4, "m", "c\nd"), (5, 6, "C", "e\nf"), (9, 9, "f", "i")]
    assert sorted((r["start_line"], r["end_line"]) for r in rows if not r["name"]) == [(1, 1), (7, 8), (10, 12)]


def test_spans_end_with_the_file(spark):
    files = spark.createDataFrame([("a", "1\n2\n3"), ("b", None), ("c", "1")], "file_path string, text string")
    spans = [("a", 2, 9, "f"), ("a", 7, 9, "g"), ("a", -3, 1, "h"), ("a", 3, 2, "i"), ("c", 5, 6, "j"), ("b", 1, 2, "k")]
    rows = chunking.entity_chunks(files, spark.createDataFrame(spans, "file_path string, start_line int, end_line int, name string")).collect()
    assert sorted((r["file_path"], r["start_line"], r["end_line"], r["name"] or "", r["chunk_text"]) for r in rows) == [("a", 1, 1, "h", "1"), ("a", 2, 3, "f", "2\n3"), ("c", 1, 1, "", "1")]


def test_text_functions(spark):
    r = _one(
        spark,
        lines=T.lines(F.lit("a\r\nb\x85c\n")), norm=T.normal_path(F.lit("..\\./x/y.py")), rel=T.resolve_relative(F.lit("a/b"), F.lit("../c/./d")),
        up=T.resolve_relative(F.lit("a"), F.lit("../../x")), ext=T.extension(F.lit("p/.hidden.PY")), noext=T.extension(F.lit("p/.hidden")),
        safe=T.is_safe_relative(F.lit("a/../b")), unsafe=T.is_safe_relative(F.lit("a/../../b")), red=T.redact(F.lit("git https://u:p@h/x failed")),
        test=T.is_test_file(F.lit("src/test_x.py")), conf=T.is_test_file(F.lit("a/conftest.py")), prod=T.is_test_file(F.lit("src/main.py")), terms=T.terms(F.lit("Größe a X1 né")),
        cos0=T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), cosn=T.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))),
    )
    assert r["lines"] == ["a", "b", "c"] and r["norm"] == "x/y.py" and r["rel"] == "a/c/d" and r["up"] == "../x"
    assert r["ext"] == ".py" and r["noext"] == "" and r["safe"] and not r["unsafe"] and r["red"] == "git https://***@h/x failed"
    assert r["test"] and r["conf"] and not r["prod"] and r["terms"] == ["größe", "x1", "né"] and r["cos0"] == r["cosn"] == 0.0


def test_urls(spark):
    cases = {
        None: "empty", "": "empty", " ": "control_or_space", "http://github.com/a/b": "scheme", "git@github.com:a/b": "scheme", "https://u@github.com/a/b": "credentials",
        "https://github.com@evil.com/a/b": "credentials", "https://github.com:1/a/b": "port", "https://x.com:1/a/b": "host", "https://www.github.com/a/b": "host",
        "https://github.com/a/b?x": "query", "https://github.com/a/b#x?y": "fragment", "https://github.com/a/b?": "path", "https://github.com/a": "path", "https://github.com/a/b/c": "path",
        "https://github.com/a%2Fb": "percent", "-https://github.com/a/b": "leading_dash", "https://github.com/-a/b": "owner", "https://github.com/a/.b": "repository", "https://github.com/" + "a" * 2048: "too_long",
        "https://github.com/a /b": "control_or_space", "https://github.com/a/b": None, "HTTPS://GitHub.com/A/b.git/": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", rejection(F.col("u")).alias("r"), normal_url(F.col("u")).alias("n"), is_sha(F.col("u")).alias("s")).collect()
    assert {r["u"]: r["r"] for r in rows} == cases and rows[-1]["n"] == "https://github.com/A/b"


def test_composites(spark):
    six = "complexity double, maintainability double, security double, sast double, secrets double, vulnerabilities double"
    data = [(91.08, 66.94, 0.0, 0.0, 100.0, None), (85.0, 57.48, 98.0, 100.0, 100.0, None), (None,) * 6]
    rows = health.composite(spark.createDataFrame(data, six)).collect()
    assert rows[0]["composite"] == pytest.approx(52.11, abs=0.01) and rows[1]["composite"] == pytest.approx(84.44, abs=0.01) and rows[2]["composite"] is None
    one = spark.createDataFrame([(1, 90.0, 80.0, 70.0, None, None, None)], "k int, " + six)
    parts = {r["component"]: round(r["effective_weight"], 4) for r in health.explain(one, "k").collect()}
    assert parts == {"complexity": 0.3571, "maintainability": 0.3571, "security": 0.2857}


def test_confusion_and_intervals(spark):
    data = [("calls", x) for x in ["tp"] * 14 + [" FP "] * 4 + ["Ambiguous"] * 2 + ["?"]]
    total = next(r for r in evaluation.confusion(spark.createDataFrame(data, "g string, label string"), "g").collect() if r["overall"])
    assert (total["tp"], total["fp"], total["ambiguous"]) == (14, 4, 2) and round(total["precision"], 4) == 0.7778 and total["recall"] is None and total["f1"] is None
    with_fn = evaluation.confusion(spark.createDataFrame([("a", x) for x in ("TP", "TP", "FP", "FN")], "g string, label string"), "g").first()
    assert {round(with_fn[c], 4) for c in ("precision", "recall", "f1")} == {0.6667}
    low, high = evaluation.wilson(F.lit(0), F.lit(0))
    assert tuple(_one(spark, low=low, high=high)) == (0.0, 0.0)


def test_ranks_and_correlations(spark):
    rows = spark.createDataFrame([(10, 1), (20, 2), (20, 2), (30, 5)], "x int, y int")
    assert sorted(r["r"] for r in evaluation.average_rank(rows, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0]
    assert evaluation.spearman(rows, "x", "y").first()["rho"] == pytest.approx(1.0) and evaluation.kendall(rows, "x", "y").first()["tau"] == pytest.approx(1.0)
    assert evaluation.spearman(rows.limit(1), "x", "y").first()["rho"] == 0.0
    assert evaluation.agreement(rows.limit(0), rows.limit(0), ["x"]).first()["jaccard"] == 1.0


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "z", 1)], "q int, i string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "q int, i string")
    rows = {r["q"]: tuple(r)[1:] for r in evaluation.retrieval_metrics(ranked, truth, "q", "i", 5).collect()}
    assert rows == {1: (1, 0.5, pytest.approx(1 / 3)), 2: (0, 0.0, 0.0)}


def test_cosine_parity_with_ties_and_zero(spark):
    x = np.random.default_rng(1).normal(size=(60, 64))
    x[7], x[9] = 0, x[3]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, vector array<double>")
    q = spark.createDataFrame([(0, x[3].tolist())], "query_id int, query array<double>")
    rows = sorted((r["rank"], r["id"], r["score"]) for r in retrieval.cosine_top_k(frame, q, 60).collect())
    norm = np.linalg.norm(x, axis=1)
    want = np.where(norm > 0, x @ x[3] / np.where(norm > 0, norm, 1) / norm[3], 0)
    assert [i for _, i, _ in rows[:2]] == [3, 9] and all(abs(s - want[i]) < 1e-9 + 5e-10 for _, i, s in rows)


def test_evidence_and_citations(spark):
    kept = retrieval.evidence(F.array(*[F.lit("x" * n) for n in (50, 60, 10)]), 100)
    assert [len(t) for t in _one(spark, k=kept)["k"]] == [50, 50]
    good, bad, clean = retrieval.citations(F.lit("yes [E1] and [E99]  ok"), F.array(F.lit("E1")))
    assert tuple(_one(spark, g=good, b=bad, c=clean)) == (["E1"], ["E99"], "yes [E1] and ok")
    assert _one(spark, r=retrieval.is_refusal(F.lit("The code DOES NOT support that")))["r"]


def test_ladders(spark):
    functions = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "g", "a"), (4, "h", "b"), (5, "k", "a"), (6, "k", "b"), (7, "g", "c")], "id long, name string, file string")
    calls = spark.createDataFrame([("c1", 3, "a", "f"), ("c2", 1, "a", "f"), ("c3", 1, "a", "h"), ("c4", 4, "b", "nothing"), ("c5", 3, "a", "g"), ("c6", 4, "b", "g")], "call_id string, caller long, file string, name string")
    rows = {r["call_id"]: (r["target"], r["confidence"]) for r in graph.call_ladder(calls, functions).collect()}
    assert rows == {
        "c1": ("ambiguous_call::f", "flagged"), "c2": ("2", "high_confidence"), "c3": ("4", "low_confidence"), "c4": ("unresolved_call::nothing", "flagged"),
        "c5": ("7", "low_confidence"), "c6": ("ambiguous_call::g", "flagged"),
    }
    imports = spark.createDataFrame([("i1", "src/index.ts", "./client"), ("i2", "p/m.py", "q.r"), ("i3", "q/r.py", "q.r")], "import_id string, file string, imported string")
    files = spark.createDataFrame([("src/client.ts",), ("q/r.py",)], "path string")
    assert {r["import_id"]: r["target"] for r in graph.resolve_imports(imports, files).collect()} == {"i1": "src/client.ts", "i2": "q/r.py", "i3": None}


def test_closure_goes_all_the_way_up(spark):
    chain = [(k, k - 1) for k in range(2, 41)]
    odd = [(101, 102), (102, 103), (103, 101), (103, 40), (103, 40), (104, 1), (104, 101), (105, 105)]  # a cycle, a repeated row, two ways, itself
    up = {}
    for child, parent in chain + odd:
        up.setdefault(child, set()).add(parent)
    want = {}
    for child in up:
        now, depth = up[child], 1
        while now:
            want |= {(child, a): depth for a in now}
            now, depth = {p for a in now for p in up.get(a, ()) if p != child and (child, p) not in want}, depth + 1
    rows = graph.closure(spark.createDataFrame(chain + odd, "child long, parent long"), spark).collect()
    assert len(rows) == len(want) and {(r["child"], r["ancestor"]): r["depth"] for r in rows} == want
    assert want[40, 1] == 39 and want[104, 1] == 1 and want[104, 2] == 42


def test_paging_grid(spark):
    data = [(k, ["x", "y", "z"][k % 3], None if k % 5 == 0 else k % 40, f"f{k % 7}" if k % 7 else None) for k in range(150)]
    rows = spark.createDataFrame(data, "id int, analyzer string, line int, file string").cache()
    for analyzer in (None, "x", "none"):
        want = sorted((r for r in data if analyzer in (None, r[1])), key=lambda r: (r[3] is None, r[3] or "", r[2] is None, r[2] or 0, r[0]))
        for offset, limit in ((0, 7), (45, 50), (149, 500)):
            got = paging.page(paging.equal(rows, analyzer=analyzer), ["file", "line", "id"], offset, limit).collect()
            assert [r["id"] for r in got] == [r[0] for r in want[offset : offset + limit]]
    with pytest.raises(ValueError):
        paging.page(rows, ["id"], 0, 501)


def test_manifests(spark):
    lines = spark.createDataFrame([("a==1.2 # pin",), ("# no",), ("B[x] >= 2",), ("-r other",), ("",), ("c",)], "line string")
    assert sorted((r["package"], r["version"]) for r in parse_requirements(lines).collect()) == [("B", ""), ("a", "1.2"), ("c", "")]
    js = spark.createDataFrame([("p.json", '{"dependencies": {"x": "^1.0"}, "devDependencies": {"y": "~2"}}'), ("q.json", "broken")], "file_path string, text string")
    assert sorted((r["package"], r["version"]) for r in parse_package_json(js).collect()) == [("x", "1.0"), ("y", "2")]
    toml = spark.createDataFrame([("pyproject.toml", '[project]\ndependencies = ["m==3", "n>1"]\n[tool.poetry.dependencies]\npython = "3"\no = {version = "^4"}'), ("bad.toml", "=")], "file_path string, text string")
    toml = toml.unionByName(spark.createDataFrame([("odd.toml", "[project]\ndependencies = 3\n[tool]\npoetry = 4"), ("list.toml", "[project]\ndependencies = [1, 'p==2']"), ("none.toml", None)], toml.schema))
    rows = parse_pyproject(toml).collect()
    assert sorted((r["package"], r["version"]) for r in rows if r["package"]) == [("m", "3"), ("n", None), ("o", "4"), ("p", "2")]
    assert sorted(r["manifest_file"] for r in rows if r["error"]) == ["bad.toml", "none.toml", "odd.toml"]


def test_token_bucket(spark):
    assert take(0, None, 0.0, 2) == (1.0, True, 0) and take(0.0, 0.0, 3.0, 2)[1:] == (False, 27) and take(5, 0, 1, 0)[1]
    data = [(k, "k" if k % 2 else "m", float(t)) for k, t in enumerate([0, 0, 1, 1, 2, 2, 40, 40])]
    frame = spark.createDataFrame(data, "request_id long, key string, at double")
    got = {r["request_id"]: (r["allowed"], r["retry_after"]) for r in admit(frame, 2).collect()}
    assert [got[k][0] for k in range(8)] == [True, True, True, True, False, False, True, True]


def test_a_finished_job_is_not_reaped(spark):
    jobs_ = spark.createDataFrame([(1, "completed", 1, 1), (2, "partial", 1, 1), (3, "parsing", 1, 9), (4, "failed", 1, 1), (5, "queued", 9, 9)], "job_id int, status string, updated_at int, created_at int")
    assert [tuple(r) for r in jobs.reap(jobs_, F.lit(5)).collect()] == [(3, "parsing", "failed", "stale while parsing")]


def _plain_score(blocks, results):
    """The score of one run by hand: blocks {component: status}, results [(component, rank, cc, mi, severity)]."""
    good = ("success", "partial")
    newer = bool({"sast", "secrets", "vulnerabilities"} & set(blocks))
    own = lambda c: [r for r in results if r[0] == c]
    mean = lambda xs: round(sum(xs) / len(xs), 2) if xs else 100.0
    bands = lambda cc: next((p for most, p in ((5, 100), (10, 85), (20, 70), (30, 50), (40, 30)) if cc <= most), 10)
    cost = {
        "security": lambda r: {"HIGH": 15, "MEDIUM": 7, "LOW": 2}.get((r[4] or "").upper(), 2),
        "sast": lambda r: {"HIGH": 15, "ERROR": 15, "WARNING": 7, "MEDIUM": 7, "INFO": 2, "LOW": 2}.get((r[4] or "INFO").upper(), 5),
        "secrets": lambda r: 25,
        "vulnerabilities": lambda r: 20,
    }
    status = {c: blocks.get(c, "unavailable") for c in (health.WEIGHTS if newer else health.LEGACY_WEIGHTS)}
    subs = {c: max(0.0, 100.0 - sum(cost[c](r) for r in own(c))) if c in cost else None for c in status}
    subs["maintainability"] = mean([min(100.0, max(0.0, 100.0 if r[3] is None else r[3])) for r in own("maintainability")])
    subs["complexity"] = mean([{"A": 100, "B": 85, "C": 70, "D": 50, "E": 30, "F": 10}.get(r[1] or "C", 50) for r in own("complexity")])
    if status["complexity"] not in good and blocks.get("lizard") in good:
        status["complexity"], subs["complexity"] = blocks["lizard"], mean([bands(r[2] or 1) for r in own("lizard")])
    subs = {c: v for c, v in subs.items() if status[c] in good}
    weights = health.WEIGHTS if newer else health.LEGACY_WEIGHTS
    total = sum(weights[c] for c in subs)
    state = "failed" if not subs else "complete" if set(status.values()) == {"success"} else "partial"
    exact = sum(Decimal(str(weights[c])) * Decimal(str(v)) for c, v in subs.items()) / Decimal(str(round(total, 2)) if subs else 1)
    return float(round(exact, 2)) if subs else None, state, subs, [c for c in status if c not in subs]


def test_score_documents_of_random_runs(spark):
    rng = np.random.default_rng(8)
    parts, pick = [*health.WEIGHTS, "lizard"], lambda xs: xs[int(rng.integers(len(xs)))]
    blocks, results = {}, {}
    for run in range(120):
        blocks[run] = {c: pick(["success", "success", "success", "partial", "failed", "unsupported", "unavailable"]) for c in parts if rng.random() < 0.85 and (run % 4 or c in (*health.LEGACY_WEIGHTS, "lizard"))}
        results[run] = [(pick(parts), pick([None, *"ABCDEFZ"]), pick([None, 1, 7, 15, 25, 33, 80]), pick([None, -3.0, 55.25, 120.0]), pick([None, "high", "High", "LOW", "medium", "error", "Warning", "info", "odd"])) for _ in range(int(rng.integers(12)))]
    blocks[500] = {c: "success" for c in health.WEIGHTS}
    results[500] = []
    b = spark.createDataFrame([(run, c, s) for run, x in blocks.items() for c, s in x.items()], "run_id int, component string, status string")
    r = spark.createDataFrame([(run, *x) for run, xs in results.items() for x in xs], "run_id int, component string, rank string, cc int, mi double, severity string")
    got = {x["run_id"]: x for x in health.score_document(b, r).collect()}
    assert set(got) == {run for run, x in blocks.items() if x}
    for run, row in got.items():
        composite, state, subs, missing = _plain_score(blocks[run], results[run])
        assert (row["composite"], row["status"], row["components_scored"], row["missing_components"]) == (composite, state, [c for c in health.WEIGHTS if c in subs], missing), run
        assert {c: row[c] for c in health.WEIGHTS if row[c] is not None} == subs and row["reduced"] == bool(missing)
        assert sum(row[f"{c}_weight"] or 0 for c in health.WEIGHTS) == pytest.approx(1.0 if subs else 0.0, abs=3e-4)
    assert got[500]["composite"] == 100.0 and got[500]["status"] == "complete" and got[500]["reduced_note"] == ""
    with pytest.raises(Exception, match="unknown status odd"):
        health.score_document(spark.createDataFrame([(1, "sast", "odd")], b.schema), r).collect()
