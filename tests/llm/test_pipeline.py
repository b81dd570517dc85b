from collections import Counter

import duckdb
from test_jaccard import _brute
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import langid, quality, queries
from lodestrata.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    told = langid.identify(frame.select("doc_id", "text"), *langid.train(frame)).collect()
    left = [r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= 0.5]
    weights = quality.train(frame.filter(frame.doc_id.isin(left)), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(frame.select("doc_id", "text"), weights).collect() if r["score"] >= 0.3}
    left = [i for i in left if i in good]
    assert 0 < len(left) < len(docs)
    left = [i for i, _, c in _brute([(i, docs[i]["text"]) for i in left]) if i == c]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, docs[i]["source"], docs[i]["text"]) for i in left])
    taken = con.execute(f"select doc_id, taken // size from ({queries.ORACLES['op7_mix_sources']}) where taken > 0").fetchall()
    tokenizer = Tokenizer.from_file(default_path())
    want = Counter()
    for i, copies in taken:
        n = len(tokenizer.encode(docs[i]["text"], add_special_tokens=False).ids) + 1
        for k, begin in enumerate(range(0, n, 2048)):
            want[i, k, begin, min(2048, n - begin)] += copies
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(1, "the of and that", "en", "a", 15, 0.5), (2, None, "en", "a", None, 0.1), (3, "12", None, None, 2, None), (4, "", "en", "a", 0, 1.0), (None, "the of and", "en", None, 10, 1.0), (5, "the of and that", "en", "b", 15, 0.0), (5, "the of and that", "en", "b", 15, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for source in (docs, docs.limit(0)):
        now = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), now.schema)
        corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
