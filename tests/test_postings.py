"""The inverted index against BM25 over all documents, with fewer postings read."""

import numpy as np
import pytest

from lodestrata.operators import postings, retrieval
from lodestrata.operators.postings import PostingIndex


def pairs(rows):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rows.collect())


@pytest.mark.parametrize("slot", [1, 4, 64])
def test_equals_bm25_of_all_documents(spark, tmp_path, monkeypatch, slot):
    monkeypatch.setattr(postings, "SLOT", slot)
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(words[min(299, int(k))] for k in rng.zipf(1.3, n))
    texts = [pick(int(rng.integers(1, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[3], texts[3], None, "", "a b"])], "id long, text string")
    queries = spark.createDataFrame([(k, pick(4)) for k in range(12)] + [(50, "w1 w1 w2"), (51, "nothing here"), (52, ""), (53, None), (54, texts[3])], "query_id int, text string")
    index = PostingIndex(spark, f"file://{tmp_path}/i").build(docs)
    for k in (1, 5, 400):
        got = index.search(queries, k)
        assert pairs(got) == pairs(retrieval.top(retrieval.bm25(docs, queries), k, documents=docs, queries=queries))


def test_reads_less_than_all_postings_at_scale(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    index = PostingIndex(spark, f"file://{tmp_path}/i").build(docs)
    got = index.search(items, 10)
    assert pairs(got) == pairs(retrieval.top(retrieval.bm25(docs, items), 10, documents=docs, queries=items))
    read, every = index.postings_read()
    assert 0 < read < 0.75 * every, (read, every)


def test_a_part_of_the_terms_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two two"), (3, "four")], "id long, text string")
    queries = spark.createDataFrame([(1, "two four")], "query_id int, text string")
    whole = PostingIndex(spark, f"file://{tmp_path}/a").build(docs).search(queries, 2)
    part = PostingIndex(spark, f"file://{tmp_path}/b").build(docs, only=spark.createDataFrame([("two",), ("four",)], "term string")).search(queries, 2)
    assert pairs(whole) == pairs(part) and len(pairs(whole)) == 2
    assert pairs(PostingIndex(spark, f"file://{tmp_path}/c").build(docs.limit(0)).search(queries, 3)) == []
