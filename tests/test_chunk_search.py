"""Vectors joined with chunks against a plain search, with fewer blocks scored than there are."""

import numpy as np
import pytest

from lodestrata.operators import chunk_search

EMB = "run_id string, source_chunk_id string, model_name string, dimension int, vector array<double>"
CHUNK = "run_id string, source_chunk_id string, chunk_id string, file_path string, chunk_text string"
ASK = "query_id int, run_id string, model_name string, query array<double>"


def plain(embeddings, chunks, asks, k):
    out = []
    for q, run, model, query in asks:
        rows = []
        for r, s, m, d, v in embeddings:
            if (r, m) == (run, model) and v is not None and query is not None and len(v) == d == len(query):
                norm = float(np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(query, query)))
                rows += [(float(np.dot(v, query)) / norm if norm else 0.0, c[2], c[3]) for c in chunks if (c[0], c[1]) == (r, s)]
        rows.sort(key=lambda x: (-round(x[0], 12), x[1]))
        out += [(q, n, round(s, 4), c, p) for n, (s, c, p) in enumerate(rows[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_equals_a_plain_search(spark, monkeypatch, spread):
    monkeypatch.setattr(chunk_search, "BLOCK", 16)
    monkeypatch.setattr(chunk_search, "OF_PIVOT", 20)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8))
    vectors = (middle[rng.integers(12, size=600)] + spread * rng.normal(size=(600, 8))).round(6)
    vectors[5], vectors[6:9] = 0, vectors[9]
    embeddings = [(["a", "a", "b"][k % 3], f"s{k}", ["m", "n"][k % 7 == 0], 8, v.tolist()) for k, v in enumerate(vectors)]
    embeddings += [("a", "s1", "m", 3, [1.0, 2.0, 3.0]), ("a", "lost", "m", 8, vectors[0].tolist()), ("a", "s3", "m", 8, None), ("a", "s4", "m", 9, vectors[0].tolist()), ("c", "s0", "n", 8, vectors[0].tolist())]
    chunks = [(["a", "a", "b"][k % 3], f"s{k}", f"c{k // 2}", f"f{k}", "t") for k in range(600)] + [("c", "s0", "c0", "f", "t"), ("d", "s0", "c0", "f", "t")]
    asks = [(k, ["a", "b"][k % 2], "m", vectors[k * 11].tolist()) for k in range(30)] + [(100, "c", "m", vectors[0].tolist()), (101, "d", "m", vectors[0].tolist()), (102, "e", "m", vectors[0].tolist()), (103, "a", "m", None), (104, "a", "m", [0.0] * 8)]
    shown, outcomes, pairs = chunk_search.search(spark.createDataFrame(embeddings, EMB), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(asks, ASK), 5)
    rows = [(r["query_id"], r["rank"], r["score"], r["chunk_id"], r["file_path"]) for r in shown.collect()]
    want = plain(embeddings, chunks, asks, 5)
    assert [r[:4] for r in sorted(rows)] == [w[:4] for w in want]
    got = {r["query_id"]: (r["outcome"], r["total_retrieved"]) for r in outcomes.collect()}
    assert got[0] == ("hits", 5) and got[100] == ("mismatch", 0) and got[101] == ("unavailable", 0) and got[102] == ("empty", 0) and got[103] == ("mismatch", 0)
    if spread < 1:
        assert pairs.count() < 0.6 * 31 * 600 / 2 / 16


def test_nothing_to_search(spark):
    e, c, a = spark.createDataFrame([], EMB), spark.createDataFrame([], CHUNK), spark.createDataFrame([(1, "r", "m", [1.0])], ASK)
    shown, outcomes, _ = chunk_search.search(e, c, a)
    assert shown.count() == 0 and [tuple(r) for r in outcomes.collect()] == [(1, "r", "empty", 0)]


def test_blocks_follow_the_size_of_a_scope(spark, monkeypatch):
    """16 runs of 64 vectors: three pivots for each run, and not the fifty that all vectors together would get."""
    monkeypatch.setattr(chunk_search, "OF_PIVOT", 20)
    rng = np.random.default_rng(7)
    rows = [(f"r{k % 16}", "m", 8, k, f"c{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(1024, 8)))]
    blocks = chunk_search._blocks(spark.createDataFrame(rows, "run_id string, model_name string, dimension int, chunk_key long, chunk_id string, vector array<double>")).collect()
    assert len(blocks) <= 16 * 3
    assert sorted(k for b in blocks for k in b["keys"]) == list(range(1024))
