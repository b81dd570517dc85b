"""Samples with refill, pages of nodes, and reports of retrieval by group."""

import hashlib

import pytest

from lodestrata.operators import evaluation, graph, paging


def edges(spark, **counts):
    return spark.createDataFrame([(r.replace("_", " "), f"{r}{k}", f"t{k}") for r, n in counts.items() for k in range(n)], "relation string, source string, target string")


def plain(rows, size, seed):
    key = lambda r: (hashlib.md5(f"{seed}|{r[1]}|{r[2]}".encode()).hexdigest(), r[1], r[2])
    kinds = sorted({r[0] for r in rows} & set(graph.SAMPLED)) or sorted({r[0] for r in rows})
    share = max(1, size // max(1, len(kinds)))
    groups = [sorted((r for r in rows if r[0] == k), key=key) for k in kinds]
    chosen, rest = [r for g in groups for r in g[:share]], sorted((r for g in groups for r in g[share:]), key=key)
    return sorted(chosen + rest[: max(0, size - len(chosen))], key=key)


@pytest.mark.parametrize("counts", [dict(calls=50, imports=3, inherits=0, contains=40), dict(calls=5, imports=2), dict(calls=30, other=99), dict(other=20, more=2), dict(calls=1, imports=1, inherits=1, contains=1)])
@pytest.mark.parametrize("size", [2, 20])
def test_a_sample_is_as_large_as_asked_if_it_can_be(spark, counts, size):
    df = edges(spark, **counts)
    got = [tuple(r)[:3] for r in graph.sample(df, size, "s", ["source", "target"]).orderBy("place").collect()]
    want = plain([tuple(r) for r in df.collect()], size, "s")
    assert got == want
    there = sum(n for r, n in counts.items() if r in graph.SAMPLED) or sum(counts.values())
    assert len(got) >= min(size, there)


def test_a_sample_of_nothing(spark):
    assert graph.sample(edges(spark, calls=1).limit(0), 5, "s", ["source"]).count() == 0


def test_pages_of_nodes(spark):
    nodes = [("a.py", "file", None, None), *[(f"a.py::{k}", ["function", "class"][k % 2], "a.py", k if k else None) for k in range(7)], ("b.py::f", "function", "b.py", 1)]
    df = spark.createDataFrame(nodes, "id string, node_type string, file_path string, start_line int")
    e = spark.createDataFrame([("a.py", "a.py::2"), ("a.py::2", "b.py::f"), ("a.py", "a.py::0")], "source string, target string")
    shown, met = paging.node_page(df, e, "function", "a.py", 0, 2)
    assert [(r["id"], r["total"]) for r in shown.orderBy("start_line").collect()] == [("a.py::2", 4), ("a.py::4", 4)]
    assert sorted(tuple(r) for r in met.collect()) == [("a.py", "a.py::2"), ("a.py::2", "b.py::f")]
    assert paging.node_page(df, e, "file", "a.py")[0].count() == 0 and paging.node_page(df, e)[0].count() == 9


def test_reports_of_retrieval(spark):
    rows = [("m", "r1", "lookup", True, False, 0.9, 1.0, 1, 1.0), ("m", "r1", "lookup", False, False, 0.5, 0.5, 0, 0.0), ("m", "r2", None, None, None, None, None, None, None), ("m", "r2", "lookup", True, True, 0.3, None, None, None)]
    df = spark.createDataFrame(rows, "method string, repo string, difficulty string, paraphrase boolean, unanswerable boolean, top1_score double, reciprocal_rank double, hit_1 int, recall_1 double")
    got = {(r["method"], r["repo"], r["overall"]): r for r in evaluation.retrieval_report(df, (1,), ["method", "repo"]).collect()}
    assert set(got) == {("m", "r1", 0), ("m", "r2", 0), ("m", None, 1), (None, None, 3)}
    one, two, all_ = got["m", "r1", 0], got["m", "r2", 0], got[None, None, 3]
    assert (one["mrr"], one["hit_1"], one["mrr_paraphrase"], one["mrr_plain"], one["top1_hit_mean"], one["top1_miss_mean"]) == (0.75, 0.5, 1.0, 0.5, 0.9, 0.5)
    assert (two["answerable"], two["unanswerable"], two["mrr"], two["mrr_lookup"], two["top1_mean"], two["unanswerable_top1_max"]) == (1, 1, 0.0, None, None, 0.3)
    assert (all_["answerable"], all_["mrr"], all_["top1_mean"]) == (3, 0.5, 0.7)
