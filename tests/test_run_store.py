"""Stored runs: what is written comes back, half a batch is invisible, a run that comes twice counts once."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.registry import REGISTRY
from lodestrata.sources import run_store
from lodestrata.sources.run_store import TABLES, RunStore


def document(n=1, **more):
    nodes = [
        {"id": "app.py", "type": "file", "provenance": "walk"},
        {"id": "app.py::C:1", "type": "class", "name": "C", "file": "app.py", "start_line": 1, "end_line": 20, "bases": [], "provenance": "ast"},
        {"id": "app.py::f:5", "type": "function", "name": 'f"\\é', "file": "app.py", "start_line": 5, "end_line": 10, "class_owner": "C", "provenance": "ast", "deep": {"a": [1, "1", None]}},
        {"id": "web/x.tsx", "type": "file", "provenance": "walk"},
        {"id": "import::os", "type": "import_target", "name": "os", "provenance": "ast"},
        {"id": "finding::b::0", "type": "finding", "analyzer": "b", "rule_id": "B1", "severity": "HIGH", "message": "m", "file": "app.py", "line": 7, "provenance": "b"},
    ]
    edges = [
        {"source": "app.py", "target": "app.py::C:1", "relation": "contains", "confidence": "structural_certain", "provenance": "ast"},
        {"source": "a", "target": "b", "relation": "calls", "confidence": "high_confidence", "provenance": "p", "line": 3},
        {"source": "a", "target": "c", "relation": "calls", "confidence": "flagged", "provenance": "p"},
        {"source": "a", "target": "d", "relation": "calls", "confidence": "low_confidence", "provenance": "p"},
    ]
    return {
        "schema_version": "1.0.0", "cache_schema_version": "v4", "analyzer_version": "0.1", "repository": f"https://example.org/r{n % 2}", "commit_sha": "abc", "cache_snapshot_id": f"s{n % 3}", "cache_key_basis": "sha",
        "analyzed_at_utc": "2026-09-19T10:00:00+00:00", "languages": ["python"], "analysis_status": "complete", "files_analyzed": n, "parse_errors": [{"file": "app.py", "error": "first"}, {"file": "app.py", "error": "last"}],
        "static_analysis": {"complexity": {"status": "success", "results": [{"cc": 3, "rank": "A"}], "provenance": "r", "errors": [], "metadata": {}}, "security": {"status": "failed", "results": [], "provenance": "", "errors": ["x"], "metadata": {"k": 1}}},
        "knowledge_graph_summary": {"total_nodes": 6}, "knowledge_graph": {"nodes": nodes, "edges": edges},
        "health_score": {
            "composite_health_score": 87.5, "status": "complete", "sub_scores": {"complexity": 90.0}, "component_statuses": {"complexity": "success"}, "weights_used": {"complexity": 0.35},
            "weights_renormalized": False, "formula_version": "2", "missing_components": [], "formula": "f", "scope_policy": "p",
        },
    } | more


def frame(spark, documents):
    return spark.createDataFrame([(d if d is None or isinstance(d, str) else json.dumps(d),) for d in documents], "document string")


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, f"file://{tmp_path}/store")


def test_a_document_comes_back(spark, store):
    want = [document(1, run_id="r1"), document(2, run_id="r2", knowledge_graph={"nodes": [], "edges": []}, parse_errors=[], health_score={}), document(3)]
    store.append(frame(spark, want))
    got = {r["run_id"]: json.loads(r["document"]) for r in store.documents().collect()}
    hashed = next(k for k in got if k not in ("r1", "r2"))
    assert got == {"r1": want[0], "r2": want[1], hashed: want[2] | {"run_id": hashed}}
    one = store.documents(spark.createDataFrame([("r2",)], "run_id string")).collect()
    assert [r["run_id"] for r in one] == ["r2"]


def test_the_tables_of_a_run(spark, store):
    vectors = [{"chunk_id": "c1", "dimension": 2, "vector": [0.5, 1.0], "model_name": "m"}, {"chunk_id": "lost", "vector": [1.0]}, {"chunk_id": "lost", "source_chunk_id": "given", "vector": [1.0]}]
    more = {"source_chunks": [{"chunk_id": "c1", "file_path": "app.py", "chunk_text": "x"}, {"chunk_id": "c1", "commit_sha": "own"}], "source_embeddings": vectors, "analysis_status": "odd", "analyzed_at_utc": "no time"}
    more["static_analysis"] = {"scope_policy": "p", "odd": 3, "tool": {"results": [1]}}
    store.append(frame(spark, [document(1, run_id="r1", **more), document(2, run_id="r2", knowledge_graph_summary=None)]))
    rows = {t: store.table(t).filter("run_id = 'r1'" if "run_id" in store.table(t).columns else "true").collect() for t in TABLES}
    assert {t: len(x) for t, x in rows.items()} == {
        "repositories": 2, "snapshots": 2, "runs": 1, "analyzer_results": 1, "file_records": 2, "entity_records": 2, "graph_nodes": 6, "graph_edges": 4, "findings": 1, "health_scores": 1, "source_chunks": 2, "source_embeddings": 2,
    }
    assert {(r["file_path"], r["language"], r["parse_error"]) for r in rows["file_records"]} == {("app.py", "python", "last"), ("web/x.tsx", "typescript", None)}
    assert {(r["name"], r["class_owner"], r["extra"]) for r in rows["entity_records"]} == {("C", None, '{"bases":[]}'), ('f"\\é', "C", '{"deep":{"a":[1,"1",null]}}')}
    last = next(r["source_chunk_id"] for r in rows["source_chunks"] if r["position"] == 1)
    assert {(r["source_chunk_id"], tuple(r["vector"]), r["model_name"], r["commit_sha"]) for r in rows["source_embeddings"]} == {(last, (0.5, 1.0), "m", "abc"), ("given", (1.0,), "unknown", "abc")}
    assert rows["runs"][0]["status"] == "partial" and rows["runs"][0]["analyzed_at_utc"] is None and json.loads(rows["findings"][0]["raw"])["rule_id"] == "B1"
    summary = json.loads(store.documents().filter("run_id = 'r2'").first()["document"])["knowledge_graph_summary"]
    assert summary["call_edges_by_confidence"] == {"high_confidence": 1, "low_confidence": 1, "flagged": 1} and summary["call_edges_resolved_pct"] == 66.7 and summary["total_nodes"] == 6


def test_half_a_batch_is_invisible_and_can_be_written_again(spark, store, monkeypatch):
    store.append(frame(spark, [document(1, run_id="r1")]))

    def dies(self, batch):
        raise OSError("lost")

    monkeypatch.setattr(RunStore, "_commit", dies)
    with pytest.raises(OSError, match="lost"):
        store.append(frame(spark, [document(2, run_id="r2")]))
    monkeypatch.undo()
    assert [r["run_id"] for r in store.statuses().collect()] == ["r1"] and store.table("graph_nodes").count() == 6
    assert store.sweep() == len(TABLES) and store.sweep() == 0
    store.append(frame(spark, [document(2, run_id="r2")]))
    assert sorted(r["run_id"] for r in store.statuses().collect()) == ["r1", "r2"]


def test_a_run_that_comes_twice_counts_once(spark, store, monkeypatch):
    twice = frame(spark, [document(1, run_id="r1"), document(1, run_id="r1"), document(3), document(3)])
    store.append(twice)
    store.append(twice.unionByName(frame(spark, [document(5, run_id="r5")])))
    monkeypatch.setattr(run_store, "parsed", lambda d, f=run_store.parsed: f(d).withColumn("run_id", F.lit("r1")))
    racing = RunStore(spark, store.root)
    monkeypatch.setattr(racing, "_all", lambda name, f=racing._all: f(name).limit(0))  # a writer that began before the others committed
    racing.append(frame(spark, [document(1)]))
    assert len(store.batches()) == 3 and store.table("runs").count() == 3 and store.table("graph_edges").count() == 12
    assert store.table("repositories").count() == 1 and store.documents().count() == 3


def test_odd_documents(spark, store):
    odd = frame(spark, [None, "", "[1]", "{broken", "{}", json.dumps({"run_id": "r", "knowledge_graph": {"nodes": [{}], "edges": [{}]}})])
    assert run_store.rejected(odd).count() == 4
    assert store.documents().count() == 0
    store.append(odd)
    got = {r["run_id"]: json.loads(r["document"]) for r in store.documents().collect()}
    assert len(got) == 2 and got["r"]["knowledge_graph"]["nodes"] == [{"id": "", "type": "unknown"}] and got["r"]["repository"] == "unknown"
    store.append(odd.limit(0))
    assert store.table("runs").count() == 2


def test_known_documents_are_not_parsed_again(spark, store, monkeypatch):
    old = [document(1, run_id="r1"), document(3)]
    store.append(frame(spark, old))
    seen = []
    monkeypatch.setattr(run_store, "parsed", lambda d, f=run_store.parsed: (seen.append(d.count()), f(d))[1])
    store.append(frame(spark, [*old, document(2, run_id="r2")]))
    assert seen == [1] and store.table("runs").count() == 3


def broadcasts(df):
    """How many sides of joins would be gathered on the driver."""
    return len(re.findall(r"[-:] BroadcastExchange", df._jdf.queryExecution().executedPlan().toString()))


def test_rows_of_runs_are_not_broadcast(spark, store, tmp_path):
    want = [document(n, run_id=f"r{n}") for n in range(40)]
    store.append(frame(spark, want[:30]))
    stored = store.table("runs").select("run_id")
    for known in (0, 20, 30):  # none, some or all of the documents are stored
        given = frame(spark, want[30 - known : 40 if known < 30 else 30])
        left = run_store._unknown(given, stored)
        assert broadcasts(left) == 0 and left.count() == given.count() - known
    store.append(frame(spark, want))
    assert len(store.batches()) == 2 and store.table("runs").count() == 40
    assert {t: broadcasts(store.table(t)) for t in TABLES} == dict.fromkeys(TABLES, 0)
    assert broadcasts(store.documents()) <= 2  # snapshots and repositories
    path = f"file://{tmp_path}/parsed"
    run_store.parsed(frame(spark, want)).write.parquet(path)
    rows = run_store.split(spark.read.schema(run_store.parsed(frame(spark, [])).schema).parquet(path))
    assert {t: broadcasts(x) for t, x in rows.items()} == dict.fromkeys(TABLES, 0)


def test_runs_of_racing_writers_are_not_broadcast(spark, store, monkeypatch):
    store.append(frame(spark, [document(1, run_id="r1"), document(2, run_id="r2")]))
    racing = RunStore(spark, store.root)
    monkeypatch.setattr(racing, "_all", lambda name, f=racing._all: f(name).limit(0))
    racing.append(frame(spark, [document(2, run_id="r2"), document(3, run_id="r3")]))
    for reader in (store, RunStore(spark, store.root)):
        runs = reader.table("runs")
        assert broadcasts(runs) == 0 and sorted(r["run_id"] for r in runs.collect()) == ["r1", "r2", "r3"]
        assert reader.table("graph_edges").count() == 12 and reader.documents().count() == 3


def test_the_query_broadcasts_no_runs(spark):
    assert broadcasts(REGISTRY["run_store"].run(spark, "/root/testdata/sf0.001")) <= 2
