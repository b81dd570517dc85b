"""Stored analysis runs: a nested result document split into twelve tables, committed at once and regrouped.

A batch of documents is parsed once and written as one folder for each table, under a batch id. Nothing of it is visible until a file named
after the batch lies in ``commits``: it is made under another name and renamed, and is the last thing that a batch writes and the first
that a reader looks for. A writer that dies leaves folders that nobody reads; ``sweep`` removes them.

A run's id is the one its document bears, else a hash of the document, so a document that is appended again is known already and left
out; where two writers commit one run at the same time, readers take the batch with the smaller name. Repositories and snapshots are
got or created by their keys.

Parsed documents are range-partitioned by run once; tables that are only taken out of them are written as they lie, sorted by run and position, others
are range-partitioned anew, so that a lookup of single runs reads few row groups. Documents whose ids are stored are left out before the
rest is parsed whole. A document is one row by nature: ``documents`` regroups the rows of each run asked for.

Sorted ids are a few bytes each in a file, so Spark would take millions of runs for a small table and gather them on the driver for a broadcast
join. Joins whose sides have a row for each run or more are merge joins by hint; only repositories and snapshots, whose keys are
hashes, are left to its estimates.

Keys that a table has no column for are kept as JSON and merged back last. Defined results: a document that is no JSON object, or null, is set
aside by ``rejected``; missing lists are empty, a missing status is partial; an analyzer that isn't an object and the keys of ``NOT_TOOLS``
are no analyzers; nodes without a type are ``unknown``; of several parse errors of a file the last counts; an embedding whose chunk is unknown
is left out; a time that can't be read is null; no documents give a batch without runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys of a document.
NOT_TOOLS = ("scope_policy", "production_files_analyzed", "test_files_excluded")
JOINED = ("repositories", "snapshots", "file_records", "entity_records", "source_embeddings")  # tables that are more than a part of each document
ENTITY_TYPES = ("function", "class", "import_target")
_OBJECTS = "array<map<string,variant>>"
_CHUNK = "chunk_id:string,file_path:string,start_line:int,end_line:int,chunk_text:string,language:string,entity_name:string,entity_type:string,provenance:string,chunk_hash:string,commit_sha:string,chunker_version:string,schema_version:string"
_EMBEDDING = "chunk_id:string,source_chunk_id:string,commit_sha:string,model_name:string,model_version:string,dimension:int,pipeline_version:string,vector:array<double>"
DOCUMENT = f"""struct<run_id:string,repository:string,cache_snapshot_id:string,commit_sha:string,cache_key_basis:string,schema_version:string,cache_schema_version:string,
  analyzer_version:string,analyzed_at_utc:string,languages:variant,analysis_status:string,files_analyzed:bigint,parse_errors:array<struct<file:string,error:string>>,
  static_analysis:map<string,variant>,knowledge_graph_summary:variant,knowledge_graph:struct<nodes:{_OBJECTS},edges:{_OBJECTS}>,health_score:map<string,variant>,
  source_chunks:array<struct<{_CHUNK}>>,source_embeddings:array<struct<{_EMBEDDING}>>>"""
_NODE = ("id", "type", "name", "file", "start_line", "end_line", "provenance")
_EDGE = ("source", "target", "relation", "confidence", "provenance")
_RUN = ("schema_version", "cache_schema_version", "analyzer_version", "analyzed_at_utc", "analysis_status", "files_analyzed")

TABLES = {
    "repositories": "repo_id string, repo_url string",
    "snapshots": "snapshot_key string, repo_id string, snapshot_id string, commit_sha string, cache_key_basis string",
    "runs": "run_id string, snapshot_key string, status string, schema_version string, cache_schema_version string, analyzer_version string, analyzed_at_utc string, analysis_status string, files_analyzed long, languages string, parse_errors string, summary string",
    "analyzer_results": "run_id string, position int, analyzer_name string, status string, provenance string, results string, errors string, metadata string",
    "file_records": "run_id string, position int, file_path string, language string, parse_error string",
    "entity_records": "run_id string, position int, file_path string, entity_type string, name string, node_id string, start_line int, end_line int, class_owner string, provenance string, extra string",
    "graph_nodes": "run_id string, position int, node_id string, node_type string, name string, file_path string, start_line int, end_line int, provenance string, attributes string",
    "graph_edges": "run_id string, position int, source string, target string, relation string, confidence string, provenance string, attributes string",
    "findings": "run_id string, position int, analyzer string, rule_id string, severity string, file_path string, line int, message string, provenance string, raw string",
    "health_scores": "run_id string, composite double, status string, sub_scores string, component_statuses string, weights_used string, weights_renormalized boolean, missing_components string, formula string, formula_version string, scope_policy string",
    "source_chunks": f"run_id string, position int, source_chunk_id string, {_CHUNK.replace(':', ' ').replace(',', ', ')}",
    "source_embeddings": "run_id string, position int, source_chunk_id string, chunk_id string, repo_url string, commit_sha string, model_name string, model_version string, dimension int, pipeline_version string, vector array<float>",
}


def _digest(*parts) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def _rest(objects: Column, known: tuple) -> Column:
    """The keys that have no column, as JSON; null if there are none."""
    rest = F.map_filter(objects, lambda k, _: ~k.isin(*known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def _json(value: Column, empty: str | None = None) -> Column:
    text = F.to_json(value)
    return F.coalesce(F.when(text != "null", text), F.lit(empty)) if empty else F.when(text != "null", text)


def language_of(path: Column) -> Column:
    """By the ending, as it is written."""
    ends = lambda *endings: F.rlike(path, F.lit(r"(" + "|".join(f"\\.{e}" for e in endings) + r")$"))
    return F.when(ends("py"), "python").when(ends("java"), "java").when(ends("js", "jsx"), "javascript").when(ends("ts", "tsx"), "typescript").otherwise("unknown")


def parsed(documents: DataFrame) -> DataFrame:
    """(document: JSON) -> run_id, d (the document's fields); rows that are no object are left out."""
    d = F.from_json(F.col("document"), DOCUMENT)
    rows = documents.filter(_is_object()).select("document", d.alias("d"))
    rows = rows.withColumn("run_id", F.coalesce("d.run_id", _digest(F.col("document"))))
    return rows.dropDuplicates(["run_id"]).select("run_id", "d")


def _unknown(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """The documents but those whose id is stored; only the id is parsed. Ids are compared first: whole documents are dealt out only if some are stored and others aren't."""
    named = documents.withColumn("run_id", F.coalesce(F.from_json("document", "struct<run_id:string>")["run_id"], _digest(F.col("document"))))
    found = named.select("run_id").join(stored.distinct().withColumn("_stored", F.lit(True)).hint("merge"), "run_id", "left")
    total, known = found.agg(F.count("*"), F.count("_stored")).first()
    if known in (0, total):
        return documents.limit(0) if known else documents
    return named.join(stored.hint("merge"), "run_id", "left_anti").select("document")


def rejected(documents: DataFrame) -> DataFrame:
    """Documents that are no JSON object."""
    return documents.filter(~_is_object())


def _is_object() -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("document")), F.lit("OBJECT")), F.lit(False))


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """(run_id, d) -> the rows of each table."""
    repository, snapshot = F.coalesce("d.repository", F.lit("unknown")), F.coalesce("d.cache_snapshot_id", F.lit("unknown"))
    repo_id = _digest(repository)
    snapshot_key = _digest(repository, snapshot)
    each = lambda name: rows.select("run_id", F.col("d.commit_sha").alias("_sha"), repository.alias("repo_url"), F.posexplode(f"d.{name}").alias("position", "x"))
    known = F.col("d.analysis_status").isin("complete", "partial", "failed")
    out = {
        "repositories": rows.select(repo_id.alias("repo_id"), repository.alias("repo_url")).distinct(),
        "snapshots": rows.groupBy(snapshot_key.alias("snapshot_key"), repo_id.alias("repo_id"), snapshot.alias("snapshot_id")).agg(F.min_by("d.commit_sha", "run_id").alias("commit_sha"), F.min_by("d.cache_key_basis", "run_id").alias("cache_key_basis")),
    }
    at = F.when(F.try_to_timestamp("d.analyzed_at_utc").isNotNull(), F.col("d.analyzed_at_utc")).alias("analyzed_at_utc")
    out["runs"] = rows.select(
        "run_id", snapshot_key.alias("snapshot_key"), F.when(known, F.col("d.analysis_status")).otherwise("partial").alias("status"), *[at if c == "analyzed_at_utc" else F.col(f"d.{c}") for c in _RUN],
        _json(F.col("d.languages"), "[]").alias("languages"), F.coalesce(F.to_json("d.parse_errors"), F.lit("[]")).alias("parse_errors"), _json(F.col("d.knowledge_graph_summary")).alias("summary"),
    )
    tools = rows.select("run_id", F.posexplode(F.map_entries("d.static_analysis")).alias("position", "e")).select("run_id", "position", F.col("e.key").alias("analyzer_name"), F.to_json("e.value").alias("j"))
    tools = tools.filter(~F.col("analyzer_name").isin(*NOT_TOOLS) & F.startswith("j", F.lit("{"))).withColumn("x", F.from_json("j", "struct<status:string,provenance:string,results:variant,errors:variant,metadata:variant>"))
    out["analyzer_results"] = tools.select(
        "run_id", "position", "analyzer_name", F.coalesce("x.status", F.lit("unknown")).alias("status"), F.coalesce("x.provenance", F.lit("")).alias("provenance"),
        _json(F.col("x.results"), "[]").alias("results"), _json(F.col("x.errors"), "[]").alias("errors"), _json(F.col("x.metadata"), "{}").alias("metadata"),
    )

    of = lambda key: F.col("x")[key].cast("string")
    number = lambda key: F.try_variant_get(F.col("x")[key], "$", "int")
    nodes = each("knowledge_graph.nodes").withColumns({"type": F.coalesce(of("type"), F.lit("unknown")), "file": of("file"), "id": F.coalesce(of("id"), F.lit(""))})
    plain = [of("name").alias("name"), F.col("file").alias("file_path"), number("start_line").alias("start_line"), number("end_line").alias("end_line"), of("provenance").alias("provenance")]
    out["graph_nodes"] = nodes.select("run_id", "position", F.col("id").alias("node_id"), F.col("type").alias("node_type"), *plain, _rest(F.col("x"), _NODE).alias("attributes"))
    out["findings"] = nodes.filter("type = 'finding'").select(
        "run_id", "position", F.coalesce(of("analyzer"), F.lit("")).alias("analyzer"), of("rule_id").alias("rule_id"), of("severity").alias("severity"), F.col("file").alias("file_path"),
        number("line").alias("line"), of("message").alias("message"), of("provenance").alias("provenance"), F.to_json("x").alias("raw"),
    )
    errors = each("parse_errors").groupBy("run_id", F.col("x.file").alias("file_path")).agg(F.max_by("x.error", "position").alias("parse_error"))
    files = nodes.filter("type = 'file'").select("run_id", "position", F.col("id").alias("file_path"))
    out["file_records"] = files.withColumn("language", language_of(F.col("file_path"))).join(errors.hint("merge"), ["run_id", "file_path"], "left")
    entities = nodes.filter(F.col("type").isin(*ENTITY_TYPES) & (F.coalesce("file", F.lit("")) != ""))
    entities = entities.select("run_id", "position", *plain, F.col("type").alias("entity_type"), of("id").alias("node_id"), of("class_owner").alias("class_owner"), _rest(F.col("x"), (*_NODE, "class_owner")).alias("extra"))
    out["entity_records"] = entities.join(files.select("run_id", "file_path").hint("merge"), ["run_id", "file_path"])
    edges = each("knowledge_graph.edges")
    out["graph_edges"] = edges.select("run_id", "position", *[F.coalesce(of(c), F.lit("")).alias(c) for c in _EDGE[:3]], *[of(c).alias(c) for c in _EDGE[3:]], _rest(F.col("x"), _EDGE).alias("attributes"))
    health = rows.filter(F.size("d.health_score") > 0).select("run_id", F.col("d.health_score").alias("x"))
    out["health_scores"] = health.select(
        "run_id", F.try_variant_get(F.col("x")["composite_health_score"], "$", "double").alias("composite"), F.coalesce(of("status"), F.lit("unknown")).alias("status"),
        *[_json(F.col("x")[c]).alias(c) for c in ("sub_scores", "component_statuses", "weights_used", "missing_components")],
        F.coalesce(F.try_variant_get(F.col("x")["weights_renormalized"], "$", "boolean"), F.lit(False)).alias("weights_renormalized"), *[of(c).alias(c) for c in ("formula", "formula_version", "scope_policy")],
    )
    default = {"chunk_id": "", "file_path": "", "start_line": 1, "end_line": 1, "chunk_text": "", "chunk_hash": "", "chunker_version": "1", "schema_version": "1"}
    names = [c.split(":")[0] for c in _CHUNK.split(",")]
    fields = [F.coalesce(f"x.{c}", "_sha").alias(c) if c == "commit_sha" else F.coalesce(f"x.{c}", F.lit(default[c])).alias(c) if c in default else F.col(f"x.{c}") for c in names]
    chunks = each("source_chunks").select("run_id", "position", _digest(F.col("run_id"), F.col("position"), F.col("x.chunk_id")).alias("source_chunk_id"), *fields)
    out["source_chunks"] = chunks
    ids = chunks.filter("chunk_id <> ''").groupBy("run_id", "chunk_id").agg(F.max_by("source_chunk_id", "position").alias("of_run"))
    vectors = each("source_embeddings").withColumn("chunk_id", F.coalesce("x.chunk_id", F.lit(""))).join(ids.hint("merge"), ["run_id", "chunk_id"], "left")
    out["source_embeddings"] = vectors.select(
        "run_id", "position", F.coalesce("of_run", "x.source_chunk_id").alias("source_chunk_id"), "chunk_id", "repo_url", F.coalesce("x.commit_sha", "_sha").alias("commit_sha"),
        *[F.coalesce(f"x.{c}", F.lit(v)).alias(c) for c, v in (("model_name", "unknown"), ("model_version", "1.0"), ("dimension", 0), ("pipeline_version", "1"))], F.col("x.vector").cast("array<float>").alias("vector"),
    ).filter("source_chunk_id is not null")
    order = {t: [c.split()[0] for c in schema.split(", ")] for t, schema in TABLES.items()}
    return {t: out[t].select(*order[t]) for t in TABLES}


class RunStore:
    """Runs under a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._twice: dict[tuple, bool] = {}

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Committed batches: a file each."""
        fs, folder = self._fs(), self._path("commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith((".", "_"))) if fs.exists(folder) else []

    def _all(self, name: str) -> DataFrame:
        return self._of(name, self.batches())

    def _of(self, name: str, batches: list[str]) -> DataFrame:
        schema = f"{TABLES[name]}, batch string"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/batch={b}" for b in batches])

    def table(self, name: str) -> DataFrame:
        """The rows of visible runs."""
        if name in ("repositories", "snapshots"):
            rows = self._all(name)
            return rows.drop("batch").dropDuplicates([rows.columns[0]])
        batches = self.batches()
        rows = self._of(name, batches)
        if self._raced(batches):
            first = self._of("runs", batches).groupBy("run_id").agg(F.min("batch").alias("batch"))
            rows = rows.join(first.hint("merge"), ["run_id", "batch"], "left_semi")
        return rows.drop("batch")

    def _raced(self, batches: list[str]) -> bool:
        """Whether two of the batches hold the same run; looked up once for each set of batches, as a commit is for good."""
        key = tuple(batches)
        if key not in self._twice:
            self._twice[key] = len(key) > 1 and self._of("runs", batches).groupBy("run_id").count().filter("count > 1").count() > 0
        return self._twice[key]

    def append(self, documents: DataFrame) -> str:
        """Writes the documents that aren't stored yet and commits them at once; the name of the batch."""
        batch = uuid.uuid4().hex
        if self.batches():
            stored = self._all("runs").select("run_id")
            rows = parsed(_unknown(documents, stored)).join(stored.hint("merge"), "run_id", "left_anti")
        else:
            rows = parsed(documents)
        path = f"{self.root}/parsed/batch={batch}"
        rows.repartitionByRange("run_id").write.parquet(path)  # parsed once for twelve tables
        rows = self.spark.read.schema(rows.schema).parquet(path)
        for name, part in split(rows).items():
            if name == "repositories":
                part = part.join(self.table(name).select("repo_id"), "repo_id", "left_anti")
            elif name == "snapshots":
                part = part.join(self.table(name).select("snapshot_key"), "snapshot_key", "left_anti")
            keys = [c for c in ("run_id", "position") if c in part.columns] or part.columns[:1]
            (part.repartitionByRange(*keys) if name in JOINED else part).sortWithinPartitions(*keys).write.parquet(f"{self.root}/{name}/batch={batch}")
        self._fs().delete(self._path("parsed", f"batch={batch}"), True)
        self._commit(batch)
        return batch

    def _commit(self, batch: str) -> None:
        fs = self._fs()
        fs.mkdirs(self._path("commits"))
        fs.create(self._path("commits", f".{batch}"), False).close()
        if not fs.rename(self._path("commits", f".{batch}"), self._path("commits", batch)):
            raise OSError(f"batch {batch} could not be committed")

    def sweep(self) -> int:
        """Removes the folders of batches that were never committed; call it while nobody writes. How many folders went."""
        fs, kept, gone = self._fs(), set(self.batches()), 0
        for name in (*TABLES, "parsed"):
            for s in fs.listStatus(self._path(name)) if fs.exists(self._path(name)) else ():
                if s.getPath().getName().removeprefix("batch=") not in kept:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone

    def statuses(self) -> DataFrame:
        """A row for each run without its graph: run_id, repository, commit_sha, status and versions."""
        s, r = self.table("snapshots"), self.table("repositories")
        return self.table("runs").join(s, "snapshot_key").join(r, "repo_id").select("run_id", F.col("repo_url").alias("repository"), "commit_sha", "cache_key_basis", F.col("snapshot_id").alias("cache_snapshot_id"), "status", *_RUN, "languages", "parse_errors", "summary")

    def documents(self, runs: DataFrame | None = None) -> DataFrame:
        """run_id, document: the runs of ``runs`` (run_id), or all, as nested JSON again; chunks and vectors are read as tables."""
        own = self.statuses() if runs is None else self.statuses().join(runs.select("run_id").distinct(), "run_id", "left_semi")

        def grouped(name: str, made: Column, alias: str) -> DataFrame:
            rows = self.table(name) if runs is None else self.table(name).join(runs.select("run_id").distinct(), "run_id", "left_semi")
            listed = F.array_sort(F.collect_list(F.struct("position", made.alias("j"))))
            return rows.groupBy("run_id").agg(F.array_join(F.transform(listed, lambda x: x["j"]), ",").alias(alias))

        merged = lambda known, more: F.when(F.col(more).isNull(), known).otherwise(_merged(known, F.col(more)))
        node = F.to_json(F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("type"), "provenance", "name", F.col("file_path").alias("file"), "start_line", "end_line"))
        edge = F.to_json(F.struct("source", "target", "relation", "confidence", "provenance"), {"ignoreNullFields": "false"})
        tool = F.concat(_quoted("analyzer_name"), F.lit(":"), F.concat(F.lit('{"status":'), _quoted("status"), F.lit(',"results":'), F.col("results"), F.lit(',"provenance":'), _quoted("provenance"), F.lit(',"errors":'), F.col("errors"), F.lit(',"metadata":'), F.col("metadata"), F.lit("}")))
        out = own
        for name, made, alias in (("analyzer_results", tool, "tools"), ("graph_nodes", merged(node, "attributes"), "nodes"), ("graph_edges", merged(edge, "attributes"), "edges")):
            out = out.join(grouped(name, made, alias).hint("merge"), "run_id", "left")
        out = out.join(self._counted().hint("merge"), "run_id", "left").join(self.table("health_scores").withColumnRenamed("status", "health_status").hint("merge"), "run_id", "left")
        empty = lambda c: F.coalesce(c, F.lit(""))
        raw = lambda c, none: F.coalesce(F.col(c), F.lit(none))
        health = F.when(F.col("health_status").isNull(), "{}").otherwise(_object({
            "composite_health_score": raw_number("composite"), "status": _quoted("health_status"), "sub_scores": raw("sub_scores", "{}"), "component_statuses": raw("component_statuses", "{}"), "weights_used": raw("weights_used", "{}"),
            "weights_renormalized": raw_number("weights_renormalized"), "formula_version": _quoted("formula_version"), "missing_components": raw("missing_components", "[]"), "formula": _quoted("formula"), "scope_policy": _quoted("scope_policy"),
        }))
        return out.select("run_id", _object({
            "run_id": _quoted("run_id"), **{c: _quoted(c) for c in ("schema_version", "cache_schema_version", "analyzer_version", "repository", "commit_sha", "cache_snapshot_id", "cache_key_basis", "analyzed_at_utc", "analysis_status")},
            "languages": F.col("languages"), "files_analyzed": raw_number("files_analyzed"), "parse_errors": F.col("parse_errors"), "static_analysis": F.concat(F.lit("{"), empty(F.col("tools")), F.lit("}")),
            "knowledge_graph_summary": F.coalesce("summary", "counted", F.lit("null")),
            "knowledge_graph": F.concat(F.lit('{"nodes":['), empty(F.col("nodes")), F.lit('],"edges":['), empty(F.col("edges")), F.lit("]}")), "health_score": health,
        }).alias("document"))

    def _counted(self) -> DataFrame:
        """A summary of each run's graph from its tables, for documents that came without one."""
        n, e, calls = self.table("graph_nodes"), self.table("graph_edges"), F.col("relation") == "calls"
        sure = F.coalesce("confidence", F.lit("flagged"))
        nodes = n.groupBy("run_id").agg(F.count("*").alias("total_nodes"), F.count_if(F.col("node_type") == "finding").alias("finding_nodes_total"))
        of = lambda c: F.count_if(calls & (sure == c))
        edges = e.groupBy("run_id").agg(
            F.count("*").alias("total_edges"), F.count_if(calls).alias("call_edges_total"), *[of(c).alias(c) for c in ("high_confidence", "low_confidence", "flagged")],
            *[F.count_if(F.col("relation") == r).alias(f"{r}_edges_total") for r in ("inherits", "depends_on", "has_finding")],
        )
        rows = self.table("runs").select("run_id").join(nodes.hint("merge"), "run_id", "left").join(edges.hint("merge"), "run_id", "left").fillna(0)
        resolved = F.round(100 * (F.col("high_confidence") + F.col("low_confidence")) / F.greatest("call_edges_total", F.lit(1)), 1)
        by = F.struct("high_confidence", "low_confidence", "flagged").alias("call_edges_by_confidence")
        totals = F.struct("total_nodes", "total_edges", "call_edges_total", by, resolved.alias("call_edges_resolved_pct"), "inherits_edges_total", "depends_on_edges_total", "has_finding_edges_total", "finding_nodes_total")
        return rows.select("run_id", F.to_json(totals).alias("counted"))


def _quoted(column: str) -> Column:
    """A string as JSON; null if there is none."""
    text = F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def raw_number(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _object(fields: dict[str, Column]) -> Column:
    parts = []
    for k, (name, value) in enumerate(fields.items()):
        parts += [F.lit(f'{"," if k else "{"}"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _merged(known: Column, more: Column) -> Column:
    """Two JSON objects as one; where both have a key, the second's value counts."""
    kind = "map<string,variant>"
    a, b = F.from_json(known, kind), F.from_json(more, kind)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))
