"""Stored runs. Every 25 documents of a source are the files of one run: nodes, findings, calls and line windows come from their texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import chunking
from lodestrata.plans import query
from lodestrata.sources import views as V
from lodestrata.sources.run_store import RunStore

_RUN = "concat_ws('-', coalesce(source, 'none'), cast(doc_id div 25 as string))"
_STATUS = "case (doc_id div 25) % 4 when 0 then 'partial' when 1 then 'odd' else 'complete' end"


def run_documents(spark: SparkSession, d: str) -> DataFrame:
    """(document): a nested result for each run, as JSON."""
    docs = V.table(spark, d, "documents").select("*", F.expr(_RUN).alias("run_id"), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("path"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text"))
    path, at = F.col("path"), F.col("doc_id")
    js = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    found = F.contains(F.lower("text"), F.lit("license"))
    nodes = F.array_compact(F.array(
        js(id=path, type=F.lit("file"), provenance=F.lit("walk")),
        js(id=F.concat(path, F.lit("::main")), type=F.lit("function"), name=F.lit("main"), file=path, start_line=F.lit(1), end_line=F.greatest(F.lit(1), n), lang=F.col("lang"), provenance=F.lit("scan")),
        F.when(found, js(id=F.concat(F.lit("finding::"), path), type=F.lit("finding"), analyzer=F.lit("words"), rule_id=F.lit("L1"), severity=F.lit("LOW"), file=path, line=F.lit(1), message=F.lit("license"))),
    ))
    before = F.lag("path").over(Window.partitionBy("run_id").orderBy("doc_id"))
    sure = F.when(at % 3 == 0, "high_confidence").when(at % 3 == 1, "low_confidence")
    edges = F.array_compact(F.array(
        js(source=path, target=F.concat(path, F.lit("::main")), relation=F.lit("contains"), confidence=F.lit("structural_certain")),
        F.when(F.col("_before").isNotNull(), js(source=F.concat("_before", F.lit("::main")), target=F.concat(path, F.lit("::main")), relation=F.lit("calls"), confidence=sure, line=n)),
    ))
    windows = chunking.windows(docs.select(F.col("path").alias("file_path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", "run_id", "lang"))
    chunk = F.struct("chunk_id", "file_path", "start_line", "end_line", "chunk_text", F.col("lang").alias("language"))
    chunks = windows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "start_line", chunk.alias("c")))), lambda x: x["c"]).alias("source_chunks"))
    rows = docs.withColumn("_before", before).select("run_id", "doc_id", F.struct("doc_id", nodes.alias("nodes"), edges.alias("edges")).alias("g"), F.when(F.col("text").isNull(), F.struct(path.alias("file"), F.lit("no text").alias("error"))).alias("e"), "source", F.expr(_STATUS).alias("status"))
    graph = F.array_sort(F.collect_list("g"))  # 25 files of a run
    rows = rows.groupBy("run_id").agg(F.first("source").alias("source"), F.first("status").alias("status"), graph.alias("g"), F.sort_array(F.collect_list("e")).alias("parse_errors"), F.count("*").alias("files_analyzed"))
    listed = lambda part: F.concat(F.lit("["), F.array_join(F.flatten(F.transform("g", lambda x: x[part])), ","), F.lit("]"))
    head = F.to_json(F.struct(
        "run_id", F.concat(F.lit("https://example.org/"), F.coalesce("source", F.lit("none"))).alias("repository"), F.substring("run_id", -1, 1).alias("cache_snapshot_id"), F.col("status").alias("analysis_status"), "files_analyzed", "parse_errors",
        F.lit("2026-01-01T00:00:00").alias("analyzed_at_utc"), F.struct(F.struct(F.lit("success").alias("status"), F.array(F.col("files_analyzed")).alias("results")).alias("words")).alias("static_analysis"), "source_chunks",
    ))
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"knowledge_graph":{"nodes":'), listed("nodes"), F.lit(',"edges":'), listed("edges"), F.lit("}}"))
    return rows.join(chunks, "run_id", "left").select(whole.alias("document"))


def new_root(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a private one is made only in a local session that configures none."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
    return f"{base.rstrip('/')}/lodestrata-{uuid.uuid4().hex}"


_RUNS = """d as (select *, coalesce(source, 'none') || '-' || (doc_id // 25) as run_id, coalesce(source, 'none') || '/' || doc_id as path, coalesce(length(text), 0) as n from documents),
  w as (select run_id, path, len(string_split(text, chr(10))) - (text like '%' || chr(10))::int as lines, text from d where text <> ''),
  c as (select run_id, sum(ceil(lines / 50.0))::bigint as chunks, sum(length(text) - (text like '%' || chr(10))::int - (ceil(lines / 50.0)::bigint - 1))::bigint as chunk_chars from w group by run_id),
  l as (select *, lag(path) over (partition by run_id order by doc_id) as before from d)"""


@query(
    "run_store",
    f"""with {_RUNS}
    select l.run_id, 'https://example.org/' || coalesce(any_value(source), 'none') as repository, case any_value((doc_id // 25) % 4) when 0 then 'partial' when 1 then 'partial' else 'complete' end as status,
      count(*) as files, count(*) as entities, count(*) filter (where contains(lower(text), 'license')) as findings, 2 * count(*) + count(*) filter (where contains(lower(text), 'license')) as nodes,
      count(*) + count(before) as edges, count(*) filter (where text is null) as errors, coalesce(any_value(chunks), 0) as chunks, coalesce(any_value(chunk_chars), 0) as chunk_chars,
      md5(string_agg(coalesce(before || '::main', '') || '>' || path || '::main:' || coalesce(case doc_id % 3 when 0 then 'high_confidence' when 1 then 'low_confidence' end, '') || n, ',' order by path) filter (where before is not null)) as calls_md5,
      coalesce(round(100 * count(before) filter (where doc_id % 3 < 2) / greatest(1, count(before)), 1), 0) as resolved_pct
    from l left join c on c.run_id = l.run_id group by l.run_id""",
)
def run_store(spark, d):
    """Every run is written, written again, read back as tables and regrouped as a document; a row for each run says what came back."""
    store = RunStore(spark, new_root(spark))
    run_documents(spark, d).write.parquet(f"{store.root}/documents")  # made once for both
    documents = spark.read.schema("document string").parquet(f"{store.root}/documents")
    store.append(documents)
    store.append(documents)  # nothing new
    count = lambda name, *more: store.table(name).groupBy("run_id").agg(F.count("*").alias(name), *more)
    line = F.get_json_object("attributes", "$.line")
    call = F.when(F.col("relation") == "calls", F.concat("source", F.lit(">"), "target", F.lit(":"), F.coalesce("confidence", F.lit("")), line))
    parts = [
        count("file_records", F.count("parse_error").alias("errors")), count("entity_records"), count("findings"), count("graph_nodes"),
        count("graph_edges", F.md5(F.array_join(F.array_sort(F.collect_list(F.struct(F.substring_index("target", "::", 1).alias("path"), call.alias("c"))))["c"], ",")).alias("calls_md5"), F.count(call).alias("calls")),
        count("source_chunks", F.sum(F.length("chunk_text")).alias("chunk_chars")),
    ]
    summary = store.documents().select("run_id", F.get_json_object("document", "$.repository").alias("repository"), F.get_json_object("document", "$.knowledge_graph_summary.call_edges_resolved_pct").cast("double").alias("resolved_pct"))
    out = store.table("runs").select("run_id", "status").join(summary.hint("merge"), "run_id")  # each has a row for each run, so none is broadcast
    for p in parts:
        out = out.join(p.hint("merge"), "run_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return out.select(
        "run_id", "repository", "status", F.col("file_records").alias("files"), F.col("entity_records").alias("entities"), zero("findings", "findings"), F.col("graph_nodes").alias("nodes"), F.col("graph_edges").alias("edges"),
        "errors", zero("source_chunks", "chunks"), zero("chunk_chars", "chunk_chars"), F.when(F.col("calls") > 0, F.col("calls_md5")).alias("calls_md5"), "resolved_pct",
    )
