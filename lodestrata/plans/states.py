"""States of analyses, jobs and reviews, reports of evaluations, evidence and small sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import evaluation, graph, health, jobs, ranking, retrieval
from lodestrata.plans import query
from lodestrata.plans.retrieval import _BM25, _bm25
from lodestrata.plans.store import new_root
from lodestrata.sources import views as V
from lodestrata.sources.views import sql

_COMPONENT = "case when l_orderkey % 3 = 0 then 'success' when l_returnflag = 'R' then 'partial' when l_returnflag = 'A' then 'unsupported' when l_orderkey % 5 = 0 then 'failed' else 'success' end"


@query(
    "overall_status",
    f"""with c as (select l_orderkey as run_id, {_COMPONENT} as status from lineitem)
    select run_id, case when count(*) filter (where status in ('success', 'partial')) = 0 then 'failed' when count(*) = count(*) filter (where status = 'success') then 'complete' else 'partial' end as status from c group by run_id""",
)
def overall_status(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.expr(_COMPONENT).alias("status"))
    return health.overall_status(rows.withColumn("has_score", F.col("status").isin("success", "partial")), "run_id")


@query(
    "review_states",
    """with r as (select source, case when source < 'src15' then 'TP' when source < 'src3' and doc_id % 2 = 0 then 'FP' when source < 'src3' then '' end as label from documents)
    select source, count(*) as total, count(*) filter (where label in ('TP', 'FP')) as reviewed,
    case when count(*) filter (where label in ('TP', 'FP')) = 0 then 'NOT VALIDATED' when count(*) filter (where label in ('TP', 'FP')) = count(*) then 'VALIDATED' else 'INCOMPLETE' end as state from r group by source""",
)
def review_states(spark, d):
    label = F.expr("case when source < 'src15' then 'tp ' when source < 'src3' and doc_id % 2 = 0 then 'FP' when source < 'src3' then '' end")
    rows = V.table(spark, d, "documents").select("source", F.upper(F.trim(label)).alias("label"))
    counted = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("label").isin("TP", "FP", "AMBIGUOUS", "FN")).alias("reviewed"))
    return counted.withColumn("state", evaluation.review_state(F.col("reviewed"), F.col("total")))


_RATED = "select doc_id, n_chars, quality, toxic from labels join documents using (doc_id)"
_PAIRED = (("length-quality", "n_chars", "quality"), ("length-toxic", "n_chars", "toxic"), ("quality-toxic", "quality", "toxic"))


def _agreed(name: str, x: str, y: str) -> str:
    return f"""select '{name}' as pair, (select corr(rx, ry) from (select rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0::double as rx, rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0::double as ry from r)) as rho,
    (select sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) / sqrt(count(*) filter (where a.{x} <> b.{x})::double * count(*) filter (where a.{y} <> b.{y})) from r a join r b on a.doc_id < b.doc_id) as tau"""


@query(
    "rating_quorum",
    f"""with r as ({_RATED}), n as (select count(*) as pairs, (select count(*) from documents) as total, count(*) filter (where toxic = 1) as excluded from r),
    c as ({" union all ".join(_agreed(*p) for p in _PAIRED)})
    select pair, pairs, case when pairs < 15 or pairs < total then 'INCOMPLETE' else 'VALIDATED' end as state, pairs >= 15 and pairs = total and excluded = 0 as validated,
      pairs >= 15 and coalesce(rho, 0) >= 0.6 as meets_rho, pairs >= 15 and coalesce(tau, 0) >= 0.8 as meets_tau, round(coalesce(rho, 0), 7) as rho, round(coalesce(tau, 0), 7) as tau from c, n""",
)
def rating_quorum(spark, d):
    """What the labels' ratings show by the protocol: each pair of them correlated, of all documents that should be rated."""
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    rows = V.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "n_chars", "quality", "toxic")
    counts = rows.agg(F.count("*").alias("pairs"), F.count_if(F.col("toxic") == 1).alias("excluded")).withColumn("total", F.lit(docs.count()))
    out = None
    for name, x, y in _PAIRED:
        one = evaluation.spearman(rows, x, y).select("rho").join(F.broadcast(evaluation.kendall(rows, x, y).select("tau"))).withColumn("pair", F.lit(name))  # one row each
        out = one if out is None else out.unionByName(one)
    c = F.col
    shown = out.join(F.broadcast(counts))
    return shown.select("pair", "pairs", *evaluation.quorum(c("pairs"), c("rho"), c("tau"), c("total"), c("excluded")), F.round("rho", 7).alias("rho"), F.round("tau", 7).alias("tau"))


_STATE = "case when conv_id % 7 = 0 then 'failed' when conv_id % 11 = 0 then 'skipped' else 'success' end"


@query(
    "answer_report",
    f"""with a as (select role, {_STATE} as state, turn % 3 <> 2 as ok, case when turn % 4 = 3 then [] else ['f' || turn % 4, 'f' || conv_id % 3, 'f' || turn % 4] end as cited,
      case when conv_id % 5 = 4 then [] else ['f' || turn % 2, 'f2'] end as expected, text like '%e%' as refused from conversations),
    m as (select role, state, ok, refused, case when len(cited) = 0 then 0.0 else len(list_filter(cited, lambda c: list_contains(expected, c))) / len(cited)::double end as p,
      case when len(cited) = 0 then 0.0 when len(expected) = 0 then 1.0 else len(list_intersect(cited, expected)) / len(expected)::double end as r from a),
    c as (select role, grouping(role)::int as overall, count(*) as total, count(*) filter (where state = 'success') as succeeded, count(*) filter (where state = 'failed') as failed, count(*) filter (where state = 'skipped') as skipped,
      round(avg(p) filter (where state = 'success' and ok), 4) as precision, round(avg(r) filter (where state = 'success' and ok), 4) as recall,
      round(1 - count(*) filter (where state = 'success' and not ok and refused) / nullif(count(*) filter (where state = 'success' and not ok), 0)::double, 4) as hallucination from m group by rollup (role))
    select *, round(100.0::double * succeeded / total, 1) as coverage,
    case when succeeded + failed = 0 then 'BLOCKED' when succeeded = total then 'COMPLETED' when succeeded > 0 then 'PARTIAL' else 'FAILED' end as state from c""",
)
def answer_report(spark, d):
    rows = V.table(spark, d, "conversations").select(
        "role", F.expr(_STATE).alias("state"), F.expr("case when turn % 3 = 0 then true end").alias("answerable"), F.expr("case when turn % 3 = 2 then true end").alias("unanswerable"),
        F.expr("case when turn % 4 = 3 then null else array('f' || turn % 4, 'f' || conv_id % 3, 'f' || turn % 4) end").alias("cited"),
        F.expr("case when conv_id % 5 = 4 then null else array('f' || turn % 2, 'f2', 'f2') end").alias("expected"), F.col("text").like("%e%").alias("refused"),
    )
    return evaluation.answer_report(rows, "role")


_STAGE = "case when l_returnflag = 'R' then 'pending' when l_returnflag = 'A' then 'running' when l_linestatus = 'F' then 'failed' else 'completed' end"
_STAGES = f"s as (select l_orderkey as job_id, l_linenumber as stage, max({_STAGE}) as status, max(case when l_returnflag <> 'R' then l_shipdate end) as started_at from lineitem group by all)"


def _job_tables(spark, d):
    j = V.table(spark, d, "orders").selectExpr("o_orderkey as job_id", "'running' as status", "cast(o_orderkey % 100 as int) as progress", "cast(1 + o_orderkey % 7 as int) as current_stage", "o_orderdate as at")
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"), F.expr(_STAGE).alias("status"), F.expr("case when l_returnflag <> 'R' then l_shipdate end").alias("started_at"))
    s = rows.groupBy("job_id", "stage").agg(F.max("status").alias("status"), F.max("started_at").alias("started_at"))
    return j, s.withColumn("completed_at", F.lit(None).cast(s.schema["started_at"].dataType))


@query(
    "jobs_completed",
    f"""with {_STAGES} select job_id, stage, case when job_id % 4 = 0 then 'partial' when job_id % 4 = 1 then 'completed' else 'running' end as job_status, case when job_id % 4 < 2 then 100 else (job_id % 100)::int end as progress,
    case when job_id % 4 < 2 then job_id * 10 end as run_id, case when job_id % 4 < 2 and s.status in ('pending', 'running') then 'completed' else s.status end as status,
    case when job_id % 4 < 2 and s.status in ('pending', 'running') then coalesce(started_at, o_orderdate) else started_at end as started_at, case when job_id % 4 < 2 and s.status in ('pending', 'running') then o_orderdate end as completed_at
    from s join orders on o_orderkey = job_id""",
)
def jobs_completed(spark, d):
    j, s = _job_tables(spark, d)
    done = j.filter("job_id % 4 < 2").selectExpr("job_id", "job_id * 10 as run_id", "case when job_id % 4 = 0 then 'partial' else 'completed' end as final_status", "at")
    new, marked = jobs.complete(j.drop("at"), s, done)
    return marked.join(new.withColumnRenamed("status", "job_status"), "job_id")


@query(
    "jobs_failed",
    f"""with {_STAGES} select job_id, stage, case when job_id % 4 = 3 then 'failed' else 'running' end as job_status, (job_id % 100)::int as progress, case when job_id % 4 = 3 then 'out of memory' end as error,
    case when job_id % 4 = 3 and stage = 1 + job_id % 7 then 'failed' else s.status end as status, started_at, case when job_id % 4 = 3 and stage = 1 + job_id % 7 then o_orderdate end as completed_at from s join orders on o_orderkey = job_id""",
)
def jobs_failed(spark, d):
    j, s = _job_tables(spark, d)
    new, marked = jobs.fail(j.drop("at"), s, j.filter("job_id % 4 = 3").select("job_id", F.lit("out of memory").alias("error"), "at"))
    return marked.join(new.withColumnRenamed("status", "job_status"), "job_id")


@query(
    "failed_auth_limit",
    """with recursive e as (select event_id as request_id, sha256(user_id::varchar) as key, epoch(ts)::double as moment, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'error'),
    f as (select request_id, key, k, moment, 1.0::double as rest, true as allowed, 0 as retry_after from e where k = 1
      union all select x.request_id, x.key, x.k, x.moment, case when t >= 1 then t - 1 else t end, t >= 1, case when t >= 1 then 0 else greatest(1, ceil((1 - t) / (2 / 60.0::double)))::int end
      from (select e.*, case when e.moment - f.moment > 3600 then 2.0::double else least(2, f.rest + greatest(0, e.moment - f.moment) * 2 / 60.0::double) end as t from f join e on e.key = f.key and e.k = f.k + 1) as x)
    select request_id, key, allowed, retry_after from f""",
)
def failed_auth_limit(spark, d):
    """Only requests that failed to identify themselves draw on the bucket of their address."""
    from lodestrata.streaming.rate_limit import admit

    failed = V.table(spark, d, "events").filter("event_type = 'error'")
    return admit(failed.select(F.col("event_id").alias("request_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("key"), F.col("ts").cast("timestamp").alias("at")), rpm=2)


_FILES = f"""{_BM25}, h as (select query_id, 'g' || id % 50 as file, score, id from scores),
  fb as (select query_id, file, max(score) as score, arg_min(id, (-score, id)) as id from h group by all),
  fr as (select query_id, file, score, row_number() over (partition by query_id order by score desc, id)::int as rank from fb)"""


def _file_ranks(spark, d):
    """Of each file the best document is found where its documents are scored."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("g"), (F.col("doc_id") % 50).cast("string")).alias("file"))
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = ranking.bm25(docs, items, 1, new_root(spark), group="file")
    if best is None:
        return retrieval.file_ranking(retrieval.bm25(docs.drop("file"), items), docs.select("id", "file"))
    return retrieval.file_ranking(best)


@query("file_ranking", f"with {_FILES} select query_id, file, round(score, 8) as score, rank from fr")
def file_ranking(spark, d):
    return _file_ranks(spark, d).withColumn("score", F.round("score", 8))


@query(
    "file_retrieval",
    f"""{sql("truth")}, {_FILES}, w as (select distinct item_id as query_id, 'g' || doc_id % 50 as file from truth), n as (select query_id, count(*) as wanted from w group by 1),
    f as (select query_id, count(*) filter (where rank <= 5) as found, min(rank) as first from fr join w using (query_id, file) group by 1), best as (select query_id, max(score) as top from fr group by 1)
    select count(*) as queries, round(avg(coalesce(found, 0) / wanted::double), 4) as recall_5, round(avg(coalesce(1.0::double / first, 0)), 4) as mrr, round(avg(top), 4) as top_mean from n left join f using (query_id) left join best using (query_id)""",
)
def file_retrieval(spark, d):
    """Recall at 5 and reciprocal rank over whole rankings of files, with the mean of the best scores."""
    ranks = _file_ranks(spark, d)
    truth = V.truth(spark, d).select(F.col("item_id").alias("query_id"), F.concat(F.lit("g"), (F.col("doc_id") % 50).cast("string")).alias("file"))
    at5 = evaluation.retrieval_metrics(ranks, truth, "query_id", "file", 5).select("query_id", "recall")
    first = evaluation.retrieval_metrics(ranks, truth, "query_id", "file", 2**31 - 1).select("query_id", "reciprocal_rank")
    best = ranks.filter("rank = 1").select("query_id", F.col("score").alias("top"))
    rows = at5.join(first, "query_id").join(best, "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall_5"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), F.round(F.avg("top"), 4).alias("top_mean"))


_HEAD = """'[E' || rank || ']' || chr(10) || 'File: ' || coalesce(source, '') || chr(10) || 'Lines: 1-' || len(string_split(text, chr(10))) || chr(10) || 'Language: ' || coalesce(lang, 'unknown') || chr(10)
      || case when doc_id % 2 = 0 then 'Entity: function f' || doc_id || chr(10) else '' end || 'ChunkID: ' || doc_id || chr(10) || chr(10)"""


@query(
    "evidence_blocks",
    f"""with recursive {_BM25}, e as (select query_id, rank, doc_id, {_HEAD} as head, text from ranked join documents on doc_id = id where rank <= 6),
    f as (select distinct query_id, 0 as rank, 0 as used, false as full_, 0 as n, null::varchar as block, null::bigint as chunk from e
      union all select query_id, rank, case when stop then used else used + length(block) end, stop, n + (not stop)::int, case when not stop then block end, chunk
      from (select *, full_ or room <= 0 or (length(block) > room and n > 0) as stop from (select e.query_id, e.rank, f.used, f.full_, f.n, e.doc_id as chunk, 4000 - f.used as room,
        case when length(head) + length(text) <= 4000 - f.used then head || text else head || substr(text, 1, greatest(0, 4000 - f.used - length(head) - 12)) || chr(10) || '[truncated]' end as block
        from f join e on e.query_id = f.query_id and e.rank = f.rank + 1)))
    select query_id, 'E' || rank as label, chunk::varchar as chunk_id, block from f where block is not null""",
)
def evidence_blocks(spark, d):
    """The six best documents of each question as labelled blocks under 4,000 characters."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    rows = docs.join(F.broadcast(_bm25(spark, d, 6)), "id")
    chunk = F.struct(
        "rank", F.col("id").alias("chunk_id"), F.col("source").alias("path"), F.lit(1).alias("first"), F.size(F.split("text", "\n")).alias("last"), "lang",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("function f"), F.col("id").cast("string"))).alias("entity"), F.lit("").alias("sha"), "text",
    )
    packed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(chunk)).alias("c"))  # six documents a question
    return packed.select("query_id", F.explode(retrieval.labelled_evidence(F.col("c"), 4000)).alias("b")).select("query_id", "b.label", "b.chunk_id", "b.block")


@query(
    "settled_answers",
    """select conv_id, turn, turn % 3 in (1, 2) as refused, case when turn % 3 in (1, 2) then 'The available repository evidence is insufficient to determine this.' else sha256(text) end as answer, case when turn % 3 in (1, 2) then 0 else 2 end as cited from conversations where text <> ''""",
)
def settled_answers(spark, d):
    answer = F.expr("case turn % 3 when 1 then '' when 2 then 'Evidence is INSUFFICIENT' else sha2(text, 256) end")
    said, cited = retrieval.settle(answer, F.array(F.lit("E1"), F.lit("E2")))
    return V.table(spark, d, "conversations").filter("text <> ''").select("conv_id", "turn", (said == retrieval.INSUFFICIENT).alias("refused"), said.alias("answer"), F.size(cited).alias("cited"))


@query("missing_sources", "select 'src' || i as source from range(0, 40) t(i) where 'src' || i not in (select source from documents)")
def missing_sources(spark, d):
    wanted = spark.range(40).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return wanted.join(V.table(spark, d, "documents").select("source"), "source", "left_anti")


@query("filter_options", "select list_sort(list_distinct(list(event_type) || ['all', 'bandit'])) as options from events")
def filter_options(spark, d):
    return V.table(spark, d, "events").agg(F.collect_set("event_type").alias("seen")).select(F.sort_array(F.array_union(F.array(F.lit("all"), F.lit("bandit")), "seen")).alias("options"))


@query("corpus_counts", "select count(distinct source) as files, count(*) as chunks from documents")
def corpus_counts(spark, d):
    return V.table(spark, d, "documents").agg(F.count_distinct("source").alias("files"), F.count("*").alias("chunks"))


@query("manifest_union", "select p_brand as name from part where p_size < 25 union select p_type from part where p_size >= 25")
def manifest_union(spark, d):
    p = V.table(spark, d, "part")
    return p.filter("p_size < 25").select(F.col("p_brand").alias("name")).union(p.filter("p_size >= 25").select("p_type")).distinct()


_EDGES = "case when l_returnflag = 'R' then 'high_confidence' when l_returnflag = 'A' then 'odd' when l_linenumber > 3 then 'low_confidence' end"


@query(
    "stored_summary",
    f"""with e as (select case when l_linestatus = 'F' then 'calls' when l_linenumber = 1 then 'inherits' when l_linenumber = 2 then 'depends_on' else 'has_finding' end as relation, coalesce({_EDGES}, 'flagged') as confidence from lineitem),
    n as (select case when p_size < 10 then 'finding' when p_size < 20 then 'class' when p_size < 40 then 'function' else 'file' end as node_type from part),
    b as (select confidence, count(*) as n from e where relation = 'calls' group by 1),
    c as (select count(*) as edges, count(*) filter (where relation = 'calls') as calls, count(*) filter (where relation = 'inherits') as inherits, count(*) filter (where relation = 'depends_on') as depends_on,
      count(*) filter (where relation = 'has_finding') as has_finding, count(*) filter (where relation = 'calls' and confidence in ('high_confidence', 'low_confidence')) as good from e)
    select (select count(*) from n) as nodes, edges, calls, inherits, depends_on, has_finding, round(100.0::double * good / greatest(calls, 1), 1) as resolved_pct,
      (select string_agg(confidence || '=' || n, ',' order by confidence) from b) as by_confidence, (select count(*) from n where node_type = 'finding') as findings,
      (select count(*) from n where node_type = 'class') as classes, (select count(*) from n where node_type = 'function') as functions, (select count(*) from n where node_type = 'file') as files from c""",
)
def stored_summary(spark, d):
    relation = F.expr("case when l_linestatus = 'F' then 'calls' when l_linenumber = 1 then 'inherits' when l_linenumber = 2 then 'depends_on' else 'has_finding' end")
    edges = V.table(spark, d, "lineitem").select(relation.alias("relation"), F.expr(_EDGES).alias("confidence"))
    kind = F.expr("case when p_size < 10 then 'finding' when p_size < 20 then 'class' when p_size < 40 then 'function' else 'file' end")
    return graph.stored_summary(V.table(spark, d, "part").select(kind.alias("node_type")), edges)
