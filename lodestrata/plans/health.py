"""Health score, run history and job queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import health, jobs, paging
from lodestrata.plans import query
from lodestrata.sources import views as V
from lodestrata.sources.views import sql

_SUB = """sub as (select run_id, avg(case when cc <= 5 then 100 when cc <= 10 then 85 when cc <= 20 then 70 when cc <= 30 then 50 when cc <= 40 then 30 else 10 end) as complexity,
    avg(greatest(0, least(100, mi))) as maintainability, greatest(0.0, 100.0 - sum(case severity when 'HIGH' then 15 when 'MEDIUM' then 7 else 2 end))::double as security,
    greatest(0.0, 100.0 - sum(case level when 'ERROR' then 15 else 2 end))::double as sast, greatest(0.0, 100.0 - sum(case when secret then 25 else 0 end))::double as secrets,
    greatest(0.0, 100.0 - sum(case when number = 7 then 20 else 0 end))::double as vulnerabilities from results group by run_id),
  gone as (select run_id, complexity, maintainability, case when run_id % 3 = 0 then null else security end as security, sast, case when run_id % 5 = 0 then null else secrets end as secrets, vulnerabilities from sub)"""
_W = {"complexity": 0.25, "maintainability": 0.25, "security": 0.2, "sast": 0.15, "secrets": 0.1, "vulnerabilities": 0.05}
_TOTAL = " + ".join(f"case when {c} is null then 0 else {w}::double end" for c, w in _W.items())
_SUM = " + ".join(f"coalesce({c} * {w}::double, 0)" for c, w in _W.items())


def _scores(spark, d):
    """Sub-scores of all runs; some runs lack components."""
    s = health.sub_scores(V.results(spark, d).withColumn("vulnerable", F.col("number") == 7))
    return s.withColumn("security", F.when(F.col("run_id") % 3 != 0, F.col("security"))).withColumn("secrets", F.when(F.col("run_id") % 5 != 0, F.col("secrets")))


@query("health_subscores", f"{sql('results')}, {_SUB} select run_id, round(complexity, 8) as complexity, round(maintainability, 8) as maintainability, security, sast, secrets, vulnerabilities from gone")
def health_subscores(spark, d):
    return _scores(spark, d).withColumns({c: F.round(c, 8) for c in ("complexity", "maintainability")})


@query("health_composite", f"{sql('results')}, {_SUB} select run_id, round(({_SUM}) / ({_TOTAL}) + 1e-11, 8) as composite, round({_TOTAL}, 8) as weight_total from gone")
def health_composite(spark, d):
    return health.composite(_scores(spark, d)).select("run_id", F.round(F.col("composite") + 1e-11, 8).alias("composite"), F.round("weight_total", 8).alias("weight_total"))


#: Analyzer blocks of a run and their results: each order has a block for most components, each line item is a result of one.
_PARTS = ("complexity", "maintainability", "security", "sast", "secrets", "vulnerabilities", "lizard")
_STATE = "case (run_id * 7 + repo_id * 3 + k * 5) % 11 when 0 then 'failed' when 1 then 'unavailable' when 2 then 'unsupported' when 3 then 'partial' else 'success' end"
_HAS = "((run_id + k) % 9 <> 0 and (k < 3 or k = 6 or version <> '5-LOW'))"
_RANK = "case l_suppkey % 8 when 0 then null when 1 then 'A' when 2 then 'B' when 3 then 'C' when 4 then 'D' when 5 then 'E' when 6 then 'F' else 'Z' end"
_SEVERITY = "case l_suppkey % 7 when 0 then 'high' when 1 then 'Medium' when 2 then 'LOW' when 3 then 'error' when 4 then 'Warning' when 5 then null else 'odd' end"


def _blocks(spark, d):
    runs = V.runs(spark, d).select("run_id", "repo_id", "version", F.posexplode(F.array(*map(F.lit, _PARTS))).alias("k", "component"))
    blocks = runs.filter(_HAS).select("run_id", "component", F.expr(_STATE).alias("status"))
    part = F.get(F.array(*map(F.lit, _PARTS)), F.col("l_linenumber") % 7)
    results = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), part.alias("component"), F.expr(_RANK).alias("rank"), F.col("l_quantity").cast("int").alias("cc"), (F.col("l_extendedprice") / 900 - 5).alias("mi"), F.expr(_SEVERITY).alias("severity"),
    )
    return blocks, results


_SIX, _THREE = _PARTS[:6], _PARTS[:3]
_GOOD = "in ('success', 'partial')"
_DOCUMENT = f"""{sql("runs")},
  b as (select run_id, component, {_STATE} as status from (select run_id, repo_id, version, unnest(range(7))::int as k, unnest({list(_PARTS)!r}) as component from runs) where {_HAS}),
  r as (select l_orderkey as run_id, {list(_PARTS)!r}[1 + l_linenumber % 7] as component, {_RANK} as rank, l_quantity::int as cc, l_extendedprice / 900 - 5 as mi, upper({_SEVERITY}) as severity from lineitem),
  s as (select run_id, bool_or(component in ('sast', 'secrets', 'vulnerabilities')) as newer, {", ".join(f"coalesce(max(status) filter (where component = '{c}'), 'unavailable') as s_{c}" for c in _PARTS)} from b group by run_id),
  f as (select run_id,
    avg(case coalesce(rank, 'C') when 'A' then 100 when 'B' then 85 when 'C' then 70 when 'D' then 50 when 'E' then 30 when 'F' then 10 else 50 end) filter (where component = 'complexity') as complexity,
    avg(case when cc <= 5 then 100 when cc <= 10 then 85 when cc <= 20 then 70 when cc <= 30 then 50 when cc <= 40 then 30 else 10 end) filter (where component = 'lizard') as lizard,
    avg(least(100, greatest(0, mi))) filter (where component = 'maintainability') as maintainability,
    sum(case severity when 'HIGH' then 15 when 'MEDIUM' then 7 else 2 end) filter (where component = 'security') as security,
    sum(case coalesce(severity, 'INFO') when 'HIGH' then 15 when 'ERROR' then 15 when 'WARNING' then 7 when 'MEDIUM' then 7 when 'INFO' then 2 when 'LOW' then 2 else 5 end) filter (where component = 'sast') as sast,
    25 * count(*) filter (where component = 'secrets') as secrets, 20 * count(*) filter (where component = 'vulnerabilities') as vulnerabilities from r group by run_id),
  c as (select run_id, newer, not s_complexity {_GOOD} and s_lizard {_GOOD} as stands_in,
    case when stands_in then s_lizard else s_complexity end as x_complexity, {", ".join(f"s_{c} as x_{c}" for c in _SIX[1:])},
    round_even(case when stands_in then coalesce(lizard, 100) when s_complexity {_GOOD} then coalesce(complexity, 100) end, 2) as complexity,
    round_even(case when s_maintainability {_GOOD} then coalesce(maintainability, 100) end, 2) as maintainability,
    case when s_security {_GOOD} then greatest(0, 100 - coalesce(security, 0))::double end as security,
    {", ".join(f"case when newer and s_{c} {_GOOD} then greatest(0, 100 - coalesce({c}, 0))::double end as {c}" for c in _SIX[3:])}
    from s left join f using (run_id)),
  w as (select *, {", ".join(f"case when {c} is not null then case when newer then {round(100 * _W[c])} else {dict(complexity=35, maintainability=35, security=30).get(c, 0)} end end::double as w_{c}" for c in _SIX)} from c),
  t as (select *, {" + ".join(f"coalesce(w_{c}, 0)" for c in _SIX)} as total, {" + ".join(f"coalesce(round({c} * 100) * w_{c}, 0)" for c in _SIX)} as summed,
    list_filter([{", ".join(f"case when {c} is not null then '{c}' end" for c in _SIX)}], lambda x: x is not null) as scored from w)
  select run_id, round_even(summed / nullif(total, 0), 0) / 100 as composite,
    case when len(scored) = 0 then 'failed' when {" and ".join(f"x_{c} = 'success'" for c in _THREE)} and (not newer or {" and ".join(f"x_{c} = 'success'" for c in _SIX[3:])}) then 'complete' else 'partial' end as status,
    {", ".join(_SIX)}, {", ".join(f"round_even(w_{c} / total, 4) as {c}_weight" for c in _SIX)},
    array_to_string(scored, ',') as components_scored, len(scored) < case when newer then 6 else 3 end as reduced from t"""


@query("health_document", _DOCUMENT)
def health_document(spark, d):
    """Scores by status of analyzers and by their results, with fallbacks, weights by presence and what is disclosed."""
    rows = health.score_document(*_blocks(spark, d))
    return rows.select("run_id", "composite", "status", *_SIX, *[f"{c}_weight" for c in _SIX], F.array_join("components_scored", ",").alias("components_scored"), "reduced")


_LONG = "long_ as (" + " union all ".join(f"select run_id, {k} as position, '{c}' as component, {c} as score, {w}::double as weight from gone where {c} is not null" for k, (c, w) in enumerate(_W.items())) + ")"


@query(
    "health_explain",
    f"{sql('results')}, {_SUB}, {_LONG} select run_id, component, round(weight / sum(weight) over (partition by run_id) + 1e-11, 8) as effective_weight, round(score * weight / sum(weight) over (partition by run_id) + 1e-11, 8) as contribution from long_",
)
def health_explain(spark, d):
    return health.explain(_scores(spark, d), "run_id").select("run_id", "component", F.round(F.col("effective_weight") + 1e-11, 8).alias("effective_weight"), F.round(F.col("contribution") + 1e-11, 8).alias("contribution"))


@query(
    "health_sensitivity",
    f"""{sql("results")}, {_SUB}, {_LONG},
    t as (select run_id, sum(weight) as w, sum(weight * score) / sum(weight) as base, sum(weight * score) as s from long_ group by run_id),
    m as (select l.run_id, position, component, greatest(abs((s - 0.2::double * weight * score) / (w - 0.2::double * weight) - base), abs((s + 0.2::double * weight * score) / (w + 0.2::double * weight) - base)) as drift from long_ l join t using (run_id)),
    f as (select run_id, component, max(drift) as drift from m group by run_id, component)
    select component, round(avg(drift), 7) as mean_drift, round(max(drift), 7) as max_drift, count(*) as runs from f group by component""",
)
def health_sensitivity(spark, d):
    s = health.sensitivity(_scores(spark, d), "run_id")
    return s.groupBy("component").agg(F.round(F.avg("drift"), 7).alias("mean_drift"), F.round(F.max("drift"), 7).alias("max_drift"), F.count("*").alias("runs"))


@query(
    "analyzer_status_fold",
    f"""{sql("results")} select run_id, case when count(*) filter (where level <> 'ERROR') = count(*) then 'success' when count(*) filter (where level <> 'ERROR') = 0 then 'failed' else 'partial' end as status,
    count(*) filter (where level <> 'ERROR') as good, count(*) as total from results group by run_id""",
)
def analyzer_status_fold(spark, d):
    return health.status_fold(V.results(spark, d), "run_id", F.col("level") != "ERROR")


@query(
    "severity_histogram",
    f"{sql('results')} select severity, level, count(*) as rows_, sum(case severity when 'HIGH' then 15 when 'MEDIUM' then 7 else 2 end)::bigint as penalty, grouping(severity)::int as all_severities from results group by grouping sets ((severity, level), (level), ())",
)
def severity_histogram(spark, d):
    rows = V.results(spark, d).withColumn("p", health.security_penalty(F.col("severity")))
    out = rows.groupingSets([["severity", "level"], ["level"], []], "severity", "level")
    return out.agg(F.count("*").alias("rows_"), F.sum("p").alias("penalty"), F.grouping("severity").cast("int").alias("all_severities"))


@query("latest_run", f"{sql('runs')} select repo_id, arg_max(run_id, (created_at, run_id)) as run_id, max(created_at) as created_at from runs where status in ('complete', 'partial') group by repo_id")
def latest_run(spark, d):
    rows = V.runs(spark, d).filter(F.col("status").isin("complete", "partial"))
    return rows.groupBy("repo_id").agg(F.max(F.struct("created_at", "run_id")).alias("x")).select("repo_id", "x.run_id", "x.created_at")


@query("run_history", f"{sql('runs')} select run_id, status, created_at, count(*) over (partition by status) as of_status from runs where repo_id = 7 order by created_at desc, run_id")
def run_history(spark, d):
    of = F.count("*").over(Window.partitionBy("status"))
    return paging.equal(V.runs(spark, d), repo_id=7).select("run_id", "status", "created_at", of.alias("of_status")).orderBy(F.col("created_at").desc(), "run_id")


@query(
    "runs_by_repository",
    "select n_name as nation, r_name as region, count(*) as runs, count(*) filter (where o_orderstatus = 'P') as failed, max(o_orderdate) as newest from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
)
def runs_by_repository(spark, d):
    t = {n: V.table(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    rows = t["orders"].join(t["customer"], F.expr("o_custkey = c_custkey")).join(F.broadcast(t["nation"]), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(t["region"]), F.expr("n_regionkey = r_regionkey"))  # 25 and 5 rows
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.max("o_orderdate").alias("newest"))


@query(
    "reusable_run",
    f"""{sql("runs")}, c as (select *, row_number() over (partition by repo_id order by case status when 'complete' then 0 else 1 end, created_at desc, run_id) as k from runs
      where status in ('complete', 'partial') and version in ('1-URGENT', '2-HIGH', '3-MEDIUM')),
    ok as (select distinct l_orderkey as run_id from lineitem where l_quantity >= 25)
    select repo_id, run_id, status from c where k <= 20 and run_id in (from ok) qualify row_number() over (partition by repo_id order by k) = 1""",
)
def reusable_run(spark, d):
    """Complete before partial, newest first, 20 candidates; then the first of those whose chunks are embedded."""
    rows = V.runs(spark, d).filter(F.col("status").isin("complete", "partial") & F.col("version").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    order = Window.partitionBy("repo_id").orderBy(F.when(F.col("status") == "complete", 0).otherwise(1), F.col("created_at").desc(), "run_id")
    first = rows.withColumn("k", F.row_number().over(order)).filter("k <= 20")
    embedded = V.results(spark, d).filter("cc >= 25").select("run_id")
    usable = first.join(embedded, "run_id", "left_semi")
    return usable.groupBy("repo_id").agg(F.min_by(F.struct("run_id", "status"), "k").alias("x")).select("repo_id", "x.run_id", "x.status")


@query(
    "stale_jobs",
    f"{sql('runs')} select run_id as job_id, status as old_status, 'failed' as status, 'stale while ' || status as message from runs where status <> 'complete' and created_at <= timestamp '1996-01-01'",
)
def stale_jobs(spark, d):
    rows = V.runs(spark, d).select(F.col("run_id").alias("job_id"), "status", F.col("created_at").alias("updated_at"), "created_at")
    return jobs.reap(rows, F.lit("1996-01-01").cast("timestamp"), done=("complete",))


@query("active_jobs", f"{sql('runs')} select repo_id, count(*) as active, max(run_id) as newest from runs where status in ('partial', 'failed') and version = '1-URGENT' group by repo_id")
def active_jobs(spark, d):
    return V.runs(spark, d).filter(F.col("status").isin("partial", "failed") & (F.col("version") == "1-URGENT")).groupBy("repo_id").agg(F.count("*").alias("active"), F.max("run_id").alias("newest"))


_PROGRESS = "case event_type when 'signup' then 10 when 'view' then 30 when 'click' then 50 when 'purchase' then 80 else 5 end"


@query(
    "job_progress",
    f"select event_id, user_id as job_id, max({_PROGRESS}) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as progress, min(ts) over (partition by user_id, event_type) as stage_started, max(ts) over (partition by user_id, event_type) as stage_seen from events",
)
def job_progress(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.expr(_PROGRESS).alias("points"))
    return jobs.progress(rows, "event_id").select("event_id", "job_id", "progress", "stage_started", "stage_seen")


@query(
    "job_finalise",
    f"""{sql("runs")}, p as (select run_id, repo_id, status, lag(run_id) over (partition by repo_id order by created_at, run_id) as old_run, lag(status) over (partition by repo_id order by created_at, run_id) as old_status from runs)
    select run_id, case when old_run is not null and (case old_status when 'complete' then 2 when 'partial' then 1 else 0 end) >= (case status when 'complete' then 2 when 'partial' then 1 else 0 end) then old_run else run_id end as final_run from p""",
)
def job_finalise(spark, d):
    w = Window.partitionBy("repo_id").orderBy("created_at", "run_id")
    rows = V.runs(spark, d).withColumn("old_run", F.lag("run_id").over(w)).withColumn("old_status", F.lag("status").over(w))
    return rows.select("run_id", jobs.final_run("run_id", "status", "old_run", "old_status").alias("final_run"))


@query("upsert_snapshot", "select o_custkey as repo_id, o_orderdate as snapshot from orders group by all")
def upsert_snapshot(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderdate").alias("snapshot"), F.col("o_orderkey").alias("k"))
    known = rows.filter("k % 2 = 0").drop("k").distinct()
    return paging.upsert(known, rows.drop("k"), ["repo_id", "snapshot"])


@query(
    "orphan_check",
    """select 'lineitem without order' as check_name, count(*) as violations from lineitem where l_orderkey not in (select o_orderkey from orders)
    union all select 'order without lineitem', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)
    union all select 'repeated order key', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)""",
)
def orphan_check(spark, d):
    orders, items = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    named = {"lineitem without order": items.join(orders, "k", "left_anti"), "order without lineitem": orders.join(items, "k", "left_anti"), "repeated order key": orders.groupBy("k").count().filter("count > 1")}
    out = None
    for name, rows in named.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "doc_roundtrip",
    "select event_id, user_id, event_type, json_extract_string(props, '$.k')::int as k, round(value, 6) as value from events",
)
def doc_roundtrip(spark, d):
    """Rows to a nested document and back."""
    rows = V.table(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    doc = rows.select(F.to_json(F.struct("event_id", F.struct("user_id", "event_type").alias("who"), F.struct("k", "value").alias("what"))).alias("j"))
    kind = "struct<event_id:bigint,who:struct<user_id:bigint,event_type:string>,what:struct<k:int,value:double>>"
    return doc.select(F.from_json("j", kind).alias("x")).select("x.event_id", "x.who.user_id", "x.who.event_type", "x.what.k", F.round("x.what.value", 6).alias("value"))


@query("rating_join_audit", """with r as (select c_custkey as k, case when c_custkey % 7 = 0 then null else c_acctbal end as rating from customer where c_custkey % 10 <> 3),
    s as (select o_custkey as k, avg(o_totalprice) as score from orders group by 1)
    select case when r.k is null then 'score without rating' when s.k is null then 'rating without score' when rating is null then 'unreviewed' when rating < 0 then 'excluded' else 'usable' end as state, count(*) as n
    from r full join s on r.k = s.k group by 1""")
def rating_join_audit(spark, d):
    c = V.table(spark, d, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("k"), F.expr("case when c_custkey % 7 = 0 then null else c_acctbal end").alias("rating"), F.lit(True).alias("in_r"))
    s = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("score")).withColumn("in_s", F.lit(True))
    state = F.when(F.col("in_r").isNull(), "score without rating").when(F.col("in_s").isNull(), "rating without score").when(F.col("rating").isNull(), "unreviewed").when(F.col("rating") < 0, "excluded").otherwise("usable")
    return c.join(s, "k", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
