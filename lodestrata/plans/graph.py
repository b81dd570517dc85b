"""Code graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph, paging
from lodestrata.plans import query
from lodestrata.sources import views as V
from lodestrata.sources.views import sql


@query("graph_nodes", f"{sql('symbols')} select 'function' as node_type, file || '::' || class_name || '.' || name || ':' || id as node_id, name, file from symbols union all select distinct 'file', file, null, null from symbols union all select distinct 'class', file || '::' || class_name, class_name, file from symbols")
def graph_nodes(spark, d):
    s = V.symbols(spark, d)
    none = F.lit(None).cast("string")
    functions = s.select(F.lit("function").alias("node_type"), F.concat("file", F.lit("::"), "class_name", F.lit("."), "name", F.lit(":"), F.col("id").cast("string")).alias("node_id"), "name", "file")
    files = s.select(F.lit("file").alias("node_type"), F.col("file").alias("node_id"), none.alias("name"), none.alias("file")).distinct()
    classes = s.select(F.lit("class").alias("node_type"), F.concat("file", F.lit("::"), "class_name").alias("node_id"), F.col("class_name").alias("name"), "file").distinct()
    return functions.unionByName(files).unionByName(classes)


@query("graph_contains", "select r_name as source, n_name as target, 'contains' as relation from nation join region on n_regionkey = r_regionkey union all select n_name, c_name, 'contains' from customer join nation on c_nationkey = n_nationkey")
def graph_contains(spark, d):
    n, r, c = (V.table(spark, d, x) for x in ("nation", "region", "customer"))
    up = n.join(r, F.expr("n_regionkey = r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    down = c.join(F.broadcast(n), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("source"), F.col("c_name").alias("target"))  # 25 rows
    return up.unionByName(down).withColumn("relation", F.lit("contains"))


@query(
    "base_class_ladder",
    f"""{sql("symbols")}, r as (select id as ref_id, file, case when id % 4 = 0 then 'pkg.Missing' when id % 4 = 1 then 'm.' || name else name end as base from symbols),
    n as (select file, name, count(*) as n, min(id) as id from symbols where id % 9 = 0 group by all), f as (select name, count(*) as n, min(id) as id from symbols where id % 9 = 0 group by all),
    k as (select *, regexp_extract(base, '([^.]*)$', 1) as short from r)
    select ref_id, k.file, base, case when n.n = 1 then n.id::varchar when n.n > 1 then 'ambiguous_class::' || short when f.n = 1 then f.id::varchar when f.n > 1 then 'ambiguous_class::' || short else 'class_target::' || base end as target,
    case when n.n = 1 then 'structural_certain' when n.n > 1 then 'flagged' when f.n = 1 then 'low_confidence' when f.n > 1 then 'flagged' else 'structural_certain' end as confidence
    from k left join n on k.file = n.file and short = n.name left join f on short = f.name""",
)
def base_class_ladder(spark, d):
    s = V.symbols(spark, d)
    refs = s.select(F.col("id").alias("ref_id"), "file", F.expr("case when id % 4 = 0 then 'pkg.Missing' when id % 4 = 1 then concat('m.', name) else name end").alias("base"))
    return graph.base_class_ladder(refs, s.filter("id % 9 = 0"))


_CALLS = """
  near as (select file, name, count(*) as n from symbols group by all), far as (select name, count(*) as n from symbols group by all),
  r as (select c.call_id, c.caller, c.name, c.file, coalesce(near.n, 0) - (s.name = c.name and s.file = c.file)::int as n1, coalesce(far.n, 0) - (s.name = c.name)::int as n2
    from calls c left join near on near.file = c.file and near.name = c.name left join far on far.name = c.name join symbols s on s.id = c.caller),
  e as (select call_id, caller, name, case when n1 > 1 then 'ambiguous_call::' || name when n1 = 1 then (select min(id) from symbols s where s.name = r.name and s.file = r.file and s.id <> r.caller)::varchar
      when n2 = 1 then (select min(id) from symbols s where s.name = r.name and s.id <> r.caller)::varchar when n2 > 1 then 'ambiguous_call::' || name else 'unresolved_call::' || name end as target,
    case when n1 > 1 then 'flagged' when n1 = 1 then 'high_confidence' when n2 = 1 then 'low_confidence' else 'flagged' end as confidence,
    case when n1 > 1 then 'duplicate_same_file_candidates' when n1 = 1 then 'same_file' when n2 = 1 then 'repository_unique' when n2 > 1 then n2 || '_candidate_definitions' else 'no_matching_definition_found' end as provenance from r)"""


@query("call_resolution", f"{sql('calls')}, {_CALLS} select * from e")
def call_resolution(spark, d):
    return graph.call_ladder(V.calls(spark, d), V.symbols(spark, d))


def _edges(spark, d):
    calls = call_resolution(spark, d).select(F.col("caller").cast("string").alias("source"), "target", F.lit("calls").alias("relation"), "confidence", F.col("call_id").alias("edge_id"))
    bases = base_class_ladder(spark, d).select(F.col("ref_id").cast("string").alias("source"), "target", F.lit("inherits").alias("relation"), "confidence", F.concat(F.lit("b"), F.col("ref_id").cast("string")).alias("edge_id"))
    return calls.unionByName(bases)


_BASES = """bn as (select file, name, count(*) as n, min(id) as id from symbols where id % 9 = 0 group by all), bf as (select name, count(*) as n, min(id) as id from symbols where id % 9 = 0 group by all),
  bk as (select id as ref_id, file, case when id % 4 = 0 then 'pkg.Missing' when id % 4 = 1 then 'm.' || name else name end as base from symbols),
  edges as (select caller::varchar as source, target, 'calls' as relation, confidence, call_id as edge_id from e
    union all select ref_id::varchar, case when bn.n = 1 then bn.id::varchar when bn.n > 1 then 'ambiguous_class::' || bk.short when bf.n = 1 then bf.id::varchar when bf.n > 1 then 'ambiguous_class::' || bk.short else 'class_target::' || base end, 'inherits',
      case when bn.n = 1 then 'structural_certain' when bn.n > 1 then 'flagged' when bf.n = 1 then 'low_confidence' when bf.n > 1 then 'flagged' else 'structural_certain' end, 'b' || ref_id
      from (select *, regexp_extract(base, '([^.]*)$', 1) as short from bk) bk left join bn on bk.file = bn.file and short = bn.name left join bf on short = bf.name)"""


@query(
    "graph_summary",
    f"""{sql("calls")}, {_CALLS}, {_BASES} select count(*) as edges, count(distinct source) as sources, count(*) filter (where relation = 'calls') as calls, count(*) filter (where relation = 'inherits') as inherits,
    count(*) filter (where relation = 'calls' and confidence = 'high_confidence') as calls_high, count(*) filter (where relation = 'calls' and confidence = 'low_confidence') as calls_low,
    count(*) filter (where relation = 'calls' and confidence = 'flagged') as calls_flagged,
    round(100.0::double * count(*) filter (where relation = 'calls' and confidence in ('high_confidence', 'low_confidence')) / greatest(count(*) filter (where relation = 'calls'), 1), 9) as resolved_percent from edges""",
)
def graph_summary(spark, d):
    return graph.summary(_edges(spark, d))


@query(
    "graph_page_edges",
    f"""{sql("calls")}, {_CALLS}, {_BASES}, p as (select id::varchar as id from symbols order by file, name, id limit 40 offset 20)
    select edge_id, source, target, relation, confidence from edges where source in (from p) or target in (from p)""",
)
def graph_page_edges(spark, d):
    nodes = paging.page(V.symbols(spark, d), ["file", "name", "id"], 20, 40).select(F.col("id").cast("string").alias("id"))
    return paging.incident_edges(_edges(spark, d), nodes).select("edge_id", "source", "target", "relation", "confidence")


@query(
    "architecture_edges",
    f"""{sql("calls")}, {_CALLS} select a.file as source_file, b.file as target_file, count(*) as calls from e join symbols a on a.id = e.caller join symbols b on b.id::varchar = e.target where a.file <> b.file group by all""",
)
def architecture_edges(spark, d):
    return graph.architecture(_edges(spark, d).filter("relation = 'calls'"), V.symbols(spark, d))


@query(
    "stratified_sample",
    f"""{sql("calls")}, {_CALLS}, {_BASES} select relation, edge_id, source, target from edges qualify row_number() over (partition by relation order by md5('seed7|' || edge_id), edge_id) <= 10""",
)
def stratified_sample(spark, d):
    return graph.stratified(_edges(spark, d), 10, "seed7", ["edge_id"]).select("relation", "edge_id", "source", "target")


@query(
    "edge_sample",
    f"""{sql("calls")}, {_CALLS}, {_BASES}, k as (select *, md5('seed9|' || edge_id || '|' || source || '|' || target) as h from edges where relation in ('calls', 'inherits')),
    placed as (select *, row_number() over (partition by relation order by h, edge_id, source, target) as k, 100 // (select count(distinct relation) from k) as share from k),
    chosen as (select * from placed where k <= share), filled as (select * from placed where k > share order by h, edge_id, source, target limit (select 100 - count(*) from chosen))
    select relation, edge_id, source, target, (row_number() over (order by h, edge_id, source, target))::int as place from (from chosen union all from filled)""",
)
def edge_sample(spark, d):
    return graph.sample(_edges(spark, d), 100, "seed9", ["edge_id", "source", "target"]).select("relation", "edge_id", "source", "target", "place")


_NODES = """n as (select file_path as id, 'file' as node_type, null::varchar as file_path, null::int as start_line from files
    union all select file_path || '::' || start_line, 'run', file_path, start_line::int from entities),
  g as (select file_path as source, file_path || '::' || start_line as target from entities)"""


@query(
    "graph_node_page",
    f"""{sql("entities")}, {_NODES}, p as (select *, (select count(*) from n where node_type = 'run') as total from n where node_type = 'run' order by file_path nulls last, start_line nulls last, id limit 40 offset 30)
    select id, node_type, file_path, start_line, total, count(g.target) as edges from p left join g on g.target = p.id or g.source = p.id group by all""",
)
def graph_node_page(spark, d):
    """A page of the nodes of one type, its total and how many edges each node has."""
    e = V.entities(spark, d)
    ident = F.concat_ws("::", "file_path", F.col("start_line").cast("string"))
    nodes = V.files(spark, d).select(F.col("file_path").alias("id"), F.lit("file").alias("node_type"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    nodes = nodes.unionByName(e.select(ident.alias("id"), F.lit("run").alias("node_type"), "file_path", F.col("start_line").cast("int").alias("start_line")))
    shown, edges = paging.node_page(nodes, e.select(F.col("file_path").alias("source"), ident.alias("target")), node_type="run", offset=30, limit=40)
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("edges"))
    return shown.join(ends, "id", "left").select("id", "node_type", "file_path", "start_line", "total", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(
    "inheritance_closure",
    """with recursive p as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1 and p_partkey % 7 <> 0),
    up as (select child, parent as ancestor, 1 as depth from p union all select u.child, p.parent, u.depth + 1 from up u join p on u.ancestor = p.child where p.parent <> u.child)
    select child, ancestor, min(depth)::int as depth from up group by all""",
)
def inheritance_closure(spark, d):
    parents = V.table(spark, d, "part").filter("p_partkey > 1 and p_partkey % 7 <> 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return graph.closure(parents, spark)


@query(
    "import_resolution",
    r"""with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages),
    i as (select row_number() over () as k, page_id, href from (select distinct page_id, href from l where href <> '')),
    f as (select distinct regexp_extract(url, '^https?://[^/]+/(.*)$', 1) as path from pages)
    select page_id, href, (select any_value(path) from f where path = href) as target from i""",
)
def import_resolution(spark, d):
    pages = V.table(spark, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).filter("href <> ''").distinct()
    imports = links.select(F.concat_ws("|", "page_id", "href").alias("import_id"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), F.col("href").alias("imported"))
    files = pages.select(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path")).distinct()
    return graph.resolve_imports(imports, files).select(F.substring_index("import_id", "|", 1).cast("long").alias("page_id"), F.col("imported").alias("href"), "target")


@query(
    "set_agreement",
    """with a as (select distinct l_partkey as x, l_suppkey as y from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey, l_suppkey from lineitem where l_linestatus = 'F'),
    j as (select a.x is not null as ina, b.l_partkey is not null as inb from a full join b on a.x = b.l_partkey and a.y = b.l_suppkey)
    select count(*) filter (where ina and inb) as both_, count(*) filter (where ina and not inb) as only_a, count(*) filter (where inb and not ina) as only_b,
    round(count(*) filter (where ina and inb)::double / count(*), 9) as jaccard, round(2.0::double * count(*) filter (where ina and inb) / (count(*) filter (where ina) + count(*) filter (where inb)), 9) as dice from j""",
)
def set_agreement(spark, d):
    from lodestrata.operators.evaluation import agreement

    rows = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), "l_returnflag", "l_linestatus")
    return agreement(rows.filter("l_returnflag = 'R'"), rows.filter("l_linestatus = 'F'"), ["x", "y"])
