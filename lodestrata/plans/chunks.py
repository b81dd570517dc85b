"""Chunk, file and finding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import chunking, intervals, paging, prefix
from lodestrata.plans import query
from lodestrata.sources import views as V
from lodestrata.sources.views import sql

_WINDOWS = """
  cut as (select file_path, lang, source, case when a[len(a)] = '' then a[1 : len(a) - 1] else a end as a from (select *, string_split(text, chr(10)) as a from files)),
  w as (select *, unnest(range(0, ceil(len(a) / 50.0)::bigint)) as w from cut where len(a) > 0),
  c as (select file_path, lang, source, w * 50 + 1 as start_line, least(len(a), w * 50 + 50) as end_line, array_to_string(a[w * 50 + 1 : w * 50 + 50], chr(10)) as chunk_text from w)"""
_ID = "'sc_' || substr(sha256(chr(10) || file_path || chr(10) || start_line || chr(10) || end_line || chr(10) || '1' || chr(10) || chunk_text), 1, 32)"


@query("chunk_windows", f"{sql('files')},{_WINDOWS} select file_path, start_line::int as start_line, end_line::int as end_line, {_ID} as chunk_id, length(chunk_text)::int as n_chars from c")
def chunk_windows(spark, d):
    return chunking.windows(V.files(spark, d)).select("file_path", "start_line", "end_line", "chunk_id", F.length("chunk_text").alias("n_chars"))


_GAPS = """
  n as (select file_path, case when a[len(a)] = '' then a[1 : len(a) - 1] else a end as a from (select *, string_split(text, chr(10)) as a from files)),
  covered as (select file_path, i from (select file_path, unnest(range(start_line, end_line + 1)) as i from entities)),
  loose as (select file_path, i from (select file_path, unnest(range(1, len(a) + 1)) as i from n) anti join covered using (file_path, i)),
  runs_ as (select file_path, min(i) as s, max(i) as e from (select *, i - row_number() over (partition by file_path order by i) as g from loose) group by file_path, g),
  spans as (
    select file_path, start_line as s, end_line as e, name from entities where end_line - start_line < 100
    union all select file_path, b, least(b + 49, end_line), name from (select *, unnest(range(start_line, end_line + 1, 50)) as b from entities where end_line - start_line >= 100)
    union all select file_path, b, least(b + 49, e), null from (select *, unnest(range(s, e + 1, 50)) as b from runs_)),
  c as (select file_path, s as start_line, e as end_line, name, array_to_string(a[s : e], chr(10)) as chunk_text from spans join n using (file_path))"""


@query("chunk_entities", f"{sql('entities')},{_GAPS} select file_path, start_line::int as start_line, end_line::int as end_line, name, {_ID} as chunk_id from c")
def chunk_entities(spark, d):
    entities = V.entities(spark, d).select("file_path", "start_line", "end_line", "name")
    return chunking.entity_chunks(V.files(spark, d), entities).select("file_path", "start_line", "end_line", "name", "chunk_id")


@query(
    "chunk_page",
    f"""{sql("files")},{_WINDOWS} select file_path, start_line::int as start_line, end_line::int as end_line, {_ID} as chunk_id from c
    where end_line >= 40 and start_line <= 60 order by file_path, start_line, end_line, chunk_id limit 25 offset 10""",
)
def chunk_page(spark, d):
    chunks = chunking.overlapping(chunking.windows(V.files(spark, d)), start=40, end=60)
    return paging.page(chunks, ["file_path", "start_line", "end_line", "chunk_id"], 10, 25).select("file_path", "start_line", "end_line", "chunk_id")


@query(
    "chunk_resolve",
    f"""{sql("findings", "entities")}
    select finding_id, doc_id, line, start_line::int as start_line, end_line::int as end_line, name from findings f join entities e using (doc_id)
    where line > 0 and start_line <= line and line <= end_line
    qualify row_number() over (partition by finding_id order by start_line desc, end_line, name) = 1""",
)
def chunk_resolve(spark, d):
    points = V.findings(spark, d).select("finding_id", "doc_id", "line")
    return intervals.resolve(points, V.entities(spark, d), "doc_id", "finding_id", ["name"]).select("finding_id", "doc_id", "line", "start_line", "end_line", "name")


@query(
    "finding_page",
    f"""{sql("findings")} select finding_id, analyzer, severity, doc_id, line, rule_id from findings where analyzer = 'click' and severity = 'HIGH'
    order by doc_id nulls last, line nulls last, rule_id nulls last, finding_id limit 50 offset 20""",
)
def finding_page(spark, d):
    rows = paging.equal(V.findings(spark, d), analyzer="click", severity="HIGH")
    return paging.page(rows, ["doc_id", "line", "rule_id", "finding_id"], 20).select("finding_id", "analyzer", "severity", "doc_id", "line", "rule_id")


@query("finding_total", f"{sql('findings')} select analyzer, severity, count(*) as total, count(line) as placed from findings group by all")
def finding_total(spark, d):
    return V.findings(spark, d).groupBy("analyzer", "severity").agg(F.count("*").alias("total"), F.count("line").alias("placed"))


@query(
    "finding_functions",
    f"""{sql("findings", "entities")} select finding_id, doc_id, line, start_line::int as start_line, name from findings join entities using (doc_id)
    where line > 0 and start_line <= line and line <= end_line""",
)
def finding_functions(spark, d):
    return intervals.stab(V.findings(spark, d), V.entities(spark, d), "doc_id", bin_lines=100).select("finding_id", "doc_id", "line", "start_line", "name")


_ASKED = "event_id as window_id, event_id % (select count(*) from documents) as doc_id, case when event_id % 9 > 0 then user_id % 90 end as start, case when event_id % 7 > 0 then user_id % 90 + event_id % 40 - 3 end as \"end\""


@query(
    "window_overlaps",
    f"""{sql("entities")}, w as (select {_ASKED} from events)
    select window_id, doc_id, start_line::int as start_line, end_line::int as end_line, name from w join entities using (doc_id)
    where (start is null or end_line >= start) and ("end" is null or start_line <= "end") and (start is null or "end" is null or start <= "end")""",
)
def window_overlaps(spark, d):
    """A table of windows, some of them open, joined with the entities that they meet."""
    docs = V.table(spark, d, "documents").count()
    windows = V.table(spark, d, "events").select(
        F.col("event_id").alias("window_id"), (F.col("event_id") % docs).alias("doc_id"), F.when(F.col("event_id") % 9 > 0, F.col("user_id") % 90).alias("start"),
        F.when(F.col("event_id") % 7 > 0, F.col("user_id") % 90 + F.col("event_id") % 40 - 3).alias("end"),
    )
    return intervals.overlaps(windows, V.entities(spark, d), "doc_id").select("window_id", "doc_id", "start_line", "end_line", "name")


@query("missing_file_nodes", f"{sql('findings')} select distinct doc_id from findings where doc_id not in (select doc_id from labels)")
def missing_file_nodes(spark, d):
    return paging.missing(V.findings(spark, d), V.table(spark, d, "labels"), ["doc_id"])


@query(
    "finding_union_index",
    f"""{sql("findings")}, o as (select *, case analyzer when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as k from findings)
    select finding_id, analyzer, row_number() over (order by k, finding_id) - 1 as position, 'finding::' || analyzer || '::' || rule_id || '::' || coalesce(doc_id::varchar, '') || ':' || coalesce(line, 0) || '::' || (row_number() over (order by k, finding_id) - 1) as node_id from o""",
)
def finding_union_index(spark, d):
    """One running index over the findings of all analyzers in a fixed order, counted per partition of the index and then summed."""
    f = V.findings(spark, d)
    k = F.expr("case analyzer when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end")
    rows = f.withColumn("k", k).withColumn("part", F.floor(F.col("finding_id") / 4096))
    from pyspark.sql import Window

    sums = rows.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy("k", "part").rowsBetween(Window.unboundedPreceding, -1)  # over counts, not rows
    sums = sums.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("k", "part").orderBy("finding_id")
    placed = rows.withColumn("n", F.row_number().over(inside)).join(sums, ["k", "part"]).withColumn("position", F.col("start") + F.col("n") - 1)
    node = F.concat(F.lit("finding::"), "analyzer", F.lit("::"), "rule_id", F.lit("::"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"), F.lit("::"), F.col("position").cast("string"))
    return placed.select("finding_id", "analyzer", F.col("position").cast("long").alias("position"), node.alias("node_id"))


@query("file_page", f"{sql('files')} select file_path, lang, source from files order by file_path limit 50 offset 5")
def file_page(spark, d):
    return paging.page(V.files(spark, d).select("file_path", "lang", "source"), ["file_path"], 5)


@query(
    "file_detail",
    f"""{sql("findings", "entities")} select doc_id, 'entity' as kind, name as label, start_line::int as line from entities where doc_id = 3
    union all select doc_id, 'finding', rule_id, line from findings where doc_id = 3""",
)
def file_detail(spark, d):
    entities = V.entities(spark, d).filter("doc_id = 3").select("doc_id", F.lit("entity").alias("kind"), F.col("name").alias("label"), F.col("start_line").alias("line"))
    return entities.unionByName(V.findings(spark, d).filter("doc_id = 3").select("doc_id", F.lit("finding").alias("kind"), F.col("rule_id").alias("label"), "line")).orderBy("line", "label")


@query(
    "languages",
    """select source, array_to_string(list_sort(list_distinct(list(coalesce(case lang when 'en' then 'python' when 'de' then 'javascript' when 'fr' then 'typescript' else 'java' end, 'python')))), ',') as languages, count(*) as files
    from documents group by source""",
)
def languages(spark, d):
    name = F.expr("case lang when 'en' then 'python' when 'de' then 'javascript' when 'fr' then 'typescript' else 'java' end")
    return V.files(spark, d).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("languages"), F.count("*").alias("files"))


@query(
    "test_path_split",
    """with p as (select page_id, regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) as path from pages)
    select page_id, path, (contains('/' || path, 'test/') or contains('/' || path, 'tests/') or contains('/' || path, 'testing/')
      or regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^(test_.*|.*_test\\.py|conftest\\.py)$')) as is_test from p""",
)
def test_path_split(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1)
    return V.table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("is_test", T.is_test_file(F.col("path")))


@query(
    "cache_eviction",
    """with s as (select doc_id, n_chars as bytes, sum(n_chars) over (order by doc_id desc rows between unbounded preceding and current row) as kept_so_far from documents)
    select doc_id, bytes, kept_so_far > 0.6 * (select sum(n_chars) from documents) as evicted from s""",
)
def cache_eviction(spark, d):
    """The newest files that fit a budget stay."""
    rows = V.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("bytes"), (-F.col("doc_id")).alias("age"))
    budget = 0.6 * (rows.agg(F.sum("bytes")).first()[0] or 0)
    return prefix.within_budget(rows, ["age"], "bytes", F.lit(budget)).select("doc_id", "bytes", (~F.col("kept")).alias("evicted"))


_PINS = """case p_partkey % 6 when 0 then concat('==', p_size, '.', p_partkey % 7) when 1 then '>=1.0 ; python_version == "3"' when 2 then '  # pinned later'
      when 3 then concat(' ', p_size) when 4 then '[extra]==2.0' else ' == 1.5 # why; not' end"""


@query(
    "requirement_parse",
    rf"""with p as (select distinct replace(p_name, ' ', '-') || {_PINS} as line from part),
    c as (select trim(split_part(split_part(line, ' #', 1), ';', 1)) as line from p)
    select regexp_extract(line, '^[A-Za-z0-9_.-]+') as package,
      case when contains(line, '==') then regexp_extract(split_part(line, '==', 2), '[^\s]+')
        when regexp_matches(line, '[<>~!]') then '' else regexp_extract(line, '^[A-Za-z0-9_.-]+\s*([A-Za-z0-9_.-]*)', 1) end as version from c""",
)
def requirement_parse(spark, d):
    from lodestrata.sources.manifests import parse_requirements

    lines = V.table(spark, d, "part").select(F.expr(f"concat(replace(p_name, ' ', '-'), {_PINS})").alias("line")).distinct()
    return parse_requirements(lines).select("package", "version")


_ADDRESS = """case page_id % 12 when 0 then 'https://github.com/own' || page_id || '/r.git/' when 1 then 'HTTPS://GitHub.com/Own/r' when 2 then 'https://www.github.com/a/b'
      when 3 then 'https://github.com/a%20b/c' when 4 then '-https://github.com/a/b' when 5 then 'https://u:p@github.com/a/b' when 6 then 'https://github.com:8443/a/b'
      when 7 then 'https://github.com/a/b?x=1' when 8 then 'https://github.com/a/b#L1' when 9 then 'https://github.com/a/b/c' when 10 then 'https://github.com/.a/b' else url end"""


@query(
    "url_validation",
    rf"""with u as (select page_id, url as given, {_ADDRESS} as url from pages),
    p as (select *, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) as place from u)
    select page_id, case when url is null or url = '' then 'empty' when length(url) > 2048 then 'too_long' when contains(url, '%') then 'percent'
      when regexp_matches(url, '[\x00-\x20\x7F]') then 'control_or_space' when url[1] = '-' then 'leading_dash' when lower(url[1:6]) <> 'https:' then 'scheme'
      when contains(place, '@') then 'credentials' when lower(split_part(place, ':', 1)) <> 'github.com' then 'host' when contains(place, ':') then 'port'
      when regexp_matches(url, '\?.') then 'query' when regexp_matches(url, '#.') then 'fragment'
      when not regexp_matches(url, '^https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$', 'i') then 'path'
      when not regexp_matches(url, '^https://[^/]*/[A-Za-z0-9]', 'i') then 'owner' when not regexp_matches(url, '^https://[^/]*/[^/]*/[A-Za-z0-9]', 'i') then 'repository' end as reason,
      regexp_extract(given, '^https?://([^/]+)', 1) as host from p""",
)
def url_validation(spark, d):
    from lodestrata.functions.urls import rejection

    pages = V.table(spark, d, "pages").select("page_id", F.col("url").alias("given"), F.expr(_ADDRESS).alias("url"))
    return pages.select("page_id", rejection(F.col("url")).alias("reason"), F.regexp_extract("given", "^https?://([^/]+)", 1).alias("host"))


@query("redaction", r"select page_id, regexp_replace('clone https://user' || page_id || ':pw@' || regexp_extract(url, '^https?://(.*)$', 1), '(//)[^/@\s]+@', '\1***@', 'g') as message from pages")
def redaction(spark, d):
    raw = F.concat(F.lit("clone https://user"), F.col("page_id").cast("string"), F.lit(":pw@"), F.regexp_extract("url", "^https?://(.*)$", 1))
    return V.table(spark, d, "pages").select("page_id", T.redact(raw).alias("message"))
