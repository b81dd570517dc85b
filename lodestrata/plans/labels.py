"""What is shown or stored of files, messages, models and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import labels as L
from lodestrata.operators import snapshots
from lodestrata.plans import query
from lodestrata.sources import views as V

_PATH = """(case doc_id % 5 when 0 then 'src/' when 1 then 'node_modules/a/' when 2 then 'lib/dist/' when 3 then 'distant/' else '.git/' end || 'f' || doc_id ||
  case doc_id % 13 when 0 then '.py' when 1 then '.PYW' when 2 then '.java' when 3 then '.js' when 4 then '.jsx' when 5 then '.tsx' when 6 then '.CC' when 7 then '.go'
    when 8 then '.rs' when 9 then '.yml' when 10 then '.txt' when 11 then '.pyc' else '' end)"""
_STATED = "case doc_id % 3 when 0 then null when 1 then 'unknown' else lang end"
_IGNORED = "list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.venv', 'venv', 'node_modules', 'dist', 'build'])"
_STORED = r"case when path like '%.py' then 'python' when path like '%.java' then 'java' when path like '%.js' or path like '%.jsx' then 'javascript' when path like '%.ts' or path like '%.tsx' then 'typescript' else 'unknown' end"


def _paths(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "source", "text", "lang", F.expr(_PATH).alias("path"), F.expr(_STATED).alias("stated"))


_P = f"with p as (select doc_id, source, text, lang, {_PATH} as path, {_STATED} as stated from documents)"


@query(
    "file_labels",
    rf"""{_P} select doc_id, case when regexp_matches(lower(path), '\.pyw?$') then 'python' when regexp_matches(lower(path), '\.java$') then 'java' when regexp_matches(lower(path), '\.jsx?$') then 'javascript'
      when regexp_matches(lower(path), '\.tsx?$') then 'typescript' when regexp_matches(lower(path), '\.(c|h|cpp|hpp|cc)$') then 'cpp' when regexp_matches(lower(path), '\.go$') then 'go'
      when regexp_matches(lower(path), '\.rs$') then 'rust' when regexp_matches(lower(path), '\.(json|toml|yaml|yml|md|xml|ini)$') then 'config' else 'unknown' end as chunk_language,
    {_STORED} as stored_language, case when stated is not null and stated not in ('', 'unknown') then stated else {_STORED} end as shown_language, {_IGNORED} as ignored,
    contains(lower(path), 'dist') as has_text, true as has_blank from p""",
)
def file_labels(spark, d):
    path = F.col("path")
    return _paths(spark, d).select(
        "doc_id", L.language(path, L.CHUNK_ENDINGS, any_case=True).alias("chunk_language"), L.language(path, L.STORED_ENDINGS).alias("stored_language"),
        L.shown_language(path, F.col("stated")).alias("shown_language"), L.in_ignored_folder(path).alias("ignored"),
        L.matches_text(path, F.lit(" DIST ")).alias("has_text"), L.matches_text(path, F.lit("  ")).alias("has_blank"),
    )


@query(
    "embedding_texts",
    f"""{_P} select doc_id, sha256('file: ' || path || chr(10) || 'language: ' || coalesce(lang, 'unknown') || chr(10) || case when doc_id % 2 = 0 then 'entity: function f' || doc_id || chr(10) else '' end
      || 'lines: ' || (doc_id % 7) || '-' || (doc_id % 7 + 40) || chr(10) || chr(10) || coalesce(text, '')) as text_hash,
    case doc_id % 3 when 0 then 'test:test:64' when 1 then 'unknown:unknown:64' else 'test:m2:0' end as version from p""",
)
def embedding_texts(spark, d):
    first = F.col("doc_id") % 7
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    text = L.embedding_text(F.col("path"), F.coalesce("lang", F.lit("unknown")), first, first + 40, F.coalesce("text", F.lit("")), F.lit("function"), name)
    version = L.vector_version(F.expr("case when doc_id % 3 <> 1 then 'test' end"), F.expr("case when doc_id % 3 = 2 then 'm2' end"), F.expr("case when doc_id % 3 <> 2 then 64 end"))
    return _paths(spark, d).select("doc_id", F.sha2(text, 256).alias("text_hash"), version.alias("version"))


_MODEL = "case event_id % 7 when 0 then 'GPT-4o-mini-2024' when 1 then 'gpt-4o' when 2 then 'models/gemini-1.5-flash' when 3 then 'gemini-1.5-pro' when 4 then 'test-deterministic-rag' when 5 then 'other' else null end"
_USAGE = """case when event_id % 11 = 0 then '[1]' when event_id % 13 = 0 then 'broken' else '{"prompt_tokens": ' || case event_id % 9 when 0 then 'true' when 1 then '1.5' when 2 then '"7"' when 3 then '-3'
  when 4 then 'null' else '' || user_id end || ', "completion_tokens": ' || (event_id % 900) || '}' end"""


@query(
    "model_costs",
    f"""with u as (select event_id, lower({_MODEL}) as model, try_cast({_USAGE} as json) as usage from events),
    t as (select event_id, model, case when json_type(usage, '$.prompt_tokens') = 'UBIGINT' and json_type(usage, '$.completion_tokens') = 'UBIGINT' then (usage->>'$.prompt_tokens')::bigint end as tokens_in,
      case when json_type(usage, '$.prompt_tokens') = 'UBIGINT' and json_type(usage, '$.completion_tokens') = 'UBIGINT' then (usage->>'$.completion_tokens')::bigint end as tokens_out from u),
    p as (select *, case when model like '%gpt-4o-mini%' then 0.00015 when model like '%gpt-4o%' then 0.0025 when model like '%gemini-1.5-flash%' then 0.000075 when model like '%gemini-1.5-pro%' then 0.00125 else 0.00015 end::double as a,
      case when model like '%gpt-4o-mini%' then 0.0006 when model like '%gpt-4o%' then 0.01 when model like '%gemini-1.5-flash%' then 0.0003 when model like '%gemini-1.5-pro%' then 0.005 else 0.0006 end::double as b,
      coalesce(model <> 'other', false) as exact from t)
    select event_id, tokens_in, tokens_out, round(tokens_in / 1000.0::double * a + tokens_out / 1000.0::double * b, 10) as cost, exact from p""",
)
def model_costs(spark, d):
    rows = V.table(spark, d, "events").select("event_id", L.price(F.expr(_MODEL)).alias("price"), F.expr(_USAGE).alias("usage"))
    rows = rows.withColumns({"a": L.token_count(F.col("usage"), "prompt_tokens"), "b": L.token_count(F.col("usage"), "completion_tokens")})
    both = F.col("a").isNotNull() & F.col("b").isNotNull()  # a usage counts only whole
    rows = rows.select("event_id", F.when(both, F.col("a")).alias("tokens_in"), F.when(both, F.col("b")).alias("tokens_out"), "price")
    return rows.select("event_id", "tokens_in", "tokens_out", F.round(L.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price")), 10).alias("cost"), F.col("price.exact").alias("exact"))


_STDERR = """case event_id % 12 when 0 then 'fatal: Redirect not found' when 1 then 'error: 301' when 2 then 'error: 3019' when 3 then 'fatal: bad object not found' when 4 then 'Repository NOT FOUND'
  when 5 then 'could not read from remote' when 6 then 'Could not resolve host' when 7 then 'Connection reset' when 8 then 'unable to update url base' when 9 then null when 10 then '' else 'pathspec x' end"""


@query(
    "clone_failures",
    f"""with e as (select event_id, coalesce(lower({_STDERR}), '') as s, event_id % 5 = 0 as checkout from events)
    select event_id, case when s like '%redirect%' or s like '%unable to update url base%' or s in ('error: 301') then 'redirected' when checkout or s like '%bad object%' or s like '%pathspec%' then 'no_commit'
      when s like '%not found%' or s like '%could not read from remote%' then 'no_repository' when s like '%resolve host%' or s like '%connection%' then 'unreachable' else 'exit_' || (128 + event_id % 3) end as reason from e""",
)
def clone_failures(spark, d):
    return V.table(spark, d, "events").select("event_id", L.clone_failure(F.expr(_STDERR), F.col("event_id") % 5 == 0, 128 + F.col("event_id") % 3).alias("reason"))


_MESSAGE = """case doc_id % 4 when 0 then text when 1 then '  File "a.py", line 3' || chr(10) || text when 2 then '  File "b.py"' || chr(10) || ' ' else 'LLM_API_KEY wrong: secret ' || doc_id || chr(10) || text end"""
_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "clean_messages",
    rf"""with m as (select doc_id, {_MESSAGE} as m from documents),
    k as (select doc_id, m, regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(m, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
      lambda x: not regexp_matches(x, '^\s*File ')), ' '), '^{_BLANK}', ''), '{_BLANK}$', '') as c from m)
    select doc_id, sha256(case when length(c) > 0 then left(c, 500) else 'Analysis execution failed' end) as error_hash,
    case when doc_id % 4 = 3 then 'LLM_API_KEY wrong: environment variable is missing or invalid.' else string_split(m, chr(10))[1] end as status from k""",
)
def clean_messages(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.expr(_MESSAGE).alias("m"))
    return rows.select("doc_id", F.sha2(L.clean_error(F.col("m")), 256).alias("error_hash"), L.clean_status(F.col("m")).alias("status"))


@query(
    "score_labels",
    """with s as (select c_custkey, case when c_custkey % 10 > 0 then c_acctbal / 100 end as score from customer)
    select c_custkey, case when score is null then 'unknown' when score >= 80 then 'good' when score >= 60 then 'warning' else 'poor' end as tier,
    case when score is null then 'N/A' else printf('%.1f', case when score * 4 = floor(score * 4) and score * 2 <> floor(score * 2) then score + sign(score) * 0.01 else score end) end as shown from s""",
)
def score_labels(spark, d):
    customer = V.table(spark, d, "customer")
    kind = "float" if dict(customer.dtypes)["c_acctbal"] == "float" else "double"  # floats of 4 bytes stay such when they are divided
    score = F.when(F.col("c_custkey") % 10 > 0, (F.col("c_acctbal").cast("double") / 100).cast(kind))
    return customer.select("c_custkey", L.tier(score).alias("tier"), L.shown_score(score).alias("shown"))


@query(
    "short_names",
    r"""with p as (select page_id, case page_id % 4 when 0 then url || '.git' when 1 then url when 2 then 'plain' else null end as url, case page_id % 4 when 0 then sha256(html) when 1 then left(sha256(html), 16) when 2 then '' else null end as sha from pages)
    select page_id, case when url is null then '—' else regexp_extract(regexp_replace(url, '\.git$', ''), '([^/]*/)?[^/]*$') end as name,
    case when sha is null or sha = '' then '—' when length(sha) > 16 then left(sha, 16) || '…' else sha end as sha from p""",
)
def short_names(spark, d):
    url = F.expr("case page_id % 4 when 0 then url || '.git' when 1 then url when 2 then 'plain' else null end")
    sha = F.expr("case page_id % 4 when 0 then sha2(html, 256) when 1 then left(sha2(html, 256), 16) when 2 then '' else null end")
    return V.table(spark, d, "pages").select("page_id", L.short_url(url).alias("name"), L.short_sha(sha).alias("sha"))


_TIME = "case when event_id % 6 = 0 then 'n/a' when event_id % 7 = 0 then '' else '2024-0' || (1 + event_id % 9) || '-' || (10 + event_id % 22) || case when event_id % 2 = 0 then 'T' else ' ' end || '0' || (user_id % 10) || ':30:00' end"


@query("parsed_times", f"select event_id, strftime(try_cast({_TIME} as timestamp), '%Y-%m-%d %H:%M:%S') as at from events")
def parsed_times(spark, d):
    return V.table(spark, d, "events").select("event_id", F.date_format(L.iso_time(F.expr(_TIME)), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "node_symbols",
    """with n as (select p_partkey as id, p_brand || case when p_partkey % 3 = 0 then '' else '::' || p_name || '::x' end as node, case when p_partkey % 4 = 0 then 'file' when p_partkey % 4 = 1 then null else 'function' end as kind,
      case when p_partkey % 5 > 0 then p_brand end as file, case when p_partkey % 2 = 0 then p_name when p_partkey % 7 = 0 then '' end as name from part)
    select id, case when kind = 'file' then node else coalesce(file, '') end as file,
    case when kind = 'file' then '' when name <> '' then name when contains(node, '::') then substr(node, strpos(node, '::') + 2) else node end as symbol from n""",
)
def node_symbols(spark, d):
    rows = V.table(spark, d, "part").selectExpr(
        "p_partkey as id", "p_brand || case when p_partkey % 3 = 0 then '' else '::' || p_name || '::x' end as node", "case when p_partkey % 4 = 0 then 'file' when p_partkey % 4 = 1 then null else 'function' end as kind",
        "case when p_partkey % 5 > 0 then p_brand end as file", "case when p_partkey % 2 = 0 then p_name when p_partkey % 7 = 0 then '' end as name",
    )
    return rows.select("id", L.node_symbol(F.col("node"), F.col("kind"), F.col("file"), F.col("name")).alias("x")).select("id", "x.file", "x.symbol")


@query("page_numbers", "select source, count(*) as total, (count(*) + 19) // 20 as pages, (count(*) // 2) // 20 + 1 as page from documents group by source")
def page_numbers(spark, d):
    rows = V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"))
    return rows.select("source", "total", L.pages(F.col("total"), F.lit(20), F.expr("total div 2")).alias("p")).select("source", "total", "p.pages", "p.page")


@query("provider_names", "select c_custkey, case when c_custkey % 3 = 0 then 'sentence_transformers' else 'test-deterministic' end as provider from customer")
def provider_names(spark, d):
    name = F.expr("case c_custkey % 6 when 0 then ' MiniLM ' when 3 then 'sentence-transformers' when 1 then 'Test' when 2 then null when 4 then '' else 'mock' end")
    return V.table(spark, d, "customer").select("c_custkey", L.provider(name).alias("provider"))


@query(
    "tree_digests",
    f"""{_P}, k as (select source, sha256(path || chr(10) || sha256(coalesce(text, '<unreadable>'))) as h from p where not {_IGNORED}),
    s as (select source, count(*) as files, {", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::bigint)::varchar as s{k}" for k in range(8))} from k group by source),
    b as (select source, sum(case when '.git' = string_split(path, '/')[1] or doc_id % 10 = 7 then 0 else coalesce(strlen(text), 0) end)::bigint as bytes from p group by source)
    select source, bytes, files, sha256({" || ',' || ".join(f"s{k}" for k in range(8))}) as digest from b left join s using (source)""",
)
def tree_digests(spark, d):
    files = _paths(spark, d).withColumn("is_link", F.col("doc_id") % 10 == 7)
    return snapshots.tree_size(files, "source").join(snapshots.tree_digest(files, "source"), "source", "left").select("source", "bytes", "files", "digest")
