"""Retrieval, question answering and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import ask, chunk_search, evaluation, ranking, retrieval
from lodestrata.operators.postings import PostingIndex
from lodestrata.plans import query
from lodestrata.plans.store import new_root
from lodestrata.sources import views as V
from lodestrata.sources.views import sql


def _vectors(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("run"))


_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query("vector_topk", f"select q.vec_id as query_id, e.vec_id as id, round({_COS}, 4) as score, (row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id))::int as rank from embeddings e, embeddings q where q.vec_id % 20 = 0 qualify rank <= 5")
def vector_topk(spark, d):
    v = _vectors(spark, d)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return retrieval.cosine_top_k(v, q, 5).withColumn("score", F.round("score", 4))


@query("vector_topk_scoped", f"select q.vec_id as query_id, e.vec_id as id, (row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id))::int as rank from embeddings e join embeddings q on e.label = q.label where q.vec_id % 20 = 0 qualify rank <= 3")
def vector_topk_scoped(spark, d):
    v = _vectors(spark, d)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), "run")
    return retrieval.cosine_top_k(v, q, 3, "run").select("query_id", "id", "rank")


_CHUNK_SEARCH = f"""k as (select coalesce(lang, source, 'none') as run_id, doc_id, 'c' || doc_id as chunk_id, coalesce(source, 'none') || '/' || doc_id as file_path, coalesce(length(text), 0) as n from documents),
  e as (select run_id, doc_id, 'm' || label % 2 as model, embedding from embeddings join k on vec_id = doc_id),
  q as (select k.doc_id as query_id, run_id, 'm' || (k.doc_id // 20) % 2 as model, embedding from k join embeddings on vec_id = k.doc_id % (select count(*) from embeddings) where k.doc_id % 20 = 0),
  h as (select query_id, q.run_id, q.model, chunk_id, file_path, n, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s,
      row_number() over (partition by query_id order by s desc, chunk_id) as rank from q join e on e.run_id = q.run_id and e.model = q.model and len(e.embedding) = len(q.embedding) join k using (doc_id) qualify rank <= 5)"""


def _chunk_search(spark, d):
    """Documents as chunks of the run of their language (else their source), embeddings of two models, every 20th document a query."""
    run = F.coalesce("lang", "source", F.lit("none")).alias("run_id")
    docs = V.table(spark, d, "documents").select(
        run, "doc_id", F.col("doc_id").cast("string").alias("source_chunk_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("file_path"), F.coalesce(F.length("text"), F.lit(0)).alias("n"),
    )
    e = V.table(spark, d, "embeddings")
    model = lambda n: F.concat(F.lit("m"), (n % 2).cast("string")).alias("model_name")
    vectors = e.join(docs.select("run_id", "doc_id", "source_chunk_id"), F.col("vec_id") == F.col("doc_id")).select("run_id", "source_chunk_id", model(F.col("label")), F.size("embedding").alias("dimension"), F.col("embedding").alias("vector"))
    asks = docs.filter("doc_id % 20 = 0").withColumn("vec_id", F.col("doc_id") % e.count()).join(e.select("vec_id", "embedding"), "vec_id")
    asks = asks.select(F.col("doc_id").alias("query_id"), "run_id", model(F.expr("doc_id div 20")), F.col("embedding").alias("query"))
    return chunk_search.search(vectors, docs.drop("doc_id"), asks, 5)


@query("chunk_search", f"with {_CHUNK_SEARCH} select query_id, rank::int as rank, round(s, 4) as score, run_id, model as model_name, chunk_id, file_path, n from h")
def chunk_search_(spark, d):
    return _chunk_search(spark, d)[0].select("query_id", "rank", "score", "run_id", "model_name", "chunk_id", "file_path", F.col("n").cast("long").alias("n"))


@query(
    "vector_outcomes",
    f"""with {_CHUNK_SEARCH} select query_id, run_id, case when count(h.s) > 0 then 'hits' when exists (select 1 from e where e.run_id = q.run_id) then 'mismatch' else 'unavailable' end as outcome, count(h.s) as total_retrieved
    from q left join (select query_id, s from h) h using (query_id) group by query_id, run_id""",
)
def vector_outcomes(spark, d):
    return _chunk_search(spark, d)[1]


@query(
    "hash_embedding",
    """with r as (select item_id, list_transform(range(64), lambda i: ('0x' || substr(sha256(text || i), 1, 8))::bigint::double) as raw from benchmark),
    s as (select item_id, list_transform(raw, lambda x: (case when x >= 2147483648 then x - 4294967296 else x end) / 2147483647::double) as v from r),
    n as (select *, sqrt(list_reduce(list_prepend(0.0::double, v), lambda a, x: a + x * x)) as norm from s)
    select item_id, list_transform(v, lambda x: round(x / norm, 9)) as vector from n""",
)
def hash_embedding(spark, d):
    vector = F.transform(T.hash_vector(F.col("text")), lambda x: F.round(x, 9))
    return V.table(spark, d, "benchmark").select("item_id", vector.alias("vector"))


_TERMS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1)"
_BM25 = f"""t as (select doc_id as id, {_TERMS.format("text")} as t from documents), s as (select count(*)::double as n, avg(len(t)) as mean from t),
  q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TERMS.format("text")}) as term from benchmark) group by all),
  tf as (select id, length, term, count(*) as tf from (select id, len(t) as length, unnest(t) as term from t) where term in (select term from q) group by all),
  df as (select term, count(*) as df from tf group by term),
  scores as (select query_id, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / mean)) * times order by term) as score
    from tf join df using (term) join q using (term) cross join s group by query_id, id),
  pairs as (select item_id as query_id, doc_id as id, coalesce(score, 0) as score from benchmark cross join documents left join scores on query_id = item_id and id = doc_id),
  ranked as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from pairs)"""


def _bm25(spark, d, k):
    """The k best of each item. Sets of queries that are too large for a task are answered by an index, written for their terms alone."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = ranking.bm25(docs, items, k, new_root(spark))
    if best is not None:
        return retrieval.top(best, k, documents=docs, queries=items)
    index = PostingIndex(spark, new_root(spark)).build(docs, only=items.select(F.explode(T.terms(F.col("text"))).alias("term")).distinct())
    return index.search(items, k)


def _overlap(spark, d, k):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = ranking.overlap(docs, items, k, new_root(spark))
    return retrieval.top(retrieval.overlap_scores(docs, items) if best is None else best, k, documents=docs, queries=items)


@query("bm25_topk", f"with {_BM25} select query_id, id, round(score, 7) as score, rank from ranked where rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).withColumn("score", F.round("score", 7))


_LEX = """lq as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) as t from benchmark),
  lt as (select doc_id as id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'))) as term from documents),
  ls as (select query_id, id, count(*) / len(t)::double as score from (select query_id, t, unnest(t) as term from lq) join lt using (term) group by query_id, id, t),
  lp as (select q.query_id, doc_id as id, coalesce(score, 0) as score from lq q cross join documents left join ls on ls.query_id = q.query_id and ls.id = doc_id),
  lr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from lp)"""


@query("lexical_topk", f"with {_LEX} select query_id, id, round(score, 8) as score, rank from lr where rank <= 5")
def lexical_topk(spark, d):
    return _overlap(spark, d, 5).withColumn("score", F.round("score", 8))


@query(
    "ir_metrics",
    f"""{sql("truth")}, {_BM25}, w as (select item_id as query_id, count(*) as wanted from truth group by 1),
    f as (select query_id, count(*) as found, min(rank) as first from ranked join truth on item_id = query_id and doc_id = id where rank <= 10 group by 1)
    select count(*) as queries, round(avg(case when found > 0 then 1 else 0 end), 8) as hit, round(avg(coalesce(found, 0) / wanted::double), 8) as recall, round(avg(coalesce(1.0::double / first, 0)), 8) as mrr from w left join f using (query_id)""",
)
def ir_metrics(spark, d):
    truth = V.truth(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    m = evaluation.retrieval_metrics(_bm25(spark, d, 10), truth, "query_id", "id", 10)
    return m.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 8).alias("hit"), F.round(F.avg("recall"), 8).alias("recall"), F.round(F.avg("reciprocal_rank"), 8).alias("mrr"))


_METHODS = "m as (select 'bm25' as method, * from ranked where rank <= 10 union all select 'overlap', query_id, id, score, rank from lr where rank <= 10)"
_ASK = """select item_id as query_id, 'r' || item_id % 3 as repo, case when len(string_split(text, ' ')) < 25 then 'lookup' when len(string_split(text, ' ')) < 40 then 'explanation' else 'cross-file' end as difficulty, contains(text, ',') as paraphrase from benchmark"""


@query(
    "retrieval_report",
    f"""{sql("truth")}, {_BM25}, {_LEX}, {_METHODS}, w as (select item_id as query_id, doc_id as id from truth), n as (select query_id, count(*) as wanted from w group by 1),
    f as (select method, query_id, count(id) filter (where rank <= 1) as f1, count(id) filter (where rank <= 5) as f5, min(rank) as first from m join w using (query_id, id) group by all),
    tops as (select method, query_id, max(score) as top from m where rank = 1 group by all),
    r as (select a.*, x.method, n.wanted is null as un, coalesce(f1, 0) as f1, coalesce(f5, 0) as f5, wanted, coalesce(1.0::double / first, 0) as rr, top
      from ({_ASK}) a cross join (values ('bm25'), ('overlap')) x(method) left join n using (query_id) left join f on f.query_id = a.query_id and f.method = x.method left join tops on tops.query_id = a.query_id and tops.method = x.method)
    select method, repo, grouping(method, repo)::int as overall, count(*) filter (where not un) as answerable, count(*) filter (where un) as unanswerable,
      round(avg((f1 > 0)::int) filter (where not un), 7) as hit_1, round(avg(f1 / wanted::double) filter (where not un), 7) as recall_1, round(avg((f5 > 0)::int) filter (where not un), 7) as hit_5, round(avg(f5 / wanted::double) filter (where not un), 7) as recall_5,
      round(avg(rr) filter (where not un), 7) as mrr, {", ".join(f"round(avg(rr) filter (where not un and difficulty = '{x}'), 7) as mrr_{x.replace('-', '_')}" for x in ("lookup", "explanation", "cross-file"))},
      round(avg(rr) filter (where not un and paraphrase), 7) as mrr_paraphrase, round(avg(rr) filter (where not un and not paraphrase), 7) as mrr_plain,
      round(avg(top) filter (where not un and f1 > 0), 7) as top1_hit_mean, round(avg(top) filter (where not un and f1 = 0), 7) as top1_miss_mean,
      {", ".join(f"round({f}(top) filter (where {w}), 7) as {n}_{x}" for w, n in (("not un", "top1"), ("un", "unanswerable_top1")) for f, x in (("avg", "mean"), ("min", "min"), ("max", "max")))}
    from r group by grouping sets ((method, repo), (method), ())""",
)
def retrieval_report(spark, d):
    """Both rankings by method and repository; an item that no document contains is unanswerable."""
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    truth = V.truth(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    n = F.size(F.split("text", " "))
    asked = items.select("query_id", F.concat(F.lit("r"), (F.col("query_id") % 3).cast("string")).alias("repo"), F.when(n < 25, "lookup").when(n < 40, "explanation").otherwise("cross-file").alias("difficulty"), F.contains("text", F.lit(",")).alias("paraphrase"))
    asked = asked.join(truth.select("query_id").distinct().withColumn("_t", F.lit(True)), "query_id", "left").withColumn("unanswerable", F.col("_t").isNull()).drop("_t")
    rows = None
    for method, ranked in (("bm25", _bm25(spark, d, 10)), ("overlap", _overlap(spark, d, 10))):
        own = asked.withColumn("method", F.lit(method)).join(ranked.filter("rank = 1").select("query_id", F.col("score").alias("top1_score")), "query_id", "left")
        for k in (1, 5):
            m = evaluation.retrieval_metrics(ranked, truth, "query_id", "id", k).select("query_id", F.col("hit").alias(f"hit_{k}"), F.col("recall").alias(f"recall_{k}"))
            own = own.join(m, "query_id", "left")
        own = own.join(evaluation.retrieval_metrics(ranked, truth, "query_id", "id", 10).select("query_id", "reciprocal_rank"), "query_id", "left")
        rows = own if rows is None else rows.unionByName(own)
    out = evaluation.retrieval_report(rows, (1, 5), ["method", "repo"])
    return out.select(*[F.round(c, 7).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    "ask_items",
    f"""with {_BM25}, e as (select query_id, list(doc_id order by rank) as ids from ranked join documents on doc_id = id where rank <= 4 group by 1),
    a as (select item_id as query_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as question, ids from benchmark left join e on query_id = item_id),
    w as (select *, regexp_replace('Based on the repository evidence, ' || trim(regexp_extract(question, '^[^\n]+')) || ' is implemented as shown in the source code ' || array_to_string(list_transform(range(1, len(ids) + 1), lambda k: '[E' || k || ']'), '') || '.', ' {{2,}}', ' ', 'g') as answer from a)
    select query_id, case when question = '' or contains(lower(answer), 'insufficient') then 'The available repository evidence is insufficient to determine this.' else answer end as answer,
      case when question = '' or contains(lower(answer), 'insufficient') then '' else array_to_string(ids, ',') end as citations, len(ids)::int as retrieved from w""",
)
def ask_items(spark, d):
    """Every benchmark item is a question to the corpus; its evidence are the four best documents, whole."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("corpus").alias("run_id"), F.col("text").alias("question"))
    none = F.lit(None).cast("string")
    found = docs.join(F.broadcast(_bm25(spark, d, 4)), "id").select("query_id", "rank", F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("path"), F.lit(1).alias("first"), F.lit(1).alias("last"), "lang", none.alias("entity"), none.alias("sha"), "text")
    out = ask.ask(items, spark.range(1).select(F.lit("corpus").alias("run_id")), found, budget=1 << 30)
    return out.select("query_id", "answer", F.array_join("citations", ",").alias("citations"), "retrieved")


@query(
    "score_stats",
    f"""with {_BM25}, a as (select query_id, list_sort(list(score)) as s, median(score) as middle, avg(score) as mean from ranked where rank <= 40 group by 1)
    select query_id, len(s)::int as n, round(middle, 8) as middle, round(mean, 8) as mean,
    round(case when len(s) >= 20 then s[k] + (0.95::double * (len(s) + 1) - k) * (s[k + 1] - s[k]) else s[len(s)] end, 8) as p95 from (select *, greatest(1, least(floor(0.95::double * (len(s) + 1))::int, len(s) - 1)) as k from a)""",
)
def score_stats(spark, d):
    rows = _bm25(spark, d, 40)
    return rows.groupBy("query_id").agg(
        F.count("*").cast("int").alias("n"), F.round(F.median("score"), 8).alias("middle"), F.round(F.avg("score"), 8).alias("mean"),
        F.round(evaluation.exclusive_quantile(F.collect_list("score"), 0.95), 8).alias("p95"),
    )


@query(
    "evidence_budget",
    f"""with recursive {_BM25}, e as (select query_id, rank, length(text)::int as n from ranked join documents on doc_id = id where rank <= 6),
    f as (select query_id, rank, 0 as before_, least(n, 4000) as kept, n > 4000 as full_ from e where rank = 1
      union all select e.query_id, e.rank, f.before_ + f.kept, case when n <= 4000 - f.before_ - f.kept then n when 4000 - f.before_ - f.kept >= 20 then 4000 - f.before_ - f.kept else 0 end, n > 4000 - f.before_ - f.kept
      from f join e on e.query_id = f.query_id and e.rank = f.rank + 1 where not f.full_)
    select query_id, count(*) filter (where kept > 0)::int as blocks, sum(kept)::int as chars from f group by query_id""",
)
def evidence_budget(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = docs.join(F.broadcast(_bm25(spark, d, 6)), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("b"))  # six texts a query
    kept = retrieval.evidence(F.transform("b", lambda x: x["text"]), 4000)
    return rows.withColumn("kept", kept).select("query_id", F.size("kept").alias("blocks"), F.aggregate("kept", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


_TAGGED = "text || ' [E' || turn || '] see [E' || (turn + 3) || ']  [E1]'"


@query(
    "citation_validation",
    rf"""with a as (select conv_id, turn, {_TAGGED} as answer from conversations), t as (select *, list_distinct(regexp_extract_all(answer, '\[(E\d+)\]', 1)) as tags from a),
    b as (select *, list_sort(list_filter(tags, lambda x: x in ('E1', 'E2', 'E3'))) as good, list_sort(list_filter(tags, lambda x: x not in ('E1', 'E2', 'E3'))) as bad from t)
    select conv_id, turn, array_to_string(good, ',') as cited, array_to_string(bad, ',') as dropped, sha256(trim(regexp_replace(regexp_replace(answer, '\[E(0|[4-9]|\d\d+)\]', '', 'g'), ' {{2,}}', ' ', 'g'), ' ')) as answer_hash from b""",
)
def citation_validation(spark, d):
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" [E"), F.col("turn").cast("string"), F.lit("] see [E"), (F.col("turn") + 3).cast("string"), F.lit("]  [E1]")).alias("answer"))
    good, bad, clean = retrieval.citations(F.col("answer"), F.array(*map(F.lit, ("E1", "E2", "E3"))))
    return rows.select("conv_id", "turn", F.array_join(F.sort_array(good), ",").alias("cited"), F.array_join(F.sort_array(bad), ",").alias("dropped"), F.sha2(clean, 256).alias("answer_hash"))


_SAID = "text || case turn % 5 when 1 then ' It was NOT FOUND' when 2 then ' The code does not support it' when 3 then ' This is outside the scope' else '' end"


@query(
    "refusal_rate",
    f"""select role, count(*) as answers, count(*) filter (where regexp_matches(lower({_SAID}),
      'not found|does not (contain|implement|exist|have|support)|no mention|not implemented|no record|i don''t know|cannot find|unanswerable|outside the scope|not present')) as refusals
    from conversations group by role""",
)
def refusal_rate(spark, d):
    rows = V.table(spark, d, "conversations").select("role", F.expr(_SAID).alias("said"))
    return rows.groupBy("role").agg(F.count("*").alias("answers"), F.count_if(retrieval.is_refusal(F.col("said"))).alias("refusals"))


@query(
    "budget_fold",
    """with recursive c as (select conv_id, turn, length(text) / 100.0::double as estimate, length(text) / 80.0::double as actual from conversations),
    f as (select conv_id, turn, case when estimate > 20 then 0 else actual end as spent, case when estimate > 20 then 'skipped' else 'run' end as state, (case when estimate > 20 then 0 else actual end) > 20 as halted from c where turn = 0
      union all select c.conv_id, c.turn, case when f.halted or f.spent + estimate > 20 then f.spent else f.spent + actual end, case when f.halted then 'halted' when f.spent + estimate > 20 then 'skipped' else 'run' end,
        f.halted or (case when f.spent + estimate > 20 then f.spent else f.spent + actual end) > 20 from f join c on c.conv_id = f.conv_id and c.turn = f.turn + 1)
    select conv_id, string_agg(state, ',' order by turn) as states from f group by conv_id""",
)
def budget_fold(spark, d):
    rows = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.length("text") / 100.0).alias("estimate"), (F.length("text") / 80.0).alias("actual")))).alias("c"))
    return rows.select("conv_id", F.array_join(retrieval.budget_fold(F.col("c"), 20.0), ",").alias("states"))


_WILSON = """round(greatest(0, least(1, (p + 1.95996::double ** 2 / (2 * n) {0} 1.95996::double * sqrt(p * (1 - p) / n + 1.95996::double ** 2 / (4 * n * n))) / (1 + 1.95996::double ** 2 / n))), 8)"""


@query(
    "edge_metrics",
    f"""with r as (select lang, case when quality = 1 and toxic = 0 then 'TP' when quality = 0 then ' fp' when doc_id % 2 = 0 then 'AMBIGUOUS' else 'FN ' end as label from labels join documents using (doc_id)),
    c as (select lang, grouping(lang)::int as overall, count(*) filter (where label = 'TP') as tp, count(*) filter (where label = ' fp') as fp, count(*) filter (where label = 'AMBIGUOUS') as ambiguous, count(*) filter (where label = 'FN ') as fn from r group by rollup (lang)),
    x as (select *, (tp + fp)::double as n, tp / (tp + fp)::double as p from c)
    select lang, overall, tp, fp, ambiguous, fn, round(p, 8) as precision, {_WILSON.format("-")} as low, {_WILSON.format("+")} as high, round(case when fn > 0 then tp / (tp + fn)::double end, 8) as recall, round(case when fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) end, 8) as f1 from x""",
)
def edge_metrics(spark, d):
    rows = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    label = F.expr("case when quality = 1 and toxic = 0 then 'TP' when quality = 0 then ' fp' when doc_id % 2 = 0 then 'AMBIGUOUS' else 'FN ' end")
    out = evaluation.confusion(rows.select("lang", label.alias("label")), "lang")
    return out.withColumns({c: F.round(c, 8) for c in ("precision", "low", "high", "recall", "f1")})


@query("rank_average", "select doc_id, n_chars, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as rank from documents")
def rank_average(spark, d):
    return evaluation.average_rank(V.table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "rank").select("doc_id", "n_chars", "rank")


@query(
    "spearman",
    """with r as (select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as x, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2.0::double as y from labels join documents using (doc_id))
    select round(corr(x, y), 7) as rho, count(*) as n from r""",
)
def spearman(spark, d):
    rows = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.spearman(rows, "n_chars", "quality").withColumn("rho", F.round("rho", 7))


@query(
    "kendall",
    """with r as (select n_chars as x, quality + toxic as y, row_number() over () as i from labels join documents using (doc_id)),
    p as (select sign(a.x - b.x) * sign(a.y - b.y) as s, a.x = b.x as tx, a.y = b.y as ty from r a join r b on a.i < b.i)
    select count(*) filter (where s > 0) as concordant, count(*) filter (where s < 0) as discordant,
    round((count(*) filter (where s > 0) - count(*) filter (where s < 0)) / sqrt(count(*) filter (where not tx)::double * count(*) filter (where not ty)), 8) as tau from p""",
)
def kendall(spark, d):
    rows = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.kendall(rows.select(F.col("n_chars").alias("x"), F.expr("quality + toxic").alias("y")), "x", "y").withColumn("tau", F.round("tau", 8))


@query("event_windows", "select time_bucket(interval 1 hour, ts) as begin, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_windows(spark, d):
    """Tumbling windows, the batch form of the stream (an addition: the reference has no event time)."""
    rows = V.table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "total")


@query(
    "event_sessions",
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
    select user_id, min(ts) as begin, count(*) as n from s group by user_id, k""",
)
def event_sessions(spark, d):
    rows = V.table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begin"), "n")


@query(
    "rate_limit",
    """with recursive e as (select event_id as request_id, sha256(user_id::varchar) as key, epoch(ts)::double as moment, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select request_id, key, k, moment, 0.0::double as rest, true as allowed, 0 as retry_after from e where k = 1
      union all select x.request_id, x.key, x.k, x.moment, case when t >= 1 then t - 1 else t end, t >= 1, case when t >= 1 then 0 else greatest(1, ceil((1 - t) / (1 / 60.0::double)))::int end
      from (select e.*, least(1, f.rest + greatest(0, e.moment - f.moment) / 60.0::double) as t from f join e on e.key = f.key and e.k = f.k + 1) as x)
    select request_id, key, allowed, retry_after from f""",
)
def rate_limit(spark, d):
    from lodestrata.streaming.rate_limit import admit

    return admit(V.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("key"), F.col("ts").cast("timestamp").alias("at")), rpm=1)
