"""Retrieval over chunks: exact cosine top-k, BM25, word overlap, evidence under a budget, citations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

K1, B = 1.5, 0.75  # fixed values of BM25
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512  # rows of each side that a task compares at once
FEW_WORDS = 2000  # words of parts that are looked up where texts are cut

# Patterns of a refusal.
REFUSALS = (
    "not found", "does not (contain|implement|exist|have|support)", "no mention", "not implemented", "no record",
    "i don't know", "cannot find", "unanswerable", "outside the scope", "not present",
)

INSUFFICIENT = "The available repository evidence is insufficient to determine this."  # fixed value


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled up with zeros, and their lengths; -1 for no vector."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    out = np.zeros((len(size), max(0, size.max())))
    out[np.arange(out.shape[1]) < size[:, None]] = pc.list_flatten(vectors).to_numpy()
    return out, size


def _dots(a: np.ndarray, i, b: np.ndarray, j) -> np.ndarray:
    """Of rows a[i] and b[j], summed in order as ``T.cosine`` does, so that the doubles are the same."""
    s = np.zeros(len(i))
    for d in range(min(a.shape[1], b.shape[1])):
        s += a[i, d] * b[j, d]
    return s


def _block_best(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score) of all in a block that may be among a query's k best.

    A matrix product finds who comes near the k-th best, and only those are scored exactly. Of equal scores the k first
    ids are enough, so copies of one vector send no more than k rows a query. No vector: -inf.
    """
    (q, nq), (v, nv) = _matrix(queries["x"]), _matrix(vectors["x"])
    place = np.empty(len(v), dtype=np.int64)
    place[pc.sort_indices(vectors["id"].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(v))
    found: list[tuple] = []
    with np.errstate(all="ignore"):
        lq, lv = (np.sqrt(_dots(x, every := np.arange(len(x)), x, every)) for x in (q, v))
        uq, uv = (x / np.where(n == 0, 1, n)[:, None] for x, n in ((q, lq), (v, lv)))
        width = min(q.shape[1], v.shape[1])
        for at in range(0, len(q), 64):
            part = slice(at, at + 64)
            near = uq[part, :width] @ uv[:, :width].T
            near[np.isnan(near)] = 2  # NaN comes first in Spark's order
            near[(nq[part, None] != nv) | (lq[part, None] * lv == 0)] = 0
            near[(nq[part, None] < 0) | (nv < 0)] = -2
            least = np.partition(near, -k, axis=1)[:, -k] if k < near.shape[1] else near.min(axis=1)
            i, j = np.nonzero(near >= least[:, None] - 4e-9)
            i += at
            norm = lq[i] * lv[j]
            s = np.where((nq[i] != nv[j]) | (norm == 0), 0.0, _dots(q, i, v, j) / norm)
            s[(nq[i] < 0) | (nv[j] < 0)] = -np.inf
            order = np.lexsort((place[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            fresh = np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])]
            keep = np.arange(len(i)) - np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0)) < k
            found.append((i[keep], j[keep], s[keep]))
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": queries["query_id"].take(pa.array(i)), "id": vectors["id"].take(pa.array(j)), "score": pa.array(s)})


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """(id, vector[, scope]) against (query_id, query[, scope]) -> query_id, id, score, rank; ties by id.

    Every query is scored against every vector. Both sides are cut into blocks; a task takes one block of each and sends
    on about k rows a query. Neither side is gathered, so the queries may grow with the table.
    """

    def side(rows: DataFrame, name: str, vector: str) -> DataFrame:
        whole = F.when(F.forall(vector, lambda x: x.isNotNull()), F.transform(vector, lambda x: x.cast("double")))
        rows = rows.select(name, whole.alias("x"), (F.col(scope) if scope else F.lit(0)).alias("_scope"))
        return rows.filter("_scope is not null")

    v, q = side(vectors, "id", "vector"), side(queries, "query_id", "query")
    in_v, in_q = (max(1, -(-rows.count() // size)) for rows, size in ((v, VECTOR_BLOCK), (q, QUERY_BLOCK)))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ("_scope", "_v", "_q")
    v = v.select("*", block("id", in_v).alias("_v"), every(in_q).alias("_q"))
    q = q.select("*", block("query_id", in_q).alias("_q"), every(in_v).alias("_v"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return _block_best(a, b, k)
        return pa.table({"query_id": a["query_id"].slice(0, 0), "id": b["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    types = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    scored = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(best, types)
    scored = scored.withColumn("score", F.when(F.col("score") != float("-inf"), F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, ...) joined with the (part, ...) that it contains.

    A part's inner words, those with a blank on either side of them, are words of any text that contains it. Texts and parts are joined by
    the longest of them and verified. A part of fewer than three words has no inner word: only such parts are looked for in every text.
    Nulls meet nothing, an empty part is in every text. Up to ``FEW_WORDS`` such words, a text is copied for each that it has, and not for each of its own.
    """
    inner = F.filter(F.split("part", " "), lambda w, i: (i > 0) & (w != ""))
    inner = F.when(F.endswith("part", F.lit(" ")), inner).otherwise(F.slice(inner, 1, F.greatest(F.lit(0), F.size(inner) - 1)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    parts = parts.withColumn("_word", longest)
    long, short = parts.filter("_word is not null"), parts.filter("_word is null and part is not null").drop("_word")
    words = F.array_distinct(F.split("text", " "))
    wanted = [r["_word"] for r in long.select("_word").distinct().limit(FEW_WORDS + 1).collect()]
    if len(wanted) <= FEW_WORDS:
        words, long = F.filter(words, lambda w: w.isin(wanted)), F.broadcast(long) if long.count() <= FEW_WORDS else long
    met = texts.select("*", F.explode(words).alias("_word")).join(long, "_word").filter(F.contains("text", "part")).drop("_word")
    return met.unionByName(texts.join(short, F.contains("text", "part")))


def bm25(documents: DataFrame, queries: DataFrame, terms=T.terms) -> DataFrame:
    """(id, text), (query_id, text) -> (query_id, id, score) of documents that share a term with the query.

    An inverted index: only terms of queries are kept after documents are counted, and a term met twice in a query counts twice.
    """
    tokens = documents.select("id", terms(F.col("text")).alias("t"))
    sizes = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).first()
    n, mean = sizes["n"], sizes["mean"] or 1.0
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    posted = tokens.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    tf = posted.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
    parts = weighted.withColumn("part", part).join(asked, "term").select("query_id", "id", "term", (F.col("part") * F.col("times")).alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("term", "part")))  # a query's terms; added in their order, so equal documents score equally
    return parts.groupBy("query_id", "id").agg(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))


def overlap_scores(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """The share of a query's distinct identifiers that a document has, of documents that have any."""
    asked = queries.select("query_id", F.array_distinct(T.identifiers(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    words = asked.select("query_id", F.size("t").alias("size"), F.explode("t").alias("term"))
    held = documents.select("id", F.explode(F.array_distinct(T.identifiers(F.col("text")))).alias("term"))
    return held.join(F.broadcast(words) if words.count() <= 100_000 else words, "term").groupBy("query_id", "id", "size").agg(F.count("*").alias("n")).select("query_id", "id", (F.col("n") / F.col("size")).alias("score"))


def top(scores: DataFrame, k: int, documents: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The k best of each query by their scores as they are, ties by id. With ``documents`` (id) and ``queries`` (query_id), documents without a score have 0
    and fill up a query that has fewer than k: of the first 2 k ids at most k are hits, so the rest are enough."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if documents is None:
        return best
    first = documents.select("id").orderBy("id").limit(2 * k).agg(F.collect_list("id").alias("ids"))
    hits = best.groupBy("query_id").agg(F.collect_set("id").alias("hits"))  # k ids at most
    short = queries.select("query_id").distinct().join(hits, "query_id", "left").filter(F.coalesce(F.size("hits"), F.lit(0)) < k)
    rest = short.join(F.broadcast(first)).select("query_id", F.explode(F.array_except("ids", F.coalesce("hits", F.slice("ids", 1, 0)))).alias("id"), F.lit(0.0).alias("score"))
    return best.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evidence(blocks: Column, budget: int, least: int = 20) -> Column:
    """Texts in order under a budget of characters: the one that overflows is cut, if ``least`` are left for it, and is the last."""
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        room = F.lit(budget) - a["used"]
        fits = F.length(x) <= room
        more = F.when(fits, x).when(room >= least, F.substring(x, F.lit(1), room))
        return F.when(a["full"], a).otherwise(
            F.struct((a["used"] + F.least(F.length(x), room)).alias("used"), (~fits).alias("full"), F.when(more.isNull(), a["kept"]).otherwise(F.concat(a["kept"], F.array(more))).alias("kept"))
        )

    return F.aggregate(blocks, zero, step)["kept"]


def citations(answer: Column, known: Column) -> tuple[Column, Column, Column]:
    """Cited tags that exist, cited tags that don't, and the answer without the latter."""
    tags = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E\d+)\]"), F.lit(1)))
    good, bad = F.array_intersect(tags, known), F.array_except(tags, known)
    clean = F.aggregate(bad, answer, lambda a, x: F.replace(a, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    return good, bad, F.trim(F.regexp_replace(clean, " {2,}", " "))


def is_refusal(answer: Column) -> Column:
    return F.rlike(F.lower(answer), F.lit("|".join(REFUSALS)))


def budget_fold(costs: Column, budget: float) -> Column:
    """Requests in order: one whose estimate would pass the budget is skipped and adds nothing; once the spent cost passes it, all stop.

    ``costs``: array of (estimate, actual). -> array of states: run, skipped, halted.
    """
    zero = F.struct(F.lit(0.0).alias("spent"), F.lit(False).alias("halted"), F.array().cast("array<string>").alias("states"))

    def step(a, x):
        skip = a["spent"] + x["estimate"] > budget
        spent = F.when(a["halted"] | skip, a["spent"]).otherwise(a["spent"] + x["actual"])
        state = F.when(a["halted"], "halted").when(skip, "skipped").otherwise("run")
        return F.struct(spent.alias("spent"), (a["halted"] | (spent > budget)).alias("halted"), F.concat(a["states"], F.array(state)).alias("states"))

    return F.aggregate(costs, zero, step)["states"]


def file_ranking(scores: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) and (id, file), or both in one -> (query_id, file, score, rank): files in the order in which a ranking of chunks first
    meets them. Files without a scored chunk come after all others and aren't listed.

    The first chunk of each file is found by aggregation before anything is sorted.
    """
    best = (scores if files is None else scores.join(files, "id")).groupBy("query_id", "file").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.s", "b.id")
    return best.select("query_id", "file", (-F.col("b.s")).alias("score"), F.row_number().over(order).alias("rank"))


def labelled_evidence(chunks: Column, budget: int) -> Column:
    """Chunks in order (chunk_id, path, first, last, lang, entity, sha, text) as blocks headed E1, E2, ... under a budget of characters.

    A block that overflows is cut and marked; it is left out if even its header does not fit, unless it is the first.
    -> array of (label, chunk_id, block)
    """
    mark = "\n[truncated]"
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    numbered = F.transform(chunks, lambda c, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("label"), c.alias("c")))

    def header(x):
        c = x["c"]
        line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(name), v, F.lit("\n"))).otherwise("")
        return F.concat(
            F.lit("["), x["label"], F.lit("]\nFile: "), text(c["path"]), F.lit("\nLines: "), text(c["first"]), F.lit("-"), text(c["last"]),
            F.lit("\nLanguage: "), F.coalesce(c["lang"], F.lit("unknown")), F.lit("\n"), line("Entity: ", c["entity"]), line("Commit: ", c["sha"]),
            F.lit("ChunkID: "), text(c["chunk_id"]), F.lit("\n\n"),
        )

    headed = F.transform(numbered, lambda x: F.struct(x["label"].alias("label"), x["c"]["chunk_id"].alias("chunk_id"), header(x).alias("head"), text(x["c"]["text"]).alias("text")))
    kind = "array<struct<label:string,chunk_id:string,block:string>>"
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast(kind).alias("kept"))

    def step(a, x):
        room = F.lit(budget) - a["used"]
        whole = F.length(x["head"]) + F.length(x["text"])
        left = F.greatest(F.lit(0), room - F.length(x["head"]) - len(mark))
        block = F.when(whole <= room, F.concat(x["head"], x["text"])).otherwise(F.concat(x["head"], F.substring(x["text"], F.lit(1), left), F.lit(mark)))
        stop = a["full"] | (room <= 0) | ((F.length(block) > room) & (F.size(a["kept"]) > 0))
        more = F.array(F.struct(x["label"].alias("label"), x["chunk_id"].cast("string").alias("chunk_id"), block.alias("block")))
        return F.struct(F.when(stop, a["used"]).otherwise(a["used"] + F.length(block)).alias("used"), stop.alias("full"), F.when(stop, a["kept"]).otherwise(F.concat(a["kept"], more)).alias("kept"))

    return F.aggregate(headed, zero, step)["kept"]


def settle(answer: Column, cited: Column) -> tuple[Column, Column]:
    """An empty answer, or one that calls the evidence insufficient, becomes the one refusal and loses its citations."""
    poor = (F.coalesce(answer, F.lit("")) == "") | F.contains(F.lower(answer), F.lit("insufficient"))
    return F.when(poor, INSUFFICIENT).otherwise(answer), F.when(poor, F.slice(cited, 1, 0)).otherwise(cited)
