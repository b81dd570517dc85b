"""Vectors joined with their chunks: exact cosine search within a run, a model and a dimension, pruned by blocks.

Unit vectors of a scope (run, model, dimension) are dealt to pivots of the sphere, which a bounded sample gives, and packed into blocks of up to
``BLOCK`` with their centroid and radius. By the triangle inequality no vector of a block is nearer to a query than the distance from the centroid
less the radius, so its cosine is at most 1 - d^2 / 2. The block with the best bound is scored first; the k-th best score found there rules out all blocks whose
bound stays below it before any product is formed. Scores are summed in the order of dimensions and ranked as they are, ties by chunk id;
results show four digits.

Outcomes: ``hits`` where the scope has vectors, ``mismatch`` where the run has vectors of another model or dimension only, ``unavailable`` where it has chunks
but no vectors, ``empty`` where the run has neither or is unknown.

Defined results: a vector without a chunk of its run, and null vectors, take no part; a zero vector scores 0 with everything; a null query vector has no hits;
no queries or no vectors give no results; rows that repeat a chunk id are chunks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import checkpoint_dir
from lodestrata.operators.retrieval import _dots as dots

#: Vectors of a block at most (about), sampled vectors, vectors for each pivot (about), and queries that go to a block together.
BLOCK, SAMPLE, OF_PIVOT, TOGETHER = 8192, 4096, 4096, 1024
_SCOPE = ("run_id", "model_name", "dimension")
_SLACK = 1e-9


def _unit(raw: list) -> np.ndarray:
    x = np.array(raw, dtype=float).reshape(len(raw), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(q: np.ndarray, x: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k best rows of each query, ties by ``place``; 0 for a zero vector.

    A matrix product finds what comes near the k-th best, and only that is summed in the order of dimensions.
    """
    length = lambda z: np.sqrt(dots(z, every := np.arange(len(z)), z, every))
    lq, lx = length(q), length(x)
    found: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    with np.errstate(all="ignore"):
        uq, ux = (z / np.where(n == 0, 1, n)[:, None] for z, n in ((q, lq), (x, lx)))
        for at in range(0, len(q), 64):
            near = uq[at : at + 64] @ ux.T
            near[np.isnan(near)] = 2
            least = np.partition(near, -k, axis=1)[:, -k] if k < near.shape[1] else near.min(axis=1)
            i, j = np.nonzero(near >= least[:, None] - 4e-9)
            i += at
            norm = lq[i] * lx[j]
            s = np.where(norm > 0, dots(q, i, x, j) / norm, 0.0)
            order = np.lexsort((place[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0))
            keep = np.arange(len(i)) - first < k
            found.append((i[keep], j[keep], s[keep]))
    i, j, s = (np.concatenate(z) for z in zip(*found, strict=True))
    return i, j, s


def _blocks(vectors: DataFrame) -> DataFrame:
    """(scope, chunk_key, chunk_id, vector) -> a row for each block: scope, block, centroid, radius, keys, ids, cells."""
    spark = vectors.sparkSession
    scopes = vectors.groupBy(*_SCOPE).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    n, most = scopes["n"] or 0, scopes["most"] or 0  # pivots for the largest scope, so that its blocks are neither many nor small
    share = min(1.0, SAMPLE / max(1, n)) * 1_000_000
    sample = vectors.filter(F.pmod(F.xxhash64("chunk_key"), F.lit(1_000_000)) < share).select("vector").limit(2 * SAMPLE).collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r["vector"]) for r in sample}:
        own = _unit(sorted(list(r["vector"]) for r in sample if len(r["vector"]) == size))
        pivots[size] = own[np.linspace(0, len(own) - 1, max(1, min(len(own), most // OF_PIVOT))).astype(int)]
    held = spark.sparkContext.broadcast(pivots)  # of a bounded sample

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).to_pylist()
            pivot = [int((_unit([v]) @ held.value[len(v)].T).argmax()) if len(v) in held.value and v else 0 for v in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32())], [*batch.schema.names, "pivot"])

    rows = vectors.select(*_SCOPE, "chunk_key", "chunk_id", "vector").mapInArrow(dealt, f"{_types(vectors)}, chunk_key long, chunk_id string, vector array<double>, pivot int")
    sizes = rows.groupBy(*_SCOPE, "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(sizes, [*_SCOPE, "pivot"]).withColumn("part", F.pmod(F.xxhash64("chunk_key"), F.col("parts")).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_key")
        raw = table["vector"].to_pylist()
        x = _unit(raw)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) if x.shape[1] else 0.0
        values = [*(k.as_py() for k in key[:3]), centre.tolist(), radius, table["chunk_key"].to_pylist(), table["chunk_id"].to_pylist(), np.array(raw, dtype="<f8").tobytes()]
        return pa.table({c: pa.array([v], t) for (c, t), v in zip(_block_schema(table), values, strict=True)})

    kinds = f"{_types(vectors)}, centroid array<double>, radius double, keys array<long>, ids array<string>, cells binary"
    packed = rows.select(*_SCOPE, "pivot", "part", "chunk_key", "chunk_id", "vector").groupBy(*_SCOPE, "pivot", "part").applyInArrow(pack, kinds)
    return packed.withColumn("block", F.monotonically_increasing_id())


def _types(vectors: DataFrame) -> str:
    return ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in _SCOPE)


def _block_schema(table: pa.Table) -> list[tuple]:
    more = [("centroid", pa.list_(pa.float64())), ("radius", pa.float64()), ("keys", pa.list_(pa.int64())), ("ids", pa.list_(pa.string())), ("cells", pa.binary())]
    return [*((c, table.schema.field(c).type) for c in _SCOPE), *more]


def _scored(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, block), (query_id, query) -> query_id, chunk_key, chunk_id, score: the k best of each block."""
    query_type = pairs.schema["query_id"].dataType.simpleString()
    turn = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("query_id")) - 1) / TOGETHER)
    sets = pairs.withColumn("turn", turn).join(asked.select("query_id", "query"), "query_id").groupBy("block", "turn").agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                asked_, keys, ids, cells = (batch.column(c)[at] for c in range(4))
                query_id, query = asked_.values.flatten()
                ids, keys = ids.as_py(), keys.as_py()
                place = np.empty(len(ids), dtype=np.int64)
                place[sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))] = np.arange(len(ids))  # noqa: B023
                i, j, s = _best(query.flatten().to_numpy(zero_copy_only=False).reshape(len(query), -1), np.frombuffer(cells.as_py(), "<f8").reshape(len(ids), -1), place, k)
                columns = [query_id.take(pa.array(i)), pa.array(keys, pa.int64()).take(pa.array(j)), pa.array(ids, pa.string()).take(pa.array(j)), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_key", "chunk_id", "score"])

    return sets.join(blocks.select("block", "keys", "ids", "cells"), "block").select("asked", "keys", "ids", "cells").mapInArrow(run, f"query_id {query_type}, chunk_key long, chunk_id string, score double")


def search(embeddings: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run_id, source_chunk_id, model_name, dimension, vector), (run_id, source_chunk_id, chunk_id, ...), (query_id, run_id, model_name, query) ->
    results (query_id, rank, score, run_id, model_name and the chunk's columns), outcomes (query_id, outcome, total_retrieved), and the
    pairs (query_id, block) that were scored."""
    checkpoint_dir(embeddings.sparkSession)
    own = chunks.withColumn("chunk_key", F.monotonically_increasing_id()).checkpoint()
    whole = embeddings.filter("vector is not null").withColumn("vector", F.transform("vector", lambda v: v.cast("double")))
    vectors = whole.join(own.select("run_id", "source_chunk_id", "chunk_key", "chunk_id"), ["run_id", "source_chunk_id"]).filter(F.size("vector") == F.col("dimension"))
    blocks = _blocks(vectors.select(*_SCOPE, "chunk_key", "chunk_id", "vector")).checkpoint()
    asked = queries.filter("query is not null").select("query_id", "run_id", "model_name", F.size("query").alias("dimension"), F.transform("query", lambda v: v.cast("double")).alias("query"))
    length = F.sqrt(F.aggregate("query", F.lit(0.0), lambda a, v: a + v * v))
    unit = F.transform("query", lambda v: F.when(length > 0, v / F.nullif(length, F.lit(0.0))).otherwise(0.0))
    away = F.sqrt(F.aggregate(F.zip_with("unit", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
    near = F.greatest(F.lit(0.0), away - F.col("radius") - _SLACK)
    bounds = asked.withColumn("unit", unit).join(blocks.select(*_SCOPE, "block", "centroid", "radius"), list(_SCOPE)).select("query_id", "block", (1 - near * near / 2).alias("bound")).checkpoint()
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
    first = bounds.withColumn("turn", turn).filter("turn = 1").select("query_id", "block")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id", "chunk_key"))
    best = _scored(first, asked, blocks, k).withColumn("rank", rank).filter(F.col("rank") <= k).checkpoint()
    least = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") + _SLACK >= F.col("least"))).join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").select("query_id", "block").checkpoint()
    best = best.drop("rank").unionByName(_scored(rest, asked, blocks, k)).withColumn("rank", rank).filter(F.col("rank") <= k)
    shown = best.drop("chunk_id").join(own, "chunk_key").join(queries.select("query_id", "model_name"), "query_id").drop("chunk_key").withColumn("score", F.round("score", 4))

    has = lambda rows, name: rows.groupBy("run_id").agg(F.count("*").alias(name))
    counts = queries.select("query_id", "run_id").join(has(own, "chunks"), "run_id", "left").join(has(whole, "vectors"), "run_id", "left")
    counts = counts.join(best.groupBy("query_id").agg(F.count("*").alias("total_retrieved")), "query_id", "left").fillna(0, ["chunks", "vectors", "total_retrieved"])
    outcome = F.when(F.col("total_retrieved") > 0, "hits").when(F.col("vectors") > 0, "mismatch").when(F.col("chunks") > 0, "unavailable").otherwise("empty")
    return shown, counts.select("query_id", "run_id", outcome.alias("outcome"), "total_retrieved"), first.select("query_id", "block").unionByName(rest.select("query_id", "block"))
