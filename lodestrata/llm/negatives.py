"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers get one more component, sqrt(M^2 - |x|^2) with M the largest length, so that all lie on a sphere and the inner
product with an anchor falls as the distance from it grows: d^2 = |q|^2 + M^2 - 2 q x. Every vector belongs to its nearest pivot, and the
pair (pivot, distance from it) is its key. The store is sorted by (length, label, pivot, distance) and packed into cells of
up to ``CELL_BYTES``, which don't cross a label, a pivot or a ring; rings are quantiles of the distances of a pivot.

By the triangle inequality a vector within r of an anchor, which is at D from a pivot, has a key between D - r and D + r. An anchor
scans rings in the order of the least distance that they allow: first those that its own key falls into, then wider and wider annuli,
``FIRST`` rings and four times as many in each next round. It is done when the remaining bound - the least distance that the next ring allows -
is beyond its k-th best. Positives are searched for in the cells of the anchor's label, negatives in those of all others; a negative's score is
between 80 and 100 percent of the positive's, so its annulus has an inner and an outer bound from the start.

Pivots and ring bounds are fitted on a sample of ``SAMPLE`` vectors a pivot, and decide what is read when, never what is found: scores are
whole numbers, compared exactly, and every vector is in a cell. With n vectors and cells of c, there are about sqrt(n / c) pivots and as many
rings of each, so the model has a number for every cell and grows as slowly as the list of cells does.

Anchors travel in blocks of up to ``QUERIES`` of one label to the cells of a ring, and meet a cell in one matrix product; what leaves
a task is the best few of each anchor (and positive), never pairs.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; components are kept between
-2^24 and 2^24 after they have been multiplied by 256; vectors of different length don't meet, empty ones meet with a score of 0; a row
without a vec_id is no anchor and counts after all ids among equal scores; rows that repeat a vec_id are rows of their own; a negative score of a
positive allows no negative; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize

#: Positives of an anchor, negatives of a positive, and the least and the largest percentage of its score that a negative has.
TOP, LEAST, MOST = 5, 80, 100
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
#: Bytes of a cell's vectors (about), sampled vectors for each pivot, rings of the first round, growth, and anchors of a block.
CELL_BYTES, SAMPLE, FIRST, GROWTH, QUERIES = 1 << 20, 64, 8, 4, 256
LARGEST = 1 << 24
_NO_ID = np.iinfo(np.int64).max
_SLACK = 1e-7


def _whole(column: pa.Array) -> tuple[list, list, list]:
    """For each vector of an array of lists of doubles: whole numbers as bytes, squared length and length; None if it takes no part."""
    lists = pc.list_value_length(column)
    n = pc.fill_null(lists, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
    begin = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    raws, squares, dims = ([None] * len(n) for _ in range(3))
    for size in np.unique(n[n >= 0]).tolist():
        where = np.flatnonzero(n == size)
        x = values[begin[where][:, None] + np.arange(size)].reshape(len(where), size)
        good = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            y = np.clip(np.floor(x[good] * 256), -LARGEST, LARGEST).astype("<i4")
        for i, row in zip(where[good].tolist(), y, strict=True):
            raws[i], squares[i], dims[i] = row.tobytes(), int((row.astype(np.int64) ** 2).sum()), size
    return raws, squares, dims


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) -> id (the largest long if there is none), named, label, raw, square, dims of rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, squares, dims = _whole(batch.column(2))
            out = [batch.column(0), batch.column(1), pa.array(raws, pa.binary()), pa.array(squares, pa.int64()), pa.array(dims, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "raw", "square", "dims"])

    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"), F.col("embedding").cast("array<double>")).filter("label is not null")
    rows = rows.mapInArrow(run, "vec_id long, label long, raw binary, square long, dims int").filter("raw is not null")
    return rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("id"), F.col("vec_id").isNotNull().alias("named"), "label", "raw", "square", "dims")


def _numbers(raws: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<i4").reshape(len(raws), dims)


@dataclass
class Keys:
    """Pivots of vectors of one length, the bounds of each pivot's rings, and the largest squared length."""

    top: int
    pivots: np.ndarray
    rings: np.ndarray  # of each pivot: 0, inner bounds, infinity

    def augmented(self, x: np.ndarray, square: np.ndarray) -> np.ndarray:
        return np.hstack([x.astype(float), np.sqrt(np.maximum(0.0, self.top - square.astype(float)))[:, None]])

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Of each row from each pivot."""
        return np.sqrt(np.maximum(0.0, (y * y).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * (y @ self.pivots.T)))

    def place(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, distance and ring of each row."""
        d = self.distances(y)
        pivot = d.argmin(axis=1)
        away = d[np.arange(len(y)), pivot]
        ring = np.array([np.searchsorted(self.rings[p], r, side="right") - 1 for p, r in zip(pivot, away, strict=True)], dtype=np.int64)
        return pivot, away, np.minimum(ring, self.rings.shape[1] - 2)

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivots, rings, least distances) of an anchor, which is no part of the sphere: rings as it scans them."""
        d = self.distances(q[None])[0][:, None]
        least = np.maximum(0.0, np.maximum(self.rings[:, :-1] - d, d - self.rings[:, 1:]))
        turn = np.argsort(least, axis=None, kind="stable")
        return *np.divmod(turn, least.shape[1]), least.ravel()[turn]


def fit(spark: SparkSession, rows: DataFrame, cell_bytes: int) -> dict[int, Keys]:
    """For each length of vectors, keys from a bounded sample of ``rows``, which are written."""
    out = {}
    for size, n, top in rows.groupBy("dims").agg(F.count("*"), F.max("square")).sort("dims").collect():
        many = max(1, math.ceil(math.sqrt(n / _cell_rows(size, cell_bytes))))
        share = min(1.0, 2 * SAMPLE * many / n) * 1_000_000
        sample = rows.filter((F.col("dims") == size) & (F.pmod(F.xxhash64("id", "raw", F.lit(11)), F.lit(1_000_000)) < share)).select("raw", "square").limit(4 * SAMPLE * many).collect()
        sample.sort()
        keys = Keys(top, np.zeros((1, size + 1)), np.array([[0.0, np.inf]]))
        if many > 1 and len(sample) > many:
            y = keys.augmented(_numbers([r["raw"] for r in sample], size), np.array([r["square"] for r in sample]))
            keys.pivots = y[np.random.default_rng(11).permutation(len(y))[:many]]
            for _ in range(4):  # means of what is nearest
                near = keys.distances(y).argmin(axis=1)
                keys.pivots = np.array([y[near == p].mean(axis=0) if (near == p).any() else keys.pivots[p] for p in range(len(keys.pivots))])
            d = keys.distances(y)
            near, every = d.argmin(axis=1), np.linspace(0, 1, many + 1)[1:-1]
            inner = [np.quantile(d[near == p, p] if (near == p).any() else d[:, p], every) for p in range(len(keys.pivots))]
            keys.rings = np.hstack([np.zeros((len(inner), 1)), np.array(inner).reshape(len(inner), -1), np.full((len(inner), 1), np.inf)])
        out[size] = keys
    return out


def _cell_rows(dims: int, cell_bytes: int) -> int:
    return max(1, cell_bytes // (4 * dims + 16))


_CELL = "dims int, pivot int, ring int, label long, uids binary, ids binary, square long, cell binary"


def _store(rows: DataFrame, held, cell_bytes: int) -> DataFrame:
    """The store: rows sorted by (dims, label, pivot, distance), packed into cells."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(5).to_numpy()
            for size in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == size)))
                keys = held.value[size]
                pivot, away, ring = keys.place(keys.augmented(_numbers(part.column(3).to_pylist(), size), part.column(4).to_numpy()))
                more = [pa.array(pivot.astype(np.int32)), pa.array(away), pa.array(ring.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "pivot", "away", "ring"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            key = np.stack([batch.column(c).to_numpy() for c in ("dims", "label", "pivot", "ring")], axis=1)
            begin = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for b, e in zip(begin, begin[1:], strict=False):
                most = _cell_rows(int(key[b, 0]), cell_bytes)
                while e - b >= most or b < e < batch.num_rows:
                    yield cell(batch.slice(b, min(most, e - b)))
                    b += min(most, e - b)
                rest = batch.slice(b, e - b) if e == batch.num_rows and b < e else None
        if rest is not None:
            yield cell(rest)

    def cell(part: pa.RecordBatch) -> pa.RecordBatch:
        first = {c: part.column(c)[0].as_py() for c in ("dims", "pivot", "ring", "label")}
        own = [b"".join(part.column("raw").to_pylist())]
        ids = [part.column(c).to_numpy().astype("<i8").tobytes() for c in ("uid", "id")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        values = [*first.values(), *ids, pc.max(part.column("square")).as_py(), own[0]]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [*first, "uids", "ids", "square", "cell"])

    schema = "uid long, id long, label long, raw binary, square long, dims int"
    rows = rows.select("uid", "id", "label", "raw", "square", "dims").mapInArrow(keyed, f"{schema}, pivot int, away double, ring int")
    order = ["dims", "label", "pivot", "away", "uid"]  # the last divides equal vectors
    rows = materialize(rows.sparkSession, rows, "negatives-keyed")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, _CELL)


def scores(x: np.ndarray, y: np.ndarray, x_square: int, y_square: int) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these hold them, which the lengths tell."""
    if x_square * y_square < 1 << 100:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of ``allowed``: higher scores, then smaller ids."""
    at = np.flatnonzero(allowed)
    if len(at) > 4 * top:  # only those that reach the top-th score
        at = at[score[at] >= np.partition(score[at], len(at) - top)[len(at) - top]]
    return at[np.lexsort((ids[at], -score[at]))[:top]]


#: An open question of an anchor: its vector, and for each positive (one without a limit while positives are sought) the score allowed at most,
#: the least score that its top has so far (null: not full) and the number of rings scanned.
_ASK = "uid long, dims int, label long, raw binary, square long, done int, most array<long>, kth array<long>"
_FOUND = "uid long, part int, score long, id long, other long"


def _asked(open_: DataFrame, held) -> DataFrame:
    """Open questions -> blocks of anchors for the rings that each scans now: (dims, pivot, ring, label, block of anchors)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = held.value[row["dims"]]
                pivots, rings, least = keys.order(np.append(_numbers([row["raw"]], row["dims"])[0].astype(float), 0.0))
                end = upto(row["done"], len(least))
                now = slice(row["done"], min(end, int(np.searchsorted(least, reach(row, keys.top), side="right"))))
                k = len(pivots[now])
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["dims"]] * k, pa.int32()), pa.array(pivots[now].astype(np.int32)), pa.array(rings[now].astype(np.int32)), pa.array([row["label"]] * k, pa.int64()),
                         pa.array([row["uid"]] * k, pa.int64()), pa.array([row["raw"]] * k, pa.binary()), pa.array([row["square"]] * k, pa.int64()), pa.array([row["most"]] * k, pa.list_(pa.int64()))],
                        ["dims", "pivot", "ring", "label", "uid", "raw", "square", "most"],
                    )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            key = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            begin = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for b, e in zip(begin, begin[1:], strict=False):
                while e - b >= QUERIES or b < e < batch.num_rows:
                    yield one(batch.slice(b, min(QUERIES, e - b)))
                    b += min(QUERIES, e - b)
                rest = batch.slice(b, e - b) if e == batch.num_rows and b < e else None
        if rest is not None:
            yield one(rest)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        values = [part.column(c)[0].as_py() for c in range(4)]
        values += [part.column(4).to_pylist(), b"".join(part.column(5).to_pylist()), pc.max(part.column(6)).as_py(), part.column(7).to_pylist()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["q_dims", "q_pivot", "q_ring", "q_label", "anchors", "q", "q_square", "most"])

    key = ["dims", "pivot", "ring", "label"]
    rows = open_.mapInArrow(spread, "dims int, pivot int, ring int, label long, uid long, raw binary, square long, most array<long>")
    rows = rows.repartition(*key, F.pmod(F.xxhash64("uid"), F.lit(64))).sortWithinPartitions(*key, "uid")
    return rows.mapInArrow(block, "q_dims int, q_pivot int, q_ring int, q_label long, anchors array<long>, q binary, q_square long, most array<array<long>>")


def upto(done: int, rings: int) -> int:
    """Rings that are scanned after the next round."""
    return min(rings, max(FIRST, done * GROWTH))


def distance(score: float, square: int, top: int) -> float:
    """Of a vector with this score from an anchor of squared length ``square``."""
    return math.sqrt(max(0.0, square + top - 2.0 * score))


def reach(row: dict, top: int) -> float:
    """The distance up to which a ring can still matter to an open question; a little more, for rounding."""
    most = [
        math.inf if limit is None and kth is None else distance(max(-(-LEAST * limit // 100) if limit is not None else -math.inf, kth if kth is not None else -math.inf), row["square"], top)
        for limit, kth in zip(row["most"], row["kth"], strict=True)
    ]
    return max(most) * (1 + _SLACK) + _SLACK


def _scanned(blocks: DataFrame, store: DataFrame, positives: bool) -> DataFrame:
    """Blocks of anchors against the cells of their rings -> the best few of each anchor and part in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, anchors = row["dims"], row["anchors"]
                uids, ids = (np.frombuffer(row[c], "<i8") for c in ("uids", "ids"))
                x = np.frombuffer(row["cell"], "<i4").reshape(len(ids), size)
                score = scores(np.frombuffer(row["q"], "<i4").reshape(len(anchors), size), x, row["q_square"], row["square"])
                out = []
                for anchor, most, own in zip(anchors, row["most"], score, strict=True):
                    for part, limit in enumerate(most):
                        allowed = uids != anchor if limit is None else (own <= limit * MOST // 100) & (own >= -(-LEAST * limit // 100))
                        at = best_of(own, ids, allowed, TOP)
                        out += [(anchor, part, int(own[k]), int(ids[k]), int(uids[k])) for k in at.tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["uid", "part", "score", "id", "other"])

    same = F.col("label") == F.col("q_label") if positives else F.col("label") != F.col("q_label")
    met = blocks.join(store, (F.col("dims") == F.col("q_dims")) & (F.col("pivot") == F.col("q_pivot")) & (F.col("ring") == F.col("q_ring")) & same)
    return met.select("dims", "anchors", "q", "q_square", "most", "uids", "ids", "square", "cell").mapInArrow(run, _FOUND)


def _searched(open_: DataFrame, store: DataFrame, held, positives: bool) -> DataFrame:
    """Open questions -> uid, part, rank, score, id, other: the best ``TOP`` of each part. Rounds end when no question is open."""
    spark, rings = store.sparkSession, max((k.rings.shape[0] * (k.rings.shape[1] - 1) for k in held.value.values()), default=0)
    best, done = None, 0
    rank = F.row_number().over(Window.partitionBy("uid", "part").orderBy(F.desc("score"), "id", "other"))
    while done < rings:
        found = _scanned(_asked(open_, held), store, positives)
        found = found if best is None else found.unionByName(best)
        best = materialize(spark, found.withColumn("rank", rank).filter(F.col("rank") <= TOP).drop("rank"), "negatives-best")
        done = upto(done, rings)
        if done < rings:
            full = best.groupBy("uid", "part").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == TOP)
            full = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("part", "kth"))).alias("full"))  # TOP parts at most
            kth = F.transform("most", lambda _, k: F.element_at("full", k.cast("int")))
            open_ = open_.drop("kth").join(full, "uid", "left").select("uid", "dims", "label", "raw", "square", F.lit(done).alias("done"), "most", kth.alias("kth"))
            open_ = materialize(spark, _still_open(open_, held), "negatives-open")
            if open_.isEmpty():
                break
    if best is None:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    return best.withColumn("rank", rank)


def _still_open(open_: DataFrame, held) -> DataFrame:
    """Questions whose next ring is not beyond their reach: the others are certified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                keys = held.value[row["dims"]]
                least = keys.order(np.append(_numbers([row["raw"]], row["dims"])[0].astype(float), 0.0))[2]
                keep.append(row["done"] < len(least) and least[row["done"]] <= reach(row, keys.top))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return open_.mapInArrow(run, _ASK)


def mine(vectors: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = materialize(spark, _rows(vectors).select(F.monotonically_increasing_id().alias("uid"), "*"), "negatives-rows")
    held = spark.sparkContext.broadcast(fit(spark, rows, cell_bytes))
    store = materialize(spark, _store(rows, held, cell_bytes), "negatives-store")
    anchors = rows.filter(F.col("named") & (F.col("id") % ANCHOR_EVERY == 0))
    nothing = F.array(F.lit(None).cast("long"))
    asked = anchors.select("uid", "dims", "label", "raw", "square", F.lit(0).alias("done"), nothing.alias("most"), nothing.alias("kth"))
    positives = _searched(materialize(spark, asked, "negatives-anchors"), store, held, True)
    positives = materialize(spark, positives.filter("score >= 0").select("uid", F.col("rank").alias("part"), F.col("id").alias("positive"), F.col("score").alias("limit")), "negatives-positives")
    limits = positives.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "limit"))), lambda p: p["limit"]).alias("most"))  # TOP at most
    asked = anchors.join(limits, "uid").select("uid", "dims", "label", "raw", "square", F.lit(0).alias("done"), "most", F.transform("most", lambda _: F.lit(None).cast("long")).alias("kth"))
    negatives = _searched(materialize(spark, asked, "negatives-limits"), store, held, False).withColumn("part", F.col("part") + 1)
    found = negatives.join(positives, ["uid", "part"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    named = {c: F.when(F.col(c) != _NO_ID, F.col(c)) for c in ("positive", "id")}
    return found.select(
        "anchor_id", named["positive"].alias("positive_id"), "rank", named["id"].alias("negative_id"), F.col("limit").alias("positive_score"), F.col("score").alias("negative_score"),
    )
