"""Embedding near-duplicates: an exact cosine join by subspace pigeonhole.

Unit vectors with cosine >= t differ by a squared distance of at most 2 (1 - t). A fixed random rotation spreads
that over all dimensions; the rotated vectors are cut into blocks of ``BLOCK_DIMS`` dimensions, and each block gets a budget
in proportion to its dimensions. If a pair keeps the whole budget it keeps that of at least one block, so the union of
the range joins in all blocks has every pair.

Vectors are packed into parts of about ``PART``, and each two parts meet in one task, which reads them where they are written. What is written and shuffled
so follows the number of vectors; a copy for each box that a vector reaches would take a hundred times its size at 600,000 vectors. Within two parts
a block's range join cuts its dimensions into boxes by a k-d tree, so that a part has about ``LEAF`` vectors in a box. The cuts are medians of a sample
of at most about ``SAMPLE`` vectors; they decide where vectors meet, never whether. A vector is at home in its box, and those of the other part that the
budget lets reach that box are compared with it. The block's squared distances (a matrix product) pick candidates, a candidate is taken up in the first
block whose budget it keeps and in no other, and its cosine is computed in double precision. What leaves a task is a link count for each vector and a
spanning forest of the links, never the pairs. The number of tasks' pairs of parts grows with the square of the vectors: 741 at 600,000.

Equal vectors are one class with a weight. Defined results: null, empty or zero vectors and vectors with null or non-finite
components link with nothing; vectors of different length don't link; rows that repeat a vec_id are vectors of their own, which bear one id;
a row without a vec_id takes part, isn't kept and counts after all ids, so a component of such rows alone has a null component_id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, few, materialize
from lodestrata.llm.graph import components

THRESHOLD = 0.95
BLOCK_DIMS = 8
#: Classes of a part and of its share of a box (about), classes in the sample (about), the most cuts on the way to a box, and groups of parts that tasks pair.
PART, LEAF, SAMPLE, MOST_DEPTH, SPREAD = 16_384, 128, 32_768, 14, 24
_SLACK = 1e-9


@cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_200_101).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, threshold: float) -> list[tuple[slice, float]]:
    """Each block's dimensions and its budget of squared distance."""
    whole = 2 * (1 - threshold) + _SLACK
    return [(slice(b, min(b + BLOCK_DIMS, dims)), whole * (min(b + BLOCK_DIMS, dims) - b) / dims) for b in range(0, dims, BLOCK_DIMS)]


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component, so that no square under- or overflows."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(column: pa.Array) -> tuple[list, list, list]:
    """For each vector of an array of lists of doubles: key, bytes and length; all None if it links with nothing."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)  # null lists hold none
    begin = np.cumsum(n) - n
    keys, raws, dims = ([None] * len(n) for _ in range(3))
    for size in np.unique(n[n > 0]).tolist():
        where = np.flatnonzero(n == size)
        x = values[begin[where][:, None] + np.arange(size)] + 0.0  # -0.0 becomes 0.0
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        where, x = where[good], x[good]
        with np.errstate(over="ignore", under="ignore"):
            short = x.astype("<f4")
        exact = (short == x).all(axis=1)
        for i, row, brief, fits in zip(where.tolist(), x, short, exact.tolist(), strict=True):
            raw = row.tobytes()
            keys[i], raws[i], dims[i] = hashlib.blake2b(raw, digest_size=16).digest(), brief.tobytes() if fits else raw, size
    return keys, raws, dims


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, key (null: links with nothing), raw (floats if they are exact, else doubles), dims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, dims = _keys(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "key", "raw", "dims"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, key binary, raw binary, dims int")


def _doubles(raws: list[bytes], dims: int) -> np.ndarray:
    """Rows of vectors that are kept as floats or doubles."""
    if len({len(r) for r in raws}) == 1:
        return np.frombuffer(b"".join(raws), "<f4" if len(raws[0]) == 4 * dims else "<f8").reshape(-1, dims).astype(float)
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dims else "<f8").astype(float) for r in raws])


class Tree:
    """Boxes of a space by medians of a sample: node k has the children 2 k + 1 (below the cut) and 2 k + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        nodes = 2**depth - 1
        self.depth, self.dim, self.at = depth, np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
        rows = {0: np.arange(len(sample))}
        for k in range(nodes):
            own = rows.pop(k)
            if len(own):
                spread = sample[own].std(axis=0)
                self.dim[k] = spread.argmax()
                self.at[k] = np.median(sample[own, self.dim[k]])
            low = sample[own, self.dim[k]] < self.at[k]
            rows[2 * k + 1], rows[2 * k + 2] = own[low], own[~low]

    def home(self, x: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[every, self.dim[node]] >= self.at[node])
        return node

    def reach(self, x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) of all boxes within a squared distance of ``budget``."""
        row, node, away = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros_like(x)
        for _ in range(self.depth):
            every, dim = np.arange(len(row)), self.dim[node]
            beyond = x[row, dim] - self.at[node]
            below, above = away, away.copy()
            below[every, dim] = np.maximum(below[every, dim], beyond)
            above[every, dim] = np.maximum(above[every, dim], -beyond)
            row, node, away = np.concatenate([row, row]), np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([below, above])
            near = (away * away).sum(axis=1) <= budget * (1 + _SLACK)
            row, node, away = row[near], node[near], away[near]
        return row, node


def _trees(classes: DataFrame, threshold: float, leaf: int, part: int) -> dict[int, list[Tree]]:
    """For each length of vectors in a bounded sample, a tree for each block."""
    n = classes.count()
    depth = 0
    while min(n, part) > leaf * 2**depth and depth < MOST_DEPTH:
        depth += 1
    if not depth:
        return {}
    share = min(1.0, SAMPLE / n) * 1_000_000
    sample = classes.filter(F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(1_000_000)) < share).select("raw", "dims").collect()
    out = {}
    for size in {r["dims"] for r in sample}:
        y = unit(_doubles([r["raw"] for r in sample if r["dims"] == size], size)) @ rotation(size)
        out[size] = [Tree(y[:, dims], depth) for dims, _ in blocks(size, threshold)]
    return out


def _packs(classes: DataFrame, part: int) -> DataFrame:
    """(class_id, weight, raw, dims) -> a row for each part of about ``part`` classes of one length: dims, own, ids, weights and cells (floats if they are exact)."""
    sizes = classes.groupBy("dims").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = classes.join(few(sizes), "dims").withColumn("own", F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("parts")).cast("int"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        raw = _doubles(rows["raw"].to_pylist(), key[0].as_py())
        with np.errstate(over="ignore", under="ignore"):
            short = raw.astype("<f4")
        cells = short if (short == raw).all() else raw
        values = [key[0], key[1], *(pa.scalar(x.tobytes(), pa.binary()) for x in (rows["class_id"].to_numpy(), rows["weight"].to_numpy(), cells))]
        return pa.table([pa.array([v.as_py()], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["dims", "own", "ids", "weights", "cells"])

    return dealt.select("dims", "own", "class_id", "weight", "raw").groupBy("dims", "own").applyInArrow(pack, "dims int, own int, ids binary, weights binary, cells binary")


class Part:
    """Vectors of one part, as they are compared."""

    def __init__(self, dims: int, ids: bytes, weights: bytes, cells: bytes):
        self.ids, self.weight = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        self.x = unit(np.frombuffer(cells, "<f4" if len(cells) == 4 * dims * len(self.ids) else "<f8").reshape(-1, dims).astype(float))
        self.y = self.x @ rotation(dims)
        self.reached: dict[int, tuple] = {}

    def reach(self, block: int, tree: Tree, own: slice, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(box, row) of all boxes within reach, by box; kept, as a part is met by many."""
        if block not in self.reached:
            row, box = tree.reach(self.y[:, own], budget)
            order = np.argsort(box, kind="stable")
            self.reached[block] = box[order].astype(np.int32), row[order].astype(np.int32)
        return self.reached[block]


class Forest:
    """Links by position, kept as one label for each component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def links_of(left: Part, right: Part, same: bool, trees: list[Tree] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, link counts and labels, by position, of the links between two parts, or within one (``same``).

    A pair meets in the home box of the right one, which the left one reaches in the first block whose budget the pair keeps.
    """
    ids, weight, shift = (left.ids, left.weight, 0) if same else (np.concatenate([left.ids, right.ids]), np.concatenate([left.weight, right.weight]), len(left.ids))
    cut = blocks(left.x.shape[1], threshold)
    count, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
    for block, (own, budget) in enumerate(cut):
        tree = trees[block] if trees else Tree(right.y[:, own], 0)
        box, row = left.reach(block, tree, own, budget)
        home = tree.home(right.y[:, own])
        order = np.argsort(home, kind="stable")
        u, v = (np.ascontiguousarray(p.y[:, own], dtype=np.float32) for p in (left, right))
        half = lambda z: (z * z).sum(axis=1, keepdims=True) / 2
        one = lambda z: np.ones((len(z), 1), dtype=np.float32)
        a_side, b_side = np.hstack([u, one(u), half(u)]), np.hstack([v, -half(v), -one(v)])  # their product is minus half the squared distance
        for here in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            guests = row[slice(*np.searchsorted(box, [home[here[0]], home[here[0]] + 1]))]
            across = np.ascontiguousarray(a_side[guests].T)
            for k in range(0, len(here), 256):
                some = here[k : k + 256]
                q, p = np.divmod(np.flatnonzero(b_side[some] @ across >= -budget / 2 - 1e-5), max(1, len(guests)))
                p, q = guests[p], some[q]
                if same:
                    p, q = p[p < q], q[p < q]
                for c in range(0, len(p), 65_536):
                    a, b = p[c : c + 65_536], q[c : c + 65_536]
                    d = (left.y[a] - right.y[b]) ** 2
                    inside = np.stack([d[:, dims].sum(axis=1) <= most for dims, most in cut], axis=1)
                    keep = inside.any(axis=1) & (inside.argmax(axis=1) == block) & ((left.x[a] * right.x[b]).sum(axis=1) >= threshold) & (left.ids[a] != right.ids[b])
                    a, b = a[keep], b[keep] + shift
                    np.add.at(count, a, weight[b])
                    np.add.at(count, b, weight[a])
                    forest.add(a, b)
    return ids, count, forest.label


def _linked(packs: DataFrame, trees: dict[int, list[Tree]], threshold: float) -> DataFrame:
    """Written parts -> (a, n, b): a has n links here, and is linked (by way of others) with b if that isn't null.

    Each two parts of one length meet once, in a product of their rows: tasks read parts, and no vector is copied for a box or another part.
    """
    held = packs.sparkSession.sparkContext.broadcast(trees)  # 2^MOST_DEPTH cuts a block and length
    spread = packs.repartition(max(1, min(SPREAD, packs.count())))
    a, b = (spread.toDF(*[f"{c}_{side}" for c in packs.columns]) for side in "ab")
    pairs = a.join(b, (F.col("dims_a") - F.col("dims_b") == 0) & (F.col("own_a") <= F.col("own_b")))  # no key to shuffle by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                dims, own_a, ids_a, weights_a, cells_a, _, own_b, ids_b, weights_b, cells_b = (batch.column(c)[k].as_py() for c in range(10))
                if (dims, own_a) != key:
                    key, left = (dims, own_a), Part(dims, ids_a, weights_a, cells_a)
                right = left if own_a == own_b else Part(dims, ids_b, weights_b, cells_b)
                ids, count, label = links_of(left, right, right is left, held.value.get(dims), threshold)
                hit = np.flatnonzero(count)
                if len(hit):
                    to = ids[label[hit]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(to, mask=to == ids[hit])], ["a", "n", "b"])

    return pairs.mapInArrow(run, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """(vec_id, embedding) -> vec_id, class_id, n_links, component_id, kept, a row for each vector."""
    spark = vectors.sparkSession
    rows = materialize(spark, _classes(vectors), "vectors")
    # one id may stand for two vectors, so classes are numbered by their keys' hash; ids come back at the end
    sums = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("raw").alias("raw"), F.first("dims").alias("dims"))
    sums = materialize(spark, sums.select("key", F.xxhash64("key").alias("class_id"), "first_id", "weight", "raw", "dims"), "vector-classes")
    classes = sums.select("class_id", "weight", "raw", "dims")
    packs = materialize(spark, _packs(classes, part), "vector-parts")
    found = materialize(spark, _linked(packs, _trees(classes, threshold, leaf, part), threshold), "vector-links")
    discard(packs)
    others = found.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("_others"))
    named = components(found.filter("b is not null").select("a", "b"))
    known = sums.select("key", "first_id", "weight", F.col("class_id").alias("c")).join(others, "c", "left")
    known = known.join(named.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "component").select("key", "first_id", "component_id", (F.col("weight") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("first_id", "vec_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
