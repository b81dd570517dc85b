"""Best-fit packing into fixed-length sequences by non-negative least squares over length patterns.

1. Texts become pieces of at most ``capacity`` tokens; only texts that are longer are cut.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver.
3. Patterns of two or three lengths that fill a sequence exactly are enumerated; non-negative least squares fits how
   often each repeats to the histogram, and the counts are rounded without using a length more often than there is.
4. What is left is packed by best fit, longest first, on counts: equal bins move together, so the cost depends on the number of lengths.
5. The plan says which ranks of each length go to which sequence and offset. Pieces get a rank among those of equal length,
   counted in two steps so that a frequent length is spread over as many tasks as it needs, and look their place up in the plan.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows are texts of their own; equal
pieces take their places in any order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import few, materialize
from lodestrata.llm.tokens import CACHE_BYTES, default_path, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked in one group, about.
GROUP_PIECES = 100_000
#: One in so many of the three-length patterns is tried, with every length as the smallest and as the middle one.
TRIPLE_STEP = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, text) -> a row for each piece; with ``keep_ids`` also ``ids``, little-endian unsigned 32-bit. A worker keeps two
    generations of ``cache_bytes`` of words."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, cache_bytes), np.array([END_ID], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cols: list[list] = [[], [], [], [], [], []]
                for doc_id, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    raw += end
                    for k, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[begin : begin + 4 * capacity]
                        for col, v in zip(cols, (doc_id, k, begin // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=True):
                            col.append(v)
                n = 6 if keep_ids else 5
                arrays = [pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names[:n])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + ", ids binary" * keep_ids)


def _patterns(capacity: int, step: int = TRIPLE_STEP) -> np.ndarray:
    """Rows (a, b, c), a + b + c = capacity, a <= b <= c; a is 0 in pairs. Of the triples every ``step``-th is listed."""
    b = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([np.zeros_like(b), b, capacity - b], axis=1)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, capacity // 3 + 1), np.arange(1, capacity // 2 + 1), indexing="ij"))
    c = capacity - a - b
    keep = (b >= a) & (c >= b) & ((b + 5 * a) % step == 0)
    return np.concatenate([pairs, np.stack([a, b, c], axis=1)[keep]])


def nnls(patterns: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x for which the patterns' lengths, each x times, are nearest to ``target`` (indexed by length).

    Accelerated projected gradient; the matrix is never formed, only gathered and summed by index. Entry 0 counts for nothing.
    """
    n = len(target)
    used = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), n) * (np.arange(n) > 0)
    back = lambda r: np.where(patterns > 0, r[patterns], 0).sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(used(v))
        v /= (top := np.linalg.norm(v)) or 1
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - target) / (1.05 * top))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / nt * (new - x), nt
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of counts[length] pieces: [(length -> times in a sequence, number of such sequences)]."""
    room: dict[int, list[list]] = {}  # by room left: groups of equal sequences
    done: list[tuple[dict[int, int], int]] = []

    def put(left: int, pattern: dict[int, int], n: int) -> None:
        if n:
            done.append((pattern, n)) if not left else room.setdefault(left, []).append([pattern, n])

    for length in range(len(counts) - 1, 0, -1):
        n = int(counts[length])
        for left in sorted(k for k in room if k >= length) if n else ():
            fit, groups = left // length, room.pop(left)
            while groups and n:
                pattern, k = groups.pop()
                whole = min(k, n // fit)
                put(left - fit * length, pattern | {length: pattern.get(length, 0) + fit}, whole)
                n, k = n - whole * fit, k - whole
                if k and n:  # fewer than would fit are left: they share one sequence
                    put(left - n * length, pattern | {length: pattern.get(length, 0) + n}, 1)
                    n, k = 0, k - 1
                put(left, pattern, k)
            if groups:
                room.setdefault(left, []).extend(groups)
            if not n:
                break
        fit = capacity // length
        put(capacity - fit * length, {length: fit}, n // fit)
        if n % fit:
            put(capacity - n % fit * length, {length: n % fit}, 1)
    return done + [(p, n) for groups in room.values() for p, n in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """counts[length] pieces of each length -> [(length -> times in a sequence, number of such sequences)]."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = _patterns(capacity)
    x = nnls(patterns, left.astype(float))
    order = np.lexsort((patterns[:, 1], patterns[:, 2]))
    total = np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64)
    times = np.diff(total, prepend=0)  # rounded so that what one pattern loses its neighbour gets
    for k in np.flatnonzero(times):
        need = dict(zip(*np.unique(patterns[order[k]][patterns[order[k]] > 0], return_counts=True), strict=True))
        n = min(int(times[k]), *(int(left[m]) // int(c) for m, c in need.items()))
        if n:
            out.append(({int(m): int(c) for m, c in need.items()}, n))
            for m, c in need.items():
                left[m] -= n * c
    return out + best_fit(left, capacity)


def _places(planned: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length and run of ranks: its first rank, pieces a sequence, first sequence, offset; sorted by length and rank."""
    rows, next_rank, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, n in planned:
        offset = 0
        for length, c in pattern.items():
            rows.append((length, next_rank[length], c, sequence, offset))
            next_rank[length] += n * c
            offset += length * c
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (written, as they are read twice) -> those with ``sequence_id`` and ``offset``."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    where = _places(plan(counts, capacity), capacity)
    names = [*pieces.columns, "sequence_id", "offset"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(where["length"], np.arange(capacity + 2))
        shift = np.int64(1) << 44  # ranks are below it: one sorted key of length and rank
        keys = where["length"] * shift + where["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            k = np.searchsorted(keys, length * shift + rank, side="right") - 1
            assert not len(k) or (k >= begin[length]).all()
            i, each = rank - where["rank"][k], where["each"][k]
            found = [where["sequence"][k] + i // each, where["offset"][k] + i % each * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names[:-2]), *map(pa.array, found)], names)

    # pieces of one length are dealt to as many groups as their number needs
    groups = F.array(*[F.lit(max(1, -(-int(n) // GROUP_PIECES))) for n in counts])
    hashed = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(groups, F.col("length").cast("int")))
    rows = pieces.withColumn("_group", hashed.cast("int"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_group").agg(F.count("*").alias("_n"))  # a row for each group
    starts = starts.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_k", F.row_number().over(inside)).join(few(materialize(pieces.sparkSession, starts, "pack-starts")), ["length", "_group"])
    ranked = ranked.select(*pieces.columns, (F.col("_start") + F.col("_k") - 1).cast("long").alias("_rank"))
    return ranked.mapInArrow(look_up, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, text) -> pieces with their places."""
    return place(materialize(docs.sparkSession, pieces(docs, capacity, path, keep_ids, cache_bytes), "pieces"), capacity)
