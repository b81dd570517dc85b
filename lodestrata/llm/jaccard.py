"""Exact n-gram Jaccard join: documents whose shingle sets are alike, by pigeonhole on a partitioned universe.

The universe of hashed shingles is cut into m segments, m fixed by a band of set sizes. Two sets of sizes that can reach
the threshold differ in at most H shingles, and a difference falls into one segment, so at most H of the m segments differ. With
m = H + 1 + slack, more than ``slack`` segments are equal. A set emits one hash for each segment that isn't empty; empty
segments would match everywhere and cost the most, so they get no allocation. A set with at most ``slack`` empty segments (more
exactly: with c > H segments that aren't empty) finds every partner this way. The rest, a few in a hundred, get a
second allocation: each of their segments also emits its one-deletion neighbourhood, which tolerates a difference of one in
each segment, so that half as many segments suffice. Two sets of the rest meet there; otherwise one of the two is enough.

The allocation follows cost. A set with c > H has at least c - H segments in common with any partner, so both may give up
(c - H - 1) // 2 each and still share one. Each gives up those whose groups are the largest.

A size band is 1 / threshold wide, so partners lie in the same band or the next; a set emits under its own band's
scheme and under the one below.

From signatures to components, without all pairs of a group and without losing a link:

1. Documents with one shingle set are one class. Signatures go out once for each class and task; signatures of a single class go at once.
2. Each class is compared with the first class of the groups it shares most with: one pair a class at most. Such pairs are
   gathered in blocks of one leading class, whose set is sent once a block.
3. Verified links give components. A group whose classes are in one component is done, and that is what becomes of groups of near copies.
4. Groups that still span components are gathered by their first class, in blocks of bounded size: classes outside the main component
   of a lead meet all others, those inside meet only the ones outside. Sizes and parity sketches (a sketch keeps the parity of the number
   of shingles in each of its cells, two cells a shingle; sets that differ in d shingles differ in at most d cells) are sent to ``TOGETHER``
   blocks at a time and leave the pairs of blocks in which some pair across components is open. Only classes of open pairs get their whole
   sets, for those pairs of blocks, and are compared where they are; what leaves a task is a link where it joins two components, never the pairs.

Sets are compared as sets of 64-bit hashes of shingles, all of them.

Defined results: words are maximal runs of characters other than ASCII white space, A-Z lower-cased; a text of
fewer words than ``n`` is one shingle; no text or no word: an empty set, linked with nothing; repeated rows are documents of
their own; a row without an id takes part and counts after all ids, so a group of such rows alone has a null component_id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import WordIndex, discard, few, materialize, rows_for, words
from lodestrata.llm.graph import components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SKETCH = 4  # words of 64 bits
#: Shingles of a lead's classes that a block of pairs takes from each side, about; a class counts for ``LEAST_COST`` at least.
BLOCK, LEAST_COST = 1_000_000, 500
#: Blocks whose sketches a task compares with those of as many others; a sketch has a thirtieth of a set's bytes, about.
TOGETHER = 8
#: Open pairs of a class that are verified before its component is looked at again.
TURN = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-word shingles. Word hashes are kept in a cache of bounded bytes."""

    def __init__(self, n: int):
        self.n, self.index, self.hashes = n, WordIndex(), np.zeros(4096, dtype=np.uint64)

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for k in range(0, len(texts), 256):
            split = [words(t and t.lower()) for t in texts[k : k + 256]]  # of bytes only A-Z change
            new, begin = self.index.add(split)
            self.hashes = rows_for(self.hashes, begin + len(new))
            self.hashes[begin : begin + len(new)] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))
            for ws in split:
                yield shingle_hashes(self.hashes[self.index.numbers(ws)], self.n)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _A + h[k : len(h) - width + 1 + k])
    return np.unique(out)


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``of`` x intersection >= ``at_least`` x union."""

    at_least: int = 85
    of: int = 100

    def differences(self, total):
        """The most shingles in which two linked sets of ``total`` shingles together can differ."""
        need = -(-self.at_least * total // (self.at_least + self.of))
        return total - 2 * need

    def largest(self, n):
        """The largest set that can link with one of ``n``."""
        return self.of * n // self.at_least


class Schemes:
    """Size bands and the number of segments in each: begin[b] <= size < begin[b + 1], segments[b]."""

    def __init__(self, rule: Rule, top: int = 1 << 40):
        self.rule, self.begin = rule, [1]
        while self.begin[-1] < top:
            self.begin.append(max(self.begin[-1] + 1, rule.largest(self.begin[-1]) + 1))
        self.segments = []
        for end in self.begin[1:]:
            h = self._most(end - 1 + rule.largest(end - 1))
            self.segments.append(h + 1 + self.slack(h))

    def _most(self, total: int) -> int:
        """The most differences of two linked sets of ``total`` shingles together or fewer (rounding makes it jitter)."""
        return max(int(self.rule.differences(t)) for t in range(max(0, total - 25), total + 1))

    @staticmethod
    def slack(h: int) -> int:
        """Segments beyond those that pigeonhole needs. They pay for empty segments, and for what the allocation gives up."""
        return 3 + h // 20 if h else 0

    def of(self, n: int) -> list[int]:
        """The schemes under which a set of ``n`` shingles emits."""
        b = bisect_right(self.begin, n) - 1
        return [b] if not b else [b, b - 1]

    def own_differences(self, n: int, b: int) -> int:
        """The most differences between a set of ``n`` and any partner it meets under scheme b."""
        own = n < self.begin[b + 1]
        return self._most(n + (self.rule.largest(n) if own else self.begin[b + 1] - 1))


def _tagged(hashes: np.ndarray, band: int, kind: int) -> np.ndarray:
    """A set emits under two bands, one of them even: the last two bits tell the band's parity and whether it is a plain segment (0)."""
    return hashes & ~np.uint64(3) | np.uint64((band & 1) | kind << 1)


def signatures(s: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, list[int]]:
    """Hashes that a set emits, of all its schemes, and how many plain segments of an even and an odd band it may give up.
    ``s`` is sorted, so a segment is a run of it."""
    out, spare = [], [0, 0]
    n = len(s)
    for b in schemes.of(n):
        m = schemes.segments[b]
        seg = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        size = np.diff(first, append=n)
        mixed = _mix(s ^ _A)
        content = np.add.reduceat(mixed, first)  # an order-free hash of the segment's shingles
        salt = _mix(np.uint64((b * 2 + 1) * int(_A) % 2**64) + seg[first].astype(np.uint64) * _B)
        out.append(_tagged(_mix(content ^ salt), b, 0))
        h = schemes.own_differences(n, b)
        spare[b & 1] = max(0, (len(first) - h - 1) // 2)
        if len(first) < h + 1:  # too many empty segments: one-deletion neighbourhoods for all others
            salt = _mix(salt + _C)
            out.append(_tagged(_mix(content ^ salt), b, 1))
            wide = np.repeat(size > 1, size)
            out.append(_tagged(_mix((np.repeat(content, size) - mixed)[wide] ^ np.repeat(salt, size)[wide]), b, 1))
            if 2 * int((size > 1).sum()) + int((size == 1).sum()) < h + 1:  # not even those suffice: one common group
                out.append(_tagged(_mix(np.array([b], dtype=np.uint64) ^ _B), b, 1))
    return np.concatenate(out), spare


def _wide_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each of 256 cells or more, about two cells a shingle."""
    cells = 64 * SKETCH
    while cells < min(2 * len(s), 1 << 16):
        cells *= 2
    bits = np.bincount((_mix(s ^ _C) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same sketch over fewer cells."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sketch(s: np.ndarray) -> np.ndarray:
    return _fold(_wide_sketch(s), SKETCH)


def _class(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_SKETCHES = [f"p{k}" for k in range(SKETCH)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text; the key tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _shingled(docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key, n_shingles, class, sketches and, once for each class and task, the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, schemes, seen = Shingler(n), Schemes(rule), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, classes, sketches, wide, sigs, spares = [], [], [], [], [], []
                for s in shingler.sets(part.column(2).cast(pa.binary()).to_pylist()):
                    cls = _class(s.tobytes())
                    counts.append(len(s))
                    classes.append(cls)
                    wide.append(_wide_sketch(s))
                    sketches.append(_fold(wide[-1], SKETCH))
                    own, spare = signatures(s, schemes) if len(s) and cls not in seen else (None, None)
                    sigs.append(None if own is None else own.view(np.int64))
                    spares.append(spare)
                    if own is not None and len(seen) < 200_000:  # a class that is emitted again does no harm
                        seen.add(cls)
                sketch = np.array(sketches, dtype="<u8").reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(classes, pa.int64()), *(_signed(sketch[:, k].copy()) for k in range(SKETCH)),
                        pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(spares, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "class", *_SKETCHES, "sketch", "sigs", "spare"],
                )

    schema = "doc_id long, text_key long, n_shingles long, class long, " + ", ".join(f"{p} long" for p in _SKETCHES) + ", sketch binary, sigs array<long>, spare array<int>"
    return _keyed(docs).mapInArrow(run, schema)


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(class, shingles) of the first documents (class, first_id, first_key) in ``ids``, which is written, from their whole texts.
    Where rows are repeated, a class comes once a task at most."""
    rows, own = _keyed(docs), few(ids)
    rows = rows.join(own, rows["doc_id"].eqNullSafe(own["first_id"]) & (rows["text_key"] == own["first_key"])).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(n), set()
        for batch in batches:
            classes = batch.column(0).to_pylist()
            batch = batch.take(pa.array([k for k, c in enumerate(classes) if c not in seen and not seen.add(c)], pa.int64()))  # rows may be repeated
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s.tobytes() for s in shingler.sets(part.column(1).cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["class", "shingles"])

    return rows.mapInArrow(run, "class long, shingles binary")


def _possible(n_a, n_b, p_a: list, p_b: list, rule: Rule):
    """Whether sizes and sketches (columns) allow a link."""
    total = n_a + n_b
    need = F.ceil(F.lit(rule.at_least) * total / F.lit(rule.at_least + rule.of))
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(p_a, p_b, strict=True)), F.lit(0))
    return (F.least(n_a, n_b) >= need) & (apart <= total - 2 * need)


_KEY = ("lead", "block_a", "block_b")


def _by_block(rows: DataFrame, columns: list[str], one, schema: str) -> DataFrame:
    """Runs ``one`` (columns of a block pair as arrays, whether both sides are one block) on each block pair of ``rows``."""
    rows = rows.select(*_KEY, *columns).repartition(*_KEY).sortWithinPartitions(*_KEY)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if table.num_rows > 1:
            yield from one(table, table["block_a"][0] == table["block_b"][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _KEY]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                now = tuple(int(c[begin]) for c in cols)
                if now != key:
                    yield from whole(held) if held else ()
                    key, held = now, []
                held.append(batch.slice(begin, end - begin))
        yield from whole(held) if held else ()

    return rows.mapInArrow(run, schema)


def _open_pairs(label: np.ndarray, n: np.ndarray, sketch: list[np.ndarray], side: np.ndarray, same: bool, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): pairs of positions across labels whose sizes and sketches allow a link. ``label`` may change meanwhile."""
    least = min(map(len, sketch))
    folded = np.stack([_fold(x, least) for x in sketch])
    every = np.arange(len(sketch))
    left, right = (every, every) if same else (every[side == 0], every[side == 1])
    for x in left.tolist():
        ys = right[label[right] != label[x]]
        if same:
            ys = ys[ys > x]
        total = n[ys] + n[x]
        most = rule.differences(total)
        fits = np.minimum(n[ys], n[x]) * 2 >= total - most
        ys, most = ys[fits], most[fits]
        if len(ys):
            ys = ys[np.bitwise_count(folded[ys] ^ folded[x]).sum(axis=1, dtype=np.int64) <= most]
            if len(ys):
                yield x, ys


def _open(rows: DataFrame, rule: Rule) -> DataFrame:
    """(lead, block_a, block_b, side, class, component, n, block, sketch), of pairs of several blocks -> lead, block_a, block_b (single blocks),
    side, class and component of the classes that have an open pair with a class of the other block."""

    def one(table: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        sketch = [np.frombuffer(x, "<u8") for x in table["sketch"].to_pylist()]
        side, label, n, block = (table[c].to_numpy() for c in ("side", "component", "n", "block"))
        own, place = np.unique(block, return_inverse=True)
        hit = np.zeros((len(n), len(own)), dtype=bool)  # of each class, the blocks in which it has an open pair
        for x, ys in _open_pairs(label, n, sketch, side, same, rule):
            hit[x, place[ys]] = True
            hit[ys, place[x]] = True
        at, other = np.nonzero(hit)
        if len(at):
            mine, theirs, names = block[at], own[other], table["class"].to_numpy()
            out = [np.full(len(at), table["lead"][0].as_py()), np.minimum(mine, theirs), np.maximum(mine, theirs), (mine > theirs).astype(np.int32), names[at], label[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [*_KEY, "side", "class", "component"])

    return _by_block(rows, ["side", "class", "component", "n", "block", "sketch"], one, "lead long, block_a int, block_b int, side int, class long, component long")


def forest(label: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, rule: Rule) -> list[tuple[int, int]]:
    """Links (positions) that join labels until none across labels is left; equal labels are joined already."""
    label, n = label.copy(), np.array(list(map(len, sets)))
    universe, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(place.astype(np.int32), np.cumsum(n)[:-1])
    marked = np.zeros(len(universe), dtype=np.int32)
    found = []
    for x, ys in _open_pairs(label, n, [_wide_sketch(s) for s in sets], side, same, rule):
        marked[place[x]] = 1
        for k in range(0, len(ys), TURN):
            now = ys[k : k + TURN]
            now = now[label[now] != label[x]]
            if not len(now):
                continue
            common = np.add.reduceat(marked[np.concatenate([place[y] for y in now.tolist()])], np.cumsum(n[now]) - n[now])
            now = now[rule.of * common >= rule.at_least * (n[now] + n[x] - common)]
            if len(now):
                joined, first = np.unique(label[now], return_index=True)
                found += [(x, int(y)) for y in now[first]]
                label[np.isin(label, joined)] = label[x]
        marked[place[x]] = 0
    return found


def _linked(rows: DataFrame, classes: DataFrame, docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """(lead, block_a, block_b, side, class, component), which is written -> links (a, b) of classes that join components, written."""
    spark = docs.sparkSession
    ids = classes.select("class", "first_id", "first_key").join(rows.select("class").distinct(), "class", "left_semi")
    ids = materialize(spark, ids, "jaccard-ids")
    sets = materialize(spark, _sets_of(docs, ids, n), "jaccard-sets")

    def one(table: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        table = table.take(pa.array(np.unique(table["class"].to_numpy(), return_index=True)[1]))
        names = table["class"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["shingles"]]
        links = forest(table["component"].to_numpy(), sets, table["side"].to_numpy(), same, rule)
        if links:
            a, b = names[np.array(links)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    links = materialize(spark, _by_block(sets.join(few(rows), "class"), ["side", "class", "component", "shingles"], one, "a long, b long"), "jaccard-links")
    discard(ids, sets, rows)
    return links


def _cost():
    return F.greatest(F.col("n"), F.lit(LEAST_COST))


def join(docs: DataFrame, n: int = 4, rule: Rule | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key (a hash of the text), n_shingles, class (documents with one shingle set), component (of
    classes; null without words), component_id (its smallest doc_id), a row for each document."""
    rule = rule or Rule()
    spark = docs.sparkSession
    rows = materialize(spark, _shingled(docs, n, rule), "jaccard-rows")
    facts = [F.first(c).alias(c) for c in (*_SKETCHES, "sketch")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(first, F.first("n_shingles").alias("n"), F.max("spare").alias("spare"), *facts)
    classes = materialize(spark, classes.select("class", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "n", "spare", *_SKETCHES, "sketch"), "jaccard-classes")

    emitted = rows.select("class", F.explode("sigs").alias("sig")).repartition("sig")
    shared = emitted.groupBy("sig").agg(F.min("class").alias("lead"), F.max("class").alias("last"), F.count("*").alias("cost")).filter("lead < last").drop("last")
    # written by itself: a join by class in the same plan would filter one of two exchanges of the signatures, and make them two
    met = materialize(spark, emitted.join(shared.hint("shuffle_hash"), "sig").distinct(), "jaccard-met")
    groups = met.join(classes.select("class", "spare"), "class")
    dear = Window.partitionBy("class", F.expr("sig & 3")).orderBy(F.desc("cost"), "sig")
    spared = F.when(F.expr("sig & 2 = 0"), F.element_at("spare", (F.expr("sig & 1") + 1).cast("int"))).otherwise(0)
    groups = groups.withColumn("turn", F.row_number().over(dear)).filter(F.col("turn") > spared)
    groups = materialize(spark, groups.select("sig", "lead", "class"), "jaccard-groups")
    discard(met)

    # one pair for each class: with the lead it shares most groups with, of those that sizes and sketches allow
    a, b = (classes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("class", "n", *_SKETCHES)]) for x in "ab")
    stars = groups.filter("lead < class").groupBy(F.col("lead").alias("class_a"), F.col("class").alias("class_b")).agg(F.count("*").alias("shares"))
    stars = stars.join(a, "class_a").join(b, "class_b")
    stars = stars.filter(_possible(F.col("n_a"), F.col("n_b"), *([F.col(f"{p}_{x}") for p in _SKETCHES] for x in "ab"), rule))
    best = F.max(F.struct("shares", (-F.col("class_a")).alias("order"), "class_a")).alias("best")
    stars = materialize(spark, stars.groupBy(F.col("class_b").alias("class")).agg(best, F.first("n_b").alias("n")).select("class", F.col("best.class_a").alias("lead"), "n"), "jaccard-stars")
    big = stars.groupBy("lead").agg(F.ceil(F.sum(_cost()) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = stars.join(few(materialize(spark, big, "jaccard-big")), "lead", "left").select(
        "lead", F.lit(-1).alias("block_a"), F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block_b"), F.lit(1).alias("side"), "class",
    )
    leads = dealt.select("lead", "block_a", "block_b", F.lit(0).alias("side"), F.col("lead").alias("class")).distinct()
    dealt = materialize(spark, dealt.unionByName(leads).withColumn("component", F.col("class")), "jaccard-dealt")
    links = _linked(dealt, classes, docs, n, rule)
    known = materialize(spark, components(links), "jaccard-known")
    discard(stars, links)

    # groups that still span components, gathered by their lead: a pair of near copies shares many groups, but few leads
    of = classes.select("class", "n", "first_id").join(known.withColumnRenamed("node", "class"), "class", "left")
    of = materialize(spark, of.select("class", F.coalesce("component", "class").alias("component"), "n", "first_id"), "jaccard-components")
    placed = groups.join(of.select("class", "component", "n"), "class")
    spans = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("sig")
    left = open_ = materialize(spark, placed.join(spans, "sig", "left_semi").select("lead", "class", "component", "n").distinct(), "jaccard-open")
    discard(groups)
    parts = left.groupBy("lead", "component").agg(F.sum(_cost()).alias("cost"))
    big = parts.groupBy("lead").agg(F.sum("cost").alias("cost"), F.max(F.struct("cost", "component")).alias("main")).filter(F.col("cost") > BLOCK)
    big = big.select("lead", F.col("main.component").alias("main"), F.ceil((F.col("cost") - F.col("main.cost")) / BLOCK).cast("int").alias("outside"), F.ceil(F.col("main.cost") / BLOCK).cast("int").alias("inside"))
    # blocks of classes outside the main component come first; without a main component there is one block
    left = left.join(few(materialize(spark, big, "jaccard-big")), "lead", "left").fillna({"outside": 1, "inside": 0}).filter("outside > 0")
    left = left.withColumn("inner", F.coalesce(F.col("component") == F.col("main"), F.lit(False))).withColumn(
        "block", (F.pmod(F.xxhash64("class"), F.when(F.col("inner"), F.col("inside")).otherwise(F.col("outside"))) + F.when(F.col("inner"), F.col("outside")).otherwise(0)).cast("int")
    )
    # blocks go together in eights, those outside the main component by themselves
    eights = lambda c: F.ceil(c / TOGETHER).cast("int")
    of_eight = F.when(F.col("inner"), eights(F.col("outside")) + F.floor((F.col("block") - F.col("outside")) / TOGETHER)).otherwise(F.floor(F.col("block") / TOGETHER)).cast("int")
    meets = F.sequence(F.lit(0), eights(F.col("outside")) + F.when(F.col("inner"), 0).otherwise(eights(F.col("inside"))) - 1)
    spread = left.withColumn("eight", of_eight).join(classes.select("class", "sketch"), "class").select("*", F.explode(meets).alias("other")).select(
        "lead", F.least("eight", "other").alias("block_a"), F.greatest("eight", "other").alias("block_b"),
        (F.col("eight") > F.col("other")).cast("int").alias("side"), "class", "component", "n", "block", "sketch",
    )
    more = _linked(materialize(spark, _open(spread, rule), "jaccard-unsure"), classes, docs, n, rule)
    discard(open_)
    # the new links join components, so only those are walked again
    name = of.select("class", "component")
    between = more.join(name.select(F.col("class").alias("a"), F.col("component").alias("ca")), "a").join(name.select(F.col("class").alias("b"), F.col("component").alias("cb")), "b")
    joined = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("wider"))

    named = of.select("class", "first_id", "component").join(joined, "component", "left").select("class", "first_id", F.coalesce("wider", "component").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("class", "component", "component_id")
    return rows.select("doc_id", "text_key", "n_shingles", "class").join(named, "class", "left").select(
        "doc_id", "text_key", "n_shingles", "class", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
