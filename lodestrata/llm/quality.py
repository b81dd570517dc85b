"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text gives its words and pairs of neighbouring words, once as written and once as shapes (letters to x or X, digits to 0,
runs of one character shortened to one, other characters kept), hashed into ``BUCKETS`` weights. Feature values are counts / sqrt(number of words), so
a score is a sparse dot product: one gather and one sum. Training makes one pass in the order of a hash over at most about
``MAX_LABELLED`` labelled texts; scoring covers every whole text.

Defined results: null and empty texts score as the bias alone; without labelled rows every score is 0.5; a text
with several labels counts once for each; null labels are ignored; a null doc_id isn't held out and has no label; repeated rows score alike; a
column of the input named ``score`` is replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WordIndex, crc32_of_id, kept, others, rows_for, words

BUCKETS = 1 << 20
#: Bound of the training sample: about so many labelled rows, chosen by a hash of the id.
MAX_LABELLED = 12_000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
_MASK = np.uint64(BUCKETS - 1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({c: "x" for c in map(chr, range(97, 123))} | {c: "X" for c in map(chr, range(65, 91))} | {c: "0" for c in "0123456789"})


def _shape(word: str) -> str:
    if not word.isascii():
        word = "".join(c if c.isascii() else "x" if c.islower() else "X" if c.isupper() else "o" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", word.translate(_SHAPE))


class Hasher:
    """Buckets of a text's features; words it has met are kept in a cache of bounded bytes."""

    def __init__(self):
        self.index = WordIndex()
        self.hashes = np.zeros((4096, 2), dtype=np.uint64)

    def features(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, int]]:
        """(buckets, number of words) of each text."""
        digest = xxhash.xxh64_intdigest
        for k in range(0, len(texts), 256):
            split = [words(t) for t in texts[k : k + 256]]
            new, begin = self.index.add(split)
            self.hashes = rows_for(self.hashes, begin + len(new))
            if new:
                self.hashes[begin : begin + len(new)] = np.array([(digest(w), digest("\0" + _shape(w.decode()))) for w in new], dtype=np.uint64)
            for ws in split:
                h = self.hashes[self.index.numbers(ws)]
                mixed = (h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
                both = np.concatenate([h.ravel(), (mixed ^ (mixed >> np.uint64(29))).ravel()])
                yield (both & _MASK).astype(np.int64), len(ws)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2; the last coordinate is the bias."""

    def __init__(self, size: int = BUCKETS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ x) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(column) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> np.ndarray:
    """(doc_id, text), (doc_id, quality) -> BUCKETS + 1 weights. The sample of labels is small and broadcast; texts stay where they are."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality")
    n = usable.count()
    if not n:
        return np.zeros(BUCKETS + 1)
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, most / n) * 1_000_000)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.select(F.md5(F.encode(F.concat_ws("/", "doc_id", "quality"), "UTF-8")).alias("turn"), "quality", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                where, values = [], []
                for buckets, n_words in hasher.features(part.column(2).cast(pa.binary()).to_pylist()):
                    u, c = np.unique(buckets, return_counts=True)
                    where.append(u.astype("<i4").tobytes())
                    values.append((c / np.sqrt(max(1, n_words))).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(where, pa.binary()), pa.array(values, pa.binary())], ["turn", "quality", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            for label, at, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at, x = np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)
                model.update(np.append(at, BUCKETS), np.append(x, 1.0), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["w"])

    counted = rows.mapInArrow(count, "turn string, quality int, at binary, x binary")
    ordered = counted.repartition(1).sortWithinPartitions("turn", "quality")  # one task, over the bounded sample
    learnt = ordered.mapInArrow(learn, "w binary").first()  # none if no labelled text is among ``docs``
    return np.frombuffer(learnt["w"], "<f4").astype(float) if learnt else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds ``score`` (the probability of quality 1) to the rows of ``docs``, which has a column ``text``."""
    docs = docs.select(*others(docs, "score"))
    held, names = docs.sparkSession.sparkContext.broadcast(weights), docs.columns  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        hasher = kept("quality", Hasher)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                dots = np.array([w[b].sum() / np.sqrt(max(1, n)) for b, n in hasher.features(texts)], dtype=float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sigmoid(dots + w[-1]), pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")
