"""Spelling variants: words one edit apart, found by rolling-hash deletions.

Two words of one length differ by a replaced code point if leaving out the same place of both gives one string; two words whose
lengths differ by one differ by an inserted code point if leaving out some place of the longer gives the shorter. A word's keys are
integers: the polynomial hash of the word, of each string that it is without one code point (strings that come out equal count
once), and of each of these with its place and the word's length. The hash of a word without place i comes from the hashes of the prefix
before i and the suffix behind it, so NumPy computes the keys of all words of a length column by column, in time in proportion to
their letters.

Keys travel without their words. Spark partitions them by their upper bits and sorts them; a task walks runs of equal keys and keeps those
that can hold near words. Only members of such runs get their strings back, and a run is split by the strings themselves, so that
a collision of hashes joins nothing. A run never becomes pairs: its members are told how many the others are and which is the
most frequent. No key is hot: words that share one differ in one place, so there are as many as letters of the alphabet, or that
many for each place of a short word.

A word's form is at least twice as frequent as the word, so a chain of forms is no longer than the binary logarithm of the largest count;
roots are found by doubling the steps along all chains at once.

Defined results: a null text has no words; a null id counts as empty text in front of the colon; rows that repeat id and text
all count; very long texts are read in pieces, very long words are words; ties go to the smallest word in code-point order;
no words give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, pieces

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 after A-Z have been lower-cased.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a code point in one of so many (document, run), and a form is so many times as frequent as the word.
DAMAGED, FORM_RATIO = 97, 2
#: Bytes of words that a task counts before it hands on what it has, and code points whose keys are made at a time.
MOST_BYTES, MOST_POINTS = 64 << 20, 1 << 19
_BASE, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def damaged(run: bytes, seed: int) -> bytes:
    """``run`` as it counts where the crc32 of its document's id and a colon is ``seed``."""
    h = crc32(run, seed)
    if h % DAMAGED:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> word, n, partial counts of what each task has read."""

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = crc32(b"%s:" % (doc_id or "").encode())
                for piece in pieces((text.as_py() or b"").lower()):  # of bytes only A-Z change
                    for word, n in Counter(RUN.findall(piece)).items():
                        word = damaged(word, seed)
                        if len(word) >= LEAST_LENGTH:  # bytes; code points are counted later
                            before = held.get(word)
                            if before is None:
                                before, size = 0, size + len(word) + 150
                            held[word] = before + n
                    if size > MOST_BYTES:
                        yield rows(held)
                        held, size = {}, 0
        if held:
            yield rows(held)

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def deletion_keys(points: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key) of words of one length, a row of code points each. Place -1 is the whole word. Even keys are of strings, of
    words and of words without a code point; odd keys are of a string with the place that was left out."""
    count, length = points.shape
    letters = _mix(points.astype(np.uint64) + _C)
    prefix, suffix = np.zeros((2, length + 1, count), dtype=np.uint64)
    power = np.ones(length + 1, dtype=np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)  # wraps around, as all of this does
    for i in range(length):
        prefix[i + 1] = prefix[i] * _BASE + letters[:, i]
    for i in range(length - 1, -1, -1):
        suffix[i] = letters[:, i] * power[length - 1 - i] + suffix[i + 1]
    without = prefix[:length] * power[length - 1 :: -1][:length, None] + suffix[1:]
    even, one = ~np.uint64(1), np.uint64(1)
    place, row = np.divmod(np.arange(length * count), count)
    at = _mix(np.arange(length, dtype=np.uint64) * _C + np.full(length, length, dtype=np.uint64) * _B)
    out = [(row, place, _mix(without ^ at[:, None]).ravel() | one), (np.arange(count), np.full(count, -1), _mix(prefix[length]) & even)]
    if length > least:
        first = np.vstack([np.ones((1, count), dtype=bool), (points[:, 1:] != points[:, :-1]).T]).ravel()  # of equal neighbours
        out.append((row[first], place[first], _mix(without).ravel()[first] & even))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(words: DataFrame) -> DataFrame:
    """(id, word) -> key, id, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
            for length in np.unique(lengths).tolist():
                own, step = np.flatnonzero(lengths == length), max(1, MOST_POINTS // length)
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    points = np.frombuffer("".join([held[i] for i in some.tolist()]).encode("utf-32-le"), "<u4").reshape(-1, length)
                    row, place, key = deletion_keys(points)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[some][row]), pa.array(place.astype(np.int32))], ["key", "id", "place"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, place int")


def _sorted_by_key(rows: DataFrame) -> DataFrame:
    """Rows dealt by the upper bits of their keys and sorted by them in each partition."""
    return rows.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches, cut so that no run of equal keys is divided, each with the places where runs begin."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        key = batch.column(0).to_numpy()
        begin = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        rest = batch.slice(begin[-1])
        if begin[-1]:
            yield batch.slice(0, begin[-1]), begin[:-1]
    if rest is not None:
        yield rest, np.zeros(1, dtype=np.int64)


def _meeting(keys: DataFrame) -> DataFrame:
    """Members of runs that can hold near words: two at least, and a whole word among them if the key is of a string alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _runs(batches):
            size = np.diff(begin, append=batch.num_rows)
            odd = (batch.column(0).to_numpy()[begin] & 1).astype(bool)
            whole = np.logical_or.reduceat(batch.column(2).to_numpy() < 0, begin)
            yield batch.filter(pa.array(np.repeat((size > 1) & (odd | whole), size)))

    return _sorted_by_key(keys).mapInArrow(run, keys.schema)


def near_in_run(members: list[tuple[int, str, int]], odd: bool) -> Iterator[tuple[int, int, int, str]]:
    """(place, word, n) of one key -> (member, near words here, count of the most frequent, that word), by the strings themselves."""
    strings: dict[tuple, list[int]] = {}
    for k, (place, word, _) in enumerate(members):
        left = word if place < 0 else word[:place] + word[place + 1 :]
        strings.setdefault((left, place, len(word)) if odd else (left,), []).append(k)
    for own in strings.values():
        own.sort(key=lambda k: (-members[k][2], members[k][1]))
        if odd:
            for k in own if len(own) > 1 else ():
                best = members[own[1] if k == own[0] else own[0]]
                yield k, len(own) - 1, best[2], best[1]
        elif len(own) > 1 and (whole := [k for k in own if members[k][0] < 0]):
            longer = [k for k in own if members[k][0] >= 0]
            yield whole[0], len(longer), members[longer[0]][2], members[longer[0]][1]
            for k in longer:
                yield k, 1, members[whole[0]][2], members[whole[0]][1]


def _near(members: DataFrame) -> DataFrame:
    """(key, id, place, word, n) -> id, n_near, best_n, best: what one key tells each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _runs(batches):
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = list(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True))
            out = [
                (int(ids[b + k]), near, n, word)
                for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True)
                for k, near, n, word in near_in_run(rows[b:e], bool(key[b] & 1))
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["id", "n_near", "best_n", "best"])

    return _sorted_by_key(members).mapInArrow(run, "id long, n_near long, best_n long, best string")


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, form), which is written -> word, root: the last of the forms that follow, by doubling the steps."""
    spark, now, steps = forms.sparkSession, forms.withColumnRenamed("form", "root"), 1
    while steps < longest:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        now = now.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"))
        now, steps = materialize(spark, now, "spelling-roots"), 2 * steps
    return now


def variants(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> word, form, root, n, n_near, form_n, a row for each word."""
    spark = docs.sparkSession
    words = _counted(docs).groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))
    words = materialize(spark, words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    members = _meeting(_keys(words)).join(words, "id").select("key", "id", "place", "word", "n")
    told = _near(members).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))
    frequent = -F.col("best.less") >= FORM_RATIO * F.col("n")
    out = words.join(told, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.best")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    out = materialize(spark, out, "spelling-forms")
    most = out.agg(F.max("n")).first()[0] or 0
    roots = _roots(out.filter("form is not null").select("word", "form"), max(1, most // LEAST_COUNT).bit_length())
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
