"""What the operators share: table reading, the shared work folder, materialised steps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of narrow rows is broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_ROWS = 250_000
#: Bytes of rows that Spark gathers for a Python worker at a time; its default is 64 MB on either side, for each task.
BATCH_BYTES = "4m"
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_left_over: list[tuple] = []
_kept: list[tuple] = []


def kept(key, make):
    """What a Python worker keeps between its tasks: one object, of the operator that ran last. Another key takes its place,
    so a worker that serves one stage after another holds the cache of one of them."""
    if not _kept or _kept[0][0] != key:
        if _kept:
            _kept.clear()
            _give_back()
        _kept.append((key, make()))
    return _kept[0][1]


def _give_back() -> None:
    """Hands freed memory back to the machine, where the C library can; else a worker stays as large as its largest stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordIndex:
    """Numbers for words met lately, from 0. ``most_bytes`` bounds what the words take; when they would take more, all are
    forgotten and numbering starts again, so long words are forgotten the sooner."""

    #: What an entry takes beside the word itself, about.
    entry_bytes = 150

    def __init__(self, most_bytes: int = 40 << 20):
        self.most_bytes, self.held, self.known = most_bytes, 0, {}

    def add(self, split: list[list]) -> tuple[list, int]:
        """Words of ``split`` that are new, which get the numbers from the second result on."""
        new = set().union(*split).difference(self.known)
        size = sum(map(len, new)) + self.entry_bytes * len(new)
        if self.known and self.held + size > self.most_bytes:
            self.known, self.held, new = {}, 0, set().union(*split)
            size = sum(map(len, new)) + self.entry_bytes * len(new)
        begin, new = len(self.known), list(new)
        self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
        self.held += size
        return new, begin

    def numbers(self, ws: list) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, ws), dtype=np.int64, count=len(ws))


def rows_for(table: np.ndarray, end: int) -> np.ndarray:
    """``table`` with room for ``end`` rows."""
    return table if end <= len(table) else np.concatenate([table, np.zeros((max(end, len(table) * 3 // 2) - len(table), *table.shape[1:]), dtype=table.dtype)])


def bound_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small, so that a task's memory doesn't follow the length of texts. Smaller ones stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", f"{64 << 20}b"):
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """The maximal runs of characters other than ASCII white space, of a text in UTF-8."""
    return text.split() if text else []


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in pieces of about ``most`` bytes. They are cut before an ASCII character that is no letter or digit, so words stay whole."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + most)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns of ``docs`` but those that a result with columns ``names`` replaces."""
    return [c for c in docs.columns if c.lower() not in names]


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A private one is made only in a local session that configures none, as in tests."""
    if not (base := spark.conf.get("spark.checkpoint.dir", "")):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not (base := getattr(shared_dir, "own", "")):
            base = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/lodestrata/{label}-{uuid.uuid4().hex}"
    if not _left_over:
        atexit.register(_remove_all)
    _left_over.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    while _left_over:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(*_left_over.pop())


def few(written: DataFrame) -> DataFrame:
    """``written`` (a table of narrow rows that is written already), to be broadcast if it is counted to be small."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, a lost executor costs nothing."""
    bound_batches(spark)
    df.write.parquet(path := scratch(spark, label))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes what ``materialize`` has written, once all that reads it is written itself."""
    for df in written:
        entry = (df.sparkSession, df.written_to)
        if entry in _left_over:
            _left_over.remove(entry)
            remove(*entry)


@contextlib.contextmanager
def only_result(spark: SparkSession):
    """Removes what was written inside, but for the frames that the block adds to the list it is given."""
    mark, kept_ = len(_left_over), []
    yield kept_
    for entry in [e for e in _left_over[mark:] if e[1] not in {df.written_to for df in kept_}]:
        _left_over.remove(entry)
        remove(*entry)
