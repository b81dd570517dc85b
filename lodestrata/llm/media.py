"""Media columns: bytes stored losslessly as images in archives, and a Spark data source that reads them back.

``encode`` turns a payload into an 8-bit grey PNG of ``WIDTH`` samples a row. ``write_archives`` stores them as members of ZIP
archives in a shared folder, one archive a task under a name of its own attempt, and returns the byte ranges of those that were
committed, of about ``RANGE_BYTES`` each; a task that runs twice leaves a file that no list names.

The source ``lodestrata_media`` (``MediaSource``) plans its partitions as byte ranges of archives: those of its manifest, or, for an
archive that a manifest names without ranges, those of members in the archive's own directory. A partition opens one archive, walks the
members of its range by their local headers and streams Arrow batches of bounded size. Each member is read and decoded by itself;
one that fails is read again from its own offset, through a new handle, ``attempts`` times.

Defined results: a null text is an empty payload; a payload is padded with bytes 255 to a positive multiple of 576; repeated
rows are members of their own; an empty table writes no archive and reads as no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.llm.archive import ArchiveError, Reader, Writer
from lodestrata.llm.common import materialize, scratch

WIDTH = 576
PAD = b"\xff"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payload bytes of a batch, and stored bytes of a range and of an archive, about.
BATCH_BYTES, RANGE_BYTES, ARCHIVE_BYTES = 4 << 20, 16 << 20, 256 << 20


def pad(data: bytes) -> bytes:
    return data + PAD * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A grey 8-bit PNG whose samples are the payload; its length is a positive multiple of ``WIDTH``."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each begins with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image that ``encode`` made."""
    if image[:8] != _SIGNATURE:
        raise ArchiveError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ArchiveError("wrong checksum in a PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ArchiveError("not an 8-bit grey image of the stored width")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ArchiveError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 16-bin histogram (per thousand) of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"mean={x.mean():.3f};std={x.std():.3f};hist=" + ",".join(map(str, histogram))


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text) -> (path, begin, end, members): byte ranges of whole members in the archives written under ``folder``.

    A member is named by the row's id and the length of its unpadded payload. Archives are cut at about ``archive_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Writer | None = None

        def close() -> pa.RecordBatch:
            places = [m.header for m, _ in out.members]
            ranges = plan(places, out.at, range_bytes)
            out.commit()
            begin, end, members = zip(*ranges, strict=True)
            path = pa.array([f"{folder}/{out_name}"] * len(ranges))
            return pa.RecordBatch.from_arrays([path, pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(members, pa.int64())], ["path", "begin", "end", "members"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if out is None:
                        out_name = f"media-{uuid.uuid4().hex}.zip"
                        out = Writer(f"{folder}/{out_name}")
                    raw = (text or "").encode()
                    out.add(f"{'' if doc_id is None else doc_id}.{len(raw)}.png", encode(pad(raw)))
                    if out.at >= archive_bytes:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "path string, begin long, end long, members long")


def plan(places: list[int], end: int, range_bytes: int) -> list[tuple[int, int, int]]:
    """(begin, end, members) of ranges of about ``range_bytes``, from the places of local headers in order; ``end`` follows the last member."""
    out, begin, members = [], 0, 0
    for k, place in enumerate(places):
        if members and place - begin >= range_bytes:
            out.append((begin, place, members))
            members = 0
        if not members:
            begin = place
        members += 1
        if k + 1 == len(places):
            out.append((begin, end, members))
    return out


class Range(InputPartition):
    """The members of an archive whose local headers lie in [begin, end)."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))
        self.open = Reader

    def partitions(self) -> list[Range]:
        """Ranges of the manifest, a text file with a line for each: path, begin and end, or a path alone."""
        from lodestrata.llm.archive import locate

        store, path = locate(self.manifest)
        with store.open_input_stream(path) as f:
            lines = [x.split("\t") for x in f.read().decode().split("\n") if x]
        out = []
        for path, *place in lines:
            if place:
                out.append(Range(path, int(place[0]), int(place[1])))
                continue
            reader = self.open(path)
            places = sorted(m.header for m in reader.members())
            out += [Range(path, begin, end) for begin, end, _ in plan(places, reader.directory, self.range_bytes)]
            reader.close()
        return out

    def _member(self, path: str, reader: Reader, at: int) -> tuple[str, bytes, bytes, int, Reader]:
        """Name, stored image, samples and end of the member whose local header is at ``at``, and the reader; read again by its offset, header
        and all, from a newly opened archive, if anything is wrong with what came."""
        for k in range(self.attempts):
            try:
                m, end = reader.member_at(at)
                image = reader.data(m)
                return m.name, image, decode(image), end, reader
            except (ArchiveError, OSError, zlib.error, struct.error, ValueError):
                reader.close()
                if k + 1 == self.attempts:
                    raise
                reader = self.open(path)
        raise AssertionError

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once even where no partition was planned
            return
        reader, at = self.open(partition.path), partition.begin
        rows: list[tuple] = []
        held = 0
        while at < partition.end:
            name, image, samples, at, reader = self._member(partition.path, reader, at)
            doc_id, n_bytes, _ = name.split(".")
            rows.append((int(doc_id) if doc_id else None, int(n_bytes), samples, image))
            held += len(samples) + len(image)
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)
        reader.close()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, samples, images = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(samples, pa.binary()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "samples", "media"])


class MediaSource(DataSource):
    """Reads the ranges of archives that a manifest names."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_media"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, samples binary, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def store(docs: DataFrame, **sizes: int) -> str:
    """Write the media of (doc_id, text); the path of the manifest, which has a line for every ``RANGE_BYTES`` and is streamed."""
    from lodestrata.llm.archive import locate

    spark = docs.sparkSession
    folder = scratch(spark, "media")
    written = materialize(spark, write_archives(docs, folder, **sizes), "media-list")
    manifest = f"{folder}/manifest.txt"
    fs, path = locate(manifest)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        for row in written.select("path", "begin", "end").toLocalIterator():
            f.write(f"{row['path']}\t{row['begin']}\t{row['end']}\n".encode())
    return manifest


def load(spark: SparkSession, manifest: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("lodestrata_media").options(**options).load(manifest)


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of what was read back; the bytes themselves go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for samples, image in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
