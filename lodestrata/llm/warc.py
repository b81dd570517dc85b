"""WARC records in ZIP packages, and a reader that finds records through the package's directories.

A package is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member a record), ``indexes/index.cdxj`` (a line a
record: key, offset and length in the archive member) and ``datapackage.json``. The reader parses the central directory (ZIP64
included), locates the stored members and the index, plans ranges of records, and range-reads each record by its offset.

Records with equal payloads: the one with the largest page_id is a response, the others are revisits that name it and hold
the HTTP header only. Rows of a payload that many pages share are joined by digest without their payloads, where an adaptive plan
may split them over tasks; payloads are shuffled once, by page.

Defined results: a null html is an empty payload; a null page_id sorts below every other; repeated rows each get a record, and
of those with the largest page_id one is the response and the rest are revisits of it; an empty table writes no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.archive import ArchiveError, Reader, Writer
from lodestrata.llm.common import materialize, scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
#: Stands for a missing page_id, below all others.
NO_PAGE = -(2**63)
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def record(page_id: int | None, copy: int, url: str, payload: bytes, refers_to: tuple[int | None, int] | None) -> bytes:
    """One WARC record; a revisit, without the payload, if ``refers_to`` names a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, copy)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(*refers_to)}", f"WARC-Profile: {_PROFILE}"]
    block = http if refers_to is not None else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload (empty in a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines)
    n = int(warc["Content-Length"])
    if len(rest) != n + 4:
        raise ArchiveError("a record of the wrong length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return warc, fields, payload


def _page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return int(page) if page else None


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, copy (number among equal ids and payloads), url, html, to_page, to_copy (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.coalesce("page_id", F.lit(NO_PAGE))).withColumn("sha", F.sha2(F.encode("html", "UTF-8"), 256))
    # which page each payload refers to is found on narrow rows; payloads move once, by keys of few rows each
    narrow = rows.select("page", "sha").distinct()
    top = narrow.groupBy("sha").agg(F.max("page").alias("top"))
    marked = rows.join(narrow.join(top, "sha"), ["page", "sha"])
    marked = marked.withColumn("copy", (F.row_number().over(Window.partitionBy("page", "sha").orderBy("url")) - 1).cast("int"))
    response = (F.col("page") == F.col("top")) & (F.col("copy") == 0)
    to = F.struct(F.when(F.col("top") != NO_PAGE, F.col("top")).alias("page"), F.lit(0).alias("copy"))
    return marked.select("page_id", "copy", "url", "html", F.when(~response, to).alias("to"))


def write_packages(marked: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """-> (path, records, bytes) of the packages written under ``folder``; a task that runs twice leaves a file that no row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            out = Writer(path := f"{folder}/pages-{uuid.uuid4().hex}.wacz")
            out.add(ARCHIVE, bytes(data))
            out.add(INDEX, "".join(sorted(index)).encode())
            out.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}).encode())
            size = out.commit()
            batch = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
            data.clear()
            index.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, copy, url, html, to in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    raw = record(page_id, copy, url, html.encode(), None if to is None else (to["page"], to["copy"]))
                    packed = gzip.compress(raw, 6, mtime=0)
                    key = " ".join(url.split()) or "-"
                    index.append(f"{key.replace(' ', '%20')} 20200101000000 {json.dumps({'offset': len(data), 'length': len(packed)})}\n")
                    data.extend(packed)
                    if len(data) >= package_bytes:
                        yield close()
        if index:
            yield close()

    return marked.mapInArrow(run, "path string, records long, bytes long")


def plan_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path) -> (path, begin, records): runs of records of about ``range_bytes``, from each package's directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                reader = Reader(path)
                members = {m.name: m for m in reader.members()}
                begin = reader.begin(members[ARCHIVE])
                places = sorted((x["offset"], x["length"]) for x in (json.loads(line.split(" ", 2)[2]) for line in reader.data(members[INDEX]).decode().splitlines()))
                reader.close()
                run_of, held = [], 0
                for offset, length in places:
                    run_of.append({"offset": begin + offset, "length": length})
                    held += length
                    if held >= range_bytes:
                        rows.append((path, run_of))
                        run_of, held = [], 0
                if run_of:
                    rows.append((path, run_of))
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind)], ["path", "places"])

    return packages.select("path").mapInArrow(run, "path string, places array<struct<offset:long,length:long>>")


def read_records(ranges: DataFrame) -> DataFrame:
    """Records of the planned ranges, each read by its own offset and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows = Reader(path), []
                for x in places:
                    warc, http, payload = parse(gzip.decompress(reader.read(x["offset"], x["length"])))
                    kind, found = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != found or len(payload) != int(http["Content-Length"])):
                        raise ArchiveError(f"{path}: a payload doesn't match its digest at {x['offset']}")
                    rows.append((_page_of(warc["WARC-Record-ID"]), int(http["Content-Length"]), found, kind, _page_of(warc["WARC-Refers-To"]) if kind == "revisit" else None))
                reader.close()
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return ranges.mapInArrow(run, READ)


def store(pages: DataFrame) -> DataFrame:
    """Write (page_id, url, html) as packages in the shared folder; (path, records, bytes) of each, itself written."""
    spark = pages.sparkSession
    return materialize(spark, write_packages(mark_revisits(pages), scratch(spark, "warc")), "warc-list")


def load(packages: DataFrame) -> DataFrame:
    """The records of the packages. Packages are dealt out one by one, then their ranges."""
    spark = packages.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism)
    ranges = materialize(spark, plan_ranges(packages.repartition(tasks, "path")), "warc-ranges")
    return read_records(ranges.repartition(tasks))
