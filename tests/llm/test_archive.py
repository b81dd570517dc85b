import hashlib
import io
import zipfile
import zlib

import pytest

from lodestrata.llm import media, queries, warc
from lodestrata.llm.archive import ArchiveError, Reader, Writer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_read_by_other_programs_and_by_range(tmp_path, zip64):
    out = Writer(str(tmp_path / "a.zip"), zip64)
    data = {"x/ä.bin": b"abc" * 1000, "empty": b"", "y": bytes(range(256))}
    places = {n: out.add(n, d) for n, d in data.items()}
    size = out.commit()
    raw = (tmp_path / "a.zip").read_bytes()
    assert len(raw) == size and {p.name for p in tmp_path.iterdir()} == {"a.zip"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist()} == data
    reader = Reader(str(tmp_path / "a.zip"))
    assert {m.name: reader.data(m) for m in reader.members()} == data
    assert all(reader.begin(m) == places[m.name] for m in reader.members())


def test_archives_by_others(tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("stored", b"12345")
        z.writestr("packed", b"1" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    reader = Reader(str(tmp_path / "b.zip"))
    stored, packed = reader.members()
    assert reader.data(stored) == b"12345"
    with pytest.raises(ArchiveError):
        reader.data(packed)
    broken = bytearray((tmp_path / "b.zip").read_bytes())
    broken[reader.begin(stored)] ^= 1
    (tmp_path / "c.zip").write_bytes(broken)
    with pytest.raises(ArchiveError):
        Reader(str(tmp_path / "c.zip")).data(stored)
    (tmp_path / "d.zip").write_bytes(b"no archive")
    with pytest.raises(ArchiveError):
        Reader(str(tmp_path / "d.zip")).members()


def test_images_are_lossless():
    for data in (b"", b"a", bytes(range(256)) * 9, b"\xff" * 576, b"x" * 577):
        payload = media.pad(data)
        assert len(payload) % 576 == 0 and len(payload) >= max(576, len(data)) and payload[: len(data)] == data
        assert set(payload[len(data) :]) <= {255}
        assert media.decode(media.encode(payload)) == payload
    image = bytearray(media.encode(media.pad(b"abc")))
    image[60] ^= 1
    with pytest.raises((ArchiveError, zlib.error)):
        media.decode(bytes(image))


def _expected(text):
    raw = (text or "").encode()
    payload = media.pad(raw)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_media_of_the_whole_table(spark):
    got = {r["doc_id"]: r for r in queries.op4_media_columns(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == _expected(d["text"])
        image = media.encode(media.pad(d["text"].encode()))
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())


def test_media_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 400), (4, "long " * 50000), (5, "same"), (5, "same"), (6, "same"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as media")
    got = media.describe(media.load(spark, media.store(docs, range_bytes=1000, archive_bytes=3000))).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted((i or 0, *_expected(t)) for i, t in rows)
    assert len({tuple(r)[1:] for r in got if r["n_bytes"] == 4}) == 1
    assert media.load(spark, media.store(docs.limit(0))).count() == 0


def test_a_member_is_read_again_by_its_offset(tmp_path):
    out = Writer(str(tmp_path / "m.zip"))
    payloads = [media.pad(b"%d" % k * 400) for k in range(5)]
    for k, p in enumerate(payloads):
        out.add(f"{k}.400.png", media.encode(p))
    out.commit()
    (tmp_path / "list.txt").write_text(f"{tmp_path}/m.zip\n")
    source = media.MediaReader({"path": str(tmp_path / "list.txt"), "range_bytes": "150"})
    failures = {2: 2, 4: 1}

    class Flaky(Reader):
        def data(self, m):
            k = int(m.name[0])
            if failures.get(k):
                failures[k] -= 1
                raise OSError("lost")
            return super().data(m)

        def member_at(self, at):
            if headers.pop(at, None):
                raise OSError("a short read of a header")
            return super().member_at(at)

    source.open = Flaky
    headers: dict = {}
    parts = source.partitions()
    assert len(parts) > 1
    (tmp_path / "list.txt").write_text("".join(f"{p.path}\t{p.begin}\t{p.end}\n" for p in parts))
    planned = media.MediaReader({"path": str(tmp_path / "list.txt")})
    planned.open = None  # ranges of a manifest open no archive
    assert [(p.path, p.begin, p.end) for p in planned.partitions()] == [(p.path, p.begin, p.end) for p in parts]
    got = [s for p in parts for b in source.read(p) for s in b.column(2).to_pylist()]
    assert got == payloads and not any(failures.values())
    headers |= {p.begin: True for p in parts}
    assert [s for p in parts for b in source.read(p) for s in b.column(2).to_pylist()] == payloads and not headers
    failures[1] = 3
    with pytest.raises(OSError):
        [list(source.read(p)) for p in parts]


def test_warc_records_round_trip():
    raw = warc.record(7, 0, "http://a/ b\r\nX: y", "ü\r\n\r\nbody".encode(), None)
    head, http, payload = warc.parse(raw)
    assert payload == "ü\r\n\r\nbody".encode() and head["WARC-Type"] == "response" and "X" not in head and http["Content-Length"] == str(len(payload))
    head, http, payload = warc.parse(warc.record(6, 1, "u", b"abc", (7, 0)))
    assert payload == b"" and head["WARC-Refers-To"] == "<urn:page:7:0>" and http["Content-Length"] == "3"
    with pytest.raises(ArchiveError):
        warc.parse(raw[:-5])


def test_warc_of_odd_rows(spark):
    rows = [(1, "u", None), (2, "v", ""), (3, None, "same"), (9, "w", "same"), (4, "w", "same"), (5, "x", "z" * 300000), (6, "y", "é"), (6, "y", "é"), (None, "q", "lonely")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as to")
    got = warc.load(warc.store(pages)).collect()
    body = {i: (h or "").encode() for i, _, h in rows}
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == sorted(
        [(1, "revisit", 2), (2, "response", None), (3, "revisit", 9), (9, "response", None), (4, "revisit", 9), (5, "response", None), (6, "response", None), (6, "revisit", 6), (0, "response", None)],
        key=lambda x: (x[0], x[1]),
    )
    assert all(r["payload_bytes"] == len(body[r["page_id"]]) and r["payload_digest"] == warc.digest(body[r["page_id"]]) for r in got)
    assert warc.load(warc.store(pages.limit(0))).count() == 0
