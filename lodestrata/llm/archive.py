"""ZIP archives of stored members: a streaming writer, and a reader that never extracts.

Members are stored, not deflated (what they hold is compressed already), so a member is a byte range of the archive. The
reader takes the end records and the central directory from the archive's tail, ZIP64 forms included, and finds a member's bytes
through its local header. Files are opened through ``pyarrow.fs``, by URI, so any shared store will do.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyarrow import fs

_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATE64 = b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DATE = (1980 - 1980) << 9 | 1 << 5 | 1


class ArchiveError(ValueError):
    """The bytes aren't what the directory or a checksum says."""


@dataclass(frozen=True)
class Member:
    name: str
    header: int
    size: int
    crc: int
    stored: bool = True


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Appends stored members to a new archive; ``commit`` puts it in place under its own name."""

    def __init__(self, uri: str, zip64: bool = False):
        self.fs, self.path = locate(uri)
        self.zip64, self.at, self.members = zip64, 0, []
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.part")

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Returns the offset of the member's bytes in the archive."""
        raw, big = name.encode(), self.zip64 or len(data) >= _MAX32
        crc, header = zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        short = _MAX32 if big else len(data)
        self._write(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, _DATE, crc, short, short, len(raw), len(extra)) + raw + extra)
        begin = self.at
        self._write(data)
        self.members.append((Member(name, header, len(data), crc), big))
        return begin

    def commit(self) -> int:
        begin = self.at
        for m, big in self.members:
            far = big or m.header >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.header) if far else b""
            short, raw = (_MAX32, m.name.encode()) if far else (m.size, m.name.encode())
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if far else 20, 0x800, 0, 0, _DATE, m.crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if far else m.header) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64 or n >= _MAX16 or begin >= _MAX32 or size >= _MAX32:
            end64 = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._write(struct.pack("<4sIQI", _LOCATE64, 0, end64, 1))
            n, size, begin = _MAX16, _MAX32, _MAX32
        self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, begin, 0))
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return self.at

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(f"{self.path}.part")


class Reader:
    def __init__(self, uri: str):
        self.fs, self.path = locate(uri)
        self.file = self.fs.open_input_file(self.path)
        self.size = self.file.size()
        self.directory = self.size  # where the central directory begins, once ``members`` has read it

    def close(self) -> None:
        self.file.close()

    def read(self, begin: int, size: int) -> bytes:
        data = self.file.read_at(size, begin)
        if len(data) != size:
            raise ArchiveError(f"{self.path}: {len(data)} of {size} bytes at {begin}")
        return data

    def members(self) -> list[Member]:
        """The central directory."""
        tail_size = min(self.size, 22 + _MAX16 + 20)
        tail = self.read(self.size - tail_size, tail_size)
        k = tail.rfind(_END)
        if k < 0:
            raise ArchiveError(f"{self.path}: no end of central directory")
        n, size, begin = struct.unpack_from("<HII", tail, k + 10)
        if _MAX16 == n or _MAX32 in (size, begin):
            at = self.size - tail_size + k - 20
            mark, _, end64, _ = struct.unpack("<4sIQI", self.read(at, 20))
            if mark != _LOCATE64:
                raise ArchiveError(f"{self.path}: no ZIP64 locator")
            mark, *_, n, size, begin = struct.unpack("<4sQHHIIQQQQ", self.read(end64, 56))
            if mark != _END64:
                raise ArchiveError(f"{self.path}: no ZIP64 end record")
        self.directory = begin
        raw, at, out = self.read(begin, size), 0, []
        for _ in range(n):
            mark, _, _, _, method, _, _, crc, packed, whole, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
            if mark != _CENTRAL:
                raise ArchiveError(f"{self.path}: broken central directory")
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:
                    big = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    whole = big.pop(0) if whole == _MAX32 else whole
                    packed = big.pop(0) if packed == _MAX32 else packed
                    header = big.pop(0) if header == _MAX32 else header
                extra = extra[4 + length :]
            out.append(Member(name, header, whole, crc, method == 0 and packed == whole))
            at += 46 + n_name + n_extra + n_note
        return out

    def begin(self, m: Member) -> int:
        """Where the member's bytes begin."""
        if not m.stored:
            raise ArchiveError(f"{self.path}: {m.name} is not a stored member")
        mark, *_, n_name, n_extra = struct.unpack("<4sHHHHHIIIHH", self.read(m.header, 30))
        if mark != _LOCAL:
            raise ArchiveError(f"{self.path}: no local header at {m.header}")
        return m.header + 30 + n_name + n_extra

    def member_at(self, header: int) -> tuple[Member, int]:
        """The member whose local header is at ``header``, and the place after its bytes."""
        mark, _, flags, method, _, _, crc, packed, whole, n_name, n_extra = struct.unpack("<4sHHHHHIIIHH", self.read(header, 30))
        if mark != _LOCAL:
            raise ArchiveError(f"{self.path}: no local header at {header}")
        if flags & 8:
            raise ArchiveError(f"{self.path}: the sizes at {header} follow the bytes")
        more = self.read(header + 30, n_name + n_extra)
        extra = more[n_name:]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:
                big = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                whole = big.pop(0) if whole == _MAX32 else whole
                packed = big.pop(0) if packed == _MAX32 else packed
            extra = extra[4 + length :]
        m = Member(more[:n_name].decode(), header, whole, crc, method == 0 and packed == whole)
        return m, header + 30 + n_name + n_extra + packed

    def data(self, m: Member) -> bytes:
        data = self.read(self.begin(m), m.size)
        if zlib.crc32(data) != m.crc:
            raise ArchiveError(f"{self.path}: wrong checksum of {m.name}")
        return data
