"""Expert Witness images (``.E01``): random reads over all segments, without a native library."""

from __future__ import annotations

import glob
import os
import struct
import zlib

# Fixed values of the format.
MAGIC = (b"EVF\x09\x0d\x0a\xff\x00", b"LVF\x09\x0d\x0a\xff\x00")
SECTION = 76


class EwfImage:
    """A seekable view of the media in an image; chunks are decompressed as they are read."""

    def __init__(self, path: str) -> None:
        stem = path[:-2]
        segments = sorted(p for p in glob.glob(glob.escape(stem) + "??") if p[-2:].isalnum())
        segments = [path] + [p for p in segments if os.path.basename(p).lower() > os.path.basename(path).lower()]
        self.files = [open(p, "rb") for p in segments]
        self.chunk, self.size = 32768, 0
        #: (file, offset, length, compressed) of each chunk
        self.chunks: list[tuple[int, int, int, bool]] = []
        for k in range(len(self.files)):
            self._sections(k)
        self.cached: tuple[int, bytes] = (-1, b"")

    def _sections(self, k: int) -> None:
        f = self.files[k]
        if f.read(8) not in MAGIC:
            raise ValueError(f"not an image segment: {f.name}")
        at, data_end = 13, 0
        while True:
            f.seek(at)
            head = f.read(SECTION)
            if len(head) < SECTION:
                return
            kind = head[:16].rstrip(b"\0").decode()
            following, size = struct.unpack_from("<QQ", head, 16)
            if kind in ("volume", "disk", "data") and not self.size:
                body = f.read(28)
                _, sectors_a_chunk, sector = struct.unpack_from("<III", body, 4)
                self.chunk = sectors_a_chunk * sector
                self.size = struct.unpack_from("<Q", body, 16)[0] * sector
            elif kind == "sectors":
                data_end = at + size
            elif kind == "table":
                body = f.read(size - SECTION)
                n, base = struct.unpack_from("<I", body)[0], struct.unpack_from("<Q", body, 8)[0]
                entries = struct.unpack_from(f"<{n}I", body, 24)
                places = [base + (e & 0x7FFFFFFF) for e in entries]
                ends = [*places[1:], data_end or at]
                self.chunks += [(k, p, z - p, bool(e >> 31)) for p, z, e in zip(places, ends, entries, strict=True)]
            if kind in ("done", "next") or following <= at:
                return
            at = following

    def _chunk(self, n: int) -> bytes:
        if self.cached[0] != n:
            k, at, length, packed = self.chunks[n]
            self.files[k].seek(at)
            data = self.files[k].read(length)
            self.cached = n, zlib.decompress(data) if packed else data[: self.chunk]
        return self.cached[1]

    def read(self, offset: int, count: int) -> bytes:
        out = []
        end = min(offset + count, self.size)
        while offset < end:
            n, skip = divmod(offset, self.chunk)
            piece = self._chunk(n)[skip : skip + end - offset]
            if not piece:
                break
            out.append(piece)
            offset += len(piece)
        return b"".join(out)

    def close(self) -> None:
        for f in self.files:
            f.close()


