"""Archives inside media: zip members and gzip streams at any byte."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

# Fixed values of the formats and of the limits on what is expanded.
ZIP_MAGIC = b"PK\x03\x04"
GZIP_MAGIC = b"\x1f\x8b\x08"
GZIP_FLAGS = (0, 2, 4)
ZIP_MOST = 16 << 20
ZIP_LEAST = 6
ZIP_NAME_MOST = 1024
GZIP_MOST = 256 << 20
DEPTH = 7


def inflate(data: bytes, most: int, wbits: int, step: int = 4096) -> bytes:
    """What can be decompressed before the first error or the limit."""
    tool, out, size = zlib.decompressobj(wbits), [], 0

    def feed(piece: bytes) -> bool:
        nonlocal size
        got = tool.decompress(piece, most - size)
        out.append(got)
        size += len(got)
        return size < most and not tool.eof

    at = 0
    while at < len(data):
        before = tool.copy()
        try:
            if not feed(data[at : at + step]):
                break
        except zlib.error:
            # Only this piece is broken: go through it byte by byte.
            tool = before
            try:
                for k in range(at, min(at + step, len(data))):
                    if not feed(data[k : k + 1]):
                        break
            except zlib.error:
                pass
            break
        at += step
    return b"".join(out)


def zip_member(data: bytes, at: int) -> bytes:
    """Content of the zip member whose local header is at ``at``; empty if there is none."""
    if len(data) < at + 30 or data[at : at + 4] != ZIP_MAGIC:
        return b""
    packed, plain, name, extra = struct.unpack_from("<IIHH", data, at + 18)
    begin = at + 30 + name + extra
    if not 0 < name <= ZIP_NAME_MOST or begin >= len(data):
        return b""
    end = len(data) if packed == 0 or begin + packed > len(data) else begin + packed
    most = ZIP_MOST if packed == 0 or packed > ZIP_MOST else min(plain, ZIP_MOST)
    return inflate(data[begin:end], most, -15) if most >= ZIP_LEAST else b""


def gzip_stream(data: bytes, at: int) -> bytes:
    """Content of the gzip stream that begins at ``at``; empty if there is none."""
    return inflate(data[at:], GZIP_MOST, 31) if len(data) >= at + 18 and is_gzip(data, at) else b""


def is_gzip(data: bytes, at: int) -> bool:
    return data[at : at + 3] == GZIP_MAGIC and len(data) > at + 8 and data[at + 8] in GZIP_FLAGS


def found(data: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(offset, kind, content) of every archive that begins in the data, in the order of offsets."""
    z, g = data.find(ZIP_MAGIC), data.find(GZIP_MAGIC)
    while z >= 0 or g >= 0:
        if g < 0 or 0 <= z < g:
            if content := zip_member(data, z):
                yield z, "zip", content
            z = data.find(ZIP_MAGIC, z + 1)
        else:
            if is_gzip(data, g) and (content := gzip_stream(data, g)):
                yield g, "gzip", content
            g = data.find(GZIP_MAGIC, g + 1)


def expand(data: bytes, depth: int = DEPTH) -> Iterator[tuple[str, bytes]]:
    """(path, content) of all archives inside, to the given depth; a path is ``offset-kind`` joined by hyphens."""
    stack = [(iter(found(data)), "", 1)]
    while stack:
        items, path, level = stack[-1]
        item = next(items, None)
        if item is None:
            stack.pop()
            continue
        here = f"{path}{'-' if path else ''}{item[0]}-{item[1]}"
        yield here, item[2]
        if level < depth:
            stack.append((iter(found(item[2])), here, level + 1))


def read(data: bytes, path: str, count: int) -> bytes:
    """``count`` bytes at a path such as ``1000-zip-0``, fewer at the end, none past it."""
    parts = path.split("-")
    if len(parts) % 2 == 0 or not all(p.isdigit() for p in parts[::2]) or not all(k in ("zip", "gzip") for k in parts[1::2]):
        raise ValueError(f"invalid path: {path}")
    for at, kind in zip(parts[::2], parts[1::2], strict=False):
        data = (zip_member if kind == "zip" else gzip_stream)(data, int(at)) if int(at) < len(data) else b""
    return bytes(data[int(parts[-1]) : int(parts[-1]) + count])
