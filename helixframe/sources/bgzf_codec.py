"""The block-compressed file format: gzip members of up to 65,536 bytes with their size inside."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

#: Bytes of contents a writer gathers for a block, and of a block at most.
FULL, MOST = 65_280, 65_536


class BlockError(ValueError):
    """A block that isn't one, or whose contents don't fit its sums."""


class Block(NamedTuple):
    offset: int
    size: int
    contents: bytes
    crc32: int


class Buffered:
    """Reads of a file that mostly go forward, a window at a time: one remote read for many blocks."""

    def __init__(self, f, window: int = 1 << 20):
        self.f, self.window, self.at, self.held = f, window, 0, b""

    def read_at(self, n: int, offset: int) -> bytes:
        start = offset - self.at
        if start < 0 or start + n > len(self.held):
            self.at, self.held, start = offset, self.f.read_at(max(n, self.window), offset), 0
        return self.held[start : start + n]


def _size(f, offset: int, head: bytes) -> tuple[int, int | None]:
    """Bytes of a block's header and of all of it, from any extra fields."""
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        raise BlockError(f"no block at {offset}")
    extra = f.read_at(struct.unpack_from("<H", head, 10)[0], offset + 12)
    at, size = 0, None
    while at + 4 <= len(extra):
        name, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if name == b"BC" and n == 2:
            size = struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    return 12 + len(extra), size


def load(f, offset: int) -> Block | None:
    """The block at a file offset; None at the file's end."""
    head = f.read_at(18, offset)
    if not head:
        return None
    if head[:4] == b"\x1f\x8b\x08\x04" and head[10:16] == b"\x06\0BC\2\0" and len(head) == 18:  # as nearly all are
        start, size = 18, (head[16] | head[17] << 8) + 1
    else:
        start, size = _size(f, offset, head[:12])
    if size is None or size < start + 8:
        raise BlockError(f"block at {offset} does not tell its size")
    rest = f.read_at(size - start, offset + start)
    if len(rest) < size - start:
        raise BlockError(f"block at {offset} is cut off")
    crc, want = struct.unpack_from("<II", rest, len(rest) - 8)
    if want > MOST:
        raise BlockError(f"block at {offset} claims {want} bytes")
    inflate = zlib.decompressobj(-15)
    try:
        contents = inflate.decompress(rest[:-8], want + 1)
    except zlib.error as e:
        raise BlockError(f"block at {offset}: {e}") from None
    if len(contents) != want:
        raise BlockError(f"block at {offset} has not the {want} bytes it claims")
    if zlib.crc32(contents) != crc:
        raise BlockError(f"block at {offset} differs from its checksum")
    return Block(offset, size, contents, crc)


def next_block(f, at: int, end: int) -> int | None:
    """Where the first block at or after a file offset begins, if that is before ``end``: what looks
    like one has to inflate to its checksum, and so has the block after it."""
    raw, i = f.read_at(2 * MOST, at), -1
    while (i := raw.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0 and at + i < end:
        try:
            b = load(f, at + i)
            load(f, at + i + b.size)
            return at + i
        except BlockError:
            pass
    if i < 0 and len(raw) == 2 * MOST and at + len(raw) < end:
        raise BlockError(f"no block after {at}")
    return None


def blocks_for(contents: bytes, level: int = 6) -> list[bytes]:
    """Contents as one block, or as several if compression leaves them too large."""
    n = len(contents)  # what deflate has to clear before it starts is as large as its window and tables: small ones do for short contents
    bits = min(15, max(9, (2 * n + 300).bit_length()))
    deflate = zlib.compressobj(level, zlib.DEFLATED, -bits, min(8, max(1, n.bit_length() - 5)))
    body = deflate.compress(contents) + deflate.flush()
    size = 18 + len(body) + 8
    if len(contents) > MOST or size > MOST:
        half = len(contents) // 2
        return blocks_for(contents[:half], level) + blocks_for(contents[half:], level)
    head = struct.pack("<4sIBBH2sHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"BC", 2, size - 1)
    return [head + body + struct.pack("<II", zlib.crc32(contents), len(contents))]


#: The empty block that ends a file.
END = blocks_for(b"")[0]


class Reader:
    """Bytes from a virtual offset on; empty blocks on the way are passed over."""

    def __init__(self, f, start: int = 0, window: int = 1 << 20):
        """window: bytes that are read at once."""
        self.f = Buffered(f, window)
        self.seek(start)

    def seek(self, virtual: int) -> None:
        self.at, self.block = virtual >> 16, None
        self.within = virtual & 0xFFFF

    def _fill(self) -> bool:
        """Makes the block at hand one with bytes left; False at the file's end."""
        while self.block is None or self.within >= len(self.block.contents):
            if self.block is not None:
                self.at += self.block.size
                self.within -= len(self.block.contents)
            self.block = load(self.f, self.at)
            if self.block is None:
                return False
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte."""
        if self.block is not None and self.within >= len(self.block.contents):
            return (self.at + self.block.size) << 16
        return (self.at << 16) | self.within

    def next(self) -> int | None:
        """The virtual offset of the next byte, beyond empty blocks; None at the file's end."""
        return self.tell() if self._fill() else None

    def rest(self) -> bytes:
        """What is left of the block at hand, which is passed over."""
        part = self.block.contents[self.within :]
        self.within += len(part)
        return part

    def read(self, n: int) -> bytes:
        """n bytes, or fewer at the file's end."""
        parts = []
        while n and self._fill():
            part = self.block.contents[self.within : self.within + n]
            self.within += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


class Writer:
    """Gathers bytes to blocks. A record goes to one block unless it is larger than that."""

    def __init__(self, out, level: int = 6):
        if not 0 <= level <= 9:
            raise ValueError("compressionLevel has to lie in 0..9")
        self.out, self.level, self.held, self.at = out, level, bytearray(), 0

    def tell(self) -> int:
        return (self.at << 16) | len(self.held)

    def flush(self) -> None:
        while self.held:
            part = bytes(self.held[:FULL])
            del self.held[:FULL]
            for b in blocks_for(part, self.level):
                self.out.write(b)
                self.at += len(b)

    def write(self, record: bytes) -> int:
        """Writes bytes that belong together; returns the virtual offset where they begin."""
        if self.held and len(self.held) + len(record) > FULL:
            self.flush()
        start = self.tell()
        self.held += record
        if len(self.held) >= FULL:
            self.flush()
        return start

    def write_all(self, data: bytes | memoryview, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes records that lie one after another, from at[i] to at[i + 1] each, as ``write`` does;
        returns the virtual offsets where each begins and where the next can begin."""
        i, n = 0, len(at) - 1
        starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while i < n:
            base, held = int(at[i]), len(self.held)
            j = int(np.searchsorted(at, base + FULL - held, "right")) - 1  # records i to j fit
            if j <= i and held:
                self.flush()
                continue
            j = max(j, i + 1)
            here = (self.at << 16) + held - base
            starts[i:j], ends[i:j] = at[i:j] + here, at[i + 1 : j + 1] + here
            self.held += data[base : int(at[j])]
            if len(self.held) >= FULL:
                self.flush()
                ends[j - 1] = self.tell()
            i = j
        return starts, ends

    def finish(self) -> None:
        self.flush()
        self.out.write(END)
        self.at += len(END)
