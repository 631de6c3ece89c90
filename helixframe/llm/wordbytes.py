"""Vectorised words, hashes and slices over Arrow text columns.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; the UTF-8 bytes of a text hold no such byte
inside a longer character, so byte scans and character scans give the same words. Hashes are
64-bit, depend on nothing but the bytes, and are equal on every worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from helixframe.llm.kept import drop

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ODD = mix64(np.arange(1000, 1032, dtype=U64)) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        base = np.full(max(n, 256), 0xB5026F5AA96619E9, U64)
        base[0] = 1
        _POW = np.multiply.accumulate(base)
    return _POW


class Words:
    """The words of a batch of texts: byte spans, and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False, between: np.ndarray = _SPACE):
        """between: which bytes part words."""
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        first, last = int(ends[0]), int(ends[-1])
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        self.text_at = ends - first
        inside = ~between[self.data]
        starts, stops = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = self.text_at[(self.text_at > 0) & (self.text_at < len(self.data))]
        starts[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(starts)
        self.stop = np.flatnonzero(stops) + 1
        self.ptr = np.searchsorted(self.start, self.text_at)
        self.inside = inside

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.stop)

    def owner(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of ``data``."""
    if not len(start):
        return np.zeros(0, U64)
    size = (stop - start).astype(np.int64)
    at = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        val = _BYTE[data[np.repeat(start, size) + within]] * _powers(int(size.max()))[within]
        return mix64(np.add.reduceat(val, at) + size.astype(U64) * _ODD[31])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-item windows of ``h``, in order; the first is h[0:k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n] * _ODD[0]
        for i in range(1, k):
            out = out + h[i : i + n] * _ODD[i]
        return mix64(out + U64(k))


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence, apart from those of full windows."""
    with np.errstate(over="ignore"):
        return mix64(np.array([(h * _ODD[: len(h)]).sum() + U64(7919 * len(h))], U64))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 20, keeping: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds at most ``most`` text bytes, or one text. Unless
    the caller is ``keeping`` something, what the worker kept for other operators goes."""
    if not keeping:
        drop()
    for b in batches:
        col = b.column(b.schema.get_field_index(text)).cast(pa.large_string())
        size = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, np.int64)
        if col.null_count:
            size = np.where(np.asarray(col.is_valid()), size, 0)
        total, at = np.cumsum(size), 0
        while at < len(col):
            gone = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, gone + most, "right")))
            yield b.slice(at, end - at)
            at = end


def planes(a: np.ndarray) -> bytes:
    """The bytes of an integer array, lowest bytes of all items first: high planes compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
