"""Binning indexes: reading, chunks of a region, and building one while records are written."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from helixframe.functions.binning import SUMMARY_BIN, bin_of, bins_of
from helixframe.sources.record_batch import bins


class IndexError_(ValueError):
    """An index that breaks its format."""


class Index:
    """Per reference: bins with chunks of virtual offsets, and the linear index."""

    def __init__(self, refs: list[tuple[dict[int, list[tuple[int, int]]], list[int]]], n_unmapped: int | None = None):
        self.refs, self.n_unmapped = refs, n_unmapped

    @classmethod
    def parse(cls, raw: bytes) -> Index:
        at = 0

        def take(form: str) -> tuple:
            nonlocal at
            out = struct.unpack_from("<" + form, raw, at)
            at += struct.calcsize("<" + form)
            return out

        if raw[:4] != b"BAI\1":
            raise IndexError_("not an alignment index")
        at = 4
        try:
            refs = []
            for _ in range(take("i")[0]):
                bins = {}
                for _ in range(take("i")[0]):
                    number, n = take("Ii")
                    offsets = take(f"{2 * n}Q")
                    chunks = list(zip(offsets[::2], offsets[1::2]))
                    if number != SUMMARY_BIN and any(a >= b for a, b in chunks):
                        raise IndexError_("a chunk ends before it begins")
                    bins[number] = chunks
                refs.append((bins, list(take(f"{take('i')[0]}Q"))))
        except struct.error:
            raise IndexError_("the index is cut off") from None
        return cls(refs, take("Q")[0] if at + 8 <= len(raw) else None)

    def binary(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.refs))]
        for bins, linear in self.refs:
            out.append(struct.pack("<i", len(bins)))
            for number in sorted(bins):
                flat = [x for c in bins[number] for x in c]
                out.append(struct.pack(f"<Ii{len(flat)}Q", number, len(bins[number]), *flat))
            out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
        if self.n_unmapped is not None:
            out.append(struct.pack("<Q", self.n_unmapped))
        return b"".join(out)

    def chunks(self, ref_id: int, start: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks that can hold records of a region; what ends before the linear index's
        entry for the region's start is left out."""
        if not 0 <= ref_id < len(self.refs):
            raise IndexError_(f"the index has no reference {ref_id}")
        bins, linear = self.refs[ref_id]
        least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
        return merge(c for b in bins_of(max(start, 0), max(end, start + 1)) for c in bins.get(b, ()) if c[1] > least)

    def starts(self) -> list[int]:
        """Virtual offsets at which records begin."""
        return sorted({a for bins, _ in self.refs for b, chunks in bins.items() if b != SUMMARY_BIN for a, _ in chunks})

    def summary(self, spark: SparkSession) -> DataFrame:
        """ref_id, vstart, vend, n_mapped, n_unmapped: what the index says of each reference that has
        a summary bin; the row without ref_id has the number of records without a place (or NULL)."""
        rows = [(r, *pair[0], *pair[1]) for r, (bins, _) in enumerate(self.refs) if len(pair := bins.get(SUMMARY_BIN, ())) == 2]
        return spark.createDataFrame([*rows, (None, None, None, None, self.n_unmapped)], "ref_id int, vstart bigint, vend bigint, n_mapped bigint, n_unmapped bigint")

    def df(self, spark: SparkSession) -> DataFrame:
        """ref_id, bin, vstart, vend."""
        rows = [(r, b, s, e) for r, (bins, _) in enumerate(self.refs) for b, chunks in bins.items() if b != SUMMARY_BIN for s, e in chunks]
        return spark.createDataFrame(rows, "ref_id int, bin int, vstart bigint, vend bigint")


def merge(chunks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted chunks; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(chunks):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Builder:
    """Builds an index from records in order of (reference, start), those without one last."""

    def __init__(self, n_refs: int):
        self.refs = [({}, {}) for _ in range(n_refs)]
        self.n_unmapped, self.last = 0, (0, -1)

    def add(self, ref_id: int, start: int, end: int, vstart: int, vend: int) -> None:
        if ref_id < 0:
            self.n_unmapped += 1
            self.last = (1 << 32, 0)
            return
        if (ref_id, start) < self.last:
            raise ValueError("records of an indexed file have to be in order")
        self.last = (ref_id, start)
        bins, linear = self.refs[ref_id]
        end = max(end, start + 1)
        chunks = bins.setdefault(bin_of(max(start, 0), end), [])
        if chunks and chunks[-1][1] == vstart:
            chunks[-1] = (chunks[-1][0], vend)
        else:
            chunks.append((vstart, vend))
        for w in range(max(start, 0) >> 14, ((end - 1) >> 14) + 1):
            linear.setdefault(w, vstart)

    def add_all(self, ref_id: np.ndarray, start: np.ndarray, end: np.ndarray, vstart: np.ndarray, vend: np.ndarray) -> None:
        """As ``add``, for many records: by runs of records of one bin that lie together."""
        here = np.flatnonzero(ref_id >= 0)
        order = np.where(ref_id >= 0, (ref_id << 32) + start, 1 << 62)
        past = np.maximum.accumulate(np.concatenate([[min((self.last[0] << 32) + self.last[1], 1 << 62)], order]))
        if (order[here] < past[here]).any():
            raise ValueError("records of an indexed file have to be in order")
        self.n_unmapped += len(ref_id) - len(here)
        if not len(here):
            self.last = (1 << 32, 0) if len(ref_id) else self.last
            return
        self.last = (int(ref_id[-1]), int(start[-1])) if ref_id[-1] >= 0 else (1 << 32, 0)
        ref, start, vstart, vend = ref_id[here], start[here], vstart[here], vend[here]
        end = np.maximum(end[here], start + 1)
        start = np.maximum(start, 0)
        number = bins(start, end)
        new = np.flatnonzero((ref[1:] != ref[:-1]) | (number[1:] != number[:-1]) | (vend[:-1] != vstart[1:])) + 1
        first, last = np.concatenate([[0], new]), np.concatenate([new, [len(ref)]]) - 1
        for r, b, a, z in zip(ref[first].tolist(), number[first].tolist(), vstart[first].tolist(), vend[last].tolist()):
            chunks = self.refs[r][0].setdefault(b, [])
            if chunks and chunks[-1][1] == a:
                chunks[-1] = (chunks[-1][0], z)
            else:
                chunks.append((a, z))
        low, high = start >> 14, (end - 1) >> 14
        reach = (ref << 32) + high  # windows up to the furthest of earlier records have their entries
        fresh = np.concatenate([[True], reach[1:] > np.maximum.accumulate(reach)[:-1]])
        for r, a, z, v in zip(*(x[fresh].tolist() for x in (ref, low, high, vstart))):
            linear = self.refs[r][1]
            for w in range(a, z + 1):
                linear.setdefault(w, v)

    def index(self) -> Index:
        refs = []
        for bins, linear in self.refs:
            filled, last = [], 0
            for w in range(max(linear) + 1 if linear else 0):
                last = linear.get(w, last)
                filled.append(last)
            refs.append((bins, filled))
        return Index(refs, self.n_unmapped)
