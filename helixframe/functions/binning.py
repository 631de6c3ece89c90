"""Bins of the hierarchical index, virtual offsets, and chunk arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Five levels below the root; (first bin, bits of a bin's length).
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26))
MOST_BIN, SUMMARY_BIN = 37448, 37450


def region_to_bin(start: Column, end: Column) -> Column:
    """The smallest bin that holds a region."""
    last = end - 1
    out = None
    for first, bits in LEVELS:
        same = F.shiftright(start, bits) == F.shiftright(last, bits)
        value = F.shiftright(start, bits) + first
        out = F.when(same, value) if out is None else out.when(same, value)
    return out.otherwise(0)


def region_to_bins(start: Column, end: Column) -> Column:
    """All bins that can hold records of a region, from the root down."""
    last = end - 1
    parts = [F.array(F.lit(0))]
    for first, bits in reversed(LEVELS):
        lo, hi = F.shiftright(start, bits) + first, F.shiftright(last, bits) + first
        parts.append(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")))
    return F.flatten(F.array(*parts))


def bins_of(start: int, end: int) -> list[int]:
    """region_to_bins for plain numbers."""
    return [0] + [b for first, bits in reversed(LEVELS) for b in range(first + (start >> bits), first + ((end - 1) >> bits) + 1)]


def bin_of(start: int, end: int) -> int:
    """region_to_bin for plain numbers."""
    return next((first + (start >> bits) for first, bits in LEVELS if start >> bits == (end - 1) >> bits), 0)


def bin_to_region(number: Column) -> Column:
    """struct<start,end> of a bin; the root has the ends of an int. A bin beyond the last is an error."""
    start, end = F.lit(-(1 << 31)), F.lit((1 << 31) - 1)
    for first, bits in reversed(LEVELS):
        inside = number >= first
        begin = F.shiftleft(number - first, bits)
        start, end = F.when(inside, begin).otherwise(start), F.when(inside, begin + (1 << bits)).otherwise(end)
    ok = (number >= 0) & (number <= MOST_BIN)
    return F.when(ok, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.raise_error(F.lit("no such bin")).cast("struct<start:int,end:int>"))


def virtual_offset(block: Column, within: Column) -> Column:
    return F.shiftleft(block.cast("long"), 16).bitwiseOR(within.cast("long"))


def block_offset(offset: Column) -> Column:
    return F.shiftrightunsigned(offset, 16)


def contents_offset(offset: Column) -> Column:
    return offset.bitwiseAND(65535)


def show_offset(offset: Column) -> Column:
    return F.format_string("c=%d,u=%d", block_offset(offset), contents_offset(offset))


def chunks_intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def chunks_combine(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The chunk over two that overlap or touch; NULL for others."""
    return F.when((s1 <= e2) & (s2 <= e1), F.struct(F.least(s1, s2).alias("vstart"), F.greatest(e1, e2).alias("vend")))
