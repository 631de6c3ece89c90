"""Nucleotide sequences and base qualities as column expressions.

Sequences are texts over ``=ACMGRSVTWYHKDBN``, ``*`` for none; ranges are 0-based, half-open.
Qualities are texts with 33 added, NULL for none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet by code, and the complement of each letter.
ALPHABET = "=ACMGRSVTWYHKDBN"
COMPLEMENT = "=TGKCYSBAWRDMHVN"
_NOT_ACGT = "=MRSVWYHKDB"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(seq: Column | str = "seq") -> Column:
    """Letters of the alphabet in either case, or ``*``."""
    return (_col(seq) == "*") | F.upper(_col(seq)).rlike(f"^[{ALPHABET}]*$")


def normal(seq: Column | str = "seq") -> Column:
    """As it is stored: upper case."""
    return F.upper(_col(seq))


def available(seq: Column | str = "seq") -> Column:
    return ~_col(seq).isin("*", "")


def length(seq: Column | str = "seq") -> Column:
    return F.when(available(seq), F.length(_col(seq))).otherwise(0)


def at(seq: Column | str, i: Column | int) -> Column:
    """The letter at a 0-based place."""
    return F.substring(_col(seq), F.lit(i) + 1 if isinstance(i, int) else i + 1, F.lit(1))


def acgtn_only(seq: Column | str = "seq") -> Column:
    """All but A, C, G and T become N."""
    return F.translate(_col(seq), _NOT_ACGT, "N" * len(_NOT_ACGT))


def complement(seq: Column | str = "seq") -> Column:
    return F.translate(_col(seq), ALPHABET, COMPLEMENT)


def subseq(seq: Column | str, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """Letters from start to end; an open bound is the sequence's."""
    s = _col(seq)
    lo = F.lit(0) if start is None else F.lit(start) if isinstance(start, int) else start
    hi = F.length(s) if end is None else F.lit(end) if isinstance(end, int) else end
    return F.substring(s, lo + 1, hi - lo)


def rev_compl(seq: Column | str, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """Reverse complement of a range."""
    return F.reverse(complement(subseq(seq, start, end)))


def readable(text: Column | str) -> Column:
    """``*`` for an empty or missing sequence or quality text."""
    return F.when(F.coalesce(F.length(_col(text)), F.lit(0)) == 0, "*").otherwise(_col(text))


def raw_qualities(qual: Column | str = "qual") -> Column:
    """array<int> of qualities without 33; NULL for none."""
    q = _col(qual)
    return F.when(F.length(q) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33))


def quality_text(raw: Column) -> Column:
    """The text of raw qualities, which have to lie in 0..93."""
    return F.array_join(F.transform(raw, lambda x: F.char(x + 33)), "")


def same_length(seq: Column | str = "seq", qual: Column | str = "qual") -> Column:
    """Whether qualities, if there, are as many as letters."""
    return _col(qual).isNull() | (F.length(_col(qual)) == length(seq))
