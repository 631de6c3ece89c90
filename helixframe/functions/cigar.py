"""CIGAR texts as column expressions. ``*`` is the empty CIGAR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operation letters by code, and what they consume.
OPS = "MIDNSHP=X"
QUERY, REF, MATCH = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X"), ("M", "=", "X")
INSERTION, DELETION, HARD = ("I", "S"), ("D", "N"), ("H", "P")
#: Lengths of 28 bits fit the binary form.
MOST_LENGTH = (1 << 28) - 1

_ONE = "([0-9]+)([MIDNSHP=X])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ops(cigar: Column | str = "cigar") -> Column:
    """array<struct<len:int,op:string>>; operations of length 0 are dropped."""
    c = _col(cigar)
    both = F.zip_with(F.regexp_extract_all(c, F.lit(_ONE), F.lit(1)), F.regexp_extract_all(c, F.lit(_ONE), F.lit(2)), lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))
    return F.filter(both, lambda x: x["len"] > 0)


def is_valid(cigar: Column | str = "cigar") -> Column:
    """``*``, or operations of positive length under 2**28 and nothing else."""
    c = _col(cigar)
    shape = (c == "*") | c.rlike("^(0*[1-9][0-9]{0,8}[MIDNSHP=X])+$")
    return shape & ~F.exists(F.regexp_extract_all(c, F.lit(_ONE), F.lit(1)), lambda n: F.coalesce(n.try_cast("long"), F.lit(MOST_LENGTH + 1)) > MOST_LENGTH)


def code(op: Column | str = "op") -> Column:
    """0 to 8, -1 for any other letter."""
    return F.position(_col(op), F.lit(OPS)) - 1


def letter(number: Column) -> Column:
    return F.substring(F.lit(OPS), number + 1, F.lit(1))


def op_class(op: Column | str = "op") -> Column:
    """0 match, 1 insertion (I S), 2 deletion (D N), 3 hard clipping (H P)."""
    o = _col(op)
    return F.when(o.isin(*MATCH), 0).when(o.isin(*INSERTION), 1).when(o.isin(*DELETION), 2).when(o.isin(*HARD), 3)


def _total(array: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(array, F.lit(0), lambda s, x: s + F.when(x["op"].isin(*kinds), x["len"]).otherwise(0))


def ref_len(cigar: Column | str = "cigar") -> Column:
    """Reference positions that the CIGAR spans."""
    return _total(ops(cigar), REF)


def query_len(cigar: Column | str = "cigar") -> Column:
    """Query bases that the CIGAR spans."""
    return _total(ops(cigar), QUERY)


def _leading(array: Column, counted: tuple[str, ...], passed: tuple[str, ...], left: bool) -> Column:
    """Lengths of ``counted`` before the first operation that is in neither."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        on = s["on"] & x["op"].isin(*counted, *passed)
        return F.struct(F.when(on & x["op"].isin(*counted), s["sum"] + x["len"]).otherwise(s["sum"]).alias("sum"), on.alias("on"))

    return F.aggregate(array if left else F.reverse(array), start, step, lambda s: s["sum"])


def hard_clipping(cigar: Column | str = "cigar", left: bool = True) -> Column:
    """Length of the run of H and P at one end."""
    return _leading(ops(cigar), HARD, (), left)


def soft_clipping(cigar: Column | str = "cigar", left: bool = True) -> Column:
    """Lengths of I and S at one end, before any match or deletion; H and P are passed over."""
    return _leading(ops(cigar), INSERTION, HARD, left)


def text(array: Column) -> Column:
    """The text of an array of operations."""
    shown = F.array_join(F.transform(array, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(F.size(array) == 0, "*").otherwise(shown)


def end(start: Column | str = "start", cigar: Column | str = "cigar") -> Column:
    """Past-last reference position; 0 for an empty CIGAR."""
    return F.when(_col(cigar) == "*", 0).otherwise(_col(start) + ref_len(cigar))
