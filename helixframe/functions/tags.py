"""Typed record tags, kept in order and with duplicates, as arrays of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.schema import TAG

# Integer types with their ranges, in the order in which a width is chosen.
UNSIGNED = (("C", 0xFF), ("S", 0xFFFF), ("I", 0xFFFFFFFF))
SIGNED = (("c", -0x80), ("s", -0x8000), ("i", -0x80000000))
RANGES = {"c": (-0x80, 0x7F), "C": (0, 0xFF), "s": (-0x8000, 0x7FFF), "S": (0, 0xFFFF), "i": (-0x80000000, 0x7FFFFFFF), "I": (0, 0xFFFFFFFF)}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is named: it is a lambda's variable.
    Inside lambdas Spark works out repeated parts again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag(name: Column | str, type_: Column | str, *, subtype: Column | None = None, i: Column | None = None, f: Column | None = None, s: Column | None = None, ia: Column | None = None, fa: Column | None = None) -> Column:
    """One tag; name and type given as str are literals."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = lambda x, kind: (F.lit(None) if x is None else x).cast(kind)
    return F.struct(lit(name).alias("name"), lit(type_).alias("type"), none(subtype, "string").alias("subtype"), none(i, "bigint").alias("i"), none(f, "float").alias("f"), none(s, "string").alias("s"), none(ia, "array<bigint>").alias("ia"), none(fa, "array<float>").alias("fa"))


def none() -> Column:
    return F.array().cast(f"array<{TAG}>")


def int_type(value: Column) -> Column:
    """The narrowest type letter; values that fit none are an error."""
    out = None
    for letter, most in UNSIGNED:
        cond = (value >= 0) & (value <= most)
        out = F.when(cond, letter) if out is None else out.when(cond, letter)
    for letter, least in SIGNED:
        out = out.when((value < 0) & (value >= least), letter)
    return out.otherwise(F.when(value.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("integer tag out of range"))).cast("string"))


def int_tag(name: str, value: Column) -> Column:
    return tag(name, int_type(value), i=value)


def get(tags: Column | str, name: str) -> Column:
    """The first tag of that name, or NULL."""
    return F.get(F.filter(_col(tags), lambda t: t["name"] == name), 0)


def push(tags: Column | str, new: Column) -> Column:
    """Appends, whatever is there."""
    return F.concat(_col(tags), F.array(new))


def _place(tags: Column, name: Column) -> Column:
    return F.array_position(F.transform(tags, lambda t: t["name"]), name)


def _with_place(tags: Column | str, name: Column, more: Column | None = None) -> Column:
    """struct<t,place,new>: the tags, and the place of the first of a name."""
    return bound(F.struct(_col(tags).alias("t"), name.alias("name"), *([] if more is None else [more.alias("new")])), lambda s: F.struct(s["t"].alias("t"), _place(s["t"], s["name"]).alias("place"), *([] if more is None else [s["new"].alias("new")])))


def insert(tags: Column | str, new: Column) -> Column:
    """Replaces the first tag of its name, or appends."""

    def put(s: Column) -> Column:
        return F.when(s["place"] == 0, push(s["t"], s["new"])).otherwise(F.transform(s["t"], lambda x, i: F.when(i + 1 == s["place"], s["new"]).otherwise(x)))

    return bound(_with_place(tags, new["name"], new), put)


def remove(tags: Column | str, name: str) -> Column:
    """Without the first tag of that name; others of it stay."""
    return bound(_with_place(tags, F.lit(name)), lambda s: F.filter(s["t"], lambda x, i: i + 1 != s["place"]))


def has(tags: Column | str, name: str) -> Column:
    return F.exists(_col(tags), lambda t: t["name"] == name)


def array_length(value: Column) -> Column:
    return F.coalesce(F.size(value["ia"]), F.size(value["fa"]))


def plain_float(x: Column) -> Column:
    """A float in as few digits as tell it apart, without exponent or needless ``.0``."""
    text = F.abs(x).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1).try_cast("int")).otherwise(0)
    point = F.length(F.substring_index(mantissa, ".", 1)) + power
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
    shown = (
        F.when(n == 0, "0")
        .when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
        .when(n <= point, F.concat(digits, zeros(point - n)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(text == "Infinity", F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, shown))


def sam_text(tags: Column | str = "tags") -> Column:
    """The tags' text, tab-separated; arrays keep their own integer type."""

    def one(x: Column) -> Column:
        kind = F.when(x["type"].isin(*RANGES), "i").otherwise(x["type"])
        items = F.when(x["subtype"] == "f", F.transform(x["fa"], plain_float)).otherwise(x["ia"].cast("array<string>"))
        value = (
            F.when(x["type"].isin(*RANGES), x["i"].cast("string"))
            .when(x["type"] == "f", plain_float(x["f"]))
            .when(x["type"] == "B", F.concat_ws(",", x["subtype"], F.when(F.size(items) > 0, F.array_join(items, ","))))
            .otherwise(x["s"])
        )
        return F.concat_ws(":", x["name"], kind, value)

    return F.array_join(F.transform(_col(tags), one), "\t")


def packed(tags: Column | str = "tags") -> Column:
    """All tags as one text, which goes to Python workers at a fraction of the cost of nested columns:
    name, type (and subtype) and value of each, NUL between them. What has no such form is an error."""

    def one(x: Column) -> Column:
        joined = lambda c: F.when(~F.exists(c, lambda v: v.isNull()), F.array_join(c.cast("array<string>"), ","))
        value = (
            F.when(x["type"].isin(*RANGES), x["i"].cast("string"))
            .when(x["type"] == "f", x["f"].cast("string"))
            .when(x["type"] == "B", F.when(x["subtype"] == "f", joined(x["fa"])).otherwise(joined(x["ia"])))
            .otherwise(x["s"])
        )
        text = F.concat_ws("\0", x["name"], F.concat(x["type"], F.when(x["type"] == "B", x["subtype"]).otherwise("")), value)
        whole = F.length(text) - F.length(F.translate(text, "\0", "")) == 2
        return F.when(whole, text).otherwise(F.raise_error(F.lit("a tag that lacks a part, or a text tag that holds NUL")).cast("string"))

    return F.array_join(F.transform(_col(tags), one), "\0")


def _bad(text: Column) -> Column:
    return F.raise_error(F.concat(F.lit("cannot parse tag '"), text, F.lit("'"))).cast(TAG)


def parse_one(text: Column) -> Column:
    """A tag from ``NM:i:1``; NULL for a text without that shape, an error for a value that doesn't fit."""
    kind = F.substring(text, 4, 1)
    parts = F.struct(text.alias("text"), kind.alias("kind"), F.substring(text, F.lit(6), F.length(text)).alias("value"))
    return bound(parts, lambda p: _parsed(p["text"], p["kind"], p["value"]))


def _parsed(text: Column, kind: Column, value: Column) -> Column:
    name = F.substring(text, 1, 2)
    shape = (F.length(text) >= 5) & (F.substring(text, 3, 1) == ":") & (F.substring(text, 5, 1) == ":")

    def whole(n: Column) -> Column:
        return F.when(n.between(-0x80000000, 0xFFFFFFFF), tag(name, int_type(n), i=n)).otherwise(_bad(text))

    def array(s: Column) -> Column:
        fits = F.lit(False)
        for letter, (lo, hi) in RANGES.items():
            fits = fits | ((s["sub"] == letter) & ~F.exists(s["ints"], lambda x: x.isNull() | (x < lo) | (x > hi)))
        floats = (s["sub"] == "f") & ~F.exists(s["floats"], lambda x: x.isNull())
        return F.when(floats, tag(name, "B", subtype=s["sub"], fa=s["floats"])).when(fits, tag(name, "B", subtype=s["sub"], ia=s["ints"])).otherwise(_bad(text))

    def items(all_: Column) -> Column:
        sub, rest = F.get(all_, F.lit(0)), F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))
        return F.struct(sub.alias("sub"), F.when(sub != "f", F.transform(rest, lambda x: x.try_cast("long"))).alias("ints"), F.when(sub == "f", F.transform(rest, lambda x: x.try_cast("float"))).alias("floats"))

    return (
        F.when(~shape, F.lit(None).cast(TAG))
        .when((kind == "A") & (F.length(value) == 1), tag(name, "A", s=value))
        .when(kind == "i", bound(value.try_cast("long"), whole))
        .when((kind == "f") & value.try_cast("float").isNotNull(), tag(name, "f", f=value.try_cast("float")))
        .when(kind == "Z", tag(name, "Z", s=value))
        .when((kind == "H") & (F.length(value) % 2 == 0), tag(name, "H", s=value))
        .when(kind == "B", bound(bound(F.split(value, ","), items), array))
        .otherwise(_bad(text))
    )


def parse(texts: Column) -> Column:
    """Tags from an array of texts; those without a tag's shape are left out."""
    return F.filter(F.transform(texts, parse_one), lambda t: t.isNotNull())
