"""Aligned positions and pileups: records expanded by their CIGARs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import cigar, tags
from helixframe.operators.regions import Region


def placed_ops(start: Column | str = "start", text: Column | str = "cigar") -> Column:
    """array of operations with their first query and reference places (q0, r0), and the insertion
    length (ins) that follows a match at once."""
    s = F.col(start) if isinstance(start, str) else start
    kind = "array<struct<op:string,len:int,q0:int,r0:int,ins:int>>"
    none = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("q"), F.lit(0).alias("r"), F.lit(0).alias("ins"))

    def step(a: Column, x: Column) -> Column:  # from the last operation back, places counted from the end
        q, r = a["q"] + F.when(among(x, cigar.QUERY), x["len"]).otherwise(0), a["r"] + F.when(among(x, cigar.REF), x["len"]).otherwise(0)
        return tags.bound(F.struct(q.alias("q"), r.alias("r")), lambda n: F.struct(F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), n["q"].alias("q0"), n["r"].alias("r0"), F.when(among(x, cigar.MATCH), a["ins"]).otherwise(0).alias("ins")))).alias("out"), n["q"].alias("q"), n["r"].alias("r"), F.when(x["op"] == "I", x["len"]).otherwise(0).alias("ins")))

    among = lambda x, kinds: F.contains(F.lit("".join(kinds)), x["op"])
    done = F.aggregate(F.reverse(cigar.ops(text)), none, step)
    return tags.bound(done, lambda a: F.transform(F.reverse(a["out"]), lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"), (a["q"] - x["q0"]).alias("q0"), (s + a["r"] - x["r0"]).alias("r0"), x["ins"].alias("ins"))))


def _expanded(records: DataFrame, kinds: tuple[str, ...], region: Region | None = None) -> DataFrame:
    """Rows of records with _x (a placed operation) and _k (a place in it)."""
    rows = records.withColumn("_x", F.explode(placed_ops())).filter(F.col("_x.op").isin(*kinds))
    lo, hi = F.lit(0), F.col("_x.len") - 1
    if region:  # only what lies inside
        lo, hi = F.greatest(lo, region.start - F.col("_x.r0")), F.least(hi, region.end - 1 - F.col("_x.r0"))
        rows = rows.filter(hi >= lo)
    return rows.withColumn("_k", F.explode(F.sequence(lo, hi)))


def aligned_pairs(records: DataFrame) -> DataFrame:
    """A row for each aligned place: q_pos, r_pos, NULL where one is absent (insertions and soft
    clips have no r_pos, deletions and skips no q_pos; hard clips and padding give none)."""
    place = lambda base, kinds: F.when(F.col("_x.op").isin(*kinds), F.col(base) + F.col("_k"))
    rows = _expanded(records, tuple(x for x in cigar.OPS if x not in cigar.HARD))
    return rows.withColumn("q_pos", place("_x.q0", cigar.QUERY)).withColumn("r_pos", place("_x.r0", cigar.REF)).drop("_x", "_k")


def matching_pairs(records: DataFrame) -> DataFrame:
    """As aligned_pairs, for places that are in both."""
    return _expanded(records, cigar.MATCH).withColumn("q_pos", F.col("_x.q0") + F.col("_k")).withColumn("r_pos", F.col("_x.r0") + F.col("_k")).drop("_x", "_k")


def pileup_entries(records: DataFrame, region: Region | None = None, keep: Column | None = None) -> DataFrame:
    """A row for each record and reference place: r_pos, kind (Nucleotide, Insertion or Deletion),
    bases (an insertion's begin with the place's own base), quals (text, NULL for none).

    Skips (N) and clips give no entry; an insertion belongs to the base matched before it, one
    without such a base is left out. ``keep`` filters records first.
    """
    rows = records if keep is None else records.filter(keep)
    if region:
        rows = rows.filter((F.col("ref_id") == region.ref_id) & (F.col("start") < region.end) & (F.col("end") > region.start))
    rows = _expanded(rows, (*cigar.MATCH, "D"), region)
    deletion = F.col("_x.op") == "D"
    extra = F.when(F.col("_k") == F.col("_x.len") - 1, F.col("_x.ins")).otherwise(0)
    part = lambda c: F.when(~deletion, F.substring(F.col(c), F.col("_x.q0") + F.col("_k") + 1, 1 + extra))
    kind = F.when(deletion, "Deletion").when(extra > 0, "Insertion").otherwise("Nucleotide")
    quals = part("qual") if "qual" in records.columns else F.lit(None).cast("string")
    return rows.withColumns({"r_pos": F.col("_x.r0") + F.col("_k"), "kind": kind, "bases": part("seq"), "quals": quals}).drop("_x", "_k")


def entry_len(kind: Column | str = "kind", bases: Column | str = "bases") -> Column:
    """1 for a nucleotide, 0 for a deletion, the bases of an insertion."""
    k, b = (F.col(x) if isinstance(x, str) else x for x in (kind, bases))
    return F.when(k == "Deletion", 0).otherwise(F.length(b))


def pileup_depth(records: DataFrame, region: Region | None = None, keep: Column | None = None) -> DataFrame:
    """ref_id, r_pos, depth, and how many entries are of each kind."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"n_{kind.lower()}")
    return pileup_entries(records, region, keep).groupBy("ref_id", "r_pos").agg(F.count("*").alias("depth"), of("Nucleotide"), of("Insertion"), of("Deletion"))
