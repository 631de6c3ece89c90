"""Rewriting record fields: each setter returns the table with what depends on the field redone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import binning, cigar, sequences


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _need(ok: Column, value: Column, why: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(why)).cast("string").cast("int"))


def derive(df: DataFrame) -> DataFrame:
    """end and bin from start and cigar."""
    return df.withColumn("end", cigar.end("start", "cigar")).withColumn("bin", binning.region_to_bin(F.col("start"), F.col("end")))


def set_name(df: DataFrame, value) -> DataFrame:
    """Names are cut to 254 characters."""
    return df.withColumn("qname", F.substring(_c(value), 1, 254))


def set_flag(df: DataFrame, value) -> DataFrame:
    return df.withColumn("flag", _need(_c(value).between(0, 65535), _c(value).cast("int"), "a flag lies in 0..65535"))


def set_mapq(df: DataFrame, value) -> DataFrame:
    return df.withColumn("mapq", _need(_c(value).between(0, 255), _c(value).cast("int"), "a mapping quality lies in 0..255"))


def set_place(df: DataFrame, **fields) -> DataFrame:
    """ref_id, start, mate_ref_id, mate_start: -1 or more. end and bin follow."""
    for name, value in fields.items():
        if name not in ("ref_id", "start", "mate_ref_id", "mate_start"):
            raise ValueError(f"{name} is no place")
        df = df.withColumn(name, _need(_c(value) >= -1, _c(value).cast("int"), f"{name} is -1 or more"))
    return derive(df)


def set_template_len(df: DataFrame, value) -> DataFrame:
    return df.withColumn("tlen", _c(value).cast("int"))


def set_cigar(df: DataFrame, value) -> DataFrame:
    ok = cigar.is_valid(_c(value))
    return derive(df.withColumn("cigar", F.when(ok, _c(value)).otherwise(F.raise_error(F.lit("no alignment")).cast("string"))))


def set_seq_qual(df: DataFrame, seq, qual=None) -> DataFrame:
    """Bases and qualities (text), which have to be as many if there are any."""
    q = F.lit(None).cast("string") if qual is None else _c(qual)
    ok = sequences.is_valid(_c(seq)) & sequences.same_length(_c(seq), q)
    return df.withColumn("seq", F.when(ok, sequences.normal(_c(seq))).otherwise(F.raise_error(F.lit("bases and qualities don't go together")).cast("string"))).withColumn("qual", q)


def set_raw_cigar(df: DataFrame, words) -> DataFrame:
    """From an array of 32-bit words as files hold them: length in the high 28 bits, operation in the
    low 4. Operations of length 0 are left out."""
    ops = F.filter(F.transform(_c(words), lambda w: w.cast("long").bitwiseAND(0xFFFFFFFF)), lambda w: F.shiftright(w, 4) > 0)
    known = F.forall(ops, lambda w: w.bitwiseAND(15) < len(cigar.OPS))
    shown = F.transform(ops, lambda w: F.concat(F.shiftright(w, 4).cast("string"), F.substring(F.lit("".join(cigar.OPS)), (w.bitwiseAND(15) + 1).cast("int"), F.lit(1))))
    value = F.when(F.size(ops) == 0, "*").otherwise(F.array_join(shown, ""))
    return derive(df.withColumn("cigar", F.when(known, value).otherwise(F.raise_error(F.lit("no alignment")).cast("string"))))


def set_raw_seq_qual(df: DataFrame, packed, quals=None, length=0) -> DataFrame:
    """Bases from bytes of two 4-bit codes each, of which ``length`` count, and qualities from bytes
    without the offset of 33 (none, or a first one of 255: not available). Bytes have to be as many
    as the length asks for."""
    raw, n = _c(packed), _c(length).cast("int")
    q = F.lit(None).cast("binary") if quals is None else _c(quals)
    q = F.when((F.length(q) > 0) & (F.substring(q, 1, 1) != F.lit(b"\xff")), q)
    ok = (F.length(raw) == F.floor((n + 1) / 2)) & (q.isNull() | (F.length(q) == n))
    letters = F.substring(F.translate(F.hex(raw), "0123456789ABCDEF", sequences.ALPHABET), F.lit(1), n)
    of = F.hex(q)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.char(F.conv(F.substring(of, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 33)), "")
    seq = F.when(n == 0, "*").otherwise(letters)
    return df.withColumns({"seq": F.when(ok, seq).otherwise(F.raise_error(F.lit("bases and qualities don't go together")).cast("string")), "qual": text})


def in_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in order of (ref_id, start), those without a reference last: what an indexed file needs."""
    place = F.when(F.col("ref_id") < 0, (1 << 31) - 1).otherwise(F.col("ref_id"))
    rows = df.repartitionByRange(partitions, place, F.col("start")) if partitions else df.repartitionByRange(place, F.col("start"))
    return rows.sortWithinPartitions(place, F.col("start"))
