"""The text alignment format, by Spark's own text reader and writer and column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import binning, cigar, sequences, tags
from helixframe.schema import COLUMNS
from helixframe.sources import files
from helixframe.sources.header import Header

#: References up to this many are broadcast to the records; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000


def read_header(spark: SparkSession, path: str) -> Header:
    """The header lines of the first file at a path, up to its first record."""
    lines: list[str] = []
    with files.open_input(files.listing(path, "")[0]) as f:
        text, at, rest = "", 0, b""
        while chunk := f.read_at(1 << 16, at):
            at += len(chunk)
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if not line.startswith(b"@"):
                    return Header("\n".join(lines))
                lines.append(line.decode())
        text = rest.decode()
    return Header("\n".join([*lines, *([text] if text.startswith("@") else [])]))


def _small(df: DataFrame, header: Header) -> DataFrame:
    return F.broadcast(df) if header.n_references <= MOST_BROADCAST else df


def decode(lines: DataFrame, header: Header, mode: str = "FAILFAST") -> DataFrame:
    """Records from a ``value`` column of text lines; header lines are passed over."""
    mode = mode.upper()
    if mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
        raise ValueError("mode is one of FAILFAST, DROPMALFORMED, PERMISSIVE")
    refs = header.ref_sequences(lines.sparkSession)
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.filter(~F.col("value").startswith("@") & (F.length("value") > 0)).select(
        "value", at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("_rname"), (at(3).try_cast("int") - 1).alias("start"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"),
        at(6).alias("_mate"), (at(7).try_cast("int") - 1).alias("mate_start"), at(8).try_cast("int").alias("tlen"), sequences.normal(at(9)).alias("seq"), at(10).alias("_qual"), F.size(f).alias("_n"),
        F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))).alias("_tags"),
    )
    by = lambda out: refs.select(F.col("ref_id").alias(out), F.col("rname").alias(f"_{out}"))
    rows = rows.join(_small(by("_ref"), header), F.col("_rname") == F.col("__ref"), "left").join(_small(by("_mref"), header), F.col("_mate") == F.col("__mref"), "left")
    rows = rows.withColumns({
        "ref_id": F.when(F.col("_rname") == "*", -1).otherwise(F.col("_ref")),
        "mate_ref_id": F.when(F.col("_mate") == "*", -1).when(F.col("_mate") == "=", F.when(F.col("_rname") == "*", -1).otherwise(F.col("_ref"))).otherwise(F.col("_mref")),
        "qual": F.when((F.col("seq") == "*") | (F.col("_qual") == "*"), F.lit(None)).otherwise(F.col("_qual")),
    })
    letters = "^[!-~]*$"
    why = (
        F.when(F.col("_n") < 11, "fewer than 11 fields")
        .when(F.col("flag").isNull() | ~F.col("flag").between(0, 65535), "no flag")
        .when(F.col("ref_id").isNull() | F.col("mate_ref_id").isNull(), "a reference that the header lacks")
        .when(F.col("start").isNull() | (F.col("start") < -1) | F.col("mate_start").isNull() | (F.col("mate_start") < -1) | F.col("tlen").isNull(), "no place")
        .when(F.col("mapq").isNull() | ~F.col("mapq").between(0, 255), "no mapping quality")
        .when(~cigar.is_valid("cigar"), "no alignment")
        .when(~sequences.is_valid("seq"), "no sequence")
        .when(F.col("qual").isNotNull() & ~F.col("qual").rlike(letters), "no qualities")
        .when(~sequences.same_length("seq", "qual"), "qualities are not as many as bases")
    )
    rows = rows.withColumn("_corrupt", why)
    if mode == "FAILFAST":
        rows = rows.withColumn("_corrupt", F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.col("_corrupt"), F.lit(": "), F.col("value")))).otherwise(F.lit(None)).cast("string"))
        # the error has to be reached whatever columns are read
        rows = rows.filter(F.col("_corrupt").isNull())
    elif mode == "DROPMALFORMED":
        rows = rows.filter(F.col("_corrupt").isNull())
    ok = F.col("_corrupt").isNull()
    end = cigar.end("start", "cigar")
    rows = rows.withColumn("tags", F.when(ok, tags.parse(F.col("_tags")))).withColumn("end", F.when(ok, end)).withColumn("bin", F.when(ok, binning.region_to_bin(F.col("start"), end)))
    rows = rows.withColumn("rname", F.when(F.col("ref_id") >= 0, F.col("_rname")))
    keep = lambda c: F.col(c) if c in ("_corrupt",) else F.when(ok, F.col(c)).alias(c)
    return rows.select(*[keep(c) for c in COLUMNS])


def read(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Records of text files at a path."""
    return decode(spark.read.text(path), read_header(spark, path), mode)


def encode(df: DataFrame, header: Header) -> DataFrame:
    """A ``value`` column of text lines."""
    refs = header.ref_sequences(df.sparkSession)
    by = lambda out: refs.select(F.col("ref_id").alias(out), F.col("rname").alias(f"{out}_name"))
    rows = df.join(_small(by("_r"), header), F.col("ref_id") == F.col("_r"), "left").join(_small(by("_m"), header), F.col("mate_ref_id") == F.col("_m"), "left")
    mate = F.when(F.col("mate_ref_id") < 0, "*").when(F.col("mate_ref_id") == F.col("ref_id"), "=").otherwise(F.col("_m_name"))
    fields = [F.col("qname"), F.col("flag"), F.coalesce("_r_name", F.lit("*")), F.col("start") + 1, F.col("mapq"), F.col("cigar"), mate, F.col("mate_start") + 1, F.col("tlen"), sequences.readable("seq"), sequences.readable("qual")]
    line = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("*")) for c in fields])
    shown = F.coalesce(tags.sam_text("tags"), F.lit(""))
    return rows.select(F.when(shown == "", line).otherwise(F.concat_ws("\t", line, shown)).alias("value"))


def write(df: DataFrame, path: str, header: Header, with_header: bool = True) -> None:
    """Text files at a path; the header is a file of its own that sorts first."""
    encode(df, header).write.text(path)
    if with_header:
        with files.open_output(f"{path.rstrip('/')}/00000-header.sam") as out:
            out.write(header.text().encode())


