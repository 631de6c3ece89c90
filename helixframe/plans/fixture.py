"""A deterministic alignment table derived from ``lineitem``, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import binning, cigar, tags
from helixframe.sources import register
from helixframe.sources.header import Entry, Header

REF_LEN = 200_000
_SEQ, _QUAL = "ACGTTGCANRGGCATTYCAK", "!5?+IIIIHGFEDCBA@=:<"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return register(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The fixture's columns; tags NM (integer) and RG (text)."""
    n, quantity = F.col("l_linenumber"), F.round("l_quantity").cast("int")
    even = n % 2 == 0
    start = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % 100000
    text = F.concat(F.when(n == 1, "3H").otherwise(""), F.when(even, "5S").otherwise(""), (quantity + 10).cast("string"), F.lit("M"), n.cast("string"), F.lit("I7M"), (n % 4 + 1).cast("string"), F.lit("D12M"))
    length = F.when(even, 5).otherwise(0) + 10 + quantity + n + 19
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(".", F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), F.col("l_partkey").cast("string"), n.cast("string")).alias("qname"),
        (F.when(even, 1).otherwise(0) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(n % 4 == 0, 64).otherwise(0) + F.when(n == 3, 256).otherwise(0) + F.when(F.col("l_returnflag") == "A", 1024).otherwise(0)).alias("flag"),
        (F.col("l_suppkey") % 5).cast("int").alias("ref_id"),
        start.cast("int").alias("start"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"),
        text.alias("cigar"),
        F.when(even, (F.col("l_suppkey") + 1) % 5).otherwise(-1).cast("int").alias("mate_ref_id"),
        F.when(even, (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31 + 150) % 100000).otherwise(-1).cast("int").alias("mate_start"),
        F.when(even, n + 150).otherwise(0).alias("tlen"),
        F.substring(F.repeat(F.lit(_SEQ), 8), (F.col("l_orderkey") % 20 + 1).cast("int"), length).alias("seq"),
        F.when(n != 5, F.substring(F.repeat(F.lit(_QUAL), 8), (F.col("l_partkey") % 20 + 1).cast("int"), length)).alias("qual"),
        n.cast("int").alias("tag_nm"), F.col("l_returnflag").alias("tag_rg"), *more,
    )
    return df.withColumn("end", cigar.end("start", "cigar"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture in the full schema."""
    df = alignments(spark, sf_dir)
    both = F.array(tags.int_tag("NM", F.col("tag_nm").cast("bigint")), tags.tag("RG", "Z", s=F.col("tag_rg")))
    return df.withColumn("tags", both).withColumn("bin", binning.region_to_bin(F.col("start"), F.col("end"))).withColumn("rname", F.lit(None).cast("string")).drop("tag_nm", "tag_rg")


def header(spark: SparkSession, sf_dir: str) -> Header:
    """References named by ``region``, in key order."""
    out = Header().push_entry(Entry.header_line("1.6"))
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # a handful of rows
        out.push_entry(Entry.ref_sequence(r["r_name"], REF_LEN))
    return out.push_comment("derived")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ref_id"), F.col("r_name").alias("rname"), F.lit(REF_LEN).cast("bigint").alias("rlen"))


_EVEN = "l_linenumber % 2 = 0"
_N = "(CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 0 END + 10 + CAST(round(l_quantity) AS INTEGER) + l_linenumber + 19)"


def _sum(ops: str, text: str = "cigar") -> str:
    """SQL for the total length of operations."""
    n, o = (f"regexp_extract_all({text}, '([0-9]+)([MIDNSHP=X])', {k})" for k in (1, 2))
    return f"CAST(coalesce(list_sum(list_transform(range(1, len({n}) + 1), lambda i: CASE WHEN contains('{ops}', {o}[i]) THEN CAST({n}[i] AS INTEGER) ELSE 0 END)), 0) AS INTEGER)"


SUM = _sum
#: Common table expressions ``a`` (the fixture), ``o`` (its operations in order with offsets), ``refs``.
CTE = f"""
    a0 AS (SELECT 'r' || l_orderkey || '.' || l_partkey || '.' || l_linenumber AS qname,
        CASE WHEN {_EVEN} THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 4 = 0 THEN 64 ELSE 0 END
          + CASE WHEN l_linenumber = 3 THEN 256 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 1024 ELSE 0 END AS flag,
        CAST(l_suppkey % 5 AS INTEGER) AS ref_id, CAST((l_partkey * 7919 + l_orderkey * 31) % 100000 AS INTEGER) AS start,
        CAST(round(l_discount * 100) AS INTEGER) * 6 AS mapq,
        CASE WHEN l_linenumber = 1 THEN '3H' ELSE '' END || CASE WHEN {_EVEN} THEN '5S' ELSE '' END || (10 + CAST(round(l_quantity) AS INTEGER)) || 'M' || l_linenumber || 'I7M' || (1 + l_linenumber % 4) || 'D12M' AS cigar,
        CASE WHEN {_EVEN} THEN CAST((l_suppkey + 1) % 5 AS INTEGER) ELSE -1 END AS mate_ref_id,
        CASE WHEN {_EVEN} THEN CAST((l_partkey * 7919 + l_orderkey * 31 + 150) % 100000 AS INTEGER) ELSE -1 END AS mate_start,
        CASE WHEN {_EVEN} THEN 150 + l_linenumber ELSE 0 END AS tlen,
        substr(repeat('{_SEQ}', 8), CAST(l_orderkey % 20 + 1 AS BIGINT), {_N}) AS seq,
        CASE WHEN l_linenumber <> 5 THEN substr(repeat('{_QUAL}', 8), CAST(l_partkey % 20 + 1 AS BIGINT), {_N}) END AS qual,
        CAST(l_linenumber AS INTEGER) AS tag_nm, l_returnflag AS tag_rg, l_orderkey, l_partkey, l_suppkey FROM lineitem),
    a AS (SELECT *, start + {_sum("MDN=X")} AS "end" FROM a0),
    refs AS (SELECT r_regionkey AS ref_id, r_name AS rname, CAST({REF_LEN} AS BIGINT) AS rlen FROM region)"""
OPS = """,
    o0 AS (SELECT row_number() OVER () AS rec, * FROM a),
    o1 AS (SELECT rec, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) + 1)) AS idx, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1) AS ns, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) AS os FROM o0),
    o2 AS (SELECT rec, CAST(idx - 1 AS INTEGER) AS idx, CAST(ns[idx] AS INTEGER) AS len, os[idx] AS op FROM o1),
    o AS (SELECT o2.*, o0.* EXCLUDE (rec),
        coalesce(sum(CASE WHEN contains('MIS=X', op) THEN len ELSE 0 END) OVER w, 0) AS q0, start + coalesce(sum(CASE WHEN contains('MDN=X', op) THEN len ELSE 0 END) OVER w, 0) AS r0,
        CASE WHEN contains('M=X', op) AND lead(op) OVER v = 'I' THEN lead(len) OVER v ELSE 0 END AS ins
      FROM o2 JOIN o0 USING (rec) WINDOW v AS (PARTITION BY rec ORDER BY idx), w AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
