"""Golden vectors of the column functions."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import binning, cigar, flags, sequences, tags


def one(spark, *cols, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(*cols).first()


def test_cigar_goldens(spark):
    c = lambda t: F.lit(t)
    r = one(spark, cigar.ref_len(c("2M1I1M")), cigar.query_len(c("2M1I1M")), cigar.soft_clipping(c("5S3I10M")), cigar.hard_clipping(c("3H5S10M")), cigar.soft_clipping(c("3H5S10M")), cigar.soft_clipping(c("10M2D4S1H"), left=False), cigar.hard_clipping(c("4S1P2H"), left=False), cigar.text(cigar.ops(c("*"))), cigar.end(F.lit(-1), c("*")))
    assert tuple(r) == (3, 4, 8, 3, 5, 4, 3, "*", 0)


@pytest.mark.parametrize("text,ok", [("*", True), ("10M", True), ("0M", False), ("5Q", False), ("M", False), ("5M3", False), ("", False), ("268435455M", True), ("268435456M", False), ("99999999999M", False)])
def test_cigar_validity(spark, text, ok):
    assert one(spark, cigar.is_valid(F.lit(text)))[0] is ok


def test_flags_invert(spark):
    r = one(spark, flags.test("is_mapped", F.lit(0)), flags.test("is_mapped", F.lit(4)), flags.put("set_mapped", True, F.lit(7)), flags.put("set_strand", False, F.lit(0)), flags.put("set_duplicate", F.lit(True), F.lit(0)))
    assert tuple(r) == (True, False, 3, 16, 1024)


def test_sequences(spark):
    s = F.lit("=ACMGRSVTWYHKDBN")
    r = one(spark, sequences.complement(s), sequences.acgtn_only(s), sequences.rev_compl(F.lit("AACG"), 1, 4), sequences.is_valid(F.lit("acgu")), sequences.is_valid(F.lit("acgn")), sequences.readable(F.lit(None).cast("string")), sequences.length(F.lit("*")))
    assert tuple(r) == ("=TGKCYSBAWRDMHVN", "NACNGNNNTNNNNNNN", "CGT", False, True, "*", 0)
    q = one(spark, sequences.raw_qualities(F.lit("+5?+")), sequences.quality_text(F.array(*map(F.lit, [10, 20, 30, 10]))), sequences.raw_qualities(F.lit("")), sequences.raw_qualities(F.lit(None).cast("string")))
    assert tuple(q) == ([10, 20, 30, 10], "+5?+", [], None)


def test_bins(spark):
    for (a, b), want in {(0, 1): 4681, (0, 16384): 4681, (0, 16385): 585, (16383, 16385): 585, (600000, 700000): 73, (0, 1 << 29): 0, (-1, 0): 4680}.items():
        assert one(spark, binning.region_to_bin(F.lit(a), F.lit(b)))[0] == want == binning.bin_of(a, b)
    assert one(spark, binning.region_to_bins(F.lit(0), F.lit(16384)))[0] == [0, 1, 9, 73, 585, 4681] == binning.bins_of(0, 16384)
    for b, want in {0: (-(1 << 31), (1 << 31) - 1), 1: (0, 67108864), 4681: (0, 16384), 37448: (536854528, 536870912)}.items():
        assert tuple(one(spark, binning.bin_to_region(F.lit(b)))[0]) == want
    with pytest.raises(Exception, match="no such bin"):
        one(spark, binning.bin_to_region(F.lit(37449)))


def test_tag_widths(spark):
    for v, want in {255: "C", 256: "S", 65536: "I", -128: "c", -129: "s", -32769: "i", 0: "C"}.items():
        assert one(spark, tags.int_type(F.lit(v).cast("bigint")))[0] == want
    with pytest.raises(Exception, match="out of range"):
        one(spark, tags.int_type(F.lit(1 << 32).cast("bigint")))


@pytest.mark.parametrize("x,want", [(1.0, "1"), (0.5, "0.5"), (-2.25, "-2.25"), (1e10, "10000000000"), (1.5e-5, "0.000015"), (0.0, "0"), (123456.78, "123456.78"), (float("inf"), "inf"), (float("nan"), "NaN"), (-0.001, "-0.001")])
def test_float_text(spark, x, want):
    assert one(spark, tags.plain_float(F.lit(x).cast("float")))[0] == want


def test_tag_texts(spark):
    texts = ["NM:i:-5", "XF:f:1.5", "XZ:Z:a:b", "XH:H:1AE3", "XA:A:q", "XB:B:S,1,65535", "XG:B:f,1,0.25", "bad", "NM:i:7"]
    t = tags.parse(F.array(*map(F.lit, texts)))
    df = spark.range(1).select(t.alias("t"))
    r = df.select(tags.sam_text("t").alias("x"), F.size("t").alias("n"), tags.get("t", "NM")["i"].alias("nm"), tags.sam_text(tags.remove("t", "NM")).alias("y"), tags.sam_text(tags.insert("t", tags.int_tag("NM", F.lit(9).cast("bigint")))).alias("z")).first()
    good = [x for x in texts if x != "bad"]
    assert r["x"].split("\t") == good and r["n"] == 8 and r["nm"] == -5
    assert r["y"].split("\t") == good[1:] and r["z"].split("\t") == ["NM:i:9", *good[1:]]


@pytest.mark.parametrize("text", ["NM:i:x", "NM:i:4294967296", "NM:i:-2147483649", "XF:f:q", "XA:A:qq", "XH:H:1AE", "XB:B:c,200", "XB:B:A,1", "XX:Q:1", "XB:B:C,-1"])
def test_bad_tags(spark, text):
    with pytest.raises(Exception, match="cannot parse tag"):
        spark.range(1).select(F.size(tags.parse(F.array(F.lit(text))))).collect()
