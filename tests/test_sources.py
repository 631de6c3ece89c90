"""Sources and sinks through Spark."""

import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import tags
from helixframe.operators import pairs, records, regions
from helixframe.operators.regions import Region
from helixframe.plans import fixture as fx
from helixframe.sources import bam, bgzf, bgzf_codec, files, sam
from helixframe.sources.header import Header

HEAD = Header("@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n")
LINES = ["Read_1\t16\tchr1\t11\t0\t2M1I1M\t*\t0\t0\tACGT\t+5?+\tNM:i:1", "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "m\t1\tchr2\t1\t60\t4M\t=\t101\t100\tacgt\t*\tXF:f:0.5\tXB:B:c,1,-1"]


def test_text_golden(spark, tmp_path):
    (tmp_path / "x.sam").write_text(HEAD.text() + "\n".join(LINES) + "\n")
    df = sam.read(spark, str(tmp_path / "x.sam"))
    rows = {r["qname"]: r for r in df.collect()}
    r = rows["Read_1"]
    assert (r["start"], r["end"], r["flag"], r["ref_id"], r["rname"], r["mate_start"]) == (10, 13, 16, 0, "chr1", -1)
    assert rows["u"]["ref_id"] == -1 and rows["u"]["bin"] == 4680 and rows["m"]["mate_ref_id"] == 1 and rows["m"]["seq"] == "ACGT"
    out = sorted(x["value"] for x in sam.encode(df, HEAD).collect())
    assert out == sorted([LINES[0], LINES[1], LINES[2].replace("acgt", "ACGT")])
    got = pairs.aligned_pairs(df.filter("qname = 'Read_1'")).select("q_pos", "r_pos").collect()
    assert [tuple(x) for x in got] == [(0, 10), (1, 11), (2, None), (3, 12)]
    got = pairs.matching_pairs(df.filter("qname = 'Read_1'")).select("q_pos", "r_pos").collect()
    assert [tuple(x) for x in got] == [(0, 10), (1, 11), (3, 12)]
    got = pairs.pileup_entries(df.filter("qname = 'Read_1'")).select("r_pos", "kind", "bases", "quals").collect()
    assert [tuple(x) for x in got] == [(10, "Nucleotide", "A", "+"), (11, "Insertion", "CG", "5?"), (12, "Nucleotide", "T", "+")]


@pytest.mark.parametrize("bad", ["a\t0\tchr1", "a\tx\tchr1\t1\t0\t1M\t*\t0\t0\tA\t!", "a\t0\tchr9\t1\t0\t1M\t*\t0\t0\tA\t!", "a\t0\tchr1\t1\t0\t0M\t*\t0\t0\tA\t!", "a\t0\tchr1\t1\t0\t1M\t*\t0\t0\tA\t!!", "a\t0\tchr1\t1\t0\t1M\t*\t0\t0\tU\t!", "a\t0\tchr1\t1\t300\t1M\t*\t0\t0\tA\t!", "a\t0\tchr1\t-5\t0\t1M\t*\t0\t0\tA\t!"])
def test_text_modes(spark, bad):
    lines = spark.createDataFrame([(x,) for x in [bad, LINES[0]]], "value string")
    with pytest.raises(Exception):
        sam.decode(lines, HEAD).collect()
    assert [r["qname"] for r in sam.decode(lines, HEAD, "DROPMALFORMED").collect()] == ["Read_1"]
    assert sum(r["_corrupt"] is not None for r in sam.decode(lines, HEAD, "PERMISSIVE").collect()) == 1


def write(spark, df, path, **options):
    cols = [c for c in bam._NAMES if c != "_corrupt"]
    df.select(*cols, F.lit(None).cast("string").alias("_corrupt")).write.format("alignments_bam").options(**options).mode("append").save(path)


@pytest.fixture(scope="module")
def indexed(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x")
    head = fx.header(spark, data)
    write(spark, records.in_order(fx.records(spark, data), 1), path, header=head.text(), index="true")
    return path, head


def read(spark, path, **options):
    return spark.read.format("alignments_bam").options(modificationTime="ignore", **options).load(path)


def test_random_regions(spark, indexed):
    path, head = indexed
    rnd = random.Random(5)
    full = read(spark, path).cache()
    for _ in range(6):
        s = rnd.randrange(99_000)
        r = Region(rnd.randrange(5), s, s + rnd.randrange(1, 3000))
        want = sorted(x["qname"] for x in regions.fetch(full, r, head).collect())
        got = sorted(x["qname"] for x in regions.fetch(read(spark, path, index="true"), r, head).collect())
        assert got == want


def test_index_prunes(indexed):
    path, _ = indexed
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    reader = bam.AlignmentReader({"path": path, "index": "true", "modificationTime": "ignore"})
    list(reader.pushFilters([EqualTo(("ref_id",), 2), LessThan(("start",), 1400), GreaterThan(("end",), 1000)]))
    decoded = sum(1 for p in reader.partitions() for _ in reader._records(p))
    assert 6 <= decoded < 600  # of 6,000


def test_stale_index(spark, indexed):
    path, _ = indexed
    file = files.listing(path, ".bam")[0]
    os.utime(f"{file}.bai", (1, 1))
    with pytest.raises(ValueError, match="older"):
        bam.check_age(file, f"{file}.bai", "error")
    with pytest.warns(UserWarning):
        bam.check_age(file, f"{file}.bai", "warn")
    bam.check_age(file, f"{file}.bai", "ignore")
    os.utime(f"{file}.bai")


def test_region_errors(indexed):
    _, head = indexed
    with pytest.raises(ValueError):
        Region(0, 5, 4)
    with pytest.raises(ValueError):
        Region(9, 0, 1).check(head)
    with pytest.raises(ValueError):
        Region(0, 0, 300_000).check(head)


def test_truncated_file(spark, indexed, tmp_path):
    file = files.listing(indexed[0], ".bam")[0]
    raw = open(file, "rb").read()
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception):
        read(spark, str(tmp_path / "cut.bam")).count()
    n = read(spark, str(tmp_path / "cut.bam"), mode="DROPMALFORMED").count()
    assert 0 < n < 6000
    assert read(spark, str(tmp_path / "cut.bam"), mode="PERMISSIVE").filter("_corrupt is not null").count() == 1


def test_python_predicate(spark, data):
    rows = fx.alignments(spark, data)
    a = regions.fetch_by(rows, Region(2, 1000, 9000), F.col("mapq") >= 30).count()
    assert a == regions.fetch_by(rows, Region(2, 1000, 9000), lambda b: b["mapq"] >= 30).count() > 0


def test_blocks(spark, tmp_path):
    raw = [bytes([65 + i]) * (100 * i + 1) for i in range(20)]
    with open(tmp_path / "x.gz", "wb") as out:
        w = bgzf_codec.Writer(out)
        for r in raw:
            w.write(r)
            w.flush()
        w.finish()
    df = spark.read.format("bgzf_blocks").option("splitSize", "100").load(str(tmp_path / "x.gz"))
    rows = sorted(df.filter("isize > 0").collect(), key=lambda r: r["coffset"])
    assert [bytes(r["data"]) for r in rows] == raw and df.rdd.getNumPartitions() > 3
    whole = spark.read.format("bgzf_blocks").option("compressed", "true").load(str(tmp_path / "x.gz")).orderBy("coffset").collect()
    assert b"".join(bytes(r["compressed"]) for r in whole) == (tmp_path / "x.gz").read_bytes()
    a, b = rows[3]["coffset"], rows[5]["coffset"]
    part = spark.read.format("bgzf_blocks").option("chunks", f"{(a << 16) + 7}-{(b << 16) + 9}").load(str(tmp_path / "x.gz")).collect()
    assert b"".join(bytes(r["data"]) for r in sorted(part, key=lambda r: r["coffset"])) == raw[3][7:] + raw[4] + raw[5][:9]
    with pytest.raises(Exception, match="sorted and disjoint"):
        spark.read.format("bgzf_blocks").option("chunks", "5-9,3-4").load(str(tmp_path / "x.gz")).count()


def test_overwrite_and_setters(spark, data, tmp_path):
    path = str(tmp_path / "o")
    head = fx.header(spark, data)
    rows = fx.records(spark, data).limit(50)
    for mode, want in (("append", 50), ("append", 100), ("overwrite", 50)):
        cols = [c for c in bam._NAMES if c != "_corrupt"]
        rows.select(*cols, F.lit(None).cast("string").alias("_corrupt")).write.format("alignments_bam").options(header=head.text()).mode(mode).save(path)
        assert read(spark, path).count() == want
    with pytest.raises(Exception):
        records.set_place(rows, start=-2).count() if False else records.set_place(rows, start=-2).collect()
    with pytest.raises(Exception):
        records.set_seq_qual(rows, F.lit("ACGT"), F.lit("!!")).collect()
    assert records.set_cigar(rows, "5M").select("end", "start").filter("end <> start + 5").count() == 0
    assert rows.select(tags.get("tags", "RG")["s"]).first()[0]


def test_files_are_cut_without_an_index(spark, indexed, tmp_path):
    path, _ = indexed
    want = sorted(map(tuple, read(spark, path).select("qname", "start", "cigar", "seq").collect()))
    df = read(spark, path, splitSize="20000")
    assert df.rdd.getNumPartitions() > 5 and sorted(map(tuple, df.select("qname", "start", "cigar", "seq").collect())) == want
    # the same bytes in blocks that end anywhere, with empty ones between
    with files.open_input(files.listing(path, ".bam")[0]) as f:
        raw = bgzf_codec.Reader(f).read(1 << 30)
    rnd, at = random.Random(3), 0
    with open(tmp_path / "any.bam", "wb") as out:
        while at < len(raw):
            n = rnd.choice([0, 1, 30, 700, 5000, 60_000])
            out.write(b"".join(bgzf_codec.blocks_for(raw[at : at + n])))
            at += n
        out.write(bgzf_codec.END)
    for split in (300, 5000, 70_001):
        reader = bam.AlignmentReader({"path": str(tmp_path / "any.bam"), "splitSize": str(split)})
        got = [b[i].as_py() for p in reader.partitions() for t in reader.read(p) for b in [t.column("qname")] for i in range(len(b))]
        assert sorted(got) == [x[0] for x in want]


FAILS = """
import sys
from pyspark.sql import SparkSession, functions as F
from pyspark import TaskContext
sys.path.insert(0, sys.argv[1])
from helixframe.plans import fixture as fx
from helixframe.sources import bam, register
spark = register(SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
def first_fails(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise ValueError("lost")
rows = fx.records(spark, sys.argv[2]).repartition(3)
rows = rows.select(*[F.lit(None).cast("string").alias(c) if c == "_corrupt" else F.col(c) for c in bam._NAMES])
n = rows.count()
for mode, want in (("append", n), ("overwrite", n), ("overwrite", n)):
    rows.mapInArrow(first_fails, rows.schema).write.format("alignments_bam").options(header=fx.header(spark, sys.argv[2]).text()).mode(mode).save(sys.argv[3] + "/bam")
    assert spark.read.format("alignments_bam").load(sys.argv[3] + "/bam").count() == want
blocks = spark.range(10).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("coffset"), F.lit(0).alias("bsize"), F.lit(0).alias("isize"), F.lit(0).cast("bigint").alias("crc32"), F.col("id").cast("string").cast("binary").alias("data"))
for mode, want in (("overwrite", 10), ("overwrite", 10), ("append", 20)):
    blocks.mapInArrow(first_fails, blocks.schema).write.format("bgzf_blocks").mode(mode).save(sys.argv[3] + "/bgzf")
    assert spark.read.format("bgzf_blocks").load(sys.argv[3] + "/bgzf").filter("isize > 0").count() == want
print("as many as written")
"""


def test_failed_attempts_leave_nothing(data, tmp_path):
    out = subprocess.run([sys.executable, "-c", FAILS, os.path.dirname(os.path.dirname(os.path.abspath(__file__))), data, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert "as many as written" in out.stdout, out.stderr[-2000:]
    assert sorted({n.split("-")[0] for n in os.listdir(tmp_path / "bam")}) == ["part"]


def test_only_committed_attempts_are_seen(tmp_path):
    w = bgzf.BlockWriter({"path": str(tmp_path / "b")}, False)
    batch = pa.RecordBatch.from_pydict({"data": [b"x"]})
    one, two = w.write(iter([batch])), w.write(iter([batch]))  # as a speculative copy of a task does
    with pytest.raises(FileNotFoundError):
        files.listing(str(tmp_path / "b"), "")
    w.commit([two])
    assert os.listdir(tmp_path / "b") == two.names and one.names != two.names
    w = bgzf.BlockWriter({"path": str(tmp_path / "b")}, True)
    w.write(iter([batch]))
    w.abort([None])  # as a job does that was told of nothing
    assert os.listdir(tmp_path / "b") == two.names


def test_index_summary(spark):
    from helixframe.functions.binning import SUMMARY_BIN
    from helixframe.sources.bai_codec import Index

    index = Index([({SUMMARY_BIN: [(100, 900), (7, 2)], 0: [(100, 900)]}, [100]), ({}, [])], 5)
    again = Index.parse(index.binary())
    got = again.summary(spark).collect()
    assert [tuple(r) for r in got] == [(0, 100, 900, 7, 2), (None, None, None, None, 5)]
    assert Index.parse(index.binary()[:-8]).summary(spark).filter("ref_id is null").first()["n_unmapped"] is None


def test_regions_of_all_lengths(spark, data):
    rnd = random.Random(9)
    rows = fx.records(spark, data).cache()
    rs = [(i, rnd.randrange(5), s, s + rnd.choice([0, 1, 40, 1023, 1024, 1025, 5000, 90_000])) for i in range(60) for s in [rnd.randrange(100_000)]]
    df = spark.createDataFrame(rs, "region_id int, ref_id int, start int, end int")
    plain = [(r["qname"], r["ref_id"], r["start"], r["end"]) for r in rows.select("qname", "ref_id", "start", "end").collect()]
    want = sorted((i, q) for i, ref, s, e in rs for q, a, b, c in plain if a == ref and b < e and c > s)
    for most in (1000, 10):  # broadcast, and by a shuffle
        assert sorted(map(tuple, regions.fetch_many(rows, df, most).select("region_id", "qname").collect())) == want
    assert regions.fetch_many(rows, df.limit(0)).count() == 0


def test_raw_setters_say_no(spark, data):
    rows = fx.records(spark, data).limit(5)
    for packed, quals, n in (("12", None, 4), ("1248", "0102", 4), ("12488F", "0102030405", 4)):
        with pytest.raises(Exception, match="go together"):
            records.set_raw_seq_qual(rows, F.unhex(F.lit(packed)), None if quals is None else F.unhex(F.lit(quals)), n).collect()
    r = records.set_raw_seq_qual(rows, F.unhex(F.lit("1248")), F.unhex(F.lit("FFFFFFFF")), 4).first()
    assert (r["seq"], r["qual"]) == ("ACGT", None)
    assert records.set_raw_seq_qual(rows, F.unhex(F.lit("")), None, 0).first()["seq"] == "*"
    with pytest.raises(Exception, match="no alignment"):
        records.set_raw_cigar(rows, F.array(F.lit(16 * 3 + 9))).collect()
    assert records.set_raw_cigar(rows, F.array(F.lit(0))).first()["cigar"] == "*"


def test_text_stream(spark, tmp_path):
    from helixframe.streaming import read_text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text("\n".join(LINES) + "\n")
    q = read_text_stream(spark, str(tmp_path / "in"), HEAD).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 3
