"""Steps that have to stay cheap with many records: what they do at once is as one by one, and bounded."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import tags
from helixframe.operators import pairs, records, regions
from helixframe.plans import fixture as fx
from helixframe.schema import TAG
from helixframe.sources import bam, bgzf, bgzf_codec, files
from helixframe.sources.bai_codec import Builder
from helixframe.sources.header import Entry, Header
from helixframe.sources.record_codec import encode

HEADER = Header().push_entry(Entry.header_line("1.6")).push_entry(Entry.ref_sequence("a", 1 << 29)).push_entry(Entry.ref_sequence("b", 1 << 29))


def row(i, start, ref=0):
    return {"qname": f"r{i}", "flag": 0, "ref_id": ref, "start": start, "mapq": 9, "cigar": f"{i % 50 + 1}M", "mate_ref_id": -1, "mate_start": -1, "tlen": 0, "seq": "ACGT" * 9, "qual": None, "tags": []}


def test_blocks_and_index_at_once_are_as_one_by_one():
    rnd = random.Random(4)
    sizes = [rnd.choice([10, 300, 5000, 65_280, 70_000, 200_000]) for _ in range(200)]
    data, at = rnd.randbytes(sum(sizes)), np.cumsum([0, *sizes])
    one, many = io.BytesIO(), io.BytesIO()
    w, v = bgzf_codec.Writer(one, 1), bgzf_codec.Writer(many, 1)
    want = [(w.write(data[a:b]), w.tell()) for a, b in zip(at, at[1:])]
    found = [v.write_all(memoryview(data)[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in ((0, 70), (70, 70), (70, 200))]
    assert one.getvalue() == many.getvalue() and want == [x for s, e in found for x in zip(s.tolist(), e.tolist())]
    places = sorted((rnd.randrange(2), rnd.randrange(-1, 10**6)) for _ in range(190)) + [(-1, -1)] * 10
    ends = [s + rnd.choice([0, 5, 40_000, 200_000]) for _, s in places]
    a, b = Builder(2), Builder(2)
    for (r, s), e, (x, y) in zip(places, ends, want):
        a.add(r, s, e, x, y)
    cols = [np.array(c, np.int64) for c in zip(*((r, s, e, x, y) for (r, s), e, (x, y) in zip(places, ends, want)))]
    for i, j in ((0, 30), (30, 30), (30, 195), (195, 200)):
        b.add_all(*(c[i:j] for c in cols))
    assert a.index().binary() == b.index().binary()
    with pytest.raises(ValueError):
        b.add_all(*(np.array([x]) for x in (0, 5, 6, 7, 8)))


def test_pieces_of_a_scan_are_bounded(tmp_path):
    path = str(tmp_path / "x.bam")
    with files.open_output(path) as out:
        w = bgzf_codec.Writer(out, 0)
        w.write(HEADER.binary())
        for i in range(3000):
            w.write(encode(row(i, i)))
        w.finish()
    reader = bam.AlignmentReader({"path": path, "splitSize": "50"})
    parts = reader.partitions()
    assert len(parts) <= bam.MOST_PARTITIONS + 1 < files.size(path) // 50
    names = [x for p in parts for b in reader.read(p) for x in b.column("qname").to_pylist()]
    assert sorted(names) == sorted(f"r{i}" for i in range(3000))


def test_indexes_in_a_named_folder(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(i, i % 700) for i in range(2000)], "i int, start int").selectExpr("concat('r', i) qname", "0 flag", "i % 2 ref_id", "start", "9 mapq", "'36M' cigar", "-1 mate_ref_id", "-1 mate_start", "0 tlen", "repeat('ACGT', 9) seq", "cast(null as string) qual")
    bam.write(records.in_order(rows.withColumn("tags", tags.none()), 3), path, header=HEADER.text(), index="true")
    assert len(files.listing(path, ".bam")) == 3
    found = regions.fetch(spark.read.format("alignments_bam").option("baiPath", path).load(path), regions.Region(1, 100, 200)).select("qname").collect()
    assert sorted(x[0] for x in found) == sorted(f"r{i}" for i in range(2000) if i % 2 and i % 700 < 200 and i % 700 + 36 > 100)


def test_packed_tags_are_written_as_they_are(spark, tmp_path, data):
    some = [("NM", "s", None, -5, None, None, None, None), ("XF", "f", None, None, 0.1, None, None, None), ("XZ", "Z", None, None, None, "tëxt, a", None, None), ("XE", "Z", None, None, None, "", None, None), ("XH", "H", None, None, None, "0AFF", None, None), ("XB", "B", "S", None, None, None, [1, 65535], None), ("XC", "B", "c", None, None, None, [], None), ("XG", "B", "f", None, None, None, None, [0.25, -1.5])]
    rows = fx.records(spark, data).limit(20).drop("tags").crossJoin(spark.createDataFrame([(some,)], f"tags array<{TAG}>"))
    bam.write(rows, str(tmp_path / "x"), header=fx.header(spark, data).text())
    back = spark.read.format("alignments_bam").load(str(tmp_path / "x"))
    assert back.select("tags").collect() == rows.select("tags").collect()
    with pytest.raises(Exception, match="NUL"):
        bad = rows.withColumn("tags", tags.push(tags.none(), tags.tag("XZ", "Z", s=F.lit("a\0b"))))
        bad.select(tags.packed("tags")).collect()


def test_block_pieces_are_bounded_and_short_blocks_are_read_back(tmp_path):
    path = str(tmp_path / "x.gz")
    with files.open_output(path) as out:
        w = bgzf_codec.Writer(out, 6)
        want = [b"", *(bytes([65 + i % 20]) * (i % 700) + b"%d" % i for i in range(3000)), random.Random(2).randbytes(65_000)]
        for x in want:
            w.write(x)
            w.flush()
        w.finish()
    reader = bgzf.BlockReader({"path": path, "splitSize": "40"})
    parts = reader.partitions()
    assert len(parts) <= bgzf.MOST_PARTITIONS + 1
    assert [x for p in parts for b in reader.read(p) for x in b.column("data").to_pylist() if x] == want[1:]
    for n in range(0, 3000, 37):  # at any length and level
        for level in (0, 1, 6, 9):
            (b,) = bgzf_codec.blocks_for(want[-1][:n], level)
            assert bgzf_codec.load(_Bytes(b), 0).contents == want[-1][:n]


class _Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_nested_inserts_do_not_multiply(spark):
    few = many = F.col("tags")
    for i in range(9):
        few, many = (tags.insert(few, tags.int_tag(f"X{i}", F.lit(i))) if i < 3 else few), tags.insert(many, tags.int_tag(f"X{i}", F.lit(i)))
    assert len(str(many)) < 20 * len(str(few))
    got = spark.range(1).select(tags.none().alias("tags")).select(tags.sam_text(many)).first()[0]
    assert got == "\t".join(f"X{i}:i:{i}" for i in range(9))


def test_pairs_of_long_alignments(spark):
    ops = [(i % 5 + 1, "MIDNSHP=X"[i * 7 % 9]) for i in range(600)]
    q = r = 0
    want = []
    for n, op in ops:
        for k in range(n if op not in "HP" else 0):
            want.append((q + k if op in "MIS=X" else None, 50 + r + k if op in "MDN=X" else None))
        q, r = q + n * (op in "MIS=X"), r + n * (op in "MDN=X")
    rows = spark.createDataFrame([(0, 50, "".join(f"{n}{op}" for n, op in ops))], "ref_id int, start int, cigar string")
    assert [tuple(x) for x in pairs.aligned_pairs(rows).select("q_pos", "r_pos").collect()] == want


def test_short_regions_do_not_meet_all_of_a_thousand_places(spark):
    assert regions.LEAST_TILE <= 7
    rows = spark.range(3000).selectExpr("concat('r', id) qname", "0 flag", "0 ref_id", "cast(id as int) start", "cast(id + 60 as int) end")
    wanted = spark.createDataFrame([(1, 0, 1000, 1040), (2, 0, 127, 128), (3, 0, 0, 2900)], "region_id int, ref_id int, start int, end int")
    got = sorted((x[0], x[1]) for x in regions.fetch_many(rows, wanted).select("region_id", "start").collect())
    assert got == sorted((i, s) for i, a, b in ((1, 1000, 1040), (2, 127, 128), (3, 0, 2900)) for s in range(3000) if s < b and s + 60 > a)


def test_equal_chunks_become_one(spark):
    chunks = [(i % 3, s, s + 5) for i in range(300) for s in (0, 10, 13, 40)]
    got = sorted(map(tuple, regions.merge_chunks(spark.createDataFrame(chunks, "bin int, vstart long, vend long"), "bin").collect()))
    assert got == sorted((b, *x) for b in range(3) for x in ((0, 5), (10, 18), (40, 45)))
