"""Blocks, headers, records and indexes: round trips, goldens and broken input."""

import gzip
import io
import random
import struct

import pytest

from helixframe.sources import bgzf_codec as bgzf
from helixframe.sources.bai_codec import Builder, Index, IndexError_, merge
from helixframe.sources.header import Entry, Header, HeaderError
from helixframe.sources.record_codec import RecordError, decode, encode


class File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


ROW = {"qname": "Read_1", "flag": 16, "ref_id": 0, "start": 10, "mapq": 0, "cigar": "2M1I1M", "mate_ref_id": -1, "mate_start": -1, "tlen": 0, "seq": "ACGT", "qual": "+5?+", "tags": []}


def tag(name, kind, **more):
    return {"name": name, "type": kind, "subtype": None, "i": None, "f": None, "s": None, "ia": None, "fa": None} | more


def test_end_block():
    assert len(bgzf.END) == 28 and bgzf.END[16:18] == struct.pack("<H", 27)


@pytest.mark.parametrize("n", [0, 1, 65_280, 65_281, 200_000])
def test_blocks_round_trip(n):
    raw = random.Random(n).randbytes(n)
    for level in (0, 6, 9):
        out = io.BytesIO()
        w = bgzf.Writer(out, level)
        w.write(raw)
        w.finish()
        assert gzip.decompress(out.getvalue()) == raw == bgzf.Reader(File(out.getvalue())).read(n + 5)


def test_virtual_offsets():
    out, w, places, rnd = io.BytesIO(), None, [], random.Random(1)
    w = bgzf.Writer(out)
    parts = [rnd.randbytes(rnd.randrange(1, 9000)) for _ in range(60)]
    for p in parts:
        places.append(w.write(p))
        if rnd.random() < 0.1:
            w.flush()
            for b in bgzf.blocks_for(b""):  # an empty block on the way
                out.write(b)
                w.at += len(b)
    w.finish()
    for at, p in zip(places, parts):
        assert bgzf.Reader(File(out.getvalue()), at).read(len(p)) == p


def test_broken_blocks():
    good = bgzf.blocks_for(b"hello")[0]
    for bad in (b"xx" + good[2:], good[:-8] + b"\0\0\0\0" + good[-4:], good[:-4] + b"\x09\0\0\0", good[:12] + b"XX" + good[14:], good[:-3]):
        with pytest.raises(bgzf.BlockError):
            bgzf.Reader(File(bad)).read(5)
    with pytest.raises(ValueError):
        bgzf.Writer(io.BytesIO(), 10)


def test_header_round_trip():
    h = Header("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:100\tM5:x\n@SQ\tSN:chr2\tLN:4294967295\n@RG\tID:a\tPL:b\tPL:c\n@CO\tfree\ttext\n")
    again = Header.from_binary(io.BytesIO(h.binary()).read)
    assert again.text() == h.text() and again.names == ["chr1", "chr2"] and h.is_sorted()
    assert h.reference_id("chr2") == 1 and h.reference_name(2) is None and h.reference_len(-1) is None
    e = Entry.read_group("x").push("PL", "a").push("PL", "b")
    e.insert("PL", "z")
    assert e.get("PL") == "z" and e.remove("PL") and e.get("PL") == "b" and len(e) == 2 and not e.remove("QQ")


@pytest.mark.parametrize("text", ["@SQ\tSN:a\tLN:0", "@SQ\tSN:a", "@SQ\tLN:5", "@SQ\tSN:a\tLN:5\n@SQ\tSN:a\tLN:6", "@XX\tAB:c", "@CO", "@HD\tV:1", "@SQ\tSN:a\tLN:x"])
def test_bad_headers(text):
    with pytest.raises(HeaderError):
        Header(text)


def test_header_and_binary_have_to_agree():
    raw = Header("@SQ\tSN:a\tLN:5").binary()
    with pytest.raises(HeaderError):
        Header.from_binary(io.BytesIO(raw[:-4] + struct.pack("<I", 6)).read)
    with pytest.raises(HeaderError):
        Header.from_binary(io.BytesIO(b"BAM\2" + raw[4:]).read)


def test_record_round_trip():
    values = [tag("NM", "C", i=1), tag("XA", "A", s="q"), tag("XF", "f", f=1.5), tag("XZ", "Z", s="text"), tag("XH", "H", s="1AE3"), tag("XI", "i", i=-70000), tag("XB", "B", subtype="s", ia=[1, -2]), tag("XG", "B", subtype="f", fa=[0.5]), tag("NM", "C", i=2)]
    for row in (ROW | {"tags": values}, ROW | {"qual": None}, ROW | {"seq": "*", "qual": None, "cigar": "*", "flag": 4, "ref_id": -1, "start": -1}, ROW | {"seq": "acgtn", "qual": "!!!!~", "cigar": "5M"}):
        got = decode(encode(row)[4:], ["chr1"])
        assert {k: got[k] for k in row} == row | {"seq": row["seq"].upper()}
    assert decode(encode(ROW)[4:], ["chr1"])["end"] == 13
    assert decode(encode(ROW | {"cigar": "*", "flag": 4, "ref_id": -1, "start": -1})[4:], ["chr1"])["bin"] == 4680


@pytest.mark.parametrize("n", [65_535, 65_536])
def test_long_cigars(n):
    row = ROW | {"cigar": "".join("1M" if i % 2 else "1I" for i in range(n)), "seq": "A" * n, "qual": None}
    got = decode(encode(row)[4:], ["chr1"])
    assert got["cigar"] == row["cigar"] and got["tags"] == []


def test_soft_clipped_whole_read():
    assert decode(encode(ROW | {"cigar": "4S", "flag": 4})[4:], ["chr1"])["cigar"] == "4S"


@pytest.mark.parametrize("change", [{"cigar": "0M"}, {"cigar": "4Q"}, {"seq": "ACGU"}, {"qual": "+"}, {"qual": "\x7f\x7f\x7f\x7f"}, {"start": -2}, {"tags": [tag("XH", "H", s="1")]}, {"tags": [tag("XZ", "Z", s="a\0b")]}, {"tags": [tag("XC", "C", i=256)]}, {"tags": [tag("XB", "B", subtype="A", ia=[1])]}])
def test_bad_rows(change):
    with pytest.raises(RecordError):
        encode(ROW | change)


def test_bad_records():
    raw = encode(ROW | {"tags": [tag("XZ", "Z", s="abc")]})[4:]
    for bad in (raw[:20], raw[:40], raw[:-1], struct.pack("<i", -2) + raw[4:], struct.pack("<i", 5) + raw[4:], raw[:8] + b"\0" + raw[9:]):
        with pytest.raises(RecordError):
            decode(bad, ["chr1"])
    with pytest.raises(RecordError):
        decode(encode(ROW | {"flag": 4})[4:], ["chr1"], strict=True)


def test_index_round_trip():
    b, rnd, at = Builder(2), random.Random(3), 0
    rows = sorted((rnd.randrange(2), rnd.randrange(10**6)) for _ in range(500))
    spans = []
    for ref, start in rows:
        spans.append((ref, start, start + rnd.randrange(1, 40_000), at, at + 100))
        b.add(*spans[-1])
        at += 100
    b.add(-1, -1, 0, at, at + 50)
    index = Index.parse(b.index().binary())
    assert index.n_unmapped == 1
    for _ in range(100):
        ref, s = rnd.randrange(2), rnd.randrange(10**6)
        e = s + rnd.randrange(1, 50_000)
        chunks = index.chunks(ref, s, e)
        assert chunks == sorted(chunks) and all(a[1] < b[0] for a, b in zip(chunks, chunks[1:]))
        for r, start, end, v, _ in spans:
            if r == ref and start < e and end > s:
                assert any(a <= v < z for a, z in chunks)
    with pytest.raises(IndexError_):
        index.chunks(2, 0, 1)
    with pytest.raises(ValueError):
        b.add(0, 1, 2, 0, 1)
    for bad in (b"BAI\2", b"BAI\1" + struct.pack("<i", 3), b"BAI\1" + struct.pack("<iiIiQQ", 1, 1, 0, 1, 9, 9) + struct.pack("<i", 0)):
        with pytest.raises(IndexError_):
            Index.parse(bad)


def test_merge():
    assert merge([(0, 10), (5, 12), (12, 20), (30, 40), (31, 33)]) == [(0, 20), (30, 40)]


def test_batches_are_as_single_records():
    """Columns at a time and records one by one give the same bytes and rows."""
    import random

    import pyarrow as pa

    from helixframe.sources import bam
    from helixframe.sources.record_batch import decode_batch, encode_batch
    from helixframe.sources.record_codec import decode, encode

    rnd, rows = random.Random(6), []
    names = ["a", "b", "c"]
    tags = [("NM", "i", None, -5, None, None, None, None), ("XA", "A", None, None, None, "q", None, None), ("XF", "f", None, None, 0.5, None, None, None), ("XZ", "Z", None, None, None, "tëxt", None, None), ("XH", "H", None, None, None, "0AFF", None, None), ("XB", "B", "S", None, None, None, [1, 2, 65535], None), ("XG", "B", "f", None, None, None, None, [0.25, -1.0])]
    for i in range(500):
        n = rnd.choice([0, 1, 2, 3, 17, 100])
        cigar = rnd.choice(["*", "5M", f"{n}M" if n else "*", "3S2M1I4D10N2=1X7H", "2P3M"])
        seq, qual = "".join(rnd.choices("ACGTNacgt=", k=n)) or "*", rnd.choice([None, "".join(chr(33 + rnd.randrange(94)) for _ in range(n))]) if n else None
        if qual and qual[0] == chr(33 + 222):
            qual = None
        own = [dict(zip(("name", "type", "subtype", "i", "f", "s", "ia", "fa"), t)) for t in rnd.sample(tags, rnd.randrange(4))]
        ref = rnd.randrange(-1, 3)
        rows.append({"qname": "r" * rnd.randrange(0, 200) + str(i), "flag": rnd.randrange(65536), "ref_id": ref, "rname": None, "start": rnd.choice([-1, 0, 16383, 16384, rnd.randrange(1 << 28)]), "end": 0, "bin": 0, "mapq": rnd.randrange(256), "cigar": cigar, "mate_ref_id": rnd.randrange(-1, 3), "mate_start": rnd.randrange(-1, 99), "tlen": rnd.randrange(-9, 9), "seq": seq, "qual": qual, "tags": own, "_corrupt": None})
    batch = pa.RecordBatch.from_pylist(rows, schema=bam.ARROW).slice(7)
    raws, ends = encode_batch(batch)
    want = [encode(r) for r in batch.to_pylist()]
    assert [bytes(x) for x in raws] == want
    bodies = [x[4:] for x in want]
    one = pa.RecordBatch.from_pylist([decode(x, names) for x in bodies], schema=bam.ARROW)
    every = set(bam._NAMES)
    assert decode_batch(bodies, names, False, every, bam.ARROW).to_pylist() == one.to_pylist()
    assert ends.tolist() == one.column("end").to_pylist()
    part = decode_batch(bodies, names, False, {"seq"}, bam.ARROW)
    assert part.column("seq") == one.column("seq") and part.column("tags").null_count == part.column("qname").null_count == len(bodies)
    # what only single records can say
    for bad in (bodies[0][:40], bodies[0][:-1] + b"", b"\x07" + bodies[0][1:]):
        assert decode_batch([*bodies[1:], bad], names, False, every, bam.ARROW) is None
    for name, value in (("seq", "ACU"), ("cigar", "0M"), ("mapq", 300), ("start", -2), ("qual", "!"), ("qname", "x" * 255)):
        odd = {**rows[50], "seq": "ACG", "qual": None, name: value}
        assert encode_batch(pa.RecordBatch.from_pylist([rows[1], odd], schema=bam.ARROW)) is None
    assert encode_batch(batch.slice(0, 0))[0] == []


def test_header_lines_end_at_line_feeds_only():
    from helixframe.sources.header import Header, HeaderError

    h = Header("@HD\tVN:1.6\r\n@CO\tone\u2028two\x85three\x0cfour\n@SQ\tSN:a\tLN:5\n")
    assert h.n_references == 1 and "one\u2028two\x85three\x0cfour" in h.text()
    with pytest.raises(HeaderError):
        Header("@SQ\tSN:a\tLN:\u00b2\n")
