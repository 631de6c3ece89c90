"""Registered queries over the derived alignment table, each with its oracle in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import binning, cigar, flags, sequences, tags
from helixframe.operators import pairs, records, regions
from helixframe.operators.regions import Region
from helixframe.plans import fixture as fx
from helixframe.runtime import scratch
from helixframe.sources import bam, bgzf, sam
from helixframe.sources.header import Header
from helixframe.streaming import read_text_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REGION = Region(2, 1000, 1400)
_IN = "ref_id = 2 AND start < 1400 AND \"end\" > 1000"


def query(sql: str, ops: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {fx.CTE}{fx.OPS if ops else ''} {sql}"
        return f

    return add


def _a(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return fx.alignments(spark, d, *more)


# --- regions and flags


@query(f"SELECT qname, flag, start, \"end\", mapq, cigar FROM a WHERE {_IN}")
def region_fetch(spark, d):
    return regions.fetch(_a(spark, d), REGION, fx.header(spark, d)).select("qname", "flag", "start", "end", "mapq", "cigar")


@query(f"SELECT qname, flag, start, \"end\", mapq FROM a WHERE {_IN} AND mapq >= 30 AND flag & 256 = 0")
def region_fetch_by(spark, d):
    return regions.fetch_by(_a(spark, d), REGION, (F.col("mapq") >= 30) & ~flags.test("is_secondary")).select("qname", "flag", "start", "end", "mapq")


@query("SELECT CAST(r.l_orderkey AS BIGINT) AS region_id, a.qname, a.start FROM a JOIN (SELECT DISTINCT l_orderkey, CAST(l_suppkey % 5 AS INTEGER) AS ref, CAST(l_orderkey * 97 % 90000 AS INTEGER) AS s FROM lineitem WHERE l_linenumber = 1) r ON a.ref_id = r.ref AND a.start < r.s + 40 AND a.\"end\" > r.s")
def region_fetch_many(spark, d):
    start = (F.col("l_orderkey") * 97 % 90000).cast("int")
    rs = fx.table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("region_id"), (F.col("l_suppkey") % 5).cast("int").alias("ref_id"), start.alias("start"), (start + 40).alias("end")).distinct()
    rows = fx.records(spark, d)
    return regions.fetch_many(rows, rs).select("region_id", "qname", "start")


_PRED = [f"flag & {bit} {'<>' if on else '='} 0 AS {name}" for name, (bit, on) in flags.PREDICATES.items()]


@query(f"SELECT qname, start, {', '.join(_PRED)} FROM a")
def flag_decode(spark, d):
    return _a(spark, d).select("qname", "start", *[flags.test(n).alias(n) for n in flags.PREDICATES])


_ON = [f"{'flag | ' + str(bit) if on else 'flag & ' + str(0xFFFF & ~bit)} AS {name}" for name, (bit, on) in flags.SETTERS.items()]
_OFF = [f"{'flag & ' + str(0xFFFF & ~bit) if on else 'flag | ' + str(bit)} AS un_{name}" for name, (bit, on) in flags.SETTERS.items()]


@query(f"SELECT qname, start, {', '.join(_ON + _OFF)} FROM a")
def flag_set_clear(spark, d):
    return _a(spark, d).select("qname", "start", *[flags.put(n, True).alias(n) for n in flags.SETTERS], *[flags.put(n, False).alias(f"un_{n}") for n in flags.SETTERS])


# --- CIGAR


@query(f"SELECT qname, start, {fx.SUM('MDN=X')} AS ref_len, {fx.SUM('MIS=X')} AS query_len FROM a")
def cigar_lengths(spark, d):
    return _a(spark, d).select("qname", "start", cigar.ref_len().alias("ref_len"), cigar.query_len().alias("query_len"))


@query("""SELECT qname, start, CAST(coalesce(sum(len) FILTER (contains('IS', op) AND idx < lo), 0) AS INTEGER) AS soft_left, CAST(coalesce(sum(len) FILTER (contains('IS', op) AND idx > hi), 0) AS INTEGER) AS soft_right,
    CAST(coalesce(sum(len) FILTER (contains('HP', op) AND idx < hlo), 0) AS INTEGER) AS hard_left, CAST(coalesce(sum(len) FILTER (contains('HP', op) AND idx > hhi), 0) AS INTEGER) AS hard_right
    FROM (SELECT *, min(CASE WHEN contains('MDN=X', op) THEN idx END) OVER (PARTITION BY rec) AS lo, max(CASE WHEN contains('MDN=X', op) THEN idx END) OVER (PARTITION BY rec) AS hi,
      min(CASE WHEN NOT contains('HP', op) THEN idx END) OVER (PARTITION BY rec) AS hlo, max(CASE WHEN NOT contains('HP', op) THEN idx END) OVER (PARTITION BY rec) AS hhi FROM o) GROUP BY rec, qname, start""", ops=True)
def cigar_clipping(spark, d):
    return _a(spark, d).select("qname", "start", cigar.soft_clipping(left=True).alias("soft_left"), cigar.soft_clipping(left=False).alias("soft_right"), cigar.hard_clipping(left=True).alias("hard_left"), cigar.hard_clipping(left=False).alias("hard_right"))


@query("SELECT qname, start, idx, len, op, CAST(position(op IN 'MIDNSHP=X') - 1 AS INTEGER) AS code, CASE WHEN contains('M=X', op) THEN 0 WHEN contains('IS', op) THEN 1 WHEN contains('DN', op) THEN 2 ELSE 3 END AS class FROM o", ops=True)
def cigar_ops_exploded(spark, d):
    rows = _a(spark, d).select("qname", "start", F.posexplode(cigar.ops()).alias("idx", "x"))
    return rows.select("qname", "start", "idx", "x.len", "x.op", cigar.code("x.op").alias("code"), cigar.op_class("x.op").alias("class"))


@query("SELECT op, CASE WHEN contains('M=X', op) THEN 0 WHEN contains('IS', op) THEN 1 WHEN contains('DN', op) THEN 2 ELSE 3 END AS class, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM o GROUP BY op", ops=True)
def cigar_class_totals(spark, d):
    return _a(spark, d).select(F.explode(cigar.ops()).alias("x")).groupBy(F.col("x.op").alias("op"), cigar.op_class("x.op").alias("class")).agg(F.count("*").alias("n"), F.sum("x.len").alias("total"))


@query("SELECT qname, start, cigar, true AS valid FROM a")
def cigar_text_roundtrip(spark, d):
    return _a(spark, d).select("qname", "start", cigar.text(cigar.ops()).alias("cigar"), cigar.is_valid().alias("valid"))


@query("SELECT ref_id, CAST(r_pos // 1000 AS BIGINT) AS piece, count(*) AS n, count(q_pos) AS n_query, CAST(coalesce(sum(q_pos), 0) AS BIGINT) AS sum_q FROM (SELECT ref_id, CASE WHEN contains('MIS=X', op) THEN q0 + k END AS q_pos, CASE WHEN contains('MDN=X', op) THEN r0 + k END AS r_pos FROM (SELECT *, unnest(range(len)) AS k FROM o WHERE NOT contains('HP', op))) GROUP BY ALL", ops=True)
def aligned_pairs(spark, d):
    rows = pairs.aligned_pairs(_a(spark, d).select("ref_id", "start", "cigar"))
    return rows.groupBy("ref_id", F.floor(F.col("r_pos") / 1000).alias("piece")).agg(F.count("*").alias("n"), F.count("q_pos").alias("n_query"), F.coalesce(F.sum("q_pos"), F.lit(0)).alias("sum_q"))


@query(f"SELECT qname, start, CAST(q0 + k AS INTEGER) AS q_pos, CAST(r0 + k AS INTEGER) AS r_pos FROM (SELECT *, unnest(range(len)) AS k FROM o WHERE {_IN} AND contains('M=X', op))", ops=True)
def region_matching_pairs(spark, d):
    return pairs.matching_pairs(regions.fetch(_a(spark, d), REGION)).select("qname", "start", "q_pos", "r_pos")


@query("SELECT ref_id, CAST(r_pos // 1000 AS BIGINT) AS piece, count(*) AS n, CAST(sum(q_pos) AS BIGINT) AS sum_q FROM (SELECT ref_id, q0 + k AS q_pos, r0 + k AS r_pos FROM (SELECT *, unnest(range(len)) AS k FROM o WHERE contains('M=X', op))) GROUP BY ALL", ops=True)
def matching_pairs(spark, d):
    return pairs.matching_pairs(_a(spark, d).select("ref_id", "start", "cigar")).groupBy("ref_id", F.floor(F.col("r_pos") / 1000).alias("piece")).agg(F.count("*").alias("n"), F.sum("q_pos").alias("sum_q"))


# --- sequences and qualities

_TR = f"translate({{}}, '{sequences.ALPHABET}', '{sequences.COMPLEMENT}')"


@query(f"SELECT qname, start, length(seq) AS n, {_TR.format('seq')} AS compl, reverse({_TR.format('seq')}) AS rev_compl, translate(seq, '=MRSVWYHKDB', 'NNNNNNNNNNN') AS acgtn, substr(seq, 4, 7) AS part, reverse({_TR.format('substr(seq, 4, 7)')}) AS part_rev, substr(seq, 3, 1) AS third FROM a")
def sequence_functions(spark, d):
    return _a(spark, d).select("qname", "start", sequences.length().cast("bigint").alias("n"), sequences.complement().alias("compl"), sequences.rev_compl("seq").alias("rev_compl"), sequences.acgtn_only().alias("acgtn"), sequences.subseq("seq", 3, 10).alias("part"), sequences.rev_compl("seq", 3, 10).alias("part_rev"), sequences.at("seq", 2).alias("third"))


@query("SELECT qname, start, coalesce(qual, '*') AS shown, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS BIGINT) AS total, CAST(list_max(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS INTEGER) AS best, qual AS again, true AS fits FROM a")
def quality_functions(spark, d):
    raw = sequences.raw_qualities()
    total = F.when(F.col("qual").isNotNull(), F.aggregate(raw, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return _a(spark, d).select("qname", "start", sequences.readable("qual").alias("shown"), total.alias("total"), F.array_max(raw).alias("best"), sequences.quality_text(raw).alias("again"), sequences.same_length().alias("fits"))


# --- bins, offsets, chunks

_BIN = "CASE " + " ".join(f"WHEN {{0}} >> {bits} = ({{1}} - 1) >> {bits} THEN {first} + ({{0}} >> {bits})" for first, bits in binning.LEVELS) + " ELSE 0 END"


@query(f"SELECT qname, start, \"end\", CAST({_BIN.format('start', '\"end\"')} AS INTEGER) AS bin FROM a")
def record_end_bin(spark, d):
    return _a(spark, d).select("qname", "start", "end", binning.region_to_bin(F.col("start"), F.col("end")).alias("bin"))


@query("SELECT bin, count(*) AS n FROM (SELECT unnest([0]) AS bin FROM a UNION ALL " + " UNION ALL ".join(f"SELECT unnest(range({first} + (start >> {bits}), {first} + (((\"end\" + 30000) - 1) >> {bits}) + 1)) FROM a" for first, bits in binning.LEVELS) + ") GROUP BY bin")
def region_bins(spark, d):
    return _a(spark, d).select(F.explode(binning.region_to_bins(F.col("start"), F.col("end") + 30000)).alias("bin")).groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


_B2R = " ".join(f"WHEN b >= {first} THEN (b - {first}) << {bits}" for first, bits in binning.LEVELS)
_LEN = " ".join(f"WHEN b >= {first} THEN ((b - {first}) << {bits}) + {1 << bits}" for first, bits in binning.LEVELS)


@query(f"SELECT CAST(b AS INTEGER) AS bin, CAST(CASE {_B2R} ELSE -2147483648 END AS INTEGER) AS start, CAST(CASE {_LEN} ELSE 2147483647 END AS INTEGER) AS \"end\" FROM (SELECT unnest(range(0, 37449)) AS b)")
def bin_region(spark, d):
    return fx.register(spark).range(0, binning.MOST_BIN + 1).select(F.col("id").cast("int").alias("bin")).select("bin", binning.bin_to_region(F.col("bin")).alias("x")).select("bin", "x.start", "x.end")


@query("SELECT qname, start, (l_partkey << 16) | start % 65536 AS voffset, l_partkey AS coffset, CAST(start % 65536 AS BIGINT) AS uoffset, 'c=' || l_partkey || ',u=' || start % 65536 AS shown FROM a")
def virtual_offset_split(spark, d):
    v = binning.virtual_offset(F.col("l_partkey"), F.col("start") % 65536)
    return _a(spark, d, "l_partkey").withColumn("voffset", v).select("qname", "start", "voffset", binning.block_offset(F.col("voffset")).alias("coffset"), binning.contents_offset(F.col("voffset")).alias("uoffset"), binning.show_offset(F.col("voffset")).alias("shown"))


@query("""SELECT bin, min(vs) AS vstart, max(ve) AS vend FROM (SELECT *, sum(new) OVER (PARTITION BY bin ORDER BY vs, ve ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN vs <= max(ve) OVER (PARTITION BY bin ORDER BY vs, ve ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
    FROM (SELECT ref_id * 100 + start // 1024 AS bin, CAST(start AS BIGINT) * 65536 AS vs, CAST(start + tag_nm AS BIGINT) * 65536 AS ve FROM a))) GROUP BY bin, island""")
def chunk_merge(spark, d):
    chunks = _a(spark, d).select((F.col("ref_id") * 100 + F.floor(F.col("start") / 1024).cast("int")).alias("bin"), (F.col("start").cast("bigint") * 65536).alias("vstart"), ((F.col("start") + F.col("tag_nm")).cast("bigint") * 65536).alias("vend"))
    return regions.merge_chunks(chunks, "bin")


# --- references


@query("SELECT a.qname, a.start, r.rname, r.rlen, CASE WHEN mate_ref_id < 0 THEN '*' WHEN mate_ref_id = a.ref_id THEN '=' ELSE m.rname END AS mate_rname FROM a LEFT JOIN refs r ON a.ref_id = r.ref_id LEFT JOIN refs m ON a.mate_ref_id = m.ref_id")
def reference_lookup(spark, d):
    return regions.with_reference_names(_a(spark, d), fx.refs(spark, d)).select("qname", "start", "rname", "rlen", "mate_rname")


# --- tags


def _tags(spark, d):
    return fx.records(spark, d)


@query("SELECT qname, start, CAST(tag_nm AS BIGINT) AS nm, 'C' AS nm_type, tag_rg AS rg, true AS no_xx, CAST(2 AS INTEGER) AS n FROM a")
def tag_get(spark, d):
    return _tags(spark, d).select("qname", "start", tags.get("tags", "NM")["i"].alias("nm"), tags.get("tags", "NM")["type"].alias("nm_type"), tags.get("tags", "RG")["s"].alias("rg"), tags.get("tags", "XX").isNull().alias("no_xx"), F.size("tags").alias("n"))


@query("SELECT qname, start, 'NM:i:' || tag_nm * 100 || chr(9) || 'RG:Z:' || tag_rg || chr(9) || 'AS:i:' || mapq || chr(9) || 'RG:Z:again' AS shown, 'NM:i:' || tag_nm || chr(9) || 'RG:Z:again' AS fewer FROM a")
def tag_edit(spark, d):
    nm, as_, rg = tags.int_tag("NM", F.col("tags")[0]["i"] * 100), tags.int_tag("AS", F.col("mapq").cast("bigint")), tags.tag("RG", "Z", s=F.lit("again"))
    rows = _tags(spark, d).withColumn("more", tags.push(tags.insert(tags.insert("tags", nm), as_), rg)).withColumn("fewer", tags.remove(tags.push("tags", rg), "RG"))
    return rows.select("qname", "start", tags.sam_text("more").alias("shown"), tags.sam_text("fewer").alias("fewer"))


@query("SELECT qname, start, v, CASE WHEN v >= 0 THEN CASE WHEN v < 256 THEN 'C' WHEN v < 65536 THEN 'S' ELSE 'I' END WHEN v >= -128 THEN 'c' WHEN v >= -32768 THEN 's' ELSE 'i' END AS kind FROM (SELECT qname, start, CAST((start - 50000) * (tag_nm * tag_nm) AS BIGINT) AS v FROM a)")
def tag_push_int(spark, d):
    v = ((F.col("start") - 50000) * (F.col("tag_nm") * F.col("tag_nm"))).cast("bigint")
    return _a(spark, d).select("qname", "start", v.alias("v"), tags.int_type(v).alias("kind"))


@query("SELECT qname, start, CAST(tag_nm AS BIGINT) AS nm, tag_rg AS rg, CAST(mapq - 20 AS BIGINT) AS last, 3 AS n_array, 'NM:i:' || tag_nm || chr(9) || 'RG:Z:' || tag_rg || chr(9) || 'XB:B:s,1,-2,' || mapq - 20 || chr(9) || 'XA:A:' || tag_rg || chr(9) || 'XH:H:1AE3' AS shown FROM a")
def tag_parse(spark, d):
    texts = F.array(F.concat(F.lit("NM:i:"), F.col("tag_nm")), F.concat(F.lit("RG:Z:"), F.col("tag_rg")), F.concat(F.lit("XB:B:s,1,-2,"), (F.col("mapq") - 20).cast("string")), F.concat(F.lit("XA:A:"), F.col("tag_rg")), F.lit("XH:H:1AE3"), F.lit("bad"))
    rows = _a(spark, d).withColumn("tags", tags.parse(texts))
    b = tags.get("tags", "XB")
    return rows.select("qname", "start", tags.get("tags", "NM")["i"].alias("nm"), tags.get("tags", "RG")["s"].alias("rg"), F.get(b["ia"], 2).alias("last"), tags.array_length(b).alias("n_array"), tags.sam_text("tags").alias("shown"))


# --- files

_MATE = "CASE WHEN mate_ref_id < 0 THEN '*' WHEN mate_ref_id = a.ref_id THEN '=' ELSE m.rname END"
_LINE = f"concat_ws(chr(9), qname, flag, r.rname, start + 1, mapq, cigar, {_MATE}, mate_start + 1, tlen, seq, coalesce(qual, '*'), 'NM:i:' || tag_nm, 'RG:Z:' || tag_rg)"
_JOIN = "FROM a LEFT JOIN refs r ON a.ref_id = r.ref_id LEFT JOIN refs m ON a.mate_ref_id = m.ref_id"
_ROW = f"SELECT qname, flag, a.ref_id, r.rname, start, \"end\", CAST({_BIN.format('start', '\"end\"')} AS INTEGER) AS bin, mapq, cigar, mate_ref_id, mate_start, tlen, seq, qual, 'NM:i:' || tag_nm || chr(9) || 'RG:Z:' || tag_rg AS tags FROM a LEFT JOIN refs r ON a.ref_id = r.ref_id"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qname", "flag", "ref_id", "rname", "start", "end", "bin", "mapq", "cigar", "mate_ref_id", "mate_start", "tlen", "seq", "qual", tags.sam_text("tags").alias("tags"))


@query(f"SELECT {_LINE} AS line {_JOIN}")
def sam_line_encode(spark, d):
    return sam.encode(fx.records(spark, d), fx.header(spark, d)).select(F.col("value").alias("line"))


@query(_ROW)
def sam_roundtrip(spark, d):
    path = scratch(spark, "sam")
    sam.write(fx.records(spark, d), path, fx.header(spark, d))
    return _shown(sam.read(spark, path))


def _written(spark, d, **options) -> str:
    path = scratch(spark, "bam")
    rows = records.in_order(fx.records(spark, d)) if options.get("index") else fx.records(spark, d)
    bam.write(rows, path, header=fx.header(spark, d).text(), **options)
    return path


@query(_ROW)
def bam_roundtrip(spark, d):
    return _shown(spark.read.format("alignments_bam").load(_written(spark, d)))


@query(f"{_ROW} WHERE a.ref_id = 2 AND start < 1400 AND \"end\" > 1000")
def bam_region_indexed(spark, d):
    path = _written(spark, d, index="true")
    return _shown(regions.fetch(spark.read.format("alignments_bam").option("index", "true").option("modificationTime", "ignore").load(path), REGION, bam.read_header(path)))


@query(_ROW)
def bam_indexed_full_scan(spark, d):
    path = _written(spark, d, index="true")
    return _shown(spark.read.format("alignments_bam").option("index", "true").option("modificationTime", "ignore").option("splitSize", "100000").load(path))


@query("SELECT ref_id, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM (SELECT ref_id, unnest(list_distinct([" + _BIN.format("start", '"end"') + "])) AS bin FROM a) GROUP BY ref_id, bin")
def bam_bins(spark, d):
    path = _written(spark, d)
    return spark.read.format("alignments_bam").option("columns", "ref_id,bin").load(path).groupBy("ref_id", F.col("bin").cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT qname, start, CAST(length(seq) AS INTEGER) AS isize, seq AS data FROM a WHERE length(seq) > 0")
def bgzf_roundtrip(spark, d):
    path = scratch(spark, "bgzf")
    rows = fx.alignments(spark, d).select(F.concat_ws("|", "qname", F.col("start").cast("string"), "seq").cast("binary").alias("data"))
    bgzf.write(rows, path)
    found = spark.read.format("bgzf_blocks").load(path).filter("isize > 0").filter(F.crc32("data") == F.col("crc32"))
    f = F.split(F.col("data").cast("string"), "\\|")
    return found.select(f[0].alias("qname"), f[1].cast("int").alias("start"), (F.col("isize") - F.length(f[0]) - F.length(f[1]) - 2).alias("isize"), f[2].alias("data"))


@query("SELECT CAST(ref_id AS INTEGER) AS ref_id, rname, rlen FROM refs")
def header_roundtrip(spark, d):
    path = _written(spark, d)
    head = bam.read_header(path)
    return Header(head.text()).ref_sequences(spark)


# --- pileups


@query("SELECT ref_id, CAST(r_pos // 500 AS BIGINT) AS piece, max(depth) AS most, CAST(sum(depth) AS BIGINT) AS total, CAST(sum(n_insertion) AS BIGINT) AS n_insertion, CAST(sum(n_deletion) AS BIGINT) AS n_deletion FROM (SELECT ref_id, r0 + k AS r_pos, count(*) AS depth, count(*) FILTER (ins > 0 AND k = len - 1) AS n_insertion, count(*) FILTER (op = 'D') AS n_deletion FROM (SELECT *, unnest(range(len)) AS k FROM o WHERE contains('M=XD', op)) GROUP BY ALL) GROUP BY ALL", ops=True)
def pileup_depth(spark, d):
    depth = pairs.pileup_depth(_a(spark, d).select("ref_id", "start", "cigar", "seq", "end"))
    return depth.groupBy("ref_id", F.floor(F.col("r_pos") / 500).alias("piece")).agg(F.max("depth").alias("most"), F.sum("depth").alias("total"), F.sum("n_insertion").alias("n_insertion"), F.sum("n_deletion").alias("n_deletion"))


@query(f"SELECT qname, CAST(r0 + k AS INTEGER) AS r_pos, CASE WHEN op = 'D' THEN 'Deletion' WHEN ins > 0 AND k = len - 1 THEN 'Insertion' ELSE 'Nucleotide' END AS kind, CASE WHEN op <> 'D' THEN substr(seq, CAST(q0 + k + 1 AS BIGINT), 1 + CASE WHEN k = len - 1 THEN ins ELSE 0 END) END AS bases, CASE WHEN op <> 'D' THEN substr(qual, CAST(q0 + k + 1 AS BIGINT), 1 + CASE WHEN k = len - 1 THEN ins ELSE 0 END) END AS quals, CAST(CASE WHEN op = 'D' THEN 0 WHEN k = len - 1 THEN 1 + ins ELSE 1 END AS INTEGER) AS n FROM (SELECT *, unnest(range(len)) AS k FROM o WHERE {_IN} AND contains('M=XD', op)) WHERE r0 + k BETWEEN 1000 AND 1399 AND flag & 1024 = 0", ops=True)
def pileup_bases(spark, d):
    rows = pairs.pileup_entries(_a(spark, d), REGION, ~flags.test("is_duplicate"))
    return rows.select("qname", "r_pos", "kind", "bases", "quals", pairs.entry_len().alias("n"))


@query("SELECT qname, start + 10 AS start, start + 10 + 15 AS \"end\", 7 AS flag, upper(substr(seq, 1, 5)) AS seq FROM a")
def record_setters(spark, d):
    df = records.set_cigar(records.set_place(records.set_flag(_a(spark, d), 7), start=F.col("start") + 10), "5M10D")
    return records.set_seq_qual(df, F.lower(F.substring("seq", 1, 5))).select("qname", "start", "end", "flag", "seq")


@query("SELECT qname, start, start + 5 + start % 7 + 1 AS \"end\", '5M' || (start % 7 + 1) || 'D' AS cigar, 'ACGTN' AS seq, '!\"#' || chr(33 + mapq % 60) || 'I' AS qual FROM a")
def raw_setters(spark, d):
    """Fields from what files hold: 32-bit operations, 4-bit bases, qualities without their offset."""
    words = F.array(F.lit(5 << 4), (F.col("start") % 7 + 1) * 16 + 2)
    quals = F.unhex(F.concat(F.lit("000102"), F.lpad(F.hex(F.col("mapq") % 60), 2, "0"), F.lit("28")))
    df = records.set_raw_seq_qual(records.set_raw_cigar(_a(spark, d), words), F.unhex(F.lit("1248F0")), quals, 5)
    return df.select("qname", "start", "end", "cigar", "seq", "qual")


@query(_ROW)
def bam_cut_scan(spark, d):
    """Files without an index, in many pieces."""
    return _shown(spark.read.format("alignments_bam").option("splitSize", "50000").load(_written(spark, d, compressionLevel="1")))


@query(f"{_ROW} WHERE a.ref_id = 2 AND start < 1400 AND \"end\" > 1000")
def bam_region_fresh_index(spark, d):
    """With the indexes' age checked, as it is by default, and their folder named."""
    path = _written(spark, d, index="true")
    return _shown(regions.fetch(spark.read.format("alignments_bam").option("index", "true").option("baiPath", path).load(path), REGION, bam.read_header(path)))


@query("SELECT qname, start, CAST(length(seq) AS INTEGER) AS isize FROM a WHERE length(seq) > 0")
def bgzf_cut_scan(spark, d):
    """Blocks of files that were overwritten, in many pieces, each from its first block on."""
    path = scratch(spark, "bgzf")
    rows = fx.alignments(spark, d).select(F.concat_ws("|", "qname", F.col("start").cast("string"), "seq").cast("binary").alias("data"))
    for part in (rows.limit(1), rows):
        bgzf.write(part, path, "overwrite")
    found = spark.read.format("bgzf_blocks").option("splitSize", "100000").load(path).filter("isize > 0")
    f = F.split(F.col("data").cast("string"), "\\|")
    return found.select(f[0].alias("qname"), f[1].cast("int").alias("start"), F.length(f[2]).alias("isize"))


@query(f"SELECT qname, start, mate_start, start < mate_start + 100 AND mate_start < start + 100 AS meet, CASE WHEN start <= mate_start + 100 AND mate_start <= start + 100 THEN least(start, mate_start) ELSE -1 END AS vstart, CASE WHEN start <= mate_start + 100 AND mate_start <= start + 100 THEN greatest(start, mate_start) + 100 ELSE -1 END AS vend, start = mate_start AS same, start < mate_start AS before, length(seq) > 0 AS has_seq, qual IS NOT NULL AS has_qual, translate({_TR.format('seq')}, '=MRSVWYHKDB', 'NNNNNNNNNNN') AS compl_acgtn FROM a")
def predicates_of_chunks_and_sequences(spark, d):
    s, m = F.col("start"), F.col("mate_start")
    both = binning.chunks_combine(s, s + 100, m, m + 100)
    return _a(spark, d).select("qname", "start", "mate_start", binning.chunks_intersect(s, s + 100, m, m + 100).alias("meet"), F.coalesce(both["vstart"], F.lit(-1)).alias("vstart"), F.coalesce(both["vend"], F.lit(-1)).alias("vend"), (s == m).alias("same"), (s < m).alias("before"), sequences.available().alias("has_seq"), F.col("qual").isNotNull().alias("has_qual"), sequences.acgtn_only(sequences.complement()).alias("compl_acgtn"))


@query("SELECT qname, start, 0 AS nth, 'NM' AS name, 'C' AS kind, CAST(tag_nm AS VARCHAR) AS shown FROM a UNION ALL SELECT qname, start, 1, 'RG', 'Z', tag_rg FROM a")
def tags_in_order(spark, d):
    x = F.posexplode("tags").alias("nth", "x")
    return _tags(spark, d).select("qname", "start", x).select("qname", "start", "nth", F.col("x.name").alias("name"), F.col("x.type").alias("kind"), F.coalesce(F.col("x.i").cast("string"), F.col("x.s")).alias("shown"))


@query("SELECT qname, start, 'XA:A:q' || chr(9) || 'Xc:i:' || mapq - 100 || chr(9) || 'XZ:Z:' || qname || chr(9) || 'XH:H:0AFF' || chr(9) || 'XB:B:I,' || start || ',1' AS shown FROM a")
def tag_kinds_roundtrip(spark, d):
    """Tags of every kind through a binary file."""
    path = scratch(spark, "bam")
    own = F.array(tags.tag("XA", "A", s=F.lit("q")), tags.tag("Xc", "s", i=(F.col("mapq") - 100).cast("bigint")), tags.tag("XZ", "Z", s=F.col("qname")), tags.tag("XH", "H", s=F.lit("0AFF")), tags.tag("XB", "B", subtype=F.lit("I"), ia=F.array(F.col("start").cast("bigint"), F.lit(1).cast("bigint"))))
    bam.write(fx.records(spark, d).withColumn("tags", own), path, header=fx.header(spark, d).text(), compressionLevel="1")
    return spark.read.format("alignments_bam").option("columns", "qname,tags").load(path).select("qname", "start", tags.sam_text("tags").alias("shown"))


@query(_ROW)
def sam_stream(spark, d):
    """Text files that arrive in a folder, as a stream that ends when it has caught up."""
    path, name = scratch(spark, "sam"), f"sam_stream_{uuid.uuid4().hex}"
    head = fx.header(spark, d)
    sam.write(fx.records(spark, d), path, head)
    to = scratch(spark, "stream")
    rows = read_text_stream(spark, path, head)
    rows.writeStream.format("parquet").queryName(name).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start(to).awaitTermination()
    return _shown(spark.read.schema(rows.schema).parquet(to))
