"""The binary alignment format as a Spark data source: ``spark.read.format("alignments_bam")``.

Reading: files are cut into pieces of ``splitSize`` compressed bytes; each task finds the first
record of its piece by itself, or with an index by that. Filters on
``ref_id``, ``start`` and ``end`` choose chunks by the index; every filter is still applied by
Spark. Options: ``index`` (true: use ``<file>.bai``), ``baiPath``, ``modificationTime`` (error,
ignore or warn, for an index older than its file), ``mode`` (FAILFAST, DROPMALFORMED, PERMISSIVE),
``strict`` (a mapped record has a reference, an unmapped has none), ``columns`` (text columns and
tags that aren't named are not decoded, and NULL), ``splitSize`` (compressed bytes of a partition; more
where there would be over 512 partitions under 64 MB). ``baiPath`` is an index, or a folder of indexes ``<file>.bai``.

Writing: a file for each task, which is seen once the job is committed. Options: ``header`` (its text), ``compressionLevel``,
``index`` (true: write ``.bai`` files; the rows of a task have to be in order), ``writeHeader``.
"""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from helixframe.functions import tags
from helixframe.schema import ALIGNMENTS
from helixframe.sources import files
from helixframe.sources.bai_codec import Builder, Index, merge
from helixframe.sources.bgzf_codec import BlockError, Buffered, Reader, Writer, load, next_block
from helixframe.sources.header import Header
from helixframe.sources.record_batch import decode_rows, encode_rows
from helixframe.sources.record_codec import RecordError, decode, encode, ref_end
from helixframe.sources.staging import Part, Staging
from helixframe.sources.tag_batch import unpack

#: Records of a batch at most, and bytes after which it is full.
BATCH, BYTES = 4096, 8 << 20
#: Bytes beyond a block that are looked at for where its first record begins (the first few do for short records), and records that have to follow.
NEAR, AHEAD, CHAIN = 16 << 10, 512 << 10, 16
#: Partitions that a small splitSize may cut a scan into (each is a task, and the driver plans them all), while pieces are under WHOLE bytes.
MOST_PARTITIONS, WHOLE = 512, 64 << 20
#: What a table to be written has; the other columns follow from these.
WRITTEN = ["qname", "flag", "ref_id", "start", "mapq", "cigar", "mate_ref_id", "mate_start", "tlen", "seq", "qual", "tags"]
_TAG = pa.struct([("name", pa.string()), ("type", pa.string()), ("subtype", pa.string()), ("i", pa.int64()), ("f", pa.float32()), ("s", pa.string()), ("ia", pa.list_(pa.int64())), ("fa", pa.list_(pa.float32()))])
_KINDS = {"qname": pa.string(), "rname": pa.string(), "cigar": pa.string(), "seq": pa.string(), "qual": pa.string(), "_corrupt": pa.string(), "tags": pa.list_(_TAG)}
_NAMES = ["qname", "flag", "ref_id", "rname", "start", "end", "bin", "mapq", "cigar", "mate_ref_id", "mate_start", "tlen", "seq", "qual", "tags", "_corrupt"]
ARROW = pa.schema([(n, _KINDS.get(n, pa.int32())) for n in _NAMES])


def read_header(path: str) -> Header:
    """The header of the first file at a path."""
    with files.open_input(files.listing(path, ".bam")[0]) as f:
        return Header.from_binary(Reader(f).read)


def read_index(path: str) -> Index:
    with files.open_input(path) as f:
        return Index.parse(f.read())


def check_age(bam: str, bai: str, mode: str) -> None:
    """An index that is older than its file is an error, or a warning, or nothing."""
    if mode not in ("error", "warn", "ignore"):
        raise ValueError("modificationTime is one of error, warn, ignore")
    ours, theirs = files.modified(bam), files.modified(bai)
    if mode != "ignore" and ours is not None and theirs is not None and theirs < ours:
        text = f"index {bai} is older than {bam}"
        if mode == "error":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)


def write(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Writes a table in the shape in which it gets to the workers fastest: only the columns that
    the others follow from, tags packed, and large batches (of short rows; bytes bound them too)."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = df.withColumn("tags", tags.packed("tags")).select(*WRITTEN)
    try:
        spark.conf.set(key, BATCH)
        rows.write.format("alignments_bam").options(**options).mode(mode).save(path)
    finally:
        spark.conf.set(key, before)


def first_record(f, start: int, end: int, n_references: int) -> int | None:
    """The virtual offset of the first record that begins in a block between two file offsets: the
    first place from where on bytes read as records, up to CHAIN of them or the end of what is at hand."""
    f, at = Buffered(f), next_block(Buffered(f), start, end)
    while at is not None and at < end and (b := load(f, at)) is not None:
        r = Reader(f, at << 16)
        data, all_read = np.frombuffer(r.read(len(b.contents) + NEAR), np.uint8), False
        n = min(len(b.contents), len(data) - 35)
        if n > 0:
            core = np.lib.stride_tricks.sliding_window_view(data, 36)[:n]
            field = lambda lo: np.ascontiguousarray(core[:, lo : lo + 4]).view("<i4")[:, 0].astype(np.int64)
            size, ref, pos, seq, mate, mate_pos = (field(x) for x in (0, 4, 8, 20, 24, 28))
            name, ops = core[:, 12].astype(np.int64), core[:, 16].astype(np.int64) | core[:, 17].astype(np.int64) << 8
            least = 32 + name + 4 * ops + (seq + 1) // 2 + seq
            ok = (name > 0) & (seq >= 0) & (size >= least) & (np.minimum(np.minimum(ref, mate), np.minimum(pos, mate_pos)) >= -1) & (np.maximum(ref, mate) < n_references)
            for u in np.flatnonzero(ok).tolist():
                found = _reads_on(data, u, n_references)
                if found is None and not all_read:  # records too long for what was read
                    data, all_read = np.concatenate([data, np.frombuffer(r.read(AHEAD - NEAR), np.uint8)]), True
                    found = _reads_on(data, u, n_references)
                if found is not False:
                    return (at << 16) | u
        at += b.size
    return None


def _reads_on(data: np.ndarray, at: int, n_references: int) -> bool | None:
    """Whether bytes read as records one after another; None if they do as far as there are any."""
    for _ in range(CHAIN):
        if at + 36 > len(data):
            return None
        raw = data[at : at + 36].tobytes()
        size, ref, pos, name, _, _, ops, _, seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", raw)
        if name < 1 or seq < 0 or size < 32 + name + 4 * ops + (seq + 1) // 2 + seq or min(ref, pos, mate, mate_pos) < -1 or max(ref, mate) >= n_references:
            return False
        text = data[at + 36 : at + 36 + name]
        if len(text) == name and (text[-1] or (text[:-1] < 32).any()):
            return False
        words = data[at + 36 + name : at + 36 + name + 4 * ops][::4]
        if ((words & 15) > 8).any():
            return False
        at += 4 + size
    return True


def _walk(r: Reader, end: int | None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Batches of the records that begin before a virtual offset: bytes, places and sizes. What came
    before a fault is given before it is raised."""
    held, at, limit, fault = bytearray(), 0, None, None
    starts: list[int] = []
    ends: list[int] = []
    take = struct.Struct("<i").unpack_from

    def batch():
        s = np.array(starts, np.int64)
        return bytes(held[:at]), s, np.array(ends, np.int64) - s

    while fault is None:
        try:
            here = r.next()
            part = b"" if here is None else r.rest()
        except BlockError as e:
            here, part, fault = None, b"", e
        if end is not None and limit is None and here is not None and here >> 16 >= end >> 16:  # no record begins from here on, or from within
            limit = len(held) + (max((end & 0xFFFF) - (here & 0xFFFF), 0) if here >> 16 == end >> 16 else 0)
        held += part
        most = len(held)
        stop = most if limit is None else min(limit, most)
        while at < stop and at + 4 <= most:
            n = take(held, at)[0]
            if n < 32:
                fault = RecordError("a record is cut off")
                break
            if at + 4 + n > most:
                break
            starts.append(at + 4)
            at += 4 + n
            ends.append(at)
            if len(starts) == BATCH:
                yield batch()
                del held[:at]
                most, stop, limit, at = most - at, stop - at, None if limit is None else limit - at, 0
                starts, ends = [], []
        if fault is None and (at >= stop if limit is not None else here is None and at == most):
            break
        if here is None and fault is None:
            fault = RecordError("stray bytes at the file's end" if most - at < 4 else "a record is cut off")
        if starts and at >= BYTES:
            yield batch()
            del held[:at]
            limit, at = None if limit is None else limit - at, 0
            starts, ends = [], []
    if starts:
        yield batch()
    if fault:
        raise fault


@dataclass
class Chunks(InputPartition):
    path: str
    chunks: list[tuple[int, int | None]]  # virtual offsets; None: to the file's end
    piece: tuple[int, int] | None = None  # file offsets: records that begin in blocks between them
    stop: int | None = None  # no record from this start on is wanted: the file is in order
    ref_id: int | None = None


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        get = self.options.get
        self.path = get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.indexed = get("index", "false").lower() == "true" or "baipath" in self.options
        self.mode = get("mode", "FAILFAST").upper()
        if self.mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
            raise ValueError("mode is one of FAILFAST, DROPMALFORMED, PERMISSIVE")
        self.strict = get("strict", "false").lower() == "true"
        self.wanted = {c.strip() for c in self.options["columns"].split(",")} if "columns" in self.options else set(_NAMES)
        self.split = int(get("splitsize", str(WHOLE)))
        self.ref_id: int | None = None
        self.lo, self.hi = 0, (1 << 31) - 1

    def pushFilters(self, filters):
        for f in filters:
            name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == ("ref_id",):
                self.ref_id = int(value)
            elif isinstance(f, EqualTo) and name == ("start",):
                self.lo, self.hi = max(self.lo, int(value)), min(self.hi, int(value) + 1)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == ("start",):
                self.hi = min(self.hi, int(value) + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == ("end",):
                self.lo = max(self.lo, int(value) - isinstance(f, GreaterThanOrEqual))
            yield f  # applied again above the scan

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        paths = files.listing(self.path, ".bam")
        sizes = [files.size(path) for path in paths]
        split = max(self.split, min(WHOLE, -(-sum(sizes) // MOST_PARTITIONS)))
        for path, size in zip(paths, sizes):
            if not self.indexed:
                out += [Chunks(path, [(-1, (a + split) << 16 if a + split < size else None)] if not a else [], (a, min(a + split, size)) if a else None) for a in range(0, max(size, 1), split)]
                continue
            bai = self.options.get("baipath", f"{path}.bai")
            if files.is_folder(bai):
                bai = f"{bai.rstrip('/')}/{path.rsplit('/', 1)[-1]}.bai"
            check_age(path, bai, self.options.get("modificationtime", "error").lower())
            index = read_index(bai)
            if self.ref_id is not None and self.ref_id >= 0:
                if self.lo < self.hi:
                    out += [Chunks(path, g, None, self.hi, self.ref_id) for g in self._groups(index.chunks(self.ref_id, self.lo, min(self.hi, 1 << 29)))]
                continue
            cuts, last = [], 0
            for start in index.starts():  # the whole file, cut where records begin
                if (start >> 16) - last >= split:
                    cuts.append(start)
                    last = start >> 16
            out += [Chunks(path, [(a, b)]) for a, b in zip([-1, *cuts], [*cuts, None])]
        return out or [Chunks("", [])]

    def _groups(self, chunks: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """Chunks of one partition; two that share a block stay together."""
        held: list[tuple[int, int]] = []
        for c in merge(chunks):
            if held and (c[0] >> 16) != (held[-1][1] >> 16) and sum((e >> 16) - (s >> 16) for s, e in held) >= self.split:
                yield held
                held = []
            held.append(c)
        if held:
            yield held

    def _records(self, part: Chunks) -> Iterator[tuple[bytes, Header, None]]:
        for data, starts, sizes, header in self._spans(part):
            for at, n in zip(starts.tolist(), sizes.tolist()):
                yield data[at : at + n], header, None

    def _spans(self, part: Chunks) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, Header]]:
        """Bytes with the places and sizes of some records in them, without the lengths before them."""
        with files.open_input(part.path) as f:
            head = Reader(f, window=64 << 10 if part.chunks[:1] != [(-1, None)] else 1 << 20)
            header = Header.from_binary(head.read)
            chunks = part.chunks
            if part.piece and (after := head.next()) is not None:
                low, high = part.piece
                first = after if low << 16 < after else first_record(f, low, high, header.n_references)  # the header may end in this piece
                chunks = [(first, high << 16)] if first is not None else []
            for start, end in chunks:
                r = head if start < 0 else Reader(f, start, 1 << 20 if end is None else min(1 << 20, (end >> 16) - max(start >> 16, 0) + (64 << 10)))
                for data, starts, sizes in _walk(r, end):
                    if part.ref_id is not None:  # by the fixed part alone
                        places = np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(8)].view("<i4")
                        mine = places[:, 0] == part.ref_id
                        late = np.flatnonzero(mine & (places[:, 1] >= part.stop))
                        mine[late[0] if len(late) else len(mine) :] = False
                        if mine.any():
                            yield data, starts[mine], sizes[mine], header
                        if len(late):
                            break
                    else:
                        yield data, starts, sizes, header

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        """Batches of records, each a column at a time; one by one where that doesn't do."""
        if not partition.path:
            return
        broken = None
        try:
            for data, starts, sizes, header in self._spans(partition):
                yield self._batch(data, starts, sizes, header.names)
        except (BlockError, RecordError) as e:  # the rest of the stream can't be found
            if self.mode == "FAILFAST":
                raise
            broken = str(e)
        if broken and self.mode == "PERMISSIVE":
            yield pa.RecordBatch.from_pylist([{"_corrupt": broken}], schema=ARROW)

    def _batch(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, names: list[str]) -> pa.RecordBatch:
        if (out := decode_rows(np.frombuffer(data, np.uint8), starts, sizes, names, self.strict, self.wanted, ARROW)) is not None:
            return out
        rows: list[dict] = []
        for at, n in zip(starts.tolist(), sizes.tolist()):
            try:
                rows.append(decode(data[at : at + n], names, self.strict, "tags" in self.wanted))
            except RecordError as e:
                if self.mode == "FAILFAST":
                    raise
                if self.mode == "PERMISSIVE":
                    rows.append({"_corrupt": str(e)})
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of more rows, as a column at a time pays only with many."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BATCH or sum(x.nbytes for x in held) >= BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class AlignmentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.header = o.get("path"), Header(o.get("header", ""))
        self.level = int(o.get("compressionlevel", "6"))
        if not 0 <= self.level <= 9:
            raise ValueError("compressionLevel has to lie in 0..9")
        self.with_index, self.with_header = o.get("index", "false").lower() == "true", o.get("writeheader", "true").lower() == "true"
        self.staging = Staging(self.path, overwrite, (".bam", ".bam.bai"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        name = self.staging.name(".bam")
        path = f"{self.staging.folder}/{name}"
        rows, builder = 0, Builder(self.header.n_references) if self.with_index else None
        with files.open_output(path) as out:
            w = Writer(out, self.level)
            if self.with_header:
                w.write(self.header.binary())
                w.flush()  # records begin in a block of their own
            for batch in _gathered(iterator):
                if (made := encode_rows(batch)) is None:
                    lines = batch.to_pylist()
                    for row in lines:
                        row["tags"] = unpack(row["tags"]) if isinstance(row["tags"], str) else row["tags"]
                    raws = [encode(row) for row in lines]
                    made = b"".join(raws), np.cumsum([0, *map(len, raws)]), np.array([ref_end(row) for row in lines], np.int64)
                starts, ends = w.write_all(memoryview(made[0]), made[1])
                if builder:
                    places = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ref_id", "start"))
                    builder.add_all(*places, made[2], starts, ends)
                rows += len(batch)
            w.finish()
        if builder:
            with files.open_output(f"{path}.bai") as out:
                out.write(builder.index().binary())
        return Part([name, *([f"{name}.bai"] if builder else [])], rows)

    def commit(self, messages: list[Part | None]) -> None:
        self.staging.commit(messages)

    def abort(self, messages: list[Part | None]) -> None:
        self.staging.abort()


class AlignmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignments_bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> DataSourceReader:
        return AlignmentReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return AlignmentWriter(self.options, overwrite)
