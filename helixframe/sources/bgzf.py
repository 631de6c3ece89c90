"""Block-compressed files as a Spark data source: a row for each block.

``spark.read.format("bgzf_blocks")``: path, coffset, bsize, isize, crc32, data. Option ``chunks``
(``start-end,...`` virtual offsets, sorted and disjoint) reads only those, clipped to them;
``splitSize`` cuts files (each task finds its first block by itself; pieces are larger where there would be over 512 under 64 MB); ``requireEof`` makes
a missing end block an error; ``compressed`` adds the block's own bytes as a column. Writing takes ``data`` (and ``coffset`` or row order) a row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from helixframe.sources import files
from helixframe.sources.bgzf_codec import END, MOST, BlockError, Buffered, Writer, load, next_block
from helixframe.sources.staging import Part, Staging

SCHEMA = "path string, coffset bigint, bsize int, isize int, crc32 bigint, data binary"
_ARROW = pa.schema([("path", pa.string()), ("coffset", pa.int64()), ("bsize", pa.int32()), ("isize", pa.int32()), ("crc32", pa.int64()), ("data", pa.binary())])


#: Blocks of a batch at most, and bytes of contents after which it is full.
ROWS, BYTES = 4096, 8 << 20
#: Partitions that a small splitSize may cut a scan into (each is a task, and the driver plans them all), while pieces are under WHOLE bytes.
MOST_PARTITIONS, WHOLE = 512, 64 << 20


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int
    seek: bool = False  # from the first block that begins after start


def parse_chunks(text: str) -> list[tuple[int, int]]:
    out = [tuple(int(x) for x in c.split("-")) for c in text.split(",") if c]
    if any(a >= b for a, b in out) or any(a[1] > b[0] for a, b in zip(out, out[1:])):
        raise ValueError("chunks have to be sorted and disjoint")
    return out


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.split = o["path"], int(o.get("splitsize", str(WHOLE)))
        self.chunks = parse_chunks(o["chunks"]) if "chunks" in o else None
        self.compressed = o.get("compressed", "false").lower() == "true"
        self.need_end = o.get("requireeof", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        paths = files.listing(self.path, "")
        split = self.split if self.chunks is not None else max(self.split, min(WHOLE, -(-sum(map(files.size, paths)) // MOST_PARTITIONS)))
        for path in paths:
            if self.chunks is not None:
                out += [Span(path, a, b) for a, b in self.chunks]
                continue
            with files.open_input(path) as f:
                size = files.size(path)
                if self.need_end and f.read_at(len(END), max(0, size - len(END))) != END:
                    raise BlockError(f"{path} lacks the end block")
                out += [Span(path, a << 16, min(a + split, size) << 16, a > 0) for a in range(0, max(size, 1), split)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with files.open_input(partition.path) as f:
            at, held, size = partition.start >> 16, [], 0
            f = Buffered(f, min(1 << 20, (partition.end >> 16) - at + 2 * MOST))
            if partition.seek and (at := next_block(f, at, partition.end >> 16)) is None:
                return
            while (at << 16) < partition.end and (b := load(f, at)) is not None:
                lo = partition.start & 0xFFFF if at == partition.start >> 16 and not partition.seek else 0
                hi = partition.end & 0xFFFF if at == partition.end >> 16 else len(b.contents)
                held.append((partition.path, at, b.size, len(b.contents), b.crc32, b.contents[lo:hi], *([f.read_at(b.size, at)] if self.compressed else [])))
                at, size = at + b.size, size + len(b.contents)
                if len(held) == ROWS or size >= BYTES:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        schema = _ARROW.append(pa.field("compressed", pa.binary())) if self.compressed else _ARROW
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        o = {k.lower(): v for k, v in options.items()}
        self.staging, self.level = Staging(o["path"], overwrite, (".gz",)), int(o.get("compressionlevel", "6"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        name, rows = self.staging.name(".gz"), 0
        with files.open_output(f"{self.staging.folder}/{name}") as out:
            w = Writer(out, self.level)
            for batch in iterator:
                for data in batch.column(batch.schema.get_field_index("data")).to_pylist():
                    w.write(data or b"")
                    w.flush()
                    rows += 1
            w.finish()
        return Part([name], rows)

    def commit(self, messages: list[Part | None]) -> None:
        self.staging.commit(messages)

    def abort(self, messages: list[Part | None]) -> None:
        self.staging.abort()


def write(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Writes a table's data column, a row a block: what workers need of it, and in large batches (bytes bound them too)."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, ROWS)
        df.select("data").write.format("bgzf_blocks").options(**options).mode(mode).save(path)
    finally:
        spark.conf.set(key, before)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf_blocks"

    def schema(self) -> str:
        return SCHEMA + (", compressed binary" if self.options.get("compressed", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockWriter(self.options, overwrite)
