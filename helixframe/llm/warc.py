"""WARC archives with an index: written first, then read by coalesced byte ranges.

Each record is a gzip member of its own. Writing yields an index row for each record: file,
offset, length, URL, digest. A reader selects index rows, sorts them by file and offset, joins
ranges that lie close together into one read each, and parses only the selected records.
Archives go to the shared folder through pyarrow's file systems (local paths, HDFS, S3).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.hot import join_hot
from helixframe.runtime import discard, scratch, settle

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than this are read together, up to so many bytes.
GAP, MOST = 64 << 10, 8 << 20
#: Bytes of archives that a task reads at most, and that are enough for one.
TASK, LITTLE = 64 << 20, 1 << 20
#: Payloads below this many bytes are never revisits.
LEAST = 100


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _safe(url: str) -> str:
    """A URL that fits on a header line: control characters and % before two hex digits of one are escaped."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[01][0-9A-Fa-f]|7[Ff]|25)", lambda m: f"%{ord(m[0]):02X}", url)


def _plain(line: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), line)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, level: int) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> dict:
    """A record from its gzip member; a payload that doesn't fit its digest or length is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a payload of record {fields['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-ID"), "url": None if url is None else _plain(url), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, level: int) -> Iterator[pa.RecordBatch]:
    fs, path = FileSystem.from_uri(folder)
    out, at, file = None, 0, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    for b in batches:
        rows: dict[str, list] = {f.name: [] for f in _INDEX}
        for page_id, url, html, digest, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))):
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{file}", compression=None)  # by its name it would be compressed again
            raw = record(page_id, url, html or b"", digest, refers_to, revisit, date, level)
            out.write(raw)
            for k, v in zip(_INDEX.names, (f"{folder}/{file}", at, len(raw), url, digest, page_id, "revisit" if revisit else "response")):
                rows[k].append(v)
            at += len(raw)
        yield pa.RecordBatch.from_pydict(rows, schema=_INDEX)
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index.

    Of rows with equal payloads of ``LEAST`` bytes or more, those of the smallest page_id are
    responses and the others revisits that refer to it. A null html is an empty payload; null
    ids rank last; a null url leaves its header out; rows that repeat an id and payload are
    all responses; other columns are ignored; an empty table makes no archive.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    null_id = (1 << 63) - 1
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    rank = F.coalesce("page_id", F.lit(null_id))
    shared = settle(rows.filter(F.length("html") >= LEAST).groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("copies")).filter("first < last").drop("last"), "warc-payloads")
    total = shared.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    marked = join_hot(rows, shared, "digest", "copies", total, "page_id", "left").withColumn("revisit", F.coalesce(rank > F.col("first"), F.lit(False)))
    marked = marked.withColumn("refers_to", F.when(F.col("revisit"), F.nullif("first", F.lit(null_id))))
    index = settle(marked.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(lambda it: _write(it, folder, date, level), INDEX), "warc-index")
    discard(shared)
    return index


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[int]]]:
    """Reads for sorted (offset, length) ranges: start, size, and the numbers of the ranges within."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, size) in enumerate(ranges):
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + size - out[-1][0] <= most:
            start, had, own = out[-1]
            out[-1] = (start, max(had, at + size - start), [*own, i])
        else:
            out.append((at, size, [i]))
    return out


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    schema = pa.schema([schema.field(n) for n in names])
    for b in batches:
        where = list(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()))
        i = 0
        while i < len(where):
            j = i
            while j < len(where) and where[j][0] == where[i][0]:
                j += 1
            fs, path = FileSystem.from_uri(where[i][0])
            with fs.open_input_file(path) as f:
                for start, size, own in coalesce_ranges([x[1:] for x in where[i:j]]):
                    raw = memoryview(f.read_at(size, start))
                    found = [parse(raw[where[i + k][1] - start :][: where[i + k][2]]) for k in own]
                    yield pa.RecordBatch.from_pydict({n: [x[n] for x in found] for n in names}, schema=schema)
            i = j


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that rows of an index name, parsed from the archives (columns of RECORD;
    without ``payload`` its bytes are checked but not returned).

    A record named twice is returned twice; an index row whose file, offset or length is null is an
    error, as is a file that is gone; other columns are ignored; an empty index gives no rows.
    Records that lie together are read by one task, TASK bytes of archives at most, and by as many
    tasks as there are cores for as long as that leaves each LITTLE bytes.
    """
    names = [x.split()[0] for x in RECORD.split(", ")][: None if payload else -1]
    schema = ", ".join(x for x in RECORD.split(", ") if x.split()[0] in names)
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = index.sparkSession.sparkContext.defaultParallelism
    n = max(-(-total // TASK), min(-(-total // LITTLE), 4 * cores), 1)
    near = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / (1 + total // n))).sortWithinPartitions("file", "offset")
    return near.mapInArrow(lambda it: _read(it, names), schema)
