"""Batches of binary records to and from Arrow columns, a column at a time.

What one record in a batch makes unusual (text beyond ASCII, an alignment kept in a tag, anything
malformed) is left to the codec of single records, which also says what is wrong.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixframe.sources.record_codec import BASES, OPS, RecordError, cigar_words
from helixframe.sources.tag_batch import decode_tags, encode_tags
from helixframe.sources.tag_batch import flat_text as _flat
from helixframe.sources.tag_batch import within as _within

#: The fixed part of a record.
CORE = np.dtype([("ref_id", "<i4"), ("start", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate_ref_id", "<i4"), ("mate_start", "<i4"), ("tlen", "<i4")])
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_PAIRS = np.stack([np.repeat(_LETTERS, 16), np.tile(_LETTERS, 16)], 1)
_CODES = np.full(256, 255, np.uint8)
for _i, _c in enumerate(BASES):
    _CODES[[ord(_c), ord(_c.lower())]] = _i
_REF = np.isin(np.arange(16), [OPS.index(x) for x in "MDN=X"])


class _Unusual(Exception):
    """A batch that single records have to be looked at for."""


def _need(ok) -> None:
    if not ok:
        raise _Unusual


def _text(flat: np.ndarray, at: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    _need(at[-1] < 1 << 31 and not (flat > 127).any())
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)), valid)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def decode_batch(raws: list[bytes], names: list[str], strict: bool, wanted: set[str], schema: pa.Schema) -> pa.RecordBatch | None:
    """Rows of records' bytes; None if they have to be decoded one by one. Columns that aren't wanted are empty."""
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    return decode_rows(np.frombuffer(b"".join(raws), np.uint8), np.cumsum(size) - size, size, names, strict, wanted, schema)


def decode_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, names: list[str], strict: bool, wanted: set[str], schema: pa.Schema) -> pa.RecordBatch | None:
    """As decode_batch, of records that lie in one array of bytes."""
    try:
        return _decode(data, start, size, names, strict, wanted, schema)
    except (_Unusual, RecordError):
        return None


def _decode(data, s, size, names, strict, wanted, schema) -> pa.RecordBatch:
    n = len(s)
    _need(n and size.min() >= 32)
    core = np.ascontiguousarray(data[s[:, None] + np.arange(32)]).view(CORE)[:, 0]
    col = {k: core[k].astype(np.int64) for k in CORE.names}
    n_seq, n_cigar = col["n_seq"], col["n_cigar"]
    _need(min(col[k].min() for k in ("ref_id", "start", "mate_ref_id", "mate_start")) >= -1 and n_seq.min() >= 0 and col["n_name"].min() > 0)
    _need(max(col["ref_id"].max(), col["mate_ref_id"].max()) < len(names))
    if strict:
        _need(((col["ref_id"] >= 0) == (col["flag"] & 4 == 0)).all())
    at_cigar = s + 32 + col["n_name"]
    at_seq = at_cigar + 4 * n_cigar
    at_qual = at_seq + (n_seq + 1) // 2
    at_tags = at_qual + n_seq
    _need((at_tags <= s + size).all())
    take, at = _within(at_cigar, 4 * n_cigar)
    words, at = data[take].view("<u4"), at // 4
    op, length = (words & 15).astype(np.int64), (words >> 4).astype(np.int64)
    _need((op < 9).all())
    two = np.flatnonzero(n_cigar == 2)
    _need(not ((words[at[two]] == n_seq[two] << 4 | 4) & (op[at[two] + 1] == 3) & (n_seq[two] > 0)).any())  # the real one may be a tag
    some = _sums(length > 0, at) > 0
    out = {k: pa.array(v, pa.int32()) for k, v in col.items()}
    out["end"] = pa.array(np.where(some, col["start"] + _sums(length * _REF[op], at), 0), pa.int32())
    refs = pa.array(names, pa.string())
    out["rname"] = refs.take(pa.array(col["ref_id"], pa.int64(), mask=col["ref_id"] < 0))
    if "qname" in wanted:
        take, ends = _within(s + 32, col["n_name"] - 1)
        out["qname"] = _text(data[take], ends)
    if "cigar" in wanted:
        kinds, which = np.unique(words, return_inverse=True)
        shown = pa.array([f"{w >> 4}{OPS[w & 15]}" if w >> 4 else "" for w in kinds.tolist()], pa.string()).take(pa.array(which.reshape(-1)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), shown), "")
        out["cigar"] = pc.if_else(pa.array(some), joined, "*")
    if "seq" in wanted:
        take, packed = _within(at_seq, (n_seq + 1) // 2)
        letters = _PAIRS[data[take]].reshape(-1)
        take, ends = _within(2 * packed[:-1], n_seq)
        out["seq"] = pc.if_else(pa.array(n_seq > 0), _text(letters[take], ends), "*")
    if "qual" in wanted:
        first = np.where(n_seq > 0, data[np.minimum(at_qual, len(data) - 1)], 255)
        take, ends = _within(at_qual, np.where(first == 255, 0, n_seq))
        _need(not (data[take] > 94).any())
        out["qual"] = _text(data[take] + np.uint8(33), ends, first == 255)
    if "tags" in wanted:
        out["tags"] = decode_tags(data, at_tags, s + size, schema.field("tags").type)
    return pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(n, f.type) for f in schema], schema=schema)


def bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds each range."""
    last = end - 1
    out = np.zeros(len(start), np.int64)
    for shift in (26, 23, 20, 17, 14):  # from large bins to small ones
        same = (start >> shift) == (last >> shift)
        out = np.where(same, ((1 << (29 - shift)) - 1) // 7 + (start >> shift), out)
    return out


def encode_batch(batch: pa.RecordBatch) -> tuple[list[memoryview], np.ndarray] | None:
    """Records' bytes with their lengths before them, and their ends; None if they have to be encoded one by one."""
    if not len(batch):
        return [], np.zeros(0, np.int64)
    if (made := encode_rows(batch)) is None:
        return None
    view, cuts = memoryview(made[0]), made[1].tolist()
    return [view[a:b] for a, b in zip(cuts, cuts[1:])], made[2]


def encode_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """As encode_batch, the bytes in one array: with where each record begins, and last where all end."""
    try:
        return _encode(batch)
    except (_Unusual, RecordError):
        return None


def _encode(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    n, col = len(batch), {}
    for k in ("ref_id", "start", "mapq", "flag", "mate_ref_id", "mate_start", "tlen"):
        _need(not get(k).null_count)
        col[k] = get(k).to_numpy(zero_copy_only=False).astype(np.int64)
    _need(min(col[k].min() for k in ("ref_id", "start", "mate_ref_id", "mate_start")) >= -1)
    _need(min(col["mapq"].min(), col["flag"].min()) >= 0 and col["mapq"].max() < 256 and col["flag"].max() < 65536)
    name, name_at, name_n = _flat(get("qname"))
    _need(name_n.max() <= 254)
    kinds = get("cigar").cast(pa.string()).fill_null("*").dictionary_encode()
    parsed = [cigar_words(x) for x in kinds.dictionary.to_pylist()]
    which = kinds.indices.to_numpy(zero_copy_only=False)
    n_kind = np.array([len(x) for x in parsed], np.int64)
    _need(n_kind.max() <= 0xFFFF)
    words, kind_at = np.fromiter(chain.from_iterable(parsed), np.uint32, int(n_kind.sum())), np.concatenate([[0], np.cumsum(n_kind)])
    ref_of = _sums((words >> 4).astype(np.int64) * _REF[words & 15], kind_at)
    n_cigar, ref_len = n_kind[which], ref_of[which]
    seq, seq_at, n_seq = _flat(get("seq"))
    star = (n_seq == 1) & (seq[np.minimum(seq_at, len(seq) - 1)] == 42) if len(seq) else np.zeros(n, bool)
    n_seq = np.where(star, 0, n_seq)
    n_packed = (n_seq + 1) // 2
    take, packed_at = _within(np.zeros(n, np.int64), n_packed)  # the pair's number in its record
    base, last = np.repeat(seq_at, n_packed), np.repeat(n_seq, n_packed)
    high = _CODES[seq[base + 2 * take]] if len(take) else np.zeros(0, np.uint8)
    low = np.where(2 * take + 1 < last, _CODES[seq[np.minimum(base + 2 * take + 1, len(seq) - 1)]], 0) if len(take) else high
    _need(not (high == 255).any() and not (low == 255).any())
    qual, qual_at, n_qual = _flat(get("qual"))
    have = np.asarray(get("qual").is_valid()) & (n_seq > 0)
    _need((n_qual[have] == n_seq[have]).all())
    take, _ = _within(qual_at, np.where(have, n_seq, 0))
    scores = qual[take]
    _need(not len(scores) or scores.min() >= 33 and scores.max() <= 126)
    tags, n_tags = encode_tags(get("tags"))
    end = np.where(n_cigar > 0, col["start"] + ref_len, 0)
    size = 32 + name_n + 1 + 4 * n_cigar + n_packed + n_seq + n_tags
    _need(size.max() < 1 << 31)
    at = np.concatenate([[0], np.cumsum(size + 4)])
    out, to = np.zeros(at[-1], np.uint8), at[:-1].copy()
    core = np.zeros(n, np.dtype([("size", "<i4"), *CORE.descr]))
    reach = np.where((col["start"] >= 0) & (n_cigar > 0), np.maximum(end, col["start"] + 1), end)
    for k, v in {**col, "size": size, "n_name": name_n + 1, "n_cigar": n_cigar, "n_seq": n_seq, "bin": bins(col["start"], reach) & 0xFFFF}.items():
        core[k] = v
    out[to[:, None] + np.arange(36)] = core.view(np.uint8).reshape(n, 36)
    to += 36

    def put(flat: np.ndarray, count: np.ndarray) -> None:
        nonlocal to
        out[_within(to, count)[0]] = flat
        to = to + count

    put(name[_within(name_at, name_n)[0]], name_n)
    to += 1
    put(words[_within(kind_at[which], n_cigar)[0]].astype("<u4").view(np.uint8), 4 * n_cigar)
    put((high << 4 | low).astype(np.uint8), n_packed)
    all_quals = np.full(int(n_seq.sum()), 255, np.uint8)
    all_quals[np.repeat(have, n_seq)] = scores - 33
    put(all_quals, n_seq)
    put(tags, n_tags)
    return out, at, end
