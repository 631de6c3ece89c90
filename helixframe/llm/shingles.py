"""Shingle sets of whole texts, as sorted 64-bit keys.

A key's high byte is the frequency class of its shingle over the whole corpus and its low 56 bits
are the shingle's hash: sorted keys begin with the rarest shingles. Any classes give right
results; good ones keep common shingles out of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.wordbytes import U64, Words, mix64, planes, sequence_hash, slices, unplanes, window_hashes

#: Bits of a hash that choose its entry in the class table; the table's size is fixed: 16 MB.
SLOT_BITS = 24
#: Hashes that a task gathers before it passes them on.
FLUSH = 1_500_000


def shingle_hashes(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows (a shorter text is one window), and where each text's begin."""
    w = Words(texts, lower=True)
    h, count = w.hashes(), w.counts()
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ptr = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(ptr[-1]), U64)
    owner = w.owner()
    if len(h) >= k:
        win = window_hashes(h, k)
        at = np.flatnonzero(owner[: len(win)] == owner[k - 1 :])
        out[at - w.ptr[owner[at]] + ptr[owner[at]]] = win[at]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[ptr[i]] = sequence_hash(h[w.ptr[i] : w.ptr[i + 1]])[0]
    return out, ptr


def keys_of(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[(h >> U64(64 - SLOT_BITS)).astype(np.int64)].astype(U64) << U64(56)) | (h >> U64(8))


def distinct(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def digest(keys: np.ndarray) -> int:
    """One signed 64-bit name for a set of hashes, whatever their classes."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(keys << U64(8)).sum() + U64(len(keys))], U64)).view(np.int64)[0])


def _flush(parts: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct 40-bit keys with counts, a row for each bucket of keys."""
    k = np.sort(np.concatenate(parts))
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    k, n = k[at], np.diff(np.concatenate([at, [len(k)]])).astype(np.uint32)
    edge = np.searchsorted(k, np.arange(1 << bits, dtype=U64) << U64(40 - bits))
    edge = np.concatenate([edge, [len(k)]])
    rows: tuple[list, list] = ([], [])
    for b in np.flatnonzero(edge[1:] > edge[:-1]):
        low = (k[edge[b] : edge[b + 1]] & U64((1 << (40 - bits)) - 1)).astype(np.uint32)
        rows[0].append(b)
        rows[1].append(planes(np.diff(low, prepend=np.uint32(0))) + planes(n[edge[b] : edge[b + 1]]))
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["bucket", "blob"])


def class_table(documents: DataFrame, k: int = 5) -> np.ndarray:
    """How common the shingles of each slot are over all documents: 0 for fewer than 8 occurrences,
    else log2 of the most common one's count less 2. Its size doesn't depend on the input."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(8, (4 * parts - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for s in slices(batches):
            h, _ = shingle_hashes(s.column("text"), k)
            held.append(h >> U64(24))
            n += len(h)
            if n >= FLUSH:
                yield from _flush(held, bits)
                held, n = [], 0
        if n:
            yield from _flush(held, bits)

    def classes(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for raw in pdf["blob"]:
            keys.append(np.cumsum(unplanes(raw[: len(raw) // 2], np.uint32), dtype=np.uint32))
            counts.append(unplanes(raw[len(raw) // 2 :], np.uint32))
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts, at)
        often = total >= 8
        level = np.clip(np.log2(total[often]).astype(np.int64) - 2, 1, 255).astype(np.uint8)
        out = np.zeros(1 << (SLOT_BITS - bits), np.uint8)
        np.maximum.at(out, (keys[at][often] >> np.uint32(40 - SLOT_BITS)).astype(np.int64), level)
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "levels": [out.tobytes()]})

    counted = documents.select("text").mapInArrow(count, "bucket int, blob binary").groupBy("bucket").applyInPandas(classes, "bucket int, levels binary")
    table = np.zeros((1 << bits, 1 << (SLOT_BITS - bits)), np.uint8)
    for r in counted.collect():  # 2 ** SLOT_BITS bytes at most
        table[r["bucket"]] = np.frombuffer(r["levels"], np.uint8)
    return table.reshape(-1)
