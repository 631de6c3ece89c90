"""Best-fit packing of tokenised documents, planned over the histogram of piece lengths.

The plan sees counts only: best-fit decreasing over at most ``capacity`` lengths. Each document
piece then takes its planned slot by its rank among the pieces of its length. The plan's size
depends on ``capacity``, never on the number of documents.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixframe.llm.kept import keep
from helixframe.runtime import settle

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_part", pa.int32()), ("_nth", pa.int64())])
#: Entries in each of the two generations of a worker's word memo.
MEMO = 400_000
#: Longer words are encoded each time.
MEMO_WORD = 64
#: Texts that are encoded together.
TOGETHER = 250


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it.

    A text's ids are then those of its words in order, so words this worker has met are looked
    up. New words of letters only are encoded many in one call: each ends at the one token with
    the vocabulary's end-of-word mark. Others are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.model = self.tok.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, self.batch(words, add_special_tokens=False))}

    def _bare(self, words: list[str]) -> dict[str, bytes]:
        """Lower-case ASCII words, which normalising and cutting leave as they are, go to the model itself."""
        return {w: array("I", [t.id for t in self.model.tokenize(w)]).tobytes() for w in words}

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.batch([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                out |= self._each(part)
                continue
            raw, start = ids.tobytes(), 0
            for w, stop in zip(part, stops):
                out[w] = raw[start:stop]
                start = stop
        return out

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words new to the memo. A last comma or stop after a letter is a token of its own."""
        plain = {w[:-1] if w[-1] in ".," and w[:-1].isalpha() else w for w in words if w}
        known = {w: v for w in plain if (v := self.young.get(w) or self.old.get(w)) is not None}
        plain.update(".,")
        todo = [w for w in plain if w not in known]
        bare, letters, others = [], [], []
        for w in todo:
            (others if not w.isalpha() else bare if w.isascii() and w.islower() else letters).append(w)
        known |= self._bare(bare) | self._joined(letters) | self._each(others)
        return {w: b"" if not w else known[w] if w in known else known[w[:-1]] + known[w[-1]] for w in words}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        flat, at = [], [0]
        for t in texts:
            if "<|" not in t:  # special tokens are case-sensitive; all else is lower-cased by the tokenizer anyhow
                t = t.encode().lower().decode()
            flat += t.replace("\n", " ").split(" ")
            at.append(len(flat))
        found = list(map(self.young.get, flat))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            new = {flat[i] for i in missing}
            if len(self.young) + len(new) > MEMO:
                self.old, self.young = self.young, {}
            got = {w: self.old[w] for w in new if w in self.old}
            got |= self._words([w for w in new if w not in got])
            for i in missing:
                found[i] = got[flat[i]]
            self.young.update((w, v) for w, v in got.items() if len(w) <= MEMO_WORD)
        return [b"".join(found[i:j]) for i, j in zip(at, at[1:])]


def _encode(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), {}
    end = np.array([end_id], "<u4").tobytes()
    encoder = keep(("packing", path), lambda: Encoder(path))
    for whole in batches:
        for at in range(0, len(whole), TOGETHER):
            b = whole.slice(at, TOGETHER)
            rows = {f.name: [] for f in PIECES}
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    k = nth[length] = nth.get(length, -1) + 1
                    crc = zlib.crc32(ids if n <= capacity else ids[4 * start : 4 * (start + length)])
                    for f, v in zip(PIECES.names, (doc, piece, start, length, crc, part, k)):
                        rows[f].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots ``(length, first_rank, per_sequence, first_sequence, offset)``: pieces of that
    length from that rank on go, ``per_sequence`` at a time, to the sequences from
    ``first_sequence`` on, beginning at ``offset``. Sequences with equal room form one group.
    """
    slots, rooms, groups, made = [], [], {}, 0  # groups: room -> [(first sequence, count)]

    def put(room: int, group: tuple[int, int]) -> None:
        if room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append(group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, made
                count = -(-left // (capacity // length))
                made += count
            per = room // length
            full = min(count, left // per)
            if full:
                slots.append((length, rank, per, first, capacity - room))
                put(room - per * length, (first, full))
                rank, left = rank + full * per, left - full * per
            if full < count and left:  # the last sequence takes what is left of this length
                slots.append((length, rank, left, first + full, capacity - room))
                put(room - left * length, (first + full, 1))
                full, left = full + 1, 0
            if full < count:
                put(room, (first + full, count - full))
    return slots


def _place(batches: Iterator[pa.RecordBatch], slots: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """slots: sorted by (length, first_rank)."""
    span = np.int64(1) << 48  # ranks stay below
    keys = slots[:, 0] * span + slots[:, 1]
    for b in batches:
        length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
        s = slots[np.searchsorted(keys, length * span + rank, "right") - 1] if len(length) else slots[:0]
        k = rank - s[:, 1]
        seq, off = s[:, 3] + k // np.maximum(s[:, 2], 1), s[:, 4] + k % np.maximum(s[:, 2], 1) * length
        yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs whole documents into as few sequences of ``capacity`` tokens as best-fit finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    is its ids and then ``end_id``; only longer ones are cut. A null or empty text gives the end
    id alone; a null doc_id stays null; repeated rows are packed as often as they occur; other
    columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle(docs.mapInArrow(lambda it: _encode(it, tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long"), "pack-pieces")
    # ranks: a piece's number in its task, after the pieces of its length in earlier tasks
    counts = settle(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "pack-counts")
    base = counts.select("length", "_part", (F.sum("n").over(W.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # never broadcast: base has a row for each length of each task, which is no fixed number
    ranked = pieces.join(base.hint("merge"), ["length", "_part"]).select(*names, (F.col("_base") + F.col("_nth")).alias("_rank"))
    return ranked.mapInArrow(lambda it: _place(it, slots, names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
