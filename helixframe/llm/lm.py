"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of 1-, 2- and 3-grams are summed over all training documents. A filter holds each n-gram
once for every count threshold that it reaches; a reader probes rising thresholds until one is
absent, which gives the quantised count. A filter is in slices by the keys' high bits. The reducer
of a slice sizes it by the entries counted there, fills it and probes it for the blocks of
documents, so no filter is sent anywhere and none has a greatest size; n-grams of all orders are
held from one occurrence on. Probabilities are interpolated,

    p(w | u v) = x r3 + (1 - x) (y r2 + (1 - y) p1),    r3 = c(uvw) / c(uv),  r2 = c(vw) / c(v),

where x and y depend on how common the context is; they are fitted by leaving one out on all
training tokens: what the fit needs of them is how often each ratio of the two sides occurs in each
class of contexts, in steps of 1/128 octave, which is summed over all blocks. The base score beside it uses exact counts. Both kinds of counts come
back from the reducers to the documents, not by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.wordbytes import _ODD, U64, Words, mix64, planes, slices, unplanes
from helixframe.runtime import discard, settle

#: Tokens of a block, so that a row stays small.
FLUSH = 80_000
#: Bits that each entry is given at least (a slice's size is a power of two), and probes for an entry.
ENTRY_BITS, PROBES = 8, 3
#: Count thresholds: small counts exactly, then in steps of 30 %.
LEVELS = np.unique(np.ceil(1.3 ** np.arange(90)).astype(np.int64))
#: Steps of an octave, and octaves to either side, of the ratios that the interpolation is fitted on; no ratio of counts goes beyond.
STEPS, OCTAVES = 128, 48
_END, _BOS = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


# --- encoded documents -------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        ids = [i for x in held for i in x[0]]
        out = np.concatenate([x[1] for x in held])
        size = np.concatenate([x[2] for x in held])
        keys, seq = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
        block = (part << 32) + nth
        return pa.RecordBatch.from_pydict({"block": [block], "ids": [ids], "held": [out.tolist()], "size": [size.tolist()], "keys": [planes(np.diff(keys, prepend=U64(0)))], "seq": [planes(seq.astype(np.uint32))]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("keys", pa.binary()), ("seq", pa.binary())]))

    for s in slices(batches):
        w = Words(s.column("text"), lower=True)
        count = w.counts()
        # each text's words, then the end token
        tokens = np.full(len(w.start) + len(count), _END, U64)
        tokens[np.arange(len(w.start)) + w.owner()] = w.hashes()
        held.append((s.column("doc_id").to_pylist(), np.asarray(s.column("held")), count + 1, tokens))
        n += len(tokens)
        if n >= FLUSH:
            yield flush()
            nth, held, n = nth + 1, [], 0
    if held:
        yield flush()


_ENCODED = "block long, ids array<long>, held array<boolean>, size array<long>, keys binary, seq binary"


class Block:
    """An encoded block's n-grams. Positions are those of its tokens in order."""

    def __init__(self, row):
        self.ids, self.held, self.size = list(row["ids"]), np.array(row["held"], bool), np.array(row["size"], np.int64)
        self.keys, self.seq = np.cumsum(unplanes(row["keys"], U64), dtype=U64), unplanes(row["seq"], np.uint32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.trained = np.repeat(~self.held, self.size)
        # two marks before each text
        doc = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.seq)) + 2 * (doc + 1)
        p = np.full(len(self.seq) + 2 * len(self.size), _BOS, U64)
        p[self.place] = self.keys[self.seq]
        with np.errstate(over="ignore"):
            two = p[:-1] * _ODD[11] + p[1:] * _ODD[12]
            self.two = mix64(np.concatenate([[U64(0)], two]))  # at a place: it and the one before
            self.three = mix64(np.concatenate([[U64(0)] * 2, two[:-1] * _ODD[13] + p[2:] * _ODD[14]]))
        # what is looked up: tokens, and for 1- and 2-grams the mark that comes before each text
        self.marks = self.place[self.at[:-1]] - 1
        self.both, self.learned = np.concatenate([self.place, self.marks]), np.concatenate([self.trained, ~self.held])

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of an order, and which of them each place has (``both``, for 3-grams ``place``)."""
        if order == 1:
            k = int(np.searchsorted(self.keys, _BOS))
            return np.insert(self.keys, k, _BOS), np.concatenate([self.seq + (self.seq >= k), np.full(len(self.marks), k)])
        # hashes of longer n-grams need no more than 40 bits
        return np.unique((self.two[self.both] if order == 2 else self.three[self.place]) >> U64(24), return_inverse=True)


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each is large."""
    for i in range(len(b)):
        yield b.slice(i, 1).to_pylist()[0]


_COUNTED = pa.schema([("order", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _bucketed(order: int, block: int, keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys and counts, a row for each bucket (the keys' high bits)."""
    width = 64 if order == 1 else 40
    edge = np.concatenate([np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(width - bits)), [len(keys)]])
    rows: dict[str, list] = {f.name: [] for f in _COUNTED}
    for k in np.flatnonzero(edge[1:] > edge[:-1]):
        own = slice(edge[k], edge[k + 1])
        for name, v in zip(rows, (order, k, block, planes(np.diff(keys[own], prepend=U64(0))), planes(n[own].astype(np.uint32)))):
            rows[name].append(v)
    return pa.RecordBatch.from_pydict(rows, schema=_COUNTED)


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Per block, order and bucket: all keys and their training counts, 0 where only held-out texts have them."""
    for b in batches:
        for row in _rows(b):
            x = Block(row)
            for order in (1, 2, 3):
                keys, at = x.grams(order)
                yield _bucketed(order, row["block"], keys, np.bincount(at[x.learned[: len(at)]], minlength=len(keys)), bits)


_MERGED = "order int, bucket int, block long, total long, kinds long, levels binary, counts binary"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers to each block: what its slice of the filter says of the block's keys, and
    for 1-grams the exact counts. Also the bucket's number of training tokens and words (block -1)."""
    order, bucket = int(pdf["order"].iloc[0]), int(pdf["bucket"].iloc[0])
    parts = [np.cumsum(unplanes(k, U64), dtype=U64) for k in pdf["keys"]]
    ends, keys = np.cumsum([len(k) for k in parts])[:-1], np.concatenate(parts)
    del parts
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    counts = np.concatenate([unplanes(c, np.uint32) for c in pdf["counts"]])[by].astype(np.int64)
    keys, counts = keys[new], np.add.reduceat(counts, np.flatnonzero(new))
    f = _plan_filter(counts, order)
    f.data = f.fill(keys, counts)
    said = (f.levels(keys) + 1).astype(np.uint8)
    out = [(order, bucket, int(block), 0, 0, said[own].tobytes(), planes(counts[own].astype(U64)) if order == 1 else b"") for block, own in zip(pdf["block"], np.split(which, ends))]
    if order == 1:
        real = counts[keys != _BOS]
        out.append((order, bucket, -1, int(real.sum()), int((real > 0).sum()), b"", b""))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _MERGED.split(", ")])


# --- the filter --------------------------------------------------------------------------------


class Filter:
    """One order's log-frequency Bloom filter, in slices by the keys' high bits."""

    def __init__(self, bits: int, width: int, first: int, slice_bits: int, data: np.ndarray | None = None):
        self.bits, self.width, self.first, self.slice_bits = bits, width, first, slice_bits
        self.data = data

    def places(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        """The bit of each key in its slice."""
        with np.errstate(over="ignore"):
            return mix64(keys + U64(level + 1) * _ODD[15] + U64(probe) * _ODD[16]) >> U64(64 - self.slice_bits)

    def fill(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bytes of one slice."""
        on = np.zeros(1 << self.slice_bits, bool)
        for level in range(self.first, len(LEVELS)):
            own = keys[counts >= LEVELS[level]]
            if not len(own):
                break
            for probe in range(PROBES):
                on[self.places(own, level, probe).astype(np.int64)] = True
        return np.packbits(on, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level that each key reaches, -1 for what the filter lacks."""
        base = (keys >> U64(self.width - self.bits - 1) >> U64(1)) << U64(self.slice_bits)
        reached = np.full(len(keys), -1)
        live = np.arange(len(keys))
        for level in range(self.first, len(LEVELS)):
            for probe in range(PROBES):
                bit = base[live] | self.places(keys[live], level, probe)
                live = live[(self.data[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            reached[live] = level
        return reached

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, 0 for what the filter lacks."""
        return SAID[self.levels(keys) + 1]


#: What a level stands for: the middle of the counts that end there.
ESTIMATES = np.append((LEVELS[:-1] + LEVELS[1:] - 1) // 2, LEVELS[-1])
#: The same by what is passed on: 0 for none, and the level after that.
SAID = np.append(0, ESTIMATES)


def _plan_filter(counts: np.ndarray, order: int) -> Filter:
    """A filter for n-grams of these counts, an entry for each level that each of them reaches."""
    entries = int(np.searchsorted(LEVELS, counts, "right").sum())
    return Filter(0, 64 if order == 1 else 40, 0, max(6, (entries * ENTRY_BITS - 1).bit_length()))


class Model:
    """Totals and interpolation weights."""

    def __init__(self, tokens: int, kinds: int):
        self.tokens, self.kinds = tokens, kinds
        self.mix2 = self.mix3 = np.full(64, 0.5)

    def p1(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.tokens + 0.1 * (self.kinds + 1))

    def log10(self, counts: tuple[np.ndarray, ...]) -> np.ndarray:
        w, v, vw, uv, uvw = counts
        return np.log10(_mixed(self.p1(w), vw, v, self.mix2, uvw, uv, self.mix3))


_SEEN = "ids array<long>, held array<boolean>, size array<long>, known array<long>, base array<double>, one binary, two binary, three binary"


def _answered(own: pd.DataFrame, answers: pd.DataFrame, model: Model) -> pd.DataFrame:
    """A block's texts with their base scores and the levels of its n-grams: 1- and 2-grams at ``both``, 3-grams at tokens."""
    x, answers = Block(own.iloc[0]), answers.sort_values("bucket")
    said = {}
    for order in (1, 2, 3):
        of = answers[answers["order"] == order]
        levels, at = np.frombuffer(b"".join(of["levels"]), np.uint8), x.grams(order)[1]
        said[order] = levels[at]
        if order == 1:
            exact = np.concatenate([unplanes(c, U64) for c in of["counts"]]).astype(float)[at[: len(x.seq)]]
    at = x.at[:-1]
    return pd.DataFrame({"ids": [x.ids], "held": [x.held.tolist()], "size": [x.size.tolist()], "known": [np.add.reduceat((exact > 0).astype(np.int64), at).tolist()], "base": [np.add.reduceat(np.log10(model.p1(exact)), at).tolist()], "one": [said[1].tobytes()], "two": [said[2].tobytes()], "three": [said[3].tobytes()]})


class Seen:
    """An answered block: quantised counts for each token."""

    def __init__(self, row):
        self.size = np.array(row["size"], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.trained = np.repeat(~np.array(row["held"], bool), self.size)
        one, two, three = (SAID[np.frombuffer(row[x], np.uint8)] for x in ("one", "two", "three"))
        n = len(self.trained)
        #: w, v, vw, uv, uvw
        self.counts = one[:n], self._before(one), two[:n], self._before(two), three

    def _before(self, c: np.ndarray) -> np.ndarray:
        """For each token what the one before has; at a text's first one, the mark."""
        out = np.concatenate([c[:1], c[: len(self.trained) - 1]])
        out[self.at] = c[len(self.trained) :]
        return out


def _class(c: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(c, 0) + 1).astype(np.int64)


def _ratio(c: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum(c / np.maximum(np.maximum(of, c), 1), 1.0)


def _mixed(p1, vw, v, mix2, uvw, uv, mix3):
    y, x = np.where(v > 0, mix2[_class(v)], 0), np.where(uv > 0, mix3[_class(uv)], 0)
    return x * _ratio(uvw, uv) + (1 - x) * (y * _ratio(vw, v) + (1 - y) * p1)


def _steps(r: np.ndarray, low: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where tokens belong: their class and the step of r / low (0 if r is 0)."""
    with np.errstate(divide="ignore"):
        at = np.floor((np.log2(r) - np.log2(low) + OCTAVES) * STEPS) + 1
    return kind * (2 * OCTAVES * STEPS + 1) + np.clip(at, 0, 2 * OCTAVES * STEPS).astype(np.int64)


def _fit(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each class the share of r in r, low that makes the tokens most probable, by EM; ``n`` tokens at ``at``."""
    out = np.full(64, 0.1)
    kind, step = np.divmod(at, 2 * OCTAVES * STEPS + 1)
    ratio = np.where(step > 0, np.exp2((step - 0.5) / STEPS - OCTAVES), 0)
    for k in np.unique(kind):
        a, share, m = ratio[kind == k], n[kind == k] / n[kind == k].sum(), 0.5
        for _ in range(20):
            m = float((share * (m * a / (m * a + 1 - m))).sum())
            m = min(max(m, 1e-4), 0.9999)
        out[k] = m
    return out


def _weights(seen: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Shares of 2-grams and, by those, of 3-grams for each class of contexts, from all training tokens."""
    size, mix2 = 64 * (2 * OCTAVES * STEPS + 1), None

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for row in _rows(b):
                x = Seen(row)
                w, v, vw, uv, uvw = (np.maximum(c[x.trained] - 1, 0) for c in x.counts)  # without the token itself
                low, r, of = model.p1(w), vw, v
                if mix2 is not None:
                    low, r, of = _mixed(low, vw, v, mix2, 0, 0, mix2), uvw, uv
                ok = of > 0
                n += np.bincount(_steps(_ratio(r, of)[ok], low[ok], _class(of[ok])), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    def fitted() -> np.ndarray:
        found = seen.mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")  # as many rows as there are steps at most
        return _fit(found["at"].to_numpy(np.int64), found["n"].to_numpy(np.int64))

    mix2 = fitted()
    return mix2, fitted()


def score(documents: DataFrame, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows where ``held_out`` is true are scored but not learned from (null: learned from). A null or
    blank text is its end token alone; null ids stay null; repeated rows are learned and scored
    each; other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = settle(docs.mapInArrow(_encode, _ENCODED), "lm-blocks")
    bits = min(14, max(6, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    merged = settle(blocks.mapInArrow(lambda it: _counts(it, bits), "order int, bucket int, block long, keys binary, counts binary").groupBy("order", "bucket").applyInPandas(_merge, _MERGED), "lm-counts")
    total = merged.filter("block = -1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    model = Model(total["tokens"], total["kinds"])
    answers = merged.filter("block >= 0").select("block", "order", "bucket", "levels", "counts")
    seen = settle(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda own, answers: _answered(own, answers, model), _SEEN), "lm-seen")
    discard(blocks, merged)

    model.mix2, model.mix3 = _weights(seen, model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                x = Seen(row)
                out = {"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["size"], pa.int64()), "n_known": pa.array(row["known"], pa.int64()), "train_tokens": pa.array([model.tokens] * len(x.size), pa.int64()), "base_score": pa.array(row["base"], pa.float64())}
                yield pa.RecordBatch.from_pydict({**out, "score": pa.array(np.add.reduceat(model.log10(x.counts), x.at), pa.float64())})

    return seen.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
