"""Substring dedup: lines are cut into units, unit digests are grouped over all documents, the
occurrence of smallest rank stays and the others are removed, with their original offsets.

A unit is a line, cut further after words that end in ``.``, ``!`` or ``?`` and where a hash of the
last three words is the least of 15 in a row (one word in 8, in runs of a few words more often). Every
passage of 17 words has such a cut, which depends on its words alone: passages that begin or end
inside a line still share their inner units, whatever their words are.
Units are compared lower-cased (A-Z) with white space collapsed. Only runs of repeated units with
``min_words`` words in all are removed, so that short common lines stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.wordbytes import _ODD, U64, Words, mix64, slices, window_hashes
from helixframe.llm.bitmap import bitmap, may_hold, maybe
from helixframe.llm.hot import join_hot
from helixframe.runtime import discard, settle

#: place: the unit's number and, lowest, whether its text has had it before; words, chars: from (high half) and to.
_UNITS = "d1 long, d2 long, doc_id long, _text long, place long, words long, chars long"
#: Words that a cut's hash is of, and places of which one is a cut at least.
NEAR, AMONG = 3, 15
_NAMES = [x.split()[0] for x in _UNITS.split(", ")]


def _cuts(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words after which a text is cut by their hashes: of each AMONG places in a row in one text, the last of the least."""
    x, n = window_hashes(h, NEAR), len(h) - NEAR - AMONG + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    at, least = np.arange(n) + AMONG - 1, x[AMONG - 1 :]
    for back in range(AMONG - 2, -1, -1):
        less = x[back : back + n] < least
        at, least = np.where(less, np.arange(n) + back, at), np.where(less, x[back : back + n], least)
    return np.unique(at[owner[:n] == owner[NEAR + AMONG - 2 :]]) + NEAR - 1


def _units(batches: Iterator[pa.RecordBatch], sent=None) -> Iterator[pa.RecordBatch]:
    """Units of each text; with a bit map, those whose digest it may hold."""
    for s in slices(batches):
        w = Words(s.column("text"), lower=True)
        n = len(w.start)
        if not n:
            continue
        h, data = w.hashes(), w.data
        last = data[w.stop - 1]
        gap_nl = np.concatenate([[0], np.cumsum(data == 10)])
        cut = (last == 46) | (last == 33) | (last == 63)
        cut[_cuts(h, w.owner())] = True
        cut[:-1] |= gap_nl[w.start[1:]] > gap_nl[w.stop[:-1]]
        ends = w.ptr[1:][w.ptr[1:] > w.ptr[:-1]]
        cut[ends - 1] = True  # a text's last word
        stop = np.flatnonzero(cut) + 1
        start = np.concatenate([[0], stop[:-1]])
        size = stop - start
        rel = np.arange(n) - np.repeat(start, size)
        with np.errstate(over="ignore"):
            pw = [np.multiply.accumulate(np.concatenate([[U64(1)], np.full(int(size.max()), _ODD[k], U64)])) for k in (20, 21)]
            d1, d2 = (mix64(np.add.reduceat(h * p[rel], start) + size.astype(U64)).view(np.int64) for p in pw)
        owner = np.searchsorted(w.ptr, start, "right") - 1
        first_unit = np.searchsorted(start, w.ptr[owner])
        unit = np.arange(len(start)) - first_unit
        # a unit that its text has had before
        order = np.lexsort((unit, d1, owner))
        again = np.zeros(len(start), bool)
        again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]])
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[w.text_at[owner]]
        w0 = start - w.ptr[owner]
        keep = slice(None)
        if sent is not None:
            keep = np.flatnonzero(may_hold(sent.value, d1))
            owner = owner[keep]
        pair = lambda lo, hi: (lo.astype(np.int64) << 32) | hi.astype(np.int64)
        of = lambda c: s.column(c).take(pa.array(owner))
        place, words, at = unit * 2 + again, pair(w0, w0 + size), pair(chars[w.start[start]] - base, chars[w.stop[stop - 1]] - base)
        yield pa.RecordBatch.from_arrays([pa.array(d1[keep]), pa.array(d2[keep]), of("doc_id"), of("_text"), pa.array(place[keep]), pa.array(words[keep]), pa.array(at[keep])], _NAMES)


def repeated_spans(documents: DataFrame, min_words: int = 20) -> DataFrame:
    """Spans to remove: doc_id, _text (xxhash64 of the text), start, end (code points of the
    original text, end exclusive), n_words, kept_doc_id (where the span's first unit stays).

    The occurrence that stays is that of the smallest doc_id and, there, the first. Rows of one
    doc_id and one text are one document; null ids rank after all others and count as one id;
    null or blank texts have no units; other columns are ignored; an empty table has no spans.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("_text", F.xxhash64("text"))
    units = docs.mapInArrow(_units, _UNITS)
    groups = settle(units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept")).filter("n > 1"), "repeated-units")
    sent = documents.sparkSession.sparkContext.broadcast(bitmap(groups, F.col("d1")))
    units = docs.mapInArrow(lambda it: _units(it, sent), _UNITS)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mine = join_hot(units, groups, ["d1", "d2"], "n", total, "doc_id").filter((F.col("place") % 2 == 1) | (F.col("doc_id") > F.col("kept")))
    low = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    high = lambda c: F.shiftright(F.col(c), 32)
    w = Window.partitionBy("doc_id", "_text").orderBy("place")
    run = F.shiftright("place", 1) - F.dense_rank().over(w)  # rises where a unit between is no repeat
    runs = mine.withColumn("_run", run).groupBy("doc_id", "_text", "_run").agg(F.min(high("chars")).cast("int").alias("start"), F.max(low("chars")).cast("int").alias("end"), (F.max(low("words")) - F.min(high("words"))).alias("n_words"), F.min_by("kept", "place").alias("kept_doc_id"))
    null_back = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c)).alias(c)
    out = settle(runs.filter(F.col("n_words") >= min_words).select(null_back("doc_id"), "_text", "start", "end", "n_words", null_back("kept_doc_id")), "repeated-spans")
    discard(groups)
    return out


def remove_repeats(documents: DataFrame, min_words: int = 20) -> DataFrame:
    """``documents`` with repeated spans cut out of ``text``; rows and other columns stay, n_chars
    (if there) follows. White space around a cut stays as it was.

    Null and blank texts stay as they are; rows of one id and text are cut alike; rows with a null
    id are cut by what other rows have, and by null ids with other texts; an empty table stays empty.
    """
    spans = repeated_spans(documents, min_words).groupBy("doc_id", "_text").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    held = bitmap(spans, F.xxhash64("doc_id", "_text"))
    docs = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    # only documents that have spans, by a fixed bit map, go into the shuffle
    may = maybe(documents.sparkSession, held, F.xxhash64("id", "hash"))
    joined = docs.filter(may).join(spans.hint("merge"), docs["id"].eqNullSafe(spans["doc_id"]) & (docs["hash"] == spans["_text"]), "left").select("row", "text", "cuts")
    text = F.col("text")
    # the kept pieces: from the end of one cut to the start of the next
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("cuts"))
    pieces = F.transform(cuts, lambda c, i: F.substring(text, c["end"] + 1, F.coalesce(F.get(cuts, i + 1)["start"], F.length(text)) - c["end"]))
    out = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(pieces, ""))
    left = F.when(F.col("cuts").isNull(), F.length(text)).otherwise(F.aggregate("cuts", F.length(text), lambda n, c: n - (c["end"] - c["start"])))
    cols = [out.alias("text") if c == "text" else left.cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in documents.columns]
    plain = docs.filter(~may).withColumn("cuts", F.lit(None).cast("array<struct<start: int, end: int>>")).select("row", "text", "cuts")
    return plain.select(*cols).unionByName(joined.select(*cols))
