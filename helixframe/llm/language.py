"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a text's
is the product over its words. Piece probabilities come from expectation maximisation (forward
and backward sums) over words of a bounded sample of labelled documents.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.kept import keep
from helixframe.llm.wordbytes import slices


def _ranges(first: str) -> str:
    """The code points whose Unicode category begins with a letter, as ranges of a character class."""
    of = [unicodedata.category(chr(c))[0] == first for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(of)) if of[c] != (c > 0 and of[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], [*edges[1::2], len(of)]))


#: The same for texts of plain characters only, much faster; those that were seen to be plain.
_QUICK, _PLAIN = re.compile(r"[^\W\d_]+"), set()


@functools.cache
def _word() -> re.Pattern:
    """A letter, then letters and their marks."""
    letters = _ranges("L")
    return re.compile(f"[{letters}][{letters}{_ranges('M')}]*")


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Probability of a character that is no piece, and the factor per character that keeps sums near 1.
_UNKNOWN, _SCALE = 1e-7, 12.0
#: Words whose scores a worker keeps before it starts anew.
MEMO = 100_000
#: Longer words are scored one by one in log space.
_LONG = 48


def load_pieces(path: str) -> list[str]:
    """The vocabulary's lower-case pieces that can stand in a word: letters, or a word start mark."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in {p.lower() for p in pieces} if p.lstrip("▁").isalpha() and p.count("▁") <= 1)


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L) with marks inside, lower-cased."""
    text = text.lower()
    new = set(text) - _PLAIN
    odd = {c for c in new if unicodedata.category(c)[0] == "M" or _QUICK.match(c) and unicodedata.category(c)[0] != "L"}
    _PLAIN.update(new - odd)
    return (_word() if odd else _QUICK).findall(text)


class Lattice:
    """Looks up the pieces of many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        keys = []
        for p in pieces:
            h = 0
            for ch in p:
                h = (h * _BASE + ord(ch) + 1) & _MASK
            keys.append(h)
        keys = np.array(keys, np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.single = {p for p in pieces if len(p) == 1}

    def arcs(self, words: list[str]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Words with a start mark of one length class: their lengths and, by start, arcs as (length, words, pieces);
        piece len(pieces) is the unknown character."""
        marked = ["▁" + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        width = int(size.max())
        codes = np.zeros((len(marked), width), np.uint64)
        codes[np.arange(width) < size[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        out = []
        with np.errstate(over="ignore"):
            for start in range(width):
                here, h = [], np.zeros(len(marked), np.uint64)
                for length in range(1, min(self.longest, width - start) + 1):
                    h = h * np.uint64(_BASE) + codes[:, start + length - 1] + np.uint64(1)
                    can = np.flatnonzero((size >= start + length) & self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                    at = np.searchsorted(self.keys, h[can])
                    at[at == len(self.keys)] = 0
                    ok = self.keys[at] == h[can]
                    rows, ids = can[ok], self.order[at[ok]]
                    if length == 1:
                        known = np.zeros(len(marked), bool)
                        known[rows] = True
                        bare = np.flatnonzero((size > start) & ~known)
                        rows, ids = np.concatenate([rows, bare]), np.concatenate([ids, np.full(len(bare), len(self.pieces))])
                    if len(rows):
                        here.append((length, rows, ids))
                out.append(here)
        return size, out

    def forward(self, size: np.ndarray, arcs: list, probs: np.ndarray) -> np.ndarray:
        """alpha[position, word, language], scaled by _SCALE a character. probs: pieces and unknown, by language."""
        alpha = np.zeros((len(arcs) + 1, len(size), probs.shape[1]))
        alpha[0] = 1
        for start, here in enumerate(arcs):
            for length, rows, ids in here:
                alpha[start + length, rows] += alpha[start, rows] * (probs[ids] * _SCALE**length)
        return alpha

    def log_scores(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """The log probability of each word in each language."""
        out = np.zeros((len(words), probs.shape[1]))
        by = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(by):
            end = min(at + 20_000, len(by))
            wide = len(words[by[at]]) * 3 // 2 + 4  # chunks of like lengths
            while end > at + 1 and len(words[by[end - 1]]) > wide:
                end = at + max(1, (end - at) // 2)
            own = by[at:end]
            if len(words[own[-1]]) > _LONG:
                for i in own:
                    out[i] = self._log_one(words[i], probs) if len(words[i]) > _LONG else self.log_scores([words[i]], probs)[0]
            else:
                size, arcs = self.arcs([words[i] for i in own])
                alpha = self.forward(size, arcs, probs)
                out[own] = np.log(alpha[size, np.arange(len(own))]) - size[:, None] * math.log(_SCALE)
            at = end
        return out

    def _log_one(self, word: str, probs: np.ndarray) -> np.ndarray:
        """As log_scores for one word, by windows of positions, rescaled at each step."""
        marked = "▁" + word
        index = {p: i for i, p in enumerate(self.pieces)} if not hasattr(self, "_index") else self._index
        self._index = index
        span = self.longest
        ring, logs = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
        for end in range(1, len(marked) + 1):
            total = np.zeros(probs.shape[1])
            for k in range(1, min(span, end) + 1):
                i = index.get(marked[end - k : end], len(self.pieces) if k == 1 else None)
                if i is not None:
                    total = total + ring[-k] * probs[i]
            ring.append(total)
            ring = [r / total for r in ring[-span:]]
            logs = logs + np.log(total)
        return logs


class Model:
    """Languages, pieces and their probabilities; small enough to send to every worker."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs


def train(texts: dict[str, list[str]], pieces: list[str], rounds: int = 3, most_words: int = 30_000) -> Model:
    """Expectation maximisation for each language over the ``most_words`` commonest words of its
    sample, without those of more than 48 letters: both bound what is fitted, not what is scored."""
    lattice, langs = Lattice(pieces), sorted(texts)
    probs = np.zeros((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        count: Counter = Counter()
        for t in texts[lang]:
            count.update(words_of(t))
        top = [(w, c) for w, c in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most_words] if len(w) <= _LONG]
        p = np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1))
        groups = []
        top.sort(key=lambda x: len(x[0]))
        for at in range(0, len(top), 10_000):
            part = top[at : at + 10_000]
            groups.append((np.array([c for _, c in part], float), *lattice.arcs([w for w, _ in part])))
        for _ in range(rounds):
            found = np.full(len(pieces) + 1, 0.01)
            for weight, size, arcs in groups:
                alpha = lattice.forward(size, arcs, p)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[size, np.arange(len(size))] = 1
                for start in range(len(arcs) - 1, -1, -1):
                    for length, rows, ids in arcs[start]:
                        beta[start, rows] += beta[start + length, rows] * p[ids, 0] * _SCALE**length
                z = weight / np.maximum(beta[0], 1e-300)
                for start, here in enumerate(arcs):
                    for length, rows, ids in here:
                        np.add.at(found, ids, alpha[start, rows] * beta[start + length, rows] * p[ids, 0] * _SCALE**length * z[rows])
            p = (found / found.sum())[:, None]
        probs[:, k] = p[:, 0]
    probs[-1] = _UNKNOWN
    return Model(langs, pieces, probs)


def fit(documents: DataFrame, pieces: list[str], per_lang: int = 400, most_docs: int = 4000, most_chars: int = 20_000) -> Model:
    """A model from labelled rows: up to about ``per_lang`` documents a language and ``most_docs``
    in all, drawn by a hash of id and text, and of each ``most_chars`` at most. Null texts and labels
    are left out; without any labelled text the model knows no language."""
    rows = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_docs).collect()}
    each = min(per_lang, most_docs // max(len(sizes), 1))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in sizes.items()]) if sizes else F.lit(0.0)
    # of a long text a piece of most_chars, from a place that its hash names: the sample is bounded in bytes too
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - most_chars + 1, F.lit(1))) + 1
    piece = F.when(F.length("text") <= most_chars, F.col("text")).otherwise(F.substring("text", at.cast("int"), F.lit(most_chars)))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", piece.alias("text")).limit(2 * most_docs).collect()
    texts: dict[str, list[str]] = {k: [] for k in sizes}
    for r in drawn:
        texts[r["lang"]].append(r["text"])
    return train(texts, pieces)


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: log probability in each language, and whether it has a letter."""
        words = [words_of(t) if t else [] for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        index = self.index
        new = [w for w in set(flat) if w not in index]
        if len(index) + len(new) > MEMO and index:
            index.clear()
            self.table = self.table[:0]
            new = list(set(flat))
        if new:
            new.sort()
            index.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.lattice.log_scores(new, self.model.probs)])
        at = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        total = np.zeros((len(texts), len(self.model.langs)))
        full = np.flatnonzero(size)
        if len(full):
            total[full] = np.add.reduceat(self.table[at], (np.cumsum(size) - size)[full])
        return total, size > 0


def _predictions(batches: Iterator[pa.RecordBatch], sent, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    scorer = keep(("language", sent.id), lambda: _Scorer(sent.value))
    for s in slices(batches, text, keeping=True):
        total, has = scorer.totals(s.column(s.schema.get_field_index(text)).to_pylist())
        if not scorer.model.langs:
            yield s, ["und"] * len(s), np.zeros(len(s))
            continue
        best = total.argmax(1)
        post = 1 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(1)
        yield s, [scorer.model.langs[k] if h else "und" for k, h in zip(best, has)], np.where(has, post, 0.0)


class Sent:
    """A broadcast model with a name that workers can keep their tables by."""

    def __init__(self, spark, model: Model):
        self.id, self.sent = hash((tuple(model.langs), model.probs.tobytes())), spark.sparkContext.broadcast(model)

    @property
    def value(self) -> Model:
        return self.sent.value


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the posterior under equal priors).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
    was learned; ties go to the first language by name; null ids stay null; repeated rows are
    predicted each; other columns are never read; an empty table gives no rows.
    """
    sent = Sent(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, langs, score in _predictions(batches, sent):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose language is known with a posterior of ``least`` or more.

    Null texts and those without a letter go, and so do all if nothing was learned; null ids,
    repeated rows and columns of any name are kept as they are; an empty table gives no rows.
    """
    sent = Sent(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, langs, score in _predictions(batches, sent):
            yield s.filter(pa.array([k != "und" and p >= least for k, p in zip(langs, score)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
