"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample.

A rule looks at a batch of texts and says which it rejects. The verdict is the same in any order:
a document is kept when no rule rejects it. The order only decides how soon a bad document stops
costing time, so each task chooses it from a bounded sample of its own, the first texts it reads: what
each measure costs there, once words are known, and what each rule rejects. The next rule is always
the one with the most rejections, among texts that the rules before it leave, for the time of the
measures that those have not made yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.wordbytes import _ODD, U64, Words, mix64, slices, window_hashes


class Batch:
    """A batch of texts with what the rules need, made on first use."""

    def __init__(self, texts: pa.Array):
        self.texts = texts.cast(pa.large_string()).fill_null("")
        self.words = Words(self.texts)
        self._made: dict[str, np.ndarray] = {}

    def take(self, at: np.ndarray) -> Batch:
        """Some of the texts, with what has been made for them."""
        out = Batch(self.texts.take(pa.array(at)))
        out._made = {k: v[at] for k, v in self._made.items()}
        return out

    def fresh(self) -> Batch:
        """The same words, with nothing made of them."""
        out = object.__new__(Batch)
        out.texts, out.words, out._made = self.texts, self.words, {}
        return out

    def get(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = FEATURES[name](self)
        return self._made[name]

    def bytes_where(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[self.words.text_at]).astype(np.int64)


def _among(chars: bytes) -> Callable[[Batch], np.ndarray]:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return lambda b: b.bytes_where(table[b.words.data])


def _lines(b: Batch) -> np.ndarray:
    """Per text: lines with a word, and those of them that equal an earlier line."""
    if "_lines" not in b._made:
        raw, at, out = b.words.data.tobytes(), b.words.text_at, []
        for i in range(len(at) - 1):
            found = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
            out.append((len(found), len(found) - len(set(found))))
        b._made["_lines"] = np.array(out, np.int64).reshape(-1, 2)
    return b._made["_lines"]


def _repeat_words(b: Batch) -> np.ndarray:
    """Words of each text in 3-word windows that it has twice or more."""
    w = b.words
    if len(w.start) < 3:
        return np.zeros(len(w.ptr) - 1, np.int64)
    owner = w.owner()
    win = window_hashes(w.hashes(), 3)
    own = owner[:-2]
    at = np.flatnonzero(own == owner[2:])
    with np.errstate(over="ignore"):
        key = mix64(win[at] + own[at].astype(U64) * _ODD[9])
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    if len(s):
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= s[1:] == s[:-1]
    twice = at[order[same]]
    hit = np.zeros(len(owner), bool)
    for k in range(3):
        hit[twice + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[w.ptr]).astype(np.int64)


def _alpha_words(b: Batch) -> np.ndarray:
    """Words with an ASCII letter or any character beyond ASCII."""
    w = b.words
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = True
    table[128:] = True
    total = np.concatenate([[0], np.cumsum(table[w.data])])
    has = total[w.stop] > total[w.start]
    return np.diff(np.concatenate([[0], np.cumsum(has)])[w.ptr]).astype(np.int64)


FEATURES: dict[str, Callable[[Batch], np.ndarray]] = {
    "n_words": lambda b: b.words.counts().astype(np.int64),
    "word_chars": lambda b: b.bytes_where(b.words.inside & ((b.words.data & 0xC0) != 0x80)),
    "n_symbols": _among(b"#*$%&|<>"),
    "n_exclaim": _among(b"!"),
    "n_upper": _among(bytes(range(65, 91))),
    "n_lower": _among(bytes(range(97, 123))),
    "n_lines": lambda b: _lines(b)[:, 0],
    "n_dup_lines": lambda b: _lines(b)[:, 1],
    "n_repeat_words": _repeat_words,
    "n_alpha_words": _alpha_words,
}


class Rule(NamedTuple):
    """Rejects where ``per_cent_of * of  <  100 * have`` (over) or ``>`` (under)."""

    name: str
    have: str
    per_cent: int
    of: str
    over: bool = True

    def rejects(self, b: Batch) -> np.ndarray:
        have, most = 100 * b.get(self.have), self.per_cent * (b.get(self.of) if self.of != "1" else 1)
        return have > most if self.over else have < most


#: Rejected before any cascade: fewer than 50 words, or over half the words in repeated windows.
BASE = (Rule("few_words", "n_words", 5000, "1", False), Rule("repeats", "n_repeat_words", 50, "n_words"))
RULES = (
    Rule("symbols", "n_symbols", 10, "n_words"),
    Rule("exclaim", "n_exclaim", 20, "n_words"),
    Rule("capitals", "n_upper", 50, "n_letters"),
    Rule("dup_lines", "n_dup_lines", 30, "n_lines"),
    Rule("few_alpha", "n_alpha_words", 70, "n_words", False),
    Rule("short_words", "word_chars", 200, "n_words", False),
    Rule("long_words", "word_chars", 1500, "n_words"),
)
FEATURES["n_letters"] = lambda b: b.get("n_upper") + b.get("n_lower")


#: Measures that come from others.
_FROM = {"n_letters": ("n_upper", "n_lower"), "n_lines": ("_lines",), "n_dup_lines": ("_lines",)}


def _needs(r: Rule) -> set[str]:
    """What a rule's measures are made of."""
    return {x for f in (r.have, r.of) if f != "1" for x in _FROM.get(f, (f,))}


def _seconds(make: Callable[[], object]) -> float:
    """The shorter of two runs."""
    out = []
    for _ in range(2):
        began = time.perf_counter()
        make()
        out.append(time.perf_counter() - began)
    return max(min(out), 1e-9)


def order_rules(b: Batch, rules: tuple[Rule, ...], sample: int = 1000, alive: np.ndarray | None = None) -> tuple[Rule, ...]:
    """The rules, best first, by at most ``sample`` texts of a batch; ties keep their order. What the
    batch has made already costs nothing; ``alive``: texts that come to the rules at all."""
    part = b.take(np.arange(min(sample, len(b.texts))))
    live = np.ones(len(part.texts), bool) if alive is None else alive[: len(part.texts)].copy()
    cost = {x: 0.0 if x in b._made else _seconds(lambda x=x: (_lines if x == "_lines" else FEATURES[x])(part.fresh())) for r in rules for x in _needs(r)}
    rejects = {r.name: r.rejects(part) for r in rules}
    look = {r.name: _seconds(lambda r=r: r.rejects(part)) for r in rules}
    out, left, made = [], list(rules), set()
    while left:
        worth = lambda r: (rejects[r.name] & live).sum() / (look[r.name] + sum(cost[x] for x in _needs(r) - made))
        best = max(left, key=worth)
        left.remove(best)
        out.append(best)
        made |= _needs(best)
        live &= ~rejects[best.name]
    return tuple(out)


def cascade(b: Batch, rules: tuple[Rule, ...], alive: np.ndarray) -> np.ndarray:
    """Which texts no rule rejects; a rule's measures are only made for texts still alive, once those
    are under half of the batch at hand. ``alive``: at the start."""
    whole, at, part = np.flatnonzero(alive), np.flatnonzero(alive), b  # numbers in b and in part
    for r in rules:
        if not len(at):
            break
        if 2 * len(at) < len(part.texts) and not _needs(r) <= set(part._made):
            part, at = part.take(at), np.arange(len(at))
        good = ~r.rejects(part)[at]
        whole, at = whole[good], at[good]
    out = np.zeros(len(alive), bool)
    out[whole] = True
    return out


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(batches: Iterator[pa.RecordBatch], base: tuple[Rule, ...], rules: tuple[Rule, ...], sample: int) -> Iterator[pa.RecordBatch]:
    ordered = None
    for s in slices(batches):
        b = Batch(s.column("text"))
        for c in _LONGS:
            b.get(c)
        failed = np.zeros(len(b.texts), bool)
        for r in base:
            failed |= r.rejects(b)
        # what the base has measured is there; the cascade works on what the base left
        ordered = ordered or order_rules(b, rules, sample, ~failed)
        kept = cascade(b, ordered, ~failed)
        yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(b.get(c), pa.int64()) for c in _LONGS), pa.array(failed), pa.array(kept)], ["doc_id", *_LONGS, "base_failed", "kept"])


def assess(documents: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample: int = 1000) -> DataFrame:
    """Per row: doc_id, the measures of its whole text, base_failed, and kept.

    A null text counts as empty, which the base rejects; a null doc_id stays null; repeated rows
    are judged each; other columns are ignored; an empty table gives no rows. Each task orders the
    rules by the first ``sample`` texts it reads at most; the verdict is the same in any order.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _score(it, base, tuple(rules), sample), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample: int = 1000) -> DataFrame:
    """The rows of ``documents``, all columns, that base and rules keep, by the cascade throughout:
    here no measure is needed for its own sake, so base rules stand in the cascade too.

    A null or empty text is rejected (it has too few words); null ids, repeated rows and columns of
    any name are kept as they are; ``text`` may be of any type that casts to a string; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = None
        for s in slices(batches):
            b = Batch(s.column(s.schema.get_field_index("text")))
            ordered = ordered or order_rules(b, tuple(base) + tuple(rules), sample)
            yield s.filter(pa.array(cascade(b, ordered, np.ones(len(b.texts), bool))))

    return documents.mapInArrow(run, documents.schema)
