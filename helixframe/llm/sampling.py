"""Sampled SentencePiece segmentations without replacement, by perturbed search of the lattice.

A text's segmentations into pieces of a public vocabulary have probabilities in proportion to the
product of their pieces' weights, 1 / (rank + 2) to the power ``alpha``. Gumbel top-k draws k
distinct ones: the search keeps a queue of disjoint parts of the lattice, each a prefix of pieces
whose next piece is open (or excludes some), with the greatest perturbed log probability in it;
that of a part inside another is drawn conditionally, truncated at the parent's. The best part is
taken first and followed to a whole path, and what branches off on the way joins the queue. The
draws depend on the row key, the sample and the place in the text alone.

A piece never crosses from a word into the next word's start mark, nor a line end, so the lattice
of a text is a chain of lattices of its words; equal words share theirs, also from one batch of
texts to the next.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.kept import keep
from helixframe.llm.wordbytes import _ODD, U64, mix64, slices

#: A stand-in, while a text is segmented, for a U+2581 of its own, which goes by bytes.
_OWN_MARK = "\udfff"
#: Units of a text: words with their start marks, cut before a stop or comma that follows a letter,
#: as no piece goes across; line ends and tabs.
_UNITS = re.compile("▁*+(?:[^▁\n\t.,]++(?:(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,])|[^▁\n\t]*+)|[.,][^▁\n\t]*+)|▁++|[\n\t]")
_CROSSES = re.compile("[^▁]▁|[\n\t]|[A-Za-zÀ-ÖØ-öø-ÿ][.,]")
#: No Gumbel draw from 53 bits is greater.
_TOP_DRAW = 37.0
#: Weight of a character that goes by bytes.
_BYTES_WEIGHT = 1e-6
#: Places of units whose lattices a worker keeps, at about 90 bytes each; a batch of texts with more has its own.
_KEPT_PLACES = 2_000_000
#: Steps of a path whose branches are drawn together with those of other paths, and paths at a time.
_STEPS, _PATHS = 512, 64
_MASK = (1 << 64) - 1
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Vocabulary:
    """Pieces and weights, and the bytes that each id decodes to."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        by_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.pieces = {}
        shown = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if i in by_byte:
                shown.append(by_byte[i])
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                shown.append(b"")
            else:
                if _CROSSES.search(p):
                    raise ValueError(f"piece {p!r} crosses the units of a text")
                self.pieces[p] = i
                shown.append(p.replace("▁", " ").encode())
        self.longest = max(map(len, self.pieces))
        ids = np.array(sorted(self.pieces.values()))
        self.weight = np.full(n, _BYTES_WEIGHT)
        self.weight[ids] = (1.0 / (np.arange(len(ids)) + 2)) ** alpha
        self.log_weight = np.log(np.append(self.weight, _BYTES_WEIGHT))
        keys, starts = [], set()
        for p in self.pieces:
            h = 0
            for ch in p:
                starts.add(h * _SPREAD & _MASK)
                h = (h * _BASE + ord(ch) + 1) & _MASK
            keys.append(h * _SPREAD & _MASK)
        self.begins = np.zeros(1 << 20, bool)  # by the high bits of what pieces begin with
        self.begins[[h >> 44 for h in starts]] = True
        keys = np.array(keys, U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.pieces.values()))[order]
        # a key's place by its high 20 bits; keys that share them come before it
        slot = (self.keys >> U64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[slot] = np.arange(len(slot))
        share = np.bincount(slot, minlength=1 << 20)
        self.crowded, self.most_crowded = share > 1, int(share.max())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.lattices = Lattices()

    def bytes_of(self, code: int) -> list[int]:
        raw = "▁".encode() if code == 0xDFFF else chr(code).encode()
        return [self.byte_ids[b] for b in raw]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the start mark of the whole."""
        return self.decode_marked(ids).removeprefix(b" ")

    def decode_marked(self, ids: np.ndarray) -> bytes:
        size = self.shown_size[ids]
        return self.shown[_ranges(self.shown_at[ids], size)].tobytes()


def _vocabulary(path: str, alpha: float) -> Vocabulary:
    return keep(("sampling", path, alpha), lambda: Vocabulary(path, alpha))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size says."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Lattices:
    """The lattices of units, made when a unit is first met: a row for each unit and place, with its arcs, longest first.

    Arrays by arc: length, piece (a character that goes by bytes: -1 - code), log share of the
    row's probability, their running sum of shares, and the row. What a unit's arrays hold depends
    on the unit alone, not on the units that are here already.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.units = self.rows = self.arcs = 0
        self.size, self.base, self.ptr = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)  # in how many batches, halved when room is made
        self.length, self.piece, self.log_share, self.cum, self.row = np.zeros(0, np.int16), np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0, np.int32)

    def numbers(self, flat: list[str], v: Vocabulary) -> np.ndarray:
        """The number of each unit, until the next call; new ones get their lattices by the one vocabulary of these."""
        out = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list(dict.fromkeys([flat[i] for i in missing]))
            if self.units and self.rows + sum(map(len, new)) > _KEPT_PLACES:
                if self.rows > _KEPT_PLACES // 2:
                    self._make_room()
                else:
                    self.clear()
                return self.numbers(flat, v)
            self.number.update(zip(new, range(self.units, self.units + len(new))))
            self._make(new, v)
            out[missing] = np.fromiter(map(self.number.__getitem__, [flat[i] for i in missing]), np.int64, len(missing))
        self.met[out] += 1
        return out

    def _make_room(self) -> None:
        """Keeps the units that most batches had, in half of the room at most."""
        met, size, base = self.met[: self.units], self.size[: self.units], self.base[: self.units]
        least = 2
        while size[met >= least].sum() > _KEPT_PLACES // 2:
            least += 1
        stay = np.flatnonzero(met >= least)
        names, met, size, rows = list(self.number), met[stay] // 2, size[stay], _ranges(base[stay], size[stay])
        count = self.ptr[rows + 1] - self.ptr[rows]
        arcs = _ranges(self.ptr[rows], count)
        by_arc = {name: getattr(self, name)[arcs] for name in ("length", "piece", "log_share", "cum")}
        self.number = {names[i]: n for n, i in enumerate(stay.tolist())}
        self.units, self.rows, self.arcs = len(stay), len(rows), len(arcs)
        self.met, self.size, self.base, self.ptr = met, size, np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(count)])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), count)
        for name, new in by_arc.items():
            setattr(self, name, new)

    def trim(self) -> None:
        """Lets go of lattices that take more room than is kept."""
        if self.rows > _KEPT_PLACES:
            self.clear()

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        have = getattr(self, name)
        if at + len(new) > len(have):
            more = np.empty(max(at + len(new), at + (at >> 1)), np.int64 if name == "row" and self.rows + len(new) >= 1 << 31 else have.dtype)
            more[:at] = have[:at]
            setattr(self, name, more)
            have = more
        have[at : at + len(new)] = new

    def _make(self, units: list[str], v: Vocabulary) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        base = np.concatenate([[0], np.cumsum(size)])
        found: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, rows, pieces
        self._arcs(units, size, base, v, found)
        rows_all = int(base[-1])
        count = np.zeros(rows_all, np.int64)
        for _, rows, _ in found:
            count[rows] += 1  # a row has one arc of a length at most
        ptr = np.concatenate([[0], np.cumsum(count)])
        fill = ptr[:-1].copy()
        n = int(ptr[-1])
        lengths, piece, log_w = np.zeros(n, np.int16), np.zeros(n, np.int32), np.zeros(n)
        for length, rows, pieces in sorted(found, key=lambda x: -x[0]):
            to = fill[rows]
            fill[rows] += 1
            lengths[to], piece[to] = length, pieces
            log_w[to] = v.log_weight[np.maximum(pieces, -1)]  # the last is that of bytes
        # sums over all segmentations from each place to its unit's end, last places first
        rest = np.repeat(base[1:], size) - np.arange(rows_all)
        by_rest = np.argsort(rest.astype(np.int16) if rest.max(initial=0) < 1 << 15 else rest, kind="stable")
        row = np.repeat(np.arange(rows_all), count)
        to = row + lengths
        to[lengths == rest[row]] = rows_all  # a unit's end, where the log sum is 0
        many = count[by_rest]
        order = _ranges(ptr[by_rest], many)
        to, log_w = to[order], log_w[order]
        first = np.cumsum(many) - many
        edges = np.searchsorted(rest[by_rest], np.arange(1, int(rest.max(initial=0)) + 2)).tolist()
        log_beta, share, log_share = np.zeros(rows_all + 1), np.zeros(n), np.zeros(n)
        for r, t in zip(edges, edges[1:]):
            if r == t:
                continue
            a, b = int(first[r]), int(first[t]) if t < rows_all else n
            at, each = first[r:t] - a, many[r:t]
            value = log_w[a:b] + log_beta[to[a:b]]
            top = np.maximum.reduceat(value, at)
            value -= np.repeat(top, each)
            e = np.exp(value)
            total = np.add.reduceat(e, at)
            log_total = np.log(total)
            log_beta[by_rest[r:t]] = top + log_total
            share[order[a:b]] = e / np.repeat(total, each)
            log_share[order[a:b]] = value - np.repeat(log_total, each)
        at = np.flatnonzero(count > 1)
        while len(at):  # each row by itself: the same sums wherever it lies
            arcs = ptr[at + 1] - count[at] + 1
            share[arcs] += share[arcs - 1]
            count[at] -= 1
            at = at[count[at] > 1]
        if n:
            share[ptr[1:] - 1] = 2.0  # rounding never leaves a row
        self._put("size", self.units, size)
        self._put("met", self.units, np.zeros(len(units), np.int64))
        self._put("base", self.units + 1, base[1:] + self.rows)
        self._put("row", self.arcs, row + self.rows)
        self._put("ptr", self.rows + 1, ptr[1:] + self.arcs)
        for name, new in (("length", lengths), ("piece", piece), ("log_share", log_share), ("cum", share)):
            self._put(name, self.arcs, new)
        self.units, self.rows, self.arcs = self.units + len(units), self.rows + rows_all, self.arcs + n

    def _arcs(self, units: list[str], size: np.ndarray, base: np.ndarray, v: Vocabulary, found: list) -> None:
        """Arcs of each length from each row; rows whose letters so far begin no piece drop out."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        ends = np.repeat(base[1:], size)
        rows, h = np.arange(len(codes)), codes + U64(1)
        for length in range(1, v.longest + 1):
            with np.errstate(over="ignore"):
                spread = h * U64(_SPREAD)
            slot = (spread >> U64(44)).astype(np.int32)
            at = v.slot[slot]
            can = np.flatnonzero(at >= 0)
            at = at[can]
            hh = spread[can]
            ok = v.keys[at] == hh
            miss = np.flatnonzero(~ok)
            miss = miss[v.crowded[slot[can[miss]]]]
            for _ in range(v.most_crowded - 1):  # keys of one slot lie side by side; the slot names the last
                at[miss] -= 1
                ok[miss] = v.keys[at[miss]] == hh[miss]
                miss = miss[~ok[miss]]
            here, pieces = rows[can[ok]], v.ids[at[ok]]
            if length == 1:
                bare = np.ones(len(codes), bool)
                bare[here] = False
                bare = np.flatnonzero(bare)
                here, pieces = np.concatenate([here, bare]), np.concatenate([pieces, -1 - codes[bare].astype(np.int64)])
            if len(here):
                found.append((length, here, pieces))
            go = np.flatnonzero(v.begins[slot] & (rows + length < ends[rows]))
            if not len(go):
                break
            rows = rows[go]
            with np.errstate(over="ignore"):
                h = h[go] * U64(_BASE) + codes[rows + length] + U64(1)

    def walk(self, unit: np.ndarray, place: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws the rest of each unit's path from a place on: all arcs, in order, and their number by unit.
        key, at: what the draws depend on, and the place of each unit in its text."""
        who, arcs = [], []
        row, end = self.base[unit] + place, self.base[unit + 1]
        with np.errstate(over="ignore"):
            key = key + (at + place).astype(U64) * _ODD[3]
        live = np.flatnonzero(row < end)
        row, end, key = row[live], end[live], key[live]
        while len(live):
            r = (mix64(key) >> U64(11)).astype(np.float64) * 2.0**-53
            arc = self.ptr[row]
            act = np.flatnonzero(r >= self.cum[arc])
            while len(act):
                arc[act] += 1
                act = act[r[act] >= self.cum[arc[act]]]
            who.append(live)
            arcs.append(arc)
            length = self.length[arc]
            row = row + length
            go = np.flatnonzero(row < end)
            with np.errstate(over="ignore"):
                key = key[go] + length[go].astype(U64) * _ODD[3]
            live, row, end = live[go], row[go], end[go]
        count = np.zeros(len(unit), np.int64)
        for w in who:
            count[w] += 1
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for step, (w, a) in enumerate(zip(who, arcs)):
            out[first[w] + step] = a
        return out, count


def _uniform(key: np.ndarray | int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix64(np.asarray(key, U64) + U64(salt) * _ODD[5]) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(mass: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """The greatest of Gumbels of log mass ``mass``, given that it is under ``most``."""
    return mass - np.log(np.exp(np.minimum(mass - most, 700)) - np.log(u))


class _Path:
    """A sampled path of one text: arcs, and how many there are up to the end of each unit."""

    def __init__(self, arcs: np.ndarray, upto: np.ndarray, g: float, fresh: int, out: dict[int, set[int]]):
        self.arcs, self.upto, self.g, self.fresh, self.out = arcs, upto, g, fresh, out  # fresh: from where on it is its own; out: excluded arcs by step


def _branches(lat: Lattices, paths: list[_Path], keys: list[int], most: int) -> list[list[tuple[float, int]]]:
    """The best parts that branch off each path where it is its own: perturbed value and step.
    A row of a table for each path: what it gives doesn't depend on the others."""
    out: list[list[tuple[float, int]]] = []
    for at in range(0, len(paths), _PATHS):
        some, key = paths[at : at + _PATHS], np.array(keys[at : at + _PATHS], U64)
        best: list[list[tuple[float, int]]] = [[] for _ in some]
        before, who, start = np.zeros(len(some)), np.arange(len(some)), 0
        while len(who):
            part = [some[i].arcs[start : start + _STEPS] for i in who]
            here = np.arange(_STEPS) < np.array(list(map(len, part)))[:, None]
            arcs, log_share = np.zeros(here.shape, np.int64), np.zeros(here.shape)
            arcs[here] = np.concatenate(part)
            log_share[here] = lat.log_share[arcs[here]]
            upto = np.cumsum(log_share, 1)
            mass = upto - log_share + before[who, None]
            before[who] += upto[:, -1]
            rows = lat.row[arcs]
            can = here & (lat.ptr[rows + 1] - lat.ptr[rows] > 1) & (np.arange(start, start + _STEPS) >= np.array([some[i].fresh for i in who])[:, None])
            other = -np.expm1(log_share)
            exact = can & (other < 1e-9)  # where it rounds, or more is excluded
            for j, i in enumerate(who):
                for step in some[i].out:
                    if start <= step < start + _STEPS:
                        exact[j, step - start] = can[j, step - start]
            for j, x in np.argwhere(exact):
                gone = some[who[j]].out.get(start + int(x), {int(arcs[j, x])})
                other[j, x] = sum(float(np.exp(lat.log_share[a])) for a in range(lat.ptr[rows[j, x]], lat.ptr[rows[j, x] + 1]) if a not in gone)
            can &= other > 0
            j, x = np.nonzero(can)
            with np.errstate(over="ignore"):
                draws = _uniform(key[who[j]] + (x + start).astype(U64) * _ODD[6], 1)
            g = np.full(here.shape, -np.inf)
            g[j, x] = _truncated(mass[j, x] + np.log(other[j, x]), np.array([some[i].g for i in who])[j], draws)
            top = np.argpartition(-g, most - 1, 1)[:, :most] if most < _STEPS else np.broadcast_to(np.arange(_STEPS), here.shape)
            go = []
            for j, i in enumerate(who.tolist()):
                best[i] = sorted([*best[i], *((float(g[j, x]), start + int(x)) for x in top[j] if can[j, x])], reverse=True)[:most]
                # nothing further on can be greater than the mass that is left allows
                if len(some[i].arcs) > start + _STEPS and not (len(best[i]) == most and before[i] + _TOP_DRAW < best[i][-1][0]):
                    go.append(i)
            who, start = np.array(go, np.int64), start + _STEPS
        out += best
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts cut before each run of spaces, one of which begins a text: the number of each word
    there, what words the numbers stand for without their first space, and where each text's end."""
    parts = pc.split_pattern(texts, " ")
    size = np.asarray(pc.fill_null(pc.list_value_length(parts), 0), np.int64)
    coded = parts.flatten().dictionary_encode()
    word, found = np.array(coded.indices, np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" not in found:
        return word, found, np.cumsum(size)
    text = np.repeat(np.arange(len(texts)), size)
    some = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) > 0
    word, text, size = word[some[text]], text[some[text]], np.where(some, size, 0)
    # nothing between two spaces: they belong to what comes next in the text, or end it
    empty = word == found.index("")
    last = np.zeros(len(word), bool)
    last[(np.cumsum(size) - 1)[size > 0]] = True
    stays = ~empty | last
    at = np.flatnonzero(stays)
    spaces = np.diff(at, prepend=-1) - 1  # empty ones before
    number = {w: i for i, w in enumerate(found)}
    for i in np.flatnonzero(spaces).tolist():
        w = " " * int(spaces[i]) + found[word[at[i]]]
        word[at[i]] = number.setdefault(w, len(number))
    return word[at], list(number), np.cumsum(np.bincount(text[at], minlength=len(texts)))


def _units(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The units of words in order, and how many each word has."""
    joined = "▁" + "▁".join(words)
    if " " in joined or "" in words or joined.count("▁") > len(words):  # more spaces, or marks of the text's own
        each = [_UNITS.findall("▁" + w.replace("▁", _OWN_MARK).replace(" ", "▁")) for w in words]
        return [u for x in each for u in x], np.fromiter(map(len, each), np.int64, len(each))
    units = _UNITS.findall(joined) if words else []
    ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
    upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), "right")
    return units, np.diff(upto, prepend=0)


def segment(texts: list[str | None] | pa.Array, keys: list[int], v: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct segmentations, likeliest perturbed first: ids, log
    probability, and inclusion score."""
    word, words, ends = _words(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    flat, count = _units(words)
    lat = v.lattices
    number, first, upto = lat.numbers(flat, v), np.cumsum(count) - count, np.concatenate([[0], np.cumsum(count[word])])
    unit, ends = number[_ranges(first[word], count[word])], upto[ends]
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(texts)), ends - starts)
    chars = np.cumsum(lat.size[unit]) - lat.size[unit]
    at = chars - chars[np.minimum(starts, max(len(unit) - 1, 0))][doc] if len(unit) else chars
    base = np.array([x & _MASK for x in keys], U64)

    def key_of(s: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(mix64(base) + U64(s) * _ODD[7])

    done: list[list[_Path]] = [[] for _ in texts]
    queues: list[list[tuple[float, int, int]]] = [[] for _ in texts]
    for s in range(1, k + 1):
        draw = key_of(s)
        gumbel = -np.log(-np.log(_uniform(draw, 2)))
        todo, begin_unit, begin_place, heads = [], [], [], []
        for i in range(len(texts)):
            if starts[i] == ends[i]:
                continue
            if s == 1:
                todo.append(i)
                begin_unit.append(starts[i])
                begin_place.append(0)
                heads.append((None, None, float(gumbel[i]), 0, {}))
            elif queues[i]:
                g, n, step = heapq.heappop(queues[i])
                old = done[i][n]
                gone = set(old.out.get(step, ())) | {int(old.arcs[step])}
                row = lat.row[old.arcs[step]]
                open_ = np.array([a for a in range(lat.ptr[row], lat.ptr[row + 1]) if a not in gone])
                c = np.cumsum(np.exp(lat.log_share[open_]))
                arc = int(open_[min(int(np.searchsorted(c, float(_uniform(draw[i], 3)) * c[-1], "right")), len(open_) - 1)])
                nth = int(np.searchsorted(old.upto, step, "right"))
                u = starts[i] + nth
                todo.append(i)
                begin_unit.append(u)
                begin_place.append(row - lat.base[unit[u]] + lat.length[arc])
                heads.append((np.append(old.arcs[:step], arc), old.upto[:nth], -g, step, {step: gone | {arc}}))
        if not todo:
            break
        # the rest of the unit where each path goes on, and all units after it
        todo_a, first = np.array(todo), np.array(begin_unit)
        n = ends[todo_a] - first
        offset = np.cumsum(n) - n
        units = np.repeat(first - offset, n) + np.arange(int(n.sum()))
        place = np.zeros(len(units), np.int64)
        place[offset] = begin_place
        arcs, count = lat.walk(unit[units], place, draw[np.repeat(todo_a, n)], at[units])
        upto = np.concatenate([[0], np.cumsum(count)])
        new = []
        for i, (head, head_upto, g, fresh, out), a, b in zip(todo, heads, offset.tolist(), [*offset[1:].tolist(), len(units)]):
            own, own_upto = arcs[upto[a] : upto[b]], upto[a + 1 : b + 1] - upto[a]
            if head is not None:
                own, own_upto = np.concatenate([head, own]), np.concatenate([head_upto, own_upto + len(head)])
            new.append(_Path(own, own_upto, g, fresh, out))
            done[i].append(new[-1])
        for i, found in zip(todo, _branches(lat, new, draw[todo_a].tolist(), k - s + 1)):
            for value, step in found:
                heapq.heappush(queues[i], (-value, len(done[i]) - 1, step))
    # all paths at once: pieces, log probabilities, and whether characters go by bytes
    paths = [p.arcs for own in done for p in own]
    cut = np.concatenate([[0], np.cumsum(np.array(list(map(len, paths)), np.int64))])
    arcs = np.concatenate(paths) if paths else np.zeros(0, np.int64)
    pieces, log_p = lat.piece[arcs], np.add.reduceat(lat.log_share[arcs], cut[:-1]).tolist() if paths else []
    has_bare = np.logical_or.reduceat(pieces < 0, cut[:-1]).tolist() if paths else []
    cut, at, out = cut.tolist(), 0, []
    for i in range(len(texts)):
        if starts[i] == ends[i]:
            out.append([(np.zeros(0, np.int32), 0.0, 1.0)])
            continue
        kappa = -queues[i][0][0] if queues[i] else -np.inf
        own = []
        for at in range(at, at + len(done[i])):
            ids = pieces[cut[at] : cut[at + 1]]
            if has_bare[at]:  # each such character becomes its bytes' pieces
                bare = np.flatnonzero(ids < 0)
                raw = [v.bytes_of(-1 - int(x)) for x in ids[bare]]
                size = np.ones(len(ids), np.int64)
                size[bare] = [len(x) for x in raw]
                first = np.cumsum(size) - size
                ids = np.repeat(ids, size)
                for x, f in zip(raw, first[bare]):
                    ids[f : f + len(x)] = x
            own.append((ids, log_p[at], -math.expm1(-math.exp(min(log_p[at] - kappa, 700))) if kappa > -np.inf else 1.0))
        at += 1
        out.append(own)
    lat.trim()
    return out


SCHEMA = "doc_id long, sample int, ids array<int>, n_pieces long, ids_crc32 long, log_prob double, inclusion double, decoded boolean"


def sample_segmentations(documents: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """Per row up to k rows of distinct segmentations of its whole text: doc_id, sample (from 1),
    ids, n_pieces, ids_crc32 (little-endian unsigned 32-bit), log_prob, inclusion (the probability
    that a threshold at the k+1st perturbed value would take it), decoded (its ids give the text back).

    A text with fewer segmentations gives all of them, with inclusion 1. A null or empty text has
    one, without pieces. Draws are seeded by ``seed`` and doc_id: rows that repeat both id and text
    get the same; null ids share a key. Other columns are ignored; an empty table gives no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
    keep = [i for i, n in enumerate(names) if with_ids or n != "ids"]
    schema = pa.schema([(names[i], kinds[i]) for i in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model, alpha)
        for s in slices(batches, keeping=True):
            ids, texts = s.column("doc_id").to_pylist(), s.column("text").to_pylist()
            keys = [(seed * 0x632BE59BD9B4E019 + (0x2545F4914F6CDD1D if i is None else i)) & _MASK for i in ids]
            rows: list[list] = [[] for _ in names]
            found, raws, all_ids = segment(s.column("text").cast(pa.large_string()), keys, v, k), [], []
            for i, text, own in zip(ids, texts, found):
                raw = text.encode() if text else b""
                for n, (pieces, log_p, inclusion) in enumerate(own, 1):
                    for col, x in zip(rows, (i, n, None, len(pieces), zlib.crc32(pieces.astype("<i4", copy=False)), log_p, inclusion, True)):
                        col.append(x)
                    raws.append(raw)
                    all_ids.append(pieces)
            # all ids at once; one by one only if something differs
            flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
            whole = v.decode_marked(flat)
            if whole != b"".join([b" " + r if r else b"" for r in raws]):
                rows[-1] = [v.decode(x) == r for x, r in zip(all_ids, raws)]
            cols = {n: pa.array(rows[j], kinds[j]) for j, n in enumerate(names) if n != "ids"}
            if with_ids:
                at = np.concatenate([[0], np.cumsum(np.array(rows[3], np.int64))])
                cols["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(SCHEMA.split(", ")[i] for i in keep))


def decode(samples: DataFrame, model: str) -> DataFrame:
    """``samples`` (ids, and other columns) with the text that the ids stand for as ``text``.

    Null ids give a null text, no ids an empty one; bytes that are no UTF-8 are replaced; a column
    ``text`` that is there already is replaced, all others and repeated rows stay; an empty table
    stays empty.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text_of(ids):
        v = _vocabulary(model, 1.0)
        return ids.map(lambda x: None if x is None else v.decode(np.asarray(x, np.int64)).decode("utf-8", "replace"))

    return samples.withColumn("text", text_of("ids"))
