"""Exact top-k inner products by dual-tree search over cover trees.

The first level of the trees is common to all tasks: queries and data go to the nearest of a few
centres, and each cell of data has a measured covering radius. In the first round a block of
queries visits the cells whose centres score best, which gives every query a k-th score; in the
second it visits those of the other cells that can still hold something for one of its queries, as
no product in a cell with centre c and radius b passes  q.c + |q| b.  What can't is pruned whole.
A task takes a few blocks of queries and a share of a cell, builds a cover tree over each and
walks pairs of nodes, best bound first. With centres q, r and covering radii a, b no product
below a pair can pass  q.r + |q| b + |r| a + a b;  a pair whose bound is under the worst k-th score
of its query group is pruned. Components are integers, so that scores are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import discard, settle

#: Vectors in a block of queries and of data, and blocks of each in a task.
QUERY_BLOCK, DATA_BLOCK, TOGETHER = 512, 1024, 4
#: Points of a leaf, and children of a node at most.
LEAF, CHILDREN = 128, 24
#: Centres of the common level at most, cells that a block of queries visits first, and vectors that a task holds.
CENTRES, FIRST, HELD = 256, 2, 65_536


class CoverTree:
    """Nodes over points: centre (a point), covering radius, children or the points of a leaf.

    Children are taken farthest first, until they cover the node within half its radius or are
    CHILDREN: so they lie at least as far apart as any point lies from its child's centre. Every
    radius is measured.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.own: list[np.ndarray] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _away(self, at: np.ndarray, centre: int) -> np.ndarray:
        d = self.points[at] - self.points[centre]
        return np.sqrt((d * d).sum(1))

    def _build(self, at: np.ndarray, centre: int) -> int:
        away = self._away(at, centre)
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.children.append([])
        self.own.append(at)
        if len(at) <= LEAF or not away.max():
            return node
        near, best = np.zeros(len(at), np.int64), away
        centres = [centre]
        while best.max() > self.radius[node] / 2 and len(centres) < CHILDREN:
            far = int(at[best.argmax()])
            d = self._away(at, far)
            closer = d < best
            near[closer], best = len(centres), np.where(closer, d, best)
            centres.append(far)
        for k, c in enumerate(centres):
            if (near == k).any() and (near != k).any():
                self.children[node].append(self._build(at[near == k], c))
        return node


def _under(score: int) -> float:
    """A score as a number that isn't greater."""
    if abs(score) < 1 << 53:
        return float(score)
    if score <= -(1 << 63):  # as far as scores are told apart
        return -np.inf
    return float(np.nextafter(float(min(score, (1 << 63) - 1)), -np.inf))


def _products(q: np.ndarray, d: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; by whole numbers of any size where floating point would round."""
    if not exact:
        return q @ d.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(d).T if q.shape[1] else np.zeros((len(q), len(d)), object)


def search(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, least: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, id) in d, but for rows of its own id. ``least``: a score
    for each query under which nothing is wanted."""
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]  # as (-score, id), in order
    if not len(q) or not len(d):
        return best
    worst = np.full(len(q), -np.inf) if least is None else least.copy()  # each query's k-th score
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1] >= 2.0**53
    a, b = CoverTree(q), CoverTree(d)
    norm = lambda t: np.sqrt((t.points[t.centre] ** 2).sum(1))
    an, bn, ar, br = norm(a), norm(b), np.array(a.radius), np.array(b.radius)

    def bound(x: int, y: int) -> float:
        top = float(q[a.centre[x]] @ d[b.centre[y]])
        more = an[x] * br[y] + bn[y] * ar[x] + ar[x] * br[y]
        out = top + more + 1e-6 * (an[x] * bn[y] + more + 1)
        return np.inf if np.isnan(out) else out

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        top, x, y = heapq.heappop(heap)
        if -top < worst[a.own[x]].min():
            continue
        if not a.children[x] and not b.children[y]:
            mine, theirs = a.own[x], b.own[y]
            scores = _products(q[mine], d[theirs], exact)
            hit = (scores >= worst[mine][:, None]).astype(bool) & (q_ids[mine][:, None] != d_ids[theirs][None, :])
            for r in np.flatnonzero(hit.any(1)):
                i = mine[r]
                s, n = scores[r][hit[r]], d_ids[theirs[hit[r]]]
                if len(s) > k and not exact:
                    top_k = np.lexsort((n, -s))[:k]
                    s, n = s[top_k], n[top_k]
                best[i] = sorted([*best[i], *((-int(x), int(y)) for x, y in zip(s, n))])[:k]
                if len(best[i]) == k:
                    worst[i] = max(worst[i], _under(-best[i][-1][0]))
            continue
        down = bool(a.children[x]) and (not b.children[y] or ar[x] >= br[y])
        for x2, y2 in [(c, y) for c in a.children[x]] if down else [(x, c) for c in b.children[y]]:
            if (to := bound(x2, y2)) >= worst[a.own[x2]].min():
                heapq.heappush(heap, (-to, x2, y2))
    return [[(-s, n) for s, n in own] for own in best]


def first_cells(q: np.ndarray, centres: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The cells that a block of queries visits first: those whose centres score best, FIRST of them
    or as many as hold more than k vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        order = np.argsort(-(q.mean(0) @ centres.T), kind="stable")
    order = order[counts[order] > 0]
    enough = int(np.searchsorted(np.cumsum(counts[order]), k + 1)) + 1
    return order[: max(FIRST, enough)]


def other_cells(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, counts: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """The cells besides the first that can hold a product of ``least`` or more for one of the queries."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((q * q).sum(1))[:, None]
        more = norm * radius + 1e-6 * (norm * (radius + np.sqrt((centres * centres).sum(1))) + 1)
        can = ~(q @ centres.T + more < least[:, None]).all(0)  # what isn't a number can
    can[counts == 0] = False
    can[first_cells(q, centres, counts, k)] = False
    return np.flatnonzero(can)


def _usable(b: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and whole-number vectors of the rows that take part."""
    lists = b.column("embedding")
    ok = np.asarray(lists.is_valid()) & np.asarray(b.column("vec_id").is_valid())
    at = np.flatnonzero(ok)
    size = np.asarray(pa.compute.list_value_length(lists).fill_null(-1))
    for dim in np.unique(size[at]):
        own = at[size[at] == dim]
        flat = lists.take(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), dim)
        good = np.isfinite(flat).all(1)  # a null component reads as NaN
        with np.errstate(over="ignore"):
            ints = np.floor(flat[good] * scale)
        fit = np.isfinite(ints).all(1)
        ids = b.column("vec_id").take(pa.array(own[good][fit])).to_numpy(zero_copy_only=False)
        yield int(dim), ids, ints[fit]


def _cells(ints: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((centres * centres).sum(1) - 2 * (ints @ centres.T), nan=np.inf, posinf=np.inf).argmin(1)


_LEAST = "array<struct<pos: long, score: long>>"
_BLOCK = "dim int, cell int, n long, radius double, ids binary, ints binary"


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, most: int, centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``most`` vectors of one dimension and cell, with their covering radius."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def packed() -> Iterator[pa.RecordBatch]:
        for (dim, cell), parts in held.items():
            ids, ints = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for i in range(0, len(ids), most):
                own = ints[i : i + most]
                away = own - _centres_of(centres, dim)[cell]
                with np.errstate(over="ignore"):
                    radius = float(np.sqrt((away * away).sum(1)).max())
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "n": [len(own)], "radius": [radius], "ids": [ids[i : i + most].astype("<i8").tobytes()], "ints": [own.astype("<f8").tobytes()]})
        held.clear()

    n = 0
    for b in batches:
        for dim, ids, ints in _usable(b, scale):
            cell = _cells(ints, _centres_of(centres, dim))
            for c in np.unique(cell):
                held.setdefault((dim, int(c)), []).append((ids[cell == c], ints[cell == c]))
            n += len(ids)
        if n >= HELD:
            yield from packed()
            n = 0
    yield from packed()


def _centres_of(centres: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return centres.get(dim, np.zeros((1, dim)))


def _vectors(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(n, dim)


class Level:
    """The common level: centres by dimension, and of each cell of data its vectors, radius and shares."""

    def __init__(self, centres: dict[int, np.ndarray], stats: list, per: int):
        """per: vectors of a share."""
        self.centres, self.per = centres, per
        self.radius = {d: np.zeros(len(c)) for d, c in centres.items()}
        self.counts = {d: np.zeros(len(c), np.int64) for d, c in centres.items()}
        for r in stats:
            if r["dim"] not in centres:
                self.centres[r["dim"]], self.radius[r["dim"]], self.counts[r["dim"]] = np.zeros((1, r["dim"])), np.zeros(1), np.zeros(1, np.int64)
            self.radius[r["dim"]][r["cell"]], self.counts[r["dim"]][r["cell"]] = r["radius"], r["n"]

    def shares(self, dim: int, cell: int) -> int:
        return 1 + int(self.counts[dim][cell]) // self.per

    def visits(self, batches: Iterator[pa.RecordBatch], k: int, again: bool) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with the shares of cells that they visit first, or with their k-th scores again."""
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                dim, n, raw = (row.column(c)[0].as_py() for c in ("dim", "n", "ints"))
                if dim not in self.counts:
                    continue
                q, args = _vectors(raw, dim, n), (self.centres[dim], self.counts[dim])
                least = np.full(n, -np.inf)
                for x in row.column("least")[0].as_py() or []:
                    least[x["pos"]] = _under(x["score"])
                cells = other_cells(q, args[0], self.radius[dim], args[1], least, k) if again else first_cells(q, *args, k)
                row = row.set_column(row.schema.get_field_index("least"), "least", pa.array([least.tobytes()], pa.binary()))
                to = [(int(c), s) for c in cells for s in range(self.shares(dim, int(c)))]
                out = row.take(pa.array([0] * len(to), pa.int32()))
                yield out.append_column("to", pa.array([c for c, _ in to], pa.int32())).append_column("share", pa.array([s for _, s in to], pa.int32()))


def _match(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    out: dict[str, list] = {"block": [], "pos": [], "query_id": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        dim = int(left["dim"].iloc[0])
        get = lambda f: (np.concatenate([np.frombuffer(x, "<i8") for x in f["ids"]]), np.concatenate([_vectors(x, dim, n) for x, n in zip(f["ints"], f["n"])]))
        (q_ids, q), (d_ids, d) = get(left), get(right)
        where = [(b, p) for b, n in zip(left["block"], left["n"]) for p in range(n)]
        least = np.concatenate([np.frombuffer(x) for x in left["least"]])
        for (b, p), i, own in zip(where, q_ids.tolist(), search(q_ids, q, d_ids, d, k, least)):
            for score, n in own:
                for name, v in zip(out, (b, p, i, n, min(max(score, -(1 << 63)), (1 << 63) - 1))):
                    out[name].append(v)
    return pd.DataFrame(out).astype({c: "int64" for c in out})


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """Per query its k highest inner products in ``data``: query_id, rank, vec_id, score.

    Both tables hold vec_id and embedding; each component x becomes floor(scale * x). Ties go to
    the smaller vec_id; rows with the query's own vec_id are no candidates. Rows with a null id, a
    null vector, or a null or non-finite component take no part; vectors of another dimension than
    the query's are no candidates; repeated query rows are answered each, repeated data rows count
    each; scores beyond a long are held at its ends; other columns are ignored; empty tables give
    no rows.
    """
    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def blocks(df: DataFrame, most: int, centres: dict[int, np.ndarray], name: str) -> DataFrame:
        return settle(rows(df).mapInArrow(lambda it: _blocks(it, scale, most, centres), _BLOCK).withColumn("block", F.monotonically_increasing_id()), name)

    sample = rows(data).filter("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRES).toArrow()
    drawn: dict[int, list[np.ndarray]] = {}
    for b in sample.to_batches():
        for dim, _, ints in _usable(b, scale):
            drawn.setdefault(dim, []).append(ints)
    # a cell for each share of vectors, up to CENTRES
    found = {dim: np.concatenate(x) for dim, x in drawn.items()}
    number = lambda df, of: max(1, df.count() // (of * TOGETHER))
    some = lambda n: {dim: np.unique(x[:n], axis=0) for dim, x in found.items() if len(x)}
    d = blocks(data, DATA_BLOCK, some(number(data, DATA_BLOCK)), "top-k-data")
    q = blocks(queries, QUERY_BLOCK, some(number(queries, QUERY_BLOCK)), "top-k-queries")
    level = Level(some(number(data, DATA_BLOCK)), d.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect(), DATA_BLOCK * TOGETHER)  # a row for each centre
    share = lambda df, of: df.join(F.broadcast(df.groupBy("dim", "cell").agg((1 + F.floor(F.sum("n") / (of * TOGETHER))).alias("_shares"))), ["dim", "cell"]).withColumn("_shares", F.pmod(F.xxhash64("block"), "_shares").cast("int"))
    left = share(q, QUERY_BLOCK).select("block", "dim", F.col("cell").alias("own"), F.col("_shares").alias("chunk"), "n", "ids", "ints")
    right = share(d, DATA_BLOCK).select("dim", F.col("cell").alias("to"), F.col("_shares").alias("share"), "n", "ids", "ints")
    best = Window.partitionBy("block", "pos").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def meet(least: DataFrame | None) -> DataFrame:
        """The best of the cells that queries visit, each chunk of queries with each share of a cell in a task."""
        again = least is not None
        mine = left.join(least, "block", "left") if again else left.withColumn("least", F.lit(None).cast(_LEAST))
        mine = mine.select("block", "dim", "own", "chunk", "n", "ids", "ints", "least").mapInArrow(lambda it: level.visits(it, k, again), "block long, dim int, own int, chunk int, n long, ids binary, ints binary, least binary, to int, share int")
        mine = settle(mine, "top-k-visits")
        key = ["dim", "to", "share", "own", "chunk"]
        theirs = right.join(mine.select(*[F.col(c).alias(c) for c in key]).distinct(), ["dim", "to", "share"])
        found = settle(ranked(mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(lambda a, b: _match(a, b, k), "block long, pos long, query_id long, vec_id long, score long")), "top-k-found")
        discard(mine)
        return found

    first = meet(None)
    least = first.filter(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("pos", "score")).alias("least"))  # QUERY_BLOCK entries at most
    rest = meet(least)
    out = settle(ranked(first.union(rest).drop("rank")).select("query_id", "rank", "vec_id", "score"), "top-k")
    discard(d, q, first, rest)
    return out
