"""Exact Jaccard join of documents' word n-gram sets in metric space.

Jaccard distance is a metric, so pivots can cut the space:

1. Equal sets become one node. First pivots are the single shingles: a set lies at distance
   1 - 1/n from the shingles it holds and at 1 from all others, so its nearest pivots are its own
   shingles, taken rarest first. Its window is the shortest prefix of them that any set within
   the radius must meet; the document is replicated to the regions of that prefix only. Regions
   of one member are done, and regions with equal members count as one.
2. Small regions are joined at once: pairs that share too few prefix shingles to reach the
   threshold, or whose sizes differ too much, are dropped; the others are verified.
3. Larger regions choose documents as pivots. Each member goes to its nearest pivot's cell, and
   also to every other cell whose pivot is within two radii of that (no pair within the radius
   is then apart). Members far from every pivot form an outer cell of their own. Members within
   the radius of a pivot are linked to it; what is linked need not be compared again, so a large
   group of near copies takes a few comparisons a document. Cells recurse until small or linked
   throughout, or until pivots no longer part them. Such leaves compare, in blocks, the documents
   that are still apart with the rest, within the window of their distances from a common pivot.

Hot groups never meet in one task: regions, cells and links are rows of tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.bitmap import bitmap, may_hold, maybe
from helixframe.llm.components import components
from helixframe.llm.hot import join_hot
from helixframe.llm.shingles import class_table, digest, distinct, keys_of, shingle_hashes
from helixframe.llm.wordbytes import U64, slices
from helixframe.runtime import discard, settle

#: Regions up to this many members are joined at once.
SMALL = 16
#: Document pivots of a larger cell in each round, documents of a block of a leaf, and members of a
#: cell that meet a copy of its pivots' sets.
PIVOTS, BLOCK, SHARE = 4, 256, 4096
#: Rounds of pivots; what is left then is compared as leaves.
DEPTH = 12
_NULL_ID = (1 << 63) - 1


def _sigs(batches: Iterator[pa.RecordBatch], sent, k: int, per_cent: int) -> Iterator[pa.RecordBatch]:
    table = np.frombuffer(sent.value, np.uint8)
    for s in slices(batches):
        h, ptr = shingle_hashes(s.column("text"), k)
        keys = keys_of(h, table)
        names, sizes, prefixes = [], [], []
        for i in range(len(s)):
            q = distinct(keys[ptr[i] : ptr[i + 1]])
            n = len(q)
            names.append(digest(q) if n else 0)
            sizes.append(n)
            prefixes.append(q[: n - (per_cent * n + 99) // 100 + 1] if n else q)
        at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "node", "n", "sigs"])


def _sets(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """The sets of documents whose hash a bit map may hold, with their nodes."""
    for s in slices(b.filter(pa.array(may_hold(sent.value, b.column("hash").to_numpy()))) for b in batches):
        h, ptr = shingle_hashes(s.column("text"), k)
        h >>= U64(8)  # as keys_of with one class for all
        sets = [distinct(h[ptr[i] : ptr[i + 1]]) for i in range(len(s))]
        at = np.concatenate([[0], np.cumsum([len(q) for q in sets])]).astype(np.int32)
        names = pa.array([digest(q) if len(q) else 0 for q in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([names, s.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "doc_id", "keys"])


def _near(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Nodes with those of their shingles that a bit map (of keys without their class) may hold."""
    for b in batches:
        lists = b.column("sigs")
        flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        keep = may_hold(sent.value, (flat.view(U64) << U64(8)).view(np.int64))
        at = np.concatenate([[0], np.cumsum(keep)])[at].astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat[keep]))], ["node", "n", "sigs"])


def _compare(left: pd.DataFrame, right: pd.DataFrame, t: int, window: float) -> pd.DataFrame:
    """Links of a block of documents to a block of others, one to each component at most."""
    out: set[tuple[int, int]] = set()
    if len(left) and len(right):
        size = np.array([len(k) for k in right["keys"]])
        keys, owner = np.concatenate(right["keys"].to_list()), np.repeat(np.arange(len(right)), size)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        roots, names, places = right["root"].to_numpy(), right["node"].to_numpy(), right["at"].to_numpy()
        for node, root, at, own in zip(left["node"], left["root"], left["at"], left["keys"]):
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = hi - lo
            first = np.cumsum(n) - n
            hit = owner[np.repeat(lo - first, n) + np.arange(int(n.sum()))]
            both = np.bincount(hit, minlength=len(right))
            ok = (100 * both >= t * (size + len(own) - both)) & (roots != root) & (np.abs(places - at) <= window)
            found = np.flatnonzero(ok)
            _, one = np.unique(roots[found], return_index=True)
            out.update((min(node, x), max(node, x)) for x in names[found[one]].tolist())
    return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")


class _Join:
    def __init__(self, documents: DataFrame, k: int, per_cent: int):
        self.k, self.t = k, per_cent
        self.spark = documents.sparkSession
        self.docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def need(self, na: Column, nb: Column) -> Column:
        """The least intersection that reaches the threshold."""
        return F.floor((self.t * (na + nb) + (99 + self.t)) / (100 + self.t))

    def near(self, na: Column, nb: Column) -> Column:
        """Sizes that a linked pair can have."""
        return 100 * F.least(na, nb) >= self.t * F.greatest(na, nb)

    def regions(self) -> None:
        sent = self.spark.sparkContext.broadcast(class_table(self.docs, self.k).tobytes())
        k, t = self.k, self.t
        rows = self.docs.mapInArrow(lambda it: _sigs(it, sent, k, t), "doc_id long, node long, n long, sigs array<long>")
        self.rows = settle(rows, "jaccard-documents")
        self.nodes = settle(self.rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sigs").alias("sigs")), "jaccard-nodes")
        sigs = self.nodes.select("node", "n", F.explode("sigs").alias("sig"))
        found = sigs.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).filter("c > 1")
        self.alike = alike = settle(found.groupBy("c", "x", "y").agg(F.min("sig").alias("sig"), F.count("*").alias("times")).select("sig", "c", "times"), "jaccard-regions")
        # only shingles that some region has go into the shuffle
        held = self.spark.sparkContext.broadcast(bitmap(alike, F.shiftleft("sig", 8)))
        near = self.nodes.select("node", "n", "sigs").mapInArrow(lambda it: _near(it, held), "node long, n long, sigs array<long>").select("node", "n", F.explode("sigs").alias("sig"))
        total = alike.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        self.members = settle(join_hot(near, alike, "sig", "c", total, "node"), "jaccard-members")

    def small_pairs(self) -> DataFrame:
        m = self.members.filter(F.col("c") <= SMALL)
        a, b = m.select("sig", "times", F.col("node").alias("a"), F.col("n").alias("na")), m.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"))
        pairs = a.join(b, "sig").filter("a < b").filter(self.near(F.col("na"), F.col("nb"))).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("times").alias("shared"))
        # what a pair may share besides: in large regions, and after the prefix
        hot = self.members.filter(F.col("c") > SMALL).groupBy("node").agg(F.sum("times").alias("h"))
        for x in ("a", "b"):
            pairs = pairs.join(hot.select(F.col("node").alias(x), F.col("h").alias(f"h{x}")), x, "left")
        rest = lambda n: F.floor((self.t * F.col(n) + 99) / 100) - 1
        more = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
        return pairs.filter(F.col("shared") + more + F.greatest(rest("na"), rest("nb")) >= self.need(F.col("na"), F.col("nb"))).select("a", "b")

    def load_sets(self, pairs: DataFrame) -> None:
        """The sets of all documents that may yet be compared."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(self.members.filter(F.col("c") > SMALL).select("node")).distinct()
        names = settle(self.nodes.join(wanted, "node").select("node", F.col("doc").alias("doc_id")), "jaccard-wanted")
        held, k = self.spark.sparkContext.broadcast(bitmap(names, F.xxhash64("doc_id"))), self.k
        found = self.docs.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(lambda it: _sets(it, held, k), "node long, doc_id long, keys array<long>")
        # rows that repeat an id and text have one set; joined and grouped by one shuffle at any size
        own = ["doc_id", "node"]
        self.sets = settle(found.join(names.hint("merge"), own).dropDuplicates(own).select("node", "keys"), "jaccard-sets")
        discard(names)

    def shared(self, a: str | Column, b: str | Column) -> Column:
        """Jaccard distance of two sets of keys, and whether they are linked: exactly."""
        both = F.size(F.array_intersect(a, b))
        every = F.size(a) + F.size(b) - both
        return F.struct((1 - both / every).alias("d"), (100 * both >= self.t * every).alias("linked"))

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are linked."""
        side = lambda x: self.sets.select(F.col("node").alias(x), F.col("keys").alias(f"k{x}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").filter(self.shared("ka", "kb")["linked"]).select("a", "b")

    def links(self) -> DataFrame:
        """Links (a, b) that join every two nodes which any chain of links joins.

        Each round compares what it can with pivots and hands the rest on; after DEPTH rounds what
        is left is compared as leaves, so the search ends and stays exact.
        """
        small = settle(self.small_pairs(), "jaccard-pairs")
        self.load_sets(small)
        links = settle(self.measured(small), "jaccard-links")
        radius = 1 - self.t / 100
        hot = self.members.filter(F.col("c") > SMALL)
        weight = settle(hot.groupBy("node").agg(F.sum("times").alias("h")), "jaccard-weights")  # those in most regions lie in the middle of their copies
        # regions whose middle is the same document are one cell
        middle = settle(hot.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("h", "node")).alias("p"), F.first("c").alias("c")), "jaccard-middles")
        cells = join_hot(hot.select("sig", "node"), middle, "sig", "c", hot.count(), "node")
        cells = settle(cells.select(F.xxhash64("p", F.lit(0)).alias("cell"), "node", F.lit(None).cast("double").alias("at")).distinct(), "jaccard-cells")
        discard(small, middle)
        for depth in range(DEPTH + 1):
            roots = components(links)
            mine = settle(cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(weight, "node"), "jaccard-cells")
            discard(roots, cells)
            split = settle(self.split(mine), "jaccard-splits")
            cells = settle(join_hot(mine.drop("h"), split, "cell", "c", mine.count(), "node"), "jaccard-cells")
            discard(mine)
            if cells.isEmpty():
                discard(split, cells)
                break
            leaf = (F.col("c") <= BLOCK) | F.col("at").isNotNull() | F.lit(depth == DEPTH)
            arms = settle(self.arms(cells.filter(~leaf), split), "jaccard-arms")
            found = self.leaf_links(cells.filter(leaf), radius)
            close = arms.select(F.col("node").alias("a"), F.explode("arms").alias("x")).filter("x.linked and a <> x.p").select("a", F.col("x.p").alias("b"))
            before, links = links, settle(links.union(found).union(close), "jaccard-links")
            discard(before, split, cells)
            if arms.isEmpty():
                discard(arms)
                break
            cells = self.next_cells(arms, radius)
            discard(arms)
        discard(weight, self.sets, self.members, self.alike)
        return links

    def split(self, mine: DataFrame) -> DataFrame:
        """Cells with members of several components: their size, largest component and pivots.
        Counts go by (cell, component) first, so that no cell is gathered."""
        least = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("x"), "node")).alias(f"m{i}") for i in range(1, PIVOTS)]
        parts = mine.groupBy("cell", "root").agg(F.count("*").alias("c"), F.max(F.struct("h", "node")).alias("m0"), *least)
        picks = [F.max("m0")["node"].alias("p0"), *[F.min(f"m{i}")["node"].alias(f"p{i}") for i in range(1, PIVOTS)]]
        whole = parts.groupBy("cell").agg(F.sum("c").alias("c"), F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("most"), *picks)
        return whole.filter("roots > 1").drop("roots")

    def arms(self, wide: DataFrame, split: DataFrame) -> DataFrame:
        """Members of wide cells with their distances from its pivots: cell, node, c, p0, arms.
        The sets of a cell's pivots are one row for each share of its members."""
        picks = split.select("cell", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"), "c").join(wide.select("cell").distinct(), "cell")
        pivots = picks.join(self.sets.select(F.col("node").alias("p"), F.col("keys").alias("k")), "p").groupBy("cell").agg(F.collect_list(F.struct("p", "k")).alias("ps"), F.first("c").alias("n"))  # PIVOTS entries at most
        pivots = pivots.select("cell", "ps", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SHARE))).alias("share"))
        own = wide.select("cell", "node", "c", "p0", F.pmod(F.xxhash64("node"), 1 + F.floor(F.col("c") / SHARE)).alias("share")).join(self.sets, "node")
        to = F.transform("ps", lambda x: F.struct(x["p"].alias("p"), F.when(x["p"] != F.col("node"), self.shared(F.col("keys"), x["k"])).alias("m")))
        flat = F.transform(to, lambda x: F.struct(x["p"].alias("p"), F.coalesce(x["m"]["d"], F.lit(0.0)).alias("d"), F.coalesce(x["m"]["linked"], F.lit(True)).alias("linked")))
        return own.join(pivots, ["cell", "share"]).select("cell", "node", "c", "p0", flat.alias("arms"))

    def leaf_links(self, leaf: DataFrame, radius: float) -> DataFrame:
        """Links between separate components within a leaf, in blocks: those outside the leaf's largest
        component against all. A link from each to each other component is enough."""
        rows = leaf.join(self.sets, "node").select("cell", "node", "root", "most", F.coalesce("at", F.lit(0.0)).alias("at"), "keys", (1 + F.floor(F.col("c") / BLOCK)).cast("int").alias("nb"))
        block = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("nb")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
        side = lambda df, x, y: df.select(*[F.col(c).alias(c) for c in ("cell", "node", "root", "at", "keys")], x.alias("x"), y.alias("y"))
        left, right = side(rows.filter("root <> most"), block(1), every), side(rows, every, block(2))
        t = self.t
        key = ["cell", "x", "y"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _compare(a, b, t, radius + 1e-9), "a long, b long")

    def next_cells(self, arms: DataFrame, radius: float) -> DataFrame:
        """The members of wide cells by their pivots. A pivot itself is done. Cells of one pivot are
        one cell, wherever its members come from. A cell that its pivots don't part well (its cells
        would hold over twice its members, or one of them over half) becomes a leaf, together
        with those of the same first pivot; ``at`` is then the distance from it."""
        far, eps = 3 * radius, 1e-9  # farther than this from every pivot: the outer cell
        least = F.array_min(F.transform("arms", lambda x: x["d"]))
        first = F.filter("arms", lambda x: x["p"] == F.col("p0"))[0]["d"]
        keep = F.transform(F.filter("arms", lambda x: x["d"] <= F.least(F.col("least") + 2 * radius, F.lit(far + radius)) + eps), lambda x: x["p"])
        keep = F.when(F.col("least") <= far, keep).otherwise(F.concat(keep, F.array(F.lit(None).cast("long"))))
        per = arms.withColumns({"least": least, "d0": first}).filter("least > 0").withColumn("to", keep).drop("arms")
        sizes = per.select("cell", "c", F.explode("to").alias("p")).groupBy("cell", "c", "p").count()
        stuck = settle(sizes.groupBy("cell", "c").agg(((F.sum("count") > 2 * F.col("c")) | (2 * F.max("count") > F.col("c"))).alias("stuck")), "jaccard-stuck")
        per = join_hot(per.drop("c"), stuck, "cell", "c", arms.count(), "node")
        whole = per.filter("stuck").select(F.xxhash64("p0", F.lit(1)).alias("cell"), "node", F.col("d0").alias("at"))
        parted = per.filter("not stuck").select("cell", "node", F.explode("to").alias("p"))
        own = F.when(F.col("p").isNull(), F.xxhash64("cell", F.lit(2))).otherwise(F.xxhash64("p", F.lit(3)))
        out = settle(whole.union(parted.select(own.alias("cell"), "node", F.lit(None).cast("double").alias("at"))).distinct(), "jaccard-cells")
        discard(stuck)
        return out

    def run(self) -> DataFrame:
        self.regions()
        links = self.links()
        roots = components(links)
        plain = self.nodes.select("node", "doc", "copies")
        named = roots.join(plain, "node")
        names = named.groupBy("root").agg(F.min("doc").alias("least"))
        labels = settle(plain.join(named.join(names, "root").select("node", "least"), "node", "left").select("node", "copies", F.coalesce("least", "doc").alias("component_id")), "jaccard-labels")
        rows = self.rows.select("doc_id", "node", F.col("n").alias("n_shingles"))
        real = lambda c: F.when(c != _NULL_ID, c)
        out = join_hot(rows.filter("n_shingles > 0"), labels, "node", "copies", rows.count(), "doc_id").select("doc_id", "n_shingles", "component_id")
        out = out.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
        found = settle(out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.col("component_id")).alias("component_id")), "jaccard-components")
        discard(links, roots, labels, self.nodes, self.rows)
        return found


def jaccard_components(documents: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents are linked when the Jaccard similarity of their sets of ``k``-word shingles is
    ``per_cent`` or more, exactly. Words are compared lower-cased (A-Z). A text of fewer words is
    one shingle; a null or blank text has none and is linked with nothing. Null ids rank last and
    a component of them alone is null; repeated rows are linked as copies are; other columns are
    ignored; an empty table gives no rows.
    """
    return _Join(documents, k, per_cent).run()


def keep_one(documents: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """``documents``, all columns, with one document of each component: that of smallest doc_id.

    Rows that share this doc_id all stay; null ids are never dropped; null and blank texts are linked
    with nothing and stay; columns of any name are kept as they are; an empty table stays empty.
    Only rows that a fixed bit map of dropped ids may hold go into a shuffle.
    """
    found = jaccard_components(documents, k, per_cent)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    own = documents["doc_id"].cast("long")
    may = maybe(documents.sparkSession, bitmap(gone, F.xxhash64("gone")), F.xxhash64(own))
    return documents.filter(~may).unionByName(documents.filter(may).join(gone.hint("merge"), own == gone["gone"], "left_anti"))
