"""Hard negatives for contrastive training, found in a multiway tree of hyperplanes with stored distance ranges (GNAT).

A node has several split points, far from each other; a row goes to the nearest, so siblings are parted by hyperplanes.
For every split point and every sibling subtree the node stores the smallest and the largest distance between the point
and the subtree's rows. A window of scores is an annulus of distances around the anchor, given the lengths of a
subtree's rows. A subtree is eliminated where that annulus around the anchor cannot meet the range around one of the
split points (triangle inequality); the leaves that remain are searched exactly.

Split points come from a documented sample (``SAMPLE``); all rows are routed to leaves and all enter the
ranges, so the search is exact whatever the sample. The tree's size depends on the sample alone. Leaves with many rows are cut
into buckets; anchors and buckets meet in blocks of bounded size (``vectors.meet``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ids_of
from barloom.llm.vectors import NO_ID, blocks_of, integers, matrix, meet, numbered, products, whole
from barloom.sources.stage import stage

#: Rows, about, from which split points are taken; a tree has no more nodes.
SAMPLE = 16384
#: Split points of a node.
WAYS = 8
#: Rows of a leaf from which on it is split, and of a bucket.
LEAF = 2048
BLOCK = 1024
PIECE = 256
MOST = 1 << 62


def hard_negatives(
    df: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id: str = "vec_id", label: str = "label", vector: str = "embedding", leaf: int = LEAF, sample: int = SAMPLE, ways: int = WAYS, block: int = BLOCK,
) -> DataFrame:
    """For every anchor and each of its best rows of the same label, the best rows of other labels within a window.

    A score is the inner product of components floor(scale * x). An anchor's positives are its ``positives`` best other
    rows of its label; a positive's negatives are the best of the rows of other labels with
    low * positive score <= 100 * score <= high * positive score. Higher scores first, ties by smaller id, a null id last.

    Rows with a null label, a null vector or a null or non-finite component take no part. A row with the anchor's id is
    the anchor itself; repeated anchors are one, other repeated rows are rows of their own. Vectors of different lengths
    are multiplied over the components that both have. Anchors without positives, and positives without negatives, give
    no rows, as do no rows. Other columns are not looked at. Components beyond 2^27 are an error.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    kept = df.filter(whole(vector) & F.col(label).isNotNull())
    asks = F.coalesce(anchors, F.lit(False)).alias("asks")
    kept = kept.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), integers(vector, scale).alias("v"), asks)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    rows = numbered(kept.withColumn("square", square), "vectors")
    tree = Tree.of(rows, rows.count(), leaf, sample, ways)
    routed = stage(rows.mapInArrow(_routing(tree), ROUTED), "routed")
    table = tree.measure(routed, leaf)
    buckets = routed.join(F.broadcast(table), "leaf")
    buckets = buckets.select("id", "label", "v", "square", "asks", "row", _bucket().alias("bucket"))
    asking = buckets.filter("asks").groupBy("id", "label", "v", "square").agg(F.min("row").alias("query"), F.min_by("bucket", "row").alias("own"))
    asking = stage(asking, "anchors")
    asking = asking.withColumn("block", blocks_of("query", asking.count(), block))
    best = _positives(asking, buckets, tree, table, positives)
    return _negatives(asking, buckets, tree, table, best, negatives, low, high)


def _bucket() -> Column:
    return F.col("first") + F.pmod(F.xxhash64("row"), F.col("split")).cast("int")


def _positives(asking: DataFrame, buckets: DataFrame, tree: Tree, table: DataFrame, k: int) -> DataFrame:
    """The k best rows of the same label: the anchor's own bucket gives a score to beat, then the tree is searched."""
    none = F.array().cast("array<long>")
    near = asking.withColumn("bucket", F.col("own")).withColumn("least", F.array(F.lit(-MOST))).withColumn("most", none)
    first = stage(_meet(near, buckets, k, same=True), "first")
    edge = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("edge")).filter(F.col("n") == k)
    known = asking.join(edge.select("query", "edge"), "query", "left")
    known = known.withColumn("least", F.array(F.coalesce("edge", F.lit(-MOST)))).withColumn("most", F.array(F.lit(MOST))).drop("edge")
    visits = _visits(known, tree, table).filter("bucket <> own")
    both = first.unionByName(_meet(visits, buckets, k, same=True))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return stage(both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "positives")


def _negatives(asking: DataFrame, buckets: DataFrame, tree: Tree, table: DataFrame, best: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Windows of the positives, one for each distinct score; the k best rows of other labels in each."""
    s = F.col("score")
    bounds = best.select("query", "score", F.ceil(s * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("least"), F.floor(s * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("most"))
    windows = bounds.filter("least <= most").groupBy("query").agg(F.collect_set(F.struct("least", "most")).alias("w"))
    known = asking.join(windows, "query").withColumn("least", F.col("w.least")).withColumn("most", F.col("w.most")).drop("w")
    found = _meet(_visits(known, tree, table), buckets, k, same=False)
    w = Window.partitionBy("query", "least", "most").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ranked = ranked.select("query", "least", "most", "rank", F.col("key").alias("negative"), F.col("score").alias("negative_score"))
    pairs = best.select("query", "query_id", "key", "score").join(bounds.distinct(), ["query", "score"])
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return pairs.join(ranked, ["query", "least", "most"]).select(
        F.col("query_id").alias("anchor_id"), named("key").alias("positive_id"), "rank", named("negative").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score",
    )


# -- the tree ------------------------------------------------------------------------------------


class Tree:
    """Nodes of split points; children are nodes or, as ``~leaf``, leaves."""

    def __init__(self):
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0

    @classmethod
    def of(cls, rows: DataFrame, n: int, leaf: int, sample: int, ways: int) -> Tree:
        """A tree on about ``sample`` rows by the hash of their number, split while a leaf would have more than ``leaf`` rows."""
        tree = cls()
        some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
        x = matrix(some.select("v").toArrow().column("v"))
        tree.root = tree._grow(x, np.arange(len(x)), n / max(1, len(x)), leaf, ways, 0)
        return tree

    def _grow(self, x: np.ndarray, of: np.ndarray, each: float, leaf: int, ways: int, depth: int) -> int:
        points = _apart(x[of], ways) if len(of) * each > leaf and len(of) >= 2 * ways and depth < 16 else []
        if len(points) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        to = squares(x[of], points).argmin(1)
        self.children[node] = [self._grow(x, of[to == j], each, leaf, ways, depth + 1) for j in range(len(points))]
        return node

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(x), np.int32)
        for _, child, of, _, _ in self._walk(x):
            if child < 0:
                out[of] = ~child
        return out

    def _walk(self, x: np.ndarray):
        """(node, child, its rows, position of the child, squared distances to all points of the node) from the root down."""
        todo = [(self.root, np.arange(len(x)))]
        if self.root < 0:
            yield -1, self.root, todo[0][1], 0, np.zeros((len(x), 0))
            return
        while todo:
            node, of = todo.pop()
            far = squares(x[of], self.points[node])
            to = far.argmin(1)
            for j, child in enumerate(self.children[node]):
                here = to == j
                if not here.any():
                    continue
                yield node, child, of[here], j, far[here]
                if child >= 0:
                    todo.append((child, of[here]))

    def measure(self, routed: DataFrame, leaf: int) -> DataFrame:
        """Take the ranges of all rows, and the buckets of every leaf (leaf, first, split)."""
        ranges = routed.select("v", "square").mapInArrow(_measuring(self), RANGES)
        found = ranges.groupBy("node", "child", "point").agg(*(F.min(c).alias(c) for c in ("near", "short")), *(F.max(c).alias(c) for c in ("far", "long")))
        self.near = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.far = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        self.short = [np.full(len(p), np.inf) for p in self.points]
        self.long = [np.full(len(p), -np.inf) for p in self.points]
        for r in found.collect():  # the tree's size, whatever the rows
            self.near[r.node][r.child, r.point], self.far[r.node][r.child, r.point] = math.sqrt(r.near), math.sqrt(r.far)
            self.short[r.node][r.child], self.long[r.node][r.child] = r.short, r.long
        sizes = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan, at = [], 0
        for number in range(self.leaves):
            split = max(1, math.ceil(sizes.get(number, 0) / leaf))
            plan.append((number, at, split))
            at += split
        return routed.sparkSession.createDataFrame(plan, "leaf int, first int, split int")

    def search(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(anchors, leaf) for every leaf that may hold a row with a score in one of an anchor's windows.

        ``least`` and ``most`` have a window in every column; an empty window has least above most.
        """
        own = np.einsum("ij,ij->i", x, x)
        slack = 1e-3 + 1e-7 * math.sqrt(max([own.max(initial=0), *(t.max() for t in self.long)]))
        todo = [(self.root, np.flatnonzero((least <= most).any(1)))]
        while todo:
            node, of = todo.pop()
            if node < 0:
                if len(of):
                    yield of, ~node
                continue
            d = np.sqrt(np.maximum(squares(x[of], self.points[node]), 0))
            for j, child in enumerate(self.children[node]):
                if self.long[node][j] < 0:
                    continue  # no rows
                outer = own[of, None] + self.long[node][j] - 2 * least[of]
                inner = np.sqrt(np.maximum(own[of, None] + self.short[node][j] - 2 * most[of], 0))
                fits = (least[of] <= most[of]) & (outer >= -slack * slack)
                outer = np.sqrt(np.maximum(outer, 0))
                gap = np.maximum(self.near[node][j] - d, d - self.far[node][j]).max(1)
                reach = (d + self.far[node][j]).min(1)
                fits &= (outer + slack >= gap[:, None]) & (inner - slack <= reach[:, None])
                going = of[fits.any(1)]
                if len(going):
                    todo.append((child, going))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; whole numbers, exact as long as they are below 2^53."""
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2.0 * products(a, b)


def _apart(x: np.ndarray, ways: int) -> np.ndarray:
    """Up to ``ways`` different rows, each the furthest from those before."""
    chosen = [int(squares(x, x.mean(0, keepdims=True).round()).argmax(0)[0])]
    nearest = squares(x, x[chosen])[:, 0]
    while len(chosen) < ways and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squares(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


ROUTED = "id long, label long, v array<int>, asks boolean, square long, row long, leaf int"
RANGES = "node int, child int, point int, near double, far double, short double, long double"


def _routing(tree: Tree):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("leaf", pa.array(tree.route(matrix(b.column("v")))))

    return work


def _measuring(tree: Tree):
    """Ranges of a task's rows: one row per node, subtree and split point."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for b in batches:
            long = b.column("square").to_numpy().astype(float)
            for node, _, of, j, d in tree._walk(matrix(b.column("v"))):
                if node < 0 or not len(of):
                    continue
                new = [d.min(0), d.max(0), long[of].min(), long[of].max()]
                old = found.get((node, j), new)
                found[node, j] = [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3])]
        rows = [(n, j, i, float(near[i]), float(far[i]), float(s), float(t)) for (n, j), (near, far, s, t) in found.items() for i in range(len(near))]
        if rows:
            kinds = [pa.int32()] * 3 + [pa.float64()] * 4
            names = [c.split()[0] for c in RANGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return work


# -- anchors and buckets -------------------------------------------------------------------------

ASKED = ("query", "id", "label", "v", "least", "most", "block")


def _visits(known: DataFrame, tree: Tree, table: DataFrame) -> DataFrame:
    """The buckets of the leaves that the tree leaves to every anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, most = padded(b.column("least"), 1), padded(b.column("most"), 0)
            for of, leaf in tree.search(matrix(b.column("v")), least.astype(float), most.astype(float)):
                out = pa.RecordBatch.from_pydict({"query": b.column("query").take(pa.array(of)), "leaf": pa.array(np.full(len(of), leaf, np.int32))})
                yield out

    visits = known.select("query", "v", "least", "most").mapInArrow(work, "query long, leaf int")
    chunk = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("split") - 1)).alias("bucket")
    found = visits.join(F.broadcast(table), "leaf").select("query", chunk)
    return known.join(found, "query")


def padded(column: pa.Array, empty: int) -> np.ndarray:
    """Lists of bounds as a matrix; ``empty`` fills up, so that least 1 and most 0 make no window."""
    items = column.to_pylist()
    width = max((len(x) for x in items), default=0)
    return np.array([list(x) + [empty] * (width - len(x)) for x in items], np.int64).reshape(len(items), width)


def _meet(queries: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of the same label, or of other labels in every window, that a bucket has for each anchor."""

    def work(q: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels, number = ids_of(q.column("id"), NO_ID), q.column("label").to_numpy(), q.column("query").to_numpy()
        keys, classes = ids_of(rows.column("id"), NO_ID), rows.column("label").to_numpy()
        x, p = matrix(q.column("v")), matrix(rows.column("v"))
        least, most = q.column("least").to_pylist(), q.column("most").to_pylist()
        order = np.argsort(keys, kind="stable")
        keys, classes, p = keys[order], classes[order], p[order]
        out: list[tuple] = []
        for at in range(0, len(x), PIECE):
            score = products(x[at : at + PIECE], p)
            for j, s in enumerate(score):
                i = at + j
                fine = (classes == labels[i]) == same
                if same:
                    windows = [(least[i][0], MOST)]
                    fine &= keys != ids[i] if ids[i] != NO_ID else True
                else:
                    windows = list(zip(least[i], most[i], strict=True))
                fine &= (s >= min(w[0] for w in windows)) & (s <= max(w[1] for w in windows))
                of = np.flatnonzero(fine)
                of = of[np.argsort(-s[of], kind="stable")]  # ids ascend among ties
                falling = -s[of]
                for low, high in windows:
                    a = int(np.searchsorted(falling, -high, "left"))
                    b = int(np.searchsorted(falling, -low, "right"))
                    for r in of[a : min(b, a + k)]:
                        out.append((number[i], q.column("id")[i].as_py(), low, high, keys[r], s[r]))
        names = ("query", "query_id", "least", "most", "key", "score")
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    asked = queries.select(*ASKED, "bucket")
    sent = buckets.select("id", "label", "v", "bucket")
    return meet(asked, sent, work, "query long, query_id long, least long, most long, key long, score long")
