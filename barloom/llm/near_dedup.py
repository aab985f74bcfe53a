"""Near-duplicate documents by SetSketch registers, confirmed on full shingle sets.

A register keeps the exponent of a truncated minimum: floor(1 - log_b(min of exponential hashes)), clipped. Registers of
a union are the maxima of its parts' registers, and two sets agree in a register about as often as their Jaccard
similarity, since the base is close to 1. Bands of registers name candidates; the similarity most likely under both
sets' registers and sizes rules out what is far below the threshold; the full sets decide.

Documents with equal sets are one node. In every band bucket all nodes are first tested against one of them, so a
bucket of k nodes costs k tests. Only where the nodes of a bucket are not all connected then are those beside its
largest component compared with the others, in blocks. No link between components is lost, no group is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barloom.llm.arrays import U, mix64, offsets_of, ragged, word_hashes
from barloom.llm.common import left_join_hot, packed, texts_of, unpacked
from barloom.sources.stage import stage

#: Registers in bands of ROWS: a pair of similarity 0.8 shares no band with a probability of about 1e-7.
ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Standard deviations of the estimate below the threshold from which on a pair is not confirmed.
SLACK = 5.0
#: Nodes of a block, and items of their sets, where torn groups are compared.
BLOCK, BLOCK_ITEMS = 512, 1 << 20
#: Rows of two or three longs that may be broadcast: 24 MB.
BROADCAST_ROWS = 1 << 20
#: Hashes looked at at once; they stay in a core's cache.
CHUNK = 1 << 16


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, A-Z in lower case.

    A text with fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    words, first = word_hashes([t.lower() for t in texts])
    out = []
    n = max(len(words) - size + 1, 0)
    h = np.zeros(n, U)
    for k in range(size):
        h = mix64(h * U(0x9E3779B97F4A7C15) + words[k : k + n])
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= size:
            out.append(np.unique(h[a : z - size + 1]))
        elif z > a:
            x = np.full(1, z - a, U)
            for w in words[a:z]:
                x = mix64(x * U(0x9E3779B97F4A7C15) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out


def node_of(s: np.ndarray) -> int:
    """A long that names a set: equal sets have equal names."""
    x = np.append(mix64(s ^ U(0xA0761D6478BD642F)), mix64(np.array([len(s)], U))).sum(keepdims=True)
    return int(mix64(x).astype(np.int64)[0])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row per set; empty sets have zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    factors = mix64(np.arange(1, REGISTERS + 1, dtype=U)) | U(1)
    full = [i for i, s in enumerate(sets) if len(s)]
    a = 0
    while a < len(full):
        b, total = a, 0
        while b < len(full) and (total == 0 or total + len(sets[full[b]]) <= CHUNK):
            total += len(sets[full[b]])
            b += 1
        flat = np.concatenate([sets[i] for i in full[a:b]])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[a : b - 1])])
        least = np.stack([np.minimum.reduceat(flat * f, starts) for f in factors], 1)
        x = -np.log1p(-((least >> U(11)).astype(float) + 0.5) / 2.0**53) / RATE
        out[full[a:b]] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
        a = b
    return out


def likely_similarity(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the highest joint likelihood, given in how many registers the first set's are above and
    below the second's and both set sizes. Searched on a grid of hundredths."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    more, less = p(np.clip(u[:, None] - v[:, None] * grid, 0, 1)), p(np.clip(v[:, None] - u[:, None] * grid, 0, 1))
    same = np.clip(1 - more - less, 1e-12, 1)
    equal = REGISTERS - above - below
    score = above[:, None] * np.log(more) + below[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return np.take_along_axis(grid, score.argmax(1)[:, None], 1)[:, 0]


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of register rows may reach the threshold."""
    t = percent / 100
    guess = likely_similarity((a > b).sum(1), (a < b).sum(1), n_a.astype(float), n_b.astype(float))
    return guess >= t - SLACK * np.sqrt(t * (1 - t) / REGISTERS) - 0.01


def _with_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            some = batch.slice(a, 256)
            yield some, shingle_sets(texts_of(some.column("text")), size)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n (size of the set), node (null for an empty set) and registers of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _with_sets(batches, size):
            rows = registers(sets)
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), node, pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "text_hash", "n", "node", "registers"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, node long, registers binary")


def full_sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """node and its set, once each, for the texts named in ``wanted`` (text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _with_sets(batches, size):
            sets = [s for s in sets if len(s)]
            arrays = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), arrays], names=["node", "items"])

    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash", "left_semi")
    return texts.dropDuplicates(["text_hash"]).select("text").mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def band_keys(nodes: DataFrame) -> DataFrame:
    """(bucket, node): one row per band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), rows.shape[:2]).copy()
            for k in range(ROWS):
                h = mix64(h * U(0x9E3779B97F4A7C15) + rows[:, :, k])
            node = batch.column("node").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64).ravel()), pa.array(np.repeat(node, BANDS))], names=["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _pairs_with_registers(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the joint likelihood does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                x = batch.slice(s, 2048)
                ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                ok = plausible(ra, rb, x.column("na").to_numpy(), x.column("nb").to_numpy(), percent)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    one = nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    # sizes alone bound the similarity
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(one, "a").join(two, "b").filter(near).select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity. A node with many pairs is dealt over tasks with its set."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node")
    sets = stage(full_sets(docs, size, wanted.select("text_hash").distinct()), "near-sets")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / 500).cast("int"))
    dealt = left_join_hot(pairs, counts, "a", "n", pairs.count(), F.xxhash64("b"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    hubs = sets.withColumnRenamed("node", "a").join(counts, "a").select("a", F.col("items").alias("xs"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = sets.select(F.col("node").alias("b"), F.col("items").alias("ys"))
    both = dealt.select("a", "b", "salt").join(others, "b").join(hubs, ["a", "salt"])
    shared = F.size(F.array_intersect("xs", "ys"))
    return both.filter(100 * shared >= percent * (F.size("xs") + F.size("ys") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (a, b): root is the smallest node it is connected with.

    Alternating stars: each node hands its smallest neighbour to its larger, then to its smaller ones, until nothing
    changes. Nodes of many edges are joined as hot keys; each round is a written table.
    """

    def star(links: DataFrame, total: int) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return left_join_hot(links, least, "u", "n", total, F.xxhash64("v")).withColumn("m", F.least("u", "m"))

    def written(links: DataFrame) -> tuple[DataFrame, tuple]:
        """The links as a table, their number and a sum of their hashes, taken while they are written."""
        seen = Observation()
        links = stage(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "near-links")
        return links, (seen.get["n"], seen.get["sum"])

    links, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(star(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "near-large")
        small = star(large, before[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        links, after = written(small.filter("u != v").distinct())
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


class Sets:
    """Disjoint sets of a block's components."""

    def __init__(self, roots: np.ndarray):
        self.up = {int(r): int(r) for r in np.unique(roots)}

    def top(self, r: int) -> int:
        while self.up[r] != r:
            self.up[r] = self.up[self.up[r]]
            r = self.up[r]
        return r

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _meet(rows: pa.Table, linked) -> tuple[list[int], list[int]]:
    """Pairs that join components, a forest at most: a row of the left block with rows of the right block.

    ``linked``: for a row and candidate rows of the right block, which of them join. A pair of two left rows is seen once.
    """
    node, root, left, few = (rows.column(c).to_numpy() for c in ("node", "root", "is_left", "few"))
    sets, found = Sets(root), ([], [])
    right = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        j = right[(root[right] != root[i]) & (~few[right] | (node[right] > node[i]))]
        if not len(j):
            continue
        for k in linked(i, j):
            if sets.join(int(root[i]), int(root[k])):
                found[0].append(i)
                found[1].append(k)
    return found


def _torn(members: DataFrame, group: str) -> DataFrame:
    """Groups with several components: their number of rows, largest component and numbers of left and right blocks.

    ``members`` has ``n``, the items that a row brings to a task. The largest component is inside already; only the nodes beside
    it are compared, with all nodes of the group.
    """
    parts = members.groupBy(group, "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    tops = parts.groupBy(group).agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max("k").alias("top_k"), F.max_by("n", "k").alias("top_n"), F.max_by("root", "k").alias("top"), F.count(F.lit(1)).alias("roots"))

    def blocks(rows: Column, items: Column) -> Column:
        return F.ceil(rows / BLOCK + items / BLOCK_ITEMS).cast("int")

    lefts = blocks(F.col("k") - F.col("top_k"), F.col("n") - F.col("top_n"))
    return tops.filter("roots > 1").select(group, "k", "top", lefts.alias("lefts"), blocks(F.col("k"), F.col("n")).alias("rights"))


def _dealt_in_blocks(members: DataFrame, group: str, torn: DataFrame, total: int) -> DataFrame:
    """Rows of torn groups for their tasks (group, l, r): the left block's nodes, beside the largest component, and the
    right block's, of all nodes. A row is sent to as many tasks as the other side has blocks."""
    dealt = left_join_hot(members, torn, group, "k", total, F.xxhash64("node")).filter("top IS NOT NULL").drop("k", "n")
    dealt = dealt.withColumn("few", F.col("root") != F.col("top")).withColumn("at", F.xxhash64("node"))
    one = dealt.filter("few").withColumn("l", F.pmod("at", "lefts").cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    two = dealt.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("r", F.pmod("at", "rights").cast("int"))
    both = one.withColumn("is_left", F.lit(True)).unionByName(two.withColumn("is_left", F.lit(False)))
    return both.drop("top", "lefts", "rights", "at")


def more_links(buckets: DataFrame, docs: DataFrame, nodes: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that the stars have not found; enough of them to join what is linked.

    Components with plausible pairs in one bucket form clusters (of such pairs a forest travels). The nodes of a cluster
    then meet with their full sets. Both times only the nodes beside the largest component are compared with
    the others, so a group of k nodes of which m are outside costs m * k tests, in tasks of bounded rows and items. Neither
    candidates nor links are expanded into all pairs.
    """
    least = REGISTERS * (percent / 100 - SLACK * np.sqrt(0.16 / REGISTERS) - 0.05)  # few pairs need the likelihood

    def near(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        node, hub, n, root = (rows.column(c).to_numpy() for c in ("node", "hub", "n", "root"))
        regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)

        def linked(i: int, j: np.ndarray) -> np.ndarray:
            j = j[(node[j] != hub[j]) & (node[i] != hub[i])]  # the hub's pairs are tested
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            same = (regs[j] == regs[i]).sum(1)
            j, same = j[same >= least], same[same >= least]
            if not len(j):
                return j
            # the closest node of each component first: where it is plausible, the component's others need no estimate
            order = np.lexsort((-same, root[j]))
            j = j[order]
            first = np.ones(len(j), bool)
            first[1:] = root[j][1:] != root[j][:-1]
            heads = j[first]
            ok = likely(i, heads)
            rest = j[~first & ~np.isin(root[j], root[heads[ok]])]
            return np.concatenate([heads[ok], rest[likely(i, rest)]])

        def likely(i: int, j: np.ndarray) -> np.ndarray:
            if not len(j):
                return np.zeros(0, bool)
            return plausible(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), n[i]), n[j], percent)

        a, b = _meet(rows, linked)
        return pa.table({"a": pa.array(root[a], pa.int64()), "b": pa.array(root[b], pa.int64())})

    def exact(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        items = rows.column("items").combine_chunks()
        edge = items.offsets.to_numpy().astype(np.int64)
        flat = items.values.to_numpy()
        every, place = np.unique(flat, return_inverse=True)
        sizes, node, mark = np.diff(edge), rows.column("node").to_numpy(), np.zeros(len(every), bool)
        right = np.flatnonzero(~rows.column("is_left").to_numpy())
        theirs = ragged(place, edge[:-1][right], sizes[right])
        starts, nth = offsets_of(sizes[right])[:-1], np.zeros(len(sizes), np.int64)
        nth[right] = np.arange(len(right))

        def linked(i: int, j: np.ndarray) -> np.ndarray:
            mine = place[edge[i] : edge[i + 1]]
            mark[mine] = True
            shared = np.add.reduceat(mark[theirs], starts, dtype=np.int64)[nth[j]]
            mark[mine] = False
            return j[100 * shared >= percent * (sizes[i] + sizes[j] - shared)]

        a, b = _meet(rows, linked)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    slim = nodes.select("node", "registers", "n")
    members = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stage(members.withColumn("n", F.lit(0)), "near-members")  # registers alone meet here
    torn = stage(_torn(members, "bucket").filter("k > 2"), "near-torn")  # of two nodes, one is the hub
    meets = _dealt_in_blocks(members, "bucket", torn, members.count()).join(slim, "node")
    touching = meets.groupBy("bucket", "l", "r").applyInArrow(near, "a long, b long").distinct()
    clusters = stage(components(touching).select(F.col("node").alias("root"), F.col("root").alias("cluster")), "near-clusters")
    in_torn = members.join(torn.select("bucket"), "bucket", "left_semi").select("node", "root").distinct()
    inside = in_torn.join(clusters, "root").join(nodes.select("node", "n", "text_hash"), "node")
    inside = stage(inside.select("node", "root", "cluster", "n", "text_hash"), "near-inside")
    sets = stage(full_sets(docs, size, inside.select("text_hash").distinct()), "near-sets")
    sizes = stage(_torn(inside, "cluster"), "near-sizes")
    met = _dealt_in_blocks(inside.drop("text_hash"), "cluster", sizes, inside.count()).join(sets, "node")
    return met.groupBy("cluster", "l", "r").applyInArrow(exact, "a long, b long")


def near_components(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Node of every near-duplicate class: written table (doc_id, text_hash, n, node, root, smallest, docs).

    ``smallest``: least doc_id of the component (nulls aside); ``docs``: number of rows with the node.
    """
    drawn = stage(sketches(docs, size), "near-sketches")
    full = drawn.filter("node IS NOT NULL")
    nodes = stage(full.dropDuplicates(["node"]).select("node", "n", "text_hash", "registers"), "near-nodes")
    bands = band_keys(nodes)  # cheaper to draw twice than to keep
    shared = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = stage(shared, "near-shared")
    total = nodes.count() * BANDS
    if shared.count() <= BROADCAST_ROWS:
        buckets = bands.join(F.broadcast(shared), "bucket")
    else:
        buckets = left_join_hot(bands, shared, "bucket", "k", total, F.xxhash64("node")).filter("hub IS NOT NULL")
    buckets = stage(buckets.select("bucket", "node", "hub"), "near-buckets")
    stars = buckets.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = stage(_pairs_with_registers(stars, nodes, percent), "near-stars")
    links = stage(confirmed(stars, docs, nodes, size, percent), "near-confirmed")
    roots = stage(components(links), "near-roots")
    more = stage(more_links(buckets, docs, nodes, roots, size, percent), "near-more")
    if more.count():
        roots = stage(components(links.unionByName(more)), "near-roots")
    per_node = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
    rooted = per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("nodes"))
    by_node = stage(left_join_hot(rooted, least, "root", "nodes", total // BANDS, F.col("node")).select("node", "root", "smallest", "docs"), "near-nodes-rooted")
    rows = drawn.drop("registers")
    return left_join_hot(rows, by_node, "node", "docs", max(1, total // BANDS), F.xxhash64("doc_id", "text_hash"))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (one row per input row).

    Documents are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` hundredths.
    component_id is the smallest doc_id reachable. Null and empty texts have no shingles and are linked with nothing;
    rows alike are linked (both are kept if they share the smallest id); a null id is in a component as any other, but
    names it only if all its documents have none. No rows give no rows; other columns are not read. Jobs run and
    tables are written when called.
    """
    rows = near_components(docs, size, percent)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    rows = rows.withColumn("component_id", component)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def clean(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each near-duplicate component: that with the smallest id, of rows alike one.

    Null and empty texts have no shingles and stay; texts of fewer than ``size`` words are their whole sequence; a null id counts as larger than
    all others. All columns stay as they are, whatever they are called; no rows give no rows.
    """
    rows = near_components(docs, size, percent).filter(F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("smallest")))
    keep = rows.groupBy(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_t")).agg(F.count(F.lit(1)).alias("_times"), F.max("node").alias("_node"))
    rows = packed(docs, "doc_id", "text").withColumn("_doc_id", F.col("_doc_id").cast("long")).withColumn("_text", F.xxhash64("_text"))
    found = rows.join(stage(keep, "near-keep"), F.col("_doc_id").eqNullSafe(F.col("_k")) & (F.col("_text") == F.col("_t")))
    alike = (F.col("_times") > 1) & F.col("_node").isNotNull()
    return unpacked(found.filter(~alike).unionByName(found.filter(alike).dropDuplicates(["_doc_id", "_text"])), docs)
