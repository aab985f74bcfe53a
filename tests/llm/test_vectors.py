"""Clustering, top products and hard negatives against brute force, on awkward rows and the whole test table."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import clustering, hard_negatives, queries, top_products
from tests.llm.rows import key

SCHEMA = "vec_id long, label int, embedding array<float>, row long, bucket int, score long, kept string, query long, cluster int, n int"
EXTRA = (7, 7, 7, "k", 7, 7, 7)


def rows_of(n=260, dims=8, groups=5, seed=3):
    """Vectors in loose groups of different lengths, with nulls, repeats, ties, zeros and damaged ones."""
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(groups)]
    rows = []
    for i in range(n):
        g = rng.randrange(groups)
        size = rng.choice((0.2, 1.0, 1.0, 3.0))
        rows.append((i, g if rng.random() < 0.9 else rng.randrange(groups), [size * (x + rng.gauss(0, 0.1)) for x in centre[g]]))
    same = rows[3][2]
    rows += [(1000 + i, i % 3, same) for i in range(40)]  # one hot vector
    rows += [(50, 1, rows[50][2]), (100, rows[100][1], rows[100][2]), (None, 2, same), (None, 2, same), (2000, None, same)]
    rows += [(2050, 1, None), (2100, 1, [math.nan] * dims), (2150, 1, [math.inf] + [0.0] * (dims - 1)), (2200, 1, [None] * dims)]
    rows += [(2300, 0, [0.0] * dims), (2400, 1, [0.0] * dims), (-100, 2, rows[7][2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def good(rows, scale, dims=None):
    for i, label, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and (dims is None or len(v) == dims):
            yield i, label, [math.floor(scale * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def last(i):
    return key(i) if i is not None else 2**64


# -- clustering ----------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=1024):
    vs = [(i, v) for i, _, v in good(rows, scale, dims)]
    start = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vs]
        for j in range(len(c)):
            of = [v for (_, v), o in zip(vs, own, strict=True) if o == j]
            if of:
                c[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    best = [near(v) for _, v in vs]
    per = [sum(d for d, j in best if j == m) for m in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, j, d, per[j], sum(per), sha[j]) for (i, _), (d, j) in zip(vs, best, strict=True)]


@pytest.mark.parametrize("bits", [1, 3, 7])
def test_clusters(spark, bits):
    rows = rows_of() + [(9000, 1, [0.1] * 7), (9001, 1, []), (9002, 1, [5.0, *[-5.0] * 7])]
    got = clustering.cluster(frame(spark, rows), k=5, rounds=4, dims=8, bits=bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_clusters(rows, 5, 4, 8)))


def test_few_and_no_vectors(spark):
    rows = [(1, 0, [0.5, 0.25]), (2, 0, [0.5, 0.25]), (3, 0, [-0.5, 0.1])]
    got = clustering.cluster(frame(spark, rows), dims=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute_clusters(rows, 8, 10, 2)) and len(got) == 3
    none = clustering.cluster(frame(spark, [(1, 0, None)]), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(frame(spark, [(1, 0, [1e9])]), dims=1).collect()


def test_cells_decide_what_is_clear_and_leave_the_rest():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-300, 300, (5, 16))
    x = centroids[rng.integers(0, 5, 2000)] + rng.integers(-60, 60, (2000, 16))
    marks = np.arange(-512, 512, 8)
    low = np.tile(np.concatenate([[x.min()], marks[1:]]), (16, 1))
    high = np.tile(np.concatenate([marks[1:] - 1, [x.max()]]), (16, 1))
    cells = clustering._coded(x, low)
    exact = clustering.distances(x, centroids)
    for reference in (centroids.mean(0), centroids[2]):
        own = clustering.by_intervals(cells.astype(np.int16), clustering.intervals(centroids, reference, low, high))
        assert (own >= 0).mean() > 0.9 and (own[own >= 0] == exact.argmin(1)[own >= 0]).all()
    tie = clustering.by_intervals(cells[:1].astype(np.int16), clustering.intervals(np.stack([centroids[0], centroids[0]]), centroids[0], low, high))
    assert tie[0] == -1  # equal centroids are never told apart by cells


# -- top products --------------------------------------------------------------------------------


def brute_top(rows, k, asks, scale=256):
    vs = [(i, v) for i, _, v in good(rows, scale)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in vs if i is not None and asks(i)}:
        best = sorted((-dot(v, w), last(j), j) for j, w in vs if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(best)]
    return sorted(map(str, out))


@pytest.mark.parametrize("bucket, block", [(2048, 2048), (16, 5)])
def test_top_products(spark, bucket, block):
    rows = rows_of() + [(3000, 0, []), (3050, 0, [4.0]), (3100, 0, [-0.7, 2.0])]
    got = top_products.top_products(frame(spark, rows), F.col("vec_id") % 50 == 0, bucket=bucket, block=block).collect()
    assert sorted(map(str, map(tuple, got))) == brute_top(rows, 5, lambda i: i % 50 == 0)
    two = rows[:3]
    got = top_products.top_products(frame(spark, two), F.col("vec_id") == 0).collect()
    assert sorted(map(str, map(tuple, got))) == brute_top(two, 5, lambda i: i == 0) and len(got) == 2
    assert top_products.top_products(frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_both_prunings_keep_all_that_count():
    """Every local threshold: by length, by coordinates, and buckets that are not searched at all."""
    rng = np.random.default_rng(5)
    rows = (rng.normal(0, 60, (400, 12)) * rng.choice([0.3, 1, 2], (400, 1))).round()
    asks = rng.normal(0, 60, (40, 12)).round()
    score = asks @ rows.T
    squares = np.einsum("ij,ij->i", rows, rows).astype(np.int64)
    for share in (0.0, 0.5, 0.9, 1.0, 1.2):
        least = (np.sort(score, 1)[:, -5] * share).astype(np.int64)
        found = list(top_products.search(-np.arange(1, 41), asks, least, np.arange(400), rows, squares, 5))
        got = {(int(i), int(j), int(s)) for part in found for i, j, s in zip(*part, strict=True)}
        want = {(i, int(j), int(score[i, j])) for i in range(40) for j in np.argsort(-score[i], kind="stable")[:5] if score[i, j] >= least[i]}
        assert got == want


def test_short_buckets_are_not_visited(spark):
    rows = [(i, 0, [1.0 + i / 100, 0.5]) for i in range(50)] + [(100 + i, 0, [0.001 * i, 0.0]) for i in range(200)]
    df = frame(spark, rows)
    seen = []
    before = top_products.meet
    try:
        top_products.meet = lambda q, *a: seen.append(q.select("query", "bucket").count()) or before(q, *a)
        top_products.top_products(df, F.col("vec_id") == 0, bucket=25).collect()
    finally:
        top_products.meet = before
    assert seen[0] == 1 and seen[1] <= 2  # of some ten buckets


# -- hard negatives ------------------------------------------------------------------------------


def brute_negatives(rows, asks, k=5, low=80, high=100, scale=256):
    vs = [r for r in good(rows, scale) if r[1] is not None]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in vs if i is not None and asks(i)}:
        scored = sorted((-dot(v, w), last(j), j, m == label) for j, m, w in vs if j != i)
        for p, _, j, _ in [x for x in scored if x[3]][:k]:
            window = [x for x in scored if not x[3] and low * -p <= 100 * -x[0] <= high * -p][:k]
            out += [(i, j, r + 1, x[2], -p, -x[0]) for r, x in enumerate(window)]
    return sorted(map(str, out))


@pytest.mark.parametrize("leaf, sample, ways, block", [(2048, 16384, 8, 1024), (12, 16384, 4, 2), (20, 60, 3, 100)])
def test_hard_negatives(spark, leaf, sample, ways, block):
    rows = rows_of() + [(4000, 0, []), (4100, 0, [1.0])]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, leaf=leaf, sample=sample, ways=ways, block=block).collect()
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(map(str, map(tuple, got))) == want and len(want) > 100
    assert hard_negatives.hard_negatives(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, rows[:1]), F.col("vec_id") == 0).count() == 0


def test_the_tree_eliminates_and_loses_nothing(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 200, (12, 6))
    x = (centre[rng.integers(0, 12, 3000)] + rng.normal(0, 20, (3000, 6))).round()
    df = spark.createDataFrame([(i, [int(a) for a in v], int(v @ v)) for i, v in enumerate(x)], "row long, v array<int>, square long")
    tree = hard_negatives.Tree.of(df, 3000, 100, 1000, 6)
    leaf = tree.route(x)
    routed = spark.createDataFrame([(i, [int(a) for a in v], int(v @ v), int(n)) for i, (v, n) in enumerate(zip(x, leaf, strict=True))], "row long, v array<int>, square long, leaf int")
    tree.measure(routed, 100)
    asks = x[:50]
    score = asks @ x.T
    low, high = 0.8 * score.max(1, keepdims=True), score.max(1, keepdims=True)
    visited = set()
    for of, n in tree.search(asks, low, high):
        visited |= {(int(i), n) for i in of}
    needed = {(i, int(leaf[j])) for i, j in zip(*np.nonzero((score >= low) & (score <= high)), strict=True)}
    assert needed <= visited and tree.leaves > 20 and len(visited) < 0.5 * 50 * tree.leaves


# -- the registered queries ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_top_products", "op13_hard_negatives"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = getattr(queries, name)(spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
