"""Near-duplicate components against brute force; the estimate; connected components."""

import random

import numpy as np
import pytest

from barloom.llm import near_dedup
from tests.llm.rows import awkward, frame, key, near_classes


def edited(n, seed=5):
    """A large group of copies with up to eight edits, most of them not similar enough to each other directly."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(60)] = f"v{rng.randrange(20)}"
        yield (1000 + i, " ".join(words), "", "", 0, "", 0, 0, 0)


def test_components_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    docs = [(r.doc_id + 100, r.text, "", "", 0, "", 0, 0, 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = awkward() + docs + list(edited(250))
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    want = near_classes([(r[0], r[1]) for r in rows], 2, 80)
    assert sorted((key(r[0]), r[1], key(r[2]), r[3]) for r in got) == sorted((key(d), n, c, key(d) == c) for d, n, c in want)


def test_one_row_of_each_group_stays(spark):
    rows = awkward() + list(edited(60, seed=8))
    got = near_dedup.clean(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    left, want = [], set()
    for (d, n, c), r in zip(near_classes([(r[0], r[1]) for r in rows], 5, 80), rows, strict=True):
        if n == 0:
            left.append((key(d), r[1]))
        elif key(d) == c and (key(d), r[1]) not in want:
            want.add((key(d), r[1]))
    assert sorted(((key(r.doc_id), r.text) for r in got.collect()), key=str) == sorted([*left, *want], key=str)


def test_large_tables_are_shuffled(spark, monkeypatch):
    rows = awkward() + list(edited(40))
    want = sorted(map(str, near_dedup.near_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, near_dedup.near_duplicates(frame(spark, rows)).collect())) == want


def test_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.clean(frame(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.sort(pool[a:z]) for a, z in ((0, 2000), (1000, 3000), (200, 2200), (0, 1900))]
    regs = near_dedup.registers([*sets, np.union1d(sets[0], sets[1])])
    assert (np.maximum(regs[0], regs[1]) == regs[4]).all()
    for other, truth in ((1, 1000 / 3000), (2, 1800 / 2200), (3, 0.95)):
        a, b = regs[[0]], regs[[other]]
        n = np.array([float(len(sets[0]))]), np.array([float(len(sets[other]))])
        guess = near_dedup.likely_similarity((a > b).sum(1), (a < b).sum(1), *n)[0]
        assert abs(guess - truth) < 0.12


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_connected(spark, shape):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(60) if i != 7], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]}[shape]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)


def test_only_nodes_beside_the_largest_component_are_dealt_to_all(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    members = spark.createDataFrame([(1, i, 0 if i < 400 else i, 1) for i in range(420)] + [(2, i, 7, 1) for i in range(50)], "bucket long, node long, root long, n long")
    torn = near_dedup._torn(members, "bucket")
    assert [(r.bucket, r.k, r.top) for r in torn.collect()] == [(1, 420, 0)]
    dealt = near_dedup._dealt_in_blocks(members, "bucket", torn, 470)
    tasks = dealt.groupBy("l", "r").count().collect()
    assert len(tasks) == 2 * 27 and max(r["count"] for r in tasks) < 16 * 5
    pairs = dealt.filter("is_left").alias("x").join(dealt.filter("NOT is_left").alias("y"), ["l", "r"]).selectExpr("x.node a", "y.node b")
    assert pairs.count() == pairs.distinct().count() == 20 * 420
