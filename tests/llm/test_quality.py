"""Quality rules: statistics against brute force, the trees' constraints and their accuracy on rows held out."""

import re
from collections import Counter

import numpy as np

from barloom.llm import quality, queries
from tests.llm.rows import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_statistics(spark, sf):
    rows = awkward() + [(r.doc_id + 100, r.text, "", "", 0, "", 0, 0, 0) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    got = quality.judge(frame(spark, rows), None).collect()
    want = []
    for d, t, *_ in rows:
        s = brute(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((d, *s, failed, not failed))
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)


def test_trees_follow_their_constraints_and_learn():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    noise = rng.random(4000) < 0.1
    y = ((x[:, 0] < 0.4) | (x[:, 1] > 0.9)) ^ noise
    model = quality.train(x[:3000], y[:3000].astype(float), [-1, 1, 0])
    right = (model.margin(x[3000:]) > 0) == y[3000:]
    assert right.mean() > 0.85
    line = np.linspace(0, 1, 200)
    for other in rng.random((20, 3)):
        for column, sign in ((0, -1), (1, 1)):
            rows = np.repeat(other[None], 200, 0)
            rows[:, column] = line
            assert (sign * np.diff(model.margin(rows)) >= -1e-9).all()


def test_held_out_documents():
    """Half of the labelled documents train, the other half is judged."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    x = quality.feature_matrix(np.array([quality.text_stats(r[1].encode()) for r in rows]))
    y = np.array([r[2] for r in rows], float)
    model = quality.train(x[::2], y[::2], list(quality.FEATURES.values()))
    good = model.margin(x[1::2]) >= 0
    assert (good == y[1::2]).mean() > 0.97
    assert good[y[1::2] == 1].mean() > 0.99


def test_no_labels_and_no_rows(spark, sf):
    docs = frame(spark)
    for labels in ([], [(1, None, 0), (None, 1, 0)], [(3, 1, 0), (4, 1, 0)]):
        assert quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) is None
    assert quality.judge(frame(spark, []), None).count() == 0
    assert quality.clean(frame(spark, []), None).columns == docs.columns


def test_clean_keeps_what_judge_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.clean(docs, model).collect()}
    judged = queries.op5_quality_rules(spark, sf).collect()
    assert kept == {r.doc_id for r in judged if r.kept}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels.get(r.doc_id) != 1 for r in judged if not r.kept and not r.base_failed)
