"""The pipeline's stages against brute force, each on its own input, and column names that their helpers use too."""

from collections import Counter

import pytest

import corpus_pipeline
from barloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tests.llm.rows import awkward, frame, key, near_classes
from tests.llm.test_native import brute_targets, shingles, words
from tests.llm.test_quality import brute
from tests.llm.test_windows import brute_passages

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((key(r.doc_id), r.text or "") for r in df.collect()), key=str)


def docs_of(spark, sf):
    """The test documents, and copies, near copies, repeated passages and benchmark items in them."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(5).collect()]
    long = [d for d in docs if d[1] and 200 < len(d[1].split()) < 2000][:12]
    more = [(1000 + i, d[1], d[2], d[3], d[4]) for i, d in enumerate(long[:4])]
    more += [(2000 + i, " ".join([*d[1].split(), "more"]), d[2], d[3], d[4]) for i, d in enumerate(long[4:8])]
    more += [(3000 + i, d[1] + "\n" + t, d[2], d[3], d[4]) for i, (d, t) in enumerate(zip(long[8:], items, strict=False))]
    return docs + more + [(None, None, None, None, None), (5000, "", "", None, 0)]


def test_stages_against_brute_force(spark, sf, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame(docs_of(spark, sf), DOCUMENTS)
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = [(key(r.doc_id), r.text, r.source) for r in docs.collect()], spark.read.parquet(str(tmp_path / name))
        pairs, got = [(d, t) for d, t, _ in before], rows_of(docs)
        assert docs.columns == columns or name == "source_mixing"
        if name == "quality_rules":
            model = quality.fit(spark.createDataFrame(docs_of(spark, sf), DOCUMENTS), labels)
            good = Counter((key(r.doc_id), r.kept) for r in quality.judge(spark.createDataFrame(docs_of(spark, sf), DOCUMENTS), model).collect())
            for d, t in pairs:
                s = brute(t)
                assert not good[d, True] or not (s[0] < 50 or 100 * s[4] > 50 * s[0])
            want = [(d, t or "") for d, t in pairs if good[d, True]]
        elif name == "line_dedup":
            want = [(d, kept) for d, n, gone, kept in brute_passages(pairs, 13) if gone < n or n == 0]
        elif name == "near_dedup":
            roots = near_classes(pairs, 5, 80)
            want = [(d, t or "") for (d, t), (_, n, least) in zip(pairs, roots, strict=True) if n == 0 or d == least]
        elif name == "benchmark_decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = [(d, t or "") for d, t in pairs if not any(q and 100 * len(q & shingles(t)) >= 80 * len(q) for q in items)]
        else:
            sizes = Counter()
            for _, t, s in before:
                sizes[s] += words(t)
            taken = Counter()
            for r in docs.collect():
                taken[r.source] += r.taken
                assert r.copies in (1, 2) and r.taken == r.copies * words(r.text)
            largest = {s: max(words(t) for _, t, x in before if x == s) for s in sizes}
            assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in brute_targets(sizes).items())
            want = got
            assert Counter(got) <= Counter((d, t or "") for d, t in pairs)
        assert got == sorted(want, key=str), name
        seen[name] = (len(before), len(got))
    assert all(a > b for a, b in list(seen.values())[:1]) and seen["source_mixing"][1] > 0


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"] and out.count() > 0


CLASH = ("_row", "_doc_id", "_text", "_k", "_t", "_times", "_node", "_id", "_hash", "_found", "_same", "_d", "_item", "_s", "_w", "_i", "h", "n", "size", "target", "copies", "taken", "node", "smallest", "kept", "bucket", "block", "_own_lang", "_one", "rank", "value")


@pytest.mark.parametrize("name", ["quality", "lines", "near", "benchmark", "mix"])
def test_columns_named_like_helpers(spark, name):
    rows = [r[:5] for r in awkward()]
    plain = frame(spark, rows, DOCUMENTS)
    wide = frame(spark, [(*r, *([f"x{i}"] * len(CLASH))) for i, r in enumerate(rows)], DOCUMENTS + "".join(f", {c} string" for c in CLASH))
    benchmark = spark.createDataFrame([(1, "three four five six one two", 1), (2, "x y x y x y x", 1)], "item_id long, text string, h long")
    clean = {
        "quality": lambda d: quality.clean(d, None), "lines": line_dedup.clean, "near": near_dedup.clean,
        "benchmark": lambda d: decontaminate.clean(d, benchmark), "mix": mixing.take,
    }[name]
    got = clean(wide)
    assert rows_of(got) == rows_of(clean(plain))
    own = {(key(r[0]), f"x{i}") for i, r in enumerate(rows)}
    kept = [c for c in CLASH if name != "mix" or c not in ("copies", "taken")]
    for r in got.collect():
        assert len({r[c] for c in kept}) == 1 and (key(r.doc_id), r["_row"]) in own


def test_pairs_come_through_the_minima(spark, monkeypatch):
    """Without minima nothing is found; with them the counted pairs are the candidates, not all that share a shingle."""
    item = " ".join(f"w{i}" for i in range(30))
    texts = [item, "a " + item + " b", " ".join(f"w{i}" for i in range(25)) + " z " * 9, "w3 w4 w5 w6 w7 only these", "other words altogether here now"]
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)], DOCUMENTS)
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    items = decontaminate.index(benchmark.withColumnRenamed("item_id", "_item"), key="_item")
    assert items.filter("minimum").count() < items.count()
    assert {r.doc_id for r in decontaminate.contained_items(docs, benchmark).collect()} == {0, 1, 2}
    counted = []
    search = decontaminate.candidates
    monkeypatch.setattr(decontaminate, "candidates", lambda *a: counted.append(search(*a)) or counted[-1])
    decontaminate.contained_items(docs, benchmark).collect()
    share = {d for d, t in enumerate(texts) if shingles(t) & shingles(item)}
    assert {r._d.id for r in counted[0].collect()} <= share == {0, 1, 2, 3}
    monkeypatch.setattr(decontaminate, "candidates", lambda hits, items, few: search(hits, items.withColumn("minimum", decontaminate.F.lit(False)), few))
    assert decontaminate.contained_items(docs, benchmark).count() == 0
