"""Removal of repeated bytes, words and lines against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import line_dedup, phrase_dedup, queries, shared_windows, suffix_dedup
from barloom.llm.arrays import offsets_of
from tests.llm.rows import awkward, covered, frame, key


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Many blocks and parts even for small tables."""
    monkeypatch.setattr(shared_windows, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(shared_windows, "MESSAGE_TEXT", 1_000)


def random_segments(rng, width, letters, kind):
    base = [rng.choice(letters) for _ in range(6 * width)]
    out = []
    for _ in range(rng.randint(1, 9)):
        n, at = rng.randint(width, 2 * width - 1), rng.randint(0, 4 * width)
        t = base[at : at + n]
        if rng.random() < 0.4:
            t[rng.randrange(n)] = max(letters) + 1
        if rng.random() < 0.1:
            t = [letters[0]] * n
        out.append(np.array(t, kind))
    return out


@pytest.mark.parametrize("module,width,kind", [(suffix_dedup, 50, np.uint8), (phrase_dedup, 13, np.uint64), (line_dedup, 3, np.uint64)])
def test_engines_find_all_older_windows(module, width, kind):
    rng = random.Random(3)
    for _ in range(120):
        segs = random_segments(rng, width, [97, 98, 99][: rng.randint(2, 3)], kind)
        ids = np.array([rng.randint(0, 4) for _ in segs])
        least = {}
        for s, d in zip(segs, ids, strict=True):
            for i in range(len(s) - width + 1):
                w = s[i : i + width].tobytes()
                least[w] = min(least.get(w, 9), d)
        want = [bool(least[s[i : i + width].tobytes()] < d) for s, d in zip(segs, ids, strict=True) for i in range(len(s) - width + 1)]
        assert module.older_windows(np.concatenate(segs), offsets_of(np.array([len(s) for s in segs])), ids).tolist() == want


def test_suffixes_are_in_order():
    rng = random.Random(5)
    for letters in (b"ab", b"a", b"\x00\xffab"):
        text = bytes(rng.choice(letters) for _ in range(700))
        a = np.frombuffer(text, np.uint8)
        words = suffix_dedup.words_at(a, 66)
        order = suffix_dedup.suffix_array(a, words, 50).tolist()
        assert sorted(order) == list(range(700))
        assert [text[i : i + 50] for i in order] == sorted(text[i : i + 50] for i in range(700))
        lcp = suffix_dedup.adjacent_prefixes(words, np.array(order), 50)
        for x, y, n in zip(order, order[1:], lcp[1:], strict=False):
            shared = next((k for k in range(50) if (text + b"\x00" * 50)[x + k] != (text + b"\x00" * 50)[y + k]), 50)
            assert shared == n


def test_segments_hold_every_window():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 10, 49, 50, 400, 3000)] + [b"a" * 500]
    atoms, offsets = shared_windows.byte_atoms(texts)
    start, count, seed = shared_windows.segments(atoms, offsets, 50, 16)
    places = [s + k for s, c in zip(start, count, strict=True) for k in range(c)]
    assert places == [o + i for o, t in zip(offsets, texts, strict=False) for i in range(max(len(t) - 49, 0))]
    by_window = {}
    for s, c, h in zip(start, count, seed, strict=True):
        for k in range(c):
            assert by_window.setdefault(atoms[s + k : s + k + 50].tobytes(), h) == h


def all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = [(r.doc_id + 100, r.text, r.lang, r.source, r.n_chars, "k", 1, 2, 3) for r in docs.collect()]
    return awkward() + rows


def test_bytes_against_brute_force(spark, sf):
    rows = all_rows(spark, sf)
    got = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", suffix_dedup.removed_length(), F.size("spans"), F.sha2("kept", 256)).collect()
    want = []
    for d, t, gone in covered([(r[0], (r[1] or "").encode()) for r in rows], 50):
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        want.append((key(d), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    assert sorted((key(r[0]), *r[1:]) for r in got) == sorted(want)


def test_words_against_brute_force(spark, sf):
    rows = all_rows(spark, sf)
    got = phrase_dedup.remove_phrases(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256)).collect()
    want = []
    for d, t, gone in covered([(r[0], (r[1] or "").encode().split()) for r in rows], 13):
        want.append((key(d), len(t), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    assert sorted((key(r[0]), *r[1:]) for r in got) == sorted(want)


def brute_lines(rows):
    solid = [(d, [x for x in (t or "").encode().split(b"\n") if x.strip()]) for d, t in rows]
    for (d, t), (_, s, gone) in zip(rows, covered(solid, 3, own=True), strict=True):
        left = iter(gone)
        kept = b"\n".join(x for x in (t or "").encode().split(b"\n") if not (x.strip() and next(left)))
        yield key(d), len(s), sum(gone), kept.decode()


def test_lines_against_brute_force(spark, sf):
    rows = all_rows(spark, sf)
    got = line_dedup.remove_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert sorted((key(r[0]), *r[1:]) for r in got) == sorted(brute_lines([(r[0], r[1]) for r in rows]))


def test_clean_keeps_columns_and_drops_emptied_documents(spark):
    rows = awkward()
    got = line_dedup.clean(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    want = [(d, kept) for d, n, gone, kept in brute_lines([(r[0], r[1]) for r in rows]) if gone < n or n == 0]
    found = got.collect()
    assert sorted((key(r.doc_id), r.text) for r in found) == sorted(want)
    assert all(r.n_chars == len(r.text) and r.kept == "k" for r in found)


def brute_passages(rows, words):
    """Lines in runs of 3 lines, or of fewer lines with ``words`` words, that stand in a smaller id or before in the document."""
    solid = [(key(d), [x for x in (t or "").encode().split(b"\n") if x.strip()]) for d, t in rows]
    runs = lambda s: [(i, n) for n in (1, 2, 3) for i in range(len(s) - n + 1) if n == 3 or sum(len(x.split()) for x in s[i : i + n]) >= words]
    least = {}
    for d, s in solid:
        for i, n in runs(s):
            k = tuple(s[i : i + n])
            least[k] = min(least.get(k, d), d)
    for (_, t), (d, s) in zip(rows, solid, strict=True):
        gone, seen = set(), set()
        for i, n in runs(s):
            k = tuple(s[i : i + n])
            if least[k] < d or k in seen:
                gone.update(range(i, i + n))
            seen.add(k)
        left = iter(range(len(s)))
        yield d, len(s), len(gone), b"\n".join(x for x in (t or "").encode().split(b"\n") if not (x.strip() and next(left) in gone)).decode()


def test_short_runs_of_many_words_go_too(spark, sf):
    line = " ".join(f"w{i}" for i in range(60))
    two = " ".join("abcdefg") + "\n\n" + " ".join("hijklmn")
    texts = [line, "own start\n" + line + "\nown end", line + "\nx\n" + line, "before\n" + two, two + "\nafter", "short\nlines", "short\nlines", line[:30]]
    rows = all_rows(spark, sf) + [(9000 + i, t, "en", "s", len(t), "k", 1, 2, 3) for i, t in enumerate(texts)]
    pairs = [(r[0], r[1]) for r in rows]
    got = line_dedup.remove_lines(frame(spark, rows), words=13).select("doc_id", "n_lines", "n_removed", "kept").collect()
    want = sorted(brute_passages(pairs, 13))
    assert sorted((key(r[0]), *r[1:]) for r in got) == want
    kept = {d: k for d, _, _, k in want}
    assert [kept[9000 + i] for i in range(8)] == [line, "own start\nown end", "x", "before\n" + two, "\nafter", "short\nlines", "short\nlines", line[:30]]
    cleaned = {key(r.doc_id): r.text for r in line_dedup.clean(frame(spark, rows)).collect()}
    assert cleaned[9001] == "own start\nown end" and cleaned[9006] == "short\nlines"


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert phrase_dedup.remove_phrases(none).count() == 0
    assert line_dedup.clean(none).count() == 0


def test_queries_have_their_columns(spark, sf):
    assert queries.op1_suffix_dedup(spark, sf).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert queries.op3_phrase_dedup(spark, sf).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
