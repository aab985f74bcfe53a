"""Line deduplication: runs of lines that stand in an earlier document, or earlier in the same one, are deleted.

Winnowing over line hashes: of every run of RUN lines, the pair of lines with the smallest hash is its fingerprint, so
a repeated run of RUN lines or more always shares fingerprints with its first occurrence. Fingerprints' positions are
joined, matches are extended line by line to both sides, and all but the first occurrence of a run go.
Where a least number of words is given, runs of one or two lines with that many are fingerprints of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import U, distinct, mix64, offsets_of, ragged_index, span_hashes
from barloom.llm.phrase_dedup import window_keys
from barloom.llm.shared_windows import NO_ID, Block, Scheme, remove_shared, seed_hashes, spans_of_rows

#: Lines of the shortest run that is deleted, and of a fingerprint.
RUN, PAIR = 3, 2
#: Words from which on a run of fewer lines goes as well, where the whole passage rule is asked for.
WORDS = 13
_SPACE = b" \t\v\f\r"


def solid_lines(text: bytes) -> list[int]:
    """Numbers of the lines that have a word; blank lines are passed over and stay."""
    return [i for i, line in enumerate(text.split(b"\n")) if line.strip(_SPACE)]


def line_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that have a word, and where each text's begin."""
    lines = [[x for x in t.split(b"\n") if x.strip(_SPACE)] for t in texts]
    flat = [x for some in lines for x in some]
    edge = offsets_of(np.array([len(x) for x in flat], np.int64))
    buffer = np.frombuffer(b"".join(flat), np.uint8)
    return span_hashes(buffer, edge[:-1], edge[1:]), offsets_of(np.array([len(x) for x in lines], np.int64))


def older_windows(atoms: np.ndarray, offsets: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For every run of RUN lines of the segments whether a segment of a smaller id has it."""
    count = np.diff(offsets) - RUN + 1
    start = ragged_index(offsets[:-1], count)
    pairs = seed_hashes(atoms, PAIR)
    # the fingerprint of a run and its place in it: the smallest pair, the first of equals
    reach = np.stack([pairs[start + k] for k in range(RUN - PAIR + 1)])
    place = np.argmin(reach, 0)
    group = distinct([reach.min(0), place])[1]  # positions that share a fingerprint at the same place of the run
    for k in range(1, RUN - PAIR + 1):  # one line further to the right, then to the left, where the run goes on
        right, left = place + PAIR - 1 + k, place - k
        for side in (right, left):
            inside = (side >= 0) & (side < RUN)
            line = np.where(inside, atoms[start + np.clip(side, 0, RUN - 1)], 0)
            group = distinct([group, line])[1]
    first, second = atoms[start + place], atoms[start + place + 1]
    group = distinct([group, first, second])[1]  # the lines themselves decide, not the fingerprint
    ids = np.repeat(smallest, count)
    least = np.full(group.max() + 1 if len(group) else 0, NO_ID)
    np.minimum.at(least, group, ids)
    return least[group] < ids


SCHEME = Scheme(RUN, PAIR, line_hashes, older_windows)


def short_runs(text: bytes, words: int) -> list[tuple[int, int]]:
    """(first solid line, lines) of the runs of one or two lines with ``words`` words; two long lines are two runs."""
    n = [len(x.split()) for x in text.split(b"\n")]
    n = [k for k in n if k]
    ones = [(i, 1) for i, k in enumerate(n) if k >= words]
    return ones + [(i, 2) for i, (j, k) in enumerate(zip(n, n[1:], strict=False)) if j + k >= words and min(j, k) < words]


def lines_and_short_runs(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lines, then every short run as a row of RUN atoms made of its lines' hashes; the text of each row."""
    atoms, offsets = line_hashes(texts)
    runs = [short_runs(t, words) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
    at, size = np.array([x for r in runs for x in r], np.int64).reshape(-1, 2).T
    first = offsets[of] + at
    whole = mix64(atoms[first] + U(1))
    two = size == 2
    whole[two] = mix64(whole[two] + mix64(atoms[first[two] + 1] + U(2)))
    rows = np.stack([mix64(whole + U(k + 3)) for k in range(RUN)], 1).ravel()
    edges = offsets[-1] + RUN * np.arange(1, len(of) + 1)
    return np.concatenate([atoms, rows]), np.concatenate([offsets, edges]), np.concatenate([np.arange(len(texts)), of])


def scheme_of(words: int | None) -> Scheme:
    return SCHEME if words is None else Scheme(RUN, PAIR, partial(lines_and_short_runs, words=words), older_windows)


def repeated_inside(atoms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of every run that stands earlier in the same document."""
    count = np.maximum(np.diff(offsets) - RUN + 1, 0)
    start = ragged_index(offsets[:-1], count)
    row = np.repeat(np.arange(len(count)), count)
    if not len(start):
        return row, start
    key = window_keys(atoms, RUN)[start]
    order = np.lexsort((start, key, row))
    again = np.zeros(len(order), bool)
    again[1:] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    at = order[again]
    return row[at], start[at] - offsets[row[at]]


def _finish(b: Block, row: np.ndarray, a: np.ndarray, z: np.ndarray, words: int | None = None) -> pa.Table:
    own_row, own_at = repeated_inside(*line_hashes(b.texts))
    older = set(row[row >= len(b.texts)].tolist())  # short runs, numbered on after the texts
    order = np.argsort(np.concatenate([row, own_row]), kind="stable")
    row, a, z = (np.concatenate(x)[order] for x in ((row, own_row), (a, own_at), (z, own_at + RUN)))
    kept, n, gone, number = [], [], [], len(b.texts)
    for text, pairs in zip(b.texts, spans_of_rows(len(b.texts), row, a, z), strict=True):
        lines = text.split(b"\n")
        solid = solid_lines(text)
        drop = {solid[k] for x, y in pairs.tolist() for k in range(x, y)}
        seen = set()
        for i, size in short_runs(text, words) if words is not None else ():
            run = tuple(lines[k] for k in solid[i : i + size])
            if number in older or run in seen:
                drop.update(solid[i : i + size])
            seen.add(run)
            number += 1
        n.append(len(solid))
        gone.append(len(drop))
        kept.append((b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text).decode())
    ids = pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID)
    return pa.table({"doc_id": ids, "kept": pa.array(kept, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())})


def finish_of(words: int | None) -> Callable[..., pa.Table]:
    return partial(_finish, words=words)


def remove_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """doc_id, kept (text), n_lines (lines with a word) and n_removed of every whole text.

    A line goes if it is in a run of 3 consecutive lines that also starts in a document with a smaller id, or earlier in
    the same document; with ``words`` also if it is in a run of one or two lines with at least that many words which stands
    in a document with a smaller id, or earlier in the same document. Blank lines are no part of runs and stay. Null texts have no lines and are kept as empty; rows
    with one id do not remove each other's lines; a null id counts as larger than all others; no rows give no rows;
    other columns are not read. Lines are compared by 64-bit hashes. One pass over sizes runs when called.
    """
    return remove_shared(docs, scheme_of(words), finish_of(words), "doc_id long, kept string, n_lines long, n_removed long", text, key)


def clean(docs: DataFrame, words: int | None = WORDS) -> DataFrame:
    """The documents with repeated runs of lines deleted, n_chars set anew; those of which no line is left go.

    Runs are of 3 lines or of ``words`` words on, however few lines those are.
    Documents that had no line with a word before stay (null as empty). The other columns travel with their text, so
    rows that share an id keep their own.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    renamed = docs.select("doc_id", "text", *(F.col(c).alias(f"_own_{c}") for c in rest))
    fields = "doc_id long, kept string, n_lines long, n_removed long"
    found = remove_shared(renamed, scheme_of(words), finish_of(words), fields, carry=tuple(f"_own_{c}" for c in rest))
    some = found.filter((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return some.select(*(new.get(c, F.col(f"_own_{c}")).alias(c) for c in docs.columns))
