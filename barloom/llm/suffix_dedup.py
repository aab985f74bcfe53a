"""Exact substring deduplication on bytes by suffix arrays that are built in two stages.

Only suffixes that are smaller than their successors are sorted directly. Every other suffix follows from its
successor: buckets by first byte are scanned in order, and each suffix found puts the one before it into its bucket.
Adjacent common prefixes then show which windows are equal. ``shared_windows`` deals the corpus into such arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import U
from barloom.llm.shared_windows import Block, Scheme, byte_atoms, remove_shared, spans_of_rows

WIDTH = 50


def words_at(text: np.ndarray, more: int) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number (zeros behind the end, ``more`` places beyond it)."""
    n = len(text) + more
    padded = np.concatenate([text, np.zeros(more + 16, np.uint8)])
    out = np.empty(n, ">u8")
    for k in range(8):
        some = np.frombuffer(padded, ">u8", (len(padded) - k) // 8, k)
        out[k::8] = some[: len(out[k::8])]
    return out.astype(U)


def larger_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is larger than its successor; the last one is."""
    n = len(text)
    out = np.ones(n, bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    where = np.full(n, n, np.int64)
    where[differs] = differs
    where = np.minimum.accumulate(where[::-1])[::-1]  # the next place whose byte differs from the one behind it
    known = where < n
    out[known] = text[where[known]] > text[where[known] + 1]
    return out


def sort_direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, eight at a time and only where still tied."""
    if not len(at):
        return at
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    for k in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = words[at[tied] + k]
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied][order]
        key, g = key[order], group[tied]
        step = np.zeros(len(at), np.int64)
        step[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        starts = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(step + starts)
    return at


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of at least their first ``depth`` bytes; ties beyond stay together."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    larger = larger_than_next(text)
    direct = sort_direct(np.flatnonzero(~larger), words, depth + 6)
    edge = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(before: np.ndarray) -> None:
        """Put suffixes, in the order found, behind those already in their buckets."""
        first = text[before]
        order = np.argsort(first, kind="stable")
        cut = np.searchsorted(first[order], np.arange(257))
        for c in np.flatnonzero(np.diff(cut)):
            induced[c].append(before[order[cut[c] : cut[c + 1]]])

    deal(np.array([n - 1]))
    out = []
    for c in range(256):
        found = induced[c]
        scanned = 0
        while scanned < len(found):  # a run of one byte adds to the bucket that is being scanned
            before = found[scanned] - 1
            scanned += 1
            before = before[before >= 0]
            deal(before[larger[before]])
        mine = direct[edge[c] : edge[c + 1]]
        before = mine[mine > 0] - 1
        deal(before[larger[before]])
        out += [*found, mine]
    return np.concatenate(out)


def adjacent_prefixes(words: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``cap`` bytes; 0 for the first."""
    n = len(order)
    out, open_ = np.zeros(n, np.int64), np.arange(1, n)
    for k in range(0, cap, 8):
        differ = words[order[open_] + k] ^ words[order[open_ - 1] + k]
        same = differ == 0
        out[open_[same]] = k + 8
        rest = differ[~same]
        # leading zero bytes of what differs
        lead = sum((rest >> U(8 * b) == 0).astype(np.int64) for b in range(1, 8))
        out[open_[~same]] = k + lead
        open_ = open_[same]
    return np.minimum(out, cap)


def older_windows(text: np.ndarray, offsets: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For every WIDTH-byte window of the segments whether a segment of a smaller id has it."""
    count = np.diff(offsets) - WIDTH + 1
    words = words_at(text, WIDTH + 16)
    order = suffix_array(text, words, WIDTH)
    number = np.full(len(text), -1, np.int64)
    starts = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    number[starts] = np.arange(len(starts))
    order = order[number[order] >= 0]
    ids = np.repeat(smallest, count)[number[order]]
    heads = np.flatnonzero(adjacent_prefixes(words, order, WIDTH) < WIDTH)
    least = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(order))))
    out = np.zeros(len(starts), bool)
    out[number[order]] = least < ids
    return out


SCHEME = Scheme(WIDTH, 16, byte_atoms, older_windows)


def _finish(b: Block, row: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.Table:
    kept, spans = [], []
    for text, pairs in zip(b.texts, spans_of_rows(len(b.texts), row, a, z), strict=True):
        edges = [0, *pairs.ravel().tolist(), len(text)]
        kept.append(b"".join(text[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True)))
        spans.append([{"start": x, "end": y} for x, y in pairs.tolist()])
    ids = pa.array(b.ids, pa.int64(), mask=b.ids == np.iinfo(np.int64).max)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": ids, "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind), "n_bytes": pa.array([len(t) for t in b.texts], pa.int64())})


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, kept (bytes), spans (removed runs, maximal) and n_bytes of every whole text.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id. Null texts are empty; rows with
    one id do not remove each other's bytes; a null id counts as larger than all others; no rows give no rows; other
    columns are not read. Cuts may fall inside a character, so what is kept is bytes. One pass over sizes runs when called.
    """
    return remove_shared(docs, SCHEME, _finish, "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long", text, key)


def removed_length(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
