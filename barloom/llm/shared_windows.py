"""Which windows of a document also start in a document with a smaller id - exactly, in bounded tasks.

A window is ``width`` consecutive atoms (bytes, words, lines) of one document. Its seed is the smallest hash of the
``seed``-atom runs in it, so equal windows have equal seeds wherever they stand; consecutive windows with one seed
form a segment. The work goes in blocks of documents (by a hash of the id) and parts of the seeds' space:

1. every block names its distinct seeds to the parts, 8 bytes each;
2. a part answers which seeds more than one document has;
3. a block sends the segments of those seeds, each distinct text once, with the places where it stands;
4. a part compares the windows of its segments (by the operator's own method: ``older``) and answers with intervals;
5. a block joins the intervals with its texts.

A passage that a third of all documents share reaches a part once per block, not once per document, and no step
sees more than a block or a part. The texts are shuffled once (the exchange by block is used three times). Blocks and
parts are as many as ``spread`` says; both grow with the square root of the input once messages would get too small.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import U, distinct, mix64, offsets_of, ragged, span_hashes
from barloom.llm.common import ids_of, texts_of

BLOCK_BYTES = 4 << 20
#: Least bytes of text behind one message from a block to a part.
MESSAGE_TEXT = 16 << 10
#: Stands for a null id: larger than all others, so such a document is no source for another.
NO_ID = np.iinfo(np.int64).max
STEP = 1 << 20


@dataclass(frozen=True)
class Scheme:
    width: int
    seed: int
    #: texts -> all atoms, and where each text's begin (one more entry than texts); rows of atoms beyond the texts' own
    #: may follow, then with the text of each row as a third array
    atoms: Callable[[list[bytes]], tuple[np.ndarray, ...]]
    #: (atoms of the segments, their offsets, their smallest ids) -> for every window whether a smaller id has it
    older: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def byte_atoms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), offsets_of(np.array([len(t) for t in texts], np.int64))


def spread(total_bytes: int) -> int:
    """Number of blocks and of parts."""
    return max(1, min(math.ceil(total_bytes / BLOCK_BYTES), math.isqrt(total_bytes // MESSAGE_TEXT) + 1))


def seed_hashes(atoms: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m atoms from each place on."""
    n = len(atoms) - m + 1
    if atoms.dtype == np.uint8 and m == 16:
        padded = np.concatenate([atoms, np.zeros(16, np.uint8)])
        whole = np.empty(len(atoms) + 8, U)
        for k in range(8):
            some = np.frombuffer(padded, U, (len(padded) - k) // 8, k)
            whole[k::8] = some[: len(whole[k::8])]
        return mix64(whole[:n] * U(0x9E3779B97F4A7C15) ^ whole[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F))
    h = np.zeros(n, U)
    for k in range(m):
        h = h * U(0x9E3779B97F4A7C15) + atoms[k : k + n].astype(U)
    return mix64(h)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive hashes."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def segments(atoms: np.ndarray, offsets: np.ndarray, width: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and seed of every segment; a segment has ``width`` windows at most."""
    found = []
    for a in range(0, max(len(atoms) - width + 1, 0), STEP):
        part = atoms[a : a + STEP + width - 1]
        n = len(part) - width + 1
        ok = np.ones(n, bool)
        lo, hi = np.searchsorted(offsets, [a + 1, a + n + width - 1])
        for e in offsets[lo:hi] - a:  # windows that would cross the end of a document
            ok[max(e - width + 1, 0) : e] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        seeds = window_minima(seed_hashes(part, m), width - m + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (seeds[1:] != seeds[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start, seed = at[first] + a, seeds[first]
        if count.max() > width:
            pieces = -(-count // width)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, seed = np.repeat(start, pieces) + k * width, np.repeat(seed, pieces)
            count = np.minimum(np.repeat(count, pieces) - k * width, width)
        found.append((start, count, seed * U(0x9E3779B97F4A7C15)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def part_of(seeds: np.ndarray, n: int) -> np.ndarray:
    """Parts are ranges of the (spread) seeds."""
    return ((seeds >> U(32)) * U(n) >> U(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


class Block:
    """A block's documents in a fixed order, and its segments."""

    def __init__(self, rows: pa.Table, scheme: Scheme):
        ids = ids_of(rows.column("_id"), NO_ID)
        texts = texts_of(rows.column("_text"))
        order = np.argsort(ids, kind="stable")
        if len(ids) and (np.diff(ids[order]) == 0).any():  # rows alike in id and text are interchangeable
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
        self.order, self.ids, self.texts = order, ids[order], [texts[i] for i in order]
        self.scheme = scheme

    def cut(self) -> None:
        s = self.scheme
        self.atoms, self.offsets, *owner = s.atoms(self.texts)
        self.start, self.count, self.seed = segments(self.atoms, self.offsets, s.width, s.seed)
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.row_ids = self.ids[owner[0]] if owner else self.ids
        self.seeds, self.seed_at = np.unique(self.seed, return_inverse=True)

    def bounds(self, n: int) -> np.ndarray:
        return np.searchsorted(part_of(self.seeds, n), np.arange(n + 1))


def _name_seeds(n: int, scheme: Scheme):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = Block(rows, scheme)
        b.cut()
        low, high = np.full(len(b.seeds), NO_ID), np.full(len(b.seeds), np.iinfo(np.int64).min)
        np.minimum.at(low, b.seed_at, b.row_ids[b.row])
        np.maximum.at(high, b.seed_at, b.row_ids[b.row])
        several, edge = low != high, b.bounds(n)
        out = {"part": [], "block": [], "seeds": [], "several": []}
        for p in np.flatnonzero(np.diff(edge)):
            x, y = edge[p], edge[p + 1]
            out["part"].append(int(p))
            out["block"].append(key[0].as_py())
            out["seeds"].append(b.seeds[x:y].tobytes())
            out["several"].append(np.packbits(several[x:y]).tobytes())
        return pa.table(out, schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), ("seeds", pa.binary()), ("several", pa.binary())]))

    return run


def _shared_seeds(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    blocks = rows.column("block").to_pylist()
    seeds = [np.frombuffer(s.as_py(), U) for s in rows.column("seeds")]
    marks = [np.unpackbits(np.frombuffer(s.as_py(), np.uint8), count=len(x)).astype(bool) for s, x in zip(rows.column("several"), seeds, strict=True)]
    every, edge = np.concatenate(seeds), offsets_of(np.array([len(s) for s in seeds]))
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    shared = np.concatenate(marks)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    out = {"block": [], "part": [], "bits": []}
    for i, block in enumerate(blocks):
        bits = shared[edge[i] : edge[i + 1]]
        if bits.any():
            out["block"].append(block)
            out["part"].append(key[0].as_py())
            out["bits"].append(np.packbits(bits).tobytes())
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())]))


def _send_segments(n: int, scheme: Scheme):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"part": [], "block": [], "blob": []}
        schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])
        if not answers.num_rows or not rows.num_rows:
            return pa.table(out, schema=schema)
        b = Block(rows, scheme)
        b.cut()
        edge, shared = b.bounds(n), np.zeros(len(b.seeds), bool)
        for p, bits in zip(answers.column("part").to_pylist(), answers.column("bits"), strict=True):
            x, y = edge[p], edge[p + 1]
            shared[x:y] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=y - x)
        mine = np.flatnonzero(shared[b.seed_at])
        mine = mine[np.argsort(b.seed_at[mine], kind="stable")]  # by part, then by place
        part = part_of(b.seed[mine], n)
        cuts = np.searchsorted(part, np.arange(n + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            i = mine[cuts[p] : cuts[p + 1]]
            length = b.count[i] + scheme.width - 1
            text = ragged(b.atoms, b.start[i], length)
            one, of = classes(text, length)
            place = b.start[i] - b.offsets[b.row[i]]
            kept = ragged(text, offsets_of(length)[:-1][one], length[one])
            out["part"].append(int(p))
            out["block"].append(key[0].as_py())
            out["blob"].append(pack(kept, length[one].astype(np.uint32), of.astype(np.uint32), b.row_ids[b.row[i]], b.row[i].astype(np.uint32), place))
        return pa.table(out, schema=schema)

    return run


def classes(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal segments by 128-bit hashes: one of each class, and each segment's class."""
    edge = offsets_of(lengths)
    return distinct([span_hashes(text, edge[:-1], edge[1:], salt) for salt in (1, 2)])


def _compare(scheme: Scheme):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in rows.column("blob")]
        texts, lengths = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
        one, of = classes(texts, lengths)
        first = offsets_of(lengths)[:-1]
        base = offsets_of(np.array([len(g[1]) for g in got]))
        seg = of[np.concatenate([g[2].astype(np.int64) + base[i] for i, g in enumerate(got)])]
        ids, place = np.concatenate([g[3] for g in got]), np.concatenate([g[5] for g in got])
        row = np.concatenate([g[4] for g in got])
        source = np.repeat(np.arange(len(got)), [len(g[2]) for g in got])
        smallest = np.full(len(one), NO_ID)
        np.minimum.at(smallest, seg, ids)
        length = lengths[one]
        kept = ragged(texts, first[one], length)
        del texts
        flags = scheme.older(kept, offsets_of(length), smallest)
        # intervals of removed atoms within each segment, for its first document; later ones lose all of it
        count = length - scheme.width + 1
        owner = np.repeat(np.arange(len(one)), count)
        at = np.arange(len(flags)) - np.repeat(np.cumsum(count) - count, count)
        on = np.flatnonzero(flags)
        new, last = np.ones(len(on), bool), np.ones(len(on), bool)
        new[1:] = (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])
        last[:-1] = new[1:]
        run_seg, run_a, run_b = owner[on[new]], at[on[new]], at[on[last]] + scheme.width
        run_edge = np.searchsorted(run_seg, np.arange(len(one) + 1))
        later = np.flatnonzero(ids > smallest[seg])
        firsts = np.flatnonzero(ids == smallest[seg])
        n_runs = np.diff(run_edge)[seg[firsts]]
        which = np.repeat(firsts, n_runs)
        k = np.repeat(run_edge[seg[firsts]], n_runs) + np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        occ = np.concatenate([later, which])
        a = np.concatenate([place[later], place[which] + run_a[k]])
        z = np.concatenate([place[later] + length[seg[later]], place[which] + run_b[k]])
        out = {"block": [], "blob": []}
        blocks = rows.column("block").to_pylist()
        order = np.argsort(source[occ], kind="stable")
        cuts = np.searchsorted(source[occ][order], np.arange(len(got) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            j = order[cuts[i] : cuts[i + 1]]
            out["block"].append(blocks[i])
            out["blob"].append(pack(*merged(row[occ[j]].astype(np.int64), a[j], z[j])))
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("blob", pa.binary())]))

    return run


def merged(row: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per row, in order; touching ones are joined."""
    if not len(row):
        return row, a, z
    order = np.lexsort((a, row))
    row, a, z = row[order], a[order], z[order]
    reach = np.maximum.accumulate((row << 40) + z)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] << 40) + a[1:] > reach[:-1]
    ends = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], a[new], reach[ends] - (row[ends] << 40)


def blocked(docs: DataFrame, text: str, key: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """_block, _id, _text, ``carry`` and the number of blocks, from one pass over the texts' sizes."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = spread(int(total))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("_block"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), *carry)
    return rows, n


def remove_shared(docs: DataFrame, scheme: Scheme, finish: Callable[[Block, np.ndarray, np.ndarray, np.ndarray], pa.Table], fields: str, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Run the five steps; ``finish`` makes a block's result rows of its documents and (row, start, end) in atoms.

    ``carry``: columns that come out beside the result as they went in.
    """
    rows, n = blocked(docs, text, key, carry)
    fields = ", ".join([fields, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    by_block = rows.groupBy("_block")
    seeds = by_block.applyInArrow(_name_seeds(n, scheme), "part long, block long, seeds binary, several binary")
    shared = seeds.groupBy("part").applyInArrow(_shared_seeds, "block long, part long, bits binary")
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_segments(n, scheme), "part long, block long, blob binary")
    found = sent.groupBy("part").applyInArrow(_compare(scheme), "block long, blob binary")

    def end(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in answers.column("blob")]
        none = np.zeros(0, np.int64)
        row, a, z = merged(*(np.concatenate([g[i] for g in got] or [none]) for i in range(3)))
        block = Block(rows, scheme)
        out = finish(block, row, a, z)
        for c in carry:
            out = out.append_column(c, rows.column(c).take(pa.array(block.order)))
        return out

    return by_block.cogroup(found.groupBy("block")).applyInArrow(end, fields)


def spans_of_rows(n: int, row: np.ndarray, a: np.ndarray, z: np.ndarray) -> Iterator[np.ndarray]:
    """For each of n documents its (start, end) pairs."""
    pairs, edge = np.stack([a, z], 1), np.searchsorted(row, np.arange(n + 1))
    for i in range(n):
        yield pairs[edge[i] : edge[i + 1]]
