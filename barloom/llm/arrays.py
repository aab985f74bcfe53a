"""Numpy helpers on ragged arrays and hashes, used inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: An odd factor whose powers have inverses modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finisher of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the factor and of its inverse."""
    factor = (FACTOR + 2 * salt * 0x632BE59BD9B4E019) & (2**64 - 1)
    up, down = np.full(n, factor, U), np.full(n, pow(factor, -1, 2**64), U)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(atoms: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of spans of atoms (bytes or longs); spans are in order of their ends and start before PIECE of them.

    Sums of atom values times powers of an odd factor, freed of the span's place by the inverse power. Spans longer
    than PIECE are hashed one by one.
    """
    out = np.empty(len(starts), U)
    up, down = powers(min(PIECE, len(atoms)) + 1, salt)
    values = mix64(np.arange(256, dtype=U) + U(salt + 1)) if atoms.dtype == np.uint8 else None
    a, n = 0, len(starts)
    while a < n:
        base = int(starts[a])
        b = int(np.searchsorted(ends, base + PIECE, "right"))
        if b <= a:  # longer than a piece
            digest = hashlib.blake2b(atoms[base : int(ends[a])].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
            out[a] = int.from_bytes(digest, "little")
            a += 1
            continue
        part = atoms[base : int(ends[b - 1])]
        x = values[part] if values is not None else mix64(part + U(salt + 1))
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(x * up[: len(part)], out=sums[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        a = b
    return out


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices [start, start + length) of ``values`` one after the other."""
    return values[ragged_index(starts, lengths)]


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    solid = np.ones(len(buffer) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = (buffer != 32) & ((buffer < 9) | (buffer > 13))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_spans(buffer)
    begins = offsets_of(np.array([len(t) + 1 for t in texts], np.int64))[:-1]
    firsts = np.append(np.searchsorted(starts, begins), len(starts))
    return span_hashes(buffer, starts, ends), firsts


def distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows alike in all hashes: index of one row of each class, and each row's class."""
    order = np.lexsort(hashes[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of
