"""Exact removal of repeated word sequences by relative Lempel-Ziv parsing.

Each part of ``shared_windows`` indexes its segments as a reference block, in order of their smallest document id.
Every segment is parsed greedily against what has smaller ids: at a word where a 13-word match begins, the match is
followed as far as it goes and becomes a factor; elsewhere one word is passed over. Windows inside a factor are
repeats. Windows that start in a factor and reach beyond it are looked up one by one, since another source may have
them; so no repeat is lost at a factor's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.arrays import U, mix64, ragged_index, word_hashes
from barloom.llm.shared_windows import NO_ID, Block, Scheme, remove_shared, spans_of_rows

WIDTH = 13


def window_keys(atoms: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` atoms from each place on."""
    n = max(len(atoms) - width + 1, 0)
    h = np.zeros(n, U)
    for k in range(width):
        h = mix64(h + atoms[k : k + n])
    return h


class Reference:
    """The windows of a block of segments; ``smallest_first``: the segments in order of their smallest ids."""

    def __init__(self, atoms: np.ndarray, offsets: np.ndarray, width: int):
        self.atoms, self.width = atoms, width
        self.end = np.repeat(offsets[1:], np.diff(offsets))
        count = np.diff(offsets) - width + 1
        self.starts = ragged_index(offsets[:-1], count)
        self.keys = window_keys(atoms, width)
        # the first place of every distinct window
        place = self.starts[np.argsort(self.keys[self.starts], kind="stable")]
        sorted_keys = self.keys[place]
        new = np.ones(len(place), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        self.index, self.first = sorted_keys[new], place[new]

    def lookup(self, at: np.ndarray) -> np.ndarray:
        """The first place where the window at each place stands (its own, if nowhere before)."""
        found = self.first[np.searchsorted(self.index, self.keys[at])]
        for k in range(self.width):  # keys are hashes; the words decide
            found = np.where(self.atoms[found + k] == self.atoms[at + k], found, at)
        return found

    def follow(self, at: np.ndarray, source: np.ndarray) -> np.ndarray:
        """How many words agree from ``at`` and ``source`` on, within their segments."""
        most = np.minimum(self.end[at] - at, self.end[source] - source)
        length, going = np.full(len(at), self.width), np.flatnonzero(most > self.width)
        while len(going):
            k = length[going]
            going = going[self.atoms[at[going] + k] == self.atoms[source[going] + k]]
            length[going] += 1
            going = going[length[going] < most[going]]
        return length


def older_windows(atoms: np.ndarray, offsets: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For every WIDTH-word window of the segments whether a segment of a smaller id has it."""
    length = np.diff(offsets)
    order = np.argsort(smallest, kind="stable")
    moved = ragged_index(offsets[:-1][order], length[order])
    atoms, ids = atoms[moved], smallest[order]
    edge = np.concatenate([[0], np.cumsum(length[order])])
    ref = Reference(atoms, edge, WIDTH)
    id_at = np.repeat(ids, length[order])
    repeat = np.zeros(len(atoms), bool)

    cursor, last = edge[:-1].copy(), edge[1:] - WIDTH
    while len(cursor):
        source = ref.lookup(cursor)
        hit = id_at[source] < id_at[cursor]
        step = np.ones(len(cursor), np.int64)
        at, source = cursor[hit], source[hit]
        if len(at):
            size = ref.follow(at, source)
            inside = size - WIDTH + 1
            repeat[ragged_index(at, inside)] = True
            # at the factor's end: windows that start in it and reach beyond
            beyond = np.minimum(at + size - 1, last[hit]) - (at + inside) + 1
            edge_at = ragged_index(at + inside, np.maximum(beyond, 0))
            repeat[edge_at] |= id_at[ref.lookup(edge_at)] < id_at[edge_at]
            step[hit] = size
        cursor = cursor + step
        more = cursor <= last
        cursor, last = cursor[more], last[more]

    back = np.empty(len(atoms), bool)
    back[moved] = repeat
    return back[ragged_index(offsets[:-1], length - WIDTH + 1)]


SCHEME = Scheme(WIDTH, 4, word_hashes, older_windows)


def _finish(b: Block, row: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.Table:
    kept, n, gone, spans = [], [], [], []
    for text, pairs in zip(b.texts, spans_of_rows(len(b.texts), row, a, z), strict=True):
        words = text.split()
        n.append(len(words))
        pairs = pairs.tolist()
        for x, y in reversed(pairs):
            del words[x:y]
        gone.append(n[-1] - len(words))
        kept.append(b" ".join(words).decode())
        spans.append([{"start": x, "end": y} for x, y in pairs])
    ids = pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": ids, "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, kind), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())})


def remove_phrases(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, kept (words joined by one space), spans (removed runs in words), n_words and n_removed of every text.

    A word goes if 13 consecutive words over it also start in a document with a smaller id. Null texts have no words;
    rows with one id do not remove each other's words; a null id counts as larger than all others; no rows give no
    rows; other columns are not read. Words are compared by 64-bit hashes. One pass over sizes runs when called.
    """
    return remove_shared(docs, SCHEME, _finish, "doc_id long, kept string, spans array<struct<start:long,end:long>>, n_words long, n_removed long", text, key)
