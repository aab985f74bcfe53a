"""Quality rules: base rules on document statistics, then gradient-boosted trees.

The trees are trained here on a bounded sample of labelled rows (logistic loss, histogram splits, monotone constraints
on chosen statistics) and flattened into numpy node arrays, so that a whole Arrow batch walks down a tree together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import texts_of

SYMBOLS = b"#*$%&|<>"
#: Statistic -> direction in which it may move the quality (-1: more is never better, 0: free).
FEATURES = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "mark_share": -1,
    "chars_per_word": 0,
    "distinct_share": 0,
    "log_words": 0,
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "n_lines")
#: Bound of the labelled sample the trees see.
SAMPLE_ROWS = 20_000
_SPACE = b" \t\n\v\f\r"


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    m = int(ids.max()) + 1
    if m < 2_000_000:
        key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The statistics of STATS over one whole text."""
    words = text.split()
    solid = text.translate(None, _SPACE)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    raw = np.frombuffer(solid, np.uint8)
    return (
        len(words),
        int(np.count_nonzero((raw & 0xC0) != 0x80)),
        len(text) - len(text.translate(None, SYMBOLS)),
        n_dup,
        repeated_words(ids),
        int(np.count_nonzero((raw >= 65) & (raw <= 90))),
        len(solid) - len(solid.translate(None, b"!?")),
        len(number),
        n_lines,
    )


def document_stats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and statistics of every whole text (null: empty, all zero)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _stat_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=[key, *STATS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(measure, f"`{key}` {kind}, " + ", ".join(f"{s} long" for s in STATS))


def feature_matrix(rows: np.ndarray) -> np.ndarray:
    """STATS rows -> FEATURES columns."""
    n, chars, sym, dup, rep, upper, marks, distinct, lines = (rows[:, i].astype(float) for i in range(len(STATS)))
    n1 = np.maximum(n, 1)
    return np.stack([sym / n1, dup / np.maximum(lines, 1), rep / n1, upper / np.maximum(chars, 1), marks / n1, chars / n1, distinct / n1, np.log1p(n)], 1)


@dataclass
class Trees:
    """Boosted trees as node arrays: one row per tree, nodes in heap order (children of i are 2i+1 and 2i+2)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``: every row steps down one level of a tree at a time."""
        total = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            total += value[node]
        return total


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: float = 5.0) -> Trees:
    """Newton boosting for 0/1 labels. ``monotone``: -1, 0 or 1 per column.

    A split on a constrained column is taken only if its two leaf values stand in the asked order; the middle between
    them then bounds everything below, so the whole tree keeps the order.
    """
    rate_of_ones = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    nodes = 2 ** (depth + 1) - 1
    out = Trees(base, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), depth)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for i in range(2**depth - 1):
            mine = np.flatnonzero(node == i)
            best = (1e-6, None)
            for f, e in enumerate(edges):
                if not len(e) or len(mine) < 2 * least:
                    continue
                b = binned[mine, f]
                gl = np.cumsum(np.bincount(b, g[mine], len(e) + 1))
                hl = np.cumsum(np.bincount(b, h[mine], len(e) + 1))
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))
                gr, hr, nr = gl[-1] - gl, hl[-1] - hl, nl[-1] - nl
                vl, vr = np.clip(gl / (hl + 1), low[i], high[i]), np.clip(gr / (hr + 1), low[i], high[i])
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[-1] ** 2 / (hl[-1] + 1)
                ok = (nl >= least) & (nr >= least) & ((vr - vl) * monotone[f] >= 0)
                gain = np.where(ok, gain, -1)[: len(e)]
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, vl[k], vr[k]))
            left, right = 2 * i + 1, 2 * i + 2
            low[left] = low[right] = low[i]
            high[left] = high[right] = high[i]
            if best[1] is None:
                node[mine] = left
                continue
            f, k, vl, vr = best[1]
            out.feature[t, i], out.cut[t, i] = f, edges[f][k]
            node[mine] = np.where(binned[mine, f] > k, right, left)
            if monotone[f]:
                middle = (vl + vr) / 2
                if monotone[f] > 0:
                    high[left] = low[right] = middle
                else:
                    low[left] = high[right] = middle
        for i in range(2**depth - 1, nodes):
            mine = node == i
            if mine.any():
                value = np.clip(g[mine].sum() / (h[mine].sum() + 1), low[i], high[i])
                out.value[t, i] = rate * float(value)
        margin = margin + out.value[t, node]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> Trees | None:
    """Trees trained on at most ``sample_rows`` labelled documents, chosen by the hash of their key.

    Only the sample's statistics, nine numbers a row, reach the driver. None if there is nothing to learn from (no
    labels, or all alike); documents then stand by the base rules alone. Null labels and keys are left out.
    """
    asked = labels.select(key, F.col(label).cast("int").alias("_y")).dropna().dropDuplicates([key])
    asked = asked.orderBy(F.xxhash64(key), key).limit(sample_rows)
    chosen = docs.select(key, text).join(F.broadcast(asked), key)
    rows = document_stats(chosen.drop("_y"), text, key).dropDuplicates([key]).join(F.broadcast(asked), key)
    got = rows.select(*STATS, "_y", key).toPandas().sort_values([key, *STATS])
    y = got["_y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return train(feature_matrix(got[list(STATS)].to_numpy()), y, list(FEATURES.values()))


def verdicts(rows: np.ndarray, model: Trees | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base failures, keeps and log-odds of STATS rows."""
    failed = (rows[:, 0] < 50) | (100 * rows[:, 4] > 50 * rows[:, 0])
    margin = model.margin(feature_matrix(rows)) if model else np.full(len(rows), np.inf)
    return failed, ~failed & (margin >= np.log(least / (1 - least))), margin


def _stat_rows(column: pa.Array) -> np.ndarray:
    return np.array([text_stats(t) for t in texts_of(column)], np.int64).reshape(-1, len(STATS))


def clean(docs: DataFrame, model: Trees | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(_stat_rows(batch.column(text)), model, least)[1]))

    return docs.mapInArrow(keep, docs.schema)


def judge(docs: DataFrame, model: Trees | None, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Statistics, base rules and verdict per document; one row per input row.

    ``kept``: not failed by a base rule (fewer than 50 words, or more than half of the words in repeated windows), and
    the trees give a probability of good quality of at least ``least``. Null and empty texts fail.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _stat_rows(batch.column(1))
            failed, keep, margin = verdicts(rows, model, least)
            score = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(5)), pa.array(failed), pa.array(keep), pa.array(score)], names=[key, *STATS[:5], "base_failed", "kept", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(score, f"`{key}` {kind}, " + ", ".join(f"{s} long" for s in STATS[:5]) + ", base_failed boolean, kept boolean, score double")
