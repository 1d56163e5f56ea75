"""Quality rules: counts with fixed limits, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE``) and flattened into node arrays, so a batch is scored
by a few array steps per level. Chosen features only lower the score (``FALLING``): more symbols, repeats or repeated lines
never make a text better. Documents are only mapped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageloom.llm import stats
from pageloom.llm import words as W
from pageloom.llm.frames import without
from pageloom.llm.labelled import sample

SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST_LEAF = 60, 3, 48, 0.25, 1.0, 8
FALLING = frozenset({"symbol_share", "dup_line_share", "repeat_share", "loud_share"})


@dataclass
class Trees:
    """Nodes of all trees in arrays; a leaf is its own child. ``roots`` has the first node of each tree."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, falling: list[bool], rounds: int = ROUNDS) -> Trees:
    """Logistic boosting with histogram splits. A split on a falling feature must not raise the value, and the values below
    it stay on their side of the middle."""
    nodes: list[list[float]] = []
    base = np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3)
    start, roots = float(np.log(base / (1 - base))), []
    if len(y) == 0 or y.min() == y.max():
        rounds = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    total = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
        nodes.append([0, 0.0, me, me, value * RATE])
        best = None
        if depth and len(rows) >= 2 * LEAST_LEAF:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, f], v, len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gr, hr, nr = g[rows].sum() - gs, h[rows].sum() - hs, len(rows) - ns
                gain = gs**2 / (hs + RIDGE) + gr**2 / (hr + RIDGE)
                good = (ns >= LEAST_LEAF) & (nr >= LEAST_LEAF)
                if falling[f]:
                    good &= -gs / (hs + RIDGE) >= -gr / (hr + RIDGE)
                gain = np.where(good, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > (best[0] if best else g[rows].sum() ** 2 / (h[rows].sum() + RIDGE) + 1e-6):
                    best = (float(gain[k]), f, k)
        if best:
            _, f, k = best
            side = binned[rows, f] <= k
            bounds = [(low, high), (low, high)]
            if falling[f]:
                a, b = (float(np.clip(-g[r].sum() / (h[r].sum() + RIDGE), low, high)) for r in (rows[side], rows[~side]))
                bounds = [((a + b) / 2, high), (low, (a + b) / 2)]
            nodes[me][:2] = [f, float(edges[f][k])]
            nodes[me][2] = grow(rows[side], g, h, depth - 1, *bounds[0])
            nodes[me][3] = grow(rows[~side], g, h, depth - 1, *bounds[1])
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH, -np.inf, np.inf))
        total += _added(roots[-1], nodes, x)
    return _flat(start, roots, nodes)


def _flat(start: float, roots: list[int], nodes: list[list[float]]) -> Trees:
    table = np.array(nodes or [[0, 0.0, 0, 0, 0.0]])
    return Trees(start, np.array(roots, np.int64), *(table[:, i].astype(t) for i, t in enumerate((np.int64, np.float64, np.int64, np.int64, np.float64))))


def _added(root: int, nodes: list[list[float]], x: np.ndarray) -> np.ndarray:
    one = _flat(0.0, [root], nodes)
    p = one.score(x)
    return np.log(p / (1 - p))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in W.pieces(batches):
        w = W.words(piece.column(piece.schema.get_field_index("text")))
        x = stats.features(w, stats.counts(w, W.hashes(w)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("label")), flat], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, learn: str = "true") -> Trees:
    """Trees fitted on at most ``rows`` labelled documents. Without labels of both kinds the score is constant."""
    got = sample(docs, labels, label, rows, learn).mapInArrow(_describe, "label int, x array<float>").toArrow()
    y = got["label"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), np.float32).reshape(len(y), len(stats.FEATURES))
    order = np.lexsort((*x.T[::-1], y))  # the same trees whatever the order of the rows
    return fit(x[order].astype(np.float64), y[order], [f in FALLING for f in stats.FEATURES])


def _judge(trees: Trees, least_words: int, repeat_percent: int, threshold: float, schema: pa.Schema) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.words(piece.column(piece.schema.get_field_index("text")))
            c = stats.counts(w, W.hashes(w))
            score = trees.score(stats.features(w, c).astype(np.float64))
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > repeat_percent * c["n_words"])
            out = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
            out |= {n: pa.array(c[n]) for n in stats.COUNTS}
            out |= {"base_failed": pa.array(failed), "rule_score": pa.array(score), "kept": pa.array(~failed & (score >= threshold))}
            yield pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return judge


def quality_rules(docs: DataFrame, trees: Trees, least_words: int = 10, repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` with the counts of ``stats.COUNTS``, ``base_failed``, ``rule_score`` and ``kept``.

    A null or empty text has no words, so it fails the base rules. Every row is judged alone; repeated rows get the same
    result. Input columns with those names are replaced.
    """
    more = StructType.fromDDL(", ".join(f"{c} long" for c in stats.COUNTS) + ", base_failed boolean, rule_score double, kept boolean")
    rows = without(docs, *more.names)
    result = StructType([*rows.schema.fields, *more.fields])
    return rows.mapInArrow(_judge(trees, least_words, repeat_percent, threshold, to_arrow_schema(result)), result)
