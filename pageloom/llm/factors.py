"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Score before the logistic function: ``w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]``: the
sum-of-squares identity makes the pairwise terms linear in the features. Inputs are the words' buckets (square root of their
share of the text), the statistics of ``stats.FEATURES`` and the length of the text in characters; nothing else of a row is read.

It is fitted by Adam on a bounded sample of labelled rows (``SAMPLE``). Documents are only mapped.
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

SAMPLE = 8_000
BUCKETS, FACTORS = 1 << 11, 6
EPOCHS, BATCH, RATE, DECAY = 24, 256, 0.02, 1e-4
#: Documents that are laid out as dense rows at once.
ROWS = 128


def inputs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word part (a dense row of bucket weights) and statistics of the texts, some rows at a time."""
    w = W.words(column)
    h = W.hashes(w)
    c = stats.counts(w, h)
    lower = W.words(column, lower=True)
    bucket = (W.hashes(lower) >> np.uint64(64 - 11)).astype(np.int64)
    more = np.column_stack([stats.features(w, c), np.log1p(np.diff(np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)][w.offsets]))])
    for at in range(0, len(w.counts), ROWS):
        to = min(at + ROWS, len(w.counts))
        of = slice(w.first[at], w.first[to])
        row = np.repeat(np.arange(to - at), w.counts[at:to])
        dense = np.bincount(row * BUCKETS + bucket[of], minlength=(to - at) * BUCKETS).reshape(to - at, BUCKETS)
        yield np.sqrt(dense / np.maximum(w.counts[at:to, None], 1)).astype(np.float32), more[at:to].astype(np.float32)


@dataclass
class Machine:
    """Bias, linear weights and factors; statistics are standardised with the sample's mean and spread."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.hstack([words, np.clip((numbers - self.mean) / self.spread, -4, 4) / 2]).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for prepared rows."""
        both = (x @ self.factors) ** 2 - (x**2) @ self.factors**2
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.linear + both.sum(axis=1) / 2, -30, 30).astype(np.float64)))


def fit(words: np.ndarray, numbers: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Adam on the logistic loss. Without rows of both labels the score is the constant share of label 1."""
    rng = np.random.default_rng(3)
    base = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3))
    width = words.shape[1] + numbers.shape[1]
    spread = numbers.std(axis=0) + 1e-6 if len(y) else np.ones(numbers.shape[1])
    out = Machine(
        float(np.log(base / (1 - base))), np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32),
        numbers.mean(axis=0) if len(y) else np.zeros(numbers.shape[1]), spread,
    )
    if len(np.unique(y)) < 2:
        return out
    out.factors = (rng.standard_normal((width, FACTORS)) * 0.05).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1, np.float32), out.linear, out.factors)]
    bias, step = np.array([out.bias], np.float32), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            of = order[at : at + BATCH]
            x = out.rows(words[of].astype(np.float32), numbers[of])
            off = (out.score(x) - y[of]).astype(np.float32) / len(of)
            sums = x @ out.factors
            grads = (off.sum()[None], x.T @ off + DECAY * out.linear, x.T @ (off[:, None] * sums) - out.factors * ((x**2).T @ off)[:, None] + DECAY * out.factors)
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip((bias, out.linear, out.factors), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            out.bias = float(bias[0])
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in W.pieces(batches):
        words, numbers = (np.concatenate(p) for p in zip(*inputs(piece.column(piece.schema.get_field_index("text"))), strict=True))
        # Weights as half floats: the whole sample fits the driver with room to spare.
        packed = [[r.astype(np.float16).tobytes() for r in words], [r.tobytes() for r in numbers]]
        yield pa.RecordBatch.from_arrays(
            [piece.column(piece.schema.get_field_index("label")), *(pa.array(p, pa.binary()) for p in packed)], names=["label", "words", "numbers"]
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, learn: str = "true") -> Machine:
    """A machine fitted on at most ``rows`` labelled documents that ``learn`` (SQL over doc_id) allows."""
    got = sample(docs, labels, label, rows, learn).mapInArrow(_describe, "label int, words binary, numbers binary").toArrow()
    y = got["label"].to_numpy().astype(np.float32)
    words = np.frombuffer(b"".join(got["words"].to_pylist()), np.float16).reshape(len(y), BUCKETS)
    numbers = np.frombuffer(b"".join(got["numbers"].to_pylist()), np.float32).reshape(len(y), len(stats.FEATURES) + 1)
    order = np.lexsort((*numbers.T, y))  # the same machine whatever the order of the rows
    return fit(words[order], numbers[order], y[order])


def _scorer(machine: Machine, name: str, schema: pa.Schema) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            got = [machine.score(machine.rows(*part)) for part in inputs(piece.column(piece.schema.get_field_index("text")))]
            out = {n: piece.column(i) for i, n in enumerate(piece.schema.names)} | {name: pa.array(np.concatenate(got))}
            yield pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return score


def score_quality(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """The columns of ``docs`` with the probability of label 1.

    A null text is scored like an empty one. Every row is scored alone, so repeated rows score alike. An input column of
    that name is replaced.
    """
    rows = without(docs, name)
    result = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} double").fields])
    return rows.mapInArrow(_scorer(machine, name, to_arrow_schema(result)), result)
