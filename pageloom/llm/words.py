"""Words of Arrow text columns as numpy arrays: byte ranges, documents and 64-bit hashes.

No Python object is made per word. A batch is handled in pieces of about ``PIECE`` bytes of text, so the memory of
a task follows the longest single document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SEGMENT = 1 << 18
NO_WORD = np.uint64(0)

_ALL = np.arange(256)
#: Bytes inside words ``[^\x20\x09-\x0D]+``; bytes of longer characters are never white space.
SPACED = ~np.isin(_ALL, [0x20, 9, 10, 11, 12, 13])
#: Bytes inside words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
LETTERS = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_BYTES = np.random.default_rng(20_24).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some documents. ``first[d]`` is the number of words before document d; it has one entry more."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def position(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(column: pa.Array, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of every text: runs of bytes of ``inside``, after A-Z became a-z where asked."""
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    held = inside[data]
    begin, last = held.copy(), held.copy()
    begin[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    tails = offsets[1:][offsets[1:] > 0] - 1
    begin[heads], last[tails] = held[heads], held[tails]
    start = np.flatnonzero(begin)
    return Words(data, offsets, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    out = np.empty(len(w.start), np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(w.end, w.start[at] + SEGMENT, side="right")))
        base, until = int(w.start[at]), int(w.end[to - 1])
        power, inverse = _power_tables(until - base + 1)
        sums = np.zeros(until - base + 1, np.uint64)
        np.cumsum(_BYTES[w.data[base:until]] * power[: until - base], out=sums[1:])
        starts = w.start[at:to] - base
        out[at:to] = (sums[w.end[at:to] - base] - sums[starts]) * inverse[starts]
        at = to
    return mix(out)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of n values, by doubling; shorter than h by n - 1, empty if h is."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have = h, 1
    for bit in bin(n)[3:]:
        out = out[: len(out) - have] * np.uint64(pow(_STEP, have, 2**64)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[: len(out) - 1] * np.uint64(_STEP) + h[have:]
            have += 1
    return out


def windows(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word window (one for each word, junk where none starts) and which words start one."""
    out = np.zeros(len(h), np.uint64)
    runs = rolled(h, n)
    out[: len(runs)] = mix(runs)
    return out, w.position() + n <= np.repeat(w.counts, w.counts)


def covered(w: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that begins at one of the given words."""
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0
