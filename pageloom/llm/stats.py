"""Statistics of whole texts, counted from their bytes and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pageloom.llm import words as W

REPEAT = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stop_share",
    "loud_share", "words_per_line", "long_share", "wide_share",
)
_ALL = np.arange(256)
_SYMBOL, _STOP, _LOUD = (np.isin(_ALL, list(s)) for s in (b"#*$%&|<>", b".,;:", b"!?"))
_UPPER, _DIGIT = (_ALL >= 0x41) & (_ALL <= 0x5A), (_ALL >= 0x30) & (_ALL <= 0x39)
_WIDE, _FIRST = _ALL >= 0xC0, (_ALL & 0xC0) != 0x80
_LINE = _ALL != 10
#: Longest word that counts as usual, in bytes.
LONG = 14


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][offsets])


def _repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its value is in its document twice or more, and whether an earlier entry has it."""
    key = W.mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1]][: len(key)]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same
    twice[order] = same | np.r_[same[1:], False][: len(key)]
    return twice, later


def counts(w: W.Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text; ``w`` are its words without changes and ``h`` their hashes."""
    value, full = W.windows(w, h, REPEAT)
    at = np.flatnonzero(full)
    repeat = W.covered(w, at[_repeated(w.doc()[at], value[at])[0]], REPEAT)
    column = pa.Array.from_buffers(
        pa.large_string(), len(w.counts), [None, pa.py_buffer(np.ascontiguousarray(w.offsets)), pa.py_buffer(np.ascontiguousarray(w.data))]
    )
    lines = W.words(column, _LINE)
    inside = np.r_[0, np.cumsum(W.SPACED[w.data])]
    worded = np.flatnonzero(inside[lines.end] > inside[lines.start])
    again = _repeated(lines.doc()[worded], W.hashes(lines)[worded])[1]
    return {
        "n_words": w.counts,
        "word_chars": _per_doc(W.SPACED[w.data] & _FIRST[w.data], w.offsets),
        "n_symbols": _per_doc(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": np.bincount(lines.doc()[worded][again], minlength=len(w.counts)).astype(np.int64),
        "n_repeat_words": np.diff(np.r_[0, np.cumsum(repeat)][w.first]),
        "n_lines": np.bincount(lines.doc()[worded], minlength=len(w.counts)).astype(np.int64),
    }


def features(w: W.Words, c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    share = lambda mask: _per_doc(mask[w.data], w.offsets) / chars
    long = np.diff(np.r_[0, np.cumsum(w.end - w.start > LONG)][w.first])
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words, share(_UPPER), share(_DIGIT), share(_STOP), share(_LOUD), c["n_words"] / np.maximum(c["n_lines"], 1),
        long / words, share(_WIDE),
    ]).astype(np.float32)
