"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (A-Z lower-cased, letters, digits and all characters beyond ASCII) build one automaton per shard of at
most ``SHARD_WORDS`` words. The words of a document stream through it and it tracks the longest match that ends at each
word; a match of 13 words or more is a hit of those words, as is a match of a whole shorter item. Runs of words
in which no two neighbours are neighbours in any item cannot hold a match, so they never reach the automaton; that leaves
the result as it is and most words to numpy.

Documents are only mapped, one pass for each shard, without a shuffle. A shard is broadcast; its words are counted first,
and a larger benchmark makes more shards, not larger ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageloom.llm import words as W
from pageloom.llm.frames import without

WINDOW = 13
SHARD_WORDS = 200_000
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


@dataclass
class Automaton:
    """All runs of words of the items, as states with the longest length, the suffix link and arcs by word number."""

    window: int
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    arcs: list[dict[int, int]] = field(default_factory=lambda: [{}])
    #: Items with a window whose state this is; whole short items that end in this state.
    holders: dict[int, set[str]] = field(default_factory=dict)
    short: dict[int, set[str]] = field(default_factory=dict)
    least: int = 0

    def add(self, word: int, last: int) -> int:
        """Extend by a word after state ``last``; returns the state of the longer run."""
        if word in self.arcs[last]:
            known = self.arcs[last][word]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {})
        while last != -1 and word not in self.arcs[last]:
            self.arcs[last][word] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            known = self.arcs[last][word]
            self.link[new] = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        return new

    def _state(self, length: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.arcs.append(arcs)
        return len(self.length) - 1

    def _split(self, last: int, word: int, known: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.arcs[known]))
        self.link[copy], self.link[known] = self.link[known], copy
        while last != -1 and self.arcs[last].get(word) == known:
            self.arcs[last][word] = copy
            last = self.link[last]
        return copy

    def top(self, state: int) -> int:
        """The state of the last ``window`` words of a match that is at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, run: list[int]) -> Iterator[tuple[int, int, int]]:
        """State and length of the longest match that ends at each word."""
        state = size = 0
        for at, word in enumerate(run):
            while state and word not in self.arcs[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.arcs[state]:
                state, size = self.arcs[state][word], size + 1
            yield at, state, size

    def hits(self, run: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """Word ranges of a run that are windows of items, with those items."""
        for at, state, size in self.walk(run):
            if size >= self.window:
                yield at + 1 - self.window, at + 1, self.holders.get(self.top(state), set())
            while self.short and state > 0:
                if state in self.short and size >= self.length[state]:
                    yield at + 1 - self.length[state], at + 1, self.short[state]
                state = self.link[state]
                size = self.length[state]


def build(items: list[tuple[str, str]], window: int) -> Automaton:
    """The automaton of (id, text) items."""
    w = W.words(pa.array([text for _, text in items], pa.string()), W.LETTERS, lower=True)
    out = Automaton(window)
    out.vocabulary, numbers = np.unique(W.hashes(w), return_inverse=True)
    runs = [numbers[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    out.pairs = np.unique([a * len(out.vocabulary) + b for run in runs for a, b in zip(run, run[1:], strict=False)]).astype(np.int64)
    for run in runs:
        last = 0
        for word in run:
            last = out.add(word, last)
    for (item, _), run in zip(items, runs, strict=True):
        if len(run) >= window:
            for _at, state, size in out.walk(run):
                if size >= window:
                    out.holders.setdefault(out.top(state), set()).add(item)
        elif run:
            *_, (_at, state, _size) = out.walk(run)
            out.short.setdefault(state, set()).add(item)
    out.least = min([len(r) for r in runs if r] + [window])
    return out


def _numbers(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 for those not in it."""
    out = np.full(len(values), -1, np.int64)
    if len(table):
        maybe = np.zeros(1 << 16, bool)
        maybe[(table & table.dtype.type(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(values & values.dtype.type(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
        found = table[place] == values[at]
        out[at[found]] = place[found]
    return out


def candidate_runs(a: Automaton, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the documents, and begin and end of the runs that could hold a window."""
    numbers = _numbers(W.hashes(w), a.vocabulary)
    inside = numbers >= 0
    joined = np.zeros(len(numbers), bool)  # the word goes on from the one before it
    if len(numbers) > 1:
        both = inside[1:] & inside[:-1]
        both[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(numbers))] - 1] = False
        at = np.flatnonzero(both)
        joined[at + 1] = _numbers(numbers[at] * len(a.vocabulary) + numbers[at + 1], a.pairs) >= 0
    begin = np.flatnonzero(inside & ~joined)
    end = np.flatnonzero(inside & ~np.append(joined[1:], False)) + 1
    long = end - begin >= a.least
    return numbers, begin[long], end[long]


_BUILT: dict[str, Automaton] = {}


def _marker(shard, key: str, window: int, schema: pa.Schema) -> Callable:
    """Add the hits of one shard to those that the documents have already."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build(shard.value, window)
        automaton = _BUILT[key]
        for piece in W.pieces(batches):
            w = W.words(piece.column(piece.schema.get_field_index("text")), W.LETTERS, lower=True)
            had = {c: piece.column(piece.schema.get_field_index(c)) for c in ("items", "spans")}
            doc, hit = w.doc(), np.zeros(len(w.start), bool)
            items = {d: set(x) for d, x in enumerate(had["items"].to_pylist()) if x} if had["items"].flatten() else {}
            before = had["spans"].flatten()
            if len(before):
                base = np.repeat(w.first[:-1], pc.list_value_length(had["spans"]).to_numpy())
                for s, e in zip(before.field(0).to_numpy() + base, before.field(1).to_numpy() + base, strict=True):
                    hit[s:e] = True
            numbers, begins, ends = candidate_runs(automaton, w)
            for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                for s, t, of in automaton.hits(numbers[b:e].tolist()):
                    hit[b + s : b + t] = True
                    items.setdefault(int(doc[b]), set()).update(of)
            total = np.r_[0, np.cumsum(hit)]
            same = doc[1:] == doc[:-1]
            starts = np.flatnonzero(hit & ~np.r_[False, hit[:-1] & same][: len(hit)])
            stops = np.flatnonzero(hit & ~np.r_[hit[1:] & same, False][: len(hit)])
            at = w.position().astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(at[starts]), pa.array(at[stops] + 1)], names=["start", "end"])
            out = {c: piece.column(i) for i, c in enumerate(piece.schema.names)}
            out["n_words"], out["n_hit"] = pa.array(w.counts), pa.array(total[w.first[1:]] - total[w.first[:-1]])
            out["items"] = pa.array([sorted(items.get(d, ())) for d in range(piece.num_rows)], pa.list_(pa.string()))
            out["spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, w.first), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([out[c].cast(schema.field(c).type) for c in schema.names], schema=schema)

    return mark


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans`` (word ranges that are hit).

    Null and empty texts have no words, and items without words match nothing. Rows with one item id are one item; a
    null id counts as the id "null". Input columns with the result's names are replaced. Repeated documents are judged
    each on its own.
    """
    spark = docs.sparkSession
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text")).filter("text is not null")
    total = listed.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_words)) if total > shard_words else 1
    rows = without(docs, "n_words", "n_hit", "items", "spans")
    result = StructType([*rows.schema.fields, *StructType.fromDDL(RESULT).fields])
    out = rows.selectExpr("*", *(f"cast({v} as {t}) as {c}" for c, t, v in (
        ("n_words", "long", "0"), ("n_hit", "long", "0"), ("items", "array<string>", "array()"),
        ("spans", "array<struct<start: int, end: int>>", "array()"))))
    for number in range(shards):
        part = listed.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == number).distinct()
        items = spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in part.toLocalIterator()))
        out = out.mapInArrow(_marker(items, uuid.uuid4().hex, window, to_arrow_schema(result)), result)
    return out


def contaminated(share: int = 20) -> str:
    """SQL: hits are at least one word in ``share``."""
    return f"(n_hit > 0 and {share} * n_hit >= n_words)"


def cut_spans(marked: DataFrame, least: int = WINDOW, share: int = 20) -> DataFrame:
    """Documents without those over the coverage limit, their spans of ``least`` hit words or more cut from the text.

    Other documents keep their text as it is.
    """
    kept = marked.filter(f"not {contaminated(share)}")
    schema = kept.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            column = piece.schema.get_field_index("text")
            w = W.words(piece.column(column), W.LETTERS, lower=True)
            text = piece.column(column).to_pylist()
            for d, spans in enumerate(piece.column(piece.schema.get_field_index("spans")).to_pylist()):
                raw = text[d].encode() if text[d] is not None else b""
                for s in reversed([s for s in spans if s["end"] - s["start"] >= least]):
                    a = int(w.start[w.first[d] + s["start"]] - w.offsets[d])
                    b = int(w.end[w.first[d] + s["end"] - 1] - w.offsets[d])
                    raw = raw[:a] + raw[b:]
                    text[d] = raw.decode()
            yield piece.set_column(column, piece.schema.field(column), pa.array(text, pa.string()))

    return kept.mapInArrow(cut, schema)
