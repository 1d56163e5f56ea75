"""Byte-level BPE as a monoid tree: halves are encoded alone, neighbours joined by re-encoding what their seam can change.

A node holds the pieces of its text (matches of the pattern, or runs of them) and their token ids. Two nodes are joined by taking a window of pieces on
either side of the seam and encoding its text anew; the window doubles until both its edges are proven. An edge is proven
where a character other than white space is followed by white space: no alternative of the pattern has both in this order,
so every split of any text around it has a match end there, and the pattern looks back at nothing. Tokens outside then
stay as they are, so joining is associative and the result does not depend on where texts are halved. Decoding joins the
bytes of halves.

Ranks are read from a file whose path is a parameter and sent to the tasks once (``MOST_BYTES`` at most).
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageloom.llm import words as W
from pageloom.llm.frames import without

LEAF = 4096
WINDOW = 8
#: Matches whose ids a worker remembers, twice over: some 250 bytes each, which the worker keeps for whatever it runs next.
REMEMBERED = 100_000
MOST_BYTES = 64 << 20
_NONE = 1 << 60
#: A space after white space, where a cut is no proven edge. What counts as white space here is what ``isspace`` says.
_AFTER_SPACE = re.compile(r" (?<=\s )").search


@dataclass
class Bpe:
    """Merge ranks and the split pattern, with the ids of matches seen lately."""

    ranks: dict[bytes, int]
    pattern: str
    known: dict[str, bytes] = field(default_factory=dict)
    old: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.matches = regex.compile(self.pattern).findall
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Rank of the token that two tokens, by their ranks, make together. Workers that only decode do without."""
        get = self.ranks.get
        return {
            a << 32 | b: r
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None
        }

    def code(self, match: str) -> bytes:
        """Ids of one match of the pattern, packed as 32-bit integers."""
        raw = match.encode()
        ids = [self.ranks[raw]] if raw in self.ranks else (self._short if len(raw) < 200 else self._long)(raw)
        return np.array(ids, np.int32).tobytes()

    def _recall(self, text: str, ids: Callable[[str], bytes]) -> bytes:
        out = self.known.get(text) or self.old.get(text) or ids(text)
        self.known[text] = out
        return out

    def _pieces(self, text: str) -> bytes:
        return b"".join(self._recall(m, self.code) for m in self.matches(text))

    def codes(self, parts: list[str], whole: bool) -> list[bytes]:
        """Packed ids of all parts: matches of the pattern, or pieces (``whole``) each of which but the last must end in a
        proven edge. When too many are remembered, those not asked for lately are dropped."""
        if len(self.known) + len(parts) > REMEMBERED:
            self.old, self.known = self.known, {}
        out = list(map(self.known.get, parts))
        if None in out:
            for i, code in enumerate(out):
                if code is None:
                    # The last piece may still change at the seam, but alone its ids are what they are.
                    out[i] = self._recall(parts[i], self._pieces if whole else self.code) if not parts[i][-1].isspace() else self._pieces(parts[i])
        return out

    def _short(self, raw: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until no pair has a rank."""
        get = self.pairs.get
        parts = list(map(self.bytes.__getitem__, raw))
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i] = least
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(least << 32 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | least, _NONE)
        return parts

    def _long(self, raw: bytes) -> list[int]:
        """The same by a heap, for matches of any length."""
        n = len(raw)
        end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue
            alive[j], end[i], after[i] = False, to, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    stop = end[after[a]]
                    if (r := self.ranks.get(raw[a:stop])) is not None:
                        heapq.heappush(heap, (r, a, stop))
        return [self.ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def leaf(self, text: str) -> Node:
        """Cut before single spaces where each cut is a proven edge, else into matches. The text alone decides which, not what
        is remembered."""
        if text and "\0" not in text and not _AFTER_SPACE(text):
            pieces = text.replace(" ", "\0 ").split("\0")
            pieces = pieces if pieces[0] else pieces[1:]
            return Node(pieces, self.codes(pieces, True))
        matches = self.matches(text)
        return Node(matches, self.codes(matches, False))

    def join(self, left: Node, right: Node) -> Node:
        """The node of both texts, one after the other."""
        if not left.matches or not right.matches:
            return left if left.matches else right
        size = WINDOW
        while True:
            a, b = max(len(left.matches) - size, 0), min(size, len(right.matches))
            if (a == 0 or _proven(left.matches, a)) and (b == len(right.matches) or _proven(right.matches, b)):
                break
            size *= 2
        seam = self.leaf("".join(left.matches[a:]) + "".join(right.matches[:b]))
        return Node(left.matches[:a] + seam.matches + right.matches[b:], left.codes[:a] + seam.codes + right.codes[b:])

    def node(self, text: str) -> Node:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.node(text[:half]), self.node(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.node(text).codes), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@dataclass
class Node:
    """Matches of the pattern in a text, and the packed ids of each."""

    matches: list[str]
    codes: list[bytes]


def _proven(matches: list[str], at: int) -> bool:
    """Whether a match of every text around must end before match ``at``."""
    return matches[at][0].isspace() and not matches[at - 1][-1].isspace()


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    if Path(path).stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes, too large to be sent to every task")
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, Path(path).read_bytes().splitlines()) if t}


_LOADED: dict[str, Bpe] = {}


def _loaded(ranks, key: str, pattern: str) -> Bpe:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(ranks.value, pattern)
    return _LOADED[key]


def _each(make: Callable[[Bpe, pa.RecordBatch], pa.Array], ranks, pattern: str, column: str, limit_on: str, schema: pa.Schema) -> Callable:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks, key, pattern)
        for piece in W.pieces(batches, limit_on) if limit_on else _rows(batches):
            out = {n: piece.column(i) for i, n in enumerate(piece.schema.names)} | {column: make(bpe, piece)}
            yield pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def _rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _ids(bpe: Bpe, piece: pa.RecordBatch) -> pa.Array:
    got = [bpe.encode(t) if t else np.zeros(0, np.int32) for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(g) for g in got])], pa.int32()), pa.array(np.concatenate(got)))


def _bytes(bpe: Bpe, piece: pa.RecordBatch) -> pa.Array:
    ids = piece.column(piece.schema.get_field_index("ids"))
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    flat, offsets = ids.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)].tolist()
    return pa.array([bpe.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``docs`` with ``ids``, the token ids of ``text`` by the ranks of a file.

    A null or empty text has no ids. Every row is encoded alone. An input column ``ids`` is replaced.
    """
    return _mapped(docs, _ids, path, pattern, "ids", "array<int>", "text")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``rows`` with ``decoded``, the bytes of ``ids``; null ids give no bytes. ``decoded`` is replaced."""
    return _mapped(rows, _bytes, path, pattern, "decoded", "binary", "")


def _mapped(rows: DataFrame, make: Callable, path: str, pattern: str, column: str, kind: str, limit_on: str) -> DataFrame:
    rows = without(rows, column)
    result = StructType([*rows.schema.fields, *StructType.fromDDL(f"{column} {kind}").fields])
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    return rows.mapInArrow(_each(make, ranks, pattern, column, limit_on, to_arrow_schema(result)), result)
