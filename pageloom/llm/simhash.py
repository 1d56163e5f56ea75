"""SimHash near-dedup: fingerprints embedded as bit counts of segments, a grid range join, exact verification.

1. A fingerprint has a bit where over half of the text's shingle hashes have it.
2. Equal fingerprints are one class, combined before the shuffle: a third of all rows may have the same one.
3. A half of a fingerprint (32 bits) is embedded as the bit counts of its 16 segments of two bits. Flipping a bit changes
   one count by one, so the Manhattan distance of two embeddings is at most the Hamming distance. Fingerprints that differ in
   at most 4 bits (5 as well) have a half whose embeddings are at most 2 apart, and then there is a grid point at most 1
   from both. So each fingerprint goes to the grid points within 1 of each half, some 50 cells, and near ones meet in one.
4. Within a cell all pairs are verified by their differing bits. Only links leave a task: each fingerprint with the least one
   that it is tied to there, so a dense cell gives as many rows as members. Cells are runs of sorted rows; a run
   longer than ``CELL`` is passed on and compared in blocks of chunks, each bounded.
5. Large-star and small-star steps find the components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import words as W
from pageloom.llm.frames import written
from pageloom.llm.near import components

SHINGLE, SEED = 4, 42
BITS, MOST_BITS = 4, 5
#: Members of a cell up to which one task compares them at once; longer cells are cut into chunks of this many.
CELL = 4096
#: Runs up to this length are compared by shifting; longer ones in slabs of so many rows.
SHORT, SLAB = 24, 256
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
_SEGMENTS = 16
_FINGERPRINTS = "doc_id long, fingerprint long"
_LINKS = "a long, b long, crowded boolean"


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        some = hashes[at : at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of every text; zero for a text without words."""
    from xxhash import xxh64_intdigest

    w = W.words(column, lower=True)
    # The words one space apart, so that a shingle is a slice.
    sizes = w.end - w.start
    begin = np.cumsum(np.r_[0, sizes + 1])[:-1] if len(sizes) else np.zeros(0, np.int64)
    spaced = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    inside = np.repeat(begin - w.start, sizes) + (at := _places(w.start, sizes))
    spaced[inside] = w.data[at]
    joined, end = spaced.tobytes(), begin + sizes
    out = np.zeros(len(w.first) - 1, np.uint64)
    for d in np.flatnonzero(w.counts):
        first, last = int(w.first[d]), int(w.first[d + 1])
        n = max(last - first - shingle + 1, 1)
        starts, ends = begin[first : first + n], end[min(first + shingle, last) - 1 : last]
        hashes = (xxh64_intdigest(joined[x:y], SEED) for x, y in zip(starts.tolist(), ends.tolist(), strict=True))
        out[d] = _fingerprint(np.fromiter(hashes, np.uint64, n))
    return out


def _places(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(start - before, sizes)


def _fingerprinter(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            prints = fingerprints(piece.column(piece.schema.get_field_index("text")), shingle)
            yield pa.RecordBatch.from_arrays(
                [piece.column(piece.schema.get_field_index("doc_id")), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"]
            )

    return run


def segment_counts(half: int, column: str = "fingerprint") -> str:
    """SQL for the bit counts of one half's 2-bit segments, each in the place of its segment."""
    bits = f"(`{column}` & 4294967295L)" if half == 0 else f"shiftrightunsigned(`{column}`, 32)"
    return f"{bits} - (shiftright({bits}, 1) & 1431655765L)"


def grid_cells(half: int, counts: str) -> str:
    """SQL for the cells of one half: its grid point and those one step away; null where a count cannot step."""
    steps = [(s, f"(shiftright(`{counts}`, {2 * s}) & 3L)") for s in range(_SEGMENTS)]
    up = [f"if({count} < 2L, `{counts}` + {1 << 2 * s}L, null)" for s, count in steps]
    down = [f"if({count} > 0L, `{counts}` - {1 << 2 * s}L, null)" for s, count in steps]
    return ", ".join(f"({point}) * 2L + {half}L" for point in [f"`{counts}`", *up, *down])


def merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each member's least tied member) after the ties x[i] - y[i]."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y = x[apart], y[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(label, high, low)
        while not np.array_equal(further := label[label], label):
            label = further
    return label


def ties(key: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of one key: every tied fingerprint with the least of its group, not each pair."""
    distinct, place = np.unique(prints, return_inverse=True)
    label = np.arange(len(distinct))
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    begin, size = edge[:-1], np.diff(edge)
    short = np.repeat(size <= SHORT, size)
    at = np.flatnonzero(short)
    for shift in range(1, SHORT):
        at = at[at + shift < len(key)]
        at = at[key[at + shift] == key[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= bits]
        label = merged(label, place[near], place[near + shift])
    for first, n in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        own, member = prints[first : first + n], place[first : first + n]
        for row in range(0, n, SLAB):
            close = np.bitwise_count(own[row : row + SLAB, None] ^ own[None, row:]) <= bits
            # Members that are tied already need no further link.
            x, y = np.nonzero(close & (label[member[row : row + SLAB]][:, None] != label[member[row:]][None]))
            label = merged(label, member[row + x], member[row + y])
    tied = label != np.arange(len(label))
    return distinct[tied], distinct[label[tied]]


def _comparer(bits: int, cell: int | None) -> Callable:
    """Links of the cells in rows (key, fingerprint) sorted by key. Members of a cell of more than ``cell`` are passed on."""

    def links(key: np.ndarray, prints: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge) if len(key) else np.zeros(0, np.int64)
        crowded = np.repeat(size > cell if cell else np.zeros(len(size), bool), size)
        several = np.repeat(size > 1, size) & ~crowded
        a, b = ties(key[several], prints[several], bits)
        return rows(a, b, False), rows(key[crowded], prints[crowded], True)

    def rows(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        passing = None
        for batch in batches:
            key, prints = (np.concatenate([w, batch.column(c).to_numpy().view(np.uint64)]) for c, w in enumerate(waiting))
            if passing is not None:
                n = int(np.searchsorted(key != passing, True)) if (key != passing).any() else len(key)
                yield rows(key[:n], prints[:n], True)
                key, prints = key[n:], prints[n:]
                passing = passing if not len(key) else None
            if not len(key):
                waiting = [key, prints]
                continue
            # The last run may go on in the next batch.
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if cell and len(key) - last > cell:
                passing, last = key[-1], len(key)
            yield from links(key[:last], prints[:last])
            waiting = [key[last:], prints[last:]]
        yield from links(*waiting)

    return run


def fingerprint_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that have the components of all pairs of distinct fingerprints with at most ``bits`` differing bits."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"the grid finds up to {MOST_BITS} differing bits")
    embedded = prints.select("fingerprint", *(F.expr(segment_counts(h)).alias(f"half{h}") for h in (0, 1)))
    points = F.expr(f"explode(array({grid_cells(0, 'half0')}, {grid_cells(1, 'half1')}))")
    cells = embedded.select("fingerprint", points.alias("key")).filter("key is not null")
    dealt = cells.select("key", "fingerprint").repartition("key").sortWithinPartitions("key", "fingerprint")
    found = written(dealt.mapInArrow(_comparer(bits, CELL), _LINKS), "links")
    # Crowded cells: members are dealt to chunks, and every two chunks of a cell are compared in a block.
    crowded = found.filter("crowded").select(F.col("a").alias("key"), F.col("b").alias("fingerprint"))
    counted = crowded.groupBy("key").agg(F.ceil(F.count("*") / CELL).alias("chunks"))
    chunked = crowded.join(counted, "key").withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    blocks = chunked.select("key", "fingerprint", "chunk", other)
    # Blocks whose hashes are equal are compared together, which finds nothing wrong.
    blocks = blocks.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fingerprint")
    rest = blocks.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_comparer(bits, None), _LINKS)
    return found.filter("not crowded").select("a", "b").union(rest.select("a", "b"))


def simhash_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Words are lower-cased (A-Z) and cut at white space; a text of fewer than ``shingle`` words is one shingle. A text without
    words, or null, has fingerprint zero, which is linked like any other. ``component_id`` is the smallest ``doc_id`` that can be
    reached over fingerprints with at most ``bits`` differing bits. Rows with one ``doc_id`` are judged each by its own text. A null
    ``doc_id`` links others but is no smallest id; a component of such rows alone has a null one. Other columns are not read.
    """
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprinter(shingle), _FINGERPRINTS)
    prints = written(prints, "fingerprints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    found = components(written(fingerprint_links(classes.select("fingerprint"), bits), "all_links"))
    placed = classes.join(found.withColumnRenamed("doc", "fingerprint"), "fingerprint", "left")
    placed = written(placed.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(placed.join(named, "component").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
