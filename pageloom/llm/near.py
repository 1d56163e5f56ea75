"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, star components.

1. Every text becomes the set of its 5-word shingles (64-bit hashes), a fingerprint of the set, and 336 minima of the
   universal functions ``a * x + b``, kept as band keys (56 of 6 minima for a similarity of 0.75) and as one mixed byte of each
   minimum (the signature), so that minima which differ agree by chance once in 256, however long the texts are.
2. Documents with equal sets are one class; only its smallest document goes on. A third of all rows may be one class.
3. In a bucket (documents with a band key) everybody is compared with the smallest member, so a bucket gives as many pairs
   as it has members. Pairs whose signatures agree too little go; the rest is confirmed on the full sets.
4. Alternating large-star and small-star steps find the components of these links.
5. What shares a bucket but not yet a component is compared too. So no link between documents that share a bucket is
   lost, and a large group of near copies never makes all its pairs. At similarity 0.75 two documents share no bucket with
   a probability of 0.00002.

Joins that spread a group's value over its members read that value from a written table, so Spark can split hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import words as W
from pageloom.llm.frames import written

SHINGLE = 5
FUNCTIONS = 336
#: Largest chance that two sets at the limit share no band, and by how many standard deviations their minima may agree less often
#: than on average (a chance of 0.000003): at 0.75 in 216 of 336.
MISSED, DEVIATIONS = 0.00002, 4.53
#: Members of a bucket up to which pairs are joined; larger buckets are compared by chunks of this many members.
FEW, CHUNK = 24, 1024
PERCENT = 75

_RNG = np.random.default_rng(7_5)
_A = _RNG.integers(0, 2**32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)
_SALT = W.mix(_RNG.integers(0, 2**63, FUNCTIONS, dtype=np.uint64))
_SPREAD = np.uint32(0x9E3779B1)
_COLUMNS = 2048
_SKETCH = "doc_id long, n_shingles long, high long, low long, bands array<long>, signature binary"
_SKETCH_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
])


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted by text, and the offsets of the texts.

    A text of fewer than n words has its whole sequence as one shingle; a text without words has none.
    """
    w = W.words(column, lower=True)
    h = W.hashes(w)
    runs, full = W.windows(w, h, n)
    at = np.flatnonzero(full)
    doc, value = w.doc()[at], runs[at]
    counts = w.counts
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        short = h[w.first[d] : w.first[d + 1]]
        doc, value = np.append(doc, d), np.append(value, W.mix(W.rolled(short, len(short)) + np.uint64(len(short))))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])][: len(doc)]
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), _COLUMNS):
        np.minimum(out, (_A[:, None] * x[None, at : at + _COLUMNS] + _B[:, None]).min(axis=1), out=out)
    return out


def band_rows(percent: int) -> int:
    """Minima in a band: as many as leave two sets at the limit a chance of at most ``MISSED`` to share no band."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    fits = [r for r in range(1, FUNCTIONS) if FUNCTIONS % r == 0 and (1 - (percent / 100) ** r) ** (FUNCTIONS // r) <= MISSED]
    return max(fits, default=1)


def least_agreement(percent: int) -> int:
    """Minima in which two sets at the limit agree at least, but for a very small chance."""
    p = percent / 100
    return max(int(FUNCTIONS * p - DEVIATIONS * (FUNCTIONS * p * (1 - p)) ** 0.5), 1)


def _sketcher(percent: int, shingle: int) -> Callable:
    rows = band_rows(percent)
    n = FUNCTIONS // rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            values, offsets = shingle_sets(piece.column(piece.schema.get_field_index("text")), shingle)
            sizes = np.diff(offsets)
            bands, signatures = np.zeros((len(sizes), n), np.uint64), [b""] * len(sizes)
            for d in np.flatnonzero(sizes):
                least = minima(values[offsets[d] : offsets[d + 1]])
                bands[d] = W.mix(_joined(least.reshape(n, rows).astype(np.uint64)) ^ _SALT[:n])
                signatures[d] = (least * _SPREAD >> np.uint32(24)).astype(np.uint8).tobytes()
            # Sums of mixed hashes do not depend on order; two of them tell sets apart.
            sums = [np.r_[np.uint64(0), np.cumsum(W.mix(values ^ np.uint64(c)))] for c in (0x51ED270B, 0x2545F491)]
            high, low = ((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
            held = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays([
                piece.column(piece.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(sizes.astype(np.int64)),
                pa.array(high), pa.array(low), pa.ListArray.from_arrays(held, pa.array(bands.view(np.int64).ravel())),
                pa.array(signatures, pa.binary()),
            ], schema=_SKETCH_ARROW)

    return sketch


def _joined(key: np.ndarray) -> np.ndarray:
    """One hash of every row of minima."""
    out = np.zeros(len(key), np.uint64)
    for column in key.T:
        out = W.mix(out + column)
    return out


def _confirm(percent: int, shingle: int) -> Callable:
    """Keep pairs whose signatures agree often enough and whose full sets are similar enough."""
    least = least_agreement(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(iter([batch]), "a_text"):
                one, two = (np.frombuffer(b"".join(piece.column(i).to_pylist()), np.uint8).reshape(piece.num_rows, -1) for i in (2, 3))
                piece = piece.filter(pa.array((one == two).sum(axis=1) >= least))
                (x, at), (y, to) = (shingle_sets(piece.column(i), shingle) for i in (4, 5))
                good = []
                for d in range(piece.num_rows):
                    one, two = x[at[d] : at[d + 1]], y[to[d] : to[d + 1]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
                yield piece.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return keep


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) that pass the signature and the full comparison. ``texts``: doc, signature, text."""
    a, b = (texts.select(F.col("doc").alias(s), F.col("signature").alias(f"{s}_signature"), F.col("text").alias(f"{s}_text")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_signature", "b_signature", "a_text", "b_text")
    return both.mapInArrow(_confirm(percent, shingle), "a long, b long").distinct()


def _shared(sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, as products of rows of marks, some thousand shared shingles at a time."""
    values, offsets = sets
    distinct, place, seen = np.unique(values, return_inverse=True, return_counts=True)
    row, number = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.cumsum(seen > 1) - 1
    both = seen[place] > 1
    row, column = row[both], number[place[both]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(offsets) - 1,) * 2, np.float32)
    for at in range(0, int((seen > 1).sum()), _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        marks = np.zeros((len(out), _COLUMNS), np.float32)
        marks[row[a:b], column[a:b] - at] = 1
        out += marks @ marks.T
    return out


def _linker(percent: int, shingle: int) -> Callable:
    least = least_agreement(percent)

    def link(table: pa.Table) -> pa.Table:
        """Links within a block between different components: signatures first, then the full sets. A pair is judged in the
        first bucket that its documents share."""
        doc, component, chunk, band = (table[c].to_numpy() for c in ("doc", "component", "chunk", "band"))
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(doc), -1)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
        own, found = table["i"][0].as_py() == table["k"][0].as_py(), []
        for x in range(len(doc)):
            near = np.flatnonzero((component != component[x]) & (doc > doc[x]) & (True if own else chunk != chunk[x]))
            near = near[(signature[near] == signature[x]).sum(axis=1) >= least]
            if len(near):
                near = near[~(bands[near, : band[x]] == bands[x, : band[x]]).any(axis=1)]
                found.append(np.column_stack([np.full(len(near), x), near]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(pairs):
            held, place = np.unique(pairs, return_inverse=True)
            sets = shingle_sets(table["text"].take(pa.array(held)).combine_chunks(), shingle)
            x, y = place.reshape(-1, 2).T
            both, size = _shared(sets)[x, y], np.diff(sets[1])
            pairs = pairs[(both > 0) & (100 * both >= percent * (size[x] + size[y] - both))]
        ends = np.sort(doc[pairs], axis=1).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return link


def _links_in_blocks(mixed: DataFrame, firsts: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links of large buckets: their members are dealt to chunks, and every two chunks of a bucket are compared in one block.
    Only links leave a block."""
    chunks = F.ceil(F.col("n") / CHUNK)
    dealt = mixed.withColumn("chunk", F.pmod(F.xxhash64("doc"), chunks)).withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    blocks = dealt.select("key", F.least("chunk", "j").alias("i"), F.greatest("chunk", "j").alias("k"), "chunk", "doc", "component")
    held = blocks.join(firsts.select("doc", "bands"), "doc").join(texts, "doc")
    held = held.withColumn("band", (F.array_position("bands", F.col("key")) - 1).cast("int"))
    return held.groupBy("key", "i", "k").applyInArrow(_linker(percent, shingle), "a long, b long")


def _told(edges: DataFrame, step: str) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, itself included."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), step)
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Connected components of (a, b) links by alternating large-star and small-star: doc, component (its least member)."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _told(both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u > v").distinct(), "large_star")
        small = _told(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u > v").distinct(), "small_star")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id`` (the smallest linked document).

    A null or empty text has no shingles and is linked with nothing. Rows with one ``doc_id`` are judged each by its own
    text; a null ``doc_id`` is linked with nothing and has no component. Other columns of ``docs`` are not read.
    """
    sets = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketcher(percent, shingle), _SKETCH), "sketches")
    held = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = written(held.groupBy("high", "low").agg(F.min("doc_id").alias("doc")), "classes")
    firsts = held.withColumnRenamed("doc_id", "doc").join(classes.select("doc").distinct(), "doc", "left_semi").select("doc", "bands", "signature")
    firsts = written(firsts, "firsts")
    banded = firsts.select("doc", F.explode("bands").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader"), "buckets")
    members = written(banded.join(buckets, "key"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members.select("doc").distinct(), "doc", "left_semi")
    texts = written(texts.join(firsts.select("doc", "signature"), "doc"), "texts")
    stars = written(members.filter("doc > leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct(), "stars")
    links = written(_linked(stars, texts, percent, shingle), "links")
    found = written(components(links), "components")

    # What shares a bucket but no component yet.
    placed = members.join(found, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x < y")
    mixed = written(placed.join(mixed.select("key", "n"), "key"), "mixed")
    one, two = (mixed.filter(F.col("n") <= FEW).select("key", F.col("doc").alias(s), F.col("component").alias(f"{s}_component")) for s in "ab")
    few = one.join(two, "key").filter("a_component <> b_component and a < b").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    large = _links_in_blocks(mixed.filter(F.col("n") > FEW), firsts, texts, percent, shingle)
    more = written(_linked(few, texts, percent, shingle).union(large).distinct(), "more_links")
    if more.head(1):
        joined = found.select(F.col("component").alias("a"), F.col("doc").alias("b")).union(more)
        found = written(components(joined), "all_components")

    named = classes.join(found, "doc", "left").select("high", "low", F.coalesce("component", "doc").alias("component_id"))
    named = written(named, "named")
    own = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return held.join(named, ["high", "low"]).select("doc_id", "n_shingles", "component_id").union(own)


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The documents without all but the smallest of each component."""
    gone = near_duplicates(docs, percent, shingle).filter("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
