"""LM scoring with a weighted backoff automaton over counts of the whole corpus.

States are the learnt n-grams shorter than the order, arcs the learnt n-grams. An arc of a history h and a word w weighs
``p(w | h) = share * c(h w) / c(h) + (1 - share) * p(w | shorter h)``; where there is no arc, the failure arc to the shorter
history weighs ``1 - share``. The root's arcs are discounted relative frequencies, and the discounts go to the one unknown
word. A document's tokens walk the automaton once from left to right, carry the state and add up the weights.

The automaton is never in one place. Documents are dealt to blocks of about ``BLOCK_BYTES``. A block sends the hashes of its
distinct n-grams with its own counts, packed by bucket; a bucket adds them up and returns to each block the corpus counts
of what that block asked for, in the same order, so only counts travel back. The block then holds the part of the
automaton that its own documents can reach. No word is hot: a block asks for it once.

A null text is empty: it has the end token alone. Learnt are the rows that ``learn`` (SQL) allows; rows without an id are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import words as W
from pageloom.llm.frames import bucket_count, text_bytes

BLOCK_BYTES = 4 << 20
ORDER, SHARE = 2, 0.4
END = np.uint64(0x5E0F7E4DC0FFEE11)
_ORDERS = W.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_ASK = "bucket int, block long, grams binary, counts binary"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_TOLD_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())])
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each with the end token, and the offsets of the texts."""
    w = W.words(column, lower=True)
    first = w.first + np.arange(len(w.first))
    out = np.full(len(w.start) + len(w.counts), END, np.uint64)
    out[np.arange(len(w.start)) + w.doc()] = W.hashes(w)
    return out, first


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each token, and whether it lies in the token's document."""
    out = np.zeros(len(h), np.uint64)
    runs = W.rolled(h, n)
    out[n - 1 :] = W.mix(runs ^ _ORDERS[n - 1])
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    return out, place >= n - 1


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses well where the values are small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _rows(bucketed: np.ndarray, counts: np.ndarray, block: int, buckets: int) -> pa.RecordBatch:
    """Sorted hashes and their counts, cut by bucket (the top of the hash)."""
    which = (bucketed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.searchsorted(which, np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edges))
    rows = {"bucket": full, "block": np.full(len(full), block), "grams": [], "counts": []}
    for b in full:
        part = slice(edges[b], edges[b + 1])
        rows["grams"].append(_planes(np.diff(bucketed[part], prepend=np.uint64(0))))
        rows["counts"].append(_planes(counts[part].astype(np.uint32)))
    return pa.RecordBatch.from_pydict(rows, schema=_ASK_ARROW)


def _sum(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, place, np.bincount(place, weights, len(distinct)).astype(np.int64)


def _unigrams(buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            h, first = tokens(piece.column(piece.schema.get_field_index("text")))
            distinct, _, counts = _sum(grams(h, first, 1)[0], np.ones(len(h)))
            yield _rows(distinct, counts, 0, buckets)

    return send


def _totals(table: pa.Table) -> pa.Table:
    values = np.concatenate([np.cumsum(_unplaned(x, np.uint64), dtype=np.uint64) for x in table["grams"].to_pylist()])
    counts = _sum(values, np.concatenate([_unplaned(x, np.uint32) for x in table["counts"].to_pylist()]))[2]
    return pa.table({"n": [int(counts.sum())], "v": [len(counts)], "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())]})


def corpus_totals(docs: DataFrame, buckets: int) -> tuple[int, int, int, int]:
    """Tokens, distinct tokens, those seen once and twice, of all rows that are learnt from."""
    found = (
        docs.filter("learnt").select("text").mapInArrow(_unigrams(buckets), _ASK)
        .groupBy("bucket").applyInArrow(_totals, "n long, v long, once long, twice long")
        .agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once", "twice"))).first()
    )
    return tuple(found)


def _ngrams(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Token hashes and offsets of a block, its n-gram hashes by order, and which of them lie in a document."""
    h, first = tokens(table["text"])
    made = [grams(h, first, n) for n in range(1, order + 1)]
    return h, first, [m[0] for m in made], [m[1] for m in made]


def _asker(order: int, buckets: int) -> Callable:
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, first, made, inside = _ngrams(table, order)
        learnt = np.repeat(table["learnt"].to_numpy(), np.diff(first)).astype(float)
        distinct, _, counts = _sum(np.concatenate([m[i] for m, i in zip(made, inside, strict=True)]), np.concatenate([learnt[i] for i in inside]))
        return pa.Table.from_batches([_rows(distinct, counts, key[0].as_py(), buckets)])

    return ask


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's n-grams, for each block in the order in which it asked."""
    parts = [np.cumsum(_unplaned(x, np.uint64), dtype=np.uint64) for x in table["grams"].to_pylist()]
    _, place, counts = _sum(np.concatenate(parts), np.concatenate([_unplaned(x, np.uint32) for x in table["counts"].to_pylist()]))
    edges = np.r_[0, np.cumsum([len(p) for p in parts])]
    told = [_planes(counts[place[a:b]].astype(np.uint64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([table["block"], table["bucket"], pa.array(told, pa.binary())], schema=_TOLD_ARROW)


class Automaton:
    """The part of the automaton that a block can reach. n-grams are numbered; ``ends[k]`` has the (k+1)-gram that ends at each token."""

    def __init__(self, ends: list[np.ndarray], inside: list[np.ndarray], counts: np.ndarray, totals: tuple, share: float) -> None:
        n, v, once, twice = totals
        discount = once / (once + 2 * twice) if once and twice else 0.5
        weight = np.zeros(len(counts))
        unknown = discount * v / n if n else 1.0
        at = ends[0]
        weight[at] = np.where(counts[at] > 0, (counts[at] - discount) / max(n, 1), unknown)
        for k in range(1, len(ends)):
            i = np.flatnonzero(inside[k])
            history = np.maximum(counts[ends[k - 1][i - 1]], 1)
            lower = np.where(counts[ends[k - 1][i]] > 0, weight[ends[k - 1][i]], 0)
            if k > 1:  # a lower order that was not learnt is reached by its own failure arcs
                lower = np.where(lower > 0, lower, (1 - share) * weight[ends[k - 2][i]])
            else:
                lower = np.where(lower > 0, lower, unknown)
            weight[ends[k][i]] = share * counts[ends[k][i]] / history + (1 - share) * lower
        with np.errstate(divide="ignore"):
            self.weight = np.log10(weight).tolist()
        self.learnt = (counts > 0).tolist()
        self.ends = [e.tolist() for e in ends]
        self.order, self.failure, self.unknown = len(ends), float(np.log10(1 - share)), float(np.log10(unknown))

    def walk(self, begin: int, end: int) -> float:
        """Log10 probability of the tokens begin to end: from the root, one arc for each token after as many failure arcs as needed."""
        learnt, weight, ends, longest = self.learnt, self.weight, self.ends, self.order - 1
        state = 0  # length of the history that the state stands for
        total = 0.0
        for i in range(begin, end):
            gram = ends[state][i]
            while state and not learnt[gram]:
                total += self.failure
                state -= 1
                gram = ends[state][i]
            if learnt[gram]:
                total += weight[gram]
                if state < longest:
                    state += 1
            else:
                total += self.unknown
        return total


def _scorer(order: int, share: float, totals: tuple) -> Callable:
    n, v = totals[:2]

    def score(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        h, first, made, inside = _ngrams(table, order)
        distinct, place = np.unique(np.concatenate([m[i] for m, i in zip(made, inside, strict=True)]), return_inverse=True)
        told = told.sort_by("bucket")
        counts = np.concatenate([_unplaned(x, np.uint64) for x in told["counts"].to_pylist()]).astype(np.int64)
        ends, at = [], 0
        for i in inside:
            end = np.zeros(len(h), np.int64)
            end[i] = place[at : at + int(i.sum())]
            at += int(i.sum())
            ends.append(end)
        automaton = Automaton(ends, inside, counts, totals, share)
        one = counts[ends[0]]
        base = np.r_[0, np.cumsum(np.log10((one + 1) / (n + (v + 1))))]
        known = np.r_[0, np.cumsum(one > 0)]
        a, b = first[:-1], first[1:]
        return pa.table([
            table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), pa.array(b - a), pa.array(known[b] - known[a]),
            pa.array(base[b] - base[a]), pa.array([automaton.walk(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]),
        ], schema=_RESULT_ARROW)

    return score


def score_texts(docs: DataFrame, held_out: str, order: int = ORDER, share: float = SHARE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is SQL over doc_id; those rows are scored and not learnt. Without rows to learn from, every token is the
    unknown one. Repeated rows are learnt as often as they stand there, and score alike. Other columns are not read.
    """
    kept = docs.selectExpr("cast(doc_id as long) as doc_id", f"coalesce({held_out}, false) as held_out", "text").withColumn("learnt", ~F.col("held_out"))
    size = text_bytes(docs)
    buckets, blocks = bucket_count(size), max(1, -(-size // BLOCK_BYTES))
    totals = corpus_totals(kept, buckets)
    dealt = kept.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "*")
    told = (
        dealt.groupBy("block").applyInArrow(_asker(order, buckets), _ASK)
        .groupBy("bucket").applyInArrow(_add_up, "block long, bucket int, counts binary")
    )
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scorer(order, share, totals), RESULT)
    return scored.withColumn("train_tokens", F.lit(totals[0]).cast("long"))
