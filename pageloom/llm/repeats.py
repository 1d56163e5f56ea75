"""Substring dedup: remove passages that stand earlier in the corpus, by level-wise doubling of repeated windows.

A window of 20 words can only repeat if a window of 5 words inside it repeats, then one of 10 words. So the levels are
5, 10 and 20 words, and only windows repeated at one length are extended to twice that length, until the full length is
reached or no candidates survive (later levels then read no documents). At the first length every full window is
stood for by the least of its short windows, which equal full windows share; at the others by the window of that length
around it. That leaves about one word in eight to send at first, and later only what repeats.

At each level map tasks combine equal windows of their piece, pack what is left by bucket of the hash (numpy bytes, a
few rows for each task and bucket), and a group of one bucket finds the repeats. A passage that a third of all documents
share reaches its bucket once per piece of text, so no hash, source or group of copies makes a large group. Answers go
back by document. The last level compares 96 hash bits and the shorter ones' repeats.

Documents with the same ``doc_id`` count as one place in the order; a null ``doc_id`` comes first; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import words as W
from pageloom.llm.frames import bucket_count, text_bytes, without

KEY, TAG = "__doc", "__tag"
_PACKED = ("docs", "tags", "sizes", "places", "hashes", "checks", "again")
_SENT = "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED)
_SENT_ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in _PACKED]])
_FOUND_ARROW = pa.schema([(KEY, pa.int64()), (TAG, pa.int32()), ("places", pa.binary())])
_FOUND = f"{KEY} long, {TAG} int, places binary"
_CHECK = np.uint64(0xA0761D6478BD642F)


def levels(window: int) -> list[int]:
    """Window lengths, each twice the one before, up to the full one."""
    out = [window]
    while out[0] % 2 == 0 and out[0] > 5:
        out.insert(0, out[0] // 2)
    return out


def _least(h: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Index of the least value among the span values from each start, the leftmost of equal ones."""
    best, have = np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[left] <= h[right], left, right)
        have += step
    return best[starts]


def _parts(w: W.Words, h: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each level, the word at which the part begins that stands for each full window."""
    full = lengths[-1]
    starts = np.flatnonzero(w.position() + full <= np.repeat(w.counts, w.counts))
    if len(lengths) == 1 or not len(starts):
        return [starts] * len(lengths)
    short = W.windows(w, h, lengths[0])[0]
    out = [_least(short, starts, full - lengths[0] + 1)]
    for before, length in zip(lengths[:-2], lengths[1:-1], strict=True):
        out.append(np.where(out[-1] + length <= starts + full, out[-1], out[-1] - before))
    return [*out, starts]


def _marked(n: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _survivors(column: pa.Array, w: W.Words) -> np.ndarray:
    """Words at which the windows begin that a level found; the column has a list of packed places per document."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    packed = column.flatten()
    if not len(packed):
        return np.zeros(0, np.int64)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(packed).to_pylist()]) // 4
    lists = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    doc = np.repeat(np.repeat(np.arange(len(column)), lists), sizes)
    places = np.frombuffer(b"".join(packed.to_pylist()), np.int32)
    return w.first[doc] + places


def _sorted_by_key(piece: pa.RecordBatch) -> pa.RecordBatch:
    keys = piece.column(piece.schema.get_field_index(KEY)).to_numpy()
    if np.all(keys[1:] >= keys[:-1]):
        return piece
    return piece.take(pa.array(np.argsort(keys, kind="stable")))


def _column(piece: pa.RecordBatch, name: str) -> pa.Array:
    return piece.column(piece.schema.get_field_index(name))


def _packed_rows(bucket, doc, place, keys, tags, more: dict[str, np.ndarray]) -> dict[str, list]:
    """Entries in order of bucket and document as a row of packed arrays for each bucket."""
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])])
    sizes = np.diff(np.r_[new, len(doc)]).astype(np.int32)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends, rows = np.r_[cut[1:], len(doc)], {c: [] for c in ("bucket", *_PACKED)}
    heads, head_ends = np.searchsorted(new, cut), np.searchsorted(new, ends)
    place = place.astype(np.int32)
    for at, to, a, b in zip(cut, ends, heads, head_ends, strict=True):
        of = doc[new[a:b]]
        rows["bucket"].append(int(bucket[at]))
        rows["docs"].append(keys[of].tobytes())
        rows["tags"].append(tags[of].tobytes())
        rows["sizes"].append(sizes[a:b].tobytes())
        rows["places"].append(place[at:to].tobytes())
        for c in ("hashes", "checks", "again"):
            rows[c].append(more[c][at:to].tobytes() if c in more else None)
    return rows


def _sender(lengths: list[int], level: int, buckets: int) -> Callable:
    """Map side of a level: the windows to be looked up, and the repeats that the piece itself shows."""
    final = level == len(lengths) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            piece = _sorted_by_key(piece)
            w = W.words(_column(piece, "text"))
            h = W.hashes(w)
            parts = _parts(w, h, lengths)
            if not len(parts[-1]):
                continue
            wanted = parts[level]
            if level:
                wanted = wanted[_marked(len(h), _survivors(_column(piece, "found"), w))[parts[level - 1]]]
            at = np.flatnonzero(_marked(len(h), wanted))
            if not len(at):
                continue
            value = W.windows(w, h, lengths[level])[0][at]
            order = np.argsort(value, kind="stable")
            at, value = at[order], value[order]
            doc, keys = w.doc()[at], _column(piece, KEY).to_numpy()
            tags, place = _column(piece, TAG).to_numpy(), w.position()[at]
            head = np.r_[True, value[1:] != value[:-1]]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            first = (keys[doc] == keys[doc[lead]]) & (place == place[lead])
            many = np.diff(np.r_[np.flatnonzero(head), len(at)]) > 1
            more = {"hashes": value, "again": np.repeat(many, np.diff(np.r_[np.flatnonzero(head), len(at)])).astype(np.uint8)}
            if final:
                more["checks"] = W.windows(w, W.mix(h ^ _CHECK), lengths[level])[0][at].astype(np.uint32)
            bucket = ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            sent = np.flatnonzero(first)
            sent = sent[np.lexsort((at[sent], bucket[sent]))]
            rows = _packed_rows(bucket[sent], doc[sent], place[sent], keys, tags, {c: v[sent] for c, v in more.items()})
            known = np.sort(at[~first])
            if len(known):
                whole = np.full(len(known), int(value[0] % np.uint64(buckets)))
                for c, v in _packed_rows(whole, w.doc()[known], w.position()[known], keys, tags, {}).items():
                    rows[c] += v
            yield pa.RecordBatch.from_pydict(rows, schema=_SENT_ARROW)

    return send


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x is not None), kind)


def _finder(final: bool) -> Callable:
    """Reduce side of a level, for one bucket: the places of repeated windows, or of all but the first at the end."""

    def find(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.is_valid(table["hashes"]))
        known = table.filter(pc.is_null(table["hashes"]))
        out = [_answer(known, None)]
        if asked.num_rows:
            value, again = _joined(asked, "hashes", np.uint64), _joined(asked, "again", np.uint8)
            if final:
                check = _joined(asked, "checks", np.uint32)
                order = np.lexsort((check, value))
                head = np.r_[True, (value[order][1:] != value[order][:-1]) | (check[order][1:] != check[order][:-1])]
                group = np.cumsum(head) - 1
                key = np.repeat(_joined(asked, "docs", np.int64), _joined(asked, "sizes", np.int32))[order]
                place = _joined(asked, "places", np.int32)[order]
                least = np.minimum.reduceat(key, np.flatnonzero(head))[group]
                far = np.where(key == least, place, np.iinfo(np.int32).max)
                hit = (key != least) | (place != np.minimum.reduceat(far, np.flatnonzero(head))[group])
            else:
                order = np.argsort(value, kind="stable")
                head = np.r_[True, value[order][1:] != value[order][:-1]]
                sizes = np.diff(np.r_[np.flatnonzero(head), len(order)])
                hit = np.repeat(sizes > 1, sizes) | (again[order] > 0)
            keep = np.zeros(len(order), bool)
            keep[order] = hit
            out.append(_answer(asked, keep))
        return pa.concat_tables(out)

    return find


def _answer(table: pa.Table, keep: np.ndarray | None) -> pa.Table:
    """A row of packed places for each document of each packed row."""
    sizes = _joined(table, "sizes", np.int32)
    places, keys, tags = (_joined(table, c, t) for c, t in (("places", np.int32), ("docs", np.int64), ("tags", np.int32)))
    if keep is not None:
        edge = np.r_[0, np.cumsum(sizes)]
        sizes, places = np.diff(np.r_[0, np.cumsum(keep)][edge]), places[keep]
    held = np.flatnonzero(sizes)
    offsets = np.r_[0, np.cumsum(sizes[held]) * 4].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(places))])
    return pa.table([pa.array(keys[held]), pa.array(tags[held]), packed], schema=_FOUND_ARROW)


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """Documents with ``found``: packed word numbers at which windows start that also start earlier in the corpus.

    ``docs`` needs ``__doc`` (the order of documents) and ``__tag`` (tells texts with one key apart).
    """
    lengths, buckets = levels(window), bucket_count(text_bytes(docs))
    found = None
    for level in range(len(lengths)):
        rows = docs if found is None else docs.join(found, [KEY, TAG], "inner")
        found = (
            rows.mapInArrow(_sender(lengths, level, buckets), _SENT)
            .groupBy("bucket")
            .applyInArrow(_finder(level == len(lengths) - 1), _FOUND)
            .groupBy(KEY, TAG)
            .agg(F.collect_list("places").alias("found"))
        )
    return docs.join(found, [KEY, TAG], "left")


def _cutter(window: int, schema: pa.Schema) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            w = W.words(_column(piece, "text"))
            gone = W.covered(w, _survivors(_column(piece, "found"), w), window)
            total, doc = np.r_[0, np.cumsum(gone)], w.doc()
            out = {c: _column(piece, c) for c in schema.names if c in piece.schema.names}
            if gone.any():
                # A removed word goes with the white space up to the next word of its document, or else to the end.
                until = np.append(w.start[1:], 0)
                until = np.where(np.append(doc[1:] != doc[:-1], True), w.offsets[1:][doc], until)
                edge = np.zeros(len(w.data) + 1, np.int8)
                np.add.at(edge, w.start[gone], 1)
                np.add.at(edge, until[gone], -1)
                kept = np.cumsum(edge[:-1], dtype=np.int8) == 0
                offsets = np.r_[0, np.cumsum(kept)][w.offsets]
                out["text"] = pa.Array.from_buffers(
                    pa.large_string(), piece.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(w.data[kept])]
                ).cast(pa.string())
                out["text"] = pc.if_else(_column(piece, "text").is_null(), pa.scalar(None, pa.string()), out["text"])
            out["n_words"] = pa.array(w.counts)
            out["n_removed"] = pa.array(total[w.first[1:]] - total[w.first[:-1]])
            starts = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (doc[1:] == doc[:-1])]) if len(gone) else np.zeros(0, int)
            ends = np.flatnonzero(gone & ~np.r_[gone[1:] & (doc[1:] == doc[:-1]), False]) if len(gone) else np.zeros(0, int)
            spans = pa.StructArray.from_arrays(
                [pa.array(w.position()[starts]), pa.array(w.position()[ends] + 1)], names=["start", "end"]
            )
            out["removed"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, w.first), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([out[c].cast(schema.field(c).type) for c in schema.names], schema=schema)

    return cut


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """Cut every word that a repeated window covers; the first occurrence of each window stays.

    Returns the columns of ``docs`` with what is left of ``text``, and ``n_words``, ``n_removed`` (long) and ``removed``
    (list of word ranges). Windows are judged on the input. A text that nothing is cut from is unchanged; one that is cut
    whole is empty; null stays null. Input columns with those names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = without(docs, "n_words", "n_removed", "removed", "found")
    more = StructType.fromDDL("n_words long, n_removed long, removed array<struct<start: long, end: long>>")
    result = StructType([*rows.schema.fields, *more.fields])
    keyed = rows.select(
        "*",
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias(KEY),
        F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int").alias(TAG),
    )
    return repeated_windows(keyed, window).mapInArrow(_cutter(window, to_arrow_schema(result)), result)
