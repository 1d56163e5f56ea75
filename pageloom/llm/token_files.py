"""Token ids in files: Parquet list columns in document order, read back by column and row group.

Layout of a folder: one file for each range of ``doc_id``, its rows in order. Columns: ``shard`` (number of the range),
``doc_id``, ``at`` (ids of earlier documents in the shard), ``n_tokens``, ``ids`` (list of int, dictionary-encoded, since
a vocabulary is small). Row groups hold ``GROUP_BYTES``, pages ``PAGE_ROWS`` rows, with page indexes; so a range of documents, or
the metadata without any id, is read without the rest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from itertools import chain
from operator import attrgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm import words as W
from pageloom.llm.frames import written

GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 1 << 20, 2_000
#: Text that one shard stands for.
SHARD_BYTES = 16 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 3_000_000
MOST_BYTES = 64 << 20
SCHEMA = "shard int, doc_id long, at long, n_tokens long, ids array<int>"
#: Signs that a tokenizer of words cuts off after letters. Not the apostrophe, which begins endings of its own.
_SIGNS = b'.,;:!?*$%&#|()"-'
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_ID = attrgetter("id")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level tokenizers write bytes as letters: printable ones as themselves, the others in order from U+0100.
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_LETTERS = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
_ARROW = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


class WordCodes:
    """Ids of words by a tokenizer that never looks across white space nor from letters into other signs.

    Words are remembered by hash in sorted arrays, some twenty bytes each, and forgotten all at once beyond ``REMEMBERED``.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        self.signs: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _sign_ids(self, tail: str) -> list[int]:
        if tail not in self.signs:
            if len(self.signs) > 10_000:
                self.signs = {}
            self.signs[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.signs[tail]

    def _word(self, raw: bytes) -> list[int]:
        """Ids of a word in UTF-8. One of a-z and Latin letters is one word for the model too, whose table of bytes alone stands
        before it; signs behind it are another. Everything else goes through the whole tokenizer."""
        if raw.isalpha():  # ASCII letters only
            return list(map(_ID, self.merge(raw.lower().decode())))
        core = raw.rstrip(_SIGNS)
        if core.isalpha():
            letters = core.lower().decode()
        elif not core.isascii() and _LATIN(shown := core.decode()):
            letters = charmap_decode(shown.lower().encode(), "strict", _BYTE_LETTERS)[0]
        else:
            return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
        ids = list(map(_ID, self.merge(letters)))
        return ids if len(core) == len(raw) else ids + self._sign_ids(raw[len(core) :].decode())

    def _add(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Remember new words; the keys are sorted."""
        ids = list(map(self._word, words))
        sizes = np.array(list(map(len, ids)), np.int32)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + total, np.int32)])
        self.flat[self.used : self.used + total] = list(chain.from_iterable(ids))
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(sizes) - sizes)
        self.size, self.keys = np.insert(self.size, at, sizes), np.insert(self.keys, at, keys)
        self.used += total

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has; null counts as empty."""
        w = W.words(texts)
        distinct, at, place = np.unique(W.hashes(w), return_index=True, return_inverse=True)
        for _ in range(2):
            entry = np.searchsorted(self.keys, distinct)
            known = entry < len(self.keys)
            known[known] = self.keys[entry[known]] == distinct[known]
            if known.all():
                break
            if len(self.keys) + len(distinct) > REMEMBERED:
                self._forget()
                known[:] = False
            new, raw = np.flatnonzero(~known), w.data.tobytes()
            self._add(distinct[new], [raw[a:b] for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)])
        entry = np.searchsorted(self.keys, distinct)[place] if len(place) else place
        counts, start = self.size[entry], self.start[entry]
        before = np.r_[0, np.cumsum(counts)]
        ids = self.flat[np.repeat(start - before[:-1], counts) + np.arange(before[-1])]
        return np.insert(ids, before[w.first[1:]], end), np.diff(before[w.first]) + 1


_WORKER: dict[str, WordCodes] = {}


def _encoder(definition, key: str, end: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = WordCodes(definition.value)
        codes, at = _WORKER[key], 0
        for piece in W.pieces(batches):
            ids, sizes = codes.encode(piece.column(piece.schema.get_field_index("text")), end)
            offsets = np.r_[0, np.cumsum(sizes)]
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(piece.schema.get_field_index("shard")), piece.column(piece.schema.get_field_index("doc_id")),
                 pa.array(offsets[:-1] + at), pa.array(sizes), ids], schema=_ARROW)
            at += int(offsets[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int) -> None:
    """Encode ``text`` of all rows, append the end id to each, and write the folder.

    Rows are in order of doc_id, those with one doc_id in order of text; a null doc_id comes first, a null text is empty.
    Other columns are not written. ``tokenizer_path``: a JSON definition whose pre-tokenizer drops white space.
    """
    if Path(tokenizer_path).stat().st_size > MOST_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than {MOST_BYTES} bytes, too large to be sent to every task")
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    (
        ordered.mapInArrow(_encoder(definition, uuid.uuid4().hex, end_id), SCHEMA)
        .write.option("parquet.block.size", GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "1")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder with ``start``, the ids of all documents before. Only the columns asked for are read.

    Starts of shards come from the metadata columns: one row for each shard, which holds ``SHARD_BYTES`` of text, summed up in a
    window of one task (6 million rows at 100 TB). The starts are written first, so their size is known to Spark, which sends
    them to the ids where they are small; the ids themselves are then not shuffled.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = written(totals.select("shard", before.alias("before")), "shard_starts")
    return rows.join(firsts, "shard").withColumn("start", F.col("before") + F.col("at")).drop("before")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        flat, offsets = memoryview(ids.flatten().to_numpy()).cast("B"), np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())] * 4
        crc = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())
        named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        yield pa.RecordBatch.from_arrays([named["doc_id"], named["start"], named["n_tokens"], crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of read rows."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
