"""From raw documents to token ids: the stages of a training corpus.

Every stage works on all that the one before it kept; its result is written to the shared folder and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, factors
from pageloom.llm.contamination import cut_spans, find_contamination
from pageloom.llm.frames import importable, read, written
from pageloom.llm.near import keep_one
from pageloom.llm.repeats import dedup_substrings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorisation machine rejects. It learns from three quarters of the labelled rows.

    A null text is judged like an empty one, repeated rows alike; without labels of both kinds all or none go."""
    importable(spark)
    labels = read(spark, sf_dir, "labels")
    machine = factors.train(docs, labels, "quality", learn="crc32(cast(doc_id as string)) % 4 <> 2")
    return factors.score_quality(docs, machine, "__score").filter(F.col("__score") >= LEAST_QUALITY).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near copies. Documents without words or without an id stay; so do
    repeated rows of the smallest id."""
    importable(spark)
    return keep_one(docs, percent=75, shingle=5).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 20 words or more that stand earlier in the corpus; no document goes. Null texts stay null."""
    importable(spark)
    return dedup_substrings(docs, window=20).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least one word in twenty lies in a passage of a benchmark item; of the others cut passages of 13
    such words or more. Null and empty texts stay."""
    importable(spark)
    marked = find_contamination(docs, read(spark, sf_dir, "benchmark"), window=13)
    return cut_spans(marked, least=13, share=20).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text back. A null text has no ids."""
    importable(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Models and token ids are beyond SQL; a test compares every stage with a brute-force version, kept ids and texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
