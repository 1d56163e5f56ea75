"""One registered query for each operator, over its whole table. Each derives the asked columns from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import backoff, bpe, factors, token_files, toxicity, trees
from pageloom.llm.centroids import cluster
from pageloom.llm.chat import format_chats
from pageloom.llm.contamination import contaminated, find_contamination
from pageloom.llm.frames import new_folder, read, remainder, text_bytes
from pageloom.llm.near import near_duplicates
from pageloom.llm.repeats import dedup_substrings
from pageloom.llm.simhash import simhash_duplicates
from pageloom.llm.turns import repair_conversations


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    kept = F.expr("trim(BOTH ' ' FROM regexp_replace(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+', ' '))")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = backoff.score_texts(docs, held_out="crc32(cast(doc_id as string)) % 7 = 2")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_contamination(docs, read(spark, sf_dir, "benchmark"), window=13)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), F.expr(contaminated()).alias("contaminated"),
    )


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=75, shingle=5)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = factors.train(docs, read(spark, sf_dir, "labels"), "quality", learn="crc32(cast(doc_id as string)) % 4 <> 2")
    held_out, predicted = (remainder("doc_id", 4) == 2).alias("held_out"), (F.col("score") >= 0.7).cast("int").alias("predicted")
    return factors.score_quality(docs, machine).select("doc_id", held_out, "score", predicted)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = trees.train(docs, read(spark, sf_dir, "labels"), "quality")
    return trees.quality_rules(docs, fitted, least_words=10, repeat_percent=20).drop("text")


def toxicity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"), "toxic", learn="crc32(cast(doc_id as string)) % 5 <> 0")
    held_out, predicted = (remainder("doc_id", 5) == 0).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score_toxicity(docs, machine).select("doc_id", held_out, "score", predicted)


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder, shards = new_folder(spark, "tokens"), -(-text_bytes(docs) // token_files.SHARD_BYTES) + 1
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1, shards=shards)
    return token_files.checksums(token_files.read_tokens(spark, folder))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return bpe.decode(ids, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"), dims=64, scale=64, k=16, rounds=3, salt="1")


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), bits=4, shingle=4)


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup,
    "op2_lm_scoring": lm_scoring,
    "op3_quality_classifier": quality_classifier,
    "op4_decontamination": decontamination,
    "op5_chat_format": chat_format,
    "op6_near_dedup": near_dedup,
    "op7_quality_rules": quality_rules,
    "op8_toxicity": toxicity_svm,
    "op9_token_output": token_output,
    "op10_byte_bpe": byte_bpe,
    "op11_centroid_clusters": centroid_clusters,
    "op12_simhash_dedup": simhash_dedup,
    "op13_conversation_repair": conversation_repair,
}
