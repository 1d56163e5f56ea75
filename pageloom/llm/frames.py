"""Column and folder helpers of the text operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.stages import shared_folder

#: Bytes of text that one bucket of an exchange or one block of documents stands for.
BUCKET_BYTES = 12 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker. Both hold a batch and its copies for each running task, and neither
#: gives all of that back afterwards; Spark's 64 MB would be tens of thousands of texts at once.
BATCH_BYTES = 4 << 20
#: Folders that each application has made in the shared folder.
_MADE: dict[str, list[str]] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster has it installed. They get small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(rows: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that have the name of a result column: the result's own column wins."""
    taken = {n.lower() for n in names}
    return rows.select([F.col(f"`{c}`") for c in rows.columns if c.lower() not in taken])


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    folder = f"{shared_folder(spark)}/pageloom-llm/{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession) -> None:
    """Delete the tables that operators have written in this application. Call it once their results are written: until then
    they are read from these tables."""
    for folder in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write rows to the cluster's shared folder and read them back."""
    spark = rows.sparkSession
    path, schema = new_folder(spark, name), rows.schema
    rows.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, which size blocks and buckets."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(size: int, least: int = 64) -> int:
    return max(least, -(-size // BUCKET_BYTES))


def remainder(key: str, of: int):
    """crc32 of a key as text, modulo ``of``; a null key has the remainder of no row (-1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of, F.lit(-1))
