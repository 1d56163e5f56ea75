"""Intermediate tables that cut lineage and keep the page clustering.

A stage is written once to the cluster's shared folder (``spark.checkpoint.dir``) as a Parquet table bucketed
by its key. Plans above it start from that table: they stay small, survive lost executors without
recomputing the scan, read only the columns they need, and join and aggregate by the key without an exchange.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Cutting a page into tokens multiplies its rows, and the sorts of a task hold its partition: up to 200 times its bytes of page files.
PARTITION_BYTES = 4 << 20
MAX_BUCKETS = "spark.sql.bucketing.maxBuckets"
UNKNOWN_SIZE = 1 << 60
# The setting cannot be changed in a running session, so a test session's folder is remembered here.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder; a temporary one of this machine only where none is set and Spark is local."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="pageloom-")
    return _LOCAL_FOLDERS[app]


def partitions_for(rows: DataFrame) -> int:
    """Number of partitions for page rows, from the size of the files they are read from.

    At least one per core. Where Spark does not know the size, the session's shuffle partitions.
    """
    spark = rows.sparkSession
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN_SIZE:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(-(-size // PARTITION_BYTES), spark.sparkContext.defaultParallelism)


class Stages:
    """Bucketed tables of one run, all with the same number of buckets."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark = spark
        self.run = uuid.uuid4().hex[:12]
        self.buckets = buckets
        # The setting's default of 100,000 would bound the pages of one run.
        if buckets > int(spark.conf.get(MAX_BUCKETS, "100000")):
            spark.conf.set(MAX_BUCKETS, str(buckets))
        self.tables: list[str] = []

    def keep(self, rows: DataFrame, name: str, key: str = "page_id") -> DataFrame:
        table = f"pageloom_{name}_{self.run}"
        # One file per bucket. Spark removes this exchange where the rows are partitioned like that already.
        (
            rows.repartition(self.buckets, key)
            .write.format("parquet")
            .mode("overwrite")
            .bucketBy(self.buckets, key)
            .option("path", f"{self._folder()}/{name}")
            .saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def _folder(self) -> str:
        return f"{shared_folder(self.spark)}/pageloom/{self.run}"

    def release(self) -> None:
        """Drop the tables and delete the folder of this run. Call it once the outputs are written."""
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
        if self.tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.clear()
