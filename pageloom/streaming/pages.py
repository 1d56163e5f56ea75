"""Pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions import naming
from pageloom.functions.markup import unescape
from pageloom.functions.urls import short_host
from pageloom.operators.tokens import attributes, tokens
from pageloom.plans.corpus import Corpus
from pageloom.session import tune
from pageloom.sources.sinks import write_table


WINNERS, MERGED = "winners", "winners_merged"
WINNER = "output_path string, page_id bigint"
#: Characters of markup that one partition of a micro-batch holds.
PARTITION_CHARS = 48 << 20


def page_heads(pages: DataFrame) -> DataFrame:
    """What can be said of a page by itself: site, title, file name. No state, so any sink will do."""
    title = unescape("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")
    return (
        pages.filter("url is not null and url != ''")
        .selectExpr("page_id", "url", f"{short_host('url')} as site", f"trim({title}) as title")
        .filter("site is not null and title != ''")
        .selectExpr("*", f"{naming.slug('title', naming.FILE_NAME_RESERVED)} as slug")
    )


def page_attributes(pages: DataFrame) -> DataFrame:
    """Attribute rows of arriving pages. Pages stay where they were read."""
    return attributes(tokens(pages, clustered=True))


def batch_partitions(batch: DataFrame) -> int:
    """Partitions of a micro-batch, from the characters of its pages: Spark does not know the size of what a trigger brings."""
    size = batch.selectExpr("coalesce(sum(length(html)), 0) as n").first().n
    return max(-(-size // PARTITION_CHARS), batch.sparkSession.sparkContext.defaultParallelism)


def convert_stream(
    pages: DataFrame,
    folder: str,
    checkpoint: str,
    run_ts: str,
    trigger: dict | None = None,
    compact_every: int = 50,
    **options,
) -> StreamingQuery:
    """Convert every micro-batch with the batch job and write all its tables below ``folder``.

    A batch owns the folder of its number and replaces it when it is run again, so a restart writes nothing twice. Which article of
    an output path is the latest is only known across batches: each one writes the winner of each of its paths, and
    ``read_converted`` compares the winners. Every ``compact_every`` batches they are merged into one table, numbered by the
    batch as well, so a reader meets a bounded number of them. ``options`` go to ``Corpus``.
    """

    def convert(batch: DataFrame, number: int) -> None:
        spark = tune(batch.sparkSession)
        corpus = Corpus(spark, batch, run_ts, **{"partitions": batch_partitions(batch), **options})
        try:
            for name, rows in corpus.outputs().items():
                write_table(rows, f"{folder}/{name}/batch={number}")
            write_table(corpus.articles.filter("is_latest").select("output_path", "page_id"), f"{folder}/{WINNERS}/batch={number}")
        finally:
            corpus.release()
        if (number + 1) % compact_every == 0:
            write_table(winners(spark, folder, before=number + 1), f"{folder}/{MERGED}/batch={number}")

    return (
        pages.writeStream.foreachBatch(convert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose table is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")) if files.exists(path) else []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or [])


def winners(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The latest article of every output path over all batches, or those numbered below ``before``: ``output_path, page_id``.

    The last merged table and the batches after it, combined by path with map-side aggregation.
    """
    known = [n for n in _batches(spark, f"{folder}/{WINNERS}") if before is None or n < before]
    # A table merged by the batch that runs again is not read but replaced.
    merged = [n for n in _batches(spark, f"{folder}/{MERGED}") if before is None or n < before - 1][-1:]
    paths = [f"{folder}/{MERGED}/batch={n}" for n in merged]
    paths += [f"{folder}/{WINNERS}/batch={n}" for n in known if not merged or n > merged[0]]
    rows = spark.read.schema(WINNER).parquet(*paths) if paths else spark.createDataFrame([], WINNER)
    return rows.groupBy("output_path").agg(F.max("page_id").alias("page_id"))


def read_converted(spark: SparkSession, folder: str, name: str = "articles") -> DataFrame:
    """A table of a stream over all complete batches; ``is_latest`` of articles is judged over all of them."""
    paths = [f"{folder}/{name}/batch={n}" for n in _batches(spark, f"{folder}/{WINNERS}")]
    if not paths:
        raise ValueError(f"no batch is complete below {folder}")
    rows = spark.read.parquet(*paths)
    if name != "articles":
        return rows
    won = winners(spark, folder).selectExpr("page_id", "true as is_latest")
    return rows.drop("is_latest").join(won, "page_id", "left").na.fill({"is_latest": False})
