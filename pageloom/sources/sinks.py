"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_articles(articles: DataFrame, path: str, by_site: bool = False, mode: str = "overwrite") -> None:
    """Write articles, in one folder per site when asked.

    A rerun replaces only the sites it has rows for. Rows are rebalanced by site: Spark splits the partition of a large site,
    whatever share of all articles it holds, and joins those of small ones, by their sizes.
    """
    if not by_site:
        articles.write.mode(mode).parquet(path)
        return
    (
        articles.hint("rebalance", "site")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("site")
        .parquet(path)
    )


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def write_bucketed_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """A page table that later runs read without any exchange (``tokens(..., clustered=True)``)."""
    pages.write.mode("overwrite").bucketBy(buckets, "page_id").format("parquet").saveAsTable(table)
