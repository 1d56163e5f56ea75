"""Corpus-level views of the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.operators.tree import exprs


def site_rollup(articles: DataFrame) -> DataFrame:
    """Articles, distinct texts and time range per site.

    Distinct hashes are removed per (site, hash) first, so a site with a third of all articles reaches the
    final step as one partial row per task.
    """
    per_text = articles.groupBy("site", "content_sha256").agg(*exprs(
        "count(*) as n", "min(published_at) as first_at", "max(published_at) as last_at"
    ))
    return per_text.groupBy("site").agg(*exprs(
        "sum(n) as n_articles", "count(content_sha256) as n_texts",
        "min(first_at) as first_at", "max(last_at) as last_at",
    ))


def duplicate_groups(articles: DataFrame) -> DataFrame:
    """Texts that occur more than once: ``content_sha256, keep_id, n_pages``."""
    return (
        articles.filter("content_sha256 is not null")
        .groupBy("content_sha256")
        .agg(*exprs("min(page_id) as keep_id", "count(*) as n_pages"))
        .filter("n_pages > 1")
    )
