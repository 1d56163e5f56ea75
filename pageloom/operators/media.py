"""The media table of a book: distinct files in order of first use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions.markup import attr
from pageloom.functions.media import (
    canonical_extension, local_href, media_type, reference_kind, stable_id, transfer_class,
)
from pageloom.functions.urls import extension, strip_query
from pageloom.operators.lookup import salted_lookup
from pageloom.operators.tree import exprs


def typed(rows: DataFrame, url: str, types: DataFrame | None = None, spread: str = "book_id") -> DataFrame:
    """Add ``media_type`` and ``extension`` by the ending of an address without its query, else of all of it; null if unknown.

    The shipped list is a map in the scan. ``types`` is a table of the caller's instead (``ext, media_type, canonical_ext``, one row
    for each ending): it is asked twice. Its size is Spark's to check, and a common ending is spread over tasks.
    """
    if types is None:
        return rows.selectExpr("*", f"{media_type(url)} as media_type", f"{canonical_extension(url)} as extension")
    table = types.selectExpr("lower(ext) as ending", "struct(media_type, canonical_ext as extension) as known").dropDuplicates(["ending"])
    for name, ending in (("plain", extension(strip_query(url))), ("whole", extension(url))):
        asked = rows.selectExpr("*", f"nullif({ending}, '') as ending")
        rows = salted_lookup(asked, table, "ending", spread).withColumnRenamed("known", name).drop("ending")
    return rows.selectExpr("*", "coalesce(plain, whole) as known").selectExpr(
        *[c for c in rows.columns if c not in ("plain", "whole")], "known.media_type as media_type", "known.extension as extension"
    )


def media_references(content: DataFrame, version: int = 3) -> DataFrame:
    """Every media element with a source: ``book_id, kind, url, pos, node_id``; ``pos`` follows the document, also among embeds."""
    return (
        content.selectExpr(
            "page_id as book_id", f"{reference_kind('tag', version)} as kind",
            f"{attr('attrs', 'src')} as url", "struct(node_id, sub) as pos", "node_id", "tag",
        ).filter("kind is not null and url is not null")
    )


def media_table(references: DataFrame, covers: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """One row per book, kind and address of known type, numbered by first use.

    The first image is the cover unless ``covers`` (``book_id, cover``) names one. Numbering is a window over
    one book and kind, after the aggregation has removed repeats.
    """
    distinct = (
        typed(references.select("book_id", "kind", "url", "pos"), "url", types)
        .filter("media_type is not null and extension is not null")
        .groupBy("book_id", "kind", "url", "media_type", "extension")
        .agg(*exprs("min(pos) as first_pos"))
        .selectExpr("*", "row_number() over (partition by book_id, kind order by first_pos, url) - 1 as media_no")
    )
    no_cover = "true"
    if covers is not None:
        distinct = distinct.join(covers.selectExpr("book_id", "cover"), "book_id", "left")
        no_cover = "cover is null"
    return distinct.selectExpr(
        "book_id", "kind", "media_no", "url", "media_type", "extension",
        f"{stable_id('book_id', 'kind', 'url')} as media_id",
        f"{local_href('book_id', 'kind', 'url', 'extension')} as local_href",
        f"{transfer_class('url')} as transfer",
        f"media_no = 0 and kind = 'image' and {no_cover} as is_cover",
    )


def media_links(references: DataFrame, media: DataFrame) -> DataFrame:
    """Write-back: the local address for every element that uses a file; null keeps the link as it is."""
    return references.join(media.select("book_id", "kind", "url", "local_href"), ["book_id", "kind", "url"], "left")
