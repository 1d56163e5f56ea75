"""Cut pages into tags and text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions import one_of
from pageloom.functions.markup import PLAIN_MARK, page_tokens, parse_attrs, tag_name, without_hidden
from pageloom.functions.vocab import VOID_TAGS


def cluster_by_page(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Strip what is never shown, then hash-partition the pages by id.

    This is the only exchange the tree steps need: every later window, aggregation and join is keyed by
    ``page_id`` first. Scripts and styles are gone before the bytes move.
    """
    stripped = pages.selectExpr("page_id", f"{without_hidden('html')} as body")
    return stripped.repartition(partitions, "page_id") if partitions else stripped.repartition("page_id")


def tokens(pages: DataFrame, clustered: bool = False, partitions: int | None = None) -> DataFrame:
    """``page_id, pos, n_tokens, tok, kind, tag``; positions are dense and follow the document.

    ``kind`` is open, close, void, text or decl. Pass ``clustered=True`` when the pages come from a table
    bucketed by ``page_id``: then nothing is shuffled at all.
    """
    if clustered:
        pages = pages.selectExpr("page_id", f"{without_hidden('html')} as body")
    else:
        pages = cluster_by_page(pages, partitions)
    return (
        pages.selectExpr("page_id", f"{page_tokens('body')} as toks")
        # The outer form keeps Catalyst from adding a size filter that would cut every page a second time.
        .selectExpr("page_id", "size(toks) as n_tokens", "posexplode_outer(toks) as (pos, tok)")
        .filter("tok is not null")
        .selectExpr("page_id", "n_tokens", "pos", f"startswith(tok, '{PLAIN_MARK}') as plain", f"if(startswith(tok, '{PLAIN_MARK}'), substring(tok, 2), tok) as tok")
        .selectExpr("*", f"case when not plain and tok rlike '^</?[A-Za-z]' then {tag_name('tok')} else '' end as tag")
        .selectExpr(
            "page_id", "pos", "n_tokens", "tok",
            "case when not plain and tok rlike '^<[!?]' then 'decl' when tag = '' then 'text' when startswith(tok, '</') then 'close'"
            f" when {one_of('tag', VOID_TAGS)} then 'void' else 'open' end as kind",
            "tag",
        )
    )


def attributes(toks: DataFrame) -> DataFrame:
    """One row per attribute of every opening tag: ``page_id, pos, tag, attr_no, name, value``."""
    return (
        toks.filter("kind in ('open', 'void') and length(tok) > length(tag) + 2")
        .selectExpr("page_id", "pos", "tag", f"posexplode_outer({parse_attrs('tok', 'tag')}) as (attr_no, a)")
        .filter("a is not null")
        .selectExpr("page_id", "pos", "tag", "attr_no", "a.name", "a.value")
    )
