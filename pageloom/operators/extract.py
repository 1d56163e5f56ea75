"""Pick the article of every page, its text and its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions import one_of
from pageloom.functions.markup import attr, unescape
from pageloom.functions.urls import address, resolved
from pageloom.operators.repair import node_order
from pageloom.operators.tree import BEFORE, UPTO, assemble, exprs, last, piece

MIN_PARAGRAPH = 25


def article_roots(nodes: DataFrame) -> DataFrame:
    """The element that holds the article: ``page_id, root_id, score``.

    Every paragraph of 25 characters or more scores ``(1 + commas + min(length / 100, 3)) * (1 - share of
    link text)`` for its parent, as reader modes do; the best parent wins, the earlier one on a tie. Pages
    without such paragraphs fall back to ``article``, then ``body``, then the whole page (-1). The three
    aggregations are all clustered by page.
    """
    length = "length(trim(tok))"
    paragraph = (
        "cast(round((1 + commas + least(len / 100.0D, 3.0D)) * (1.0D - link_len / len), 6) as decimal(20,6))"
    )
    return (
        nodes.selectExpr(
            "page_id", "node_id", "kind", "tag",
            f"{last("if(tag = 'p', struct(node_id, end_id, parent_id), null)", node_order(UPTO))} as p",
            f"coalesce(max(if(tag = 'a', end_id, null)) {node_order(BEFORE)} >= node_id, false) as linked",
            f"if(kind = 'text', {length}, 0) as len",
            "if(kind = 'text', length(tok) - length(replace(tok, ',', '')), 0) as commas",
        )
        .selectExpr("*", "kind = 'text' and coalesce(node_id <= p.end_id, false) as in_p")
        .groupBy("page_id", *exprs("if(in_p, p.node_id, -1) as p_id", "if(in_p, coalesce(p.parent_id, -1), -1) as box"))
        .agg(*exprs(
            "sum(len) as len", "sum(if(linked, len, 0)) as link_len", "sum(commas) as commas",
            "min(if(tag = 'article', node_id, null)) as article_id", "min(if(tag = 'body', node_id, null)) as body_id",
        ))
        .groupBy("page_id", "box")
        .agg(*exprs(
            f"sum(if(p_id >= 0 and len >= {MIN_PARAGRAPH}, {paragraph}, null)) as score",
            "min(article_id) as article_id", "min(body_id) as body_id",
        ))
        .groupBy("page_id")
        .agg(*exprs(
            "max(if(score > 0, struct(score, -box as rank), null)) as best",
            "min(article_id) as article_id", "min(body_id) as body_id",
        ))
        .selectExpr("page_id", "coalesce(-best.rank, article_id, body_id, -1) as root_id", "best.score as score")
    )


def article_content(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows below the article root of their page, with ``root_id``."""
    root_end = f"max(if(node_id = root_id, end_id, null)) {node_order(UPTO)}"
    return (
        nodes.join(roots.select("page_id", "root_id"), "page_id")
        .selectExpr("*", f"node_id > root_id and (root_id = -1 or {root_end} >= node_id) as inside_root")
        .filter("inside_root")
        .drop("inside_root")
    )


def article_text(content: DataFrame) -> DataFrame:
    """Plain text of the article: ``page_id, text_content``."""
    return assemble(
        content.filter("kind = 'text'"),
        ["page_id"],
        f"array({piece('node_id', 0, '0', unescape('tok'))})",
        "text_content",
    )


def metadata(nodes: DataFrame) -> DataFrame:
    """What a page says about itself: ``page_id, title, byline, site_name, published_time, lang, excerpt``.

    One pass: every field is the value with the best rank among the tags that can give it.
    """
    name = f"lower(coalesce({attr('attrs', 'property')}, {attr('attrs', 'name')}, ''))"
    ranks = {
        "title": ("og:title", "dc:title", "twitter:title"),
        "byline": ("author", "article:author", "dc:creator"),
        "site_name": ("og:site_name",),
        "published_time": ("article:published_time", "parsely-pub-date"),
        "excerpt": ("description", "og:description", "twitter:description"),
    }
    # A stray bracket cuts the text of an element into several rows.
    whole = (
        "array_join(collect_list(if(kind = 'text', tok, null)) over (partition by page_id, parent_id order by node_id"
        " rows between unbounded preceding and unbounded following), '')"
    )
    rows = nodes.filter("tag in ('meta', 'html') or (kind = 'text' and parent_tag in ('title', 'h1'))").selectExpr(
        "page_id", "node_id", "kind", "tag", "parent_tag",
        f"if(tag = 'meta', {name}, null) as name",
        f"case when kind = 'text' then trim(regexp_replace({unescape(whole)}, r'\\s+', ' '))"
        f" when tag = 'meta' then nullif({attr('attrs', 'content')}, '') else nullif({attr('attrs', 'lang')}, '') end as value",
    )

    def best(field: str) -> str:
        rank = " ".join(f"when name = '{n}' then {i}" for i, n in enumerate(ranks[field]))
        other = "when parent_tag = 'title' then 8 when parent_tag = 'h1' then 9" if field == "title" else ""
        match = one_of("name", ranks[field]) + (" or parent_tag in ('title', 'h1')" if field == "title" else "")
        return (
            f"min(if(value != '' and ({match}), struct(case {rank} {other} end as rank, node_id, value), null)).value as {field}"
        )

    lang = "min(if(tag = 'html' and value != '', struct(node_id, value), null)).value as lang"
    return rows.groupBy("page_id").agg(*exprs(*[best(f) for f in ranks], lang))


def resolve_links(content: DataFrame, urls: DataFrame) -> DataFrame:
    """Make the ``href`` of links and the ``src`` of media absolute. ``urls`` is ``page_id, url``."""
    linked = (
        "(a.name = 'href' and tag = 'a') or (a.name = 'src' and tag in ('img', 'video', 'audio', 'source', 'iframe', 'input'))"
    )
    one = (
        f"if(({linked}) and a.value is not null,"
        f" named_struct('name', a.name, 'value', {resolved('page', 'a.value')}), a)"
    )
    fix = f"if(exists(attrs, a -> {linked}), transform(attrs, a -> {one}), attrs)"
    return (
        content.join(urls.selectExpr("page_id", f"{address('url')} as page"), "page_id")
        .withColumns(dict(zip(("attrs",), exprs(fix))))
        .drop("page")
    )


def with_family(content: DataFrame) -> DataFrame:
    """Add ``n_siblings`` (children of the same parent) and ``is_last`` among them."""
    family = "over (partition by page_id, parent_id)"
    return content.selectExpr("*", f"count(*) {family} as n_siblings", f"max(node_id) {family} = node_id as is_last")


def below_single_divs(content: DataFrame) -> DataFrame:
    """Descend while the content is one single ``div``: drop that leading chain of wrappers.

    Below the root, such wrappers are the first rows of the page, so the first row that is not one ends
    the chain; nothing is joined and nothing loops.
    """
    order = "node_id, sub" if "sub" in content.columns else "node_id"
    return (
        content.selectExpr("*", f"sum(if(not (n_siblings = 1 and tag = 'div'), 1, 0)) {node_order(UPTO, order)} as stops")
        .filter("stops > 0")
        .drop("stops")
    )
