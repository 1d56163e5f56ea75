"""Replace frames and find the videos that quotes link to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pageloom.functions import one_of, text
from pageloom.functions.markup import ATTRS_TYPE, NO_ATTRS, attr, attrs_of, escape_text, open_tag
from pageloom.functions.media import MEDIA_FOLDER, download_path
from pageloom.functions.logs import media_kind
from pageloom.functions.urls import short_host
from pageloom.functions.vocab import NO_MEDIA_TEXT, QUOTE_HOSTS, VIDEO_HOSTS, VOID_TAGS
from pageloom.operators.lookup import salted_lookup
from pageloom.operators.repair import inside, node_order
from pageloom.operators.tree import BEFORE, UPTO, exprs, last, piece, render_parts

#: Rows to be put in: their columns, with whether they follow their target. A row of the page reaches beyond all of its last position.
PUT_IN_COLUMNS = ("sub", "sub_end", "kind", "tag", "tok", "attrs", "parent_tag")
PUT_IN_TYPE = f"struct<sub:int,sub_end:int,kind:string,tag:string,tok:string,attrs:{ATTRS_TYPE},parent_tag:string,follows:boolean>"
LAST_STEP = 2**31 - 1


def _followed(follows: str) -> str:
    return "named_struct(" + ", ".join(f"'{c}', r.{c}" for c in PUT_IN_COLUMNS) + f", 'follows', {follows})"


def find_embeds(content: DataFrame) -> DataFrame:
    """Frames, and links that end a quote: ``page_id, node_id, kind, target_id, url, host``.

    ``content`` carries ``root_id``, ``n_siblings`` and ``is_last``. A frame's target is the nearest element,
    from itself upwards, that has a sibling. Only children directly follow their parents in document
    order, so the target is the last row up to the frame that is no only child. A quote is a
    ``blockquote`` whose last child is a ``p`` whose last child is a link.
    """
    target = "if(n_siblings > 1 or parent_id <=> root_id, node_id, null)"
    host = short_host("url")
    return (
        content.selectExpr(
            "page_id", "node_id", "tag", "attrs", "parent_id", "parent_tag", "is_last",
            f"{last(target, node_order(UPTO))} as climb",
            f"{last("if(tag = 'p', struct(node_id, parent_id, parent_tag, is_last), null)", node_order(BEFORE))} as p",
        )
        .selectExpr(
            "page_id", "node_id",
            "case when tag = 'iframe' then 'frame'"
            " when tag = 'a' and is_last and parent_tag = 'p' and p.node_id = parent_id and p.is_last"
            " and p.parent_tag = 'blockquote' then 'quote' end as kind",
            "coalesce(climb, node_id) as climb", "p.parent_id as quote_id", "attrs",
        )
        .filter("kind is not null")
        .selectExpr(
            "page_id", "node_id", "kind", "if(kind = 'frame', climb, quote_id) as target_id",
            f"coalesce(if(kind = 'frame', {attr('attrs', 'src')}, {attr('attrs', 'href')}), '') as url",
        )
        .selectExpr("*", f"{host} as host")
    )


def embed_outcomes(
    embeds: DataFrame,
    chosen: DataFrame | None,
    video_hosts: Sequence[str] = VIDEO_HOSTS,
    quote_hosts: Sequence[str] = QUOTE_HOSTS,
    folder: str = MEDIA_FOLDER,
) -> DataFrame:
    """Join embeds to the chosen downloads and say what becomes of each.

    ``chosen`` has one row per ``media_url``, or per ``wish`` of embeds that carry one.
    ``action`` is link, media, none or reject. Embeds carry ``download_media``. A failed download of a
    frame rejects the page, one of a quote is passed over; an invalid address rejects it either way.
    """
    wanted = (
        f"download_media and host is not null and ((kind = 'frame' and {one_of('host', video_hosts)})"
        f" or (kind = 'quote' and {one_of('host', quote_hosts)}))"
    )
    key = "wish" if chosen is not None and "wish" in chosen.columns else "media_url"
    asked = "wish" if key == "wish" else "url"
    rows = embeds.selectExpr(*[c for c in embeds.columns if c != key], f"{wanted} as wanted", f"if({wanted}, {asked}, null) as {key}")
    if chosen is None:
        rows = rows.selectExpr("*", "cast(null as string) as outcome", "cast(null as string) as container")
    else:
        table = chosen.select(key, "outcome", "container")
        rows = salted_lookup(rows, table, key, "page_id")
    return rows.selectExpr(
        "page_id", "node_id", "kind", "target_id", "url", "host",
        "case when kind = 'quote' and not download_media then 'none' when host is null then 'reject'"
        " when wanted and outcome = 'chosen' then 'media'"
        " when wanted and kind = 'frame' then 'reject' when kind = 'frame' then 'link' else 'none' end as action",
        f"if(wanted and outcome = 'chosen', {download_path('url', 'container', folder)}, null) as media_path",
    )


def _row(first: int, last: int, tag: str, attrs: str = NO_ATTRS, tok: str = "''", parent: str = "''") -> str:
    """A row to be put in, which covers the steps ``first`` to ``last`` of its place. Without a tag it is text."""
    kind = "element" if tag else "text"
    name = tag if tag.startswith("(") else text(tag)
    return (
        f"named_struct('sub', {first}, 'sub_end', {last}, 'kind', '{kind}', 'tag', {name}, 'tok', {tok}, 'attrs',"
        f" {attrs if tag else f'cast(null as {ATTRS_TYPE})'}, 'parent_tag', {parent})"
    )


def embed_rows(outcomes: DataFrame) -> DataFrame:
    """Tree rows for each embed and where they go: ``page_id, target_id, place, rows``.

    ``place`` is replace or after. The rows of one place are numbered by steps (``sub`` to ``sub_end``), so that they nest like the
    rows of a page and can stand at one position of it.
    """
    kind = f"({media_kind('media_path')})"
    sentence = NO_MEDIA_TEXT.split("{kind}")
    # The sentence stands there twice, as two texts.
    note = f"repeat(concat({text(sentence[0])}, {kind}, {text(sentence[1])}), 2)"
    player = attrs_of(src="media_path", controls="'Controls'")
    link = attrs_of(href="url")
    label = lambda word: escape_text(f"concat('{word} ', host, '.')")
    quoted = [_row(1, 4, "p"), _row(2, 3, kind, player, parent="'p'")]
    played = [
        _row(1, 10, "figure"), _row(2, 4, kind, player, parent="'figure'"), _row(3, 3, "", tok=note, parent=kind),
        _row(5, 9, "figcaption", parent="'figure'"), _row(6, 8, "a", link, parent="'figcaption'"), _row(7, 7, "", tok=label("Watch on"), parent="'a'"),
    ]
    linked = [_row(1, 5, "p"), _row(2, 4, "a", link, parent="'p'"), _row(3, 3, "", tok=label("Visit"), parent="'a'")]
    rows = [f"array({', '.join(r)})" for r in (quoted, played, linked)]
    return outcomes.filter("action in ('link', 'media')").selectExpr(
        "page_id", "target_id", "if(kind = 'quote', 'after', 'replace') as place",
        f"case when kind = 'quote' then {rows[0]} when action = 'media' then {rows[1]} else {rows[2]} end as rows",
    )


def embed_markup(outcomes: DataFrame) -> DataFrame:
    """HTML of each embed alone: ``page_id, target_id, place, html``."""
    opened = piece("0", 0, "0", f"if(r.kind = 'element', {open_tag('r.tag', 'r.attrs')}, r.tok)", "r.sub")
    closed = f"if(r.kind = 'element', {piece('0', 0, '0', "concat('</', r.tag, '>')", 'r.sub_end')}, null)"
    pieces = f"filter(flatten(transform(rows, r -> array({opened}, {closed}))), p -> p is not null)"
    return embed_rows(outcomes).selectExpr("page_id", "target_id", "place", f"array_join(transform(array_sort({pieces}), p -> p.html), '') as html")


def apply_embeds(content: DataFrame, rows: DataFrame) -> DataFrame:
    """Put the rows of embeds into the content, in place of their target and all it contains, or right after it.

    All rows get ``sub``, ``sub_end`` and ``anchor``. Rows of the page have sub 0. Rows put in have the position of their target, or
    its last one where they follow it, and their steps; ``anchor`` is then the target, after whose end tag they stand, before
    those of elements around it. Later steps see them like any other rows. Nothing is shuffled: a row becomes several in its place.
    """
    per_target = rows.groupBy("page_id", "target_id").agg(*exprs(
        "max(if(place = 'replace', rows, null)) as instead",
        "max(if(place = 'after', rows, null)) as after",
    )).withColumnRenamed("target_id", "node_id")
    none = f"cast(array() as array<{PUT_IN_TYPE}>)"
    marked = lambda name, follows: f"coalesce(transform({name}, r -> {_followed(follows)}), {none})"
    several = f"concat(if(instead is null, array(cast(null as {PUT_IN_TYPE})), {none}), {marked('instead', 'false')}, {marked('after', 'true')})"
    made = (
        content.join(per_target, ["page_id", "node_id"], "left")
        .selectExpr("*", f"{inside('instead is not null')} as gone")
        .filter("not gone")
        .selectExpr("*", f"explode_outer(if(instead is null and after is null, null, {several})) as e")
    )
    own = [c for c in content.columns if c not in {"page_id", "node_id", "end_id", *PUT_IN_COLUMNS, "parent_id", "inner", "n_siblings"}]
    at = "if(e.follows, end_id, node_id)"
    return made.selectExpr(
        "page_id", f"if(e is null, node_id, {at}) as node_id", f"if(e is null, end_id, {at}) as end_id",
        "coalesce(e.sub, 0) as sub", f"case when e is not null then e.sub_end when after is not null then 0 else {LAST_STEP} end as sub_end",
        "if(e.follows, node_id, null) as anchor",
        "if(e is null or e.sub = 1, parent_id, node_id) as parent_id", "if(e is null, inner, null) as inner",
        "if(e is null or e.sub = 1, n_siblings, 1) as n_siblings",
        *[f"if(e is null, {c}, e.{c}) as {c}" for c in ("kind", "tag", "tok", "attrs")],
        "if(e is null or e.sub = 1, parent_tag, e.parent_tag) as parent_tag", *own,
    )


def content_parts() -> str:
    """Pieces of HTML of a content row, repairs and rows put in among them."""
    plain = render_parts(True)
    inner = f"if(inner is not null, array({piece('node_id', 0, '1', 'inner')}), array())"
    step, order = "if(anchor is null, 0, 1)", "if(anchor is null, 0, -anchor)"
    opened = piece("node_id", step, order, f"if(kind = 'element', {open_tag('tag', 'attrs')}, tok)", "sub")
    closed = piece("node_id", step, order, "concat('</', tag, '>')", "sub_end")
    return f"if(sub > 0, array({opened}, if(kind = 'element' and not {one_of('tag', VOID_TAGS)}, {closed}, null)), concat({plain}, {inner}))"
