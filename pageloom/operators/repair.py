"""Repair media markup before the article is picked.

Order matters: pictures, wrappers, videos, placeholders. "Inside a removed element" is a running maximum
of end positions, because intervals nest; no step joins nodes with their descendants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pageloom.functions import text
from pageloom.functions.choice import media_choice
from pageloom.functions.markup import NO_ATTRS, attr, attrs_of
from pageloom.functions.vocab import NO_MEDIA_TEXT, PICTURE_TYPES
from pageloom.operators.tree import BEFORE, UPTO, exprs, last, over

def node_order(frame: str = "", order: str = "node_id") -> str:
    return over(frame, order=order)


def inside(removed: str, put_in: bool = False) -> str:
    """True for rows below an earlier row of the page for which ``removed`` holds. ``put_in``: rows have ``sub`` and ``sub_end``."""
    if put_in:
        ends = f"max(if({removed}, struct(end_id, sub_end), null)) {node_order(BEFORE, 'node_id, sub')}"
        return f"coalesce({ends} >= struct(node_id, sub), false)"
    return f"coalesce(max(if({removed}, end_id, null)) {node_order(BEFORE)} >= node_id, false)"


def media_sources(nodes: DataFrame, priority: Sequence[str] = PICTURE_TYPES) -> DataFrame:
    """Add ``choice`` (src, alt) to every picture, and to every video that has no source of its own."""
    video = f"tag = 'video' and coalesce({attr('attrs', 'src')}, '') = ''"
    return nodes.selectExpr(
        "*",
        f"case when tag = 'picture' then {media_choice('kids', True, priority)}"
        f" when {video} then {media_choice('kids', False)} end as choice",
    )


def replace_media(nodes: DataFrame, priority: Sequence[str] = PICTURE_TYPES) -> DataFrame:
    """Turn pictures into images and give videos their source."""
    image = attrs_of(src="choice.src", alt="nullif(choice.alt, '')")
    video = attrs_of(src="choice.src", controls="'controls'", title=f"nullif({attr('attrs', 'title')}, '')")
    return (
        media_sources(nodes, priority)
        .selectExpr("*", f"{inside('choice is not null')} as gone")
        .filter("not gone")
        .selectExpr(
            "page_id", "node_id", "end_id", "parent_id", "kind",
            "if(tag = 'picture' and choice is not null, 'img', tag) as tag",
            "tok",
            f"case when choice is null then attrs when tag = 'picture' then {image} else {video} end as attrs",
            "parent_tag", "wrapper_id",
            f"if(tag = 'video' and choice is not null, {text(NO_MEDIA_TEXT.format(kind='video'))}, null) as inner",
        )
    )


def unwrap_images(nodes: DataFrame) -> DataFrame:
    """Put an image inside the known double wrapper in the place of the outer wrapper."""
    keep = "(tag = 'img' and wrapper_id is not null)"
    # An image and its wrapper share a window, so the wrapper learns of the image without a join.
    members = f"over (partition by page_id, if({keep}, wrapper_id, node_id))"
    return (
        nodes.selectExpr("*", f"not {keep} and max(if({keep}, 1, 0)) {members} = 1 as is_outer")
        .selectExpr(
            "*",
            f"{inside('is_outer')} as gone",
            f"{last('if(is_outer, struct(parent_id, parent_tag), null)', node_order(BEFORE))} as outer",
        )
        .filter(f"not is_outer and (not gone or {keep})")
        .selectExpr(
            "page_id", "node_id", "end_id",
            f"if({keep} and gone, outer.parent_id, parent_id) as parent_id", "kind", "tag", "tok", "attrs",
            f"if({keep} and gone, outer.parent_tag, parent_tag) as parent_tag", "wrapper_id", "inner",
        )
    )


def placeholder_figures(nodes: DataFrame, per_figure: bool = False) -> DataFrame:
    """Figures with their image counts and the image to drop: ``page_id, figure_id, n_images,
    n_placeholders, active, placeholder_id, kept_id``.

    A figure without exactly two images, or with two placeholders, ends the search in its page unless
    ``per_figure`` is set. Images inside a figure are counted as the difference of a running count at the
    figure's two ends.
    """
    blank = (
        f"(contains(coalesce({attr('attrs', 'alt')}, ''), 'placeholder')"
        f" or contains(coalesce({attr('attrs', 'src')}, ''), 'placeholder'))"
    )
    at = over(UPTO, order="pos, side")
    figures = (
        nodes.filter("tag in ('figure', 'img')")
        .selectExpr(
            "page_id", "node_id", f"tag = 'img' and {blank} as blank",
            "explode_outer(if(tag = 'figure', array(named_struct('pos', node_id, 'side', 0), named_struct('pos', end_id, 'side', 2)),"
            " array(named_struct('pos', node_id, 'side', 1)))) as e",
        )
        .selectExpr("page_id", "node_id", "e.pos as pos", "e.side as side", "blank")
        .selectExpr(
            "*",
            f"sum(if(side = 1, 1, 0)) {at} as n",
            f"sum(if(blank, 1, 0)) {at} as n_blank",
            f"sum(if(side = 1, node_id, 0)) {at} as ids",
            f"sum(if(blank, node_id, 0)) {at} as blank_ids",
            f"max(if(side = 1, node_id, -1)) {at} as last_image",
        )
        .filter("side != 1")
        .groupBy("page_id", "node_id")
        .agg(*exprs(
            "max(n) - min(n) as n_images", "max(n_blank) - min(n_blank) as n_placeholders",
            "max(ids) - min(ids) as ids", "max(blank_ids) - min(blank_ids) as blank_ids",
            "max(last_image) as last_image",
        ))
    )
    stops = "(n_images != 2 or n_placeholders = 2)"
    active = f"not {stops}"
    if not per_figure:
        active = f"coalesce(node_id < min(if({stops}, node_id, null)) over (partition by page_id), true)"
    return figures.selectExpr("*", f"{active} as active").selectExpr(
        "page_id", "node_id as figure_id", "n_images", "n_placeholders", "active",
        "if(active and n_placeholders = 1, blank_ids, null) as placeholder_id",
        "if(active, if(n_placeholders = 1, ids - blank_ids, last_image), null) as kept_id",
    )


def remove_placeholders(nodes: DataFrame, per_figure: bool = False) -> DataFrame:
    """Drop placeholder images; a span right after the kept image becomes a paragraph of its text."""
    marks = (
        placeholder_figures(nodes, per_figure)
        .filter("active")
        .selectExpr(
            "page_id",
            "explode_outer(array(named_struct('id', placeholder_id, 'mark', 'drop'), named_struct('id', kept_id, 'mark', 'kept'))) as m",
        )
        .filter("m.id is not null")
        .groupBy("page_id", "m.id")
        .agg(*exprs("min(m.mark) as mark"))
        .selectExpr("page_id", "cast(id as int) as node_id", "mark")
    )
    before = last("if(kind = 'element', struct(mark, parent_id), null)", node_order(BEFORE))
    return (
        nodes.join(marks, ["page_id", "node_id"], "left")
        .filter("coalesce(mark, '') != 'drop'")
        .selectExpr("*", f"{before} as prev_element")
        .selectExpr(
            "*",
            "tag = 'span' and coalesce(prev_element.mark = 'kept', false) and prev_element.parent_id <=> parent_id as caption",
        )
        .selectExpr(
            "*",
            f"{inside('caption')} as in_caption",
            f"{last('if(caption, node_id, null)', node_order(BEFORE))} as caption_id",
        )
        .filter("not in_caption or kind = 'text'")
        .selectExpr(
            "page_id", "node_id", "end_id", "if(in_caption, caption_id, parent_id) as parent_id", "kind",
            "if(caption, 'p', tag) as tag", "tok", f"if(caption, {NO_ATTRS}, attrs) as attrs",
            "if(in_caption, 'p', parent_tag) as parent_tag", "wrapper_id", "inner",
        )
    )


def repair(nodes: DataFrame, priority: Sequence[str] = PICTURE_TYPES, per_figure: bool = False) -> DataFrame:
    """All repairs. ``nodes`` is read more than once; persist it in a job."""
    return (
        nodes.transform(replace_media, priority)
        .transform(unwrap_images)
        .transform(remove_placeholders, per_figure)
    )
