"""Build the element tree of every page as interval-encoded rows, and write it back as HTML.

A node covers the token positions ``node_id`` to ``end_id``; descendants lie inside. The steps are
windows over one page, all on the page clustering of the token scan:

1. an end tag is paired with the start tag of its name that it balances (phrase tags only within a run
   between two block tags); end tags that balance nothing are dropped;
2. a ``p``, and an unclosed ``li dt dd td th``, reaches to the next block tag;
3. a container left open outside every closed element (a cut-off page) reaches to the end of the page;
4. any other unclosed element is empty, and what follows stays with the enclosing element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions import one_of
from pageloom.functions.markup import attr, has_class, open_tag, parse_attrs
from pageloom.functions.vocab import BLOCK_TAGS, OPTIONAL_END_TAGS, PAGE_LONG_TAGS, PHRASE_TAGS, VOID_TAGS

MEDIA_PARENTS = ("picture", "video")
WRAPPER_CLASS = "image-wrapper"
OUTER_WRAPPER_CLASS = "mediaplay-image"

UPTO = "rows between unbounded preceding and current row"
BEFORE = "rows between unbounded preceding and 1 preceding"


def over(frame: str = "", keys: str = "page_id", order: str = "pos") -> str:
    return f"over (partition by {keys} order by {order} {frame})"


def last(value: str, window: str) -> str:
    return f"last({value}, true) {window}"


def _paired(toks: DataFrame) -> DataFrame:
    """Drop what builds no tree; mark the start tags that have an end tag."""
    own = "page_id, tag, scope"
    p_end = "(tag = 'p' and kind = 'close')"
    step = "case when tag = 'p' then 0 when kind = 'open' then 1 when kind = 'close' then -1 else 0 end"
    # Level within its own tag; an end tag at level 0 has no start tag.
    level = "run - least(0, coalesce(low, 0)) + if(kind = 'close', 1, 0)"
    return (
        toks.filter("kind != 'decl'")
        .selectExpr("*", f"kind in ('open', 'close', 'void') and {one_of('tag', BLOCK_TAGS)} as is_block")
        .selectExpr(
            "*",
            f"sum(cast(is_block as int)) {over(UPTO)} as block_no",
            f"{last('if(is_block, struct(pos, tag, kind), null)', over(BEFORE))} as prev_block",
        )
        .filter(
            f"not (kind = 'close' and {one_of('tag', VOID_TAGS)}) and (not {p_end}"
            " or coalesce(prev_block.tag = 'p' and prev_block.kind = 'open', false))"
        )
        .selectExpr(
            "page_id", "pos", "n_tokens", "tok", "kind", "tag", "is_block",
            f"if({p_end}, prev_block.pos, null) as p_pos",
            f"if({one_of('tag', PHRASE_TAGS)}, block_no, -1) as scope",
        )
        .selectExpr("*", f"sum({step}) {over(UPTO, own)} as run")
        .selectExpr("*", f"min(run) {over(BEFORE, own)} as low")
        .selectExpr("*", f"if(tag = 'p', 1, {level}) as tag_level")
        .selectExpr(
            "page_id", "pos", "n_tokens", "tok", "kind", "tag", "is_block", "p_pos", "tag_level",
            f"coalesce(lead(kind) {over('', own + ', tag_level')} = 'close', false) as closed",
        )
        .filter("kind != 'close' or tag_level > 0")
    )


def _levels(rows: DataFrame) -> DataFrame:
    """Role and level of every remaining token."""
    step = "case when tag = 'p' then 0 when kind = 'open' and closed then 1 when kind = 'close' then -1 else 0 end"
    role = (
        "case when kind = 'close' then 'close' when kind != 'open' then 'leaf' when tag = 'p' then 'short'"
        f" when closed then 'node' when {one_of('tag', OPTIONAL_END_TAGS)} then 'short'"
        f" when base = 0 and {one_of('tag', PAGE_LONG_TAGS)} then 'long' else 'leaf' end"
    )
    return (
        rows.selectExpr("*", f"sum({step}) {over(UPTO)} as base")
        .selectExpr("*", f"{role} as role")
        .selectExpr(
            "*",
            f"{last("if(is_block, named_struct('pos', pos, 'short', role = 'short'), null)", over(UPTO))} as block",
            f"sum(if(role = 'long', 1, 0)) {over(UPTO)} as n_long",
            f"lag(role) {over()} as prev_role",
            f"lead(role) {over()} as next_role",
            f"lead(is_block) {over()} as next_block",
        )
        .selectExpr("*", "if(coalesce(block.short and block.pos != pos, false), 1, 0) as in_short")
        .selectExpr(
            "page_id", "pos", "n_tokens", "tok", "kind", "tag", "p_pos", "role", "n_long", "block.pos as block_pos",
            "base + in_short + if(role = 'node', 0, 1) as level",
            # The parent ends right after this token, or the page does.
            "next_role is null or next_role = 'close' or (in_short = 1 and next_block) as ends",
            "prev_role is null or prev_role in ('node', 'long') or (prev_role = 'short' and not is_block) as is_first",
            "(role = 'short' or in_short = 1) and coalesce(next_block, true) as short_end",
        )
    )


def build_nodes(toks: DataFrame) -> DataFrame:
    """Tree rows, one per element and text.

    ``page_id, node_id, end_id, parent_id, depth, sib_no, kind, tag, tok, attrs, parent_tag, only_child,
    last_child, explicit_end, wrapper_id, kids``. ``kids`` holds the element children of a picture or
    video; ``wrapper_id`` is the grandparent of an image inside the known double wrapper.
    """
    may_wrap = f"kind = 'open' and (contains(tok, '{WRAPPER_CLASS}') or contains(tok, '{OUTER_WRAPPER_CLASS}'))"
    part = lambda at, name: f"named_struct('at', cast({at} as bigint), 'part', '{name}')"
    # A start tag is read at its parent's level and provides a parent at its own.
    parts = (
        f"array(if(role = 'close', {part("if(tag = 'p', -9, level)", 'close')}, {part('level - 1', 'child')}),"
        f" if(role in ('node', 'short'), {part('level', 'self')}, null),"
        f" if(tag in ('img', 'picture') and role != 'close', {part('level - 2', 'grand')}, null),"
        f" if(short_end, {part('-9', 'extent')}, null))"
    )
    given = (
        f"struct(pos, tag, n_child, {has_class('classes', WRAPPER_CLASS)} as wraps,"
        f" {has_class('classes', OUTER_WRAPPER_CLASS)} as outer)"
    )
    gives = "part = 'self' or (part = 'child' and role = 'long')"
    level = over("", "page_id, at")
    key = (
        "case part when 'close' then coalesce(p_pos, owner.pos) when 'extent' then block_pos else pos end"
    )
    is_kid = f"part = 'child' and tag != '' and {one_of('owner.tag', MEDIA_PARENTS)}"
    node = (
        "struct(kind, tag, tok, role, n_tokens, ends, is_first, level + n_long - if(role = 'long', 1, 0) as depth,"
        " owner.pos as parent_id, owner.tag as parent_tag, coalesce(owner.wraps, false) as in_wrapper,"
        " n_child - coalesce(owner.n_child, 0) as sib_no)"
    )
    return (
        _levels(_paired(toks))
        .selectExpr("*", f"if({may_wrap}, {attr(parse_attrs('tok', 'tag'), 'class')}, null) as classes")
        .selectExpr("*", f"explode_outer({parts}) as p")
        .filter("p is not null")
        .selectExpr("*", "p.at as at", "p.part as part")
        .selectExpr("*", f"sum(if(part = 'child', 1, 0)) {level.replace(')', UPTO + ')')} as n_child")
        .selectExpr("*", f"{last(f'if({gives}, {given}, null)', level.replace(')', BEFORE + ')'))} as owner")
        # Negative keys carry a child up to its media parent.
        .selectExpr("*", f"explode_outer(if({is_kid}, array({key}, -owner.pos - 1), array({key}))) as key")
        .selectExpr("*", "key < 0 as is_kid", "if(key < 0, -key - 1, key) as node_id")
        .groupBy("page_id", "node_id")
        .agg(
            *exprs(
                f"max(if(part = 'child' and not is_kid, {node}, null)) as n",
                "max(if(part = 'close', struct(pos, ends), null)) as closer",
                "max(if(part = 'extent', struct(pos, ends), null)) as extent",
                "max(if(part = 'grand' and owner.outer, owner.pos, null)) as outer_id",
                "collect_list(if(is_kid, struct(pos, tag, tok), null)) as kids",
            )
        )
        .filter("n is not null")
        .selectExpr(
            "page_id", "node_id",
            "if(n.role = 'long', n.n_tokens - 1, coalesce(closer.pos, extent.pos, node_id)) as end_id",
            "n.parent_id", "n.depth", "n.sib_no",
            "if(n.kind = 'text', 'text', 'element') as kind",
            "n.tag", "n.tok",
            f"if(n.kind = 'text', null, {parse_attrs('n.tok', 'n.tag')}) as attrs",
            "n.parent_tag",
            "n.is_first and (n.role = 'long' or coalesce(closer.ends, extent.ends, n.ends)) as only_child",
            "n.role = 'long' or coalesce(closer.ends, extent.ends, n.ends) as last_child",
            "closer.pos is not null as explicit_end",
            "if(n.in_wrapper, outer_id, null) as wrapper_id",
            "array_sort(kids) as kids",
        )
    )


def exprs(*sql: str) -> list:
    from pyspark.sql import functions as F

    return [F.expr(s) for s in sql]


def node_attributes(nodes: DataFrame) -> DataFrame:
    """Attributes of tree rows as rows: ``page_id, node_id, attr_no, name, value``."""
    return (
        nodes.selectExpr("page_id", "node_id", "posexplode_outer(attrs) as (attr_no, a)")
        .filter("a is not null")
        .selectExpr("page_id", "node_id", "attr_no", "a.name", "a.value")
    )


def piece(pos: str, step: int | str, order: str, html: str, sub: str = "0") -> str:
    return f"named_struct('pos', cast({pos} as int), 'step', {step}, 'order', cast({order} as int), 'sub', {sub}, 'html', {html})"


def render_parts(rewritten: bool) -> str:
    """Pieces of HTML a tree row puts out, as an array.

    Sorting the pieces of a subtree by their fields gives its text in document order, with the end tags
    of elements that end together written from the inside out. ``sub`` orders pieces that were put in at one place.
    """
    start = open_tag("tag", "attrs") if rewritten else "tok"
    # A stray bracket is text; written as it stands it could open a tag once an element beside it is dropped.
    shown = "replace(replace(tok, '<', '&lt;'), '>', '&gt;')" if rewritten else "tok"
    end = piece("end_id", 1, "-node_id", "concat('</', tag, '>')")
    return (
        f"array({piece('node_id', 0, '0', f"if(kind = 'element', {start}, {shown})")},"
        f" if(kind = 'element' and not {one_of('tag', VOID_TAGS)}, {end}, null))"
    )


def assemble(rows: DataFrame, keys: list[str], parts: str, name: str) -> DataFrame:
    """Concatenate the pieces of each group in document order. A group is one page or one subtree."""
    return (
        rows.selectExpr(*keys, f"explode_outer({parts}) as piece")
        .filter("piece is not null")
        .groupBy(*keys)
        .agg(*exprs("array_sort(collect_list(piece)) as pieces"))
        .selectExpr(*keys, f"array_join(transform(pieces, p -> p.html), '') as {name}")
    )


def serialize(nodes: DataFrame, name: str = "html") -> DataFrame:
    """Whole pages back to HTML: ``page_id, html``. Left-out end tags are written."""
    return assemble(nodes, ["page_id"], render_parts(False), name)
