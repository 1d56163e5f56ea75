"""Remove active content and keep only listed attributes and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pageloom.functions import one_of, pattern, text
from pageloom.functions.media import canonical_extension, local_href, reference_kind
from pageloom.functions.markup import NO_ATTRS, attr
from pageloom.functions.vocab import ALLOWED_ATTRIBUTES, ALLOWED_LEGACY_TAGS, LINK_ATTRIBUTES, SAFE_TAGS, UNSAFE_TAGS
from pageloom.operators.lookup import salted_lookup
from pageloom.operators.repair import inside
from pageloom.operators.tree import exprs

LOCAL_SRC_TAGS = "video", "audio", "img", "image"
INLINE_DATA_TAGS = "audio", "video", "img", "source", "image", "track"
SAFE_SCHEME = pattern(r"(?i)^\s*(?:(?:https?|ftps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$))")


def html_names(names: Sequence[str]) -> list[str]:
    """Listed names as they are written in HTML: ``className`` stands for ``class``."""
    return sorted({"class" if n == "className" else n for n in names})


def is_safe(tag: str, name: str, value: str, keep: str = "false") -> str:
    """True for an attribute the sanitizer keeps. ``keep`` is a further exemption of the caller's."""
    local = f"({name} = 'src' and {one_of(tag, LOCAL_SRC_TAGS)} and startswith({value}, 'file://'))"
    inline = f"({name} = 'src' and {one_of(tag, INLINE_DATA_TAGS)} and startswith({value}, 'data:'))"
    # Browsers skip white space and control characters inside a scheme.
    bare = f"regexp_replace({value}, {pattern(r'[\x00-\x20\x7F-\xA0\u2028\u2029\uFEFF]')}, '')"
    address = f"not {one_of(name, LINK_ATTRIBUTES)} or coalesce({value}, '') = '' or {bare} rlike {SAFE_SCHEME}"
    return f"(coalesce({keep}, false) or (not startswith({name}, 'on') and coalesce({local} or {inline} or {address}, true)))"


def drop_unsafe(content: DataFrame, unsafe: Sequence[str] = UNSAFE_TAGS, safe: Sequence[str] = SAFE_TAGS) -> DataFrame:
    """Drop unsafe elements with all they contain; of other elements that are not listed as safe only the content stays."""
    return (
        content.selectExpr("*", f"kind = 'element' and {one_of('tag', unsafe)} as bad")
        .selectExpr("*", f"{inside('bad', 'sub' in content.columns)} as gone")
        .filter(f"not gone and not bad and (kind = 'text' or {one_of('tag', safe)})")
        .drop("gone", "bad")
    )


def clean_value(name: str, value: str) -> str:
    """Written value of a kept attribute; a bare ``controls`` gets one."""
    return f"if({name} = 'controls' and lower(coalesce({value}, '')) in ('', 'controls'), 'Controls', {value})"


def keep_listed(attrs: DataFrame, allowed: DataFrame | None = None, keep: str = "false") -> DataFrame:
    """Sanitize and filter attribute rows (``tag, name, value`` and keys).

    ``allowed`` is a DataFrame with a ``name`` column; its join carries no hint, so Spark broadcasts it only
    when it is small. The shipped list is a set test in the scan.
    """
    rows = attrs.filter(is_safe("tag", "name", "value", keep)).filter("name != 'type' or value <=> 'script'")
    if allowed is None:
        rows = rows.filter(one_of("name", html_names(ALLOWED_ATTRIBUTES)))
    else:
        rows = rows.join(allowed.select("name").distinct(), "name", "left_semi")
    return rows.withColumns(dict(zip(("value",), exprs(clean_value("name", "value")))))


def listed(rows: DataFrame, key: str, names: DataFrame, mark: str) -> DataFrame:
    """Add ``mark``: whether ``key`` is among the ``name`` of a table. ``className`` stands for ``class``; common names are spread
    over tasks, and the table's size is Spark's to check."""
    table = names.selectExpr(f"if(name = 'className', 'class', name) as {key}").distinct().selectExpr(key, f"true as {mark}")
    return salted_lookup(rows, table, key, "page_id").selectExpr(*rows.columns, f"coalesce({mark}, false) as {mark}")


def _listed_attributes(content: DataFrame, names: DataFrame) -> DataFrame:
    """Keep the attributes whose names are in a table: as rows, which are put together again by element."""
    keys = ["page_id", "node_id", "sub"] if "sub" in content.columns else ["page_id", "node_id"]
    rows = content.selectExpr(*keys, "posexplode(attrs) as (attr_no, a)").selectExpr(*keys, "attr_no", "a.name as name", "a")
    kept = listed(rows, "name", names, "is_listed").filter("is_listed").groupBy(*keys)
    kept = kept.agg(*exprs("transform(array_sort(collect_list(struct(attr_no, a))), x -> x.a) as listed_attrs"))
    joined = content.join(kept, keys, "left")
    return joined.selectExpr(*[f"if(attrs is null, null, coalesce(listed_attrs, {NO_ATTRS})) as attrs" if c == "attrs" else c for c in content.columns])


def clean_attributes(
    content: DataFrame, allowed: Sequence[str] | DataFrame = ALLOWED_ATTRIBUTES, keep: str = "false"
) -> DataFrame:
    """The same rules on the attribute arrays of content rows; images get a text when they have none. The list may be a table."""
    if isinstance(allowed, DataFrame):
        content, by_name = _listed_attributes(content, allowed), "true"
    else:
        by_name = one_of("a.name", html_names(allowed))
    kept = (
        f"filter(attrs, a -> {is_safe('tag', 'a.name', 'a.value', keep)} and (a.name != 'type' or a.value <=> 'script')"
        f" and {by_name})"
    )
    valued = f"transform({kept}, a -> named_struct('name', a.name, 'value', {clean_value('a.name', 'a.value')}))"
    missing = f"tag = 'img' and coalesce({attr('attrs', 'alt')}, '') = ''"
    alt = "array(named_struct('name', 'alt', 'value', 'image-placeholder'))"
    return content.withColumns(dict(zip(("attrs",), exprs(valued)))).withColumns(dict(zip(("attrs",), exprs(
        f"if({missing}, concat(filter(attrs, a -> a.name != 'alt'), {alt}), attrs)"
    ))))


def legacy_tags(content: DataFrame, allowed: Sequence[str] | DataFrame = ALLOWED_LEGACY_TAGS) -> DataFrame:
    """Version 2 output: a tag that is not listed becomes ``div``. The list may be a table."""
    if isinstance(allowed, DataFrame):
        rows = listed(content, "tag", allowed, "is_listed")
        return rows.selectExpr(*["if(kind = 'element' and not is_listed, 'div', tag) as tag" if c == "tag" else c for c in content.columns])
    mapped = f"if(kind = 'element' and not {one_of('tag', allowed)}, 'div', tag)"
    return content.withColumns(dict(zip(("tag",), exprs(mapped))))


def localize_media(content: DataFrame, version: int = 3, references: DataFrame | None = None) -> DataFrame:
    """Point the ``src`` of every media element at its file inside the book.

    File ids are hashes of book, kind and address, so the rewrite needs no join with the media table. In version 2 players are no
    media: a downloaded file that nothing in the book stands for is not pointed at either. ``references`` has the extensions of
    media elements (``book_id, node_id, sub, extension``) where they come from a table of types.
    """
    kind, extension = reference_kind("tag", version), canonical_extension("a.value")
    if references is not None:
        found = references.selectExpr("book_id as page_id", "node_id", "pos.sub as sub", "extension as found_extension")
        content, extension = content.join(found, ["page_id", "node_id", "sub"], "left"), "found_extension"
    known = f"a.name = 'src' and {kind} is not null and {extension} is not null"
    local = local_href("page_id", kind, "a.value", extension)
    fixed = f"transform(attrs, a -> if({known}, named_struct('name', a.name, 'value', {local}), a))"
    if version == 2:
        fixed = f"filter({fixed}, a -> not (a.name = 'src' and {kind} is null and startswith(a.value, 'file://')))"
    return content.withColumns(dict(zip(("attrs",), exprs(fixed)))).drop("found_extension")
