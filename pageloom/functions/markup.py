"""Expressions over tag text: tag names, attribute lists, character references."""

from __future__ import annotations

from pageloom.functions import let, pattern, text
from pageloom.functions.vocab import ENTITIES

# The rest of a start tag, with quoted values that may hold angle brackets. The possessive quantifiers keep matching linear
# and free of recursion on hostile pages.
_REST = r"""[^<>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^<>=]*+)*+>"""
_START = r"(?=[\s/>])" + _REST
# Content up to the element's own end tag, or to the end of the page: the only way out of an element of plain text.
_OWN_CONTENT = r"[^<]*+(?:<(?!/{name}[\s/>])[^<]*+)*+"
# Cut before tags are read, by what is kept in groups 1 and 3: elements of plain text stay whole, so nothing inside them counts
# as a comment or a script; a frame keeps its tags without content; comments and elements that are never shown go.
HIDDEN = pattern(
    r"(?is)(?=<[!a-z])(?:(<(title|textarea|xmp)" + _START + _OWN_CONTENT.replace("{name}", r"\2") + r"|<plaintext" + _START + r".*+)"
    r"|(<iframe" + _START + r")" + _OWN_CONTENT.replace("{name}", "iframe")
    + r"|<!--.*?(?:-->|\z)|<(script|style|noscript|noframes|noembed)(?=[\s/>])[^>]*+>.*?(?:</\4\s*+>|\z))"
)
# Start tags of elements of plain text whose content could be taken for markup.
PLAIN_START = r"(?=<[A-Za-z])(?i:<(title|textarea)" + _START + r"(?=[^<]*+<(?!/\1[\s/>]))|<(xmp)" + _START + r"(?!</\2[\s/>])|<plaintext" + _START + r"(?=.))"
# The same with their content, as one token; a tag; a declaration; text; a stray bracket.
_PLAIN = (
    r"(?=<)(?is:<(title|textarea)" + _START + r"(?=[^<]*+<(?!/\1[\s/>]))" + _OWN_CONTENT.replace("{name}", r"\1")
    + r"|<(xmp)" + _START + r"(?!</\2[\s/>])" + _OWN_CONTENT.replace("{name}", r"\2") + r"|<plaintext" + _START + r".++)"
)
_TAG = r"</?[A-Za-z]" + _REST + r"|<[!?][^<>]*+>|[^<]++|<"
TOKEN = pattern(_TAG)
PLAIN_OR_TOKEN = pattern(_PLAIN + "|" + _TAG)
# Before the text of such an element, which is no markup whatever it looks like. Pages cannot hold this character.
PLAIN_MARK = "\\u0000"
TAG_NAME = pattern(r"^</?([A-Za-z][A-Za-z0-9:_.\-]*)")
TAG_INSIDE = pattern(r"(?s)^<[A-Za-z][A-Za-z0-9:_.\-]*(.*?)/?>$")
ATTRIBUTE = pattern(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+))?""")
ATTRS_TYPE = "array<struct<name:string,value:string>>"
NO_ATTRS = f"cast(array() as {ATTRS_TYPE})"
NAMED = f"map({', '.join(text(x) for pair in ENTITIES.items() for x in pair)})"


def tag_name(tok: str) -> str:
    return f"lower(regexp_extract({tok}, {TAG_NAME}, 1))"


def without_hidden(html: str) -> str:
    """The page without comments, scripts, styles and what else is never shown."""
    return f"regexp_replace({html}, {HIDDEN}, '$1$3')"


def page_tokens(body: str) -> str:
    """Tags and texts in order. The content of ``title``, ``textarea``, ``xmp`` and ``plaintext`` is one text, marked by a first
    ``PLAIN_MARK`` where it could be taken for markup; few pages have such content, the others are cut by one pattern."""
    start = f"regexp_extract(t, {pattern('(?s)^' + PLAIN_START)}, 0)"
    # In xmp and plaintext a reference is not decoded either.
    inner = f"substring(t, length({start}) + 1)"
    written = f"if({start} rlike '(?i)^<(xmp|plaintext)', replace({inner}, '&', '&amp;'), {inner})"
    split_up = f"if(t rlike {pattern('(?s)^' + PLAIN_START)}, array({start}, concat('{PLAIN_MARK}', {written})), array(t))"
    marked = f"flatten(transform(regexp_extract_all({body}, {PLAIN_OR_TOKEN}, 0), t -> {split_up}))"
    return f"if({body} rlike {pattern('(?s)' + PLAIN_START)}, {marked}, regexp_extract_all({body}, {TOKEN}, 0))"


def unescape(value: str) -> str:
    """Decode named and numeric character references; unknown ones stay as written."""
    ref = "regexp_extract(piece, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
    digits = "case when ref rlike '^#[xX]' then upper(substring(ref, 3)) else hex(try_cast(substring(ref, 2) as bigint)) end"
    point = f"try_cast(conv({digits}, 16, 10) as bigint)"
    valid = f"({point} between 1 and 55295 or {point} between 57344 and 1114111)"
    char = f"decode(unhex(lpad({digits}, 8, '0')), 'UTF-32')"
    decoded = (
        f"case when try_element_at({NAMED}, ref) is not null then concat(try_element_at({NAMED}, ref), substring(piece, length(ref) + 2))"
        f" when startswith(ref, '#') and {valid} then concat({char}, substring(piece, length(ref) + 2))"
        " else concat('&', piece) end"
    )
    pieces = f"transform(split({value}, '&'), (piece, no) -> case when no = 0 then piece else {let(ref, 'ref', decoded)} end)"
    return f"case when contains({value}, '&') then array_join({pieces}, '') else {value} end"


def escape_text(value: str) -> str:
    return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def escape_value(value: str) -> str:
    """Brackets are written as references too: a reader that ends a value early must not find a tag in it."""
    return f"replace({escape_text(value)}, '\"', '&quot;')"


def parse_attrs(tok: str, tag: str) -> str:
    """Name/value pairs of an opening tag in written order; a bare name has a null value.

    The first of several attributes with one name counts.
    """
    raw = f"regexp_extract(w, {pattern(r'(?s)^[^\s=]+\s*=\s*(.*)$')}, 1)"
    bare = "case when substring(raw, 1, 1) in ('\"', '\\'') then substring(raw, 2, length(raw) - 2) else raw end"
    value = let(raw, "raw", f"case when raw = '' then null else {let(bare, 'bare', unescape('bare'))} end")
    name = f"lower(regexp_extract(w, {pattern(r'^([^\s=]+)')}, 1))"
    written = f"regexp_extract_all(regexp_extract({tok}, {TAG_INSIDE}, 1), {ATTRIBUTE}, 0)"
    pairs = f"transform({written}, w -> named_struct('name', {name}, 'value', {value}))"
    firsts = "filter(ps, (p, i) -> array_position(transform(ps, q -> q.name), p.name) = i + 1)"
    once = f"case when size(array_distinct(transform(ps, q -> q.name))) = size(ps) then ps else {firsts} end"
    # ``<p>`` and its like need no parsing.
    return f"case when length({tok}) <= length({tag}) + 2 then {NO_ATTRS} else {let(pairs, 'ps', once)} end"


def attr(attrs: str, name: str) -> str:
    """Value of one attribute, null when absent, empty for a bare name."""
    hit = f"try_element_at(filter({attrs}, a -> a.name = {text(name)}), 1)"
    return let(hit, "hit", "case when hit is not null then coalesce(hit.value, '') end")


def attrs_of(**values: str) -> str:
    """Attribute list from name/expression pairs; those with a null value are left out."""
    made = ", ".join(f"named_struct('name', '{n}', 'value', {v})" for n, v in values.items())
    return f"cast(filter(array({made}), a -> a.value is not null) as {ATTRS_TYPE})"


def open_tag(tag: str, attrs: str) -> str:
    one = f"concat(' ', a.name, '=\"', {escape_value("coalesce(a.value, '')")}, '\"')"
    return f"concat('<', {tag}, array_join(transform(coalesce({attrs}, {NO_ATTRS}), a -> {one}), ''), '>')"


def has_class(class_value: str, name: str) -> str:
    return f"coalesce(array_contains(split({class_value}, {pattern(r'\s+')}), '{name}'), false)"
