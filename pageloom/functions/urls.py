"""URL expressions: one record of an address, its host, absolute form and extension."""

from __future__ import annotations

from pageloom.functions import let, one_of, pattern, text
from pageloom.functions.vocab import DEFAULT_PORTS

SCHEME = pattern(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
# What a scheme is followed by, in groups: authority, host with port, path, query, fragment. Web schemes have an authority after
# any number of slashes; others only after two.
_TAIL = r"([^?#]*)((?:\?[^#]*)?)((?:#.*)?)$"
_WEB = pattern(r"(?s)^[^:]*+:[/\\]*+((?:[^/\\?#]*@)?([^/\\?#@]*))" + _TAIL)
_OTHER = pattern(r"(?s)^[^:]*+:(?://((?:[^/?#]*@)?([^/?#@]*)))?" + _TAIL)
_CUT = "'$1\\u0001$2\\u0001$3\\u0001$4\\u0001$5'"
# A host and a port; names may not hold what would end or escape them.
_NAME = r"""(?:\[[0-9A-Fa-f:.]+\]|[^\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7F]{least})(?::[0-9]{0,5})?"""
_WEB_HOST, _ANY_HOST = (pattern(f"^{_NAME.replace('{least}', least)}$") for least in ("+", "*"))
_PORT = pattern(r":([0-9]*)$")
_BARE = pattern(r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]")


def address(url: str) -> str:
    """The parts of an absolute address: struct ``scheme, authority, host, path, query, fragment``; null for any other text.

    ``host`` is as a URL parser shows it: in lower case and without the scheme's own port for web schemes, empty for schemes
    without one (``mailto:a@b``, ``file:///a``). ``authority`` is as written; query and fragment keep their sign. An address
    whose host or port cannot be is null. Percent signs in host names are not decoded but refused, names are not converted to
    ASCII. One pattern cuts the address; whoever needs several parts asks for the record once.
    """
    web = one_of("scheme", [*DEFAULT_PORTS])
    ports = f"map({', '.join(f'{text(s)}, {p}' for s, p in DEFAULT_PORTS.items())})"
    name = f"regexp_replace(p[1], {_PORT}, '')"
    port = f"try_cast(nullif(regexp_extract(p[1], {_PORT}, 1), '') as int)"
    shown = f"concat({name}, if(coalesce({port} = try_element_at({ports}, scheme), true), '', concat(':', cast({port} as string))))"
    host = f"case when {web} then lower({shown}) when scheme = 'file' then if(lower(p[1]) = 'localhost', '', lower(p[1])) else p[1] end"
    valid = (
        f"p[1] rlike if({web}, {_WEB_HOST}, {_ANY_HOST}) and coalesce({port}, 0) <= 65535"
        f" and (scheme != 'file' or not p[1] rlike {_PORT})"
    )
    record = f"named_struct('scheme', scheme, 'authority', p[0], 'host', {host}, 'path', p[2], 'query', p[3], 'fragment', p[4])"
    parts = f"split(if({web}, regexp_replace(u, {_WEB}, {_CUT}), regexp_replace(u, {_OTHER}, {_CUT})), '\\u0001')"
    cut = let(parts, "p", f"if({valid}, {record}, null)")
    found = let(f"lower(regexp_extract(u, {SCHEME}, 1))", "scheme", f"case when scheme != '' then {cut} end")
    return let(f"regexp_replace({url}, {_BARE}, '')", "u", found)


def full_host(url: str) -> str:
    """Lower-case host with a non-default port; empty for an address without one; null when it is not an absolute URL."""
    return f"{address(url)}.host"


def short_host(url: str) -> str:
    """Host without a leading ``www.`` and a trailing ``.com``; null for an invalid URL."""
    return short_name(full_host(url))


def short_name(host: str) -> str:
    www, com = pattern(r"^www\."), pattern(r"\.com$")
    return f"regexp_replace(regexp_replace({host}, {www}, ''), {com}, '')"


def strip_query(url: str) -> str:
    return f"regexp_replace({url}, {pattern(r'\?.*')}, '')"


def extension(url: str) -> str:
    """Lower-case extension of the last path part, empty if there is none."""
    ending = pattern(r"\.([^./\\]+)$")
    return f"lower(regexp_extract({url}, {ending}, 1))"


def _without_dot_segments(path: str) -> str:
    """Drop ``.`` and resolve ``..``; both name a folder when they come last."""
    closed = f"case when {path} rlike {pattern(r'/\.\.?$')} then concat({path}, '/') else {path} end"
    fold = (
        "aggregate(slice(parts, 2, size(parts) - 1), cast(array() as array<string>), (acc, part) -> case"
        " when part = '.' then acc"
        " when part = '..' then slice(acc, 1, greatest(size(acc) - 1, 0))"
        " else array_append(acc, part) end)"
    )
    return f"transform(array(split({closed}, '/')), parts -> concat('/', array_join({fold}, '/')))[0]"


def absolute_url(base: str, link: str) -> str:
    """Resolve ``link`` against the page address ``base`` (RFC 3986, section 5)."""
    return let(address(base), "page", resolved("page", link))


def resolved(page: str, link: str) -> str:
    """Resolve ``link`` against the record of a page's address; without one the link stays."""
    link = f"trim({link})"
    scheme = f"concat({page}.scheme, ':')"
    origin = f"concat({scheme}, '//', {page}.authority)"
    folder = f"coalesce(nullif(regexp_extract({page}.path, '^(.*/)', 1), ''), '/')"
    without_fragment = f"concat({origin}, {page}.path, {page}.query)"
    link_path = f"regexp_extract({link}, '^([^?#]*)', 1)"
    link_tail = f"regexp_extract({link}, '^[^?#]*(.*)$', 1)"
    joined = f"case when {link} like '/%' then {link_path} else concat({folder}, {link_path}) end"
    path = f"case when {link_path} like '%.%' and {joined} like '%/.%' then {_without_dot_segments(joined)} else {joined} end"
    return (
        f"case when {link} is null then null when {link} rlike {SCHEME} then {link} when coalesce({page}.authority, '') = '' then {link}"
        f" when {link} like '//%' then concat({scheme}, {link})"
        f" when {link} = '' then {without_fragment}"
        f" when {link} like '#%' then concat({without_fragment}, {link})"
        f" when {link} like '?%' then concat({origin}, {page}.path, {link})"
        f" else concat({origin}, {path}, {link_tail}) end"
    )
