"""Titles, names, dates and output paths."""

from __future__ import annotations

from pageloom.functions import let, pattern, text
from pageloom.functions.urls import short_host
from pageloom.functions.vocab import MONTHS, ZONES

FILE_NAME_LIMIT = 255
FILE_NAME_RESERVED = 16  # ten characters of date, one underscore, five of extension


def slug(title: str, reserved: int | str = 0) -> str:
    """Spaces to dashes, lower case, ASCII word characters only, cut to what a file name can hold."""
    kept = f"regexp_replace(lower(replace({title}, ' ', '-')), '[^0-9a-z_-]', '')"
    return f"substring({kept}, 1, {FILE_NAME_LIMIT} - ({reserved}))"


def site_name(declared: str, url: str) -> str:
    return f"coalesce(nullif({declared}, ''), {short_host(url)})"


def author(byline: str, site: str) -> str:
    """Drop a leading ``by``; fall back to the site."""
    bare = f"case when startswith({byline}, 'by ') then substring({byline}, 4) else {byline} end"
    return f"coalesce(nullif({bare}, ''), {site})"


_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
_YEAR = r"(\d{4}|\d{2})"
# A date in one of four orders, then perhaps a time and a zone. Groups: 1-3 year month day; 4-6 month day year; 7-9 day month year with
# the month written out; 10-12 month day year; 13-17 hour, minute, second, fraction, half of the day; 18 named zone; 19-21 offset.
DATE = pattern(
    r"(?i)^\s*(?:[a-z]{3,9}\.?,?\s+(?=[a-z0-9]))?(?:(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?"
    rf"|(\d{{1,2}})[-/](\d{{1,2}})[-/]{_YEAR}|(\d{{1,2}})[\s-]+{_MONTH}[\s,-]+{_YEAR}|{_MONTH}\s+(\d{{1,2}}),?\s+{_YEAR})"
    r"(?:(?:t|,?\s+(?:at\s+)?)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(am|pm)?)?"
    rf"\s*(z|{'|'.join(ZONES)})?\s*(?:([+-])(\d{{2}}):?(\d{{2}}))?(?:\s+\([^()]*\))?\s*$"
)
_DATE_CUT = "'" + "\\u0001".join(f"${n}" for n in range(1, 22)) + "'"


def published_at(given: str, run_ts: str) -> str:
    """Publishing time in UTC; the run time when none is given; null when it cannot be read.

    One pattern cuts the text into its parts, from which the time is built: year first (``2025-01-06``, ``2025/1/6``, with or
    without the day), month first (``1/6/2025``), and the month written out before or after the day, all with or without a weekday
    before and a time behind, of 12 or 24 hours. Zones are offsets or the names that mail uses; a time without one is UTC. Years of
    two digits are 1950 to 2049. A day that the month does not have cannot be read.
    """
    part = lambda *numbers: "concat(" + ", ".join(f"p[{n - 1}]" for n in numbers) + ")"
    months = f"map({', '.join(f'{text(m)}, {n}' for n, m in enumerate(MONTHS, 1))})"
    zones = f"map({', '.join(f'{text(z)}, {60 * h}' for z, h in ZONES.items())})"
    number = lambda value, other=0: f"coalesce(cast(nullif({value}, '') as int), {other})"
    short_year = f"if({number(part(1, 6, 9, 12))} < 50, 2000, 1900)"
    year = f"{number(part(1, 6, 9, 12))} + if(length({part(1, 6, 9, 12)}) = 2, {short_year}, 0)"
    month = f"coalesce(try_element_at({months}, lower({part(8, 10)})), {number(part(2, 4))})"
    hour = f"case lower(p[16]) when 'am' then {number('p[12]')} % 12 when 'pm' then {number('p[12]')} % 12 + 12 else {number('p[12]')} end"
    valid = f"(p[16] = '' or {number('p[12]')} between 1 and 12)"
    second = "cast(concat('0', p[14], '.', if(p[15] = '', '0', p[15])) as decimal(16,6))"
    built = f"try_make_timestamp_ntz({year}, {month}, {number(part(3, 5, 7, 11), 1)}, {hour}, {number('p[13]')}, {second})"
    offset = f"if(p[18] = '-', -1, 1) * (60 * {number('p[19]')} + {number('p[20]')}) + coalesce(try_element_at(zones, lower(p[17])), 0)"
    shifted = f"{built} - make_dt_interval(0, 0, {offset.replace('zones', zones)}, 0)"
    cut = f"split(regexp_replace({given}, {DATE}, {_DATE_CUT}), '\\u0001')"
    return (
        f"case when coalesce({given}, '') = '' then {run_ts} when {given} rlike {DATE}"
        f" then {let(cut, 'p', f'if({valid}, {shifted}, null)')} end"
    )


def language(lang: str) -> str:
    return f"coalesce(nullif(substring({lang}, 1, 2), ''), 'en')"


def date_text(ts: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd')"


def http_date(ts: str) -> str:
    return f"date_format({ts}, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\")"


def modified_text(ts: str) -> str:
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def iso_text(ts: str) -> str:
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def rights_line(ts: str, publisher: str) -> str:
    return f"concat('Copyright © ', cast(year({ts}) as string), ' by ', {publisher})"


def file_name(published: str, title: str) -> str:
    return f"concat({date_text(published)}, '_', {slug(title, FILE_NAME_RESERVED)}, '.epub')"


def output_path(name: str, site: str, output: str = "null", path: str = "null", subfolders: str = "false") -> str:
    """An explicit output wins; otherwise base folder, optional site folder, file name, joined as paths are: without empty and
    ``.`` parts of the base. Without a base folder the path starts with the next part."""
    bare = f"regexp_replace(regexp_replace({path}, {pattern(r'/(?:\./|/)+')}, '/'), {pattern(r'^(?:\./)+|/\.?$')}, '')"
    base = f"case when {path} = '/' then '' when {path} in ('', '.', './') then null else nullif({bare}, '') end"
    made = f"concat_ws('/', {base}, case when {subfolders} then {site} end, {name})"
    return f"coalesce(nullif({output}, ''), {made})"


def chapter_file(index: str, title: str, given: str | None = None) -> str:
    """``{index}_{slug}.xhtml`` or the given name with that ending."""
    prefix = f"concat(cast({index} as string), '_')"
    named = f"coalesce(nullif({title}, ''), 'no title')"
    made = f"concat({prefix}, {slug(named, f'length({prefix}) + 6')}, '.xhtml')"
    if given is None:
        return made
    return (
        f"case when {given} is null then {made} when endswith({given}, '.xhtml') then {given}"
        f" else concat({given}, '.xhtml') end"
    )
