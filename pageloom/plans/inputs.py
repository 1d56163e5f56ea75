"""Inputs derived from the given tables.

The given pages hold no media and no metadata, so pages with such markup, logs, formats and requests are
derived from them. The expressions are plain SQL that Spark and the oracle both run, so both sides build the
same rows, one per row of the given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.functions.vocab import FRAME_FORMATS, QUOTE_FORMATS

RUN_TS = "2025-01-06 00:00:00"
CAP_MIB = 100
LAST_ATTEMPT = 2

N = "cast(page_id as string)"
FRAGMENTS = (
    "'<picture><source type=\"image/webp\" srcset=\"/w{n}.webp 1x, /w{n}b.webp 2x\"><source type=\"image/png\" srcset=\"/p{n}.png 400w, /p{n}b.png 800w\"></picture>'",
    "'<picture><source type=\"image/png\" srcset=\"/p{n}.png\"><img src=\"/i{n}.jpg\" alt=\"pic {n}\"></picture>'",
    "'<picture><source type=\"image/png\" srcset=\"/p{n}.png\"><source type=\"image/x-odd\" srcset=\"/o{n}.odd\"><img src=\"data:image/gif;base64,AA\" alt=\"late\"></picture>'",
    "'<video title=\"v{n}\"><source src=\"/v{n}.m3u8\"><source src=\"/v{n}.mp4\"></video>'",
    "'<figure><img src=\"/placeholder.png\" alt=\"\"><img src=\"/r{n}.jpg\" alt=\"r\"><span>cap {n}</span></figure>'",
    "'<figure><img src=\"/one{n}.jpg\"></figure><figure><img src=\"/placeholder.png\" alt=\"\"><img src=\"/r{n}.jpg\" alt=\"r\"></figure>'",
    "'<div class=\"mediaplay-image\"><div class=\"image-wrapper\"><img src=\"/n{n}.jpg\"></div></div>'",
    "'<div><div><iframe src=\"https://www.youtube.com/embed/{n}\"></iframe></div></div><div><iframe src=\"https://maps.example.com/{n}\"></iframe><i>x</i></div>'",
    "'<blockquote><p>said</p><p>by <a href=\"https://twitter.com/u/status/{n}\">u</a></p></blockquote>'",
    "'<p onclick=\"x()\" class=\"c\" data-k=\"1\" title=\"t{n}\"><img src=\"/q{n}.png?s=1\"><img src=\"/q{n}.png?s=1\"><img src=\"/noext{n}\"><audio src=\"/a{n}.m4a\" controls></audio><mark>m</mark></p>'",
)
FRAGMENT = (
    "case page_id % 10 "
    + " ".join(f"when {k} then {f.replace('{n}', f"' || {N} || '")}" for k, f in enumerate(FRAGMENTS))
    + " end"
)
PAGES_RICH = f"select page_id, url, replace(html, '</article>', {FRAGMENT} || '</article>') as html from pages"

# Markup that attacks a sanitizer, and what may be left of it.
_SHOWN = '<img src="https://h.example/x" alt="image-placeholder">'
HOSTILE = (
    ('<xmp><p title="</xmp><img src=https://h.example/x onerror=alert(1)>">t</xmp>', _SHOWN + '"&gt;t'),
    ('<textarea><p title="</textarea><img src=https://h.example/x onerror=alert(1)>"></textarea>t', '<textarea>&lt;p title="</textarea>' + _SHOWN + '"&gt;t'),
    ('<noscript><p title="</noscript><img src=https://h.example/x onerror=alert(1)>"></noscript>t', _SHOWN + '"&gt;t'),
    ("<title><img src=x onerror=alert(1)></title>t", "t"),
    ('<iframe src="javascript:alert(1)"><p title="</iframe><img src=https://h.example/x onerror=alert(1)>"></iframe>t', "<p><a>Visit .</a></p>" + _SHOWN + '"&gt;t'),
    ("<svg><style><img src=x onerror=alert(1)></style><g onload=alert(1)></g></svg>t", "t"),
    ('<math><mi href="javascript:alert(1)" xlink:href="javascript:alert(1)">x</mi></math>t', "<math><mi>x</mi></math>t"),
    ('<a href="java&#115;cript:alert(1)" title="<b onclick=x>">k</a>', '<a title="&lt;b onclick=x&gt;">k</a>'),
    ('<x-card onclick="a()"><b>kept</b></x-card><blink>too</blink>', "<b>kept</b>too"),
    ('<img src="https://h.example/x"onerror="alert(1)"><img/src="https://h.example/x"/onerror=alert(1)>', _SHOWN * 2),
    ('<form action="javascript:alert(1)"><button formaction="javascript:alert(1)">b</button><input autofocus onfocus=alert(1) type=image src="https://h.example/x"></form>',
     '<form><button>b</button><input src="https://h.example/x"></form>'),
    ('<style>@import "x"</style><link rel=stylesheet href=x><meta http-equiv=refresh content=0><base href="javascript:/">t', "t"),
    ('<object data="https://h.example/x"><embed src="https://h.example/x"><p>in</p></object><applet code=a>b</applet>t', "t"),
    ('<!--<img src="--><img src=https://h.example/x onerror=alert(1)//">t', _SHOWN + "t"),
    ('<p title=">"><script>alert(1)</script >x</p>', '<p title="&gt;">x</p>'),
    ('<a href="data:text/html,<script>alert(1)</script>">d</a>', "<a>d</a>"),
    ("<plaintext><img src=x onerror=alert(1)>", ""),
    ('<p style="x" onmouseover=a() ONCLICK=b()>c</p>', '<p style="x">c</p>'),
    ("1 < 2 <<b>x</b> <img src=https://h.example/x onerror=alert(1)", "1 &lt; 2 &lt;<b>x</b> &lt;img src=https://h.example/x onerror=alert(1)"),
)
PAGES_HOSTILE = (
    f"select page_id, url, replace(html, '</article>', '<h6>begin</h6>' || case page_id % {len(HOSTILE)} "
    + " ".join(f"when {k} then '{given}'" for k, (given, _) in enumerate(HOSTILE))
    + " end || '<h6>end</h6></article>') as html from pages"
)

PAGES_META = f"""
select p.page_id, p.url, p.html,
  case when p.page_id % 7 = 3 then '' when p.page_id % 7 = 5 then 'not a date' else cast(e.ts as string) end as published_time,
  case p.page_id % 4 when 0 then 'by Author ' || cast(p.page_id % 11 as string) when 1 then 'Author ' || cast(p.page_id % 11 as string)
    when 2 then 'by ' else null end as byline,
  case when p.page_id % 3 = 0 then null else 'Site ' || cast(p.page_id % 5 as string) end as site_name
from pages p left join events e on e.event_id = p.page_id
"""

# Every page once more under a new id, damaged in one of four ways.
PAGES_BAD = """
select page_id, url, html from pages
union all
select 1000000 + page_id as page_id,
  case when page_id % 8 in (0, 1) then null when page_id % 8 in (2, 3) then '' when page_id % 8 in (6, 7) then 'not a url' else url end as url,
  case when page_id % 8 in (4, 5) then regexp_replace(html, '<title>[^<]*</title>', '<title></title>') else html end as html
from pages
"""

REQUESTS = """
select url,
  case when page_id % 6 = 0 then 'out/' || cast(page_id as string) || '.epub' else null end as output,
  case when page_id % 2 = 0 then 'lib' else null end as path,
  page_id % 3 = 0 as create_subfolders,
  case when page_id % 4 = 1 then 'https://c.example.com/' || cast(page_id as string) || '.png'
    when page_id % 12 = 2 then '/covers/' || cast(page_id as string) || '.jpg'
    when page_id % 12 = 7 then 'https://c.example.com/' || cast(page_id as string) || '.xyz' else null end as cover,
  page_id % 5 != 4 as download_media,
  case when page_id % 9 = 0 then 'best_bestaudio' else null end as media_format,
  case when page_id % 2 = 0 then 100 else null end as target_file_size
from pages
"""

MEDIA_LOG = """
select user_id as download_id, cast(event_id % 3 as int) as attempt, ts,
  case event_id % 5
    when 3 then '[info] Downloading 1 format(s)'
    when 4 then 'plain text line'
    when 2 then '[download]  5.0% of 10MiB at 1.00MiB/s ETA 00:05'
    else '[download]  ' || cast(event_id % 100 as string) || '.' || cast(event_id % 10 as string) || '% of '
      || cast(event_id * 7 % 900 as string) || '.' || lpad(cast(event_id % 100 as string), 2, '0')
      || case event_id % 4 when 0 then 'KiB' when 2 then 'GiB' else 'MiB' end || ' at 1.00MiB/s ETA 00:05'
  end as line
from events
"""

# Outcomes of formats: the built-in ones of the embed of a page, those that requests name, and three of addresses without an embed.
_FORMAT = "case page_id % 10 " + " ".join(
    f"when {k} then case a " + " ".join(f"when {a} then '{f}'" for a, f in enumerate((*listed, "best", "bestaudio"))) + " end"
    for k, listed in ((7, FRAME_FORMATS), (8, QUOTE_FORMATS))
) + " else case a when 0 then 'worstvideo+bestaudio' when 1 then 'best' when 2 then 'bestaudio' end end"
FORMATS = f"""
select * from (select case page_id % 10 when 7 then 'https://www.youtube.com/embed/' when 8 then 'https://twitter.com/u/status/'
    else 'https://v.example.com/' end || cast(page_id as string) as media_url,
  cast(a as int) as attempt, {_FORMAT} as format,
  case when (page_id + a) % 4 = 0 then 'unavailable' when (page_id + 2 * a) % 11 = 0 then 'error' else 'ok' end as status,
  cast((page_id * 13 + a * 7) % 200 as int) as size_mib, {CAP_MIB} as cap
from (select page_id, {{unnest}}(sequence5) as a from (select page_id, {{list}} as sequence5 from pages) s) t) f where format is not null
"""
FORMATS_SPARK = FORMATS.format(unnest="explode", list="array(0, 1, 2, 3, 4)")
FORMATS_ORACLE = FORMATS.format(unnest="unnest", list="[0, 1, 2, 3, 4]")

# Addresses made from the host of a page and its number, with their parts: address, scheme, host, path, query, fragment.
_H, _N = "regexp_extract(url, '://([^/?#]+)', 1)", "cast(page_id as string)"
ADDRESSES = (
    ("url", "regexp_extract(url, '^([a-z]+)', 1)", _H, "regexp_extract(url, '://[^/?#]+([^?#]*)', 1)", "regexp_extract(url, '^[^?#]*([?][^#]*)', 1)", "regexp_extract(url, '(#.*)$', 1)"),
    (f"'HTTPS://User:pw@' || upper({_H}) || ':443/a/' || {_N} || '?q#f'", "'https'", _H, f"'/a/' || {_N}", "'?q'", "'#f'"),
    (f"'http://' || {_H} || ':8080/'", "'http'", f"{_H} || ':8080'", "'/'", "''", "''"),
    (f"'http:' || {_H} || '/x'", "'http'", _H, "'/x'", "''", "''"),
    (f"'https:///' || {_H}", "'https'", _H, "''", "''", "''"),
    (f"' https://' || {_H} || '/a b '", "'https'", _H, "'/a b'", "''", "''"),
    (f"'file:///a/' || {_N} || '.html'", "'file'", "''", f"'/a/' || {_N} || '.html'", "''", "''"),
    (f"'file://' || {_H} || '/a'", "'file'", _H, "'/a'", "''", "''"),
    (f"'skype:' || {_N} || '?call'", "'skype'", "''", _N, "'?call'", "''"),
    (f"'whatsapp:hello' || {_N}", "'whatsapp'", "''", f"'hello' || {_N}", "''", "''"),
    (f"'callto:' || {_N}", "'callto'", "''", _N, "''", "''"),
    (f"'mailto:a@' || {_H}", "'mailto'", "''", f"'a@' || {_H}", "''", "''"),
    (f"'data:text/plain,' || {_N}", "'data'", "''", f"'text/plain,' || {_N}", "''", "''"),
    (f"'javascript:f(' || {_N} || ')'", "'javascript'", "''", f"'f(' || {_N} || ')'", "''", "''"),
    (f"'foo://Bar' || {_N} || ':9/x?y'", "'foo'", f"'Bar' || {_N} || ':9'", "'/x'", "'?y'", "''"),
    (f"'wss://' || {_H} || ':443'", "'wss'", _H, "''", "''", "''"),
    (f"'ftp://' || {_H} || ':2121/p/../q'", "'ftp'", f"{_H} || ':2121'", "'/p/../q'", "''", "''"),
    (f"'https://' || {_H} || ':99999/'", None, None, None, None, None),
    (f"'http://' || {_N} || ' ' || {_H}", None, None, None, None, None),
    (f"'//' || {_H} || '/a'", None, None, None, None, None),
    (f"'page ' || {_N}", None, None, None, None, None),
)
PAGE_ADDRESSES = (
    f"select page_id, case page_id % {len(ADDRESSES)} " + " ".join(f"when {k} then {a[0]}" for k, a in enumerate(ADDRESSES)) + " end as address from pages"
)

# Times of events written in the forms that pages use, and the time each stands for (SQL of the oracle; null: cannot be read).
_Y, _M, _D = "cast(year(ts) as string)", "cast(month(ts) as string)", "cast(day(ts) as string)"
_two = lambda x: f"lpad(cast({x}(ts) as string), 2, '0')"
_MM, _DD, _HH, _MI, _SS = (_two(x) for x in ("month", "day", "hour", "minute", "second"))
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(ts) * 3 - 2 as int), 3)"
_MONTH = "trim(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December', cast(month(ts) * 9 - 8 as int), 9))"
_H12, _AP = "cast((hour(ts) + 11) % 12 + 1 as string)", "case when hour(ts) < 12 then 'AM' else 'PM' end"
_HMS = f"{_HH} || ':' || {_MI} || ':' || {_SS}"
_DAY, _MINUTE, _SECOND = (f"date_trunc('{x}', ts)" for x in ("day", "minute", "second"))
DATES = (
    (f"{_Y} || '-' || {_MM} || '-' || {_DD}", _DAY),
    (f"{_Y} || '/' || {_MM} || '/' || {_DD}", _DAY),
    (f"{_Y} || '.' || {_M} || '.' || {_D}", _DAY),
    (f"{_Y} || '-' || {_MM}", "date_trunc('month', ts)"),
    (f"{_M} || '/' || {_D} || '/' || {_Y}", _DAY),
    (f"{_MM} || '-' || {_DD} || '-' || right({_Y}, 2)", _DAY),
    (f"{_Y} || '-' || {_MM} || '-' || {_DD} || 'T' || {_HMS} || 'Z'", _SECOND),
    (f"{_Y} || '-' || {_MM} || '-' || {_DD} || 'T' || {_HMS} || '.250+02:00'", f"{_SECOND} - interval 2 hour"),
    (f"{_Y} || '-' || {_MM} || '-' || {_DD} || ' ' || {_HMS} || ' -0530'", f"{_SECOND} + interval 330 minute"),
    (f"{_Y} || '-' || {_MM} || '-' || {_DD} || 'T' || {_HH} || ':' || {_MI}", _MINUTE),
    (f"'Mon, ' || {_DD} || ' ' || {_MON} || ' ' || {_Y} || ' ' || {_HMS} || ' GMT'", _SECOND),
    (f"{_D} || ' ' || {_MON} || ' ' || {_Y} || ' ' || {_HMS} || ' +0100'", f"{_SECOND} - interval 1 hour"),
    (f"{_D} || ' ' || {_MONTH} || ' ' || {_Y}", _DAY),
    (f"{_MONTH} || ' ' || {_D} || ', ' || {_Y}", _DAY),
    (f"{_MON} || '. ' || {_D} || ', ' || {_Y} || ' ' || {_H12} || ':' || {_MI} || ' ' || {_AP}", _MINUTE),
    (f"'Monday, ' || {_MONTH} || ' ' || {_D} || ', ' || {_Y} || ' at ' || {_H12} || ':' || {_MI} || ' ' || {_AP} || ' EST'", f"{_MINUTE} + interval 5 hour"),
    (f"'Mon ' || {_MON} || ' ' || {_DD} || ' ' || {_Y} || ' ' || {_HMS} || ' GMT+0100 (CET)'", f"{_SECOND} - interval 1 hour"),
    (f"{_DD} || '-' || {_MON} || '-' || {_Y}", _DAY),
    (f"upper({_D} || ' ' || {_MONTH} || ' ' || {_Y} || ' ' || {_HH} || ':' || {_MI} || ' pdt')", f"{_MINUTE} + interval 7 hour"),
    (f"'  ' || {_MONTH} || ' ' || {_D} || ' ' || {_Y} || ' '", _DAY),
    (f"{_M} || '/' || {_D} || '/' || {_Y} || ', ' || {_H12} || ':' || {_MI} || ':' || {_SS} || ' ' || {_AP}", _SECOND),
    ("''", f"timestamp '{RUN_TS}'"),
    (f"{_Y} || '-' || {_MM} || '-32'", None),
    (f"'on ' || {_D}", None),
    (f"{_MONTH} || ' ' || {_D} || ', ' || {_Y} || ' 13:00 PM'", None),
)
EVENT_DATES = f"select event_id, case event_id % {len(DATES)} " + " ".join(f"when {k} then {d[0]}" for k, d in enumerate(DATES)) + " end as given from events"

# Media endings with their type and the extension a file gets; null: unknown.
ENDINGS = (
    ("png", "image/png", "png"), ("JPG", "image/jpeg", "jpeg"), ("jpeg?w=1", "image/jpeg", "jpeg"), ("jxl", "image/jxl", "jxl"),
    ("heic", "image/heic", "heic"), ("heif", "image/heif", "heif"), ("jp2", "image/jp2", "jp2"), ("avif", "image/avif", "avif"),
    ("svgz", "image/svg+xml", "svg"), ("tiff", "image/tiff", "tif"), ("ico", "image/vnd.microsoft.icon", "ico"), ("wmv", "video/x-ms-wmv", "wmv"),
    ("flv?a=b.mp4", "video/x-flv", "flv"), ("mov", "video/quicktime", "qt"), ("m2ts", "video/mp2t", "ts"), ("3gp", "video/3gpp", "3gp"),
    ("get?file=b.webm", "video/webm", "webm"), ("aiff", "audio/x-aiff", "aif"), ("wma", "audio/x-ms-wma", "wma"), ("opus", "audio/ogg", "ogg"),
    ("mp2", "audio/mpeg", "mp3"), ("amr", "audio/amr", "amr"), ("odd", None, None), ("png/", None, None), ("png#x", None, None),
)
MEDIA_ADDRESSES = (
    f"select page_id, 'https://m.example/' || cast(page_id as string) || '.' || case page_id % {len(ENDINGS)} "
    + " ".join(f"when {k} then '{e[0]}'" for k, e in enumerate(ENDINGS)) + " end as url from pages"
)
#: A caller's own table of types.
OWN_TYPES = "select * from values ('png', 'image/x-own', 'own'), ('ODD', 'image/x-odd', 'odd'), ('jpg', 'image/jpeg', 'jpg') as t(ext, media_type, canonical_ext)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above on the given tables."""
    names = ["pages"] + (["events"] if "events" in sql else [])
    if "from events" in sql and "from pages" not in sql:
        names = ["events"]
    for name in names:
        sql = sql.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})
