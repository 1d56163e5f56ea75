import pytest

from pageloom.functions import logs, markup, media, naming, srcset, urls


@pytest.mark.parametrize(
    "url, host",
    [
        ("https://0pointer.net/blog/linux-boot-partitions.html", "0pointer.net"),
        ("https://www.youtube.com/embed/1", "youtube"),
        ("https://m.youtube.com/x", "m.youtube"),
        ("https://youtu.be/x", "youtu.be"),
        ("http://www.a.org:80/x", "a.org"),
        ("http://a.org:8080/x", "a.org:8080"),
        ("https://u:p@A.com:443", "a"),
        ("https://münchen.de/x", "münchen.de"),
        ("not a url", None),
        ("", None),
    ],
)
def test_short_host(value, url, host):
    assert value(urls.short_host("u"), u=url) == host


BASE = "https://a.org/b/c/d;p?q#f"


@pytest.mark.parametrize(
    "link, wanted",
    [
        ("http://x.y/z", "http://x.y/z"), ("g", "https://a.org/b/c/g"), ("./g", "https://a.org/b/c/g"),
        ("g/", "https://a.org/b/c/g/"), ("/g", "https://a.org/g"), ("//g", "https://g"), ("?y", "https://a.org/b/c/d;p?y"),
        ("g?y", "https://a.org/b/c/g?y"), ("#s", "https://a.org/b/c/d;p?q#s"), ("", "https://a.org/b/c/d;p?q"),
        (".", "https://a.org/b/c/"), ("..", "https://a.org/b/"), ("../g", "https://a.org/b/g"), ("../..", "https://a.org/"),
        ("../../../g", "https://a.org/g"), ("/./g", "https://a.org/g"), ("/../g", "https://a.org/g"), ("g.", "https://a.org/b/c/g."),
        ("..g", "https://a.org/b/c/..g"), ("./../g", "https://a.org/b/g"), ("g/./h", "https://a.org/b/c/g/h"),
        ("g/../h", "https://a.org/b/c/h"), ("g?y/../x", "https://a.org/b/c/g?y/../x"), ("data:x", "data:x"),
    ],
)
def test_absolute_url(value, link, wanted):
    assert value(urls.absolute_url("b", "l"), b=BASE, l=link) == wanted


def test_absolute_url_of_a_bare_host(value):
    assert value(urls.absolute_url("b", "l"), b="https://a.org", l="g") == "https://a.org/g"


@pytest.mark.parametrize(
    "title, wanted",
    [("Linux Boot Partitions", "linux-boot-partitions"), ("Ünï, a_b-c!", "n-a_b-c"), ("漢字", ""), ("x" * 300, "x" * 239)],
)
def test_slug(value, title, wanted):
    assert value(naming.slug("t", 16), t=title) == wanted


def test_file_name_and_path(value):
    name = naming.file_name("timestamp_ntz '2025-01-06 10:00:00'", "t")
    assert value(name, t="Linux boot partitions") == "2025-01-06_linux-boot-partitions.epub"
    path = naming.output_path("n", "s", "o", "p", "f = 'y'")
    assert value(path, n="n.epub", s="0pointer.net", o=None, p=None, f="y") == "0pointer.net/n.epub"
    joined = {None: "n", "": "n", ".": "n", "./": "n", "././": "n", "lib": "lib/n", "./lib/": "lib/n", "/": "/n", "/a//b/./c/": "/a/b/c/n", "a/.": "a/n", ".a": ".a/n"}
    for given, wanted in joined.items():
        assert value(path, n="n", s="s", o=None, p=given, f="n") == wanted, given
    assert value(path, n="n.epub", s="a", o=None, p="lib", f="n") == "lib/n.epub"
    assert value(path, n="n.epub", s="a", o="x/y.epub", p="lib", f="y") == "x/y.epub"


@pytest.mark.parametrize(
    "byline, wanted", [("by Ann", "Ann"), ("By Ann", "By Ann"), ("by ", "site"), ("", "site"), (None, "site")]
)
def test_author(value, byline, wanted):
    assert value(naming.author("b", "s"), b=byline, s="site") == wanted


def test_dates(value):
    run = "timestamp_ntz '2025-01-06 00:00:00'"
    assert str(value(naming.published_at("t", run), t="2024-02-03T04:05:06")) == "2024-02-03 04:05:06"
    assert str(value(naming.published_at("t", run), t="")) == "2025-01-06 00:00:00"
    assert value(naming.published_at("t", run), t="soon") is None
    assert value(naming.http_date(run)) == "Mon, 06 Jan 2025 00:00:00 GMT"
    assert value(naming.modified_text(run)) == "2025-01-06T00:00:00Z"
    assert value(naming.language("l"), l="de-AT") == "de"
    assert value(naming.language("l"), l=None) == "en"


def test_chapter_file(value):
    assert value(naming.chapter_file("1", "t"), t="My Title") == "1_my-title.xhtml"
    assert value(naming.chapter_file("1", "t"), t=None) == "1_no-title.xhtml"
    assert value(naming.chapter_file("1", "t", "g"), t="x", g="f") == "f.xhtml"
    assert value(naming.chapter_file("1", "t", "g"), t="x", g="f.xhtml") == "f.xhtml"
    assert len(value(naming.chapter_file("12", "t"), t="y" * 400)) == 255 - 3 - 6 + 3 + 6


@pytest.mark.parametrize(
    "sources, wanted",
    [
        ("a.png", "a.png"),
        ("a 1x, b 2x", "b"),
        ("a 400w, b 800w, c 600w", "b"),
        ("a 2x, b 2x", "b"),
        ("a 5x, b, c 9x", "b"),
        ("a big, b 9x", "a"),
        ("x.m3u8, y 1x", "y"),
        ("x.m3u8", None),
        ("a -1x", None),
        ("a 1x,", ""),
    ],
)
def test_best_candidate(value, sources, wanted):
    assert value(srcset.best_candidate("s"), s=sources) == wanted


@pytest.mark.parametrize("text, wanted", [("800w", 800), ("2x", 2), (" 3.5x", 3), ("-4", -4), ("big", None), ("", None)])
def test_leading_number(value, text, wanted):
    assert value(srcset.leading_number("s"), s=text) == wanted


def test_attributes(value):
    tok = """<IMG Src='/a?b=1&amp;c=2' alt="x > y" hidden data-n=5 src=later />"""
    got = value(f"array_join(transform({markup.parse_attrs('t', "'img'")}, a -> concat(a.name, '=', coalesce(a.value, '~'))), '|')", t=tok)
    assert got == "src=/a?b=1&c=2|alt=x > y|hidden=~|data-n=5"
    assert value(f"size({markup.parse_attrs('t', "'p'")})", t="<p>") == 0


def test_unescape(value):
    sql = markup.unescape("t")
    assert value(sql, t="a &amp; b &#8217; &#x1F600; &nosuch; & &eacute; &amp;lt;") == "a & b ’ \U0001f600 &nosuch; & é &lt;"
    assert value(sql, t="&#0; &#xD800; &#9999999;") == "&#0; &#xD800; &#9999999;"
    assert value(sql, t="plain") == "plain"


def test_log_lines(value):
    line = "[download]  12.5% of ~ 10.00MiB at 1.00MiB/s ETA 00:05"
    got = value(logs.progress("l"), l="[download]  12.5% of ~10.00MiB at 1.00MiB/s ETA 00:05")
    assert tuple(got) == (12.5, "10.00MiB", "1.00MiB/s", "00:05")
    assert value(logs.event_type("l"), l=line) == "download"
    assert value(logs.event_data("l"), l="[info] a b") == " a b"
    assert value(logs.event_type("l"), l="text") is None
    assert value(logs.progress("l"), l="[info] Downloading 1 format(s)") is None


@pytest.mark.parametrize(
    "text, wanted",
    [("of 10.9MiB", 10), ("512.5KiB", 0.5), ("2.0GiB", 2048), ("10MiB at 1.00MiB/s", 1), ("3.0TiB", None), ("10MiB", None)],
)
def test_size(value, text, wanted):
    assert value(logs.size_mib("t"), t=text) == wanted


def test_containers(value):
    for fmt, ending in (("worstvideo+bestaudio", ".mp4"), ("best", ".mp4"), ("bestaudio", ".m4a"), ("best[x]", ".mp4"), ("wv*", ".mp4")):
        assert value(logs.container("f"), f=fmt) == ending
    assert value(logs.error_class("m"), m="x Requested format is not available. y") == "unavailable"
    assert value(logs.error_class("m"), m="boom") == "error"


def test_media_types(value):
    assert value(media.media_type("u"), u="http://a/b.JPG?x=1") == "image/jpeg"
    assert value(media.canonical_extension("u"), u="http://a/b.jpg") == "jpeg"
    assert value(media.media_type("u"), u="http://a/get?file=b.png") == "image/png"
    assert value(media.media_type("u"), u="http://a/noext") is None
    kinds = [("file:///t/a.mp4", "false", "local"), ("/a.png", "false", "skip"), ("/a.png", "true", "local"), ("http://a", "false", "remote")]
    for url, cover, wanted in kinds:
        assert value(media.transfer_class("u", cover), u=url) == wanted
