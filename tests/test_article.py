"""Extraction, embeds, cleaning and books on small hand-written pages."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions.markup import attr
from pageloom.functions.vocab import FRAME_FORMATS, QUOTE_FORMATS
from pageloom.operators import book, clean, downloads, extract, media
from pageloom.operators.lookup import latest_per_key, salted_lookup
from pageloom.operators.tokens import attributes, tokens
from pageloom.operators.tree import build_nodes
from pageloom.plans.corpus import Corpus

LONG = "This paragraph is long enough, it has commas, and it counts."
FILLER = f"<p>{LONG}</p><p>{LONG}</p>"
RUN_TS = "2025-01-06 00:00:00"


def page(body, head="<title>T</title>"):
    return f"<html lang='de-AT'><head>{head}</head><body>{body}</body></html>"


YOUTUBE = '<iframe src="https://www.youtube.com/embed/{}"></iframe>'
TWEET = '<blockquote><p>q</p><p>by <a href="https://{}/s/1">u</a></p></blockquote>'
BODIES = [
    f"<nav><ul><li><a href='/x'>{LONG}</a></li></ul></nav><div id='m'>{FILLER}</div><div><p>short</p></div>",
    f"<article>{FILLER}<div><div>{YOUTUBE.format(1)}</div></div><div>a{YOUTUBE.format(2)}</div></article>",
    f"<article>{FILLER}<p>{YOUTUBE.format('bad')}</p></article>",
    f"<article>{FILLER}{TWEET.format('twitter.com')}{TWEET.format('www.x.com')}{TWEET.format('t.co')}<blockquote><p><a href='https://x.com/s/2'>u</a>.</p></blockquote></article>",
    f"<article>{FILLER}<iframe></iframe></article>",
    f"<div class='w'><article><div><div>{FILLER}</div></div></article></div>",
    f"<article>{FILLER}<object><p>x</p></object><p onclick='a()'>k<a href='javascript:x' id='i'>l</a><a href='q?a=1&amp;b=2'>r</a></p><img src='a.jpg' alt=''><img src='a.jpg'><img src='b'><video src='c.mp4' controls></video></article>",
    "",
    f"<article>{FILLER}</article>",
]
HEADS = {
    5: "<title>Old &amp; new</title><meta property='og:title' content='Best'><meta name='author' content='by Ann'>"
    "<meta property='article:published_time' content='2024-02-03T04:05:06'><meta name=description content='D'>",
    8: "<title> </title>",
}


def two_formats(spark):
    rows = [(k, n, f) for k in ("frame", "quote") for n, f in enumerate(("best", "bestaudio"))]
    return spark.createDataFrame(rows, "kind string, prio int, format string")


@pytest.fixture(scope="module")
def corpus(spark, pages):
    rows = pages(*[page(b, HEADS.get(i, "<title>T</title>")) for i, b in enumerate(BODIES)])
    formats = spark.createDataFrame(
        [
            ("https://www.youtube.com/embed/1", 0, "best", "ok", 500, 100),
            ("https://www.youtube.com/embed/1", 1, "bestaudio", "ok", 5, 100),
            ("https://www.youtube.com/embed/2", 0, "bestaudio", "ok", 5, 100),
            ("https://www.youtube.com/embed/2", 1, "best", "ok", 50, 100),
            ("https://www.youtube.com/embed/bad", 0, "best", "error", 0, 100),
            ("https://twitter.com/s/1", 0, "best", "ok", 1, 100),
            ("https://www.x.com/s/1", 0, "best", "error", 1, 100),
        ],
        "media_url string, attempt int, format string, status string, size_mib int, cap int",
    )
    made = Corpus(spark, rows, RUN_TS, formats=formats, defaults={"download_media": "true"}, preferences=two_formats(spark))
    yield made
    made.release()


def html_of(corpus, page_id):
    return corpus.html.filter(f"page_id = {page_id}").first().content_html


def test_pages_get_what_they_ask_for(spark, pages):
    film = "https://www.youtube.com/embed/1"
    frame = f"<article><p>{'Some words of text, ' * 5}</p><div><iframe src='{film}'></iframe></div><i>x</i></article>"
    rows = pages(*[page(frame, "<title>T</title>")] * 6).selectExpr("page_id", "concat('https://a.com/', page_id) as url", "html")
    asked = [(None, None), (None, 100), ("bestaudio", None), ("best", 100), ("worst_best", None), ("best_worst", 100)]
    requests = spark.createDataFrame(
        [(f"https://a.com/{r.page_id}", True, *a) for r, a in zip(rows.select("page_id").orderBy("page_id").collect(), asked, strict=True)],
        "url string, download_media boolean, media_format string, target_file_size int",
    ).selectExpr("*", "cast(null as string) as output", "cast(null as string) as path", "false as create_subfolders", "cast(null as string) as cover")
    formats = spark.createDataFrame(
        [(film, 0, "best", "ok", 500), (film, 1, "bestaudio", "ok", 5)],
        "media_url string, attempt int, format string, status string, size_mib int",
    )
    made = Corpus(spark, rows, RUN_TS, requests=requests, formats=formats, preferences=two_formats(spark))
    got = [(r.action, (r.media_path or "")[-4:]) for r in made.outcomes.orderBy("page_id").collect()]
    made.release()
    assert got == [("media", ".mp4"), ("media", ".m4a"), ("media", ".m4a"), ("media", ".mp4"), ("media", ".mp4"), ("reject", "")]


def test_article_roots(corpus):
    names = corpus.repaired.join(corpus.roots, "page_id").filter("node_id = root_id").selectExpr("page_id", "tag", f"{attr('attrs', 'id')} as id")
    found = {r.page_id: (r.tag, r.id) for r in names.collect()}
    assert found[0] == ("div", "m")
    assert found[1][0] == "article" and found[5][0] == "div"
    assert found[7][0] == "body"


def test_text(corpus):
    text = extract.article_text(corpus.content).filter("page_id = 5").first().text_content
    assert text == LONG + LONG


def test_frames(corpus):
    one = html_of(corpus, 1)
    assert one.count("<figure>") == 2 and "<iframe" not in one
    first, second = one.split("<figure>")[1:]
    # Only children climb: the two wrappers of the first frame are gone, the second stays beside its text.
    assert "<audio src=\"audiovideo/" in first and 'controls="Controls"' in first
    assert "Watch on youtube.</a></figcaption></figure><div>a" in first
    assert "<video src=\"audiovideo/" in second and second.endswith("</figure></div>")


def test_quotes(corpus):
    html = html_of(corpus, 3)
    assert html.count("<video") == 1
    assert html.index("twitter.com") < html.index("</blockquote><p><video") < html.index("www.x.com")


def test_rejects(corpus):
    assert {(r.page_id, r.stage, r.reason) for r in corpus.rejects.collect()} == {
        (2, "embed", "download failed"), (4, "embed", "download failed"), (7, "extract", "no article"), (8, "create", "no title"),
    }
    assert corpus.articles.count() + corpus.rejects.count() == len(BODIES)


def test_cleaning(corpus):
    html = html_of(corpus, 6)
    assert "<object" not in html and "<p>x</p>" not in html and "onclick" not in html
    assert '<a id="i">l</a><a href="https://www.site.example/dir/q?a=1&amp;b=2">r</a>' in html
    assert html.count('alt="image-placeholder"') == 3
    assert '<img src="https://www.site.example/dir/b" alt' in html
    rows = corpus.media.filter("book_id = 6").orderBy("kind", "media_no").collect()
    assert [(r.kind, r.url, r.is_cover) for r in rows] == [
        ("audiovideo", "https://www.site.example/dir/c.mp4", False), ("image", "https://www.site.example/dir/a.jpg", True),
    ]
    for r in rows:
        assert r.local_href in html


def test_metadata(corpus):
    rows = {r.page_id: r for r in corpus.articles.collect()}
    five = rows[5]
    assert (five.title, five.author, five.lang, five.excerpt) == ("Best", "Ann", "de", "D")
    assert five.file_name == "2024-02-03_best.epub" and five.site == "site.example"
    assert rows[0].title == "T" and rows[0].author == "site.example"
    assert five.provenance.published == "Sat, 03 Feb 2024 04:05:06 GMT"
    same = [r for r in rows.values() if r.output_path == "2025-01-06_t.epub"]
    assert len(same) > 1 and [r.page_id for r in same if r.is_latest] == [max(r.page_id for r in same)]


def test_content_root(corpus):
    assert html_of(corpus, 5) == FILLER
    assert html_of(corpus, 1).startswith(FILLER)


def test_book_tables_are_consistent(corpus):
    assert corpus.manifest.groupBy("book_id", "href").count().filter("count > 1").count() == 0
    assert corpus.media.groupBy("book_id", "kind").agg({"media_no": "max", "*": "count"}).filter("`max(media_no)` + 1 != `count(1)`").count() == 0
    spine = corpus.navigation.filter("kind = 'spine'").select("book_id", "id")
    assert spine.join(corpus.manifest.select("book_id", "id"), ["book_id", "id"], "left_anti").count() == 0


def test_write(spark, corpus, tmp_path):
    corpus.write(str(tmp_path / "out"), by_site=True)
    assert spark.read.parquet(str(tmp_path / "out/articles")).count() == corpus.articles.count()
    assert (tmp_path / "out/articles/site=site.example").exists()
    assert spark.read.parquet(str(tmp_path / "out/packages")).filter("cover_id = 'image_0'").count() >= 1


def test_cover_chapter_and_extra_chapters(spark):
    articles = spark.createDataFrame(
        [(1, "A", ["x", "y"], None, None, None, None, "u", "c.png"), (2, "", [], "p", None, "fr", "e", "u", None)],
        "book_id long, title string, author array<string>, publisher string, published_at timestamp_ntz, lang string,"
        " excerpt string, url string, cover string",
    )
    books = book.book_records(articles, f"timestamp_ntz '{RUN_TS}'")
    two = books.filter("book_id = 2").first()
    assert two.author == ["anonymous"] and two.publisher == "p"
    extra = spark.createDataFrame(
        [(2, 3, "Notes", "notes", None, ["n"], False, True)],
        "book_id long, slot int, title string, filename string, type string, author array<string>, exclude_from_toc boolean, before_toc boolean",
    )
    chapters = book.chapters(books, extra)
    rows = [(r.book_id, r.chapter_no, r.href, r.type) for r in chapters.orderBy("book_id", "chapter_no").collect()]
    assert rows == [
        (1, 0, "cover.xhtml", None), (1, 1, "1_a.xhtml", "part bodymatter"), (1, 2, "2_references.xhtml", "backmatter appendix"),
        (2, 0, "0_no-title.xhtml", "part bodymatter"), (2, 1, "1_references.xhtml", "backmatter appendix"), (2, 2, "notes.xhtml", "part bodymatter"),
    ]
    nav = book.navigation(books, chapters, show_toc=True)
    spine = [(r.id, r.linear) for r in nav.filter("kind = 'spine' and book_id = 1").orderBy("nav_no").collect()]
    assert spine == [("cover", "no"), ("toc", None), ("content_1_item_1", None), ("content_2_item_2", None)]
    labels = [r.label for r in nav.filter("kind = 'ncx' and book_id = 2").orderBy("nav_no").collect()]
    assert labels == ["3. Notes", "Table Of Contents", "1. Chapter 1", "2. References"]
    empty = media.media_table(spark.createDataFrame([], "book_id long, kind string, url string, pos int"))
    ids = [r.id for r in book.manifest(books, chapters, empty, fonts=("f.ttf",)).filter("book_id = 1").orderBy("item_no").collect()]
    assert ids == ["cover", "ncx", "toc", "css", "image_cover", "content_1_item_1", "content_2_item_2", "font_0"]
    package = book.package_metadata(books, f"timestamp_ntz '{RUN_TS}'").filter("book_id = 1").first()
    assert (package.creator, package.rights, package.cover_id) == ("x,y", "Copyright © 2025 by anonymous", "image_cover")


def test_attribute_lists_and_hooks(spark, pages):
    rows = attributes(tokens(pages("<p class=a data-x=1 type=script><b type=text><img src='file:///t/a.png' onload=x>")))
    keep = lambda **kw: {(r.tag, r.name) for r in clean.keep_listed(rows, **kw).collect()}
    assert keep() == {("p", "class"), ("p", "type"), ("img", "src")}
    allowed = spark.createDataFrame([("data-x",), ("onload",)], "name string")
    assert keep(allowed=allowed) == {("p", "data-x")}
    assert keep(allowed=allowed, keep="name = 'onload'") == {("p", "data-x"), ("img", "onload")}


def test_legacy_version(spark, pages):
    body = f"<article>{FILLER}<mark data-x='1' title='t' id='i'>m</mark><audio src='a.mp3'></audio></article>"
    made = Corpus(
        spark, pages(page(body)), RUN_TS, version=2, allowed_attributes=("title", "data-x"),
        rewrites=[lambda rows: rows.withColumn("attrs", F.expr("filter(attrs, a -> a.name != 'title')"))],
    )
    html = made.html.first().content_html
    assert '<div data-x="1">m</div>' in html and "<audio" not in html
    assert made.media.count() == 0
    made.release()


def test_built_in_formats_are_walked_by_kind(spark, pages):
    film, post = "https://youtu.be/1", "https://x.com/s/1"
    body = f"<article>{FILLER}<div><iframe src='{film}'></iframe>t</div><blockquote><p>q</p><p><a href='{post}'>u</a></p></blockquote></article>"
    formats = [(film, 0, FRAME_FORMATS[0], "unavailable", 0), (film, 1, "best", "ok", 1), (film, 2, FRAME_FORMATS[2], "ok", 9)]
    formats += [(post, 0, QUOTE_FORMATS[2], "ok", 900), (post, 1, FRAME_FORMATS[0], "error", 1)]
    made = Corpus(
        spark, pages(page(body)), RUN_TS, defaults={"download_media": "true", "target_file_size": "5"},
        formats=spark.createDataFrame(formats, "media_url string, attempt int, format string, status string, size_mib int"),
    )
    got = {r.url: (r.action, (r.media_path or "")[-4:]) for r in made.outcomes.collect()}
    made.release()
    # The last format of a list has no cap; formats that are on no list are not tried.
    assert got == {film: ("media", ".mp4"), post: ("media", ".m4a")}


def test_any_address_is_an_address(spark, pages):
    frames = "".join(f"<div>t<iframe src='{u}'></iframe></div>" for u in ("file:///a/b.html", "skype:echo123?call", "callto:1"))
    quote = "<blockquote><p>q</p><p><a href='whatsapp:hello'>u</a></p></blockquote>"
    head = "<title>T</title><meta property='article:published_time' content='2025/01/06'>"
    rows = pages(page(f"<article>{FILLER}{frames}{quote}</article>", head))
    requests = rows.selectExpr(
        "url", "true as download_media", "cast(null as string) as media_format", "cast(null as int) as target_file_size",
        "cast(null as string) as output", "cast(null as string) as path", "false as create_subfolders", "'https://a.org/c.heic' as cover",
    )
    made = Corpus(spark, rows, RUN_TS, requests=requests)
    assert made.rejects.count() == 0
    html, article = made.html.first().content_html, made.articles.first()
    cover = made.manifest.filter("id = 'image_cover'").first()
    made.release()
    # Links that the sanitizer does not know stay without their address.
    assert html.count("<p><a>Visit .</a></p>") == 2 and '<a href="callto:1">Visit .</a>' in html
    assert str(article.published_at) == "2025-01-06 00:00:00" and cover.media_type == "image/heic"


def test_embeds_are_rows(spark, pages):
    tweet = "<blockquote><p><video src='https://a.org/in.mp4'></video>q</p><p>by <a href='https://x.com/s/1'>u</a></p></blockquote>"
    body = f"<article>{FILLER}{tweet}<div>a<iframe src='https://youtu.be/2'></iframe></div><div>b<iframe src='https://maps.org/3'></iframe></div></article>"
    formats = spark.createDataFrame(
        [("https://x.com/s/1", 0, "best", "ok", 1), ("https://youtu.be/2", 0, "best", "ok", 1)],
        "media_url string, attempt int, format string, status string, size_mib int",
    )
    seen = []

    def plugin(rows):
        seen.append(sorted((r.tag, r.sub) for r in rows.filter("sub > 0 and kind = 'element'").select("tag", "sub").collect()))
        return rows.withColumn("attrs", F.expr("filter(attrs, a -> a.name != 'controls')"))

    options = dict(formats=formats, defaults={"download_media": "true"}, preferences=two_formats(spark), rewrites=[plugin])
    for version in (3, 2):
        made = Corpus(spark, pages(page(body)), RUN_TS, version=version, **options)
        html = made.html.first().content_html
        files = [(r.media_no, r.url[-6:] if r.url.startswith("https") else r.transfer) for r in made.media.orderBy("media_no").collect()]
        hrefs = [r.local_href for r in made.media.collect()]
        made.release()
        assert seen.pop() == [("a", 2), ("a", 6), ("figcaption", 5), ("figure", 1), ("p", 1), ("p", 1), ("video", 2), ("video", 2)]
        assert "controls" not in html
        assert "</blockquote><p><" in html and "<iframe" not in html
        if version == 3:
            # The player after the quote comes after the video inside it.
            assert files == [(0, "in.mp4"), (1, "moved"), (2, "moved")] and all(h in html for h in hrefs)
        else:
            assert files == [] and "<video" not in html and "<figure" not in html and "file://" not in html
            assert '<div><div>There is video content' in html


def test_a_link_inside_an_unclosed_quote_keeps_its_player(spark, pages):
    body = f"<article>{FILLER}<section><blockquote><p>by <a href='https://x.com/s/1'>u</a>"
    formats = spark.createDataFrame([("https://x.com/s/1", 0, "best", "ok", 1)], "media_url string, attempt int, format string, status string, size_mib int")
    made = Corpus(spark, pages(f"<html><body>{body}"), RUN_TS, formats=formats, defaults={"download_media": "true"}, preferences=two_formats(spark))
    html = made.html.first().content_html
    made.release()
    assert "</a></p></blockquote><p><video" in html and html.endswith("</video></p></section>")


def test_a_table_of_types_counts_everywhere(spark, pages):
    body = f"<article>{FILLER}<img src='a.odd'><img src='b.jpg'><img src='c.png?x=1'></article>"
    types = spark.createDataFrame([("odd", "image/x-odd", "odd"), ("PNG", "image/png", "png"), ("cov", "image/x-cov", "cov")], "ext string, media_type string, canonical_ext string")
    rows = pages(page(body))
    requests = rows.selectExpr(
        "url", "false as download_media", "cast(null as string) as media_format", "cast(null as int) as target_file_size",
        "cast(null as string) as output", "cast(null as string) as path", "false as create_subfolders", "'c.cov' as cover",
    )
    made = Corpus(spark, rows, RUN_TS, requests=requests, types=types)
    html = made.html.first().content_html
    files = {(r.media_type, r.extension) for r in made.media.collect()}
    hrefs = [r.local_href for r in made.media.collect()]
    cover = made.manifest.filter("id = 'image_cover'").first()
    made.release()
    assert files == {("image/x-odd", "odd"), ("image/png", "png")} and all(h in html for h in hrefs)
    assert 'src="https://www.site.example/dir/b.jpg"' in html and (cover.href, cover.media_type) == ("cover.cov", "image/x-cov")


def test_lists_as_tables_give_the_same(spark, pages):
    body = f"<article>{FILLER}<mark class='c' data-x='1' title='t' onclick='a()'>m<img src='a.png' alt='' width='3'><br></mark><p>n</p><audio src='a.mp3' controls></audio></article>"
    names, tags = ("title", "className", "alt", "src", "controls"), ("p", "img", "br")
    table = lambda values: spark.createDataFrame([(v,) for v in (*values, values[0])], "name string")
    for version in (3, 2):
        found = []
        for given in (dict(allowed_attributes=names, legacy=tags), dict(allowed_attributes=table(names), legacy=table(tags))):
            made = Corpus(spark, pages(page(body), page(f"<article>{FILLER}</article>")), RUN_TS, version=version, **given)
            found.append(sorted((r.page_id, r.content_html) for r in made.html.collect()))
            made.release()
        assert found[0] == found[1] and 'class="c" title="t"' in found[0][0][1] and "data-x" not in found[0][0][1]


def test_chapters_fonts_and_title_of_the_caller(spark, pages):
    extra = spark.createDataFrame(
        [(0, 3, "Notes", None, None, ["n"], False, True, "https://n.org")],
        "book_id long, slot int, title string, filename string, type string, author array<string>, exclude_from_toc boolean, before_toc boolean, url string",
    )
    made = Corpus(spark, pages(page(f"<article>{FILLER}</article>")), RUN_TS, extra_chapters=extra, fonts=("f.ttf",), toc_title="Inhalt", show_toc=True)
    contents = [(r.part, r.label, r.author, r.url) for r in made.contents.orderBy("part", "entry_no").collect()]
    labels = [r.label for r in made.navigation.filter("kind = 'ncx'").orderBy("nav_no").collect()]
    files = [r.href for r in made.manifest.orderBy("item_no").collect()]
    made.release()
    assert contents == [
        ("contents", "Notes", "n", "https://n.org"), ("contents", "T", None, None), ("contents", "References", None, None),
        ("landmarks", "Table of Contents", None, None), ("landmarks", "Start of Content", None, None),
    ]
    assert labels == ["3. Notes", "Inhalt", "1. T", "2. References"] and files[-1] == "fonts/f.ttf"


@pytest.mark.parametrize(
    "rows, cap, wanted",
    [
        ([(0, "ok", 5)], 10, ("chosen", 0)),
        ([(0, "ok", 50), (1, "ok", 5)], 10, ("chosen", 1)),
        ([(0, "ok", 50), (1, "ok", 60)], 10, ("chosen", 1)),
        ([(0, "ok", 50)], None, ("chosen", 0)),
        ([(0, "unavailable", 0), (1, "ok", 5)], 10, ("chosen", 1)),
        ([(0, "unavailable", 0), (1, "unavailable", 0)], 10, ("failed", None)),
        ([(0, "error", 0), (1, "ok", 5)], 10, ("failed", None)),
        ([(0, "ok", 50), (1, "error", 0)], 10, ("failed", None)),
    ],
)
def test_walk_attempts(spark, rows, cap, wanted):
    formats = spark.createDataFrame([("u", a, "best", s, m) for a, s, m in rows], "media_url string, attempt int, format string, status string, size_mib int")
    row = downloads.walk_attempts(formats, "null" if cap is None else str(cap)).first()
    assert (row.outcome, row.attempt) == wanted


def test_hot_keys_keep_every_row(spark):
    rows = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else concat('k', id) end as k")
    table = rows.filter("k is not null and id % 7 != 0").select("k").distinct().selectExpr("k", "concat(k, '!') as v")
    got = salted_lookup(rows, table, "k", "id").collect()
    known = {r.k for r in table.collect()}
    assert len(got) == 2000
    assert all(r.v == (f"{r.k}!" if r.k in known else None) for r in got)
    latest = latest_per_key(rows.filter("k is not null"), "k", "id % 10", "id")
    assert latest.filter("is_latest and k = 'hot'").first().id == 1999
    assert latest.filter("is_latest").count() == rows.filter("k is not null").select("k").distinct().count()


def test_node_attributes(spark, pages):
    from pageloom.operators.tree import node_attributes

    rows = node_attributes(build_nodes(tokens(pages("<p a=1 b=2><i>x</i>")))).orderBy("attr_no").collect()
    assert [(r.node_id, r.name, r.value) for r in rows] == [(0, "a", "1"), (0, "b", "2")]
