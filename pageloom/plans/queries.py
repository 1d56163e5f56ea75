"""The registered queries: each takes a session and a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pageloom.functions import naming, one_of
from pageloom.functions.markup import attr, unescape
from pageloom.functions.srcset import best_candidate
from pageloom.functions.urls import absolute_url, address, short_host, short_name
from pageloom.functions.vocab import SAFE_TAGS
from pageloom.operators import book, clean, downloads, embeds, extract, media, repair, rollup
from pageloom.operators.lookup import latest_per_key
from pageloom.operators.tokens import attributes, tokens
from pageloom.operators.tree import exprs, serialize
from pageloom.plans import inputs
from pageloom.plans.corpus import Corpus
from pageloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_CORPORA: dict[tuple, Corpus] = {}
RUN = f"timestamp_ntz '{inputs.RUN_TS}'"
TITLE = unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _corpus(spark: SparkSession, sf_dir: str, kind: str) -> Corpus:
    """Corpora share their stages between the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _CORPORA:
        if kind == "rich":
            made = Corpus(
                spark, inputs.derive(spark, sf_dir, inputs.PAGES_RICH), inputs.RUN_TS,
                requests=inputs.derive(spark, sf_dir, inputs.REQUESTS),
                formats=inputs.derive(spark, sf_dir, inputs.FORMATS_SPARK),
            )
        elif kind == "hostile":
            made = Corpus(spark, inputs.derive(spark, sf_dir, inputs.PAGES_HOSTILE), inputs.RUN_TS)
        elif kind == "bad":
            made = Corpus(spark, inputs.derive(spark, sf_dir, inputs.PAGES_BAD), inputs.RUN_TS)
        elif kind == "meta":
            dated = inputs.derive(spark, sf_dir, inputs.PAGES_META)
            made = Corpus(spark, dated.select("page_id", "url", "html"), inputs.RUN_TS, meta=dated)
        else:
            made = Corpus(spark, inputs.table(spark, sf_dir, "pages"), inputs.RUN_TS)
        _CORPORA[key] = made
    return _CORPORA[key]


def release_all() -> None:
    """Drop the stages of every corpus."""
    for corpus in _CORPORA.values():
        corpus.release()
    _CORPORA.clear()


def _dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with title, site and the publishing time of the event of the same number."""
    pages = inputs.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", f"{short_host('url')} as site", f"{TITLE} as title"
    )
    events = inputs.table(spark, sf_dir, "events").selectExpr("event_id as page_id", "ts")
    return pages.join(events, "page_id", "left").selectExpr("*", f"coalesce(ts, {RUN}) as published_at")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _dated_pages(spark, sf_dir).selectExpr("*", f"{naming.file_name('published_at', 'title')} as file_name")
    path = naming.output_path("file_name", "site", subfolders="true")
    return latest_per_key(named.selectExpr("*", f"{path} as output_path"), "output_path", "published_at", "page_id")


@query
def article_paths(spark, sf_dir):
    """Which file every page would become, and whether a later page replaces it."""
    return _paths(spark, sf_dir).select("page_id", "site", "title", "output_path", "is_latest")


@query
def latest_article_per_path(spark, sf_dir):
    return _paths(spark, sf_dir).filter("is_latest").selectExpr("output_path", "page_id", "url", f"{naming.date_text('published_at')} as published")


@query
def address_parts(spark, sf_dir):
    """Scheme, host, path, query and fragment of addresses of all kinds; none where a text is no address."""
    rows = inputs.derive(spark, sf_dir, inputs.PAGE_ADDRESSES).selectExpr("*", f"{address('address')} as a")
    return rows.selectExpr("page_id", "address", "a.scheme", "a.host", f"{short_name('a.host')} as short", "a.path", "a.query", "a.fragment")


@query
def published_times(spark, sf_dir):
    """Publishing times written in many forms, read and shown in UTC."""
    rows = inputs.derive(spark, sf_dir, inputs.EVENT_DATES)
    return rows.selectExpr("event_id", "given", f"date_format({naming.published_at('given', RUN)}, 'yyyy-MM-dd HH:mm:ss') as published")


@query
def media_types(spark, sf_dir):
    """Type and extension of media addresses, by the shipped list and by a caller's table."""
    rows = media.typed(inputs.derive(spark, sf_dir, inputs.MEDIA_ADDRESSES), "url")
    own = media.typed(rows.withColumnsRenamed({"media_type": "shipped_type", "extension": "shipped_extension"}), "url", spark.sql(inputs.OWN_TYPES), "page_id")
    return own.selectExpr("page_id", "url", "shipped_type", "shipped_extension", "media_type as own_type", "extension as own_extension")


@query
def page_tokens(spark, sf_dir):
    return tokens(inputs.table(spark, sf_dir, "pages")).select("page_id", "pos", "kind", "tag", "tok")


@query
def link_attributes(spark, sf_dir):
    """Every attribute of every tag, links also in absolute form."""
    pages = inputs.derive(spark, sf_dir, inputs.PAGES_RICH)
    rows = attributes(tokens(pages)).join(pages.select("page_id", "url"), "page_id")
    linked = "name in ('href', 'src') and value is not null"
    return rows.selectExpr(
        "page_id", "pos", "tag", "attr_no", "name", "value",
        f"if({linked}, {absolute_url('url', 'value')}, null) as absolute",
    )


@query
def page_nodes(spark, sf_dir):
    return _corpus(spark, sf_dir, "rich").nodes.select(
        "page_id", "node_id", "end_id", "parent_id", "depth", "sib_no", "kind", "tag", "only_child", "last_child"
    )


@query
def page_roundtrip(spark, sf_dir):
    """Pages written back from their trees, as length and hash."""
    pages = serialize(_corpus(spark, sf_dir, "rich").nodes)
    return pages.selectExpr("page_id", "length(html) as n_chars", "sha2(html, 256) as html_sha256")


@query
def article_text_hash(spark, sf_dir):
    text = extract.article_text(_corpus(spark, sf_dir, "plain").content)
    return text.selectExpr("page_id", "length(text_content) as n_chars", "sha2(text_content, 256) as content_sha256")


@query
def site_rollup(spark, sf_dir):
    corpus = _corpus(spark, sf_dir, "plain")
    text = extract.article_text(corpus.content).selectExpr("page_id", "sha2(text_content, 256) as content_sha256")
    rows = _dated_pages(spark, sf_dir).join(text, "page_id", "left")
    return rollup.site_rollup(rows).selectExpr(
        "site", "n_articles", "n_texts", "cast(first_at as string) as first_at", "cast(last_at as string) as last_at"
    )


@query
def duplicate_articles(spark, sf_dir):
    """Groups of pages with one text, over the pages and their damaged copies."""
    corpus = _corpus(spark, sf_dir, "bad")
    text = extract.article_text(corpus.content).selectExpr("page_id", "sha2(text_content, 256) as content_sha256")
    return rollup.duplicate_groups(text)


@query
def article_metadata(spark, sf_dir):
    """Title, author, site, dates, language, path and provenance of every accepted article."""
    return _corpus(spark, sf_dir, "meta").articles.selectExpr(
        "page_id", "title", "author", "publisher", "site", "lang", "cast(published_at as string) as published_at",
        "provenance.published as published_text", "provenance.fetched as fetched_text", "provenance.hash as content_sha256",
        "file_name", "output_path", "is_latest",
    )


@query
def rejected_pages(spark, sf_dir):
    return _corpus(spark, sf_dir, "bad").rejects


@query
def rejected_embeds(spark, sf_dir):
    """Pages rejected for a date, a cover or a download, over pages with media and requests."""
    return _corpus(spark, sf_dir, "rich").rejects


def _choices(spark, sf_dir, tag):
    return repair.media_sources(_corpus(spark, sf_dir, "rich").nodes).filter(f"tag = '{tag}'")


@query
def picture_choice(spark, sf_dir):
    return _choices(spark, sf_dir, "picture").selectExpr("page_id", "node_id", "choice.src as src", "choice.alt as alt")


@query
def video_choice(spark, sf_dir):
    return _choices(spark, sf_dir, "video").selectExpr(
        "page_id", "node_id", "choice.src as src", f"{attr('attrs', 'title')} as title"
    )


@query
def source_lists(spark, sf_dir):
    """Best entry of every source list of the pages."""
    rows = attributes(tokens(inputs.derive(spark, sf_dir, inputs.PAGES_RICH))).filter("name = 'srcset'")
    return rows.selectExpr("page_id", "pos", "value", f"{best_candidate('value')} as best")


@query
def placeholder_images(spark, sf_dir):
    nodes = _corpus(spark, sf_dir, "rich").nodes
    return repair.placeholder_figures(nodes.transform(repair.replace_media).transform(repair.unwrap_images))


@query
def wrapper_removal(spark, sf_dir):
    """Images taken out of their double wrapper, with their new parent."""
    return _corpus(spark, sf_dir, "rich").repaired.filter("wrapper_id is not null").selectExpr(
        "page_id", "node_id", "wrapper_id", "parent_id", "parent_tag", f"{attr('attrs', 'src')} as src"
    )


@query
def iframe_links(spark, sf_dir):
    """Markup that replaces each frame when no media is wanted."""
    found = embeds.find_embeds(_corpus(spark, sf_dir, "rich").content).selectExpr("*", "false as download_media")
    markup = embeds.embed_markup(embeds.embed_outcomes(found, None))
    return markup.select("page_id", "target_id", "place", "html")


@query
def embed_outcomes(spark, sf_dir):
    return _corpus(spark, sf_dir, "rich").outcomes.select("page_id", "kind", "url", "host", "action", "media_path")


@query
def quote_media(spark, sf_dir):
    """Videos found for quotes, with the markup that follows the quote."""
    corpus = _corpus(spark, sf_dir, "rich")
    markup = embeds.embed_markup(corpus.outcomes.filter("kind = 'quote'"))
    return markup.select("page_id", "target_id", "place", "html")


@query
def article_html(spark, sf_dir):
    """Cleaned HTML of every article."""
    return _corpus(spark, sf_dir, "rich").html.selectExpr("page_id", "length(content_html) as n_chars", "content_html")


@query
def clean_attributes(spark, sf_dir):
    """Attributes that survive the sanitizer and the list, over all tags of the pages."""
    rows = attributes(tokens(inputs.derive(spark, sf_dir, inputs.PAGES_RICH)))
    return clean.keep_listed(rows).select("page_id", "pos", "tag", "name", "value")


@query
def hostile_markup(spark, sf_dir):
    """What is left of markup that attacks the sanitizer, and what it would give when it is cut into tags again: attributes that
    run scripts, and tags that are not listed as safe."""
    html = _corpus(spark, sf_dir, "hostile").html
    again = tokens(html.selectExpr("page_id", "content_html as html"))
    bad = attributes(again).groupBy("page_id").agg(*exprs(f"count_if(not {clean.is_safe('tag', 'name', 'value')}) as n_handlers"))
    tags = again.groupBy("page_id").agg(*exprs(f"count_if(tag != '' and not {one_of('tag', SAFE_TAGS)}) as n_unlisted"))
    fragment = "regexp_extract(content_html, '(?s)<h6>begin</h6>(.*?)(?:<h6>end</h6>|$)', 1) as fragment_html"
    joined = html.selectExpr("page_id", fragment).join(bad, "page_id", "left").join(tags, "page_id", "left")
    return joined.selectExpr("page_id", "fragment_html", "coalesce(n_handlers, 0) as n_handlers", "coalesce(n_unlisted, 0) as n_unlisted")


@query
def image_texts(spark, sf_dir):
    """Alternative text of every image after cleaning."""
    return _corpus(spark, sf_dir, "rich").cleaned.filter("tag = 'img'").selectExpr(
        "page_id", "node_id", f"{attr('attrs', 'alt')} as alt"
    )


@query
def legacy_tags(spark, sf_dir):
    """Element counts of every article by tag in the version 2 output."""
    rows = clean.legacy_tags(_corpus(spark, sf_dir, "rich").cleaned.filter("kind = 'element'"))
    return rows.groupBy("page_id", "tag").agg(*exprs("count(*) as n"))


@query
def media_table(spark, sf_dir):
    return media.media_table(_corpus(spark, sf_dir, "rich").references)


@query
def media_links(spark, sf_dir):
    corpus = _corpus(spark, sf_dir, "rich")
    rows = media.media_links(corpus.references, media.media_table(corpus.references))
    return rows.select("book_id", "node_id", "kind", "url", "local_href")


@query
def book_chapters(spark, sf_dir):
    return _corpus(spark, sf_dir, "rich").chapters.selectExpr(
        "book_id", "chapter_no", "item_id", "href", "title", "type", "array_join(author, ',') as author",
        "exclude_from_toc", "before_toc", "is_cover",
    )


@query
def book_manifest(spark, sf_dir):
    return _corpus(spark, sf_dir, "rich").manifest


@query
def book_navigation(spark, sf_dir):
    corpus = _corpus(spark, sf_dir, "rich")
    return book.navigation(corpus.books, corpus.chapters, show_toc=True)


@query
def book_contents(spark, sf_dir):
    """The contents list and landmarks of every book, with a further chapter for books whose number three divides."""
    corpus = _corpus(spark, sf_dir, "rich")
    extra = corpus.books.filter("book_id % 3 = 0").selectExpr(
        "book_id", "3 as slot", "'' as title", "cast(null as string) as filename", "'notes' as type", "array('A', 'B') as author",
        "concat('https://n.example/', book_id) as url", "false as exclude_from_toc", "book_id % 2 = 0 as before_toc",
    )
    return book.contents(corpus.books, book.chapters(corpus.books, extra), show_toc=True)


@query
def package_metadata(spark, sf_dir):
    corpus = _corpus(spark, sf_dir, "rich")
    return book.package_metadata(corpus.books, corpus.run_ts, corpus.media)


@query
def log_progress(spark, sf_dir):
    log = inputs.derive(spark, sf_dir, inputs.MEDIA_LOG)
    return downloads.log_events(log).selectExpr(
        "download_id", "attempt", "cast(ts as string) as ts", "event_type", "event_data",
        "progress.percent", "progress.total_size", "progress.speed", "progress.eta",
    )


@query
def log_size_peaks(spark, sf_dir):
    return downloads.size_peaks(inputs.derive(spark, sf_dir, inputs.MEDIA_LOG))


@query
def format_fallback(spark, sf_dir):
    """What comes of each thing that pages ask of an address: the formats named, or those built in for its kind, in order."""
    corpus = _corpus(spark, sf_dir, "rich")
    asked = corpus.found.filter("download_media and host is not null").select("wish", "kind", "url", "media_format", "target_file_size")
    return corpus.chosen.join(asked.dropDuplicates(["wish"]), "wish").select(
        "kind", "url", "media_format", "target_file_size", "outcome", "attempt", "format", "container", "size_mib"
    )


@query
def address_walk(spark, sf_dir):
    """The same over all formats of an address, whatever is asked."""
    return downloads.walk_attempts(inputs.derive(spark, sf_dir, inputs.FORMATS_SPARK), "cap")


@query
def download_attempts(spark, sf_dir):
    """Formats each embed would try, in order."""
    corpus = _corpus(spark, sf_dir, "rich")
    rows = corpus.outcomes.join(corpus.options.select("page_id", "media_format"), "page_id")
    return downloads.attempts(rows, corpus.preferences).select("page_id", "kind", "url", "attempt", "format", "container")


@query
def transfer_plan(spark, sf_dir):
    """How the cover and every media file of a book would be fetched."""
    corpus = _corpus(spark, sf_dir, "rich")
    files = media.media_table(corpus.references).selectExpr("book_id", "kind", "url", "transfer")
    covers = corpus.options.filter("cover is not null").selectExpr(
        "page_id as book_id", "'cover' as kind", "cover as url", f"{media.transfer_class('cover', 'true')} as transfer"
    )
    return files.unionByName(covers)


@query
def oversize_breaches(spark, sf_dir):
    log = inputs.derive(spark, sf_dir, inputs.MEDIA_LOG)
    rows = downloads.oversize_breaches(log, inputs.CAP_MIB, inputs.LAST_ATTEMPT)
    return rows.selectExpr("download_id", "attempt", "cast(ts as string) as ts", "size_mib")
