"""The whole job: pages in; articles, media, chapters, manifest, navigation and rejects out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pageloom.functions import naming
from pageloom.functions.urls import short_host
from pageloom.functions.vocab import ALLOWED_ATTRIBUTES, ALLOWED_LEGACY_TAGS, PICTURE_TYPES, QUOTE_HOSTS, VIDEO_HOSTS
from pageloom.operators import book, clean, downloads, embeds, extract, media, repair
from pageloom.operators.lookup import latest_per_key
from pageloom.operators.tokens import tokens
from pageloom.operators.tree import assemble, build_nodes
from pageloom.session import tune
from pageloom.sources import sinks
from pageloom.sources.pages import with_requests
from pageloom.sources.stages import Stages, partitions_for


class Corpus:
    """Tables derived from one page table; each is built on first use.

    Steps that feed several tables are kept as stages (``pageloom.sources.stages``): tables in the cluster's
    shared folder, bucketed by page, so what is built on them shuffles nothing by page again.

    ``rewrites`` are functions over the cleaned content rows, run in order. ``keep_attribute`` is a SQL condition on
    ``a.name``, ``a.value`` and ``tag`` that exempts attributes from the sanitizer.

    Downloads are walked by what each page asks for: its ``media_format``, else the list of ``preferences`` for the kind of embed
    (``kind, prio, format``; built-in lists by default), and its ``target_file_size``. Without ``by_request`` all pages share one
    walk of all formats of an address.

    ``types`` is a table of media types (``ext, media_type, canonical_ext``) in place of the shipped one; ``video_hosts`` and
    ``quote_hosts`` are the short hosts whose frames and quotes may be downloads; ``legacy`` are the tags of version 2. It and
    ``allowed_attributes`` may be tables with a column ``name``. ``extra_chapters`` (see ``book.chapters``), ``fonts`` and
    ``toc_title`` go into every book that they name or that there is.

    ``meta`` may supply ``page_id, published_time, byline, site_name`` that override what pages say.
    """

    def __init__(
        self,
        spark: SparkSession,
        pages: DataFrame,
        run_ts: str,
        requests: DataFrame | None = None,
        formats: DataFrame | None = None,
        meta: DataFrame | None = None,
        defaults: dict[str, str] | None = None,
        version: int = 3,
        show_toc: bool = False,
        per_figure: bool = False,
        picture_types: Sequence[str] = PICTURE_TYPES,
        allowed_attributes: Sequence[str] | DataFrame = ALLOWED_ATTRIBUTES,
        keep_attribute: str = "false",
        rewrites: Sequence[Callable[[DataFrame], DataFrame]] = (),
        clustered: bool = False,
        partitions: int | None = None,
        by_request: bool = True,
        types: DataFrame | None = None,
        preferences: DataFrame | None = None,
        video_hosts: Sequence[str] = VIDEO_HOSTS,
        quote_hosts: Sequence[str] = QUOTE_HOSTS,
        legacy: Sequence[str] | DataFrame = ALLOWED_LEGACY_TAGS,
        extra_chapters: DataFrame | None = None,
        fonts: Sequence[str] = (),
        toc_title: str = book.TOC_TITLE,
    ) -> None:
        self.spark = tune(spark)
        self.pages = pages
        self.run_ts = f"timestamp_ntz '{run_ts}'"
        self.requests, self.formats, self.meta_override = requests, formats, meta
        self.defaults, self.version, self.show_toc, self.per_figure = defaults, version, show_toc, per_figure
        self.picture_types, self.allowed_attributes = picture_types, allowed_attributes
        self.keep_attribute, self.rewrites = keep_attribute, rewrites
        self.clustered, self.by_request = clustered, by_request
        self.types, self.preferences, self.legacy = types, preferences, legacy
        self.video_hosts, self.quote_hosts = video_hosts, quote_hosts
        self.extra_chapters, self.fonts, self.toc_title = extra_chapters, tuple(fonts), toc_title
        self.partitions = partitions or partitions_for(pages.select("page_id", "html"))
        self.stages = Stages(self.spark, self.partitions)

    def release(self) -> None:
        self.stages.release()
        for name in [n for n in vars(self) if isinstance(getattr(type(self), n, None), cached_property)]:
            del self.__dict__[name]

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens(self.pages, self.clustered, self.partitions)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.stages.keep(build_nodes(self.tokens), "nodes")

    @cached_property
    def repaired(self) -> DataFrame:
        return self.stages.keep(repair.repair(self.nodes, self.picture_types, self.per_figure), "repaired")

    @cached_property
    def options(self) -> DataFrame:
        return self.stages.keep(with_requests(self.pages, self.requests, self.defaults), "options")

    @cached_property
    def roots(self) -> DataFrame:
        return extract.article_roots(self.repaired)

    @cached_property
    def raw_content(self) -> DataFrame:
        """Article rows as picked, before links are resolved and embeds replaced."""
        return extract.article_content(self.repaired, self.roots)

    @cached_property
    def content(self) -> DataFrame:
        urls = self.pages.select("page_id", "url")
        return self.stages.keep(extract.with_family(extract.resolve_links(self.raw_content, urls)), "content")

    @cached_property
    def found(self) -> DataFrame:
        asked = self.options.select("page_id", "download_media", "media_format", "target_file_size")
        return embeds.find_embeds(self.content).join(asked, "page_id").selectExpr("*", f"{downloads.wish('url')} as wish")

    @cached_property
    def chosen(self) -> DataFrame | None:
        """Outcome per wish, or per address; the cap is what the page asks for, else a column of ``formats``, or none."""
        if self.formats is None:
            return None
        cap = "cap" if "cap" in self.formats.columns else "null"
        if not self.by_request:
            return downloads.walk_attempts(self.formats, cap)
        wishes = self.found.filter("download_media and host is not null")
        wishes = wishes.selectExpr("wish", "kind", "url as media_url", "media_format", "target_file_size").dropDuplicates(["wish"])
        return downloads.walk_attempts(downloads.requested_attempts(self.formats, wishes, cap, self.preferences), "cap", "wish")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.stages.keep(embeds.embed_outcomes(self.found, self.chosen, self.video_hosts, self.quote_hosts), "outcomes")

    @cached_property
    def embedded(self) -> DataFrame:
        """Article rows with embeds in place, below the content root, without active content."""
        rows = extract.below_single_divs(embeds.apply_embeds(self.content, embeds.embed_rows(self.outcomes)))
        return clean.drop_unsafe(rows)

    @cached_property
    def cleaned(self) -> DataFrame:
        rows = clean.clean_attributes(self.embedded, self.allowed_attributes, self.keep_attribute)
        for rewrite in self.rewrites:
            rows = rows.transform(rewrite)
        return self.stages.keep(clean.legacy_tags(rows, self.legacy) if self.version == 2 else rows, "cleaned")

    @cached_property
    def html(self) -> DataFrame:
        known = media.typed(self.references, "url", self.types) if self.types is not None else None
        rows = clean.localize_media(self.cleaned, self.version, known)
        return assemble(rows, ["page_id"], embeds.content_parts(), "content_html")

    @cached_property
    def references(self) -> DataFrame:
        return media.media_references(self.cleaned, self.version)

    @cached_property
    def meta(self) -> DataFrame:
        """Metadata of every page of the input, also of pages that say nothing."""
        said = extract.metadata(self.nodes)
        if self.meta_override is None:
            return said
        given = self.meta_override.selectExpr(
            "page_id", "published_time as g_time", "byline as g_byline", "site_name as g_site"
        )
        return said.join(given, "page_id", "left").selectExpr(
            "page_id", "title", "coalesce(g_byline, byline) as byline", "coalesce(g_site, site_name) as site_name",
            "coalesce(g_time, published_time) as published_time", "lang", "excerpt",
        )

    @cached_property
    def judged(self) -> DataFrame:
        """One row per page with all article columns and a ``stage``/``reason`` where it is rejected."""
        text = extract.article_text(self.content)
        failed = self.outcomes.filter("action = 'reject'").select("page_id").distinct().selectExpr("page_id", "true as failed")
        rows = (
            self.options.join(self.meta, "page_id", "left")
            .join(text, "page_id", "left")
            .join(self.html, "page_id", "left")
            .join(failed, "page_id", "left")
        )
        rows = media.typed(rows, "cover", self.types, "page_id").withColumnRenamed("extension", "cover_extension").drop("media_type")
        rows = rows.selectExpr("*", f"{short_host('url')} as host").selectExpr(
            "*",
            "coalesce(nullif(site_name, ''), host) as site",
            f"{naming.published_at('published_time', self.run_ts)} as published_at",
        )
        reason = (
            "case when coalesce(url, '') = '' then 'scan: no url' when host is null then 'scan: invalid url'"
            " when coalesce(text_content, content_html) is null then 'extract: no article'"
            " when failed then 'embed: download failed' when coalesce(title, '') = '' then 'create: no title'"
            " when cover is not null and cover_extension is null then 'book: unknown cover type'"
            " when published_at is null then 'create: invalid date' end"
        )
        return self.stages.keep(rows.selectExpr("*", f"{reason} as verdict"), "judged")

    @cached_property
    def rejects(self) -> DataFrame:
        return self.judged.filter("verdict is not null").selectExpr(
            "page_id", "url", "split(verdict, ': ')[0] as stage", "split(verdict, ': ')[1] as reason"
        )

    @cached_property
    def articles(self) -> DataFrame:
        run, name = self.run_ts, naming.file_name("published_at", "title")
        author = naming.author("byline", "site")
        path = naming.output_path("file_name", "site", "output", "path", "create_subfolders")
        rows = (
            self.judged.filter("verdict is null")
            .selectExpr("*", f"{author} as author", f"{name} as file_name", "sha2(coalesce(text_content, ''), 256) as content_sha256")
            .selectExpr(
                "page_id", "url", "site", "title", "author", "site as publisher", "published_at",
                f"{naming.language('lang')} as lang", "excerpt", "coalesce(text_content, '') as text_content",
                "coalesce(content_html, '') as content_html", "content_sha256", "file_name", f"{path} as output_path", "cover",
                f"named_struct('published', {naming.http_date('published_at')}, 'author', author, 'url', url, 'site', site,"
                f" 'fetched', {naming.http_date(run)}, 'hash', content_sha256) as provenance",
            )
        )
        return self.stages.keep(latest_per_key(rows, "output_path", "page_id", "page_id"), "articles")

    @cached_property
    def books(self) -> DataFrame:
        rows = self.articles.selectExpr(
            "page_id as book_id", "title", "array(author) as author", "publisher", "published_at", "lang", "excerpt",
            "url", "cover",
        )
        return book.book_records(rows, self.run_ts, self.types)

    @cached_property
    def media(self) -> DataFrame:
        """Media of the accepted pages."""
        found = media.media_table(self.references, self.books.select("book_id", "cover"), self.types)
        accepted = found.join(self.books.select("book_id"), "book_id", "left_semi")
        return self.stages.keep(accepted, "media", "book_id")

    @cached_property
    def chapters(self) -> DataFrame:
        return book.chapters(self.books, self.extra_chapters)

    @cached_property
    def manifest(self) -> DataFrame:
        return book.manifest(self.books, self.chapters, self.media, self.version, self.fonts)

    @cached_property
    def navigation(self) -> DataFrame:
        return book.navigation(self.books, self.chapters, self.show_toc, self.toc_title, self.version)

    @cached_property
    def contents(self) -> DataFrame:
        return book.contents(self.books, self.chapters, self.show_toc)

    def outputs(self) -> dict[str, DataFrame]:
        """Every output table by its name."""
        return {
            "articles": self.articles, "rejects": self.rejects, "media": self.media, "chapters": self.chapters, "manifest": self.manifest,
            "navigation": self.navigation, "contents": self.contents, "packages": book.package_metadata(self.books, self.run_ts, self.media),
        }

    def write(self, folder: str, by_site: bool = False) -> None:
        """Write every output table below ``folder``."""
        for name, rows in self.outputs().items():
            if name == "articles":
                sinks.write_articles(rows, f"{folder}/{name}", by_site)
            else:
                sinks.write_table(rows, f"{folder}/{name}")
