"""Book tables: records, chapters, manifest, navigation. Everything is keyed by ``book_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions import naming, text
from pageloom.functions.media import stable_id
from pageloom.operators.media import typed
from pageloom.operators.tree import exprs

XHTML = "application/xhtml+xml"
TOC_TITLE = "Table Of Contents"


def book_records(articles: DataFrame, run_ts: str, types: DataFrame | None = None) -> DataFrame:
    """Defaults of a book. ``articles``: ``book_id, title, author (array), publisher, published_at, lang,
    excerpt, url, cover``. An unknown cover type leaves ``cover_type`` null; such books are rejected."""
    return typed(articles, "cover", types).selectExpr(
        "book_id", "title",
        "if(author is null or size(author) = 0, array('anonymous'), author) as author",
        "coalesce(publisher, 'anonymous') as publisher",
        f"coalesce(published_at, {run_ts}) as published_at",
        "coalesce(lang, 'en') as lang", "excerpt as description", "url as source", "cover",
        "media_type as cover_type", "extension as cover_extension",
    )


def package_metadata(books: DataFrame, run_ts: str, media: DataFrame | None = None) -> DataFrame:
    """The package record. With ``media``, books without a cover name their first image as one."""
    first_image = "cast(null as string)"
    if media is not None:
        firsts = media.filter("kind = 'image' and media_no = 0").selectExpr("book_id", "true as has_image")
        books = books.join(firsts, "book_id", "left")
        first_image = "if(has_image, 'image_0', null)"
    return books.selectExpr(
        "book_id", "title", f"{stable_id('book_id', "'book'", 'source')} as identifier", "lang as language",
        "array_join(author, ',') as creator", "publisher", f"{naming.iso_text('published_at')} as date",
        f"{naming.rights_line(run_ts, 'publisher')} as rights", f"{naming.modified_text(run_ts)} as modified",
        "nullif(description, '') as description", "nullif(source, '') as source",
        f"if(cover is not null, 'image_cover', {first_image}) as cover_id",
    )


def chapters(books: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Cover (if any), article, references, numbered from 0 in each book.

    ``extra`` adds chapters of the caller's: ``book_id, slot, title, filename, type, author, exclude_from_toc,
    before_toc`` with ``slot`` above 2, and ``url`` where there is one.
    """
    columns = (
        "book_id", "slot", "title", "filename", "type", "author", "url", "exclude_from_toc", "before_toc", "is_cover",
    )
    no_author = "cast(array() as array<string>) as author"
    none = "cast(null as string)"
    # The content chapters of a book are made in its own row: one scan instead of a union of three.
    slots = (
        "array(if(cover is not null, named_struct('slot', 0, 'title', 'cover', 'type', cast(null as string), 'is_cover', true), null),"
        " named_struct('slot', 1, 'title', title, 'type', cast(null as string), 'is_cover', false),"
        " named_struct('slot', 2, 'title', 'References', 'type', 'backmatter appendix', 'is_cover', false))"
    )
    rows = (
        books.selectExpr("book_id", f"explode_outer({slots}) as c")
        .filter("c is not null")
        .selectExpr(
            "book_id", "c.slot", "c.title", f"{none} as filename", "c.type", no_author, f"{none} as url",
            "c.is_cover as exclude_from_toc", "c.is_cover as before_toc", "c.is_cover",
        )
    )
    if extra is not None:
        added = extra.selectExpr(
            "book_id", "slot", "title", "filename", "type", "coalesce(author, array()) as author",
            "url" if "url" in extra.columns else f"{none} as url", "coalesce(exclude_from_toc, false) as exclude_from_toc", "coalesce(before_toc, false) as before_toc",
            "false as is_cover",
        )
        rows = rows.select(*columns).unionByName(added.select(*columns))
    number = "row_number() over (partition by book_id order by slot) - 1"
    return rows.selectExpr("*", f"{number} as chapter_no").selectExpr(
        "book_id", "chapter_no", "concat('item_', chapter_no) as item_id",
        f"if(is_cover, 'cover.xhtml', {naming.chapter_file('chapter_no', 'title', 'filename')}) as href",
        "title", "if(is_cover, null, coalesce(nullif(type, ''), 'part bodymatter')) as type", "author", "url",
        "exclude_from_toc", "before_toc", "is_cover",
    )


def manifest(books: DataFrame, chapter_rows: DataFrame, media: DataFrame, version: int = 3,
             fonts: tuple[str, ...] = ()) -> DataFrame:
    """All files of a book in their fixed order: ``book_id, item_no, id, href, media_type, properties``."""
    nav, svg, image = ("'nav'", "'svg'", "'cover-image'") if version != 2 else ("null",) * 3
    item = lambda s, i, h, m, p="null": (
        f"named_struct('section', {s}, 'no', 0, 'id', {i}, 'href', {h}, 'media_type', {m}, 'properties', cast({p} as string))"
    )
    fixed = ", ".join(
        [
            f"if(cover is not null, {item(0, "'cover'", "'cover.xhtml'", f"'{XHTML}'", svg)}, null)",
            item(1, "'ncx'", "'toc.ncx'", "'application/x-dtbncx+xml'"),
            item(2, "'toc'", "'toc.xhtml'", f"'{XHTML}'", nav),
            item(3, "'css'", "'style.css'", "'text/css'"),
            f"if(cover is not null, {item(4, "'image_cover'", "concat('cover.', cover_extension)", 'cover_type', image)}, null)",
        ]
        + [item(8 + i, f"'font_{i}'", text(f"fonts/{f}"), "'application/x-font-ttf'") for i, f in enumerate(fonts)]
    )
    base = (
        books.selectExpr("book_id", f"explode_outer(array({fixed})) as f")
        .filter("f is not null")
        .selectExpr("book_id", "f.*")
    )
    files = media.filter("kind = 'image'" if version == 2 else "true").selectExpr(
        "book_id", "if(kind = 'image', 5, 6) as section", "media_no as no",
        "concat(if(kind = 'image', 'image_', 'media_'), media_no) as id", "local_href as href", "media_type",
        f"cast(if(is_cover, {image}, null) as string) as properties",
    )
    texts = chapter_rows.filter("not is_cover").selectExpr(
        "book_id", "7 as section", "chapter_no as no", "concat('content_', chapter_no, '_', item_id) as id", "href",
        f"'{XHTML}' as media_type", "cast(null as string) as properties",
    )
    rows = base.unionByName(files).unionByName(texts)
    number = "row_number() over (partition by book_id order by section, no) - 1 as item_no"
    return rows.selectExpr("book_id", number, "id", "href", "media_type", "properties")


def navigation(books: DataFrame, chapter_rows: DataFrame, show_toc: bool = False, toc_title: str = TOC_TITLE,
               version: int = 3) -> DataFrame:
    """Reading order (``spine``) and table of contents (``ncx``), each numbered from 0.

    Chapters before the contents come first, then the cover (spine only, not linear), the contents page
    when shown, and the other chapters; excluded chapters are left out.
    """
    listed = chapter_rows.filter("not exclude_from_toc").selectExpr(
        "book_id", "explode_outer(array('spine', 'ncx')) as kind", "if(before_toc, 0, 3) as grp", "chapter_no as no",
        "concat('content_', chapter_no, '_', item_id) as id", "href",
        "concat(cast(chapter_no + 1 as string), '. ', coalesce(nullif(title, ''), concat('Chapter ', chapter_no + 1))) as label",
        "cast(null as string) as linear",
    )
    fixed = lambda kind, grp, name, href, label, linear: (
        f"named_struct('kind', '{kind}', 'grp', {grp}, 'no', 0, 'id', '{name}', 'href', '{href}',"
        f" 'label', cast({label} as string), 'linear', cast({linear} as string))"
    )
    label = text(toc_title)
    entries = [f"if(cover is not null, {fixed('spine', 1, 'cover', 'cover.xhtml', 'null', "'no'" if version != 2 else 'null')}, null)"]
    if show_toc:
        entries += [fixed(k, 2, "toc", "toc.xhtml", label, "null") for k in ("spine", "ncx")]
    base = (
        books.selectExpr("book_id", f"explode_outer(array({', '.join(entries)})) as f")
        .filter("f is not null")
        .selectExpr("book_id", "f.*")
    )
    return (
        listed.unionByName(base)
        .selectExpr("*", "row_number() over (partition by book_id, kind order by grp, no) - 1 as nav_no")
        .selectExpr("book_id", "nav_no", "kind", "id", "href", "if(kind = 'ncx', label, null) as label", "linear")
    )


def contents(books: DataFrame, chapter_rows: DataFrame, show_toc: bool = False) -> DataFrame:
    """What the contents page shows: ``book_id, part, entry_no, type, href, label, author, url``.

    ``part`` contents: the chapters that are not excluded, those before the contents first, without numbers in their labels,
    with author and address where they have them. ``part`` landmarks: the cover, the contents page when shown, and
    the first of those chapters as the start of the text. Everything comes of one aggregation per book and its own row.
    """
    entry = (
        "struct(not before_toc as later, chapter_no, href, coalesce(nullif(title, ''), concat('Chapter ', chapter_no + 1)) as label,"
        " nullif(array_join(author, ','), '') as author, nullif(url, '') as url)"
    )
    listed = chapter_rows.filter("not exclude_from_toc").groupBy("book_id").agg(*exprs(
        f"array_sort(collect_list({entry})) as entries", "min(struct(chapter_no, href)).href as start",
    ))
    row = lambda part, no, kind, href, label, author="null", url="null": (
        f"named_struct('part', '{part}', 'entry_no', {no}, 'type', {kind}, 'href', {href}, 'label', {label},"
        f" 'author', cast({author} as string), 'url', cast({url} as string))"
    )
    shown = f"transform(entries, (e, i) -> {row('contents', 'i', 'cast(null as string)', 'e.href', 'e.label', 'e.author', 'e.url')})"
    marks = [f"if(cover is not null, {row('landmarks', '0', "'cover'", "'cover.xhtml'", "'Cover'")}, null)"]
    if show_toc:
        marks.append(row("landmarks", "1", "'toc'", "'#toc'", "'Table of Contents'"))
    marks.append(f"if(start is not null, {row('landmarks', '2', "'bodymatter'", 'start', "'Start of Content'")}, null)")
    rows = books.select("book_id", "cover").join(listed, "book_id", "left").selectExpr(
        "book_id", f"explode(filter(concat(array({', '.join(marks)}), coalesce({shown}, array())), r -> r is not null)) as r"
    )
    number = "row_number() over (partition by book_id, part order by r.entry_no) - 1 as entry_no"
    return rows.selectExpr("book_id", "r", "r.part as part").selectExpr(
        "book_id", "part", number, "r.type as type", "r.href as href", "r.label as label", "r.author as author", "r.url as url"
    )
