from pageloom.functions.markup import attr
from pageloom.operators import repair
from pageloom.operators.tokens import tokens
from pageloom.operators.tree import assemble, build_nodes
from pageloom.operators.embeds import content_parts


def nodes_of(pages, *html):
    return build_nodes(tokens(pages(*html)))


def choices(pages, tag, inners):
    rows = repair.media_sources(nodes_of(pages, *[f"<{tag}>{i}</{tag}>" for i in inners])).filter(f"tag = '{tag}'")
    found = {r.page_id: tuple(r.choice) if r.choice else None for r in rows.collect()}
    return [found[i] for i in range(len(inners))]


def repaired(pages, *html, **options):
    rows = repair.repair(nodes_of(pages, *html), **options).selectExpr(
        "*", "0 as sub", "0 as sub_end", "cast(null as int) as anchor"
    )
    made = {r.page_id: r.html for r in assemble(rows, ["page_id"], content_parts(), "html").collect()}
    return made[0] if len(html) == 1 else [made[i] for i in range(len(html))]


PICTURES = [
        ('<source type="image/png" srcset="a 1x, b 2x">', ("b", None)),
        # A usable image ends the search and wins.
        ('<source srcset="a"><img src="b" alt="t"><source srcset="c">', ("b", "t")),
        ('<source srcset="a"><img src="data:x" alt="t">', ("a", "t")),
        ('<source srcset="a"><img alt="t">', ("a", "t")),
        # A better listed type replaces a chosen one; a worse one does not.
        ('<source type="image/webp" srcset="w"><source type="image/png" srcset="p">', ("p", None)),
        ('<source type="image/png" srcset="p"><source type="image/webp" srcset="w">', ("p", None)),
        # A type that is not listed ranks first.
        ('<source type="image/png" srcset="p"><source type="image/odd" srcset="o">', ("o", None)),
        ('<source type="image/odd" srcset="o"><source type="image/png" srcset="p">', ("o", None)),
        # Another element cancels, but not after the image ended the search.
        ('<source srcset="a"><span></span>', None),
        ('<img src="b"><span></span>', ("b", "")),
        ('<source srcset="a"><img data-x=1><b></b>', None),
        # Address order, and lists that are skipped.
        ('<source src="a" srcset="b" data-srcset="c">', ("a", None)),
        ('<source src="data:x" srcset="b">', ("b", None)),
        ('<source srcset="data:x" data-srcset="c">', ("c", None)),
        ('<source type="image/png" srcset="x.m3u8"><source type="image/webp" srcset="w">', ("w", None)),
        ('<source srcset="a 1x,">', None),
        ("text only", None),
]


def test_picture_choice(pages):
    assert choices(pages, "picture", [c[0] for c in PICTURES]) == [c[1] for c in PICTURES]


VIDEOS = [
        ('<source src="a.m3u8"><source src="b.mp4">', ("b.mp4", None)),
        ('<source src="a" type="x"><source src="b" type="y">', ("a", None)),
        ('<source src="a"><img src="b">', None),
        ('<source src="a"><p>x</p>', None),
        ('<source src="a">fallback', ("a", None)),
]


def test_video_choice(pages):
    assert choices(pages, "video", [c[0] for c in VIDEOS]) == [c[1] for c in VIDEOS]


def test_picture_and_video_markup(pages):
    assert repaired(
        pages,
        '<div><picture><source srcset="a"><img alt="t &amp; u"></picture>x</div>',
        '<p><video title="t"><source src="a"></video></p>',
        '<video src="a"><source src="b"></video>',
    ) == [
        '<div><img src="a" alt="t &amp; u">x</div>',
        '<p><video src="a" controls="controls" title="t">There is video content at this location that is not'
        " currently supported on your device.</video></p>",
        '<video src="a"><source src="b"></video>',
    ]


def test_wrapper(pages):
    kept = '<div class="mediaplay-image"><div class="image-wrapper"><picture><source srcset="a"><i></i></picture></div></div>'
    assert repaired(
        pages,
        '<p>a</p><div class="x mediaplay-image"><script>1</script><div class="image-wrapper"><img src="a"></div>t</div><p>b</p>',
        '<div class="mediaplay-image"><div class="image-wrapper"><picture><source srcset="a"></picture></div></div>',
        kept,
    ) == ['<p>a</p><img src="a"><p>b</p>', '<img src="a">', kept]


def test_wrapper_needs_both_classes_in_place(pages):
    kept = [
        '<div class="image-wrapper"><img src="a"></div>',
        '<div class="mediaplay-image"><img src="a"></div>',
        '<div class="mediaplay-image"><p class="image-wrapper"><b><img src="a"></b></p></div>',
        '<div class="mediaplay-images"><div class="image-wrapper"><img src="a"></div></div>',
    ]
    assert repaired(pages, *kept) == kept


PLACEHOLDER = '<img src="/placeholder.png" alt="">'


def test_placeholder_and_caption(pages):
    assert repaired(
        pages,
        f'<figure>{PLACEHOLDER}<img src="r"><span>a <b>c</b></span></figure>',
        # The span must be the next element of the kept image.
        '<figure><div><img src="r" alt="placeholder"><img src="s"></div><span>a</span></figure>',
        # The removed image does not stand between.
        f'<figure><img src="r">{PLACEHOLDER}<span>a</span></figure>',
        # Of two plain images the second counts.
        '<figure><img src="a"><img src="b"><span>c</span></figure>',
        # Flattened pictures are images.
        f'<figure><picture><source srcset="p"></picture>{PLACEHOLDER}</figure>',
    ) == [
        '<figure><img src="r"><p>a c</p></figure>',
        '<figure><div><img src="s"></div><span>a</span></figure>',
        '<figure><img src="r"><p>a</p></figure>',
        '<figure><img src="a"><img src="b"><p>c</p></figure>',
        '<figure><img src="p"></figure>',
    ]


def test_first_odd_figure_stops_the_page(pages):
    good = f'<figure>{PLACEHOLDER}<img src="r"></figure>'
    fixed = '<figure><img src="r"></figure>'
    odd = '<figure><img src="o"></figure>'
    double = f"<figure>{PLACEHOLDER}{PLACEHOLDER}</figure>"
    inner = f"<figure>{good}</figure>"
    assert repaired(pages, good + odd + good, good + double + good, inner) == [
        fixed + odd + good, fixed + double + good, f"<figure>{fixed}</figure>",
    ]
    assert repaired(pages, good + odd + good, per_figure=True) == fixed + odd + fixed


def test_nested_figures(pages):
    inner = f'<figure>{PLACEHOLDER}<img src="r"></figure>'
    rows = repair.placeholder_figures(repair.replace_media(nodes_of(pages, f'<figure><img src="a">{inner}</figure>')))
    assert [(r.n_images, r.active) for r in rows.orderBy("figure_id").collect()] == [(3, False), (2, False)]


def test_priority_is_a_parameter(pages):
    html = '<picture><source type="image/png" srcset="p"><source type="image/webp" srcset="w"></picture>'
    row = repair.media_sources(nodes_of(pages, html), ["image/webp", "image/png"]).filter("tag = 'picture'").first()
    assert row.choice.src == "w"
    assert attr("attrs", "src")
