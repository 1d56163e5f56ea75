"""Markup that attacks the sanitizer: readings of plain-text elements, and random pages whose output must read the same again."""

from __future__ import annotations

import random

import pytest

from pageloom.functions.vocab import SAFE_TAGS
from pageloom.operators import clean
from pageloom.operators.tokens import attributes, tokens
from pageloom.operators.tree import build_nodes, serialize
from pageloom.plans.corpus import Corpus

RUN_TS = "2025-01-06 00:00:00"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<title>a <b> c</title>d", ["<title>", "a <b> c", "</title>", "d"]),
        ("<TITLE x='>'>a <!-- b --> c</Title >d", ["<TITLE x='>'>", "a <!-- b --> c", "</Title >", "d"]),
        ("<textarea><p title=\"</textarea>\">", ["<textarea>", '<p title="', "</textarea>", '">']),
        ("<xmp>a &lt; b</xmp>&lt;", ["<xmp>", "a &amp;lt; b", "</xmp>", "&lt;"]),
        ("<xmp></xmp><xmper><b></xmper>", ["<xmp>", "</xmp>", "<xmper>", "<b>", "</xmper>"]),
        ("<p><plaintext>a</plaintext><b>", ["<p>", "<plaintext>", "a</plaintext><b>"]),
        ("<textarea>open <b>", ["<textarea>", "open <b>"]),
        ("<iframe src=a><b></iframe><i>", ["<iframe src=a>", "</iframe>", "<i>"]),
        ("<noscript><img></noscript><noframes><b></noframes><noembed>x</noembed>y", ["y"]),
        ("<xmp><script></xmp>a</script>", ["<xmp>", "<script>", "</xmp>", "a", "</script>"]),
        ("<title>plain</title>", ["<title>", "plain", "</title>"]),
    ],
)
def test_plain_text_ends_at_its_own_tag(pages, html, expected):
    assert [r.tok for r in tokens(pages(html)).orderBy("pos").collect()] == expected


def test_plain_text_is_text(pages):
    rows = tokens(pages("<title><!x></title><textarea></p><a></textarea>")).orderBy("pos").collect()
    assert [(r.kind, r.tag) for r in rows] == [
        ("open", "title"), ("text", ""), ("close", "title"), ("open", "textarea"), ("text", ""), ("close", "textarea"),
    ]


def test_long_plain_text_does_not_recurse(pages):
    html = ["<textarea>" + "<a " * 50_000, "<xmp>" + "</xm" * 50_000, "<title>" + "&<" * 50_000 + "</title>x", "<iframe" + " a='<'" * 20_000 + ">" + "<" * 50_000]
    assert tokens(pages(*html)).count() == 2 + 2 + 4 + 1


PIECES = [
    "<p>", "</p>", "<div>", "</div>", "<xmp>", "</xmp>", "<textarea>", "</textarea>", "<title>", "</title>", "<noscript>", "</noscript>", "<svg>",
    "</svg>", "<style>", "</style>", "<math>", "<mtext>", "</math>", "<!--", "-->", "<script>", "</script>", "<plaintext>", "<table>", "<select>", "<option>",
    '<img src=x onerror=alert(1)>', '<a href="javascript:a()" onclick=b>', "</a>", '<p title="', '">', "'", '"', "<", ">", "&lt;", "&#60;img onload=x&#62;",
    "<iframe src='javascript:x'>", "</iframe>", "<x-y onx=1>", "text", "<b a='</b><img onerror=z>'>", "<template>", "<embed src=a>", "<form action=javascript:1>",
]


def test_output_reads_the_same_again(spark, pages):
    rng = random.Random(11)
    filler = "<p>Some words of text, long enough to be taken for an article, twice.</p>" * 2
    html = [f"<html><body><article>{filler}{''.join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))}</article></body></html>" for _ in range(400)]
    made = Corpus(spark, pages(*html), RUN_TS)
    out = made.html.selectExpr("page_id", "content_html as html")
    again = tokens(out)
    assert out.count() >= 390
    assert again.filter("tag != ''").select("tag").distinct().filter(~again.tag.isin(*SAFE_TAGS)).collect() == []
    assert attributes(again).filter(f"not {clean.is_safe('tag', 'name', 'value')} or startswith(name, 'on')").collect() == []
    # The tree of the output, written again, is the output.
    twice = {r.page_id: r.html for r in serialize(build_nodes(again)).collect()}
    same = sum(twice.get(r.page_id) == r.html for r in out.collect())
    made.release()
    assert same >= 380


def test_unlisted_tags_leave_their_content(spark, pages):
    filler = "<p>Some words of text, long enough to be taken for an article, twice.</p>" * 2
    made = Corpus(spark, pages(f"<article>{filler}<my-box><p>in</p><my-box>deep</my-box></my-box><svg><p>gone</p></svg></article>"), RUN_TS)
    html = made.html.first().content_html
    made.release()
    assert html == f"{filler}<p>in</p>deep"
