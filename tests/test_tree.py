from pageloom.operators.tokens import attributes, tokens
from pageloom.operators.tree import build_nodes, serialize


def tree(pages, html):
    rows = build_nodes(tokens(pages(html))).orderBy("node_id").collect()
    by_id = {r.node_id: r for r in rows}
    name = lambda r: r.tag or r.tok
    return [(name(r), name(by_id[r.parent_id]) if r.parent_id is not None else None) for r in rows]


def html_of(pages, html):
    return serialize(build_nodes(tokens(pages(html)))).first().html


def test_tokens_keep_every_character(pages):
    html = '<div a="x>y"><p>1 < 2 & <b>c</b>\n</div>'
    rows = tokens(pages(html)).orderBy("pos").collect()
    assert "".join(r.tok for r in rows) == html
    assert [r.kind for r in rows[:2]] == ["open", "open"]
    assert [r.pos for r in rows] == list(range(len(rows)))


def test_tokens_drop_comments_and_scripts(pages):
    html = "<!-- <p> --><SCRIPT>if (a<b) '</p>'</SCRIPT><style>p{}</style ><p>x</p><!-- open"
    assert [r.tok for r in tokens(pages(html)).orderBy("pos").collect()] == ["<p>", "x", "</p>"]


def test_tokens_survive_hostile_pages(pages):
    html = [
        "<p" + ' a="1"' * 3000 + ">x</p>", "<a " * 3000, '<a b="' * 2000, "<" * 5000, "<p>" + "x" * 200000 + "</p>", "<a = = = " * 500,
    ]
    rows = tokens(pages(*html)).orderBy("page_id", "pos").collect()
    assert ["".join(r.tok for r in rows if r.page_id == i) for i in range(len(html))] == html


def test_empty_pages_give_no_rows(pages):
    assert tokens(pages("", None, "<!-- -->")).count() == 0


def test_attributes_first_wins(pages):
    rows = attributes(tokens(pages("<img src=a SRC=b alt><p>"))).orderBy("attr_no").collect()
    assert [(r.name, r.value) for r in rows] == [("src", "a"), ("alt", None)]


def test_parents(pages):
    html = "<html><body><div><p>a<b>c</b></p><ul><li>1</li><li>2</li></ul></div></body></html>"
    assert tree(pages, html) == [
        ("html", None), ("body", "html"), ("div", "body"), ("p", "div"), ("a", "p"), ("b", "p"), ("c", "b"),
        ("ul", "div"), ("li", "ul"), ("1", "li"), ("li", "ul"), ("2", "li"),
    ]


def test_left_out_end_tags(pages):
    assert tree(pages, "<div><p>a<p>b<div>c</div></div>") == [
        ("div", None), ("p", "div"), ("a", "p"), ("p", "div"), ("b", "p"), ("div", "div"), ("c", "div"),
    ]
    assert html_of(pages, "<ul><li>1<li>2</ul>") == "<ul><li>1</li><li>2</li></ul>"


def test_cut_off_page(pages):
    assert tree(pages, "<html><body><article><p>a</p>b") == [
        ("html", None), ("body", "html"), ("article", "body"), ("p", "article"), ("a", "p"), ("b", "article"),
    ]


def test_surplus_end_tags(pages):
    assert html_of(pages, "</div><div>a</span></div></div><p>b</p>") == "<div>a</div><p>b</p>"


def test_open_phrase_does_not_shift_what_follows(pages):
    assert tree(pages, "<div><p><b>a</p><p>c</p></div><p>d</p>") == [
        ("div", None), ("p", "div"), ("b", "p"), ("a", "p"), ("p", "div"), ("c", "p"), ("p", None), ("d", "p"),
    ]


def test_open_container_inside_a_closed_one(pages):
    assert tree(pages, "<div><section>a</div><p>b</p>") == [
        ("div", None), ("section", "div"), ("a", "div"), ("p", None), ("b", "p"),
    ]


def test_round_trip(pages):
    html = [
        "<div><p>a<b>c</b></p> <img src='x'></div>", "<ul><li><p>a</p><ul><li>b</li></ul></li></ul>", "text<br>more", "<a href=x><div>y</div></a>",
    ]
    made = {r.page_id: r.html for r in serialize(build_nodes(tokens(pages(*html)))).collect()}
    assert [made[i] for i in range(len(html))] == html


def test_only_and_last_child(pages):
    rows = {r.node_id: r for r in build_nodes(tokens(pages("<div><div><i>x</i></div></div><p>a<b>c</b></p>"))).collect()}
    assert [rows[i].only_child for i in (0, 1, 2, 3)] == [False, True, True, True]
    assert rows[9].tag == "b" and rows[9].last_child and not rows[9].only_child


def test_pages_do_not_mix_and_depths_are_right(spark, pages):
    nodes = build_nodes(tokens(pages("<div><p>a</p></div>", "<p>a", "<div>")))
    assert [r.depth for r in nodes.orderBy("page_id", "node_id").collect()] == [1, 2, 3, 1, 2, 1]
    bad = nodes.alias("c").join(nodes.alias("p"), ["page_id"]).where("c.parent_id = p.node_id and not (c.node_id > p.node_id and c.end_id <= p.end_id)")
    assert bad.count() == 0


def test_one_exchange(spark, pages):
    plan = build_nodes(tokens(pages("<p>a")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
