"""Pages as numbered nodes: joins by numbers against a walk of the tree, selectors against plain search."""

import random

from pyspark.sql import functions as F

from kotonami.plans import fixtures
from kotonami.plans.queries import QUERIES, SELECTORS
from kotonami.sources import html, tree
from kotonami.sources.tree import Step


def random_page(rng):
    out = []
    for _ in range(rng.randint(0, 60)):
        tag = rng.choice(["div", "p", "span", "b"])
        attrs = rng.choice(["", ' class="x"', ' class="y x"', ' href="/a"', ' href="b/a"'])
        out.append(rng.choice([f"<{tag}{attrs}>", f"<{tag}{attrs}>", f"</{tag}>", "<br>", f"text{rng.randint(0, 9)}", " ", "<!-- c -->"]))
    return "".join(out)


def meets(node, steps):
    """Whether a node meets the steps, tried from the last one back."""
    *rest, step = steps
    if (step.tag not in (None, node.tag)) or node.tag[0] == "#" or not step.fits(node):
        return False
    if not rest:
        return True
    beside = [c for c in node.parent.children[: node.place] if c.tag[0] != "#"]
    if step.how == ">":
        near = [node.parent]
    elif step.how == " ":
        near, at = [], node.parent
        while at is not None:
            near, at = [*near, at], at.parent
    else:
        near = beside[-1:] if step.how == "+" else beside
    return any(meets(n, rest) for n in near)


def pages_of(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page long, html string")


def test_selectors_against_plain_search(spark):
    rng = random.Random(1)
    pages = [random_page(rng) for _ in range(300)]
    tests = [(), (("href", "^=", "/"),), (("href", "*=", "a"),), (("href", "=", "b/a"),), (("class", "?", ""),)]
    selectors = {
        str(k): [Step(rng.choice([None, "div", "p", "span", "b", "br"]), rng.choice([None, None, "x"]), rng.choice(tests), rng.choice(" >+~")) for _ in range(rng.randint(1, 4))]
        for k in range(60)
    }
    got = {(r.key, r.pre): set(r.matched) for r in tree.nodes(pages_of(spark, pages), "page", selectors=selectors).collect()}
    some = 0
    for k, page in enumerate(pages):
        top = html.parse(page)
        for pre, node in enumerate([top, *top.walk()]):
            want = {name for name, steps in selectors.items() if meets(node, steps)}
            assert got[k, pre] == want
            some += len(want)
    assert some > 1000


def test_joins_by_numbers_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 4)
    rng = random.Random(2)
    pages = [random_page(rng) for _ in range(60)]
    table = tree.nodes(pages_of(spark, pages), "page").cache()
    below = {(r.key, r.top, r.pre) for r in tree.below(table.where("tag = 'div'"), table.where("tag = 'span'")).collect()}
    child = {(r.key, r.top, r.pre) for r in tree.children(table.where("tag = 'div'"), table.where("tag = 'span'")).collect()}
    after = {(r.key, r.pre, r.next) for r in tree.with_next(table, "p").where("tag = 'br'").collect()}
    texts = {(r.key, r.pre, r.text) for r in tree.texts(table, table.where("tag = 'div'"), "|").collect()}
    want = [set(), set(), set(), set()]
    for k, page in enumerate(pages):
        top = html.parse(page)
        place = {id(n): i for i, n in enumerate([top, *top.walk()])}
        for node in top.walk():
            at = place[id(node)]
            if node.tag == "div":
                want[0] |= {(k, at, place[id(n)]) for n in node.find("span")}
                want[1] |= {(k, at, place[id(n)]) for n in node.direct("span")}
                want[3].add((k, at, node.text("|")))
            if node.tag == "br":
                following = node.next_sibling("p")
                want[2].add((k, at, following and place[id(following)]))
    assert [below, child, after, texts] == want
    table.unpersist()


def test_fixture_pages_by_selectors(spark):
    pages = [fixtures.SEARCH_PAGES[0][3], fixtures.ENTRY_PAGES[0][2], fixtures.SENTENCE_PAGES[0][2], fixtures.ACCENT_PAYLOAD[0][3]]
    table = tree.nodes(pages_of(spark, pages), "page", selectors=SELECTORS)
    got = {(r.key, r.selector): r.n for r in table.select("key", F.explode("matched").alias("selector")).groupBy("key", "selector").agg(F.count("*").alias("n")).collect()}
    assert (got[1, "span.kanj"], got[1, "tr.sense span.pos span.abbr"], got[1, "tr.sense span.glossx"], got[1, "a[href^=srchres.py]"]) == (1, 2, 3, 2)
    assert got[2, "div[style*=clear] br ~ font[size=-1]"] == 2
    assert got[3, "div.phrasing_text > span"] == sum(len(d.direct("span")) for d in html.parse(pages[3]).find("div", "phrasing_text"))
    assert got[0, "tr.resrow input[name=e]"] >= 2


def test_broken_empty_null_and_deep_pages(spark):
    deep = "<div>" * 30_000 + "x"
    frame = pages_of(spark, [None, "", "<![foo[ x ]]>", deep, "same", "same"]).withColumns({"key": F.lit("clash"), "pre": F.lit(1)})
    rows = tree.nodes(frame, "page").groupBy("key").agg(F.count("*").alias("n"), F.max("tag").alias("tag"), F.max("last").alias("last"), F.min("tag").alias("first")).collect()
    got = {r.key: (r.n, r.first, r.last) for r in rows}
    assert got == {0: (1, "#broken", None), 1: (1, "#document", 0), 2: (1, "#broken", None), 3: (30_002, "#document", 30_001), 4: (2, "#document", 1), 5: (2, "#document", 1)}
    assert tree.nodes(frame.where("false"), "page").count() == 0


def test_gathered_texts_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(tree, "_MOST", 7)
    rng = random.Random(3)
    pages = [*(random_page(rng) for _ in range(60)), None, "<![foo[ x ]]>", "<div>" * 500 + "a <br> b"]
    selectors = {"d": [Step("div")], "x": [Step(None, "x")], "b": [Step("br")]}
    table = tree.nodes(pages_of(spark, pages), "page", selectors=selectors, texts_of=("d", "x"), only=True)
    got = {(r.key, r.pre, r.parent, r.tag, tuple(r.matched), r.data, r.text) for r in tree.gathered(table, "text", tree.joined("|")).collect()}
    want = set()
    for k, page in enumerate(pages):
        if k in (60, 61):
            continue
        top = html.parse(page)
        place = {id(n): i for i, n in enumerate([top, *top.walk()])}
        for n in top.walk():
            met = tuple(name for name, steps in selectors.items() if meets(n, steps))
            if met or n.tag == "#comment":
                want.add((k, place[id(n)], place[id(n.parent)], n.tag, met, n.data if n.tag == "#comment" else None, n.text("|") if set(met) & {"d", "x"} else ""))
    assert got == want


def test_queries_over_pages_parse_them_once(spark, tmp_path):
    item = '<li><a href="/{0}">t{0}</a><a>u</a></li>'
    pages = [
        "<nav><ul>" + item.format(1) + "<b>x</b><li>no link</li> text " + item.format(2) + "</ul><ul>" + item.format(3) + "</ul></nav><ul>" + item.format(4) + "</ul>",
        "<nav><ul><li><a href='/o'>o</a><nav><ul><li><a href='/i'> i </a></li></ul></nav></li></ul></nav>",
        "<br>x<p><b> y</b>z</p><br><p></p><br><!-- ad 1 -->t<div class='ad'> a <b>b</b></div><!-- ad 2 --><div>c</div><div class='ad'>d</div>",
        None,
    ]
    spark.createDataFrame([(k, "", p) for k, p in enumerate(pages, 1)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {
        "tree_list_items": [(1, 0, "/1", "t1u", "no link"), (1, 1, None, "t1u", "no link"), (1, 2, "/2", "t2u", None), (1, 3, None, "t2u", None), (1, 4, "/3", "t3u", None), (1, 5, None, "t3u", None), (2, 0, "/o", "oi", None), (2, 1, "/i", "i", None)],
        "tree_break_lines": [(3, 0, " y"), (3, 1, None), (3, 2, None)],
        "tree_comment_blocks": [(3, "ad 1", "ab")],
        "entry_blocks": [(1, 3, "ab")],
    }
    for name, rows in want.items():
        out = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str), name
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sum("MapInArrow" in line and "page" in line for line in plan.splitlines()) == 1, name
