import random

import pytest

from plinth.sources import pages
from plinth.sources.pages import Field, Site, Step

HTML = """<html lang=en><head><title>T</title><script>var a = "<div class='card'>no</div>"</script></head><body>
<div class="card big" data-id="7"><h3>Ann Lee, MD</h3><p>Suite 2<br>Main&nbsp;St<p>Miami, FL<span class=phone>(305) 555-0100</span></div>
<div class="card"><h3>Bo  Roe, DO</h3><a href="/p/9">more</a><ul><li>one<li>two</ul></div>
<div class="card"><h3></h3></div><h4>Team</h4><p>first</p><div><p>inner</p></div><p>second</p>
<table><tr><td>a<td>b<tr><td>c</table><img src="x.png"></b></body></html>"""


def test_steps_and_fields():
    root = pages.parsed(HTML)
    texts = lambda *s: [n.text() for n in pages.chosen(root, s)]
    assert texts(Step("h3")) == ["Ann Lee, MD", "Bo Roe, DO", ""] and texts(Step("div", ("card",)), Step("li")) == ["one", "two"]
    assert texts(Step("h4"), Step("p", axis="later")) == ["first", "second"] and texts(Step("h4"), Step("p", axis="next")) == ["first"] and texts(Step("h4"), Step("div", axis="next")) == []
    assert texts(Step("body"), Step("p", axis="child")) == ["first", "second"] and texts(Step("tr"), Step("td", axis="child")) == ["a", "b", "c"]
    assert [n.attrs["src"] for n in pages.chosen(root, [Step("img")])] == ["x.png"]
    fields = {"name": Field((Step("h3"),), pattern=r"^([^,]+)"), "degree": Field((Step("h3"),), pattern=r"\b(MD|DO)\b"), "id": Field(attribute="data-id"), "link": Field((Step("a", attrs=(("href", r"^/p/"),)),), "href"), "phone": Field((Step(classes=("phone",)),)), "lines": Field((Step("p"),), between=" | ")}
    site = Site("", (Step("div", ("card",)),), fields, ("name",))
    assert pages.records(HTML, site) == [
        {"name": "Ann Lee", "degree": "MD", "id": "7", "link": None, "phone": "(305) 555-0100", "lines": "Suite 2 | Main St"},
        {"name": "Bo Roe", "degree": "DO", "id": None, "link": "/p/9", "phone": None, "lines": None},
    ]


def walk(node, path=()):
    """Every element with the elements around it, by recursion."""
    for c in node.children():
        yield c, (*path, node)
        yield from walk(c, (*path, node))


@pytest.mark.parametrize("seed", range(8))
def test_choices_equal_a_walk_over_all_elements(seed):
    rng, text = random.Random(seed), ""
    for _ in range(120):
        tag = rng.choice(["div", "p", "ul", "li", "a", "table", "td", "br", "b"])
        text += rng.choice([f"<{tag} class='{rng.choice('xyz')} {rng.choice('uv')}' href='{rng.randint(0, 5)}'>", f"</{tag}>", f"t{rng.randint(0, 9)} "])
    root = pages.parsed(text)
    every = list(walk(root))
    fits = lambda n, s: (s.tag in ("*", n.tag)) and all(c in n.attrs.get("class", "").split() for c in s.classes)
    for first in (Step("div"), Step("p", ("x",)), Step("*", ("u",)), Step("li")):
        for axis in ("inside", "child", "next", "later"):
            second = Step(rng.choice(["*", "a", "b", "p"]), axis=axis)
            want = []
            for n, path in every:
                beside = path[-1].children()
                place = beside.index(n)
                near = {"inside": path, "child": path[-1:], "next": beside[place - 1 : place] if place else [], "later": beside[:place]}[axis]
                if fits(n, second) and any(m is not root and fits(m, first) for m in near):
                    want.append(n.at)
            assert [n.at for n in pages.chosen(root, (first, second))] == sorted(want)


def test_pages_of_all_kinds(spark):
    deep = "<div>" * 3000 + "<h3>Deep, MD</h3>"
    rows = [(1, "http://a.org/x", HTML), (2, "http://b.org", HTML), (3, "http://a.org", None), (4, "http://a.org", ""), (5, None, HTML), (6, "http://a.org", '<div class="card"><h3>Cut, MD</h3><p>half'), (None, "http://c.org", deep), (1, "http://a.org/x", HTML)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as position", "1 as name")
    sites = [Site(r"//a\.org", (Step("div", ("card",)),), {"name": Field((Step("h3"),))}, ("name",)), Site(r"//[bc]\.org", (Step("h3"),), {"title": Field()}, ("title",))]
    got = pages.read_pages(df.repartition(3), sites)
    assert got.columns == ["page_id", "position", "name", "title"]
    want = [(None, 1, None, "Deep, MD"), (2, 1, None, "Ann Lee, MD"), (2, 2, None, "Bo Roe, DO"), (6, 1, "Cut, MD", None)] + [(1, 1, "Ann Lee, MD", None), (1, 2, "Bo Roe, DO", None)] * 2
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and pages.read_pages(df.where("false"), sites).collect() == []


def test_references_without_semicolon_stay_where_closed_ones_are_asked_for():
    page = "<h1>A&amp;&lt;b&#38; c&amp</h1><p title='x&amp;y&copy z'>1 & 2 &nosuch; &amp;lt;</p>"
    fields = {"h": Field((Step("h1"),)), "p": Field((Step("p"),)), "t": Field((Step("p"),), "title")}
    (got,) = pages.records(page, Site("", (), fields, closed=True))
    assert got == {"h": "A&<b& c&amp", "p": "1 & 2 &nosuch; &lt;", "t": "x&y&copy z"}
    assert pages.records(page, Site("", (), fields))[0]["h"] == "A&<b& c&"
