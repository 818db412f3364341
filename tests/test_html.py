"""The tree of tolerant HTML, selectors, and the table functions over pages."""

import pytest
from pyspark.sql import functions as F

from gleaner.sources import html as H

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><script>var t = "<b class='no'>x</b>";</script><style>p{}</style></head>
<body class="home wide"><!-- <i>none</i> --><ul id=menu><li class=item><a href="/a?x=1&amp;y=2">One</a><li class="item last">Two <b>bold</b></ul>
<div class="card big"><img src="p.png"><p>First<p class='lead card'>Sec&eacute;nd</div></span><div class="card"><br/>tail &lt;3<template><u>t</u></template></div>
<pre>  </pre><em>   </em><a name=x data-Kind="Big Deal">no link</a>"""


def found(css, text=PAGE):
    page, test = H.Page(text), H.selector(css)
    return [page.text(i) for i in range(len(page.names)) if test(page, i)]


def test_tree_of_unclosed_tags():
    page = H.Page(PAGE)
    parent = lambda i: page.names[page.parents[i]]
    assert page.title() == "A & B"
    items = [i for i, n in enumerate(page.names) if n == "li"]
    assert [parent(i) for i in items] == ["ul", "li"]  # nothing closes the first item before its list ends
    assert page.text(items[0]) == "One Two bold" and page.text(items[1]) == "Two bold"
    paragraphs = [i for i, n in enumerate(page.names) if n == "p"]
    assert [parent(i) for i in paragraphs] == ["div", "p"] and page.text(paragraphs[0]) == "First Secénd"
    assert "i" not in page.names and page.names.count("b") == 1
    script, cards = page.names.index("script"), [i for i in range(len(page.names)) if "card" in page.classes(i)]
    assert page.text(script).startswith("var t") and page.text(0).count("var t") == 0
    assert [page.text(i) for i in cards] == ["First Secénd", "Secénd", "tail <3"]


@pytest.mark.parametrize("text", [None, "", "plain", "<", "<p", "</p>", "<p></div></p>", "<script>never closed <b>", "<!-- open", "<a b=c d='e", "&#xD800;&bogus;&amp", "<div " * 2000, "<p>" * 3000])
def test_odd_pages(text):
    page = H.Page(text)
    assert all(a <= z for ranges in (page.held, page.said, page.made) for a, z in ranges)
    assert page.title() == "" and [page.inner_html(i) for i in range(min(5, len(page.names)))] is not None


@pytest.mark.parametrize(
    "css,want",
    [
        ("title", ["A & B"]), ("#menu > li", ["One Two bold"]), ("li li", ["Two bold"]), ("ul b", ["bold"]), (".card.big", ["First Secénd"]),
        (".card", ["First Secénd", "Secénd", "tail <3"]), ("div + div", ["tail <3"]), ("ul ~ div", ["First Secénd", "tail <3"]), ("p:not(.lead)", ["First Secénd"]),
        ("a[href]", ["One"]), ("a[href^='/a']", ["One"]), ("[data-kind='big deal' i]", ["no link"]), ("[data-kind~=Deal]", ["no link"]), ("[data-kind$=deal]", []),
        ("[class|=item]", ["One Two bold"]), ("img, b, .lead", ["bold", "", "Secénd"]), ("body > :nth-child(2)", ["First Secénd"]), ("body > *:nth-child(odd)", ["One Two bold", "tail <3", ""]),
        ("div:last-of-type", ["tail <3"]), ("b:only-child", ["bold"]), ("em:empty", [""]), (":is(ul, pre)", ["One Two bold", ""]), ("p:nth-last-child(-n+1)", ["First Secénd", "Secénd"]), ("html:root > head > title", ["A & B"]),
    ],
)
def test_selectors(css, want):
    assert found(css) == want


@pytest.mark.parametrize("css", ["", "a >", "a[", "p:hover", "p:nth-child(x)", "a,,b >", ">"])
def test_selectors_that_are_none(css):
    with pytest.raises(ValueError):
        H.selector(css)


def test_inner_html():
    page = H.Page(PAGE)
    at = lambda css: next(i for i in range(len(page.names)) if H.selector(css)(page, i))
    assert page.inner_html(at(".big")) == '<img src="p.png"/><p>First<p class="lead card">Secénd</p></p>'
    assert page.inner_html(at("div + div")) == "<br/>tail &lt;3<template><u>t</u></template>"
    assert page.inner_html(at("ul")).startswith('<li class="item"><a href="/a?x=1&amp;y=2">One</a><li class="item last">')
    assert page.inner_html(at("pre")) == "  " and page.inner_html(at("em")) == " "
    assert page.inner_html(at("script")) == "var t = \"<b class='no'>x</b>\";"
    assert H.quoted("a\"b'c") == '"a&quot;b\'c"' and H.quoted('a"b') == "'a\"b'"


def test_table_functions(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string").withColumns({"place": F.lit(0), "Tag": F.lit("x"), "more": F.lit(5)})
    rows = H.select(df, ".card", "links", root="https://x.example").orderBy("place").collect()
    assert [(r.page_id, r.more, r.place, r.tag, r.href, r.src) for r in rows] == [(1, 5, 1, "div", "", "p.png"), (1, 5, 2, "p", "", ""), (1, 5, 3, "div", "", "")]
    assert [r.href for r in H.select(df, "li", "links", root="https://x.example").collect()] == ["https://x.example/a?x=1&y=2", ""]
    assert [r.html for r in H.select_classes(df, ["lead", "odd:name"], "html").collect()] == ["Secénd"]
    assert H.select(df, "*", limit=4).count() == 4
    found = {(r.page_id, r.kind, r.name): (r.place, r.n, r.tags, r.sample) for r in H.inventory(df).collect()}
    assert found[1, "class", "card"] == (1, 3, "div, p", "First Secénd") and found[1, "class", "item"] == (2, 2, "li", "One Two bold")
    assert found[1, "title", "title"][3] == "A & B" and found[3, "title", "title"][3] == "" and (2, "title", "title") not in found
    assert found[1, "tag", "li"][1] == 2 and found[1, "tag", "div"][1] == 2
    with pytest.raises(ValueError):
        H.select(df, "p", "bytes")
