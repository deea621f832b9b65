import html
import random
import re

import pytest
from conftest_llm import DATA, table

from fleetcatalog.llm import html_text, queries
from fleetcatalog.llm.html_text import Densities, Page, density, main_text

LONG = "The ferry leaves at dawn, when the tide is in, and comes back with the evening papers and the mail. " * 2
FLAT = " ".join(LONG.split())


def article(page):
    """The article of the given tables' pages, by their template."""
    inner = page[page.index("<article>") : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1|article)>", inner)
    return "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())))


def test_given_pages(spark):
    pages = queries.read(spark, DATA, "pages")
    got = {r.page_id: r for r in queries.op13_html_text(spark, DATA).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(article(r.html))


PAGES = {
    "no article element": (
        f"""<html><body><div id="top"><a href=/>Home</a> <a href=/a>About</a></div><h1>Title</h1><div class="content"><p>{LONG}</p><p>Short.</p><blockquote>{LONG}</blockquote></div>
        <div><a href=1>One story</a><a href=2>Another</a><a href=3>Third</a></div><div id="comments"><p>{LONG * 9}</p></div><div id=footer>All rights</div></body></html>""",
        ["Title", FLAT, "Short.", FLAT],
    ),
    "main": (
        f"""<body><header><h1>Site</h1></header><nav>menu</nav><main><h1>Title</h1><p>{LONG}<section><h2>Part</h2><p>{LONG}<ul><li>a<li>b</ul></section>
        <form><label>Mail</label><input name=x></form><div class=newsletter>Subscribe</div></main><aside>{LONG * 9}</aside>""",
        ["Title", FLAT, "Part", FLAT, "a", "b"],
    ),
    "article with header, advert, script, table, footer and comments": (
        f"""<body><div class="cookie-banner">We use cookies {LONG}</div><div class="wrap has-sidebar"><article class="post"><header><h1>T &amp; U</h1></header><div class=ad>Buy</div>
        <p>{LONG}<script>if (a<b) document.write("<p>x</p>")</script> more&nbsp;text<br>line</p><table><tr><td>1</td><td>2</td></tr></table><footer>tags</footer>
        <section class="comments"><article class=comment><p>{LONG * 9}</p></article></section></article><div class="sidebar">{LONG * 9}</div></div>""",
        ["T & U", FLAT + " more text line", "1", "2"],
    ),
    "text and line breaks in a div": (f'<body><div class=nav><a href=1>x</a></div><div>{LONG}<br><br>{LONG}<br>{LONG}</div><div>About <a href=2>us</a></div>', [" ".join([FLAT] * 3)]),
    "a form around everything": (f"<body><form id=f action=x><div><article><p>{LONG}</p></article></div></form>", [FLAT]),
    "sections": (f'<body><div class="alert">Note</div><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>{LONG}</p></section>', ["A", FLAT, "B", FLAT]),
    "links at the end of an article": (f"<article><h1>T</h1><p>{LONG}</p><ul><li><a href=1>r</a><li><a href=2>s</a><li><a href=3>t</a></ul><p>End</p></article>", ["T", FLAT, "End"]),
    "an article shorter than what is around it": (f"<body><nav>a</nav><div class=ad>{LONG}</div><article><p>Hi.</p></article><footer>{LONG}</footer>", ["Hi."]),
    "hidden": (f'<article><p>{LONG}</p><p hidden>x</p><p style="display: none">y</p><p aria-hidden=true>z</p></article>', [FLAT]),
    "unclosed": (f"<body><article><p><b>One.<br><p>{LONG}<p><i>Two</b> three<div>four", ["One.", FLAT, "Two three", "four"]),
    "quotes in attributes": (f"""<article title="a > b" data-x='c > d' y=it's><p z="<p>">{LONG}</p></article>""", [FLAT]),
    "no markup": ("just text &lt;b&gt; a < b &amp c", ["just text <b> a < b & c"]),
    "comments": ("a<!-- x --><!--->b<![CDATA[ y ]]><?php z ?>c<!-- never", ["abc"]),
    "inside a tag": ("<p>abc <a href='x", ["abc"]),
    "inside a script": ("<p>abc<script>x<p>y", ["abc"]),
    "only markup": ("<html><head><title>x</title></head><body><p></p></body></html>", []),
    "no tags closed in the head": ("<head><title>t</title><p>abc", ["abc"]),
    "references": ("<p>&#233;&#xE9;&eacute; &am; &copy&nbsp;&#x1F600;</p>", ["ééé &am; © 😀"]),
    "white space": ("<p>\n a\t\tb c\r\n</p> \n ", ["a b c"]),
    "cells": ("<article><table><tr><td>a<td>b<tr><th>c</table></article>", ["a", "b", "c"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, blocks = PAGES[name]
    assert main_text(page) == "\n\n".join(blocks)


def test_sums_against_recursion():
    """Densities of random trees, from nested lists."""
    pick = random.Random(6)
    for _ in range(60):

        def grow(depth):
            tag = pick.choice(["div", "div", "section", "a", "b", "script"])
            inner = [grow(depth - 1) if depth and pick.random() < 0.6 else "w" * pick.randrange(30) for _ in range(pick.randrange(4))]
            return [tag, *(["w"] if tag == "script" else inner)]

        write = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(write, x[1:]))}</{x[0]}>"

        def count(x, linked=False):
            """Characters, tags, linked characters, link tags."""
            if isinstance(x, str):
                return len(x), 0, len(x) if linked else 0, 0
            parts = [count(y, linked or x[0] == "a") for y in x[1:] if x[0] != "script"]
            tags = [(y[0] != "script", y[0] == "a") for y in x[1:] if not isinstance(y, str)]
            c, t, lc, lt = (sum(p[k] for p in parts) for k in range(4))
            return c, t + sum(a for a, _ in tags), lc, lt + sum(b for _, b in tags)

        tree = ["body", *[["div", *[grow(4) for _ in range(3)]] for _ in range(3)]]
        page = Page(write(tree))
        found = Densities(page)
        nodes = []

        def walk(x, linked):
            nodes.append((x, linked))
            for y in x[1:]:
                if not isinstance(y, str):
                    walk(y, linked or x[0] == "a")

        walk(tree, False)
        c, _, lc, _ = count(tree)
        share = lc / max(c, 1)
        assert page.tag == [x[0] for x, _ in nodes]
        for i, (x, linked) in enumerate(nodes):
            assert found.density[i] == pytest.approx(density(*count(x, linked), share))
            own = sum(len(y) for y in x[1:] if isinstance(y, str))
            want = sum(density(*count(y, linked or x[0] == "a"), share) for y in x[1:] if not isinstance(y, str))
            want += 0 if linked or x[0] in ("a", "script") else density(own, 0, 0, 0, share)
            assert found.sum[i] == pytest.approx(want)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50_000 + "x", "<p><b>" * 50_000 + "x", '<a href="' * 50_000, "<" * 200_000, "<!--" * 50_000, "</div>" * 100_000, "<li><div>" * 50_000, "<table><tr><td>" * 30_000 + "x",
     "<b>" * 50_000 + "<div></b>" * 50_000 + "x", "x" * 3_000_000, "&" * 100_000, "<x '=\"" * 50_000],
    ids=lambda p: p[:9],
)
def test_hostile_pages_end(page):
    assert len(main_text(page)) <= len(page)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (3, "u", "<p>" + "é " * 50_000)]
    pages = table(spark, rows, "page_id long, url string, html string").withColumnRenamed("row", "text")
    got = html_text.extract(pages)
    assert sorted(map(str, got.collect())) == sorted(
        str(r) for r in spark.createDataFrame([(1, "u", "", 0), (2, None, "", 0), (None, "u", "a", 1), (None, "u", "a", 1), (3, "u", ("é " * 50_000).strip(), 99_999)], got.schema).collect()
    )
    assert html_text.extract(pages.limit(0)).count() == 0 and got.columns == ["page_id", "url", "text", "n_chars"]
