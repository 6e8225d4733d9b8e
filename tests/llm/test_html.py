"""Main text of pages: the given pages against patterns of their layout, template removal against plain counting, odd markup by hand."""

import html
import random
import re
import time
from collections import defaultdict

import pytest

from cargoline.llm import html as pages

SCHEMA = "page_id long, url string, html string, `page key` string, runs string, copies int"
SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "r", 1) for i, (u, h) in enumerate(rows)], SCHEMA)


def texts(spark, rows, **options):
    out = pages.extract(table(spark, rows), **options)
    assert out.columns == ["page_id", "url", "page key", "runs", "copies", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    return [got[i].text for i in range(len(rows))]


def blocks(page):
    return pages.left(pages.parse(page), set())


def test_given_pages(spark):
    from cargoline.llm.queries import QUERIES

    given = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op12_html"](spark, SF).collect()
    assert len(got) == len(given)
    for row in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", given[row.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?h1>|</?p>|<br>", inner)]
        assert row.text == "\n\n".join(p for p in parts if p) and row.n_chars == len(row.text) and row.url == given[row.page_id].url


def test_templates_are_subtrees_on_many_pages_of_a_host(spark):
    rng = random.Random(3)
    rows, expected = [], []
    chrome = ["<div><span>Follow us</span> today</div>", "<ul><li>one</li><li>two</li></ul>", "<div><p>Terms of use</p><div>Legal</div></div>"]
    use = defaultdict(lambda: defaultdict(set))
    for i in range(60):
        site = f"s{i % 4}.example"
        top = rng.choice(chrome[: 1 + i % 4 % 3 + (i % 4 > 2)])
        page = f"<body>{top}<div><p>Story {i} begins</p><p>and ends {i}</p></div>{rng.choice(chrome)}</body>"
        rows.append((f"https://{site}/p{i}", page))
    read = [pages.parse(h) for _, h in rows]
    for (url, page), one in zip(rows, read):
        for digest, _, _, free in one.elements:
            if free:
                use[url.split("/")[2]][digest].add(page)
    for (url, _), one in zip(rows, read):
        common = {d for d, where in use[url.split("/")[2]].items() if len(where) >= 5}
        expected.append("\n\n".join(pages.left(one, common)))
    got = texts(spark, rows)
    assert got == expected
    assert "Follow us today" not in "".join(got[0::4]) and all(f"Story {i} begins\n\nand ends {i}" in t for i, t in enumerate(got))
    # a host with fewer pages than a template needs shows none
    assert texts(spark, rows[:4])[0].startswith("Follow us today")


def test_copies_and_common_passages_of_articles_stay(spark):
    page = "<body><div>Site</div><article><h1>T</h1><p>Body</p></article><div>End</div></body>"
    rows = [("https://a.example/x", page)] * 40
    rows += [("https://a.example/y", f"<body><article><p>Quoted by all</p><p>own {i}</p><div>Share this</div></article></body>") for i in range(20)]
    got = texts(spark, rows)
    assert got[:40] == ["T\n\nBody"] * 40
    assert got[40:] == [f"Quoted by all\n\nown {i}" for i in range(20)]


def test_null_empty_and_repeated_rows(spark):
    rows = [(None, None), ("", ""), ("nonsense", "plain &amp; text"), (None, "<p>x"), (None, "<p>x"), ("https://h.example", "<script>var a;</script>")]
    assert texts(spark, rows) == ["", "", "plain & text", "x", "x", ""]
    assert pages.extract(table(spark, [])).count() == 0


CASES = [
    ("<p>a<p>b<br>c", ["a", "b c"]),
    ("<body><nav>m</nav><main><h1>H</h1><article><header><h2>S</h2></header><p>x &lt;y&gt; &copy z</p><footer>by</footer></article></main><footer>f</footer>", ["H", "S", "x <y> © z"]),
    ("<header>site</header><div class='site-header'>s</div><div id=cookie-notice>c</div><div class=\"with-sidebar\"><p>text</p></div><div class=sidebar><p>no</p></div>", ["text"]),
    ("<article>t<section class='comments'><p>c1</p></section><form>f<p>g</p></form><aside>a</aside></article><div>rest", ["t"]),
    ("<article><p>in<div class=ad>buy</div><p>out</article>", ["in", "out"]),
    ("<article><p class='ad'>buy</p><p>read</p></article>", ["read"]),
    ("<p>one <span class='share'>tweet <span>me</span> now</span> two</p>", ["one", "two"]),
    ("<SCRIPT>if (a<b) '</p>'</SCRIPT><STYLE>p{}</STYLE><P>Up</P>", ["Up"]),
    ("<!-- <p>no</p> --><p>yes<!-- open", ["yes"]),
    ("<a href='x>y' title=\"a'b\">link</a> 1 < 2 & 3", ["link 1 < 2 & 3"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<ul><li>a<li>b</ul></div></p>c", ["a", "b", "c"]),
    ("&#" + "9" * 6000 + "; &#x41;&#0;&am &amp", ["� A�&am &"]),
    ("<div hidden>h</div><div style='display: none'>d</div><div role=navigation>r</div><p>t", ["t"]),
    ("<p>cut <b", ["cut"]),
    ("<title>t</title>text", ["text"]),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_markup(page, expected):
    assert blocks(page) == expected


@pytest.mark.parametrize("part", ["<a ", '<a ="', "<p>", "<div>", "</div>", "<b>", "&", "<!--", "<script>", "<", "<td>", "<li>", "= ", "<nav><b>", "<p>x</b>"])
def test_time_is_linear(part):
    began = time.time()
    pages.parse(part * 100_000)
    assert time.time() - began < 5
