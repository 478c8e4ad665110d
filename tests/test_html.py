from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierflow.sources import html
from tierflow.specs import SCRAPES


def found(page: str, selector: str) -> list[str]:
    return [n.text() for n in html.select(html.parse_html(page), html.parse_selector(selector))]


TABLE = """
<table class="sortable wikitable"><thead><tr><th>h</th></tr></thead><tbody>
<tr><td><a href="/x">Uno</a> <a>otro</a></td><td> 1,5 <td>200<td>133</tr>
<tr><td>sin enlace</td><td>2</td><td>300</td></tr>
<tr><td></td></tr>
</tbody></table>"""


def test_table_rows_with_unclosed_cells(spark):
    spec = SCRAPES["neighborhoods"]
    pages = spark.createDataFrame([(7, TABLE)], "page int, html string")
    rows = [tuple(r) for r in html.scrape(pages, spec.fields, spec.container).collect()]
    assert rows == [(7, 1, "Uno", "1,5", "200", "133"), (7, 2, None, "2", "300", None)]


@pytest.mark.parametrize(
    "page, selector, texts",
    [
        ("<p>a<p>b", "p", ["a", "b"]),
        ("<p><b>a<br>x<p>b</p>", "p", ["ax", "b"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "ul > li", ["a", "bc", "c"]),
        ("<div class='x y'>a</div><div class='xy'>b</div>", "div.x.y", ["a"]),
        ("<i id=k>a</i>", "#k", ["a"]),
        ("<a href='/1'>a</a><a>b</a>", "a[href]", ["a"]),
        ("<a rel='n'>a</a><a rel='m'>b</a>", "a[rel=m]", ["b"]),
        ("<h1>a</h1><h2>b</h2>", "h2, h1", ["a", "b"]),
        ("<div><p>a</p><i>b</i><p>c</p></div>", "div p:nth-of-type(2)", ["c"]),
        ("<p>a &amp; b&nbsp;</p>", "p", ["a & b"]),
        ("<p>a &amp b &copy; &#65; &lt;i&gt;", "p", ["a &amp b \u00a9 A <i>"]),
        ("<a title='x&y=1'>a</a>", "a[title='x&y=1']", ["a"]),
        ("<script>a&b && c&amp;</script>", "script", ["a&b && c&amp;"]),
        ("<p> a <b> b </b>\n c </p>", "p", ["abc"]),
        ("<p>a<script>var x='</p>';</script>b<!-- c --></p>", "p", ["ab"]),
        ("<script>x</script>", "script", ["x"]),
        ("<section><nav>n</nav><div><em>a</em></div></section>", "section em", ["a"]),
        ("<div>a</span></div>", "div", ["a"]),
        ("", "p", []),
    ],
)
def test_selection(page, selector, texts):
    assert found(page, selector) == texts


def test_selector_context_reaches_above_the_container(spark):
    pages = spark.createDataFrame([("<main><div class='c'><i>a</i></div></main>",)], "html string")
    assert html.scrape(pages, {"x": "main i"}, ".c").first()["x"] == "a"


def test_unsupported_selector():
    for selector in ("p:hover", "p + p", "", "a,"):
        with pytest.raises(ValueError):
            html.parse_selector(selector)


def test_empty_records_are_dropped(spark):
    pages = spark.createDataFrame(
        [(1, "<div class=c></div><div class=c><b> </b></div><div class=c><b>x</b></div>"), (2, None), (3, "")],
        "id int, html string",
    )
    assert [tuple(r) for r in html.scrape(pages, {"b": "b", "i": "i"}, "div.c").collect()] == [(1, 1, "x", None)]


def test_page_links(spark):
    df = spark.createDataFrame([("/a",), ("b",), ("http://x/c",), ("https://x/d",)], "u string")
    links = df.select(html.page_links(F.col("u"), "http://h/base/"))
    assert [r[0] for r in links.collect()] == ["http://h/base/a", "http://h/base/b", "http://x/c", "https://x/d"]
