"""The element table finds what the tree selector finds."""

import pytest

from hearthlake.plans.source_queries import CARDS, result_pages
from hearthlake.sources.elements import elements, extracted_cards
from hearthlake.sources.html import extracted
from hearthlake.sources.portals import PORTALS

SF = "/root/testdata/sf0.001"
ODD = (
    "<html lang=nl><body><nav><ul><li><a href=/a>A<li><a href='/b'>B <b>bold</b></a></ul></nav><div class='x card' id=c1><p>one<p>two<!-- c -->three<br>four</div>"
    "<div class=card data-k><script>var a = '<p>';</script><span title=\"T\">5 &euro;</span><em></em><span class=\"y\">  </span></section></div><p>after<p class=z>last</body>"
)


def plain(df):
    return sorted(((r["url"], -1 if r["pos"] is None else r["pos"], r["n"], tuple(sorted(r["f"].items())), tuple(sorted(r["p"].items()))) for r in df.select("url", "pos", "n", "f", "p").collect()))


def test_rows_of_a_page(spark):
    rows = elements(spark.createDataFrame([("u", "<div a=1><b>x</b> y</div>z"), ("v", None)], "url string, html string")).collect()
    got = [(r["url"], r["pre"], r["post"], r["parent"], r["tag"], r["text"]) for r in sorted(rows, key=lambda r: (r["url"], r["pre"]))]
    assert got == [("u", 0, 5, None, "#root", None), ("u", 1, 4, 0, "div", None), ("u", 2, 3, 1, "b", None), ("u", 3, 3, 2, "#text", "x"), ("u", 4, 4, 1, "#text", "y"), ("u", 5, 5, 0, "#text", "z"), ("v", 0, 0, None, "#root", None)]


@pytest.mark.parametrize("card", ("nav > ul li", ".card", "div.card[data-k], #c1", ".card:has(span[title])", "div ~ p", "body p.z", "table"))
def test_equals_the_tree_selector(spark, card):
    pages = spark.createDataFrame([("u", ODD), ("u", "<p>again</p>"), ("v", ""), ("w", None)], "url string, html string")
    fields = {"all": "", "link": "a@href", "every": "*a[href], p", "texts": "*span@title=", "code": "script", "id": "@id", "bold": "a > b", "late": "span ~ span", "span": "span[title^=T]", "none": "i"}
    page = {"lang": "html@lang", "body": "body", "hrefs": "*a[href]@href", "last": "p.z"}
    assert plain(extracted_cards(pages, card, fields, page)) == plain(extracted(pages, card, fields, page))


@pytest.mark.parametrize("source", sorted(CARDS))
def test_equals_the_tree_selector_on_result_pages(spark, source):
    pages, portal = result_pages(spark, SF, source).orderBy("url").limit(6).persist(), PORTALS[source]
    assert plain(extracted_cards(pages, portal.card, portal.fields, portal.page)) == plain(extracted(pages, portal.card, portal.fields, portal.page))
    pages.unpersist()
