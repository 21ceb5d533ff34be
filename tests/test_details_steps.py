"""Rules of detail pages: shared values are columns of their own, and pages are read only for fields that a rule names."""

import json

import pytest

from hearthlake.plans import detail_queries
from hearthlake.sources import details
from hearthlake.sources.html import text_maps


@pytest.mark.parametrize("source", ["akiyaportal", "homege", "bulgarianproperties", "domaza", "greenacres"])
def test_prices_stay_outside_lambdas(spark, source):
    plan = detail_queries.QUERIES[f"details_{source}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "fx_source" in plan
    assert not any(f in plan for f in ("map_from_arrays", "map_concat", "transform_values"))


def test_franimo_reads_no_bodies(spark):
    details.detail_rows(spark.createDataFrame([("u", "<p>x</p>")], "url string, html string"), "franimo")
    assert "slides" in details.ASKED
    assert not details.ASKED & {"body", "scripts", "images", "osm", "ld"}


@pytest.mark.parametrize("label", ["Condition", "price_eur", "my price_eur", "fx_rate"])
def test_raw_fields_are_one_object(spark, label):
    cell = f'<div class="listing-fields"><div class="table-cell"><div class="name">{label}</div><div class="value">7</div></div></div>'
    money = '<script type="application/ld+json">{"@type":"Product","offers":{"price":"100","priceCurrency":"usd"}}</script>'
    pages = [("https://h/x-1.html", cell + money), ("https://h/x-2.html", cell), ("https://h/x-3.html", money), ("https://h/x-4.html", None)]
    found = {r.url: json.loads(r.raw_fields) for r in details.detail_rows(spark.createDataFrame(pages, "url string, html string"), "homege").collect()}
    own = {"price_usd": "100", "price_eur": "85", "price_source": "usd_converted", "fx_rate": "0.85", "fx_source": "documented fixed rate, not a live feed"}
    said = {label: "7"} if label in ("Condition", "my price_eur") else {}
    said = {k.lower(): v for k, v in said.items()}
    assert list(found.values()) == [said | own, said, own, {}]


def test_text_maps():
    rows = [[("a", "1"), ("b", "2")], [], [("a", "3")]]
    assert text_maps(rows).to_pylist() == rows
    assert text_maps([[], []]).to_pylist() == [[], []]
    assert text_maps([]).to_pylist() == []


def test_only_blocks_of_a_wanted_kind_are_parsed(spark):
    """A page's other structured data was parsed and opened, too; kinds spelled with escapes, lists, graphs and fallbacks are found as before."""
    script = '<script type="application/ld+json">{}</script>'.format
    other, listing = script('{"@type":"Organization","sku":"o"}'), script('{"@type":"Product","sku":"p"}')
    pages = {
        "a": other + listing, "b": other, "c": other + script('[{"@type":"X"},{"@type":["Thing","OFFER"],"sku":"l"}]'), "d": other + script('{"@graph":[{"@type":"product","sku":"g"}]}'),
        "e": other + script('{"@type":"Pr\\u006fduct","sku":"e"}'), "f": script('{"@type":"Organization","name":"Product","sku":"n"}') + listing, "g": script("{broken Product") + other, "h": "",
    }
    wanted = {"a": "p", "b": "o", "c": "l", "d": "g", "e": "e", "f": "p", "g": "o", "h": None}
    rows = spark.createDataFrame([(k, v) for k, v in pages.items()], "url string, html string")
    found = {r.url: r.external_id for r in details.detail_rows(rows, "homege").collect()}
    assert found == wanted
    plan = details.detail_rows(rows, "bulgarianproperties")._jdf.queryExecution().optimizedPlan().toString()
    assert r"(?i)\\u|product" in plan or r"(?i)\u|product" in plan
