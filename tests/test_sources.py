"""HTML extraction and the portals' rules on small pages; files and outlines."""

import base64
import gzip
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthlake.plans import detail_queries
from hearthlake.sources import details, files, portals
from hearthlake.sources.html import Field, Selector, extracted, parse


def pages(spark, html, url="https://x/list"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def row(spark, source, html, url="https://x/list"):
    return portals.list_rows(pages(spark, html, url), source).collect()


def test_selectors():
    root = parse('<div id="a" class="x y"><p>one<p>two<br>lines<ul><li>1<li>2</ul></div><div><a href="/s/sale/1">A &amp; B</a></div><script>var a = "<p>";</script>')
    texts = lambda s: [n.text() for n in Selector(s).all(root)]
    assert texts("p") == ["one", "two lines 1 2"] or texts("p") == ["one", "two lines"]
    assert texts("#a li") == ["1", "2"] and texts("div.x.y > ul > li, a[href*=sale]") in (["1", "2", "A & B"], ["A & B"])
    assert Field("a@href").read(root) == "/s/sale/1" and Field("*li").read(root) == "1\n2" and Field("script").read(root) == 'var a = "<p>";'
    assert texts("a[href^=/s]") == ["A & B"] and texts("a[href$=9]") == [] and texts("b") == []
    assert texts("div:has(a)") == ["A & B"] and texts("li:has(b)") == []
    with pytest.raises(ValueError, match="selector"):
        Selector("p::first")


def test_pairs_and_pages_without_cards(spark):
    html = '<table><tr><th>Area:</th><td>60 m2</td></tr><tr><th>Area</th><td>61 m2</td></tr></table><div class="r"><b>Price:</b> €5</div>'
    found = extracted(pages(spark, html), None, {"h": "h1"}, pairs=[("tr", "th", "td"), (".r", "b", "i")]).first()
    assert found["facts"] == {"area": "61 m2", "price": "€5"} and found["f"] == {}
    empty = extracted(spark.createDataFrame([("u", None), ("v", "<p>")], "url string, html string"), ".card", {"t": "b"}, {"p": "p"}).collect()
    assert [(r["url"], r["pos"], r["n"]) for r in empty] == [("u", None, 0), ("v", None, 0)]


def test_cards_turned_away_and_repeated(spark):
    card = '<div class="listingBox {c}" linkref="/en/a/{i}/x"><input class="adId" value="{i}"><span class="priceTag">{p}</span></div>'
    html = card.format(c="", i=1, p="350,000 DH") + card.format(c="", i=1, p="1 DH") + card.format(c="", i=2, p="From 5 DH") + card.format(c="adBoostBox", i=3, p="9 DH") + card.format(c="sPremium", i=4, p="price on request")
    found = row(spark, "mubawab", html)
    assert sorted((r["external_id"], r["price"], r["promoted"]) for r in found) == [("1", 32110, False), ("4", None, True)]
    land = '<article class="item"><div class="compare-grid-icon" data-listing-id="9"></div><ul><li class="title"><a href="/en/miwis-nakveti/x-9.html">Land</a></li></ul></article>'
    assert row(spark, "homege", land) == []
    token = base64.b64encode(b"/SignIn?x").decode()  # an account page is no address, the card stays
    found = row(spark, "greenacres", f'<div class="announce-card" data-advertid="abcdefgh1" data-o="{token}"></div><div class="announce-card skeleton" data-advertid="abcdefgh2"></div>')
    assert [(r["external_id"], "SignIn" in r["url"]) for r in found] == [("abcdefgh1", False)]


def test_plot_sized_area_and_quarters(spark):
    html = '<article class="item"><div class="compare-grid-icon" data-listing-id="5"></div><ul><li class="services"><span class="square_feet">1,500 m</span></li></ul><span class="price-tag">60,000 $</span></article>'
    found = row(spark, "homege", html)[0]
    assert (found["living_m2"], found["land_m2"], found["price"]) == (None, 1500, 51000)
    html = '<div class="component-property-item"><a class="title" href="/AD7BG_x">t</a><div class="location">Varna, Quarter Asparuhovo</div><div class="new-price">€ 9 000</div><div class="old-price">€ 9 500</div></div>'
    found = row(spark, "bulgarianproperties", html)[0]
    assert (found["place"], found["region"], found["price"], found["old_price"]) == ("Quarter Asparuhovo", "Varna", 9000, 9500)


def test_item_list_counts_before_cards(spark):
    item = {"@type": "House", "url": "/annonces/annonce-111.html", "name": "Maison 4 pièces Boussac (23)", "offers": {"price": "37 500".replace(" ", "")}, "floorSize": {"value": "71"}, "address": {"addressRegion": "Creuse"}}
    rental = {"item": {"@type": "House", "url": "/annonces/annonce-333.html", "name": "Location maison"}}
    ld = json.dumps({"@type": "ItemList", "numberOfItems": 3, "itemListElement": [{"item": item}, rental]})
    html = f'<script type="application/ld+json">{ld}</script><div class="cartouche-liste"><a href="/annonces/annonce-111.html">x</a> 9 €</div><div class="cartouche-liste"><a href="/annonces/annonce-222.html">x</a> 40 000 €</div>'
    found = {r["external_id"]: (r["price"], r["living_m2"], r["place"], r["region"]) for r in row(spark, "lefigaro", html)}
    assert found == {"111": (37500, 71, "Boussac", "Creuse"), "222": (40000, None, None, None)}


def test_counts_beside_icons(spark):
    html = '<div class="single_property" data-prop="5"><ul class="thumb-info"><li><i class="icon-bed"></i> 3</li><li><i class="icon-shower"></i> 2</li></ul></div>'
    found = row(spark, "domaza", html)[0]
    assert (found["bedrooms"], found["baths"]) == (3, 2)


def page(spark, source, html, url):
    r = portals.list_pages(pages(spark, html, url), source).first()
    return r["total"], r["total_pages"], r["next_url"]


def test_paging(spark):
    assert page(spark, "mubawab", "<div id=numResults>375 results</div>", "https://m/st:p:2") == (375, 12, "https://m/st:p:3")
    assert page(spark, "homege", "<h1>84 ad(s) found</h1>", "https://h/x/") == (84, 2, "https://h/x/index2.html")
    assert page(spark, "domaza", "<a href='/s/_page/5/'>5</a>", "https://d/s/_page/5/") == (None, 5, None)
    assert page(spark, "ok_bulgaria", "<title>22 Bulgarian Properties</title><div class=pagination><input data-max-page=2></div>", "https://o/?a=1") == (22, 2, "https://o/?a=1&page=2")
    assert page(spark, "lefigaro", '<script type="application/ld+json">{"numberOfItems": 9000}</script>', "https://l/x") == (9000, 100, "https://l/x?page=2")
    assert page(spark, "abruzzoruralproperty", '<div class="fw-list-property"></div>' * 6, "https://a/l") == (None, 2, "https://a/l?start=6")
    assert page(spark, "franimo", '<p class="current-page">pagina 1 van 9</p><span class=total-amount>1.234</span><ul class=paging><li class=next><a href="/woning/2">x</a></li></ul>', "https://f/") == (1234, 9, "https://www.franimo.nl/woning/2")
    assert page(spark, "akiyaportal", '<form data-analytics-results-count="50"></form><nav aria-label="Pagination"><a href="?page=3">3</a></nav>', "https://y/l") == (50, 3, "https://y/l?page=2")


def test_details(spark):
    ld = json.dumps({"@type": "RealEstateListing", "offers": {"price": "85000", "priceCurrency": "EUR"}, "itemOffered": {"floorSize": {"value": 96}, "numberOfRooms": 6, "address": {"addressLocality": "Taza"}}})
    html = f'<script type="application/ld+json">{ld}</script><div class="mainInfoProp">Decreased by 5,000 EUR</div><div class="adMainFeature"><p class="adMainFeatureContentLabel">Plot surface</p><p class="adMainFeatureContentValue">96 m²</p></div><div class="prop-map-holder" lat="34.2" lon="-4.0"></div>'
    r = details.detail_rows(pages(spark, html, "https://m/en/a/8158008/x"), "mubawab").first()
    assert (r["external_id"], r["price"], r["old_price"], r["living_m2"], r["land_m2"], r["rooms"], r["place"], r["lat"]) == ("8158008", 85000, 90000, 96, 96, 6, "Taza", 34.2)
    assert json.loads(r["raw_fields"]) == {"plot surface": "96 m²", "price_eur": "85000", "price_source": "portal_eur"}
    html = '<table class="property-information"></table><div class="property-information"><table><tr><th>Type:</th><td>Terrein</td></tr><tr><th>Woning:</th><td>800 m2</td></tr><tr><th>Terrein:</th><td>800 m2</td></tr></table></div><div class="energy-emmission"><table class="energy-table"><tr><td>51 - 90 B</td><td></td></tr><tr><td>180 - 250 D</td><td>207</td></tr></table></div><table class="gas-emmission faded"><tr><td>A</td><td>9</td></tr></table>'
    r = details.detail_rows(pages(spark, html, "https://f/woning/12345"), "franimo").first()
    assert (r["type"], r["living_m2"], r["land_m2"]) == ("Terrein", None, 800)
    assert (r["energy_label"], r["energy_kwh"], r["gas_label"], r["gas_co2"]) == ("D", 207, None, None)
    html = "<table class=buttons_details><tr><td><div><b>Type:</b> Land - agricultural</div> Land: 707 m2 Village: NIKOLAEVKA (pop. 9) € 1,500 £1,286 ID: K7</td></tr></table><h3>House 100 sqm</h3>"
    r = details.detail_rows(pages(spark, html, "https://o/h.php?id=29839"), "ok_bulgaria").first()
    assert (r["external_id"], r["price"], r["land_m2"], r["living_m2"], r["place"], r["reference"]) == ("29839", 1500, 707, None, "Nikolaevka", "K7")
    assert set(details.DETAILS) == set(portals.PORTALS)


def test_files(spark, tmp_path):
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "aa.html.gz").write_bytes(gzip.compress("prix 5 €".encode()))
    (cache / "bb.html").write_bytes(b"\xcf\xf0\xe8\xe2\xe5\xf2 \xcf\xf0\xe8\xe2\xe5\xf2")
    (cache / "cc.html.gz").write_bytes(b"\x1f\x8bbroken")
    found = files.page_files(spark, str(cache), declared="windows-1251")
    assert {r["key"]: r["html"] for r in found.collect()} == {"aa": "prix 5 €", "bb": "Привет Привет", "cc": None}
    assert files.fresh(found, F.current_timestamp(), 3600).count() == 2 and files.fresh(found, F.lit(datetime(2100, 1, 1)), 10).count() == 0
    files.compact_pages(found, str(tmp_path / "pages"), 1)
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 3


def test_search_lists_and_counts(spark, tmp_path):
    specs = {"a": {"path": "/x", "skip": {"priceless": True, "above": 5}, "bands": [[0, 9], [10, 20]]}, "b": {"source": "homege", "path": "/y", "enabled": False}}
    (tmp_path / "searches.json").write_text(json.dumps(specs))
    found = files.searches(spark, str(tmp_path / "searches.json"))
    assert {r["search"]: (r["source"], r["enabled"]) for r in found.collect()} == {"a": ("franimo", True), "b": ("homege", False)}
    assert [r["bands"] for r in found.where("search = 'a'").collect()] == [[[0, 9], [10, 20]]]
    assert [r["search"] for r in files.enabled(found).collect()] == ["a"] and [r["search"] for r in files.enabled(found, "homege", ["b"]).collect()] == ["b"]
    added = found.where("search = 'b'").withColumn("enabled", F.lit(True))
    files.searches_json(files.with_search(found, added)).write.text(str(tmp_path / "again"))
    again = files.searches(spark, str(tmp_path / "again"))
    assert {r["search"]: r["enabled"] for r in again.collect()} == {"a": True, "b": True} and again.where("search = 'a'").first()["bands"] == [[0, 9], [10, 20]]
    (tmp_path / "meta.json").write_text(json.dumps({"total": 1, "searches": [{"search": "a", "n": 5}, {"search": "b", "n": "x"}, {"n": 3}, "odd", {"search": "c", "n": "7"}]}))
    assert sorted(map(tuple, files.published_counts(spark, str(tmp_path / "meta.json")).collect())) == [("a", 5), ("c", 7)]


def test_packed_export_and_old_store(spark, tmp_path):
    packed = {"v": 2, "cols": ["id", "source", "url", "thumb", "price"], "dict": {"source": ["franimo", "homege"]}, "imgPrefixes": ["https://i/1/"], "urlPrefix": "https://f", "rows": [[1, 1, "/a", [0, "x.jpg"], 5], [2, 0, "https://h/b", None, None]]}
    (tmp_path / "p.json").write_text(json.dumps(packed))
    found = {r["id"]: r["facts"] for r in files.unpacked(spark, str(tmp_path / "p.json")).collect()}
    assert found == {1: {"id": "1", "source": "homege", "url": "https://f/a", "thumb": "https://i/1/x.jpg", "price": "5"}, 2: {"id": "2", "source": "franimo", "url": "https://h/b"}}
    store = sqlite3.connect(tmp_path / "s.db")
    store.execute("CREATE TABLE listings (id INTEGER PRIMARY KEY, source TEXT, lat REAL)")
    store.executemany("INSERT INTO listings VALUES (?, ?, ?)", [(i, f"s{i % 3}", i / 2) for i in range(1, 101)])
    store.commit()
    rows = files.sqlite_table(spark, str(tmp_path / "s.db"), "listings", 3)
    assert rows.count() == 100 and rows.agg(F.sum("lat")).first()[0] == 2525.0 and rows.rdd.getNumPartitions() == 3


def test_outlines(spark, tmp_path):
    square = [[0, 0], [1, 0.0001], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [{"properties": {"name": "A", "code": "01"}, "geometry": {"type": "Polygon", "coordinates": [square, [[9, 9], [9, 8], [9, 9]]]}}, {"properties": {"nom": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[50, 50], [51, 50], [50, 50]]]]}}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = files.outlines(spark, str(tmp_path / "g.json"))
    found = {r["name"]: r["rings"] for r in files.simplify(files.inside(rows, -5, 5, -5, 5), 0.01).collect()}
    assert found == {"A": [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]], "B": [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]}
    assert rows.select(files.svg_path(F.col("rings")).alias("d")).first()["d"].startswith("M0.0 0.0L1.0 0.0L2.0 0.0")


def test_rules_of_a_detail_page_are_worked_out_a_few_times(spark):
    """Amounts, sizes and JSON parts are shared inside an expression, not written out again for each mention (3,773 patterns for one portal before)."""
    for source, most in (("bulgarianproperties", 200), ("homege", 100), ("mubawab", 100), ("greenacres", 100), ("akiyaportal", 60)):
        plan = detail_queries.QUERIES[f"details_{source}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") <= most, source
