"""Result pages of every portal, written from the orders table in the portal's markup and read back.

Twenty listings make a page. The SQL states what each card says, so parsing, numbers, prices and
conversion are checked together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.plans import derived as D
from hearthlake.sources import portals
from hearthlake.sources.elements import extracted_cards

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EURO, TIMES, OVER = "p", "CAST(round_even(p * {0}::DOUBLE, 0) AS BIGINT)", "CAST(round_even(p / {0}::DOUBLE, 0) AS BIGINT)"
#: By portal: a card with {id}, {p} (price), {m2} and {place}; then as SQL its external id, price, and further columns.
CARDS: dict[str, tuple[str, str, str, dict[str, str]]] = {
    "franimo": ('<div class="box1" data-id="{id}" data-latitude="1.5" data-longitude="2.5"><a itemprop="url" href="/w/{id}">x</a><meta itemprop="name" content="huis te koop {place}"><span itemprop="price" content="{p}"></span><span class="beds">3</span></div>',
                "id::VARCHAR", EURO, {"place": "place", "bedrooms": "3::BIGINT", "lat": "1.5::DOUBLE"}),
    "ok_bulgaria": ('<table class="table_prop_item"><tr><td><a href="houses_in_bulgaria_for_sale.php?id={id}">x</a><span class="prop_price">£ {p}</span><span class="prop_lbl">Land:</span><span class="prop_txt">{m2} sq.m.</span></td></tr></table>',
                    "id::VARCHAR", TIMES.format(1.166), {"land_m2": "m2"}),
    "akiyaportal": ('<div><a href="/listings/slug-{id}">y</a><h3>House</h3><p class="text-xl">${p}</p><span class="rounded-full">{m2}m²</span><span class="rounded-full">3LDK</span></div>',
                    "'slug-' || id", TIMES.format(0.85), {"living_m2": "m2", "bedrooms": "3::BIGINT"}),
    "holprop": ('<div class="searchrestable"><a href="/s/sale/es{id}/">x</a><span class="pricefield">€ {p} EUR</span><div class="searchbeds">House • <b>3</b> • {m2} m2</div></div>', "'es' || id", EURO, {"living_m2": "m2", "bedrooms": "3::BIGINT"}),
    "abruzzopropertyitaly": ('<div class="results-list-wrap"><a href="property.php?pid={id}">x</a><div class="results-list-price">Ref: {id} | €{p}</div><div class="results-list-address">{place}, Teramo, Abruzzo, TE64100</div><span class="bednumber">3</span></div>',
                             "id::VARCHAR", EURO, {"place": "place", "region": "'Teramo'", "bedrooms": "3::BIGINT"}),
    "abruzzoruralproperty": ('<div class="fw-list-property"><a href="/find-a-property/for-sale/item/{id}-x">x</a><h2>Stone house with three bedrooms and {m2} sqm of land</h2><span class="bold">€{p}</span></div>', "id::VARCHAR", EURO, {"land_m2": "m2", "bedrooms": "3::BIGINT"}),
    "centrarium": ('<div class="j-item g-item" data-id="1"><a class="g-item-title" href="/en/houses/x-{id}.html">Villa</a><div class="g-item-address">Budva, {place}, Черногория, Montenegro</div><div class="rp-it-params"><span title="total area">{m2} m²</span></div><div class="c-item-price">€ {p}</div></div>',
                   "id::VARCHAR", EURO, {"place": "place", "region": "'Budva'", "living_m2": "m2"}),
    "mubawab": ('<div class="listingBox" linkref="/en/a/{id}/x"><input class="adId" value="{id}"><span class="priceTag">{p} DH</span><span class="listingH3">{place} in Rabat</span><div class="adDetailFeature">{m2} m²</div></div>',
                "id::VARCHAR", OVER.format(10.9), {"place": "place", "region": "'Rabat'", "living_m2": "m2"}),
    "homege": ('<article class="item"><div class="compare-grid-icon" data-listing-id="{id}"></div><ul><li class="title"><a href="/en/x-{id}.html">House For Sale, 3 Room, Borjomi, {place}</a></li><li class="services"><span class="square_feet">{m2} m</span></li></ul><span class="price-tag">{p} $</span></article>',
               "id::VARCHAR", TIMES.format(0.85), {"place": "place", "region": "'Borjomi'", "living_m2": "m2", "rooms": "3::BIGINT"}),
    "bulgarianproperties": ('<div class="component-property-item"><a class="title" href="/x/AD{id}BG_y.html">t</a><div class="location">Near Tarnovo, {place}</div><div class="regular-price">£ {p}</div><div>Area: {m2} m2</div></div>',
                            "'AD' || id || 'BG'", TIMES.format(1.163), {"place": "place", "region": "'Tarnovo'", "living_m2": "m2"}),
    "domaza": ('<div class="single_property" data-prop="{id}"><span class="prop_price">$ {p}</span><span class="area_hidden_data">{m2} m2</span><span class="prop_title">House</span></div>', "id::VARCHAR", TIMES.format(0.87), {"living_m2": "m2", "type": "'House'"}),
    "lefigaro": ('<div class="cartouche-liste"><a href="/annonces/annonce-{id}.html">x</a><h2>Maison</h2>4 pièces • {m2} m² • 2 chambres Boussac (23) : {p} €</div>', "id::VARCHAR", EURO, {"place": "'Boussac'", "living_m2": "m2", "rooms": "4::BIGINT", "bedrooms": "2::BIGINT"}),
    "greenacres": ('<div class="announce-card" data-advertid="adv0{id}"><span class="announce-localisation">{place} (Creuse)</span><span class="info-price">{p} €</span><span class="info-tag" title="Woonoppervlakte">{m2} m²</span></div>',
                   "'adv0' || id", EURO, {"place": "place", "region": "'Creuse'", "living_m2": "m2"}),
}
FACTS = "o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(20 + o_custkey % 300 AS BIGINT) AS m2, 'Village ' || substr('ABCDEFGHIJ', CAST(o_custkey % 10 + 1 AS INT), 1) AS place"


def result_pages(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """url, html: the orders as result pages of a portal, twenty cards a page."""
    facts = D.table(spark, sf_dir, "orders").selectExpr(*D.split_select(FACTS))
    card = D.filled_in(CARDS[source][0], "id", "p", "m2", "place")
    page = F.concat(F.lit(portals.PORTALS[source].base + "/list?part="), F.floor(F.col("id") / 20).cast("string"))
    frame = ('<html><body><div id="listings">', "</div></body></html>") if source == "akiyaportal" else ("<html><body>", "</body></html>")
    return facts.select(page.alias("url"), card.alias("card")).groupBy("url").agg(F.concat(F.lit(frame[0]), F.array_join(F.collect_list("card"), "\n"), F.lit(frame[1])).alias("html"))


def register(source: str) -> None:
    _, ident, price, more = CARDS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portals.list_rows(result_pages(spark, sf_dir, source), source).select("external_id", "price", *more)

    QUERIES[f"source_{source}"] = run
    ORACLES[f"source_{source}"] = f"SELECT {ident} AS external_id, {price} AS price{''.join(f', {v} AS {k}' for k, v in more.items())} FROM (SELECT {FACTS} FROM orders)"


for _source in CARDS:
    register(_source)


def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the navigation and the heading of every raw page."""
    pages = D.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    found = extracted_cards(pages, "nav > ul li", {"link": "a@href", "label": "a"}, {"lang": "html@lang"})
    return found.where("pos is not null").select(F.col("url").cast("long").alias("page_id"), F.col("pos").cast("long").alias("pos"), F.col("f")["link"].alias("link"), F.col("p")["lang"].alias("lang"))


QUERIES["html_cards"] = html_cards
ORACLES["html_cards"] = """WITH lists AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)"', 1) AS links FROM pages)
    SELECT page_id, i - 1 AS pos, links[i] AS link, lang FROM lists, unnest(range(1, len(links) + 1)) AS t(i)"""
