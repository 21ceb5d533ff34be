"""Detail pages of every portal, written from the orders table in the portal's markup and read back.

One listing a page, with the parts of a page that must not be read beside those that must: other
structured data, other listings, plots and barns. The SQL states what each page says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.plans import derived as D
from hearthlake.plans.source_queries import EURO, FACTS, OVER, TIMES
from hearthlake.sources.details import detail_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LD = '<script type="application/ld+json">{0}</script>'
ORGANISATION = LD.format('{"@type":"Organization","name":"Portal","price":"1"}')
#: By portal: the address and the page, with {id}, {p} (price), {m2}, {land} and {place}; then as SQL what the page says.
PAGES: dict[str, tuple[str, str, dict[str, str]]] = {
    "mubawab": (
        "https://www.mubawab.ma/en/a/{id}/x",
        ORGANISATION + LD.format('{"@type":"RealEstateListing","offers":{"price":"{p}","priceCurrency":"MAD"},"itemOffered":{"numberOfRooms":"4","floorSize":{"value":"{m2}"},"address":{"addressLocality":"{place}"}}}')
        + '<div class="mainInfoProp"><h3 class="orangeTit">{p} DH</h3><span class="x">Decreased by 109 DH</span></div><div class="blockProp"><p>House on a plot of {land} m²</p></div><div class="prop-map-holder" lat="34.5" lon="-6.5"></div>',
        {"external_id": "id::VARCHAR", "price": OVER.format(10.9), "old_price": "CAST(round_even((p + 109) / 10.9::DOUBLE, 0) AS BIGINT)", "living_m2": "m2", "land_m2": "land", "rooms": "4::BIGINT", "place": "place", "lat": "34.5::DOUBLE", "price_source": "'mad_converted'"},
    ),
    "homege": (
        "https://www.home.ge/en/x-{id}.html",
        ORGANISATION + LD.format('{"@type":"Product","brand":{"name":"House For Sale"},"offers":{"price":"{p}","priceCurrency":"USD"}}')
        + '<div class="listing-fields">' + "".join(f'<div class="table-cell"><div class="name">{k}</div><div class="value">{v}</div></div>' for k, v in (("Area", "{m2} m"), ("Yard area", "{land} m"), ("Rooms", "3 Rooms"), ("Water", "Yes"), ("Gas", "No"), ("Condition", "Old"), ("Title", "Agricultural land, daily rent"), ("District / Village", "{place}")))
        + "</div>",
        {"external_id": "id::VARCHAR", "price": TIMES.format(0.85), "living_m2": "m2", "land_m2": "land", "rooms": "3::BIGINT", "type": "'House For Sale'", "features": "'Water, Condition: Old'", "agricultural_land": "'true'", "maybe_rental": "'true'", "price_source": "'usd_converted'"},
    ),
    "bulgarianproperties": (
        "https://www.bulgarianproperties.com/x/AD{id}BG_y.html",
        ORGANISATION + LD.format('[{"@type":"BreadcrumbList"},{"@type":["Product","Offer"],"image":["https://x.test/property-images/big/{id}.jpg",{"url":"https://x.test/a.jpg"}],"offers":{"price":"{p}","priceCurrency":"GBP"}}]')
        + '<span class="property-label">Reserved</span><div class="property-gallery"><img src="https://x.test/property-images/medium1/{id}.jpg"><img src="/property-images/big/{id}b.jpg"><img src="/logo.png"></div>'
        + "".join(f'<div class="characteristic"><span class="label">{k}</span><span class="value">{v}</span></div>' for k, v in (("Type of property:", "House, Villa"), ("Area:", "{m2} m2"), ("Garden:", "{land} m2"), ("Village:", "{place}"))),
        {"external_id": "'AD' || id || 'BG'", "price": TIMES.format(1.163), "living_m2": "m2", "land_m2": "land", "type": "'House'", "place": "place", "price_source": "'gbp_converted'", "reserved": "'true'", "maybe_rental": "NULL::VARCHAR",
         "photos": "'https://x.test/property-images/big/' || id || '.jpg https://x.test/a.jpg https://www.bulgarianproperties.com/property-images/big/' || id || 'b.jpg'"},
    ),
    "centrarium": (
        "https://centrarium.com/en/houses/x-{id}.html",
        ORGANISATION + LD.format('{"@type":"Product","offers":{"price":"{p}","priceCurrency":"EUR"}}')
        + "<h1>Townhouse in Budva</h1><p>It stands on a plot of {land} m2</p>" + "".join(f'<div class="vw-dynprops-item"><span class="vw-dynprops-item-attr">{k}</span><span class="vw-dynprops-item-val">{v}</span></div>' for k, v in (("Total area", "{m2} m²"), ("Rooms", "5"), ("Bedrooms", "2"))),
        {"external_id": "id::VARCHAR", "price": EURO, "living_m2": "m2", "land_m2": "land", "rooms": "5::BIGINT", "bedrooms": "2::BIGINT", "type": "'Townhouse'"},
    ),
    "abruzzoruralproperty": (
        "https://www.abruzzoruralproperty.com/find-a-property/for-sale/item/{id}-x",
        '<meta name="description" content="Stone house with {land} sqm of land"><meta property="og:description" content="Abruzzo Rural Property, 9 sqm of land"><nav>8 sqm of garden</nav>'
        + "".join(f'<div class="fw-property-detail-row"><span class="text-bold">{k}</span><span itemprop="value">{v}</span></div>' for k, v in (("Price:", "€{p}"), ("City:", "{place}"), ("Total cadastral space:", "{m2} sqm"), ("Bedrooms:", "3"), ("Energy class:", "G"))),
        {"external_id": "id::VARCHAR", "price": EURO, "living_m2": "m2", "land_m2": "land", "bedrooms": "3::BIGINT", "place": "place", "energy_label": "'G'"},
    ),
    "abruzzopropertyitaly": (
        "https://www.abruzzopropertyitaly.com/property.php?pid={id}",
        '<h1 class="detail-price">{place}, Teramo, Abruzzo</h1><div class="details-address1">Ref: {id} | €{p} PCM</div><div class="details-icons"><div>Townhouse</div><div>3 bedrooms</div><div>1 bathroom</div><div>{m2}.00 SQM</div><div>{land}.00 SQM</div></div><script>new google.maps.LatLng(42.5, 13.5)</script>',
        {"external_id": "id::VARCHAR", "price": EURO, "living_m2": "m2", "land_m2": "land", "bedrooms": "3::BIGINT", "place": "place", "region": "'Teramo'", "lat": "42.5::DOUBLE", "pcm_label": "true"},
    ),
    "domaza": (
        "https://www.domaza.com/property/x-{id}",
        '<h1>House, {place}, Shkoder</h1><div class="title_hidden_data">House for sale</div><span class="property_title">House</span><div class="property_important_data">'
        + "".join(f'<div class="data_row"><span class="single_data_label">{k}</span><span class="single_data_value">{v}</span></div>' for k, v in (("Price", "$ {p}"), ("Floor area", "{m2} m2"), ("Plot", "{land} m2"))) + "</div><p>ID {id}</p>",
        {"external_id": "id::VARCHAR", "price": TIMES.format(0.87), "living_m2": "m2", "land_m2": "land", "type": "'House'", "place": "place", "deal": "'sale'", "price_source": "'usd_converted'"},
    ),
    "holprop": (
        "https://www.holprop.com/s/sale/es{id}/",
        '<div class="lefdetails">Type: Villa Bedrooms: 3 Bathrooms: 2 Floor area: {m2} m2 Land area: {land} m2 City: {place}</div><div class="advert-price">€ {p} EUR</div><span class="txt_gray_price">£ 77 GBP</span>',
        {"external_id": "'es' || id", "price": EURO, "price_gbp": "77::BIGINT", "living_m2": "m2", "land_m2": "land", "bedrooms": "3::BIGINT", "baths": "2::BIGINT", "type": "'Villa'", "price_source": "'portal_eur'"},
    ),
    "ok_bulgaria": (
        "https://www.cheap-bulgarian-house.co.uk/houses_in_bulgaria_for_sale.php?id={id}",
        '<h3>30 sqm garage, 1300 sqm forest, {m2} sqm derelict house, 12 sqm villa</h3><table class="buttons_details"><tr><td>Type: 3 bedrooms Land: {land} sq.m. Village: NIKOLAEVKA (VARNA) Price: £ {p} ID: ref{id}</td></tr></table>',
        {"external_id": "id::VARCHAR", "price": TIMES.format(1.166), "living_m2": "m2", "land_m2": "land", "bedrooms": "3::BIGINT", "place": "'Nikolaevka'", "price_source": "'gbp_converted'"},
    ),
    "lefigaro": (
        "https://immobilier.lefigaro.fr/annonces/annonce-{id}.html",
        ORGANISATION + LD.format('{"@graph":[{"@type":"WebSite"},{"@type":"RealEstateListing","offers":[{"price":"{p}"}],"itemOffered":{"@type":["Thing","House"],"numberOfRooms":"4","numberOfBedrooms":"2","floorSize":{"value":"{m2}"},"address":{"addressLocality":"{place}","addressRegion":"Creuse"}}}]}')
        + "<h1>Belle demeure</h1><ul><li><span>Terrain</span><strong>{land} m²</strong></li></ul><p>DPE : G GES : C 447 kWh</p>",
        {"external_id": "id::VARCHAR", "price": EURO, "living_m2": "m2", "land_m2": "land", "rooms": "4::BIGINT", "bedrooms": "2::BIGINT", "type": "'Maison'", "region": "'Creuse'", "energy_label": "'G'", "gas_label": "'C'"},
    ),
    "greenacres": (
        "https://www.green-acres.fr/nl/properties/huis/x/adv0{id}.htm",
        '<input id="AdvertId" value="adv0{id}"><h1>Huis</h1><span class="announce-localisation">{place} (Creuse)</span><span class="price-detail">{p} €</span><span class="info-tag" title="Woonoppervlakte">{m2} m²</span><p class="description">Ruim {land} m² terrein</p><span class="ValueTag__ValueTagGrade">D</span>',
        {"external_id": "'adv0' || id", "price": EURO, "living_m2": "m2", "land_m2": "land", "type": "'Huis'", "place": "place", "region": "'Creuse'", "energy_label": "'D'", "price_source": "'portal_eur'"},
    ),
    "franimo": (
        "https://www.franimo.nl/woning/{id}",
        '<p>not a feature</p><div itemprop="description">Huis</div><p>Tuin</p><p>Zwembad</p><div class="property-information"><table>'
        + "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in (("Franimo nr:", "{id}"), ("Type:", "huis"), ("Nabij:", "{place}"), ("Woning:", "{m2} m²"), ("Terrein:", "{land} m²"), ("Kamers:", "5"), ("Slaapkamers:", "3"), ("Prijs:", "€ {p}")))
        + "</table></div><p>Elsewhere</p>",
        {"external_id": "id::VARCHAR", "price": EURO, "living_m2": "m2", "land_m2": "land", "rooms": "5::BIGINT", "bedrooms": "3::BIGINT", "place": "place", "features": "'Tuin, Zwembad'"},
    ),
    "akiyaportal": (
        "https://akiyaportal.com/listings/slug-{id}",
        ORGANISATION + LD.format('{"@type":"RealEstateListing","price":"{p}","priceCurrency":"USD","description":"Old house. Start a free trial to see more.","address":{"addressLocality":"{place}, X","addressRegion":"Nagano"}}')
        + '<h1>House 3LDK</h1><a href="/listing-images/{id}a/1.webp">1</a><a href="/listing-images/{id}a/2.webp">2</a><div class="flex justify-between"><span class="label">Building area</span><span class="font-medium">{m2} m²</span></div>'
        + '<div class="flex justify-between"><span class="label">Land area</span><span class="font-medium">{land} m²</span></div><h2>Similar Properties</h2><a href="/listing-images/other/1.webp">3</a>',
        {"external_id": "'slug-' || id", "price": TIMES.format(0.85), "living_m2": "m2", "land_m2": "land", "place": "place", "region": "'Nagano'", "bedrooms": "3::BIGINT", "description": "'Old house.'", "photos": "'https://akiyaportal.com/listing-images/' || id || 'a/1.webp'", "price_source": "'portal_usd'"},
    ),
}
DETAIL_FACTS = FACTS + ", CAST(400 + o_custkey % 3000 AS BIGINT) AS land"


def detail_pages(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """url, html: the orders as detail pages of a portal."""
    facts = D.spread(D.table(spark, sf_dir, "orders").selectExpr(*D.split_select(DETAIL_FACTS)))
    address, body, _ = PAGES[source]
    named = ("id", "p", "m2", "land", "place")
    return facts.select(D.filled_in(address, *named).alias("url"), D.filled_in("<html><body>" + body + "</body></html>", *named).alias("html"))


def register(source: str) -> None:
    stated = PAGES[source][2]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        derived = {"photos": F.array_join("photos", " "), **{k: F.get_json_object("raw_fields", f"$.{k}") for k in ("price_source", "reserved", "maybe_rental", "agricultural_land")}}
        return detail_rows(detail_pages(spark, sf_dir, source), source).select(*(derived.get(c, F.col(c)).alias(c) for c in stated))

    QUERIES[f"details_{source}"] = run
    ORACLES[f"details_{source}"] = f"SELECT {', '.join(f'{v} AS {k}' for k, v in stated.items())} FROM (SELECT {DETAIL_FACTS} FROM orders)"


for _source in PAGES:
    register(_source)
