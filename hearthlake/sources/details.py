"""Detail pages: label and value tables, JSON-LD and texts of each portal as columns of the listing table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions import cleaning, money, numbers, text, urls
from hearthlake.functions.geo import clean_coordinate, literal_map, not_at_zero
from hearthlake.functions.numbers import AMOUNT, SQUARE_METRES, found, matched
from hearthlake.sources.html import RECORD, extracted
from hearthlake.sources.portals import LEFIGARO_TYPES, here, in_lines, kinds_of, unwrapped, whole

DETAILS: dict[str, Detail] = {}
#: Values that rules name more than once, in the order in which they are worked out; detail_rows makes each a column of its own.
STEPS: list[tuple[str, Column]] = []
#: The fields of the page that the rules have named so far.
ASKED: set[str] = set()
#: May be read on every detail page beside what a portal names.
COMMON = {
    "ld": "**script[type=application/ld+json]",
    "h1": "h1",
    "title": "title",
    "body": "body",
    "scripts": "*script",
    "images": "*img[src]@src",
    "map_links": "*a[href*=mlat=], a[href*=maps]@href",
    "osm": "*iframe[src*=maps]@src",
}


@dataclass(frozen=True)
class Detail:
    name: str
    columns: Callable[[], dict[str, Column]]
    fields: dict[str, str] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    #: Kinds of the JSON-LD block that describes the listing, lower case, and whether any other block will do.
    kinds: tuple[str, ...] = ("product", "offer", "realestatelisting")
    any_kind: bool = True

    def __post_init__(self) -> None:
        DETAILS[self.name] = self


def kept(value: Column) -> Column:
    """A value that is always needed and named more than once, as a column worked out once before the rules.

    It then stays outside the lambdas of `once`, which Spark walks node by node for every row.
    """
    STEPS.append((f"_kept_{len(STEPS)}", value))
    return F.col(STEPS[-1][0])


def f(name: str) -> Column:
    """A field of the page; only fields that a rule names are read."""
    ASKED.add(name)
    return F.col("f")[name]


def node() -> Column:
    """The page's JSON-LD block."""
    ASKED.add("ld")
    return F.col("node")


def fact(*labels: str) -> Column:
    """The value beside the first of the labels that the page has."""
    return F.coalesce(*(F.col("facts")[label] for label in labels))


def fact_like(pattern: str) -> Column:
    """The value beside the first label that a pattern meets."""
    return F.try_element_at(F.map_values(F.map_filter("facts", lambda k, v: k.rlike(pattern))), F.lit(1))


def part(value: Column | str, path: str, kind: str = "string") -> Column:
    """A part of a parsed JSON value, as text or another type; null where it is not there or of no such type."""
    return F.try_variant_get(value, path if path.startswith("$") else f"${path}" if path.startswith("[") else f"$.{path}", kind)


def ld_block(kinds: tuple[str, ...], any_kind: bool) -> Column:
    """The page's first JSON-LD block of one of these kinds, else its first block at all, parsed; lists and graphs are opened.

    Blocks are parsed here; fields are parts of the parsed value. A text that nowhere has a kind's word, nor an escape
    that might spell one, is of no such kind and is parsed only if none is.
    """
    texts, words = F.split(F.coalesce(f("ld"), F.lit("")), RECORD), "|".join(kinds)
    opened = lambda b: F.coalesce(part(b, "$", "array<variant>"), part(b, "$['@graph']", "array<variant>"), F.array(b))
    blocks = lambda of: F.filter(F.flatten(F.transform(F.transform(of, F.try_parse_json), opened)), lambda b: b.isNotNull())
    likely = F.filter(texts, lambda t: t.rlike(rf"(?i)\\u|{words}"))
    wanted = F.filter(blocks(likely), lambda b: part(b, "$['@type']").rlike(rf'(?i)(^|")({words})("|$)'))
    first = F.try_element_at(wanted, F.lit(1))
    return F.coalesce(first, F.try_element_at(blocks(texts), F.lit(1))) if any_kind else first


def ld(path: str) -> Column:
    """A value of the page's JSON-LD block."""
    return part(node(), path)


def ld_images() -> Column:
    """The pictures that the JSON-LD block names, one a line: addresses, or objects with one."""
    listed = F.coalesce(part(node(), "image", "array<variant>"), F.array(part(node(), "image", "variant")))
    each = F.transform(listed, lambda x: F.coalesce(part(x, "url"), part(x, "$")))
    return F.array_join(F.filter(each, lambda x: F.startswith(x, F.lit("http"))), "\n")


def offered(path: str) -> Column:
    return F.coalesce(ld(f"itemOffered.{path}"), ld(path))


def coordinates(*patterns: str) -> tuple[Column, Column]:
    """Latitude and longitude from the first pattern with two groups that the page's scripts or links meet."""
    blob = F.concat_ws("\n", f("scripts"), f("map_links"), f("osm"))
    lat = F.coalesce(*(found(blob, p, 1) for p in patterns))
    lon = F.coalesce(*(found(blob, p, 2) for p in patterns))
    return clean_coordinate(lat, 90), clean_coordinate(lon, 180)


def body() -> Column:
    return numbers.spaced(F.coalesce(f("body"), F.lit("")))


def photo_list(lines: Column, base: str, wanted: str = r".") -> Column:
    """The pictures in order, each once whatever its query, as whole addresses."""
    links = F.filter(F.split(F.coalesce(lines, F.lit("")), "\n"), lambda u: (u != "") & ~F.startswith(u, F.lit("data:")) & u.rlike(wanted))
    return F.array_distinct(F.transform(links, lambda u: here(F.regexp_replace(u, r"\?.*$", ""), base)))


def one_size(lines: Column, size: str, base: str) -> Column:
    """The first address of each picture, whatever the size that its address names."""
    links = kept(F.filter(F.split(F.coalesce(lines, F.lit("")), "\n"), lambda u: u != ""))
    keys = kept(F.transform(links, lambda u: F.regexp_replace(u, size, "/big/")))  # inside the lambda they would be made again for each link
    first = F.filter(links, lambda u, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return F.transform(first, lambda u: here(u, base))


# What portals write of rentals, land that foreigners may not own, and plots that go with a house.
RENTAL = {
    "bulgarianproperties": r"(?i)\b(?:/month|per month|for rent|to let|pcm)\b",
    "greenacres": r"(?i)\b(?:te huur|huur|location|louer)\b",
    "homege": r"(?i)\b(?:for rent|house for rent|daily rent|lease)\b",
    "lefigaro": r"(?i)\b(?:location|louer)\b",
    "mubawab": r"(?i)(?:\bfor rent\b|\bà louer\b)",
}
FARM_LAND, HOUSEHOLD_PLOT = r"(?i)\b(?:agricultural(?:\s+land)?|ag[\s-]?land)\b|სასოფლო", "საკარმიდამო"


def flags(source: str, *texts: Column, **more: Column) -> dict[str, Column]:
    """The marks that a page's texts earn, each as `true` or null: maybe_rental by the portal's words, and others that are given."""
    marks = more | {"maybe_rental": matched(F.concat_ws(" ", *texts), RENTAL[source])}
    return {name: F.when(mark, "true") for name, mark in marks.items()}


def chosen(amount: Column, currency: Column) -> Column:
    return F.when(amount.isNotNull() & currency.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def stated_by(amount: Column, currency: Column) -> dict[str, Column]:
    """A single amount by its currency; null for the others."""
    return {c: F.when(currency == c, amount.cast("long")) for c in money.ORDER}


def stated_in(**by_currency: Column) -> dict[str, Column]:
    """Amounts by currency, null where they are not there."""
    return {c: v.cast("long") for c, v in by_currency.items()}


def stated_at(text: Column, source: str) -> dict[str, Column]:
    """The first amount of each currency that a text states."""
    return {c: kept(v) for c, v in money.amounts_by(kept(numbers.spaced(text)), source).items()}


def energy(pattern: str = r"(?i)\b(?:classe[-\s]?[eé]nergie|DPE|energieklasse|energieprestatie|verbruik)\s*[:\s]*([A-G])\b") -> Column:
    return F.upper(found(body(), pattern))


def mubawab() -> dict[str, Column]:
    code = kept(money.code(ld("offers.priceCurrency")))
    currency = F.when(code.isin("MAD", "DH"), "MAD").when(code == "EUR", "EUR")
    paid = kept(F.coalesce(chosen(numbers.rounded(ld("offers.price")), currency), money.money(f("price"), "mubawab")))
    before = money.price_before_drop(f("main"), paid["amount"], paid["currency"])
    place, description = offered("address.addressLocality"), F.coalesce(f("text"), ld("description"))
    land = F.coalesce(
        numbers.area(fact_like("^(plot|land)( ?(surface|area))?$")),
        numbers.digits(found(numbers.spaced(description), rf"(?i)(?:plot|land(?:\s+area)?|lot(?:\s+area)?)\s*(?:of|is|:)?\s*{AMOUNT}\s*(?:m²|m2)")),
    )
    lat, lon = clean_coordinate(F.coalesce(f("lat"), f("lat2")), 90), clean_coordinate(F.coalesce(f("lon"), f("lon2")), 180)
    return {
        "_flags": flags("mubawab", description, ld("name"), fact("type of property")),
        "_stated": stated_by(paid["amount"], paid["currency"]),
        "external_id": F.coalesce(urls.listing_id(F.col("url"), "mubawab"), urls.listing_id(ld("url"), "mubawab")),
        "type": F.coalesce(fact("type of property"), F.lit("House")),
        "place": F.coalesce(f("grey"), place),
        "region": F.coalesce(place, f("grey")),
        "price": money.euros(paid["amount"], paid["currency"], "mubawab"),
        "currency": F.lit("EUR"),
        "old_price": money.to_euro(before, paid["currency"], "mubawab"),
        "living_m2": F.coalesce(numbers.rounded(offered("floorSize.value")), numbers.area(in_lines(f("features"), r"(?i)([0-9][0-9\s.,]*\s*m[²2])"))),
        "land_m2": land,
        "rooms": whole(offered("numberOfRooms")),
        "bedrooms": whole(offered("numberOfBedrooms")),
        "baths": whole(offered("numberOfBathroomsTotal")),
        "lat": lat,
        "lon": lon,
        "description": description,
        "photos": photo_list(f("gallery"), "https://www.mubawab.ma"),
    }


Detail("mubawab", mubawab, {
    "price": "h3.orangeTit",
    "main": ".mainInfoProp",
    "features": "*.mainInfoProp .adDetailFeature",
    "grey": "h3.greyTit",
    "text": ".blockProp p",
    "lat": ".prop-map-holder@lat",
    "lon": ".prop-map-holder@lon",
    "lat2": "#latField@value",
    "lon2": "#lngField@value",
    "gallery": "*.gallery img, img.sliderImage@src",
},
       [(".adMainFeature", ".adMainFeatureContentLabel", ".adMainFeatureContentValue")])


# Labels of one portal's fittings.
FITTINGS = ("water", "drainage", "electricity", "gas", "fireplace", "sauna", "pool", "loggia", "furniture appliances", "condition", "status", "storeroom")


def fittings() -> Column:
    """The fittings that a page states: those it says yes to by name, others with their value."""
    def named(label: str) -> Column:
        value, name = fact(label), label.title()
        return F.when(F.lower(value).isin("no", "none", "-"), None).when(F.lower(value) == "yes", name).otherwise(F.concat(F.lit(name + ": "), value))

    return text.blank_as_null(F.concat_ws(", ", *map(named, FITTINGS)))


def homege() -> dict[str, Column]:
    currency = kept(money.code(ld("offers.priceCurrency")))
    currency = F.when(currency.isin("USD", "US$"), "USD").when(currency.isin("EUR", "EU"), "EUR").when(currency == "GEL", "GEL")
    paid = kept(F.coalesce(chosen(numbers.comma_thousands(ld("offers.price")), currency), money.money(f("price"), "homege")))
    living, land, _ = cleaning.plot_as_land(
        numbers.area(fact("area"), numbers.comma_thousands, r"(?:m²|m2|m)\b"),
        numbers.area(fact("yard area"), numbers.comma_thousands, r"(?:m²|m2|m)\b"),
    )
    lat, lon = coordinates(r"(?i)latLng['\"]?\s*:\s*['\"]\s*(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)")
    blob = kept(F.concat_ws(" ", fact("title"), fact("description"), ld("description"), ld("name"), ld("brand.name")))
    farm = matched(blob, FARM_LAND) | F.contains(F.lower(F.coalesce(fact("land_type_data"), F.lit(""))), F.lit("agricultural"))
    return {
        "_flags": flags("homege", blob, agricultural_land=farm, household_plot=~farm & F.contains(blob, F.lit(HOUSEHOLD_PLOT))),
        "_stated": stated_by(paid["amount"], paid["currency"]),
        "external_id": F.coalesce(urls.listing_id(F.col("url"), "homege"), urls.listing_id(ld("url"), "homege"), ld("sku"), ld("mpn")),
        "type": F.coalesce(ld("brand.name"), fact("type of property"), F.lit("House For Sale")),
        "place": F.trim(fact("district / village")),
        "region": F.trim(fact("city/region")),
        "price": money.euros(paid["amount"], paid["currency"], "homege"),
        "currency": F.lit("EUR"),
        "living_m2": living,
        "land_m2": land,
        "rooms": whole(found(fact("rooms"), r"(?i)([0-9]+)\s*Rooms?\b")),
        "bedrooms": numbers.comma_thousands(fact("bedrooms")),
        "baths": numbers.comma_thousands(fact("bathrooms")),
        "lat": lat,
        "lon": lon,
        "description": F.concat_ws("\n", fact("title"), F.coalesce(fact("description"), ld("description"))),
        "reference": fact("reference number"),
        "agent": text.node_text(f("seller")),
        "features": fittings(),
        "photos": photo_list(f("images"), "https://www.home.ge", "listings|digitaloceanspaces"),
    }


Detail("homege", homege, {"price": ".price-tag, #df_field_price", "seller": ".seller-info"}, [(".listing-fields .table-cell", ".name", ".value")])


def bulgarianproperties() -> dict[str, Column]:
    number = F.coalesce(
        urls.listing_id(F.col("url"), "bulgarianproperties"),
        urls.listing_id(ld("offers.url"), "bulgarianproperties"),
        f("prop_id"),
        found(f("body"), r"(?i)\bAD([0-9]+)BG\b"),
    )
    stated = kept(numbers.comma_thousands(ld("offers.price"), join_spaces=True))
    currency = kept(money.code(F.coalesce(ld("offers.priceCurrency"), F.lit("EUR"))))
    switch = lambda sign: numbers.comma_thousands(
        found(f("switches"), rf"(?i)ch_currency\(\s*['\"][^'\"]*?(?:{sign})\s*{AMOUNT}"),
        join_spaces=True,
    )
    shown = kept(money.money(f("price"), "bulgarianproperties"))
    of = lambda code, sign: F.coalesce(F.when(currency == code, stated), switch(sign), F.when(shown["currency"] == code, shown["amount"]))
    eur, gbp, usd = kept(of("EUR", "€|&euro;")), kept(of("GBP", "£|&pound;")), kept(of("USD", r"\$|USD"))
    price = F.coalesce(eur, money.euros(gbp, F.lit("GBP"), "bulgarianproperties"), money.euros(usd, F.lit("USD"), "bulgarianproperties"))
    kind = F.trim(F.split_part(fact("type of property"), F.lit(","), F.lit(1)))
    size = lambda t: numbers.area_or_number(t, lambda x: numbers.comma_thousands(x, join_spaces=True))
    living, land, _ = cleaning.plot_as_land(size(fact("area")), size(fact("garden", "yard", "plot")), matched(kind, r"(?i)land|plot"))
    lat, lon = coordinates(r"(?i)maps\?q=(-?[0-9]+(?:\.[0-9]+)?),(-?[0-9]+(?:\.[0-9]+)?)")
    zero = not_at_zero(lat, lon, 0.1, both=True)
    return {
        "_flags": flags(
            "bulgarianproperties", f("h1"), kind, f("text"), f("labels"),
            reserved=matched(f("labels"), "(?i)reserved|sold"), best_bargain=matched(f("labels"), "(?i)best bargain"),
        ),
        "_stated": stated_in(EUR=eur, GBP=gbp, USD=usd),
        "external_id": F.concat(F.lit("AD"), number, F.lit("BG")),
        "type": kind,
        "place": fact("village", "town", "location"),
        "price": price,
        "currency": F.lit("EUR"),
        "price_gbp": gbp,
        "price_usd": usd,
        "living_m2": living,
        "land_m2": land,
        "lat": zero[0],
        "lon": zero[1],
        "description": F.coalesce(f("text"), ld("description")),
        "reference": F.concat(F.lit("AD"), number, F.lit("BG")),
        "photos": one_size(
            F.concat_ws("\n", ld_images(), F.array_join(F.filter(F.split(f("gallery"), "\n"), lambda u: F.contains(u, F.lit("property-images"))), "\n")),
            r"/medium[0-9]*/",
            "https://www.bulgarianproperties.com",
        ),
    }


Detail("bulgarianproperties", bulgarianproperties, {
    "prop_id": "[data-preference-prop-id]@data-preference-prop-id",
    "price": ".component-single-property-price .regular-price, .component-single-property-price .new-price, #newprice",
    "text": ".component-single-property-description",
    "switches": "*[onclick*=ch_currency]@onclick",
    "labels": "*.component-single-property-labels, .property-label, .label-reserved",
    "gallery": "*.component-single-property-head-gallery img[src], .component-single-property-content-gallery img[src], .property-gallery img[src]@src",
},
       [(".characteristic", ".label", ".value")], kinds=("product", "offer", "realestatelisting", "singlefamilyresidence"), any_kind=False)


def centrarium() -> dict[str, Column]:
    ident = F.coalesce(urls.listing_id(F.col("url"), "centrarium"), found(f("body"), r"(?i)object\s*(?:id|№|number)\s*:?\s*([0-9]+)"))
    living, plot = numbers.first_token(fact_like(r"(?:total )?area$|living area|house area")), numbers.first_token(fact_like(r"plot|land|parcel"))
    phrase = numbers.first_token(found(
        body(),
        rf"(?i)(?:on\s+a\s+plot\s+of|the\s+plot(?:\s+of\s+land)?\s+is|plot\s+is|plot\s+of\s+land(?:\s+for\b.{{0,80}})?\s+(?:with\s+an\s+)?area\s+of|land\s+plot\s+of|plot\s+of(?:\s+land)?(?:\s+of)?)\s*{AMOUNT}\s*{SQUARE_METRES}",
    ))
    lat, lon = coordinates(r'"addr_lat"\s*:\s*(-?[0-9.]+)\s*,\s*"addr_lon"\s*:\s*(-?[0-9.]+)', r"mlat=(-?[0-9.]+)[^\n]*?mlon=(-?[0-9.]+)")
    price = F.coalesce(
        F.when(money.code(ld("offers.priceCurrency")) == "EUR", numbers.rounded(ld("offers.price"))),
        money.money(f("price"), "centrarium")["amount"],
    )
    rooms = numbers.first_token(fact_like(r"^(?:number of )?rooms?$|\brooms\b"))
    return {
        "external_id": ident,
        "type": F.coalesce(F.initcap(found(f("h1"), r"(?i)\b(House|Villa|Cottage|Townhouse|Town house|Chalet|Maisonette)\b")), F.lit("House")),
        "price": price,
        "currency": F.lit("EUR"),
        "living_m2": living,
        "land_m2": cleaning.land_unless_echoed(living, F.coalesce(plot, phrase)),
        "rooms": rooms,
        "bedrooms": F.coalesce(numbers.first_token(fact_like("bedroom")), rooms),
        "baths": numbers.first_token(fact_like("bath")),
        "lat": lat,
        "lon": lon,
        "reference": ident,
    }


Detail("centrarium", centrarium, {
    "price": ".vw-price, .vw-header-price, [class*=price]",
}, [(".vw-dynprops-item", ".vw-dynprops-item-attr", ".vw-dynprops-item-val")], kinds=("product", "offer", "residence"))


def abruzzoruralproperty() -> dict[str, Column]:
    summaries = F.array_join(F.filter(F.split(F.coalesce(f("metas"), F.lit("")), "\n"), lambda t: ~F.contains(t, F.lit("Abruzzo Rural Property"))), " ")
    # What belongs to this listing: neither navigation nor the cards of others.
    written = F.concat_ws(" ", summaries, f("described"), f("row"), f("details"))
    spoken = numbers.european(found(numbers.spaced(written), rf"(?i)Total\s+(?:cadastral\s+space|liveable\s+surface):\s*([0-9][0-9.,]*)\s*{SQUARE_METRES}"))
    plot = numbers.european(found(
        numbers.spaced(written),
        rf"(?i)([0-9][0-9.,]*)\s*{SQUARE_METRES}\s+(?:of\s+)?(?:[\w'-]+\s+){{0,4}}(?:land|garden|grounds?)\b",
    ))
    land = F.when(~matched(fact("total land"), r"(?i)\bno land\b"), F.coalesce(numbers.european(fact("total land")), plot, numbers.hectares(written)))
    return {
        "external_id": urls.listing_id(F.col("url"), "abruzzoruralproperty"),
        "type": fact("property type", "category"),
        "place": fact("city"),
        "price": F.coalesce(money.money(fact("price"), "abruzzoruralproperty")["amount"], money.money(f("price"), "abruzzoruralproperty")["amount"]),
        "currency": F.lit("EUR"),
        "living_m2": F.coalesce(numbers.european(fact("total cadastral space", "cadastral space", "cadastral area", "total liveable surface")), spoken),
        "land_m2": land,
        "bedrooms": F.coalesce(numbers.european(fact("bedrooms")), numbers.bedroom_words(written)),
        "reference": fact("reference number"),
        "energy_label": F.upper(found(fact("energy class", "energy rating", "energy efficiency"), r"(?i)^\s*([A-G])\b")),
        "description": f("text"),
    }


Detail("abruzzoruralproperty", abruzzoruralproperty, {
    "metas": "*meta[name=description], meta[property=og:description]@content",
    "described": "[itemprop=description]",
    "row": "article.fw-property-detail-row",
    "details": ".fw-property-details",
    "text": ".fw-property-description, [itemprop=description], .fw-description",
    "price": "span.price, .fw-price, [itemprop=price]",
},
       [(".fw-property-detail-row", ".text-bold", "[itemprop=value]"), (".fw-property-detail-row-odd", ".text-bold", "[itemprop=value]")])


def abruzzopropertyitaly() -> dict[str, Column]:
    icons = F.coalesce(f("icons"), F.lit(""))
    sizes = F.regexp_extract_all(icons, F.lit(r"(?i)([0-9][0-9.,]*)\s*SQM"))
    size = lambda i: numbers.decimal_area(F.concat(F.try_element_at(sizes, F.lit(i)), F.lit(" sqm")), zero_is_null=True)
    ident = F.coalesce(
        urls.listing_id(F.col("url"), "abruzzopropertyitaly"),
        urls.listing_id(f("address"), "abruzzopropertyitaly"),
        found(F.coalesce(f("address"), f("body")), r"(?i)Ref:\s*([0-9]+)"),
    )
    place = F.split(F.coalesce(f("place"), f("h1")), r"\s*,\s*")
    kind = in_lines(icons, r"^\s*([A-Za-z][A-Za-z -]+)(?:\n|$)")
    lat, lon = coordinates(r"google\.maps\.LatLng\(\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*\)")
    land_only = F.lower(kind) == "land"
    return {
        "external_id": ident,
        "type": kind,
        "place": F.try_element_at(place, F.lit(1)),
        "region": F.try_element_at(place, F.lit(2)),
        "dept_nl": F.try_element_at(place, F.lit(3)),
        "price": money.money(f("address"), "abruzzopropertyitaly")["amount"],
        "currency": F.lit("EUR"),
        "bedrooms": numbers.digits(found(icons, r"(?i)([0-9]+)\s*bedroom")),
        "baths": numbers.digits(found(icons, r"(?i)([0-9]+)\s*bathroom")),
        "living_m2": F.when(land_only & (F.size(sizes) < 2), None).otherwise(size(1)),
        "land_m2": F.when(land_only & (F.size(sizes) < 2), size(1)).otherwise(size(2)),
        "lat": lat,
        "lon": lon,
        "pcm_label": matched(f("address"), r"\bPCM\b"),
        "description": f("text"),
        "features": f("features"),
        "reference": ident,
    }


Detail("abruzzopropertyitaly", abruzzopropertyitaly, {
    "address": ".details-address1",
    "place": "h1.detail-price",
    "icons": "*.details-icons > div",
    "text": ".details-description",
    "features": ".details-features",
})


def domaza() -> dict[str, Column]:
    bits = F.split(f("h1"), r"\s*,\s*")
    stated = stated_at(F.coalesce(fact("price"), f("price"), f("price2"), f("meta_price")), "domaza")
    described = F.coalesce(f("text"), body())
    deal = F.lower(F.concat_ws(" ", f("labels"), f("hidden_title")))
    return {
        "_stated": stated,
        "external_id": F.coalesce(urls.listing_id(F.col("url"), "domaza"), found(body(), r"(?i)\bID\s+([0-9]+)\b")),
        "type": F.coalesce(f("kind"), F.try_element_at(bits, F.lit(1))),
        "place": F.try_element_at(bits, F.lit(2)),
        "region": F.try_element_at(bits, F.lit(3)),
        "country": F.try_element_at(bits, F.lit(4)),
        "price": F.coalesce(*(money.euros(v, F.lit(c), "domaza") for c, v in stated.items())),
        "currency": F.lit("EUR"),
        "living_m2": F.coalesce(
            numbers.area(fact_like("floor area|total area|living area|^area"), unit=r"(?:m2|m²|m\s*2|sq\.?\s*m|sqm)\b"),
            numbers.area(f("hidden_area")),
        ),
        "land_m2": F.coalesce(
            numbers.area(fact_like("plot|land|yard"), unit=r"(?:m2|m²|m\s*2)"),
            numbers.digits(found(
                numbers.spaced(described),
                rf"(?i)(?:building plot|plot|yard|land)\s+(?:of\s+|around the house is\s+)?{AMOUNT}\s*(?:m2|m²)",
            )),
        ),
        "deal": F.when(deal.rlike(r"\brent\b"), "rent").when(deal.rlike(r"\bsale\b"), "sale"),
        "description": f("text"),
    }


Detail("domaza", domaza, {
    "kind": ".property_title",
    "price": ".prop_price",
    "price2": ".property_price",
    "meta_price": "meta[itemprop=price]@content",
    "labels": ".property_labels",
    "hidden_title": ".title_hidden_data",
    "hidden_area": ".area_hidden_data",
    "text": ".property_description, [itemprop=description]",
},
       [(".property_important_data .data_row", ".single_data_label", ".single_data_value")])


def holprop() -> dict[str, Column]:
    blob = kept(F.concat_ws(" ", f("facts_text"), f("address"), body()))
    labels = r"(?=\s*(?:Type|Bedrooms?|Bathrooms?|Floor area|Land area|Size|Plot|Date Built|City|Region|Country|Area|Postcode|Address)\s*:|$)"
    of = lambda label: found(blob, rf"(?i)\b(?:{label})\s*:\s*(.*?){labels}")
    stated = stated_at(F.concat_ws(" ", f("price"), f("gray"), f("facts_text")), "holprop")
    marked = F.when(F.upper(F.coalesce(f("currency"), F.lit("EUR"))) == "EUR", numbers.digits(f("meta_price")))
    ident = urls.listing_id(F.col("url"), "holprop")
    return {
        "_stated": stated,
        "external_id": ident,
        "type": of("Type"),
        "place": F.coalesce(f("place"), of("City")),
        "region": F.coalesce(f("region"), of("Region")),
        "price": F.coalesce(marked, stated["EUR"]),
        "currency": F.lit("EUR"),
        "price_gbp": stated["GBP"],
        "price_usd": stated["USD"],
        "bedrooms": numbers.digits(of("Bedrooms?")),
        "baths": numbers.digits(of("Bathrooms?")),
        "living_m2": numbers.area(of("Floor area|Size")),
        "land_m2": numbers.area(of("Land area|Plot")),
        "reference": F.upper(ident),
        "description": F.coalesce(f("text"), f("h1")),
    }


Detail("holprop", holprop, {
    "facts_text": ".lefdetails",
    "address": "span.address",
    "place": "[itemprop=addressLocality]",
    "region": "[itemprop=addressRegion]",
    "meta_price": "[itemprop=price]@content",
    "currency": "[itemprop=priceCurrency]@content",
    "price": ".advert-price",
    "gray": ".txt_gray_price",
    "text": "[itemprop=description]",
})


# What a headline calls a dwelling, and what it calls anything else.
DWELLING = r"(?i)([0-9][0-9\s.,]*)\s*(?:sq\.?\s*m\.?|sqm|m2|m²)\s+(?:[a-z-]+\s+){0,2}(?:living|house|home|villa|bungalow|cottage|apartment|property)\b"
NO_DWELLING = r"(?i)\b(?:barn|plot|land|forest|garage|shed|outbuilding|annex|ruins?|stable|orchard|meadow|yard)\b"


def dwelling_area(headline: Column) -> Column:
    """The first area in a comma-separated headline that its clause gives to a dwelling and to nothing else."""
    clauses = F.filter(F.split(headline, "[,;]"), lambda c: ~c.rlike(NO_DWELLING) & c.rlike(DWELLING))
    return numbers.digits(found(F.try_element_at(clauses, F.lit(1)), DWELLING))


def ok_bulgaria() -> dict[str, Column]:
    facts = kept(numbers.spaced(F.coalesce(f("facts_text"), body())))
    kind = found(facts, r"(?i)Type:\s*(.*?)\s*(?=Land:|Village:|Province|Price|ID:|$)")
    headline = F.concat_ws(", ", f("h3"), f("title"))
    is_land = matched(kind, r"(?i)^(?:land|regulated|plot|agricultural)")
    euro, pound = kept(numbers.digits(found(facts, r"€\s*([0-9.,\s]+)"))), kept(numbers.digits(found(facts, r"£\s*([0-9.,\s]+)")))
    return {
        "_stated": stated_in(EUR=euro, GBP=pound),
        "external_id": found(F.col("url"), r"[?&]id=([^&#]+)"),
        "type": kind,
        "place": F.initcap(F.trim(found(facts, r"(?i)Village:\s*([^(\-]+)"))),
        "price": F.coalesce(euro, money.euros(pound, F.lit("GBP"), "ok_bulgaria")),
        "currency": F.lit("EUR"),
        "price_gbp": pound,
        "land_m2": numbers.area_or_number(found(facts, r"(?i)Land:\s*([0-9][0-9\s.,]*\s*(?:sq\.?\s*m\.?|sqm|m2|m²)?)")),
        "living_m2": F.when(~F.coalesce(is_land, F.lit(False)), dwelling_area(headline)),
        "bedrooms": whole(found(kind, r"^([0-9]+)\s+bedroom")),
        "reference": found(facts, r"(?i)ID:\s*(\S+)"),
        "description": f("text"),
        "photos": photo_list(f("gallery"), "https://www.cheap-bulgarian-house.co.uk"),
    }


Detail("ok_bulgaria", ok_bulgaria, {
    "facts_text": "table.buttons_details",
    "h3": "h3",
    "text": ".details_holder .p_text",
    "gallery": "*#galleria a[href]@href",
})


def lefigaro() -> dict[str, Column]:
    quantity = lambda *paths: F.coalesce(*(numbers.decimal_comma(F.coalesce(
        offered(f"{p}.value"),
        F.when(~F.startswith(offered(p), F.lit("{")), offered(p)),
    )) for p in paths))
    described = F.coalesce(offered("description"), f("text"))
    land = F.coalesce(
        quantity("landArea", "lotSize"),
        numbers.area(fact_like("^(?:terrain|surface (?:du )?terrain|parcelle|jardin)$"), numbers.decimal_comma, "(?:m²|m2)"),
        numbers.decimal_comma(found(
            numbers.spaced(described),
            rf"(?i)(?:terrain|parcelle|jardin)\s*(?:de|attenant(?:e)?\s+de)?\s*(?:plus\s+de\s*)?{AMOUNT}\s*(?:m²|m2)",
        )),
    )
    price = F.coalesce(
        numbers.rounded(ld("offers.price")),
        numbers.rounded(ld("offers[0].price")),
        numbers.rounded(ld("price")),
        money.money(f("h1"), "lefigaro")["amount"],
        money.money(f("price"), "lefigaro")["amount"],
        money.money(body(), "lefigaro")["amount"],
    )
    name = F.coalesce(offered("name"), f("h1"))
    first = F.try_element_at(literal_map(LEFIGARO_TYPES), F.lower(found(name, r"^(\S+)")))
    region = F.coalesce(
        offered("address.addressRegion"),
        F.when(~F.contains(F.col("url"), F.lit("annonce-")), urls.department(F.col("url"), "lefigaro")["name"]),
    )
    return {
        "_flags": flags("lefigaro", name, described),
        "external_id": F.coalesce(urls.listing_id(F.col("url"), "lefigaro"), urls.listing_id(ld("url"), "lefigaro")),
        "type": F.coalesce(first, kinds_of(ld("['itemOffered']['@type']")), kinds_of(ld("['@type']")), F.lit("Maison")),
        "place": offered("address.addressLocality"),
        "region": region,
        "dept_fr": region,
        "price": price,
        "currency": F.lit("EUR"),
        "living_m2": quantity("floorSize"),
        "land_m2": land,
        "rooms": numbers.decimal_comma(offered("numberOfRooms")),
        "bedrooms": numbers.decimal_comma(offered("numberOfBedrooms")),
        "baths": numbers.decimal_comma(F.coalesce(offered("numberOfBathroomsTotal"), offered("numberOfBathrooms"))),
        "energy_label": energy(),
        "gas_label": F.upper(found(body(), r"(?i)\bGES\s*[:\s]*([A-G])\b")),
        "energy_kwh": numbers.decimal_comma(found(body(), r"(?i)([0-9][0-9\s.,]*)\s*kWh")),
        "lat": clean_coordinate(ld("geo.latitude"), 90),
        "lon": clean_coordinate(ld("geo.longitude"), 180),
        "description": described,
    }


Detail("lefigaro", lefigaro, {
    "price": ".price, [class*=price]",
    "text": "[class*=description], article p",
}, [("li", "span", "strong"), ("tr", "th", "td")], kinds=("realestatelisting", "product", "house", "singlefamilyresidence", "residence", "offer"))


def greenacres() -> dict[str, Column]:
    size = lambda t: F.coalesce(numbers.area(t, numbers.dot_thousands, r"(?:m²|m2)"), numbers.dot_thousands(t))
    living = kept(F.coalesce(size(f("living")), size(f("living2"))))
    sizes = F.transform(F.filter(F.split(F.coalesce(f("labels"), F.lit("")), "\n"), lambda t: t.rlike(r"[0-9]\s*m[²2]")), size)
    land = F.coalesce(
        size(f("land")),
        F.try_element_at(F.filter(sizes, lambda x: x != living), F.lit(1)),
        numbers.dot_thousands(found(numbers.spaced(f("text")), r"(?i)([0-9.\s]+)\s*m[²2]\s*terrein")),
    )
    paid = kept(F.coalesce(money.money(f("euro"), "greenacres"), money.money(f("price"), "greenacres"), money.money(body(), "greenacres")))
    name, blob = F.coalesce(f("h1"), f("title")), F.concat_ws(" ", f("h1"), F.col("url"), f("text"))
    garage = matched(blob, r"(?i)\b(?:garage|box|parking|parkeerplaats)\b") & (F.coalesce(living, F.lit(0)) < 30)
    kind = F.when(F.contains(F.col("url"), F.lit("/appartement/")), "Appartement").when(F.contains(F.col("url"), F.lit("/huis/")), "Huis").when(
        F.contains(F.lower(name), F.lit("appartement")),
        "Appartement",
    ).when(
        garage,
        "Garage",
    ).otherwise("Huis")
    grade = F.upper(F.trim(f("grade")))
    return {
        "_flags": flags("greenacres", name, f("text")),
        "_stated": stated_by(paid["amount"], paid["currency"]),
        "external_id": F.coalesce(f("id"), urls.listing_id(F.col("url"), "greenacres")),
        "type": kind,
        "place": found(f("where"), r"^\s*([^()]+?)\s*\("),
        "region": found(f("where"), r"\(([^)]+)\)"),
        "price": money.euros(paid["amount"], paid["currency"], "greenacres"),
        "currency": F.lit("EUR"),
        "living_m2": living,
        "land_m2": land,
        "bedrooms": whole(found(f("labels"), r"(?i)([0-9]+)\s*slaapkamers?\b")),
        "baths": whole(found(f("labels"), r"(?i)([0-9]+)\s*badkamers?\b")),
        "energy_label": F.coalesce(F.when(grade.rlike("^[A-G]$"), grade), energy()),
        "energy_kwh": numbers.dot_thousands(found(body(), r"(?i)([0-9][0-9\s.,]*)\s*kWh")),
        "gas_co2": numbers.dot_thousands(found(body(), r"(?i)([0-9][0-9\s.,]*)\s*kg\s*CO")),
        "agent": f("agent"),
        "description": f("text"),
    }


Detail("greenacres", greenacres, {
    "id": "#AdvertId@value",
    "euro": ".advert-currency-price",
    "price": ".price-detail, .sticky-price",
    "where": ".announce-localisation, .location-text",
    "living": ".info-tag[title=Woonoppervlakte]",
    "living2": ".info-tag[title*=oppervlak]",
    "land": ".info-tag[title=Terrein], .info-tag[title=Grond]",
    "labels": "*.tag__label",
    "text": ".main-description, .description-text, .description",
    "grade": ".ValueTag__ValueTagGrade",
    "agent": ".company-name",
})


def scale(rows: str, kind: str) -> tuple[Column, Column]:
    """Letter and figure of an energy scale drawn as a table: those of the row that has a figure; none where the table is faded."""
    row, known = r"(?m)([A-G])\s+([0-9]+)\s*$", ~matched(f(kind), r"\bfaded\b")
    return F.when(known, found(f(rows), row)), F.when(known, found(f(rows), row, 2).try_cast("long"))


def franimo() -> dict[str, Column]:
    energy_label, energy_kwh = scale("energy", "energy_class")
    gas_label, gas_co2 = scale("gas", "gas_class")
    kind, land = kept(F.lower(fact("type"))), kept(numbers.leading_area(fact("terrein")))
    living = kept(cleaning.living_of_land(kind, kept(numbers.leading_area(fact("woning")))))
    rooms, beds = kept(numbers.digits(fact("kamers"))), kept(numbers.digits(fact("slaapkamers")))
    return {
        "external_id": F.coalesce(numbers.digits(fact("franimo nr")).cast("string"), found(F.col("url"), r"([0-9]{4,})")),
        "type": fact("type"),
        "place": fact("nabij"),
        "living_m2": cleaning.plausible_living(kind, living, rooms, beds, land),
        "land_m2": land,
        "rooms": rooms,
        "bedrooms": beds,
        "baths": numbers.digits(fact("badkamers")),
        "year_built": numbers.digits(fact("bouwjaar")),
        "price": numbers.digits(fact("prijs")),
        "currency": F.lit("EUR"),
        "reference": fact("referentie"),
        "agent": fact("makelaar"),
        "agent_name": fact("naam"),
        "agent_address": fact("adres"),
        "region": in_lines(f("crumbs"), r" regio ([^\n]+)"),
        "dept_fr": fact("departement"),
        "dept_nl": in_lines(f("crumbs"), r" departement ([^\n]+)"),
        "photos": photo_list(f("slides"), "https://www.franimo.nl", "^(?!.*thumb[^/]*$)"),
        "features": F.replace(f("feature_lines"), F.lit("\n"), F.lit(", ")),
        "energy_label": energy_label,
        "energy_kwh": energy_kwh,
        "gas_label": gas_label,
        "gas_co2": gas_co2,
        "description": f("text"),
    }


Detail("franimo", franimo, {
    "energy": "*.energy-emmission table.energy-table tr",
    "energy_class": ".energy-emmission table.energy-table@class",
    "gas": "*table.gas-emmission tr",
    "gas_class": "table.gas-emmission@class",
    "text": "[itemprop=description]",
    "crumbs": "*a",
    "feature_lines": "*[itemprop=description] ~ p until .property-information",
    "slides": "*.splide img[data-splide-lazy]@data-splide-lazy",
}, [(".property-information table tr", "th", "td"), (".property-vendor table tr", "th", "td")])


def akiyaportal() -> dict[str, Column]:
    currency = kept(money.code(F.coalesce(ld("priceCurrency"), F.lit("USD"))))
    paid = kept(F.coalesce(
        chosen(numbers.rounded(ld("price")), F.when(currency.isin("JPY", "YEN"), "JPY").when(currency == "USD", "USD")),
        money.money(F.concat_ws(" ", f("h1"), f("title")), "akiyaportal"),
    ))
    bedrooms = F.coalesce(*(numbers.layout_bedrooms(t) for t in (fact_like("layout"), fact_like("building area|floor"), f("h1"))))
    ident = F.coalesce(f("id"), urls.listing_id(F.col("url"), "akiyaportal"))
    return {
        "_stated": stated_by(paid["amount"], paid["currency"]),
        "photos": one_size(f("gallery"), r"/[0-9]+\.webp$", "https://akiyaportal.com"),
        "external_id": ident,
        "type": F.coalesce(fact("property type", "type"), F.lit("Used single-family home")),
        "region": F.coalesce(fact("prefecture"), ld("address.addressRegion")),
        "place": F.split_part(ld("address.addressLocality"), F.lit(","), F.lit(1)),
        "price": money.euros(paid["amount"], paid["currency"], "akiyaportal"),
        "currency": F.lit("EUR"),
        "living_m2": numbers.decimal_area(fact_like("building area|floor area|living")),
        "land_m2": numbers.decimal_area(fact_like("land")),
        "bedrooms": bedrooms,
        "year_built": numbers.year(fact_like("built|year")),
        "description": text.without_pitch(ld("description")),
        "reference": ident,
    }


Detail("akiyaportal", akiyaportal, {
    "id": "[data-listing-id]@data-listing-id",
    "gallery": "*a[href*=listing-images]@href until h2 with similar",
}, [("div.flex.justify-between", "span.label, span.text-gray-600, span", "span.font-medium, span.font-semibold")], kinds=("realestatelisting",), any_kind=False)


# What raw fields keep of a price and of a page's marks; a label of the page of such a name gives way.
OWN_NAMES = r"price_[a-z]+|fx_[a-z]+|maybe_rental|reserved|best_bargain|agricultural_land|household_plot"


def raw_facts(columns: dict[str, Column], first: Column | None, source: str) -> Column:
    """Every label and value of the page, where its price comes from, and its marks, as JSON.

    The page's labels and the rest are written apart and put together, so that nothing but labels goes through a map.
    """
    own = money.provenance_parts(columns["_stated"], first, source) if "_stated" in columns else {}
    own |= columns.get("_flags", {})
    if not own:
        return F.to_json("facts")
    clash = F.array_join(F.map_keys("facts"), "\n").rlike(OWN_NAMES)
    plain = F.to_json(F.when(clash, F.map_filter("facts", lambda k, v: ~k.rlike(f"^({OWN_NAMES})$"))).otherwise(F.col("facts")))
    more = F.to_json(F.struct(*(v.alias(k) for k, v in own.items())), {"ignoreNullFields": "true"})
    return F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.when((plain != "{}") & (more != "{}"), ",").otherwise(""), F.substring(more, 2, 1 << 30))


def detail_rows(pages: DataFrame, source: str) -> DataFrame:
    """One row for each detail page (url, html): url, source, the portal's columns, raw_fields with every label and value as JSON."""
    detail = DETAILS[source]
    pages = unwrapped(pages) if source == "greenacres" else pages
    STEPS.clear(), ASKED.clear()
    columns = detail.columns()
    first = kept(money.first_stated(columns["_stated"])) if "_stated" in columns else None
    rows = extracted(pages, None, {k: v for k, v in (COMMON | detail.fields).items() if k in ASKED}, pairs=detail.pairs)
    if "ld" in ASKED:
        rows = rows.withColumn("node", ld_block(detail.kinds, detail.any_kind))
    for name, value in STEPS:
        rows = rows.withColumn(name, value)
    named = [c.alias(n) for n, c in columns.items() if n not in ("_stated", "_flags")]
    return rows.select("url", F.lit(source).alias("source"), *named, raw_facts(columns, first, source).alias("raw_fields"))
