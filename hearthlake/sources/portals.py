"""The portals: where each keeps its cards, and what its texts mean.

Selectors say where a text stands; columns say what it is. `list_rows` gives the listings of result
pages, `list_pages` one row a page with its total, number of pages and next address.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthlake.functions import money, numbers, text, urls
from hearthlake.functions.cleaning import plot_as_land
from hearthlake.functions.geo import literal_map, not_at_zero
from hearthlake.functions.numbers import found, matched
from hearthlake.sources.html import extracted

PORTALS: dict[str, Portal] = {}


@dataclass(frozen=True)
class Portal:
    name: str
    base: str
    per_page: int
    card: str
    fields: dict[str, str]
    columns: Callable[[], dict[str, Column]]
    page: dict[str, str] = field(default_factory=dict)
    total: Callable[[], Column] = lambda: F.lit(None).cast("long")
    pages: Callable[[], Column] = lambda: F.lit(1).cast("long")
    keep: Callable[[], Column] = lambda: F.lit(True)
    #: Rows that the page states apart from its cards, over extracted pages; they count before the cards.
    stated: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        PORTALS[self.name] = self


def f(name: str) -> Column:
    return F.col("f")[name]


def p(name: str) -> Column:
    return F.col("p")[name]


def whole(value: Column) -> Column:
    return value.try_cast("long")


def paid(source: str, blob: Column) -> dict[str, Column]:
    stored = money.priced(money.money(blob, source), source)
    return {"price": stored["price"], "currency": F.coalesce(stored["currency"], F.lit("EUR"))}


def here(path: Column, base: str) -> Column:
    """An address on the page as a whole one."""
    return F.when(path.rlike("(?i)^https?://"), path).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(path, "^/+", "")))


def in_lines(lines: Column, pattern: str, group: int = 1) -> Column:
    return found(lines, pattern, group)


def most(lines: Column, pattern: str) -> Column:
    """The largest number among all matches in a text."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(lines, F.lit("")), F.lit(pattern)), lambda x: x.try_cast("long")))


def comma_part(address: Column, i: int) -> Column:
    parts = F.filter(F.transform(F.split(address, ","), lambda x: text.node_text(x)), lambda x: x.isNotNull())
    return F.try_element_at(parts, F.lit(i))


def pages_of(total: Column, per_page: int, *others: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / per_page), *others).cast("long")


def one_more(last: Column, per_page: int) -> Column:
    """A full page without a pager has at least one page after it."""
    return F.when((F.coalesce(last, F.lit(1)) <= 1) & (F.col("n") >= per_page), F.lit(2)).otherwise(F.coalesce(last, F.lit(1))).cast("long")


# ---- franimo -------------------------------------------------------------------------------------
def franimo_columns() -> dict[str, Column]:
    name, title = f("name"), f("title")
    named = F.contains(name, F.lit(" te koop "))
    return {
        "external_id": f("id"),
        "url": here(f("link"), "https://www.franimo.nl"),
        "lat": f("lat").try_cast("double"),
        "lon": f("lon").try_cast("double"),
        "price": F.coalesce(numbers.digits(f("price_content")), numbers.digits(f("price"))),
        "currency": F.lit("EUR"),
        "old_price": numbers.digits(f("old_price")),
        "type": F.when(named, F.split_part(name, F.lit(" te koop "), F.lit(1))).otherwise(found(title, r"^(\S+)")),
        "place": F.when(named, found(name, r"^.*? te koop (.*)$")).otherwise(found(title, r"^\S+ (.*)$")),
        "dept_nl": text.blank_as_null(F.regexp_replace(f("dept"), r"^[()]+|[()]+$", "")),
        "bedrooms": numbers.digits(f("beds")),
        "baths": numbers.digits(f("baths")),
        "thumb": f("thumb"),
        "snippet": f("snippet"),
        "promoted": matched(f("class"), r"\btop-property\b"),
    }


Portal(
    "franimo", "https://www.franimo.nl", 14, "div.box1[data-id]",
    {
        "id": "@data-id",
        "class": "@class",
        "lat": "@data-latitude",
        "lon": "@data-longitude",
        "link": "a[itemprop=url][href]@href",
        "price_content": "[itemprop=price]@content",
        "price": "[itemprop=price]",
        "old_price": ".old-price",
        "name": "meta[itemprop=name]@content",
        "title": "h2",
        "dept": "h3",
        "beds": ".beds",
        "baths": ".baths",
        "thumb": ".image@data-src",
        "snippet": "[itemprop=description]",
    },
    franimo_columns, page={"current": ".current-page", "total": ".total-amount", "title": "title", "next": "ul.paging li.next a[href]@href"},
    total=lambda: F.coalesce(numbers.digits(p("total")), numbers.digits(found(p("title"), r"(?i)gevonden:?\s*([0-9.\s]+)"))),
    pages=lambda: F.coalesce(whole(found(p("current"), r"van\s+([0-9]+)")), F.lit(1)),
)


# ---- ok_bulgaria ---------------------------------------------------------------------------------
# Kinds of property by the slug of a card's link, and by the number in its address.
OK_BULGARIA_SLUGS = {
    "one_bedroom": "1 bedroom",
    "two_bedrooms": "2 bedrooms",
    "three_bedrooms": "3 bedrooms",
    "four_bedrooms": "4 bedrooms",
    "five_bedrooms": "5 bedrooms",
    "land_agrucultural": "land - agricultural",
    "land_agricultural": "land - agricultural",
    "land_for_building": "land for building",
    "commerce": "commerce",
    "hotel": "hotel",
    "renovation": "renovation",
}
OK_BULGARIA_NUMBERS = {"11": "2 bedrooms", "12": "3 bedrooms", "14": "commerce", "16": "land for building", "17": "land - agricultural"}


def ok_bulgaria_kind() -> Column:
    """By the slug of the card's first link, words for underscores where it is unknown; else by the number in its address."""
    slug = F.lower(found(f("kind_link"), r"(?i)^([a-z0-9_]+)_id[0-9]+"))
    by_slug = F.coalesce(F.try_element_at(literal_map(OK_BULGARIA_SLUGS), slug), F.replace(slug, F.lit("_"), F.lit(" ")))
    return F.when(slug.isNotNull(), by_slug).otherwise(F.try_element_at(literal_map(OK_BULGARIA_NUMBERS), found(f("link"), r"[?&]tid=([0-9]+)")))


def ok_bulgaria_columns() -> dict[str, Column]:
    ident = found(f("link"), r"[?&]id=([^&#]+)")
    stated = money.best_priced(
        F.map_from_entries(F.filter(
            F.array(*(F.struct(
                F.lit(c).alias("key"),
                numbers.digits(found(numbers.spaced(f("prices")), rf"{s}\s*([0-9.,\s]+)")).alias("value"),
            ) for c, s in (("EUR", "€"), ("GBP", "£")))),
            lambda e: e["value"].isNotNull(),
        )),
        "ok_bulgaria",
        ("EUR", "GBP"),
    )
    return {
        "external_id": ident,
        "url": F.concat(F.lit("https://www.cheap-bulgarian-house.co.uk/houses_in_bulgaria_for_sale.php?id="), ident),
        "type": ok_bulgaria_kind(),
        "price": stated["price"],
        "currency": F.lit("EUR"),
        "land_m2": numbers.area_or_number(found(f("labelled"), r"(?i)Land:?\s*([^\n]+)")),
        "reference": found(f("prices"), r"(?i)ID#\s*(\S+)"),
        "snippet": f("snippet"),
        "thumb": f("thumb"),
        "promoted": matched(f("all"), r"(?:^|\s)NEW(?:\s|$)"),
    }


Portal(
    "ok_bulgaria", "https://www.cheap-bulgarian-house.co.uk", 20, "table.table_prop_item",
    {
        "link": "a[href*=houses_in_bulgaria_for_sale.php]@href",
        "kind_link": ".prop_item a[href]@href",
        "prices": "*.prop_price, .prop_price1",
        "labelled": "*.prop_lbl, .prop_txt",
        "snippet": "span.prop_txt",
        "thumb": "a.thumbnail span img[src]@src",
        "all": "",
    },
    ok_bulgaria_columns, page={"last": ".pagination input[data-max-page]@data-max-page", "title": "title"},
    total=lambda: numbers.digits(found(
        p("title"),
        r"(?i)([0-9][0-9\s,]*)\s+Bulgarian Properties\b",
    )), pages=lambda: F.greatest(F.lit(1), F.coalesce(whole(p("last")), F.lit(1))),
    keep=lambda: f("link").isNotNull(),
)


# ---- akiyaportal ---------------------------------------------------------------------------------
def akiyaportal_columns() -> dict[str, Column]:
    slug, pills = found(f("link"), r"/listings/([A-Za-z0-9][A-Za-z0-9_-]+)"), f("pills")
    title = F.coalesce(f("title"), F.replace(slug, F.lit("-"), F.lit(" ")))
    return {
        "external_id": F.coalesce(f("id"), slug), "url": F.concat(
            F.lit("https://akiyaportal.com/listings/"),
            slug,
        ), "type": F.lit("Used single-family home"), "region": f("prefecture"), "dept_nl": f("prefecture"),
        **paid("akiyaportal", F.concat_ws(" ", F.coalesce(f("price"), f("price2"), f("all")), title)),
        "bedrooms": numbers.layout_bedrooms(pills), "living_m2": numbers.decimal_area(pills), "year_built": numbers.year(F.regexp_replace(
            pills,
            r"[^\n]*m²[^\n]*",
            "",
        )), "reference": F.coalesce(f("id"), slug),
        "thumb": here(f("thumb"), "https://akiyaportal.com"), "snippet": title, "place": found(
            title,
            r"\b([A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){0,3}\s+(?:City|Town|Village|Ward|District))\b",
        ),
        "promoted": matched(f("all"), r"(?:^|\s)New(?:\s|$)"),
    }


Portal(
    "akiyaportal", "https://akiyaportal.com", 24, "#listings > div, a.group[href]",
    {
        "link": "a[href*=/listings/]@href",
        "id": "[data-listing-id]@data-listing-id",
        "title": "h3",
        "price": "p.text-xl",
        "price2": "p.text-lg",
        "pills": "*span.rounded-full",
        "prefecture": "span.rounded-full[class*=amber]",
        "thumb": "img[src]@src",
        "all": "",
    },
    akiyaportal_columns, page={
        "total": "[data-analytics-results-count]@data-analytics-results-count",
        "body": "body",
        "hrefs": "*nav[aria-label=Pagination] a[href]@href",
    },
    total=lambda: F.coalesce(whole(p("total")), numbers.digits(found(p("body"), r"(?i)([0-9,]+)\s+Properties Found"))),
    pages=lambda: one_more(
        F.greatest(most(p("hrefs"), r"page=([0-9]+)"), F.ceil(numbers.digits(found(p("body"), r"(?i)([0-9,]+)\s+Properties Found")) / 24)),
        24,
    ),
    keep=lambda: f("link").isNotNull(),
)


# ---- holprop -------------------------------------------------------------------------------------
def holprop_columns() -> dict[str, Column]:
    ld = lambda path: F.get_json_object(f("ld"), path)
    ident = urls.listing_id(F.coalesce(f("link"), ld("$.url")), "holprop")
    kinds = F.filter(F.coalesce(F.from_json(ld("$['@type']"), "array<string>"), F.array(ld("$['@type']"))), lambda t: t.isNotNull() & (t != "Offer"))
    euros = F.when(F.upper(F.coalesce(ld("$.priceCurrency"), F.lit("EUR"))) == "EUR", numbers.rounded(ld("$.price")))
    price = F.coalesce(euros, money.amounts(F.coalesce(f("price"), f("all")), "holprop")["EUR"])
    beds = F.coalesce(whole(ld("$.numberOfRooms")), numbers.digits(f("beds")))
    region = F.coalesce(ld("$.address.addressRegion"), f("region"))
    return {
        "external_id": ident,
        "url": F.concat(F.lit("https://www.holprop.com/s/sale/"), F.lower(ident), F.lit("/?ctype=EUR")),
        "type": F.coalesce(
            F.try_element_at(kinds, F.lit(1)),
            found(ld("$.category"), r"^(.*?)(?: in |$)"),
            text.node_text(F.split_part(f("line"), F.lit("•"), F.lit(1))),
        ),
        "place": F.coalesce(ld("$.address.addressLocality"), f("place")),
        "region": region,
        "dept_nl": region,
        "lat": f("lat").try_cast("double"),
        "lon": f("lon").try_cast("double"),
        "price": price,
        "currency": F.lit("EUR"),
        "bedrooms": beds,
        "living_m2": F.coalesce(numbers.digits(ld("$.floorSize.value")), numbers.area(f("line"))),
        "reference": F.upper(ident),
        "thumb": here(F.coalesce(ld("$.image"), f("thumb")), "https://www.holprop.com"),
        "snippet": F.coalesce(ld("$.name"), f("title")),
        "promoted": F.lit(False),
    }


Portal(
    "holprop", "https://www.holprop.com", 39, ".searchrestable",
    {
        "link": "a[href*=/s/sale/]@href",
        "ld": "script[type=application/ld+json]",
        "price": ".pricefield",
        "beds": ".searchbeds b",
        "line": ".searchbeds",
        "place": "[itemprop=addressLocality]",
        "region": "[itemprop=addressRegion]",
        "lat": "[itemprop=latitude]@content",
        "lon": "[itemprop=longitude]@content",
        "thumb": "img[src]@src",
        "title": ".prop_title",
        "all": "",
    },
    holprop_columns, page={"heading": "h2.stitle", "hrefs": "*a[href]@href", "body": "body"},
    total=lambda: numbers.digits(found(p("heading"), r"(?i)Found\s+([0-9,]+)\b")),
    pages=lambda: one_more(
        F.greatest(
            most(p("hrefs"), r"/page/([0-9]+)/?"),
            F.ceil(numbers.digits(found(F.coalesce(p("heading"), p("body")), r"(?i)Found\s+([0-9,]+)\b")) / 39),
        ),
        39,
    ),
)


# ---- abruzzopropertyitaly ------------------------------------------------------------------------
# Words of a description and the kind they stand for, in the order in which they count.
ABRUZZO_TYPES = [
    ("country house", "country house"), ("farmhouse", "farmhouse"), ("townhouse", "townhouse"), ("semi detached", "semi detached"), ("bed & breakfast", "bed & breakfast"), ("agriturismo", "agriturismo"),
    ("studio apartment", "studio"), ("studio", "studio"), ("apartment", "apartment"), ("restoration", "restoration"), ("villa", "villa"), ("ruins", "ruins"), ("ruin", "ruins"), ("borgo", "borgo"),
    ("hotel", "hotel"), ("restaurant", "restaurant"), ("land", "land"), ("farm", "farm"), ("house", "house"),
]
ICONS = r"(?i)(Studio|[0-9]+)\s*x\s+([0-9]+)\s*x\s+([0-9]+)\s*x\s+([0-9.]+)\s*SQM\s+([0-9.]+)\s*SQM"


def abruzzopropertyitaly_columns() -> dict[str, Column]:
    ident = urls.listing_id(f("link"), "abruzzopropertyitaly")
    bare = F.regexp_replace(f("address"), r"(?i)\s+For sale\s*$", "")
    address = F.regexp_replace(bare, r",?\s*[A-Z]{2}[0-9]{5}$", "")
    kind = F.coalesce(text.first_match(f("snippet"), ABRUZZO_TYPES), text.first_match(f("icons"), ABRUZZO_TYPES))
    size = lambda g: numbers.decimal_area(F.concat(found(f("icons"), ICONS, g), F.lit(" SQM")), zero_is_null=True)
    price = money.money(f("price"), "abruzzopropertyitaly")["amount"]
    return {
        "external_id": ident,
        "url": F.concat(F.lit("https://www.abruzzopropertyitaly.com/property-search~action=detail,pid="), ident),
        "type": F.when(F.lower(f("beds")) == "studio", "studio").otherwise(kind),
        "place": comma_part(address, 1),
        "region": comma_part(address, 2),
        "dept_nl": comma_part(address, 3),
        "price": F.coalesce(price, money.money(f("all"), "abruzzopropertyitaly")["amount"]),
        "currency": F.lit("EUR"),
        "bedrooms": F.coalesce(numbers.digits(f("beds")), whole(found(f("icons"), ICONS, 1))),
        "baths": whole(found(f("icons"), ICONS, 2)),
        "living_m2": size(4),
        "land_m2": size(5),
        "reference": F.coalesce(found(f("price"), r"(?i)Ref:\s*([0-9]+)"), ident),
        "thumb": here(f("thumb"), "https://www.abruzzopropertyitaly.com"),
        "snippet": f("snippet"),
        "promoted": F.lit(False),
    }


Portal(
    "abruzzopropertyitaly", "https://www.abruzzopropertyitaly.com", 50, ".results-list-wrap",
    {
        "link": "a[href*=pid=]@href",
        "price": ".results-list-price",
        "address": ".results-list-address",
        "beds": ".bednumber",
        "icons": ".results-list-icons",
        "snippet": ".results-list-description",
        "thumb": "img[src]@src",
        "all": "",
    },
    abruzzopropertyitaly_columns, page={"count": ".results-count", "body": "body", "hrefs": "*a[href]@href"},
    total=lambda: numbers.digits(found(p("count"), r"(?i)Search results:\s*([0-9,]+)\s+propert")),
    pages=lambda: one_more(
        F.greatest(
            most(p("hrefs"), r"(?:^|[~,\n])[^\n]*?[~,]page=([0-9]+)") + 1,
            F.ceil(numbers.digits(found(F.coalesce(p("count"), p("body")), r"(?i)Search results:\s*([0-9,]+)\s+propert")) / 50),
        ),
        50,
    ),
)


# ---- abruzzoruralproperty ------------------------------------------------------------------------
def abruzzoruralproperty_columns() -> dict[str, Column]:
    ident = urls.listing_id(f("links"), "abruzzoruralproperty")
    described = text.node_text(F.regexp_replace(f("snippet"), r"(?i)^property short description[^:]*:", ""))
    blob = F.concat_ws(" ", f("title"), described)
    land = numbers.european(found(
        numbers.spaced(blob),
        rf"(?i)([0-9][0-9.,]*)\s*{numbers.SQUARE_METRES}\s+(?:of\s+)?(?:[\w'-]+\s+){{0,4}}(?:land|garden|grounds?)\b",
    ))
    return {
        "external_id": ident,
        "url": here(in_lines(f("links"), r"(?i)(/find-a-property/for-sale/item/[0-9]+-[^/?#\n]+)"), "https://www.abruzzoruralproperty.com"),
        "type": in_lines(f("labelled"), r"(?i)property type\s*:?\s*([^\n]+)"),
        "place": in_lines(f("labelled"), r"(?i)city\s*:?\s*([^\n]+)"),
        "price": F.coalesce(money.money(f("price"), "abruzzoruralproperty")["amount"], money.money(f("all"), "abruzzoruralproperty")["amount"]),
        "currency": F.lit("EUR"),
        "bedrooms": numbers.bedroom_words(blob),
        "land_m2": F.coalesce(land, numbers.hectares(blob)),
        "reference": F.coalesce(in_lines(f("labelled"), r"(?i)reference number\s*:?\s*([^\n]+)"), ident),
        "thumb": here(f("thumb"), "https://www.abruzzoruralproperty.com"),
        "snippet": F.coalesce(described, f("title")),
        "promoted": F.lit(False),
    }


Portal(
    "abruzzoruralproperty", "https://www.abruzzoruralproperty.com", 6, ".fw-list-property",
    {
        "links": "*a[href]@href",
        "title": "h2, .fw-list-propery-line, .contentheading",
        "price": "span.bold",
        "labelled": "*.property-id, .category, .type",
        "snippet": ".description",
        "thumb": ".fw-list-propery-image img[src]@src",
        "all": "",
    },
    abruzzoruralproperty_columns, page={"hrefs": "*a[href*=start=]@href"},
    pages=lambda: F.greatest(
        F.lit(1),
        F.floor(F.coalesce(most(p("hrefs"), r"(?:[?&]|/)start=([0-9]+)"), F.lit(0)) / 6) + 1,
        F.when(F.col("n") >= 6, F.coalesce(whole(found(F.col("url"), r"[?&/]start=([0-9]+)")) / 6, F.lit(0)) + 2),
    ).cast("long"),
)


# Countries that an address may end with.
BALKAN_COUNTRIES = ["montenegro", "serbia", "albania", "croatia", "bosnia", "bosnia and herzegovina", "north macedonia", "macedonia", "kosovo", "slovenia"]


# ---- centrarium ----------------------------------------------------------------------------------
def centrarium_columns() -> dict[str, Column]:
    linked = urls.listing_id(f("link"), "centrarium")
    ident = F.coalesce(linked, f("id"))
    param = lambda label: numbers.first_token(in_lines(f("params"), rf"(?i){label}[^\n]*?=([^\n]+)"))
    parts = text.latin_parts(f("address"), BALKAN_COUNTRIES)
    named, rest = F.filter(parts, lambda x: x.rlike("(?i)region")), F.filter(parts, lambda x: ~x.rlike("(?i)region"))
    place = F.when(F.size(named) > 0, F.try_element_at(rest, F.lit(1))).otherwise(F.try_element_at(rest, F.lit(-1)))
    region = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(rest, F.lit(1)))
    price = F.coalesce(money.money(f("price"), "centrarium")["amount"], money.money(f("price_box"), "centrarium")["amount"])
    kind = F.initcap(found(f("title"), r"(?i)\b(House|Villa|Cottage|Townhouse|Town house|Chalet|Maisonette)\b"))
    return {
        "external_id": ident,
        "url": F.when(linked.isNotNull(), here(f("link"), "https://centrarium.com")),
        "type": F.coalesce(kind, F.lit("House")),
        "place": place,
        "region": region,
        "dept_nl": region,
        "price": price,
        "currency": F.lit("EUR"),
        "bedrooms": F.coalesce(param("bedroom"), param("room")),
        "rooms": param(r"\brooms"),
        "baths": param("bath"),
        "living_m2": param("area"),
        "reference": ident,
        "thumb": here(f("thumb"), "https://centrarium.com"),
        "snippet": f("title"),
        "agent_name": f("owner"),
        "promoted": F.lit(False),
    }


Portal(
    "centrarium", "https://centrarium.com", 36, "div.j-item.g-item",
    {
        "id": "@data-id",
        "link": "a.g-item-title[href], a.c-item-img-box[href], a[href*=.html]@href",
        "title": ".g-item-title, .jt-item-title",
        "address": ".g-item-address",
        "params": "*.rp-it-params span[title]@title=",
        "price": ".c-item-price",
        "price_box": ".g-item-price-box",
        "thumb": "img[src]@src",
        "owner": ".rp-it-owner",
    },
    centrarium_columns, page={"count": ".j-search-total, .it-sort-item-count", "hrefs": "*a[href*=page=]@href", "body": "body"},
    total=lambda: numbers.first_token(found(p("count"), r"(?i)([0-9,\s]+)\s+listings\b")),
    pages=lambda: one_more(
        F.greatest(
            most(p("hrefs"), r"[?&]page=([0-9]+)"),
            F.ceil(numbers.first_token(found(F.coalesce(p("count"), p("body")), r"(?i)([0-9,\s]+)\s+listings\b")) / 36),
        ),
        36,
    ),
)


# ---- mubawab -------------------------------------------------------------------------------------
def mubawab_columns() -> dict[str, Column]:
    ident = F.coalesce(f("id"), urls.listing_id(f("link"), "mubawab"))
    linked = F.when(urls.listing_id(f("link"), "mubawab") == ident, f("link")).otherwise(f("title_link"))
    near = F.trim(F.regexp_replace(f("where"), r"(?i)^in\s+", ""))
    feature = lambda pattern: whole(in_lines(f("features"), pattern))
    return {
        "external_id": ident, "url": F.coalesce(
            F.when(urls.listing_id(linked, "mubawab").isNotNull(), here(linked, "https://www.mubawab.ma")),
            F.concat(F.lit("https://www.mubawab.ma/en/a/"), ident, F.lit("/"), ident),
        ), "type": F.lit("House"),
        "place": F.coalesce(
            found(near, r"^(.*?)\s+in\s+"),
            comma_part(near, 1),
        ), "region": F.coalesce(found(near, r"\s+in\s+(.*)$"), comma_part(near, -1)), **paid("mubawab", f("price")),
        "living_m2": numbers.area(
            f("features"),
            unit="(?:m²|m2)",
        ), "rooms": feature(r"(?i)([0-9]+)\s*Pieces?\b"), "bedrooms": feature(r"(?i)([0-9]+)\s*Rooms?\b"), "baths": feature(r"(?i)([0-9]+)\s*Bathrooms?\b"),
        "snippet": f("snippet"), "thumb": here(
            F.coalesce(f("thumb"), f("thumb2")),
            "https://www.mubawab.ma",
        ), "promoted": matched(f("class"), r"\bsPremium\b"),
    }


Portal(
    "mubawab", "https://www.mubawab.ma", 32, ".listingBox",
    {
        "id": "input.adId@value",
        "link": "@linkref",
        "class": "@class",
        "title_link": "h2.listingTit a[href]@href",
        "price": ".priceTag",
        "title": "h2.listingTit",
        "where": "span.listingH3",
        "features": "*.adDetailFeature",
        "snippet": "p.listingP",
        "thumb": "img.firstPicture@data-lazy",
        "thumb2": "img.firstPicture@src",
    },
    mubawab_columns, page={"count": "#numResults", "map": "#pageUrlMap@value", "current": "#currentPage@value"},
    total=lambda: numbers.digits(found(p("count"), r"(?i)([0-9\s.,]+)\s+results?\b")),
    pages=lambda: pages_of(numbers.digits(found(p("count"), r"(?i)([0-9\s.,]+)\s+results?\b")), 32, most(p("map"), r'"([0-9]+)"\s*:')),
    keep=lambda: f("id").isNotNull() & ~matched(f("price"), r"(?i)^From\b") & ~matched(
        f("class"),
        r"\b(?:adBoostBox|emptyBox)\b",
    ) & ~matched(f("link"), "/p/"),
)


# ---- homege --------------------------------------------------------------------------------------
def homege_columns() -> dict[str, Column]:
    link = F.coalesce(f("link"), f("data_link"))
    ident = F.coalesce(f("id"), urls.listing_id(link, "homege"), f("slider"))
    title = F.coalesce(f("title"), f("data_title"))
    parts = F.filter(F.transform(F.split(title, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(?i)[0-9]+\s*Rooms?\b|for sale|for rent|lease"))
    spans = F.filter(F.split(F.coalesce(f("spans"), F.lit("")), "\n"), lambda x: x != "")
    kind = F.coalesce(F.try_element_at(F.filter(spans, lambda x: x.rlike("(?i)sale|rent|house|land")), F.lit(1)), F.lit("House For Sale"))
    city = F.try_element_at(F.filter(spans, lambda x: (x != kind) & ~x.rlike("(?i)^house for sale$")), F.lit(-1))
    living, land, _ = plot_as_land(numbers.area(f("area"), numbers.comma_thousands, r"(?:m²|m2|m)\b"), F.lit(None).cast("long"))
    thumb = F.when(~matched(f("thumb"), r"blank|^data:"), f("thumb"))
    return {
        "external_id": ident, "url": here(
            F.when(urls.listing_id(link, "homege").isNotNull(), link).otherwise(F.concat(
                F.lit("en/saxlebi-agarakebi/iyideba-saxlebi-agarakebi/listing-"),
                ident,
                F.lit(".html"),
            )),
            "https://www.home.ge",
        ), "type": kind,
        "place": F.coalesce(
            F.try_element_at(parts, F.lit(-1)),
            city,
        ), "region": F.coalesce(
            city,
            F.try_element_at(parts, F.lit(1)),
        ), "rooms": whole(found(title, r"(?i)([0-9]+)\s*Rooms?\b")), **paid("homege", f("price")),
        "living_m2": living, "land_m2": land, "bedrooms": numbers.comma_thousands(f("beds")), "baths": numbers.comma_thousands(f("baths")), "thumb": here(
            F.coalesce(thumb, f("data_thumb")),
            "https://www.home.ge",
        ),
        "promoted": matched(f("class"), r"\b(?:featured|topvip_status|supervip)\b"),
    }


Portal(
    "homege", "https://www.home.ge", 48, "article.item",
    {
        "class": "@class",
        "id": ".compare-grid-icon@data-listing-id",
        "data_link": ".compare-grid-icon@data-listing-url",
        "data_title": ".compare-grid-icon@data-listing-title",
        "data_thumb": ".compare-grid-icon@data-listing-picture",
        "slider": ".listing-picture-slider[data-id]@data-id",
        "link": "li.title a[href], a.link-large[href]@href",
        "title": "li.title a[href], a.link-large[href]",
        "spans": "*li.fields span",
        "price": ".price-tag",
        "beds": "li.services .badrooms, li.services .bedrooms",
        "baths": "li.services .bathrooms",
        "area": "li.services .square_feet",
        "thumb": ".listing-picture-slider img[src]@src",
    },
    homege_columns, page={
        "h1": "h1",
        "stats": "ul.pagination input[name=stats]@value",
        "pager": "ul.pagination",
        "current": "ul.pagination input[type=text]@value",
    },
    total=lambda: numbers.comma_thousands(found(p("h1"), r"(?i)([0-9\s.,]+)\s+ad\(s\)\s+found")),
    pages=lambda: pages_of(
        numbers.comma_thousands(found(p("h1"), r"(?i)([0-9\s.,]+)\s+ad\(s\)\s+found")),
        48,
        F.coalesce(whole(found(p("stats"), r"\|([0-9]+)$")), whole(found(p("pager"), r"(?i)of\s+([0-9]+)"))),
    ),
    keep=lambda: ~matched(F.coalesce(f("link"), f("data_link")), r"(?i)/miwis-nakveti/|/binebi/"),
)


# ---- bulgarianproperties -------------------------------------------------------------------------
def bulgarianproperties_columns() -> dict[str, Column]:
    number = F.coalesce(urls.listing_id(f("link"), "bulgarianproperties"), found(F.coalesce(f("id"), f("id2"), f("id3")), "^([0-9]+)$"))
    near = F.coalesce(found(f("where"), r"(?i)\bNear\s+([^,]+)"), F.lit(None))
    names = F.filter(F.transform(F.split(f("where"), ","), lambda x: F.trim(F.regexp_replace(x, r"(?i)^\s*Near\s+", ""))), lambda x: x != "")
    quarter = matched(F.try_element_at(names, F.lit(-1)), r"(?i)^(Quarter|District|Area)\b")
    first, last = F.try_element_at(names, F.lit(1)), F.try_element_at(names, F.lit(-1))
    other = F.try_element_at(F.filter(names, lambda x: F.lower(x) != F.lower(F.trim(near))), F.lit(1))
    stated = money.amounts(F.concat_ws(" ", F.coalesce(f("new_price"), f("price")), F.when(f("new_price").isNotNull(), f("price"))), "bulgarianproperties")
    priced = money.best_priced(stated, "bulgarianproperties")
    kind = text.node_text(F.regexp_replace(f("type"), r"(?i)^Type of property:\s*", ""))
    size = lambda words: numbers.comma_thousands(
        found(numbers.spaced(f("all")), rf"(?i)(?:{words})[:\s]*{numbers.AMOUNT}\s*(?:m²|m2|m\b)"),
        join_spaces=True,
    )
    living, land, _ = plot_as_land(size("Area|Living"), size("Garden|Yard|Plot|Land"), matched(kind, r"(?i)land|plot"))
    return {
        "external_id": F.concat(F.lit("AD"), number, F.lit("BG")),
        "url": here(f("link"), "https://www.bulgarianproperties.com"),
        "type": kind,
        "place": F.when(near.isNotNull(), other).when(quarter, last).otherwise(first),
        "region": F.when(near.isNotNull(), F.trim(near)).when(quarter, first).otherwise(last),
        "price": priced["price"],
        "currency": F.lit("EUR"),
        "old_price": money.money(f("old_price"), "bulgarianproperties")["amount"],
        "living_m2": living,
        "land_m2": land,
        "snippet": F.coalesce(f("subtitle"), f("description")),
        "agent": f("agent"),
        "thumb": here(F.coalesce(f("thumb"), f("thumb2")), "https://www.bulgarianproperties.com"),
        "promoted": matched(f("labels"), r"(?i)best bargain|top offer|exclusive"),
    }


Portal(
    "bulgarianproperties", "https://www.bulgarianproperties.com", 30, ".component-property-item",
    {
        "link": "a.title[href], a.image[href], a[href*=/AD]@href",
        "id": "@data-preference-prop-id",
        "id2": "@id",
        "id3": "@data-id",
        "where": ".location",
        "type": ".type a, .type",
        "new_price": ".new-price",
        "old_price": ".old-price",
        "price": "*.regular-price, .property-prices",
        "labels": "*.top-labels .label, .bottom-labels .label",
        "subtitle": ".list-subtitle",
        "description": ".list-description",
        "agent": ".broker-info .name",
        "thumb": "img[data-src]@data-src",
        "thumb2": "a.image img@src",
        "all": "",
    },
    bulgarianproperties_columns, page={"count": ".pcount", "ids": "*.pcount a[data-preference-element-id]@data-preference-element-id"},
    total=lambda: numbers.comma_thousands(found(p("count"), r"(?i)from\s+([0-9\s.,]+)\s+results"), join_spaces=True),
    pages=lambda: pages_of(
        numbers.comma_thousands(found(p("count"), r"(?i)from\s+([0-9\s.,]+)\s+results"), join_spaces=True),
        30,
        most(p("ids"), r"pagination_([0-9]+)"),
    ),
)


# ---- domaza --------------------------------------------------------------------------------------
def domaza_columns() -> dict[str, Column]:
    link = F.coalesce(f("link"), f("data_link"))
    ident = F.coalesce(numbers.digits(f("id")).cast("string"), numbers.digits(f("id2")).cast("string"), urls.listing_id(link, "domaza"))
    crumbs = F.filter(F.split(F.coalesce(f("crumbs"), F.lit("")), "\n"), lambda x: x != "")
    place = F.coalesce(F.when(F.size(crumbs) > 2, crumbs[2]), F.try_element_at(crumbs, F.lit(-1)), f("hidden_place"))
    region = F.try_element_at(crumbs, F.lit(2))
    lat, lon = not_at_zero(f("lat").try_cast("double"), f("lon").try_cast("double"))
    stated = money.amounts(F.coalesce(f("price"), f("price2"), f("price3")), "domaza")
    unit = r"(?:m2|m²|m\s*2|sq\.?\s*m|sqm)\b"
    return {
        "external_id": ident,
        "url": F.coalesce(
            F.regexp_replace(F.regexp_replace(here(link, "https://www.domaza.com"), r"[?#].*$|_hasSearch/[0-9]+/?$", ""), "/*$", "/"),
            F.concat(F.lit("https://www.domaza.com/property/print/id/"), ident, F.lit("/")),
        ),
        "type": f("title"),
        "place": place,
        "region": region,
        "dept_nl": region,
        "country": F.try_element_at(crumbs, F.lit(1)),
        "lat": lat,
        "lon": lon,
        "price": money.best_priced(stated, "domaza")["price"],
        "currency": F.lit("EUR"),
        "bedrooms": numbers.digits(f("beds")),
        "baths": numbers.digits(f("baths")),
        "living_m2": F.coalesce(numbers.area(f("area"), unit=unit), numbers.area(f("price2"), unit=unit)),
        "reference": F.coalesce(found(f("ref"), r"(?i)\bRef\s*[-–]?\s*([A-Za-z0-9/-]+)"), ident),
        "agent_name": f("agency"),
        "thumb": here(F.when(~F.contains(f("thumb"), F.lit("offer_default")), f("thumb")), "https://www.domaza.com"),
        "snippet": f("title"),
        "promoted": F.lit(False),
    }


Portal(
    "domaza", "https://www.domaza.com", 20, ".single_property",
    {
        "id": "@data-prop",
        "id2": ".prop_id",
        "data_link": "@data-href",
        "link": "a.thumb-popup[href], a[href*=-p/]@href",
        "price": ".prop_price",
        "price2": ".property_price",
        "price3": ".price_hidden_data",
        "crumbs": "*.oftitle a[href*=properties_], .oftitle_location a[href*=properties_]",
        "hidden_place": ".location_hidden_data",
        "area": ".area_hidden_data",
        "title": ".prop_title",
        "labels": ".property_labels",
        "lat": ".prop_latitude",
        "lon": ".prop_longitude",
        "beds": ".thumb-info li:has([class*=icon-bed]), .thumb-info li:has([src*=bed_icon]), li:has([src*=bed_icon])",
        "baths": ".thumb-info li:has([class*=icon-shower]), .thumb-info li:has([src*=shower_icon]), li:has([src*=shower_icon])",
        "agency": ".property_agency_name",
        "ref": ".oftitle .id, .id",
        "thumb": ".property_image_thumb img[src], img.img-responsive[src]@src",
    },
    domaza_columns, page={"hrefs": "*a[href]@href"},
    pages=lambda: one_more(most(p("hrefs"), r"/_page/([0-9]+)/?"), 20),
)


# ---- lefigaro ------------------------------------------------------------------------------------
def lefigaro_columns() -> dict[str, Column]:
    ident, line = found(f("links"), urls.LISTING_ID["lefigaro"]), numbers.spaced(f("all"))
    sizes = F.regexp_extract_all(line, F.lit(r"(?i)([0-9][0-9\s.,]*)\s*(?:m²|m2)"))
    plot = found(line, rf"(?i)(?:terrain|parcelle|jardin)\s*(?:de|attenant(?:e)?\s+de)?\s*{numbers.AMOUNT}\s*(?:m²|m2)")
    return {
        "external_id": ident,
        "url": F.concat(F.lit("https://immobilier.lefigaro.fr/annonces/annonce-"), ident, F.lit(".html")),
        "type": F.coalesce(found(line, r"\b(Maison|Propriété|Appartement|Terrain|Immeuble|Ferme|Longère)\b"), F.lit("Maison")),
        "place": found(line, r"\b([A-ZÀ-Ÿ][A-Za-zÀ-ÿ'’ -]+?)\s*\([0-9]{2,3}\)"),
        "region": urls.department(F.col("url"), "lefigaro")["name"],
        "price": money.money(line, "lefigaro")["amount"],
        "currency": F.lit("EUR"),
        "living_m2": numbers.decimal_comma(F.try_element_at(sizes, F.lit(1))),
        "land_m2": F.coalesce(
            numbers.decimal_comma(plot),
            F.when(matched(line, "(?i)terrain") & (F.size(sizes) > 1), numbers.decimal_comma(F.try_element_at(sizes, F.lit(-1)))),
        ),
        "rooms": whole(found(line, r"(?i)([0-9]+)\s*pi[eè]ces?\b")),
        "bedrooms": whole(found(line, r"(?i)([0-9]+)\s*chambres?\b")),
        "thumb": here(F.coalesce(f("thumb"), f("thumb2")), "https://immobilier.lefigaro.fr"),
        "snippet": f("title"),
        "promoted": F.lit(False),
    }


# The kinds of one portal's structured data and titles, and the kinds that name a listing.
LEFIGARO_TYPES = {
    "house": "Maison",
    "singlefamilyresidence": "Maison",
    "residence": "Maison",
    "accommodation": "Maison",
    "maison": "Maison",
    "propriete": "Propriété",
    "propriété": "Propriété",
    "apartment": "Appartement",
    "appartement": "Appartement",
    "land": "Terrain",
    "terrain": "Terrain",
}
LEFIGARO_NAMED = ("house", "singlefamilyresidence", "apartment", "land", "residence")


def kinds_of(stated: Column) -> Column:
    """The name of the first kind in an @type value (a word or a list of them) that names a listing; null without one."""
    listed = F.from_json(F.when(F.startswith(stated, F.lit("[")), stated).otherwise(F.concat(F.lit('["'), stated, F.lit('"]'))), "array<string>")
    known = F.try_element_at(F.filter(F.transform(listed, F.lower), lambda k: k.isin(*LEFIGARO_NAMED)), F.lit(1))
    return F.when(known.isNotNull(), text.pretty_type(known, LEFIGARO_TYPES, "Maison"))


def lefigaro_items(pages: DataFrame) -> DataFrame:
    """Listings of the page's ItemList; the cards give those that it leaves out."""
    whole_page = extracted(pages, None, {}, {"ld": "script[type=application/ld+json]"})
    listed = whole_page.select("url", F.posexplode(F.from_json(F.get_json_object(p("ld"), "$.itemListElement"), "array<string>")).alias("pos", "entry"))
    of = lambda path: F.get_json_object("item", path)
    rows = listed.withColumn("item", F.coalesce(F.get_json_object("entry", "$.item"), "entry"))
    quantity = lambda name: numbers.decimal_comma(F.coalesce(
        of(f"$.{name}.value"),
        F.when(~F.startswith(of(f"$.{name}"), F.lit("{")), of(f"$.{name}")),
    ))
    name = of("$.name")
    rental = matched(name, r"(?i)\b(?:location|louer)\b") & ~matched(name, "(?i)vente")
    columns = {
        "external_id": urls.listing_id(F.coalesce(of("$.url"), of("$['@id']")), "lefigaro"),
        "url": here(F.coalesce(of("$.url"), of("$['@id']")), "https://immobilier.lefigaro.fr"),
        "type": F.coalesce(kinds_of(of("$['@type']")), text.pretty_type(found(name, r"^(\S+)"), LEFIGARO_TYPES, "Maison")),
        "place": F.coalesce(of("$.address.addressLocality"), found(name, r"\b([A-ZÀ-Ÿ][A-Za-zÀ-ÿ'’ -]+?)\s*\([0-9]{2,3}\)\s*$")),
        "region": F.coalesce(of("$.address.addressRegion"), urls.department(F.col("url"), "lefigaro")["name"]),
        "price": F.coalesce(numbers.rounded(of("$.offers.price")), numbers.rounded(of("$.offers[0].price"))),
        "currency": F.lit("EUR"),
        "living_m2": quantity("floorSize"),
        "land_m2": F.coalesce(quantity("landArea"), quantity("lotSize")),
        "rooms": numbers.decimal_comma(of("$.numberOfRooms")),
        "bedrooms": numbers.decimal_comma(of("$.numberOfBedrooms")),
        "lat": of("$.geo.latitude").try_cast("double"),
        "lon": of("$.geo.longitude").try_cast("double"),
        "snippet": of("$.description"),
        "promoted": F.lit(False),
    }
    return rows.where(~F.coalesce(rental, F.lit(False))).select(
        F.col("url").alias("page_url"),
        (F.col("pos") - 10_000).alias("pos"),
        F.lit("lefigaro").alias("source"),
        *(c.alias(n) for n, c in columns.items()),
    )


Portal(
    "lefigaro", "https://immobilier.lefigaro.fr", 24, ".cartouche-liste, .cartouche-liste--polpo",
    {"links": "*a[href]@href", "title": "h2, h3, .cartouche-liste__title", "thumb": "img[data-src]@data-src", "thumb2": "img[src]@src", "all": ""},
    lefigaro_columns, page={"ld": "script[type=application/ld+json]", "h1": "h1", "title": "title", "body": "body"},
    total=lambda: F.coalesce(
        numbers.decimal_comma(F.get_json_object(p("ld"), "$.numberOfItems")),
        numbers.decimal_comma(found(numbers.spaced(F.coalesce(p("h1"), p("title"))), r"(?i)([0-9\s]+)\s+annonces?\b")),
    ),
    pages=lambda: F.least(
        F.lit(100),
        pages_of(
            F.coalesce(
                numbers.decimal_comma(F.get_json_object(p("ld"), "$.numberOfItems")),
                numbers.decimal_comma(found(numbers.spaced(F.concat_ws(" ", p("h1"), p("title"), p("body"))), r"(?i)([0-9\s]+)\s+annonces?\b")),
            ),
            24,
        ),
    ),
    stated=lefigaro_items, keep=lambda: found(f("links"), urls.LISTING_ID["lefigaro"]).isNotNull() & ~(matched(
        f("all"),
        r"(?i)\b(?:location|louer)\b",
    ) & ~matched(f("all"), "(?i)vente")),
)


# ---- greenacres ----------------------------------------------------------------------------------
def greenacres_columns() -> dict[str, Column]:
    link = urls.decoded_href(f("token"))
    ident = F.coalesce(f("id"), urls.listing_id(link, "greenacres"))
    tag = lambda label: in_lines(f("tags"), rf"(?i)(?:^|\n){label}=([^\n]+)")
    size = lambda t: F.coalesce(numbers.area(t, numbers.dot_thousands, r"(?:m²|m2|m&#xB2;)"), numbers.dot_thousands(t))
    where = f("where")
    needles = [("appartement", "Appartement"), ("garage", "Garage"), ("/box", "Garage"), ("terrein", "Terrein"), ("terrain", "Terrein")]
    # Text by text: what the first of them says counts, whatever the later ones hold.
    kind = F.coalesce(*(text.first_match(t, needles) for t in (f("seo"), f("title"), link)))
    region = F.coalesce(found(where, r"\(([^)]+)\)\s*$"), urls.department(F.col("url"), "greenacres")["name"])
    return {
        "external_id": ident, "url": here(
            F.coalesce(link, F.concat(F.lit("nl/properties/huis/france/"), ident, F.lit(".htm"))),
            "https://www.green-acres.fr",
        ), "type": F.coalesce(kind, F.lit("Huis")), "place": F.coalesce(found(where, r"^\s*([^()]+?)\s*\("), where),
        "region": region, "dept_fr": region, "dept_nl": region, **paid(
            "greenacres",
            F.coalesce(f("price"), f("all")),
        ), "living_m2": size(tag("Woonoppervlakte")), "land_m2": size(tag("(?:Terrein|Grond)")),
        "rooms": F.coalesce(numbers.dot_thousands(tag("Kamers?")), whole(found(f("all"), r"(?i)([0-9]+)\s*kamers?\b"))), "bedrooms": F.coalesce(
            numbers.dot_thousands(tag("Slaapkamers?")),
            whole(found(f("all"), r"(?i)([0-9]+)\s*slaapkamers?\b")),
        ),
        "thumb": here(
            f("thumb"),
            "https://www.green-acres.fr",
        ), "snippet": F.coalesce(f("snippet"), f("title")), "agent": f("agent"), "promoted": F.lit(False),
    }


Portal(
    "greenacres", "https://www.green-acres.fr", 24, ".announce-card",
    {
        "class": "@class",
        "id": "@data-advertid",
        "token": "@data-o",
        "title": "@title",
        "where": ".announce-localisation",
        "price": ".info-price",
        "seo": ".advert-seo-tag",
        "tags": "*.info-tag@title=",
        "snippet": ".description-details",
        "thumb": "img.announce-card-img[src]@src",
        "agent": ".company-name",
        "all": "",
    },
    greenacres_columns, page={"count": "meta[name=adverts-count]@content", "info": ".pagination-info", "h1": "h1", "title": "title"},
    total=lambda: F.coalesce(
        whole(p("count")),
        numbers.dot_thousands(found(numbers.spaced(p("info")), r"(?i)op\s+([0-9.\s]+)")),
        numbers.dot_thousands(found(numbers.spaced(F.coalesce(p("h1"), p("title"))), r"(?i)([0-9.\s]+)\s+(?:woningen|huizen|properties|annonces|biens)\b")),
    ),
    pages=lambda: pages_of(
        F.coalesce(
            whole(p("count")),
            numbers.dot_thousands(found(numbers.spaced(p("info")), r"(?i)op\s+([0-9.\s]+)")),
            numbers.dot_thousands(found(
                numbers.spaced(F.coalesce(p("h1"), p("title"))),
                r"(?i)([0-9.\s]+)\s+(?:woningen|huizen|properties|annonces|biens)\b",
            )),
            F.col("n").cast("long"),
        ),
        24,
    ),
    keep=lambda: ~matched(f("class"), r"\bskeleton\b"),
)


def unwrapped(pages: DataFrame) -> DataFrame:
    """pages whose JSON envelopes (html, advertsCount) are opened: the markup, with the count as a meta element before it."""
    boxed = F.startswith(F.ltrim("html"), F.lit("{")) & F.get_json_object("html", "$.html").isNotNull()
    count = F.get_json_object("html", "$.advertsCount").try_cast("long")
    meta = F.coalesce(F.concat(F.lit('<meta name="adverts-count" content="'), count, F.lit('">')), F.lit(""))
    return pages.withColumn("html", F.when(boxed, F.concat(meta, F.get_json_object("html", "$.html"))).otherwise(F.col("html")))


def cards(pages: DataFrame, source: str, page: dict[str, str] | None = None) -> DataFrame:
    """The cards of result pages; each has a copy of the page fields that are asked for."""
    portal = PORTALS[source]
    pages = unwrapped(pages) if source == "greenacres" else pages
    return extracted(pages, portal.card, portal.fields, page)


def list_rows(pages: DataFrame, source: str) -> DataFrame:
    """The listings of result pages (url, html): page_url, pos, source, external_id and the portal's columns.

    Cards without an id and those that the portal's rule turns away are left out; of an id that a
    page shows twice the first card counts.
    """
    portal = PORTALS[source]
    columns = portal.columns()
    rows = cards(pages, source).where(F.col("pos").isNotNull() & portal.keep())
    rows = rows.select(F.col("url").alias("page_url"), "pos", F.lit(source).alias("source"), *(c.alias(n) for n, c in columns.items()))
    if portal.stated:
        rows = rows.unionByName(portal.stated(pages), allowMissingColumns=True)
    rows = rows.where(F.col("external_id").isNotNull())
    first = F.row_number().over(W.partitionBy("page_url", "external_id").orderBy("pos"))
    return rows.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def list_pages(pages: DataFrame, source: str) -> DataFrame:
    """url, total, total_pages, cards, next_url of result pages."""
    portal = PORTALS[source]
    rows = cards(pages, source, portal.page).where(F.coalesce("pos", F.lit(0)) == 0)
    number = F.coalesce(
        whole(p("current")).cast("int"),
        urls.page_number(F.col("url"), source) if source in urls.PAGE_NUMBER else F.lit(1),
    ) if "current" in portal.page and source != "franimo" else urls.page_number(F.col("url"), source) if source in urls.PAGE_NUMBER else F.lit(1)
    measured = rows.select(
        "url",
        portal.total().alias("total"),
        F.coalesce(portal.pages(), F.lit(1)).cast("long").alias("total_pages"),
        F.col("n").alias("cards"),
        number.alias("page"),
        p("next").alias("given"),
    )
    following = F.when(F.col("page") < F.col("total_pages"), urls.with_page(F.col("url"), F.col("page") + 1, source))
    if source == "franimo":
        following = F.when(F.col("given").isNotNull(), here(F.col("given"), PORTALS[source].base))
    if source == "bulgarianproperties":
        following = F.when(urls.robots_allowed(following), following)
    return measured.select("url", "total", "total_pages", "cards", following.alias("next_url"))
