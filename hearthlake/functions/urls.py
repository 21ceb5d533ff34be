"""Addresses: identity, paging, price bounds and search paths of the portals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.numbers import filled, found, matched, once

# Where a listing's id stands in its address.
LISTING_ID = {
    "lefigaro": r"(?i)/annonces/annonce-([0-9]+)\.html", "greenacres": r"(?i)/([A-Za-z0-9]{8,})\.htm", "bulgarianproperties": r"(?i)/AD([0-9]+)BG(?:_|\.|$)", "mubawab": r"(?i)/[a-z]{2}/a/([0-9]+)/",
    "homege": r"(?i)(?:-|/ad)([0-9]+)(?:\.html)?$", "centrarium": r"(?i)-([0-9]+)\.html", "domaza": r"(?i)/[a-z0-9_]+-([0-9]+)-[0-9]+-p/?", "holprop": r"(?i)/s/sale/([a-z]{2}[0-9]+)/?",
    "akiyaportal": r"/listings/([A-Za-z0-9][A-Za-z0-9_-]+)$", "abruzzopropertyitaly": r"(?i)pid=([0-9]+)", "abruzzoruralproperty": r"(?i)/find-a-property/for-sale/item/([0-9]+)-",
}
# Where a page number stands in a list address (group 1), and what is added to the first page counts from.
PAGE_NUMBER = {
    "lefigaro": r"[?&]page=([0-9]+)", "greenacres": r"[?&]p_n=([0-9]+)", "mubawab": r":p:([0-9]+)(?=:|$)", "homege": r"(?i)/index([0-9]+)\.html$", "centrarium": r"[?&]page=([0-9]+)",
    "domaza": r"/_page/([0-9]+)/?", "holprop": r"/page/([0-9]+)/?$", "akiyaportal": r"[?&]page=([0-9]+)", "ok_bulgaria": r"[?&]page=([0-9]+)", "abruzzopropertyitaly": r"[~,]page=([0-9]+)", "abruzzoruralproperty": r"[?&/]start=([0-9]+)",
}
#: Places of a listing in an office's private paths; never a listing.
PRIVATE = r"(?i)/SignIn|/Authentication|/deleted-adverts|/Content/"
#: Addresses that a portal asks robots to leave alone.
DISALLOWED = r"(?i)/Search/|search\?|[?&](?:page|minprice|maxprice|ID|srtby|hw_page)="


def cache_key(url: Column) -> Column:
    return F.sha1(url)


def resolved(url: Column, base: str) -> Column:
    """base before an address that is a path only."""
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


def listing_id(url: Column, source: str) -> Column:
    return found(url, LISTING_ID[source])


def page_number(url: Column, source: str) -> Column:
    """1 where the address names no page. One portal counts from 0, another counts the listings before the page."""
    number = found(url, PAGE_NUMBER[source]).try_cast("int")
    if source == "abruzzopropertyitaly":
        number = number + 1
    if source == "abruzzoruralproperty":
        number = (number / 6).cast("int") + 1
    return F.greatest(F.lit(1), F.coalesce(number, F.lit(1)))


def with_query(url: Column, name: str, value: Column, keep: bool = True) -> Column:
    """url with a query parameter set, or taken out where keep is false."""
    bare = F.regexp_replace(F.regexp_replace(url, rf"([?&]){name}=[^&#]*&?", "$1"), r"[?&](#|$)", "$1")
    sign = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    return F.concat(bare, sign, F.lit(f"{name}="), value.cast("string")) if keep else bare


def with_page(url: Column, page: Column, source: str) -> Column:
    """The address of a page of the same list; the first page carries no number, but at one portal."""
    first = page <= 1
    number = page.cast("string")
    if source == "mubawab":
        bare = F.regexp_replace(url, r":p:[0-9]+(?=:|$)", "")
        return F.when(first, bare).otherwise(F.concat(bare, F.lit(":p:"), number))
    if source == "homege":
        bare = F.regexp_replace(url, r"(?i)/index[0-9]+\.html$", "")
        return F.when(first, F.concat(F.regexp_replace(bare, "/+$", ""), F.lit("/"))).otherwise(F.concat(F.regexp_replace(bare, "/+$", ""), F.lit("/index"), number, F.lit(".html")))
    if source in ("domaza", "holprop"):
        token = "_page" if source == "domaza" else "page"
        bare = F.regexp_replace(F.regexp_replace(url, rf"/{token}/[0-9]+/?", "/"), "/+$", "")
        return F.when(first, F.concat(bare, F.lit("/"))).otherwise(F.concat(bare, F.lit(f"/{token}/"), number, F.lit("/")))
    if source == "abruzzopropertyitaly":  # filters after a tilde; pages count from 0
        bare = F.regexp_replace(F.regexp_replace(url, r"([~,])page=[0-9]+,?", "$1"), "[~,]$", "")
        sign = F.when(F.contains(bare, F.lit("~")), ",").otherwise("~")
        return F.when(first, bare).otherwise(F.concat(bare, sign, F.lit("page="), (page - 1).cast("string")))
    if source == "abruzzoruralproperty":  # counts listings, six a page
        start = ((page - 1) * 6).cast("string")
        return F.when(first, with_query(url, "start", start, keep=False)).otherwise(with_query(url, "start", start))
    if source == "ok_bulgaria":
        return with_query(url, "page", number)
    name = "p_n" if source == "greenacres" else "page"
    return F.when(first, with_query(url, name, number, keep=False)).otherwise(with_query(url, name, number))


def query_map(url: Column) -> Column:
    """The query parameters, decoded; of a repeated name the last one."""
    return F.transform_values(F.str_to_map(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("=")), lambda k, v: F.try_url_decode(v))


def with_prices(url: Column, lo: Column, hi: Column, low_name: str = "pricefrom", high_name: str = "priceto") -> Column:
    """url with its price bounds replaced; bounds that are missing are added. The same bounds again change nothing."""
    return with_query(with_query(url, low_name, lo), high_name, hi)


def robots_allowed(url: Column) -> Column:
    return ~matched(url, DISALLOWED)


def decoded_href(token: Column) -> Column:
    """The address in a base64 token, padded or not; null for anchors, account pages and what is no base64."""
    clean = F.regexp_replace(token, r"[\s=]", "")
    valid = matched(clean, r"^[A-Za-z0-9+/]+$") & (F.length(clean) % 4 != 1)
    text = F.when(valid, F.decode(F.unbase64(clean), "utf-8"))
    return F.when((text != "") & ~F.startswith(text, F.lit("#")) & ~matched(text, PRIVATE), text)


def search_path(types: list[int], lat: float | None = None, lon: float | None = None, km: float | None = None, lo: int = 0, hi: int = 999_999_999) -> str:
    """The path of a search by price, kind and distance."""
    area = "" if lat is None else f"&areaid=0&longitude={lon}&latitude={lat}&zoom=7&kmrange_custom={km}&savedproperties=false&kmrange=0&rooms=0"
    kinds = "".join(f"&propertytypes%5B%5D={t}" for t in types)
    return f"/woning/?pricefrom={lo}&priceto={hi}&zonestype=or{area}{kinds}&submitted=true&orderby=price%20asc"


# Departments by the slug that the portals' addresses end with.
DEPARTMENTS = {
    "creuse": ("Creuse", "23"), "nievre": ("Nièvre", "58"), "haute-vienne": ("Haute-Vienne", "87"), "allier": ("Allier", "03"), "cantal": ("Cantal", "15"), "indre": ("Indre", "36"),
    "cher": ("Cher", "18"), "dordogne": ("Dordogne", "24"), "gers": ("Gers", "32"), "herault": ("Hérault", "34"), "lot": ("Lot", "46"), "aude": ("Aude", "11"), "val-d-oise": ("Val-d'Oise", "95"),
}
#: Those of them that one portal's addresses are known by; other slugs there become a name of their own words.
LEFIGARO_DEPARTMENTS = ("creuse", "nievre", "haute-vienne", "allier", "cantal", "indre", "cher")


def department(url: Column, source: str) -> Column:
    """Struct of name and code of the department that a result or detail address names; both null where it names none."""
    path = F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    nothing = F.lit(None).cast("string")
    if source == "lefigaro":
        slug = F.split_part(found(path, r"immobilier-vente-[^-]+-([a-z0-9+-]+)\.html"), F.lit("+"), F.lit(1))
        known, other = LEFIGARO_DEPARTMENTS, F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
    else:
        slug = found(F.concat(F.lit("/"), F.regexp_replace(path, "^/+|/+$", "")), r".+/([^/]+)$")
        known, other = tuple(DEPARTMENTS), nothing
    name, code = other, nothing
    for key in known:
        name = F.when(slug == key, DEPARTMENTS[key][0]).otherwise(name)
        code = F.when(slug == key, DEPARTMENTS[key][1]).otherwise(code)
    return F.struct(name.alias("name"), code.alias("code"))


# The words of one portal's search tokens that take a value.
TOKENS = ("hab_house", "hab_appartement", "hab_castle", "lg", "cn", "mx_p", "mn_p", "city_id", "prc_max")
GREEN_BASE = "https://www.green-acres.fr/nl/AdvertListingActions/AdvertsListing"


def greenacres_tokens(url: Column) -> Column:
    """Map of the search tokens of an address: `searchQuery=lg-nl-cn-fr-hab_house-on`, its own parameters, and what its path says."""

    def rule(given: Column, blob: Column) -> Column:
        values = {t: F.coalesce(filled(given[t]), found(blob, rf"(?i)-{t}-+([^-]+)(?=-)")) for t in TOKENS}
        values["order"] = filled(given["order"])
        path = F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
        values["city_id"] = F.coalesce(values["city_id"], F.when(F.contains(path, F.lit("creuse")), "dp_23"))
        values["hab_house"] = F.when(F.contains(path, F.lit("/huis")), "true").otherwise(once(values["hab_house"], lambda v: F.when(v == "on", "true").otherwise(v)))
        pairs = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
        return F.map_filter(pairs, lambda k, v: v.isNotNull())

    # Each is worked out once: the parameters, then the words of the search.
    blob = lambda given: F.concat(F.lit("-"), F.coalesce(filled(given["searchQuery"]), filled(given["searchquery"]), given["UrlConditions"], F.lit("")), F.lit("-"))
    return once(query_map(url), lambda given: once(blob(given), lambda words: rule(given, words)))


def listing_api_url(url: Column, page: Column | int = 1, order: str = "price_i", base: str = GREEN_BASE) -> Column:
    """The address of the JSON listing that stands behind a search page; of such an address itself another page."""
    number = F.greatest(F.lit(1), F.lit(page) if isinstance(page, int) else page)
    amount = lambda token, name: F.coalesce(filled(F.regexp_replace(token[name], "[^0-9]", "")), token[name])
    parts = lambda token: [
        F.lit("advertType=Property"), F.concat(F.lit("p_n="), number.cast("string")), F.concat(F.lit("order="), F.url_encode(F.coalesce(token["order"], F.lit(order)))), F.concat(F.lit("cn="), F.coalesce(token["cn"], F.lit("fr"))),
        F.concat(F.lit("lg="), F.coalesce(token["lg"], F.lit("nl"))), F.lit("type=properties"), F.when(token["hab_house"].isin("on", "true", "1"), "hab_house=true"),
        F.concat(F.lit("mx_p="), amount(token, "mx_p")), F.concat(F.lit("mn_p="), amount(token, "mn_p")), F.concat(F.lit("city_id="), token["city_id"]),
    ]
    built = F.concat(F.lit(base + "?"), once(greenacres_tokens(url), lambda token: F.concat_ws("&", *parts(token))))
    return F.when(F.contains(url, F.lit("AdvertListingActions/AdvertsListing")), with_query(url, "p_n", number)).otherwise(built)


def seed_url(path: Column, source: Column, bases: dict[str, str]) -> Column:
    """The first page's address of a search: the portal's base and the path; for one portal the JSON listing behind it."""
    base = F.try_element_at(F.create_map(*(F.lit(x) for pair in bases.items() for x in pair)), source)
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))
    url = F.when(path.rlike("^https?://"), path).otherwise(joined)
    return F.when(source == "greenacres", listing_api_url(url)).otherwise(url)


def joined(reference: Column, base: Column) -> Column:
    """The whole address of a reference on the page at base, as RFC 3986 resolves it: paths with dots, query-only and scheme-less ones too."""
    site = found(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)")
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    asked = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(reference, r"^([^?#]*)", 1)
    rest = F.substring(reference, F.length(own) + 1, F.length(reference))
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    full = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
    steps = F.filter(F.split(F.regexp_replace(full, "^/", ""), "/"), lambda x: x != ".")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(out) - 1))).otherwise(F.concat(out, F.array(x))))
    resolved_path = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(matched(full, r"(?:^|/)\.\.?$") & (F.size(kept) > 0), "/").otherwise(""))
    here = F.when(own == "", F.concat(path, F.when(F.startswith(rest, F.lit("?")), rest).otherwise(F.concat(asked, rest)))).otherwise(F.concat(resolved_path, rest))
    return (
        F.when(reference.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), reference)
        .when(F.startswith(reference, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), reference))
        .otherwise(F.concat(site, here))
    )
