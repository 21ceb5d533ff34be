"""Scalar rules on single values."""

import pytest
from pyspark.sql import functions as F

from hearthlake.functions import cleaning, geo, money, numbers, text, urls


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rule", "written", "wanted"),
    [
        ("franimo", "€ 14.950", 14950), ("franimo", "1 200 m", 1200), ("franimo", "", None), ("franimo", None, None), ("domaza", "70,000.00", 7000000),
        ("lefigaro", "37 500", 37500), ("lefigaro", "73,5", 74), ("lefigaro", "72,5", 72), ("greenacres", "107.417", 107417), ("greenacres", "1.220", 1220), ("greenacres", "12,5", 12),
        ("homege", "70,000.00", 70000), ("homege", "1,489.36", 1489), ("bulgarianproperties", "10 900", 10900), ("centrarium", "21.5", 215), ("centrarium", "35 000", 35000),
        ("abruzzoruralproperty", "4.700", 4700), ("abruzzoruralproperty", "4,700", 4700), ("abruzzoruralproperty", "7,36", 7), ("abruzzoruralproperty", "none", None),
    ],
)
def test_numbers(value, rule, written, wanted):
    assert value(numbers.DIALECTS[rule](F.lit(written).cast("string"))) == wanted


def test_areas(value):
    assert value(numbers.area(F.lit("House 2,700 sq.m."))) == 2700
    assert value(numbers.area_or_number(F.lit("707"))) == 707
    assert value(numbers.leading_area(F.lit("120 m2"))) == 120
    assert value(numbers.decimal_area(F.lit("105.3m²"))) == 105
    assert value(numbers.decimal_area(F.lit("0.00 SQM"), zero_is_null=True)) is None
    assert value(numbers.hectares(F.lit("1,5 hectares of land"))) == 15000
    assert [value(numbers.bedroom_words(F.lit(t))) for t in ("three bedrooms", "a 4-bedroom house", "bedroom")] == [3, 4, None]
    assert value(numbers.layout(F.lit("112.86m²5dk"))) == "5DK" and value(numbers.layout_bedrooms(F.lit("3LDK"))) == 3
    assert value(numbers.year(F.lit("built 1987, sold"))) == 1987


@pytest.mark.parametrize(
    ("amount", "currency", "source", "euros"),
    [(350000, "MAD", "mubawab", 32110), (70000, "USD", "homege", 59500), (150000, "GEL", "homege", 49505), (9375, "GBP", "bulgarianproperties", 10903), (12512, "USD", "bulgarianproperties", 10885), (107417, "USD", "greenacres", 93453), (10, "XXX", "homege", None)],
)
def test_euros(value, amount, currency, source, euros):
    assert value(money.to_euro(F.lit(amount), F.lit(currency), source)) == euros


@pytest.mark.parametrize(
    ("source", "written", "wanted"),
    [
        ("homege", "70,000.00 $ (25.00 $ p/m)", (70000, "USD")), ("homege", "59,500 € / 70,000 $", (59500, "EUR")), ("mubawab", "350,000 DH", (350000, "MAD")), ("mubawab", "Price on request 1 DH", None), ("mubawab", "85,000 EUR", (85000, "EUR")),
        ("bulgarianproperties", "£ 9 375 € 10 900", (10900, "EUR")), ("ok_bulgaria", "£1,286 (€ 1,500)", (1286, "GBP")), ("greenacres", "$107.417 Prijs in euro: 93.500", (93500, "EUR")), ("domaza", "215 000 € 4 574 €/m 2", (215000, "EUR")),
        ("abruzzoruralproperty", "SOLD", None), ("abruzzoruralproperty", "Reserved €42.000", (42000, "EUR")), ("lefigaro", "Prix sur demande", None), ("akiyaportal", "¥1,200,000", (1200000, "JPY")), ("centrarium", "€ 35 000", (35000, "EUR")),
    ],
)
def test_prices(value, source, written, wanted):
    found = value(money.money(F.lit(written), source))
    assert (None if found is None else tuple(found)) == wanted


def test_stated_amounts_and_drops(value):
    assert value(money.amounts(F.lit("€9,500 £ 8,171 GBP $ 10,905 USD"), "holprop")) == {"EUR": 9500, "GBP": 8171, "USD": 10905}
    stored = value(money.priced(money.money(F.lit("£ 8,171 GBP"), "holprop"), "holprop"))
    assert tuple(stored) == (8171, "GBP", "portal_gbp")
    drop = lambda t, p, c: value(money.price_before_drop(F.lit(t), F.lit(p).cast("long"), F.lit(c)))
    assert drop("Decreased by 5,000 EUR", 85000, "EUR") == 90000 and drop("Decreased by 109 DH", 85000, "EUR") == 85010 and drop("", 1, "EUR") is None


def test_texts(value):
    assert value(text.node_text(F.lit("  a  b\n c "))) == "a b c" and value(text.node_text(F.lit(" \n"))) is None
    assert [value(text.pretty_source(F.lit(s))) for s in ("homege", "new_portal-x", "", "—")] == ["home.ge", "New Portal X", "", "—"]
    assert value(text.fold(F.lit("Ardèche (07)"))) == "ardeche"
    assert text.search_terms("  Near  TOWN ") == ["near", "town"] and text.search_terms(" ") == []
    assert value(text.label(F.lit(" Area : "))) == "area"
    assert value(text.first_match(F.lit("Detached VILLA"), [("villa", "v"), ("detached", "d")])) == "v"
    assert value(text.latin_parts(F.lit("Bar, Сутоморе, Susanj, Montenegro"), ["montenegro"])) == ["Bar", "Susanj"]
    assert [value(text.photo_name(F.lit(n))) for n in ("a.jpg", "b.png")] == ["a", "=b.png"]
    assert value(text.path_head(F.lit("https://x/y/z.jpg"))) == "https://x/y/" and value(text.path_head(F.lit("z.jpg"))) == "/" and value(text.path_tail(F.lit("https://x/y/z.jpg"))) == "z.jpg"
    assert value(text.absolute(F.lit("/a"), "https://b")) == "https://b/a" and value(text.relative(F.lit("https://b/a"), "https://b")) == "/a"


def test_addresses(value):
    page = lambda u, n, s: value(urls.with_page(F.lit(u), F.lit(n), s))
    assert page("https://m/en/st:pr:10", 2, "mubawab") == "https://m/en/st:pr:10:p:2" and page("https://m/en/st:pr:10:p:2", 1, "mubawab") == "https://m/en/st:pr:10"
    assert page("https://h/houses/", 3, "homege") == "https://h/houses/index3.html" and page("https://d/s/_page/2/", 4, "domaza") == "https://d/s/_page/4/" and page("https://d/s/_page/2/", 1, "domaza") == "https://d/s/"
    assert page("https://l/x?page=3&q=1", 4, "lefigaro") == "https://l/x?q=1&page=4" and page("https://l/x?page=3", 1, "lefigaro") == "https://l/x"
    assert page("https://a/s~minprice=1", 3, "abruzzopropertyitaly") == "https://a/s~minprice=1,page=2" and page("https://a/s~page=2,x=1", 1, "abruzzopropertyitaly") == "https://a/s~x=1"
    assert value(urls.page_number(F.lit("https://a/s~x=1,page=2"), "abruzzopropertyitaly")) == 3 and value(urls.page_number(F.lit("https://a/l?start=12"), "abruzzoruralproperty")) == 3
    assert page("https://a/list", 3, "abruzzoruralproperty") == "https://a/list?start=12" and page("https://o/?a=1", 1, "ok_bulgaria") == "https://o/?a=1&page=1"
    assert value(urls.page_number(F.lit("https://d/s/_page/7/"), "domaza")) == 7 and value(urls.page_number(F.lit("https://d/s"), "domaza")) == 1
    assert value(urls.listing_id(F.lit("https://b/AD91080BG_house.html"), "bulgarianproperties")) == "91080"
    assert value(urls.query_map(F.lit("https://b/?a=1&b=x%20y"))) == {"a": "1", "b": "x y"}
    twice = urls.with_prices(urls.with_prices(F.lit("https://f/?pricefrom=0&z=1"), F.lit(5), F.lit(9)), F.lit(5), F.lit(9))
    assert value(twice) == value(urls.with_prices(F.lit("https://f/?pricefrom=0&z=1"), F.lit(5), F.lit(9)))
    assert value(urls.resolved(F.lit("/a"), "https://b/")) == "https://b/a"
    assert [value(urls.decoded_href(F.lit(t))) for t in ("L2EvYi5odG0", "I3RvcA", "L1NpZ25Jbg==", "?!")] == ["/a/b.htm", None, None, None]
    assert "propertytypes%5B%5D=3" in urls.search_path([3], 45.0, 2.0, 30) and "kmrange_custom=30" in urls.search_path([3], 45.0, 2.0, 30)


def test_places_and_areas(value):
    assert [value(geo.iso(F.lit(n))) for n in (" France ", "bg", "xx", "maroc")] == ["FR", "BG", None, "MA"]
    assert value(geo.country_for(F.lit("nowhere"), F.lit(None).cast("string"), F.lit("homege"))) == "GE"
    assert value(geo.country_for(F.lit("Japan"), F.lit("FR"), F.lit("homege"))) == "JP"
    assert value(geo.clean_coordinate(F.lit("139256123"), 180)) is None and value(geo.clean_coordinate(F.lit("42.5"), 90)) == 42.5 and value(geo.clean_coordinate(F.lit("x"), 90)) is None
    lat, lon = geo.not_at_zero(F.lit(0.00001), F.lit(23.0))
    assert value(lat) is None and value(lon) == 23.0
    living, land, moved = cleaning.plot_as_land(F.lit(1500), F.lit(None).cast("int"))
    assert (value(living), value(land), value(moved)) == (None, 1500, True)
    big = lambda kind: value(cleaning.plausible_living(F.lit(kind), F.lit(2500), F.lit(3), F.lit(2), F.lit(10)))
    assert big("huis") is None and big("kasteel") == 2500
    assert value(cleaning.living_of_land(F.lit("Terrein"), F.lit(80))) is None and value(cleaning.land_unless_echoed(F.lit(80), F.lit(80))) is None


def test_address_parts_are_worked_out_once(spark):
    """The parameters of an address were parsed anew for each of its search words."""
    rows = spark.createDataFrame([("/nl/huis?searchQuery=lg-nl-cn-fr-hab_house-on-mx_p-5", "greenacres")], "path string, source string").repartition(1)
    found = rows.select(urls.seed_url(F.col("path"), F.col("source"), {"greenacres": "https://www.green-acres.fr"}).alias("url"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)-lg-") == 1
    assert found.first()["url"].endswith("&hab_house=true&mx_p=5")
