"""Queries over the store and what feeds it: countries, migration, run log, queues, bands, photos, outlines, addresses and provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.functions import money, text, urls
from hearthlake.functions.geo import ISO_BY_NAME, SOURCE_COUNTRY, bounds, extent, not_at_zero, tolerance
from hearthlake.functions.numbers import bedroom_words
from hearthlake.operators import bands, compaction, merge, pack, probe, view
from hearthlake.operators.filters import row_haystack
from hearthlake.operators.text_index import TextIndex
from hearthlake.operators.versions import SnapshotLog, prune_store
from hearthlake.plans import derived as D
from hearthlake.plans.listing_queries import HI, LO, listing_view_of
from hearthlake.plans.listing_queries import ORACLES as LISTING_ORACLES
from hearthlake.session import shared_dir
from hearthlake.sources import details, files, portals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def sql_map(values: dict[str, str], key: str) -> str:
    return f"CASE {key} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in values.items())} END"


def iso_sql(name: str) -> str:
    codes = ", ".join(f"'{c}'" for c in sorted(set(ISO_BY_NAME.values())))
    return f"CASE WHEN length(trim({name})) = 2 AND upper(trim({name})) IN ({codes}) THEN upper(trim({name})) ELSE {sql_map(ISO_BY_NAME, f'lower(trim({name}))')} END"


RAW = "CASE id % 4 WHEN 0 THEN '{\"country\": \"Italia\"}' WHEN 1 THEN '{\"country\": \"Atlantis\"}' WHEN 2 THEN 'no json' END"
STORED = f"listing.* REPLACE (CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN country END AS country, CASE WHEN id % 8 = 0 THEN '' ELSE external_id END AS external_id), {RAW} AS raw_fields"
W_STORED = f"WITH {D.DUCK_LISTING}, stored AS (SELECT {STORED} FROM listing)"
RAW_ISO = iso_sql("CASE WHEN json_valid(raw_fields) THEN json_extract_string(raw_fields, '$.country') END")
HOME = sql_map(SOURCE_COUNTRY, "coalesce(nullif(source, ''), 'franimo')")


def stored(spark, sf_dir) -> DataFrame:
    rows = D.listings(spark, sf_dir)
    return rows.withColumns({"country": F.expr("CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN country END"), "external_id": F.expr("CASE WHEN id % 8 = 0 THEN '' ELSE external_id END"), "raw_fields": F.expr(RAW)})


@query(W_STORED + f" SELECT id, coalesce({RAW_ISO}, {iso_sql('country')}, {sql_map(SOURCE_COUNTRY, 'source')}) AS country, coalesce(nullif(currency, ''), 'EUR') AS currency FROM stored")
def card_countries(spark, sf_dir):
    return merge.card_values(stored(spark, sf_dir)).select("id", "country", "currency")


@query(
    W_STORED + f""", cards AS (SELECT coalesce(nullif(source, ''), 'franimo') AS source, reference AS external_id, id, coalesce({RAW_ISO}, {iso_sql('country')}, {HOME}) AS country FROM stored)
    SELECT source, external_id, arg_max(country, id) FILTER (country IS NOT NULL) AS country, count(*) AS n FROM cards GROUP BY ALL"""
)
def snapshot_countries(spark, sf_dir):
    seen = merge.with_identity(stored(spark, sf_dir).withColumn("external_id", F.col("reference")))
    cards = merge.card_values(seen).withColumn("ts", F.col("first_seen"))
    counts = cards.groupBy(*merge.KEY).agg(F.count("*").alias("n"))
    return merge.merged_snapshot(cards, ["id"], ["country"]).join(counts, merge.KEY).select(*merge.KEY, "country", "n")


@query(
    W_STORED + f""" SELECT id, coalesce(nullif(source, ''), 'franimo') AS source, coalesce(nullif(external_id, ''), id::VARCHAR) AS external_id, coalesce(nullif(currency, ''), 'EUR') AS currency,
    coalesce(nullif(country, ''), {RAW_ISO}, {HOME}, country) AS country FROM stored"""
)
def backfill(spark, sf_dir):
    return merge.backfilled(stored(spark, sf_dir)).select("id", "source", "external_id", "currency", "country")


@query(W_STORED + f" SELECT id, 'franimo' AS source, id::VARCHAR AS external_id, 'EUR' AS currency, coalesce({RAW_ISO}, 'FR') AS country, price, CAST(NULL AS BIGINT) AS baths FROM stored")
def migrate(spark, sf_dir):
    old = stored(spark, sf_dir).select("id", "price", "raw_fields")
    return merge.migrated(old).select("id", "source", "external_id", "currency", "country", "price", F.col("baths").cast("long").alias("baths"))


@query(
    """WITH runs AS (SELECT o_clerk AS search, max(o_orderdate) AS started_at, count(*) AS seen FROM (SELECT *, 'search ' || (o_custkey % 40) AS o_clerk FROM orders) GROUP BY 1),
    log AS (SELECT row_number() OVER (ORDER BY started_at, search) AS id, * FROM runs WHERE seen % 2 = 0)
    SELECT id, search, seen FROM log UNION ALL SELECT (SELECT count(*) FROM log) + row_number() OVER (ORDER BY started_at, search) AS id, search, seen FROM runs WHERE seen % 2 = 1"""
)
def run_log(spark, sf_dir):
    runs = D.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("search "), F.col("o_custkey") % 40).alias("search")).agg(F.max("o_orderdate").alias("started_at"), F.count("*").alias("seen"))
    log = merge.logged_runs(runs.limit(0).withColumn("id", F.lit(0).cast("long")), runs.where("seen % 2 = 0"), 0)
    return merge.logged_runs(log, runs.where("seen % 2 = 1"), runs.where("seen % 2 = 0").count()).select("id", "search", "seen")


@query(
    f"""WITH {D.DUCK_LISTING}, seen AS (SELECT l_orderkey AS id, min(l_partkey) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT id, pos FROM listing JOIN seen USING (id) WHERE detail_fetched IS NULL ORDER BY pos, id LIMIT 150"""
)
def crawl_queue(spark, sf_dir):
    seen = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS id", "l_partkey AS pos")
    return merge.crawl_queue(D.listings(spark, sf_dir), seen, 150)


@query(
    f"""WITH {D.DUCK_OBSERVATION} SELECT source, external_id, arg_min(page, (band, page, pos, seq, tie)) AS page, min(band) AS band FROM
    (SELECT *, CASE WHEN price <= 30000 THEN 1 WHEN price IS NULL THEN 3 ELSE 2 END AS band FROM observation) GROUP BY ALL"""
)
def band_union(spark, sf_dir):
    """Sightings of three price bands as one list, each listing once."""
    rows = D.observations(spark, sf_dir).withColumn("band", F.expr("CASE WHEN price <= 30000 THEN 1 WHEN price IS NULL THEN 3 ELSE 2 END"))
    return bands.union_of_bands(rows, merge.KEY, ["band", "page", "pos", "seq", "tie"]).select(*merge.KEY, "page", "band")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey || ' q' ELSE '' END AS photos FROM orders")
def photo_join(spark, sf_dir):
    ids = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    photos = ids.where("id % 3 = 0").select("id", F.array(F.concat(F.lit("p"), F.col("id")), F.lit("q")).alias("photos"))
    return view.with_photos(ids, photos).select("id", F.array_join("photos", " ").alias("photos"))


OUTLINES = {"FR": "france", "BG": "bulgaria"}
DEPARTMENTS = {"Ardèche": "a", "Creuse (23)": "c", "Nièvre": "n"}


@query(
    """WITH rows AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'JP' WHEN o_orderkey % 5 = 1 THEN 'BG' ELSE 'FR' END AS country,
        CASE o_orderkey % 4 WHEN 0 THEN 'Ardeche' WHEN 1 THEN 'CREUSE' WHEN 2 THEN 'Unknown' END AS dept_fr, CASE WHEN o_orderkey % 3 = 0 THEN 'nièvre (58)' END AS dept_nl FROM orders)
    SELECT id, CASE country WHEN 'FR' THEN 'france' WHEN 'BG' THEN 'bulgaria' END AS outline,
        CASE WHEN country = 'FR' THEN coalesce(CASE dept_fr WHEN 'Ardeche' THEN 'a' WHEN 'CREUSE' THEN 'c' END, CASE WHEN dept_nl IS NOT NULL THEN 'n' END) END AS department FROM rows"""
)
def outline_join(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'JP' WHEN o_orderkey % 5 = 1 THEN 'BG' ELSE 'FR' END AS country",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Ardeche' WHEN 1 THEN 'CREUSE' WHEN 2 THEN 'Unknown' END AS dept_fr", "CASE WHEN o_orderkey % 3 = 0 THEN 'nièvre (58)' END AS dept_nl",
    )
    countries = spark.createDataFrame(list(OUTLINES.items()), "code string, outline string")
    return view.with_outlines(rows, countries, spark.createDataFrame(list(DEPARTMENTS.items()), "name string, outline string")).select("id", "outline", "department")


@query("SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 61 SECOND, '%Y-%m-%d %H:%M') AS moment FROM orders")
def run_minutes(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), view.minute(F.col("o_orderdate") + F.expr("INTERVAL 61 SECOND")).alias("moment"))


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://www.green-acres.fr/nl/AdvertListingActions/AdvertsListing?advertType=Property&p_n=1&order=price_i&cn=fr&lg=nl&type=properties&hab_house=true&mx_p=' || c_custkey
        WHEN 1 THEN 'https://x.test/list?n=' || c_custkey WHEN 2 THEN 'https://www.domaza.com/a/' || c_custkey ELSE 'https://www.domaza.com/b' END AS url,
    CASE WHEN c_custkey % 4 = 0 THEN 'https://www.green-acres.fr/nl/AdvertListingActions/AdvertsListing?advertType=Property&order=price_i&cn=fr&lg=nl&type=properties&hab_house=true&mx_p=' || c_custkey || '&p_n=3' END AS third FROM customer"""
)
def seed_urls(spark, sf_dir):
    path = "CASE c_custkey % 4 WHEN 0 THEN '/nl/huis?searchQuery=lg-nl-cn-fr-hab_house-on-mx_p-' || c_custkey WHEN 1 THEN 'https://x.test/list?n=' || c_custkey WHEN 2 THEN 'a/' || c_custkey ELSE '/b' END"
    source = "CASE c_custkey % 4 WHEN 0 THEN 'greenacres' WHEN 1 THEN 'homege' ELSE 'domaza' END"
    rows = D.spread(D.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{path} AS path", f"{source} AS source"))
    bases = {k: v.base for k, v in portals.PORTALS.items()}
    found = rows.withColumn("url", urls.seed_url(F.col("path"), F.col("source"), bases))
    return found.select("id", "url", F.when(F.col("source") == "greenacres", urls.listing_api_url(F.col("url"), 3)).alias("third"))


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Nièvre' WHEN 1 THEN 'Puy De Dome' END AS figaro, CASE c_custkey % 4 WHEN 0 THEN '58' END AS figaro_code,
    CASE WHEN c_custkey % 4 = 2 THEN 'Val-d''Oise' END AS acres FROM customer"""
)
def departments(spark, sf_dir):
    address = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'https://x.fr/immobilier-vente-maison-nievre+france.html?p=2' WHEN 1 THEN 'https://x.fr/a/immobilier-vente-bien-puy-de-dome.html' WHEN 2 THEN 'https://y.fr/nl/huis/val-d-oise/' ELSE 'https://y.fr/' END")
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), address.alias("url"))
    figaro = urls.department(F.col("url"), "lefigaro")
    return rows.select("id", figaro["name"].alias("figaro"), figaro["code"].alias("figaro_code"), urls.department(F.col("url"), "greenacres")["name"].alias("acres"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'House of ' || c_name END AS description FROM customer")
def sales_pitch(spark, sf_dir):
    written = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'House of ' || c_name || ' Start a free trial of it for unlimited views.  ' WHEN 1 THEN 'House of ' || c_name ELSE ' Start a free trial now.' END")
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.without_pitch(written).alias("description"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Maison' WHEN 1 THEN 'Terrain' WHEN 2 THEN upper(p_brand[1]) || lower(p_brand[2:]) ELSE 'Maison' END AS kind FROM part")
def kind_names(spark, sf_dir):
    raw = F.expr("CASE p_size % 5 WHEN 0 THEN ' Single Family Residence' WHEN 1 THEN 'LAND' WHEN 2 THEN p_brand WHEN 3 THEN '' END")
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.pretty_type(raw, portals.LEFIGARO_TYPES, "Maison").alias("kind"))


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 20 + p_size WHEN 3 THEN 20 + p_size WHEN 4 THEN 200 + p_size END::BIGINT AS living_m2 FROM part")
def dwelling_areas(spark, sf_dir):
    headline = F.expr(
        """CASE p_size % 6 WHEN 0 THEN '1300 sqm forest, ' || (20 + p_size) || ' sqm derelict house' WHEN 1 THEN '2500 sq.m. Forest for Sale' WHEN 2 THEN (20 + p_size) || ' sqm plot with house'
        WHEN 3 THEN '30 sqm garage; ' || (20 + p_size) || ' sqm villa on an island' WHEN 4 THEN '1,2' || lpad(p_size, 2, '0') || ' sq.m living space, 3 km to Greece' ELSE 'House for sale' END"""
    )
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), details.dwelling_area(headline).alias("living_m2"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'portal_eur' WHEN 1 THEN 'gbp_converted' WHEN 2 THEN 'usd_converted' END AS price_source,
    CASE o_orderkey % 4 WHEN 1 THEN '1.163' WHEN 2 THEN '0.87' END AS fx_rate, CASE o_orderkey % 4 WHEN 0 THEN p WHEN 1 THEN CAST(round_even(p * 1.163::DOUBLE, 0) AS BIGINT) WHEN 2 THEN CAST(round_even(p * 0.87::DOUBLE, 0) AS BIGINT) END::VARCHAR AS price_eur,
    CASE WHEN o_orderkey % 4 IN (0, 1) THEN p::VARCHAR END AS price_gbp FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)"""
)
def price_provenance(spark, sf_dir):
    p = F.floor("o_totalprice")
    m = F.col("o_orderkey") % 4
    pairs = F.create_map(*(x for c, v in details.stated_in(EUR=F.when(m == 0, p), GBP=F.when(m.isin(0, 1), p), USD=F.when(m == 2, p)).items() for x in (F.lit(c), v)))
    stated = F.map_filter(pairs, lambda k, v: v.isNotNull())
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), money.provenance(stated, "bulgarianproperties").alias("kept"))
    return rows.select("id", *(F.try_element_at("kept", F.lit(k)).alias(k) for k in ("price_source", "fx_rate", "price_eur", "price_gbp")))


@query(
    """SELECT c_custkey AS search, CASE c_custkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'error' WHEN 2 THEN 'blocked' WHEN 3 THEN 'error' ELSE 'exact' END AS note, CASE WHEN c_custkey % 5 = 4 THEN 12 END::BIGINT AS live,
    CASE c_custkey % 5 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 1 THEN 'no cards' WHEN 3 THEN 'empty response' ELSE '' END AS detail FROM customer"""
)
def probe_errors(spark, sf_dir):
    m = F.col("c_custkey") % 5
    nothing = F.lit(None).cast("long")
    seeds = D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("search"), F.lit("homege").alias("source"), F.lit(12).cast("long").alias("ours"), F.when(m == 3, " ").otherwise(F.repeat(F.lit("<p>card</p>"), 20)).alias("html"),
        nothing.alias("total"), nothing.alias("result_count"), F.lit(1).cast("long").alias("pages"), F.lit(12).cast("long").alias("cards"), F.lit(24).cast("long").alias("page_size"), F.lit(False).alias("has_skip"),
        F.lit(None).cast("string").alias("catalogue_currency"), F.when(m == 0, "HTTP 403 Forbidden").when(m == 1, "no cards").alias("error"), (m == 2).alias("page_blocked"),
    )
    return probe.probe(seeds).select("search", "note", "live", "detail")


@query("""SELECT 5 AS groups, count(*) FILTER (c_custkey % 5 IN (0, 2)) AS blocked, count(*) FILTER (c_custkey % 5 IN (1, 3)) AS errors, count(*) AS seeds, false AS failed FROM customer""")
def probe_summary(spark, sf_dir):
    report = QUERIES["probe_errors"](spark, sf_dir).withColumn("drift", F.lit(False))
    return probe.drift_summary(report).select(F.lit(5).alias("groups"), "blocked", "errors", "seeds", "failed")


ENVELOPE_SQL = "SELECT page, count(*) AS n FROM (SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS page FROM orders) GROUP BY 1"


@query(f"SELECT 'https://www.green-acres.fr/nl/AdvertListingActions/AdvertsListing?p_n=' || (page + 1) AS url, 4000 + page AS total, CAST(ceil((4000 + page) / 24) AS BIGINT) AS total_pages, n AS cards FROM ({ENVELOPE_SQL})")
def json_envelopes(spark, sf_dir):
    """Result pages as one portal sends them: markup and a count inside JSON."""
    part = F.floor(F.col("o_orderkey") / 20)
    card = F.concat(F.lit('<div class="announce-card" data-advertid="adv0'), F.col("o_orderkey"), F.lit('"><span class="info-price">9 €</span></div>'))
    pages = D.table(spark, sf_dir, "orders").groupBy(part.alias("page")).agg(F.array_join(F.collect_list(card), "").alias("cards"))
    boxed = F.to_json(F.struct(F.col("cards").alias("html"), (F.col("page") + 4000).alias("advertsCount")))
    url = F.concat(F.lit("https://www.green-acres.fr/nl/AdvertListingActions/AdvertsListing?p_n="), F.col("page") + 1)
    found = portals.list_pages(pages.select(url.alias("url"), boxed.alias("html")), "greenacres")
    return found.select("url", "total", "total_pages", F.col("cards").cast("long").alias("cards"))


@query(
    """SELECT c_custkey AS id, 'https://p.test/l?pricefrom=5&priceto=' || c_custkey AS priced, c_custkey % 2 = 0 AS allowed, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'b ' || c_custkey END AS b,
    CASE WHEN c_custkey % 2 = 0 THEN 'https://p.test/x' ELSE 'https://p.test/l' END AS whole FROM (SELECT c_custkey FROM customer)"""
)
def url_rules(spark, sf_dir):
    i = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(i.alias("id"))
    i = F.col("id")
    asked = F.concat(F.lit("https://p.test/l?a=1&b=b+"), i)
    return rows.select(
        "id", urls.with_prices(F.concat(F.lit("https://p.test/l?pricefrom=1&priceto="), i + 9), F.lit(5), i).alias("priced"), (i % 2 == 0).alias("allowed"),
        urls.query_map(F.when(i % 3 != 0, asked))["b"].alias("b"), urls.resolved(F.when(i % 2 == 0, "/x").otherwise("https://p.test/l"), "https://p.test/").alias("whole"),
    )


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 12 END::BIGINT AS bedrooms, 'plot size' AS label, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey / 10.0 END AS lat, '["' || c_custkey || '","' || c_mktsegment || '"]' AS row FROM customer"""
)
def text_rules(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer")
    words = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'a Three-bedroom house' WHEN 1 THEN 'has 12 bedrooms' ELSE 'rooms' END")
    lat = F.when(F.col("c_custkey") % 2 == 0, F.lit(0.00001)).otherwise(F.col("c_custkey") / 10.0)
    packed = pack.as_json_rows(rows.select(F.col("c_custkey").alias("id"), "c_mktsegment"))
    found = rows.select(F.col("c_custkey").alias("id"), bedroom_words(words).alias("bedrooms"), text.label(F.lit("  Plot  size : ")).alias("label"), not_at_zero(lat, lat)[0].alias("lat"))
    return found.join(packed, "id")


JOINS = {
    "/a/b": "https://p.test/a/b", "x.php?i=1#t": "https://p.test/d/e/x.php?i=1#t", "../x": "https://p.test/d/x", "../../../x/": "https://p.test/x/", "./": "https://p.test/d/e/", "..": "https://p.test/d/", "?p=2": "https://p.test/d/e/f.html?p=2",
    "#top": "https://p.test/d/e/f.html?q=1#top", "//cdn.test/y": "https://cdn.test/y", "http://z.test": "http://z.test", "": "https://p.test/d/e/f.html?q=1", "mailto:a@b.c": "mailto:a@b.c",
}


@query(f"SELECT c_custkey AS id, list_extract([{', '.join(f"'{v}'" for v in JOINS.values())}], CAST(c_custkey % {len(JOINS)} + 1 AS INT)) AS url FROM customer")
def joined_urls(spark, sf_dir):
    reference = F.element_at(F.array(*map(F.lit, JOINS)), (F.col("c_custkey") % len(JOINS) + 1).cast("int"))
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), urls.joined(reference, F.lit("https://p.test/d/e/f.html?q=1")).alias("url"))


@query(
    """SELECT c_custkey AS id, (-1 - c_nationkey)::DOUBLE AS west, (2 + c_nationkey)::DOUBLE AS east, 40::DOUBLE AS south, (41 + c_custkey % 3)::DOUBLE AS north,
    greatest(0.004::DOUBLE, least(0.03::DOUBLE, greatest(3 + 2 * c_nationkey, 1 + c_custkey % 3)::DOUBLE / 600)) AS tolerance, CASE WHEN c_custkey % 4 = 0 THEN '—' ELSE replace(format('{:,}', c_custkey * 2), ',', '.') END AS shown
    FROM customer"""
)
def outline_bounds(spark, sf_dir):
    n, i = F.col("c_nationkey").cast("double"), F.col("c_custkey")
    ring = F.array(F.array(-1 - n, F.lit(40.0)), F.array(n + 2, 41.0 + i % 3), F.array(F.lit(0.0), F.lit(40.5)))
    rows = D.table(spark, sf_dir, "customer").select(i.alias("id"), F.array(ring).alias("rings"), text.dutch_number(F.when(i % 4 != 0, i * 2 + 0.1)).alias("shown"))
    return rows.select("id", bounds(F.col("rings")).alias("b"), tolerance(extent(F.col("rings"))).alias("tolerance"), "shown").select("id", "b.*", "tolerance", "shown")


@query("SELECT 'search ' || n_nationkey AS search FROM nation WHERE n_nationkey >= 10")
def unknown_searches(spark, sf_dir):
    specs = D.table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("search "), F.col("n_nationkey")).alias("search"))
    return files.unknown_searches(specs, [f"search {i}" for i in range(25)])


def pruned_store(spark: SparkSession, sf_dir: str) -> SnapshotLog:
    """The listings and their history as version 0, pruned by price as version 1."""
    log = SnapshotLog(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    history = D.history(spark, sf_dir).select("listing_id", "price")
    log.commit({"listings": D.listings(spark, sf_dir).select("id", "price"), "history": history, "runs": D.table(spark, sf_dir, "nation").select("n_name")}, "load")
    prune_store(log, ["history"], LO, HI)
    return log


W_PRUNED = f"WITH {D.DUCK_LISTING}, {D.DUCK_HISTORY}, kept AS (SELECT id FROM listing WHERE price IS NULL OR price BETWEEN {LO} AND {HI})"


@query(
    W_PRUNED
    + """ SELECT 0::BIGINT AS version, 'load' AS note, 'listings' AS tbl, (SELECT count(*) FROM listing) AS rows, false AS shared
    UNION ALL SELECT 0, 'load', 'history', (SELECT count(*) FROM history), false UNION ALL SELECT 0, 'load', 'runs', (SELECT count(*) FROM nation), false
    UNION ALL SELECT 1, 'prune', 'listings', (SELECT count(*) FROM kept), false UNION ALL SELECT 1, 'prune', 'history', (SELECT count(*) FROM history WHERE listing_id IN (FROM kept) OR listing_id NOT IN (SELECT id FROM listing)), false
    UNION ALL SELECT 1, 'prune', 'runs', (SELECT count(*) FROM nation), true"""
)
def store_versions(spark, sf_dir):
    return pruned_store(spark, sf_dir).versions()


@query(W_PRUNED + " SELECT 0 AS version, id, price FROM listing UNION ALL SELECT 1, id, price FROM listing WHERE id IN (FROM kept)")
def store_as_of(spark, sf_dir):
    """The listings before and after they were pruned, both read from the log."""
    log = pruned_store(spark, sf_dir)
    return log.read("listings", 0).select(F.lit(0).alias("version"), "id", "price").unionByName(log.read("listings", 1).select(F.lit(1).alias("version"), "id", "price"))


def indexed(spark: SparkSession, sf_dir: str, words: str) -> DataFrame:
    """The listings still there that have all words, by the index: only candidates are joined to the listings."""
    rows = listing_view_of(spark, sf_dir)
    index = TextIndex(spark)
    index.add(rows, "id", row_haystack())
    return rows.where("gone_at IS NULL").join(index.search(words), "id", "left_semi").select("id")


@query(LISTING_ORACLES["search_text"])
def search_indexed(spark, sf_dir):
    return indexed(spark, sf_dir, "  Near BUILDING ")


@query(LISTING_ORACLES["search_text"].replace("'near'", "'fr'").replace("'building'", "'achinery'"))
def search_indexed_short(spark, sf_dir):
    """A word that is shorter than a gram is verified among the candidates of the other one."""
    return indexed(spark, sf_dir, "fr achinery")


@query("SELECT count(*) AS files, sum(strlen(html) + 1)::BIGINT AS bytes, count(*) AS pages, count(DISTINCT html) AS different, 0::BIGINT AS left_over, true AS fewer FROM pages WHERE html IS NOT NULL")
def pack_files(spark, sf_dir):
    """Every raw page as a file of its own, packed by size: what was there, what is readable after it, and what is left of the files."""
    root = f"{shared_dir(spark)}/pack-{uuid.uuid4().hex}"
    pages = D.table(spark, sf_dir, "pages").where("html IS NOT NULL")
    # Some thousand files a folder. A folder is written by one task, so that it is committed as one and not file by file.
    folders = -(-pages.count() // 1000) or 1
    shelf = F.pmod(F.xxhash64("page_id"), F.lit(folders)).alias("shelf")
    pages.select("html", shelf).repartition("shelf").write.option("maxRecordsPerFile", 1).partitionBy("shelf").text(f"{root}/in")
    archive = compaction.PageArchive(spark, f"{root}/archive")
    report = archive.pack(f"{root}/in", target=1 << 20)
    read = archive.pages().agg(F.count("html").alias("pages"), F.count_distinct("html").alias("different"))
    left = compaction.file_sizes(spark, f"{root}/in").agg(F.count("*").alias("left_over"))
    # One row of each, with columns of its own.
    whole = report.unionByName(read, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)
    whole = whole.agg(*(F.max(c).alias(c) for c in ("files", "bytes", "packed", "pages", "different", "left_over")))
    return whole.select("files", "bytes", "pages", "different", "left_over", (F.col("packed") < F.col("files")).alias("fewer"))
