"""Queries over numbers, prices, texts and addresses built from the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake.functions import cleaning, money, numbers, text, urls
from hearthlake.functions.geo import tolerance
from hearthlake.plans import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Whole numbers as portals write them.
WRITTEN = """CASE o_orderkey % 9 WHEN 0 THEN CAST(t AS {s}) || '.' || lpad(CAST(r AS {s}), 3, '0') WHEN 1 THEN CAST(t AS {s}) || ',' || lpad(CAST(r AS {s}), 3, '0')
    WHEN 2 THEN CAST(t AS {s}) || ' ' || lpad(CAST(r AS {s}), 3, '0') WHEN 3 THEN CAST(t AS {s}) || ',5' WHEN 4 THEN CAST(t AS {s}) || '.25' WHEN 5 THEN 'n/a'
    WHEN 6 THEN CAST(t AS {s}) || ',' || lpad(CAST(r AS {s}), 3, '0') || '.00' WHEN 7 THEN NULL ELSE CAST(t * 1000 + r AS {s}) END"""
PARTS = "o_orderkey, o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS t, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS r"
W_WRITTEN = f"WITH parts AS (SELECT {PARTS} FROM orders), written AS (SELECT o_orderkey AS id, o_orderpriority, {WRITTEN.format(s='VARCHAR')} AS s FROM parts)"
ALL_DIGITS = "TRY_CAST(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), '') AS BIGINT)"
ROUND = "CAST(round_even(TRY_CAST({0} AS DOUBLE), 0) AS BIGINT)"


def written(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").selectExpr(*D.split_select(PARTS))
    return rows.selectExpr("o_orderkey AS id", "o_orderpriority", f"{WRITTEN.format(s='STRING')} AS s")


EUROPEAN_RAW = "nullif(regexp_extract(s, '([0-9]+(?:[.,][0-9]+)*)', 1), '')"
GROUPED = "(regexp_matches({0}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') OR regexp_matches({0}, '^[0-9]{{1,3}}(,[0-9]{{3}})+$'))"
DOT = "regexp_replace(s, '[€$£ ]', '', 'g')"


@query(
    W_WRITTEN
    + f""" SELECT id, {ALL_DIGITS.format("s")} AS franimo,
    CASE WHEN contains(s, ',') AND NOT contains(s, '.') THEN {ROUND.format("replace(replace(s, ' ', ''), ',', '.')")} ELSE {ALL_DIGITS.format("s")} END AS lefigaro,
    CASE WHEN regexp_matches({DOT}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') THEN {ALL_DIGITS.format(DOT)} WHEN contains({DOT}, ',') AND NOT contains({DOT}, '.') THEN {ROUND.format(f"replace({DOT}, ',', '.')")} ELSE {ALL_DIGITS.format(DOT)} END AS greenacres,
    {ROUND.format("nullif(regexp_extract(replace(s, ',', ''), '([0-9]+(?:[.][0-9]+)?)', 1), '')")} AS homege,
    {ROUND.format("nullif(regexp_extract(regexp_replace(s, '[, ]', '', 'g'), '([0-9]+(?:[.][0-9]+)?)', 1), '')")} AS bulgarianproperties,
    {ALL_DIGITS.format("regexp_extract(s, '([0-9]+(?:[.\\s,][0-9]+)*)', 1)")} AS centrarium,
    CASE WHEN {GROUPED.format(EUROPEAN_RAW)} OR (contains({EUROPEAN_RAW}, ',') AND contains({EUROPEAN_RAW}, '.')) THEN {ALL_DIGITS.format(EUROPEAN_RAW)} ELSE {ROUND.format(f"replace({EUROPEAN_RAW}, ',', '.')")} END AS abruzzoruralproperty,
    TRY_CAST(replace(s, ',', '.') AS DOUBLE) AS decimal FROM written"""
)
def num_dialects(spark, sf_dir):
    s = F.col("s")
    names = ("franimo", "lefigaro", "greenacres", "homege", "bulgarianproperties", "centrarium", "abruzzoruralproperty")
    return written(spark, sf_dir).select("id", *(numbers.DIALECTS[n](s).alias(n) for n in names), numbers.decimal(s).alias("decimal"))


AREA_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'Area: ' || t || ' m2' WHEN 1 THEN t || '.6m²' WHEN 2 THEN t || ' sqm of garden' WHEN 3 THEN 'three bedrooms, 2 hectares' ELSE '0.00 sqm, 19' || lpad(CAST(r % 100 AS {s}), 2, '0') END"
UNIT = "(?:m²|m2|sq\\.?\\s*m|sqm)"


@query(
    f"""WITH texts AS (SELECT o_orderkey AS id, {AREA_TEXT.format(s="VARCHAR")} AS x FROM (SELECT {PARTS} FROM orders))
    SELECT id, {ALL_DIGITS.format(f"regexp_extract(x, '(?i)([0-9][0-9\\s.,]*)\\s*{UNIT}', 1)")} AS area, {ALL_DIGITS.format("regexp_extract(x, '^\\s*([0-9.,\\s]+)', 1)")} AS leading,
    CASE WHEN TRY_CAST(regexp_extract(x, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*{UNIT}', 1) AS DOUBLE) > 0 THEN {ROUND.format(f"regexp_extract(x, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*{UNIT}', 1)")} END AS nearest,
    CASE WHEN contains(x, 'hectares') THEN 20000::BIGINT END AS hectares, CASE WHEN contains(x, 'three bedrooms') THEN 3::BIGINT END AS bedrooms,
    TRY_CAST(nullif(regexp_extract(x, '\\b((?:19|20)[0-9]{{2}})\\b', 1), '') AS BIGINT) AS year FROM texts"""
)
def num_areas(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").selectExpr(*D.split_select(PARTS)).selectExpr("o_orderkey AS id", f"{AREA_TEXT.format(s='STRING')} AS x")
    x = F.col("x")
    return rows.select("id", numbers.area(x).alias("area"), numbers.leading_area(x).alias("leading"), numbers.decimal_area(x, zero_is_null=True).alias("nearest"), numbers.hectares(x).alias("hectares"), numbers.bedroom_words(x).alias("bedrooms"), numbers.year(x).alias("year"))


PRICE_TEXT = "CASE o_orderkey % 7 WHEN 0 THEN '€ ' || p WHEN 1 THEN p || ' EUR' WHEN 2 THEN '£ ' || p || ' GBP' WHEN 3 THEN p || ' DH' WHEN 4 THEN '$ ' || p || ' USD' WHEN 5 THEN 'price on request' ELSE p || ' GEL or ' || p || ' $' END"
W_PRICE = f"WITH texts AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, p, {PRICE_TEXT} AS x FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders))"


def price_texts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) AS p")
    return rows.selectExpr("o_orderkey AS id", "p", f"{PRICE_TEXT} AS x")


@query(
    W_PRICE
    + """ SELECT id, CASE WHEN k IN (0, 1, 4, 6) THEN p END AS homege_amount, CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'EUR' WHEN 4 THEN 'USD' WHEN 6 THEN 'GEL' END AS homege_currency,
    CASE WHEN k IN (1, 3) THEN p END AS mubawab_amount, CASE k WHEN 1 THEN 'EUR' WHEN 3 THEN 'MAD' END AS mubawab_currency,
    CASE WHEN k IN (0, 2, 4) THEN p END AS bulgarian_amount, CASE k WHEN 0 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 4 THEN 'USD' END AS bulgarian_currency,
    CASE WHEN k IN (0, 2) THEN p END AS ok_amount, CASE k WHEN 0 THEN 'EUR' WHEN 2 THEN 'GBP' END AS ok_currency, CASE WHEN k IN (0, 1) THEN p END AS holprop_eur, CASE WHEN k = 2 THEN p END AS holprop_gbp FROM texts"""
)
def money_dialects(spark, sf_dir):
    x = F.col("x")
    rows = price_texts(spark, sf_dir).withColumns({n: money.money(x, s) for n, s in (("homege", "homege"), ("mubawab", "mubawab"), ("bulgarian", "bulgarianproperties"), ("ok", "ok_bulgaria"))}).withColumn("stated", money.amounts(x, "holprop"))
    both = [F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in ("homege", "mubawab", "bulgarian", "ok") for part in ("amount", "currency")]
    return rows.select("id", *both, F.col("stated")["EUR"].alias("holprop_eur"), F.col("stated")["GBP"].alias("holprop_gbp"))


@query(
    W_PRICE
    + """ SELECT id, CAST(round_even(p * 0.85::DOUBLE, 0) AS BIGINT) AS usd_akiya, CAST(round_even(p / 170.0::DOUBLE, 0) AS BIGINT) AS jpy_akiya, CAST(round_even(p / 3.03::DOUBLE, 0) AS BIGINT) AS gel_homege,
    CAST(round_even(p / 10.9::DOUBLE, 0) AS BIGINT) AS mad_mubawab, CAST(round_even(p * 1.163::DOUBLE, 0) AS BIGINT) AS gbp_bulgarian, CAST(round_even(p * 0.87::DOUBLE, 0) AS BIGINT) AS usd_domaza, CAST(round_even(p * 1.166::DOUBLE, 0) AS BIGINT) AS gbp_ok, p AS eur FROM texts"""
)
def fx_rates(spark, sf_dir):
    p = F.col("p")
    asked = {"usd_akiya": ("USD", "akiyaportal"), "jpy_akiya": ("JPY", "akiyaportal"), "gel_homege": ("GEL", "homege"), "mad_mubawab": ("MAD", "mubawab"), "gbp_bulgarian": ("GBP", "bulgarianproperties"), "usd_domaza": ("USD", "domaza"), "gbp_ok": ("GBP", "ok_bulgaria"), "eur": ("EUR", "homege")}
    return price_texts(spark, sf_dir).select("id", *(money.to_euro(p, F.lit(c), s).alias(n) for n, (c, s) in asked.items()))


@query(
    W_PRICE
    + """ SELECT id, CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 4 THEN CAST(round_even(p * 0.85::DOUBLE, 0) AS BIGINT) WHEN 6 THEN CAST(round_even(p / 3.03::DOUBLE, 0) AS BIGINT) END AS price, 'EUR' AS currency,
    CASE k WHEN 0 THEN 'portal_eur' WHEN 1 THEN 'portal_eur' WHEN 4 THEN 'usd_converted' WHEN 6 THEN 'gel_converted' END AS origin FROM texts"""
)
def money_priced(spark, sf_dir):
    return price_texts(spark, sf_dir).select("id", money.priced(money.money(F.col("x"), "homege"), "homege").alias("m")).select("id", "m.price", "m.currency", "m.origin")


W_CLEAN = f"WITH {D.DUCK_LISTING}"


@query(
    W_CLEAN
    + """ SELECT id, CASE WHEN lower(type) NOT IN ('1-urgent', '2-high') THEN living_m2 END AS living_of_house,
    CASE WHEN NOT coalesce(living_m2 > 2000 OR (bedrooms IS NULL AND land_m2 IS NULL AND living_m2 > 500), false) THEN living_m2 END AS plausible,
    CASE WHEN land_m2 IS NULL AND living_m2 >= 200 THEN NULL ELSE living_m2 END AS living_after, CASE WHEN land_m2 IS NULL AND living_m2 >= 200 THEN living_m2 ELSE land_m2 END AS land_after,
    nullif(land_m2, living_m2) AS land_not_echoed FROM listing"""
)
def clean_areas(spark, sf_dir):
    c = F.col
    living, land, _ = cleaning.plot_as_land(c("living_m2"), c("land_m2"), least=200)
    return D.listings(spark, sf_dir).select(
        "id",
        cleaning.living_of_land(c("type"), c("living_m2"), ("1-urgent", "2-high")).alias("living_of_house"),
        cleaning.plausible_living(c("type"), c("living_m2"), F.lit(None).cast("int"), c("bedrooms"), c("land_m2")).alias("plausible"),
        living.alias("living_after"),
        land.alias("land_after"),
        cleaning.land_unless_echoed(c("living_m2"), c("land_m2")).alias("land_not_echoed"),
    )


@query("SELECT page_id, sha1(url) AS key, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INT), 1)::INT AS page, NOT regexp_matches(url, '(?i)/Search/|search\\?|[?&](?:page|minprice|maxprice|ID|srtby|hw_page)=') AS allowed FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return D.table(spark, sf_dir, "pages").select("page_id", urls.cache_key(url).alias("key"), F.parse_url(url, F.lit("HOST")).alias("host"), urls.page_number(url, "lefigaro").alias("page"), urls.robots_allowed(url).alias("allowed"))


@query("SELECT page_id, CASE WHEN nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') IS NOT NULL THEN trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) END AS title, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(html, '<li>'))))::BIGINT AS items FROM pages")
def page_title(spark, sf_dir):
    html = F.col("html")
    return D.table(spark, sf_dir, "pages").select("page_id", text.node_text(numbers.found(html, "<title>([^<]*)</title>")).alias("title"), F.regexp_count(html, F.lit("<li>")).cast("long").alias("items"))


@query("SELECT page_id, contains(lower(html[:8000]), 'article') AS marked, length(html) AS n FROM pages")
def page_markers(spark, sf_dir):
    html = F.col("html")
    return D.table(spark, sf_dir, "pages").select("page_id", F.contains(F.lower(F.substring(html, 1, 8000)), F.lit("article")).alias("marked"), F.length(html).cast("long").alias("n"))


@query("SELECT page_id, url AS decoded FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 3 = 0")
def base64_href(spark, sf_dir):
    plain = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#"), "url")).otherwise(F.col("url"))
    token = F.regexp_replace(F.base64(plain.cast("binary")), "[=\\s]", "")
    return D.table(spark, sf_dir, "pages").select("page_id", urls.decoded_href(token).alias("decoded"))


@query("SELECT n_nationkey AS id, count(*) AS n FROM nation JOIN customer ON lower(strip_accents(n_name)) = lower('NATION_' || (c_custkey % 25)) GROUP BY 1")
def dept_fold_join(spark, sf_dir):
    nations = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.fold(F.col("n_name")).alias("name"))
    customers = D.table(spark, sf_dir, "customer").select(text.fold(F.concat(F.lit("Nâtion_"), F.col("c_custkey") % 25, F.lit(" (dept)"))).alias("name"))
    return customers.join(F.broadcast(nations), "name").groupBy("id").agg(F.count("*").alias("n"))  # nation: 25 rows by definition


@query(r"SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_terms, contains(lower(text), 'the') AND contains(lower(text), 'and') AS has_terms FROM documents")
def text_terms(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.terms(F.col("text"))).cast("long").alias("n_terms"), text.contains_all(F.lower(F.col("text")), text.search_terms("The AND")).alias("has_terms"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fact(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unlabelled(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id").join(D.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(W_CLEAN + " SELECT id, coalesce(nullif(dept_nl, ''), nullif(region, ''), nullif(country, ''), '') AS hint, greatest(0.004, least(0.03, coalesce(land_m2, 0) / 600.0)) AS tolerance FROM listing")
def location_hint(spark, sf_dir):
    c = F.col
    return D.listings(spark, sf_dir).select("id", text.location_hint(c("dept_nl"), c("region"), c("country")).alias("hint"), tolerance(F.coalesce(c("land_m2"), F.lit(0)).cast("double")).alias("tolerance"))
