"""Queries over listings, their view and their sightings, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.functions.geo import clean_coordinate, country_for, plottable, project
from hearthlake.operators import bands, facets, gone, merge, pack, probe, view
from hearthlake.operators.filters import FACETS, FilterSpec, ingest_skip, matching
from hearthlake.operators.selection import upper_medians
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


def listing_view_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.listing_view(D.listings(spark, sf_dir), D.history(spark, sf_dir), D.bridge(spark, sf_dir), D.ASOF)


VIEW_COLUMNS = "id, source, currency, price, round(eur_m2, 6) AS eur_m2, round(eur_m2_land, 6) AS eur_m2_land, first_price, n_changes, days_known, searches, price_drop"
W_VIEW = f"WITH {D.DUCK_VIEW} "
BASIC = FilterSpec(price_min=50_000, price_max=250_000, bedrooms_min=2, living_min=60)
BASIC_SQL = "price >= 50000 AND price <= 250000 AND bedrooms >= 2 AND living_m2 >= 60 AND gone_at IS NULL"


@query(W_VIEW + f"SELECT {VIEW_COLUMNS} FROM view")
def listing_view(spark, sf_dir):
    return listing_view_of(spark, sf_dir).selectExpr(*D.split_select(VIEW_COLUMNS))


@query(W_VIEW + f"SELECT id, price, round(eur_m2, 6) AS eur_m2 FROM view WHERE {BASIC_SQL} ORDER BY view.eur_m2 NULLS LAST, id LIMIT 300")
def search_basic(spark, sf_dir):
    rows = matching(listing_view_of(spark, sf_dir), BASIC)
    return view.sorted_page(rows, "eur_m2").selectExpr("id", "price", "round(eur_m2, 6) AS eur_m2")


@query(W_VIEW + "SELECT id, price, price_drop FROM view WHERE price_drop > 0 AND eur_m2 <= 3000 AND land_m2 >= 500 AND coalesce(living_m2, 0) <> 0")
def search_drops(spark, sf_dir):
    spec = FilterSpec(only_drops=True, eur_m2_max=3000, land_min=500, need_living=True, hide_gone=False)
    return matching(listing_view_of(spark, sf_dir), spec).select("id", "price", "price_drop")


@query(W_VIEW + "SELECT id, days_known FROM view WHERE coalesce(days_known, 0) <= 400 AND gone_at IS NULL")
def search_new(spark, sf_dir):
    return matching(listing_view_of(spark, sf_dir), FilterSpec(only_new_days=400)).select("id", "days_known")


HAY_SQL = "lower(concat_ws(' ', nullif(place,''), nullif(type,''), nullif(dept_nl,''), nullif(region,''), nullif(description,''), nullif(features,''), nullif(agent,''), nullif(reference,''), nullif(snippet,''), nullif(source,''), nullif(country,'')))"


@query(W_VIEW + f"SELECT id FROM view WHERE contains({HAY_SQL}, 'near') AND contains({HAY_SQL}, 'building') AND gone_at IS NULL")
def search_text(spark, sf_dir):
    return matching(listing_view_of(spark, sf_dir), FilterSpec(query="  Near BUILDING ")).select("id")


CHOSEN = FilterSpec(price_max=200_000, chosen={"source": ("homege", "domaza", "franimo"), "searches": ("RF", "AF"), "energy_label": ("O", "F")})
CHOSEN_SQL = {
    "source": "source IN ('homege', 'domaza', 'franimo')",
    "searches": "list_has_any(string_split(coalesce(searches, ''), ','), ['RF', 'AF'])",
    "energy_label": "coalesce(nullif(energy_label, ''), '—') IN ('O', 'F')",
}
CHOSEN_BASE = "price <= 200000 AND gone_at IS NULL"


@query(W_VIEW + f"SELECT id FROM view WHERE {CHOSEN_BASE} AND " + " AND ".join(CHOSEN_SQL.values()))
def search_facets(spark, sf_dir):
    return matching(listing_view_of(spark, sf_dir), CHOSEN).select("id")


def facet_sql(name: str) -> str:
    others = " AND ".join([CHOSEN_BASE, *(p for k, p in CHOSEN_SQL.items() if k != name)])
    if name == "searches":
        return f"SELECT value, count(*) AS n FROM (SELECT unnest(string_split(coalesce(searches, ''), ',')) AS value FROM view WHERE {others}) WHERE value <> '' GROUP BY value"
    return f"SELECT coalesce(nullif({name}, ''), '—') AS value, count(*) AS n FROM view WHERE {others} GROUP BY 1"


for _name in FACETS:
    QUERIES[f"facet_{_name}"] = lambda spark, sf_dir, name=_name: facets.facet(listing_view_of(spark, sf_dir), CHOSEN, name)
    ORACLES[f"facet_{_name}"] = W_VIEW + facet_sql(_name)


@query(W_VIEW + " UNION ALL ".join(f"SELECT '{n}' AS facet, value, n FROM ({facet_sql(n)})" for n in FACETS))
def facets_all(spark, sf_dir):
    return facets.facet_counts(listing_view_of(spark, sf_dir), CHOSEN).select("facet", "value", "n")


@query(
    W_VIEW
    + """, counts AS (SELECT 'type' AS facet, coalesce(nullif(type, ''), '—') AS value, count(*) AS n, min(id) AS first_id FROM view WHERE gone_at IS NULL GROUP BY 2
        UNION ALL SELECT 'dept_nl', coalesce(nullif(dept_nl, ''), '—'), count(*), min(id) FROM view WHERE gone_at IS NULL GROUP BY 2)
    SELECT facet, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, first_id) AS place FROM counts) WHERE place <= 8"""
)
def facet_top_values(spark, sf_dir):
    counts = facets.facet_counts(listing_view_of(spark, sf_dir), FilterSpec(), ("type", "dept_nl"))
    return facets.top_values(counts).select("facet", "value", "n", F.col("place").cast("long").alias("place"))


PRETTY_SQL = "CASE value " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.SOURCE_NAMES.items()) + " ELSE 'New Portal X' END"


@query(
    W_VIEW
    + f""", counts AS (SELECT source AS value, count(*) AS n FROM view WHERE gone_at IS NULL GROUP BY 1)
    SELECT value, n, {PRETTY_SQL} AS label, row_number() OVER (ORDER BY coalesce(nullif(list_position([{", ".join(f"'{k}'" for k in D.SOURCE_NAMES)}], value), 0), 999)) AS place FROM counts"""
)
def facet_source_order(spark, sf_dir):
    from hearthlake.functions.text import pretty_source

    counts = facets.facet_counts(listing_view_of(spark, sf_dir), FilterSpec(), ("source",))
    return facets.top_values(counts).select("value", "n", pretty_source(F.col("value")).alias("label"), F.col("place").cast("long").alias("place"))


@query(
    W_VIEW
    + f"""SELECT count(*) FILTER ({BASIC_SQL}) AS n, count(*) AS total,
        list_sort(list(price) FILTER ({BASIC_SQL} AND price IS NOT NULL))[count(price) FILTER ({BASIC_SQL}) // 2 + 1] AS median_price,
        round(list_sort(list(eur_m2) FILTER ({BASIC_SQL} AND eur_m2 IS NOT NULL))[count(eur_m2) FILTER ({BASIC_SQL}) // 2 + 1], 6) AS median_eur_m2,
        count(*) FILTER ({BASIC_SQL} AND price_drop > 0) AS drops, count(*) FILTER ({BASIC_SQL} AND detail_fetched IS NULL) AS without_detail FROM view"""
)
def summary(spark, sf_dir):
    return facets.summary(listing_view_of(spark, sf_dir), BASIC).withColumn("median_eur_m2", F.round("median_eur_m2", 6))


@query(W_VIEW + "SELECT source, list_sort(list(price) FILTER (price IS NOT NULL))[count(price) // 2 + 1] AS median_price FROM view GROUP BY source")
def median_price_by_source(spark, sf_dir):
    return upper_medians(listing_view_of(spark, sf_dir), "price", ["source"]).withColumnRenamed("price", "median_price")


@query(f"WITH {D.DUCK_LISTING} SELECT id, agent, row_number() OVER (ORDER BY nullif(agent, '') DESC NULLS LAST, id) AS place FROM listing ORDER BY place LIMIT 500")
def sort_blanks_last(spark, sf_dir):
    rows = view.sorted_page(D.listings(spark, sf_dir).select("id", "agent"), "agent", ascending=False, limit=500)
    from pyspark.sql import Window as W

    # The window sees the page's 500 rows only.
    return rows.withColumn("place", F.row_number().over(W.orderBy(view.blanks_last("agent", False), "id")).cast("long"))


@query(f"WITH {D.DUCK_LISTING} SELECT id, price FROM listing ORDER BY price NULLS LAST, id LIMIT 500 OFFSET 300")
def sort_second_page(spark, sf_dir):
    return view.sorted_page(D.listings(spark, sf_dir).select("id", "price"), "price", limit=500, offset=300)


@query(W_VIEW + "SELECT id, source, price, searches FROM view WHERE id = (SELECT min(o_orderkey) FROM orders)")
def point_lookup(spark, sf_dir):
    wanted = D.table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    # The id reaches all three scans, so nothing of other listings is grouped or joined.
    own = [rows.where(F.col(key) == wanted) for rows, key in ((D.listings(spark, sf_dir), "id"), (D.history(spark, sf_dir), "listing_id"), (D.bridge(spark, sf_dir), "listing_id"))]
    return view.listing_view(*own, D.ASOF).select("id", "source", "price", "searches")


@query(f"WITH {D.DUCK_LISTING} SELECT id FROM listing WHERE NOT (CASE WHEN price IS NULL THEN true ELSE price > 200000 OR price < 20000 END)")
def ingest_kept(spark, sf_dir):
    return D.listings(spark, sf_dir).where(~ingest_skip(F.col("price"), priceless=True, above=200_000, below=20_000)).select("id")


@query(f"WITH {D.DUCK_LISTING} SELECT count(*) AS total FROM listing")
def meta_total(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").agg(F.count("*").alias("total"))


@query(f"WITH {D.DUCK_LISTING} SELECT source, count(*) AS n FROM listing GROUP BY source")
def meta_sources(spark, sf_dir):
    return D.listings(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {D.DUCK_BRIDGE} SELECT search, count(*) AS n FROM bridge GROUP BY search")
def meta_searches(spark, sf_dir):
    return D.bridge(spark, sf_dir).groupBy("search").agg(F.count("*").alias("n"))


def classified_of(spark, sf_dir) -> DataFrame:
    return merge.classified(D.observations(spark, sf_dir), None, D.SIGHTING_ORDER)


W_CLASSIFIED = f"WITH {D.DUCK_CLASSIFIED} "


@query(W_CLASSIFIED + "SELECT status, count(*) AS n FROM classified GROUP BY status")
def status_counts(spark, sf_dir):
    return classified_of(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(W_CLASSIFIED + "SELECT source, external_id, ts, page, pos, seq, price, before, status FROM classified WHERE status <> 'same'")
def price_history(spark, sf_dir):
    return merge.new_history(classified_of(spark, sf_dir)).select("source", "external_id", "ts", "page", "pos", "seq", "price", "before", "status")


RUN_SQL = """SELECT search, year(ts) AS year, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'price_drop') AS price_drops, count(*) FILTER (status = 'price_rise') AS price_rises,
    count(*) FILTER (status = 'same') AS same, count(DISTINCT listing_id) AS seen FROM classified GROUP BY 1, 2"""


def runs_of(spark, sf_dir) -> DataFrame:
    return merge.run_counters(classified_of(spark, sf_dir).withColumn("year", F.year("ts").cast("long")), ["search", "year"])


@query(W_CLASSIFIED + RUN_SQL)
def run_counters(spark, sf_dir):
    return runs_of(spark, sf_dir)


@query(W_CLASSIFIED + f"SELECT search, year, seen FROM ({RUN_SQL}) ORDER BY year DESC, search LIMIT 20")
def meta_runs(spark, sf_dir):
    return runs_of(spark, sf_dir).orderBy(F.desc("year"), "search").limit(20).select("search", "year", "seen")


@query(
    f"""WITH {D.DUCK_OBSERVATION} SELECT source, external_id, arg_max(price, (ts, page, pos, seq, tie)) FILTER (price IS NOT NULL) AS price,
        arg_max(living_m2, (ts, page, pos, seq, tie)) FILTER (living_m2 IS NOT NULL) AS living_m2, arg_max(type, (ts, page, pos, seq, tie)) FILTER (type IS NOT NULL) AS type,
        min(ts) AS first_seen, max(ts) AS last_seen FROM observation GROUP BY ALL"""
)
def merge_snapshot(spark, sf_dir):
    return merge.merged_snapshot(D.observations(spark, sf_dir), D.SIGHTING_ORDER, ["price", "living_m2", "type"]).drop("gone_at")


@query(
    f"""WITH {D.DUCK_OBSERVATION}, cut AS (SELECT TIMESTAMP '1996-01-01' AS moment),
    stored AS (SELECT listing_id, arg_max(price, (ts, page, pos, seq, tie)) FILTER (price IS NOT NULL) AS price FROM observation, cut WHERE ts < moment GROUP BY listing_id),
    seen AS (SELECT o.*, s.listing_id IS NOT NULL AS known, row_number() OVER own AS nth,
        coalesce(last_value(o.price IGNORE NULLS) OVER (PARTITION BY o.listing_id ORDER BY ts, page, pos, seq, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.price) AS before
        FROM cut, observation o LEFT JOIN stored s ON o.listing_id = s.listing_id WHERE ts >= moment WINDOW own AS (PARTITION BY o.listing_id ORDER BY ts, page, pos, seq, tie))
    SELECT status, count(*) AS n, count(before) AS with_before FROM (SELECT before, CASE WHEN NOT known AND nth = 1 THEN 'new' WHEN price < before THEN 'price_drop' WHEN price > before THEN 'price_rise' ELSE 'same' END AS status FROM seen) GROUP BY status"""
)
def merge_second_batch(spark, sf_dir):
    rows, cut = D.observations(spark, sf_dir), F.lit("1996-01-01").cast("timestamp_ntz")
    stored = merge.merged_snapshot(rows.where(F.col("ts") < cut), D.SIGHTING_ORDER, ["price"])
    later = merge.classified(rows.where(F.col("ts") >= cut), stored, D.SIGHTING_ORDER)
    return later.groupBy("status").agg(F.count("*").alias("n"), F.count("before").alias("with_before"))


@query(f"WITH {D.DUCK_OBSERVATION} SELECT listing_id, search, max(ts) AS last_seen FROM observation GROUP BY ALL")
def merge_bridge(spark, sf_dir):
    rows = D.observations(spark, sf_dir).select("listing_id", "search", F.col("ts").alias("last_seen"))
    early = F.col("last_seen") < F.lit("1996-01-01").cast("timestamp_ntz")
    return merge.merge_bridge(rows.where(early), rows.where(~early))


@query(f"WITH {D.DUCK_OBSERVATION}, keys AS (SELECT source, external_id, min((ts, page, pos, seq, tie)) AS first FROM observation GROUP BY ALL) SELECT source, external_id, 1000 + row_number() OVER (ORDER BY first) AS id FROM keys")
def merge_new_ids(spark, sf_dir):
    keys = D.observations(spark, sf_dir).groupBy("source", "external_id").agg(F.min(F.struct(*D.SIGHTING_ORDER)).alias("first"))
    return merge.numbered(keys, 1000, ["first"]).select("source", "external_id", "id")


RUN_TS_SQL = "runs AS (SELECT search, CASE WHEN search = 'NO' THEN TIMESTAMP '1900-01-01' ELSE max(last_seen) END AS ts FROM bridge GROUP BY search)"
#: Per search of the bridge: the day of its last run; the bridge is cut to days so that a run sees many listings.
W_GONE = f"""WITH {D.DUCK_LISTING}, daily AS (SELECT l_orderkey AS listing_id, l_returnflag || l_linestatus AS search, max(CASE WHEN l_suppkey % 5 < 4 THEN TIMESTAMP '1999-01-01' ELSE l_shipdate END) AS last_seen FROM lineitem GROUP BY ALL),
    runs AS (SELECT search, CASE WHEN search = 'NO' THEN TIMESTAMP '1999-06-01' ELSE max(last_seen) END AS ts FROM daily GROUP BY search),
    guard AS (SELECT search, ts, count(*) FILTER (last_seen = ts) AS seen, count(*) FILTER (last_seen <> ts) AS missing FROM daily JOIN runs USING (search) GROUP BY ALL),
    judged AS (SELECT *, seen > 0 AND (missing <= 5 OR seen >= 0.6 * (seen + missing)) AS believed FROM guard)"""


def gone_inputs(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS listing_id", "l_returnflag || l_linestatus AS search", "CASE WHEN l_suppkey % 5 < 4 THEN TIMESTAMP_NTZ '1999-01-01' ELSE l_shipdate END AS last_seen"
    )
    daily = rows.groupBy("listing_id", "search").agg(F.max("last_seen").alias("last_seen"))
    runs = daily.groupBy("search").agg(F.max("last_seen").alias("ts")).withColumn("ts", F.when(F.col("search") == "NO", F.expr("TIMESTAMP_NTZ '1999-06-01'")).otherwise(F.col("ts")))
    return daily, runs


@query(W_GONE + " SELECT search, seen, missing, believed FROM judged")
def gone_guard(spark, sf_dir):
    return gone.completeness(*gone_inputs(spark, sf_dir)).select("search", "seen", "missing", "believed")


def gone_sql(where: str) -> str:
    return W_GONE + f", missed AS (SELECT listing_id, min(ts) AS missed_at FROM daily JOIN judged USING (search) WHERE last_seen <> ts {where} GROUP BY listing_id) SELECT id, coalesce(gone_at, missed_at) AS gone_at FROM listing LEFT JOIN missed ON id = listing_id"


@query(gone_sql("AND believed"))
def mark_gone_guarded(spark, sf_dir):
    return gone.mark_gone(D.listings(spark, sf_dir).select("id", "gone_at"), *gone_inputs(spark, sf_dir))


@query(gone_sql(""))
def mark_gone(spark, sf_dir):
    return gone.mark_gone(D.listings(spark, sf_dir).select("id", "gone_at"), *gone_inputs(spark, sf_dir), force=True)


DETAIL_SQL = "details AS (SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE 'detail ' || type END AS type, CASE WHEN id % 4 = 1 THEN NULL ELSE CAST(77 AS INT) END AS living_m2, CASE WHEN id % 3 = 0 THEN '' ELSE '{\"a\": 1}' END AS raw_fields FROM listing WHERE id % 5 = 0)"


@query(
    f"""WITH {D.DUCK_LISTING}, {DETAIL_SQL} SELECT l.id, coalesce(d.type, l.type) AS type,
    CASE WHEN d.id IS NOT NULL AND source = 'franimo' AND d.raw_fields <> '' THEN d.living_m2 ELSE coalesce(d.living_m2, l.living_m2) END AS living_m2,
    CASE WHEN d.id IS NOT NULL THEN TIMESTAMP '1998-12-01' ELSE detail_fetched END AS detail_fetched FROM listing l LEFT JOIN details d ON l.id = d.id"""
)
def detail_merge(spark, sf_dir):
    rows = D.listings(spark, sf_dir).withColumn("raw_fields", F.lit(None).cast("string"))
    details = rows.where("id % 5 = 0").selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'detail ' || type END AS type", "CASE WHEN id % 4 = 1 THEN NULL ELSE 77 END AS living_m2", "CASE WHEN id % 3 = 0 THEN '' ELSE '{\"a\": 1}' END AS raw_fields"
    )
    return merge.apply_details(rows, details, F.lit(D.ASOF).cast("timestamp_ntz")).select("id", "type", "living_m2", "detail_fetched")


@query(f"WITH {D.DUCK_LISTING}, {D.DUCK_BRIDGE} SELECT id FROM listing WHERE detail_fetched IS NULL AND id IN (SELECT listing_id FROM bridge WHERE search = 'RF')")
def needs_detail(spark, sf_dir):
    return merge.needs_detail(D.listings(spark, sf_dir), D.bridge(spark, sf_dir).where("search = 'RF'").withColumnRenamed("listing_id", "id"))


@query(f"WITH {D.DUCK_LISTING} SELECT id, price FROM listing WHERE detail_fetched IS NULL ORDER BY price NULLS LAST, id LIMIT 200")
def detail_queue(spark, sf_dir):
    return merge.detail_queue(D.listings(spark, sf_dir), 200)


@query(
    f"""WITH {D.DUCK_OBSERVATION}, pages AS (SELECT search, year(ts) AS page, coalesce(price <= 60000 AND tie <= 58000, false) AND year(ts) <> 1995 AS kept FROM observation),
    dry AS (SELECT search, min(page) AS last_page FROM (SELECT search, page FROM pages GROUP BY ALL HAVING count(*) FILTER (kept) = 0) GROUP BY search)
    SELECT search, page, count(*) AS n FROM pages LEFT JOIN dry USING (search) WHERE last_page IS NULL OR page <= last_page GROUP BY ALL"""
)
def early_stop(spark, sf_dir):
    kept = F.coalesce((F.col("price") <= 60000) & (F.col("tie") <= 58000), F.lit(False)) & (F.year("ts") != 1995)
    pages = D.observations(spark, sf_dir).select("search", F.year("ts").cast("long").alias("page"), kept.alias("kept"))
    return merge.early_stop(pages).groupBy("search", "page").agg(F.count("*").alias("n"))


LO, HI = 50_000, 250_000
DOOMED = f"(price > {HI} OR price < {LO})"


@query(f"WITH {D.DUCK_LISTING} SELECT count(*) FILTER ({DOOMED}) AS doomed, count(*) - count(*) FILTER ({DOOMED}) AS keep, count(*) FILTER (price IS NULL) AS priceless FROM listing")
def prune_counts(spark, sf_dir):
    return gone.prune_counts(D.listings(spark, sf_dir), LO, HI)


@query(f"WITH {D.DUCK_LISTING}, {D.DUCK_BRIDGE} SELECT search, count(*) AS n FROM bridge JOIN listing ON id = listing_id WHERE {DOOMED} GROUP BY search")
def prune_report(spark, sf_dir):
    return gone.prune_report(D.listings(spark, sf_dir), D.bridge(spark, sf_dir), LO, HI)


@query(f"WITH {D.DUCK_LISTING} SELECT id FROM listing WHERE price BETWEEN {LO} AND {HI}")
def prune_keep(spark, sf_dir):
    return gone.prune(D.listings(spark, sf_dir), [], LO, HI, drop_priceless=True)[0].select("id")


@query(f"WITH {D.DUCK_LISTING}, {D.DUCK_BRIDGE} SELECT * FROM bridge WHERE listing_id NOT IN (SELECT id FROM listing WHERE {DOOMED})")
def prune_children(spark, sf_dir):
    return gone.prune(D.listings(spark, sf_dir), [D.bridge(spark, sf_dir)], LO, HI)[1][0].select("listing_id", "search", "last_seen")


@query(
    f"""WITH RECURSIVE {D.DUCK_LISTING}, bands(lo, hi, depth, n) AS (SELECT 0::BIGINT, 400000::BIGINT, 0, (SELECT count(*) FROM listing WHERE price BETWEEN 0 AND 400000)
        UNION ALL SELECT CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END, depth + 1,
            (SELECT count(*) FROM listing WHERE price BETWEEN CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 + 1 END AND CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END)
        FROM bands, (VALUES (0), (1)) t(side) WHERE ceil(n / 20.0) > 20 AND depth < 8 AND hi - lo > 500)
    SELECT lo, hi, n FROM bands WHERE NOT (ceil(n / 20.0) > 20 AND depth < 8 AND hi - lo > 500)"""
)
def price_bands(spark, sf_dir):
    rows = D.listings(spark, sf_dir)
    return bands.band_counts(rows, bands.bands_of(rows, 0, 400_000, ceiling=20, page_size=20))


CODED = ["source", "type", "region", "dept_nl", "agent", "reference", "place"]


@query(
    W_VIEW
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, count(DISTINCT {c}) > 0 AND count(DISTINCT {c}) <= count(*) * 0.6 AS coded FROM view" for c in CODED)
)
def pack_profile(spark, sf_dir):
    return pack.column_profile(listing_view_of(spark, sf_dir), CODED)


@query(W_VIEW + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM view WHERE {c} IS NOT NULL)" for c in ("source", "region", "agent")))
def pack_dict(spark, sf_dir):
    return pack.dictionaries(listing_view_of(spark, sf_dir), ["source", "region", "agent"])


@query(W_VIEW + "SELECT id, agent FROM view")
def pack_round_trip(spark, sf_dir):
    rows = listing_view_of(spark, sf_dir)
    codes = pack.dictionaries(rows, ["agent"])
    return pack.decoded(pack.encoded(rows.select("id", "agent"), "agent", codes), "agent", codes)


PAGE_HEAD = "regexp_replace(url, '/?[^/]*$', '') || '/'"


@query(f"SELECT head, row_number() OVER (ORDER BY first) - 1 AS prefix FROM (SELECT {PAGE_HEAD} AS head, min(page_id) AS first FROM pages WHERE url IS NOT NULL GROUP BY 1)")
def pack_prefix(spark, sf_dir):
    return pack.prefixes(D.table(spark, sf_dir, "pages"), "url", F.col("page_id"))


@query(
    f"""WITH photos AS (SELECT c_custkey AS id, list_transform(range(1 + c_custkey % 3), lambda i: 'https://cdn/' || CASE WHEN c_custkey % 5 = 0 THEN i ELSE c_nationkey END || '/' || i || CASE WHEN c_custkey % 2 = 0 THEN '.jpg' ELSE '.png' END) AS photos FROM customer),
    heads AS (SELECT *, list_distinct(list_transform(photos, lambda url: {PAGE_HEAD})) AS heads FROM photos)
    SELECT id, CASE WHEN len(heads) = 1 THEN heads[1] END AS head, array_to_string(CASE WHEN len(heads) = 1 THEN list_transform(photos, lambda p: CASE WHEN p LIKE '%.jpg' THEN regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.jpg$', '') ELSE '=' || regexp_extract(p, '([^/]*)$', 1) END) ELSE photos END, '|') AS names FROM heads"""
)
def photo_index(spark, sf_dir):
    photos = D.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "transform(sequence(0, CAST(c_custkey % 3 AS INT)), i -> 'https://cdn/' || CASE WHEN c_custkey % 5 = 0 THEN i ELSE c_nationkey END || '/' || i || CASE WHEN c_custkey % 2 = 0 THEN '.jpg' ELSE '.png' END) AS photos",
    )
    return pack.photo_index(photos).select("id", "head", F.array_join("names", "|").alias("names"))


SEEDS_SQL = """seeds AS (SELECT n_name AS search, 'src' || (n_regionkey) AS source, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE cnt END AS ours,
    CASE n_nationkey % 8 WHEN 0 THEN '<html>Just a moment</html>' || repeat('x', 100) WHEN 1 THEN '  ' ELSE repeat('<p>card</p>', 20) END AS html,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE cnt + n_nationkey * 9 - 60 END AS total, CAST(NULL AS BIGINT) AS result_count, CAST(1 + n_nationkey % 4 AS BIGINT) AS pages, CAST(12 AS BIGINT) AS cards,
    CAST(24 AS BIGINT) AS page_size, n_nationkey % 2 = 0 AS has_skip, CASE WHEN n_nationkey % 7 = 0 THEN 'USD' END AS catalogue_currency
    FROM (SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS cnt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL))"""


def seeds_of(spark, sf_dir) -> DataFrame:
    counts = D.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("cnt"))
    nations = D.table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    select = SEEDS_SQL[SEEDS_SQL.index("SELECT") + 6 : SEEDS_SQL.index("FROM (SELECT")].replace("'src' || (n_regionkey)", "'src' || n_regionkey")
    return nations.selectExpr(*D.split_select(select))


@query(
    f"""WITH {SEEDS_SQL}, scored AS (SELECT *, contains(lower(html[:8000]), 'just a moment') AS blocked, length(trim(html)) < 80 AS empty,
        CASE WHEN total >= 0 THEN total WHEN pages <= 1 THEN cards ELSE (pages - 1) * page_size + cards END AS count, CASE WHEN total >= 0 OR pages <= 1 THEN 'exact' ELSE 'estimate' END AS kind FROM seeds),
    live AS (SELECT *, CASE WHEN NOT blocked AND NOT empty THEN count END AS live FROM scored),
    drift AS (SELECT *, coalesce(abs(live - ours) >= 50 OR (ours > 0 AND abs(live - ours) * 100 >= ours * 5), false) AS drift FROM live)
    SELECT search, source, ours, live, live - ours AS delta, drift, CASE WHEN NOT blocked AND empty THEN 'empty response' ELSE '' END AS detail, CASE WHEN blocked THEN 'blocked' WHEN empty THEN 'error' ELSE
        concat_ws('; ', CASE WHEN kind = 'exact' AND has_skip AND ours > 0 AND live > ours * 2 THEN 'exact; list wider than skip' ELSE kind END,
            CASE WHEN catalogue_currency = 'USD' THEN 'USD catalogue' END, CASE WHEN ours IS NULL THEN 'no published count' END) || CASE WHEN drift THEN ' drift' ELSE '' END END AS note FROM drift"""
)
def probe_drift(spark, sf_dir):
    return probe.probe(seeds_of(spark, sf_dir))


@query(
    f"""WITH {D.DUCK_LISTING} SELECT id, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lon BETWEEN -180 AND 180 THEN lon END AS lon, abs(lat) <= 90 AND abs(lon) <= 180 AS plottable FROM listing"""
)
def clean_latlon(spark, sf_dir):
    return D.listings(spark, sf_dir).select("id", clean_coordinate(F.col("lat"), 90).alias("lat"), clean_coordinate(F.col("lon"), 180).alias("lon"), plottable(F.col("lat"), F.col("lon")).alias("plottable"))


@query(f"WITH {D.DUCK_LISTING} SELECT source, count(*) AS n, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM listing WHERE abs(lat) <= 90 AND abs(lon) <= 180 GROUP BY source")
def map_bounds(spark, sf_dir):
    rows = D.listings(spark, sf_dir).where(plottable(F.col("lat"), F.col("lon")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query(
    f"""WITH {D.DUCK_LISTING} SELECT id, CASE WHEN lower(country) = 'france' THEN 'FR' WHEN lower(country) = 'bg' THEN 'BG' WHEN lower(country) = 'japan' THEN 'JP' WHEN lower(country) = 'morocco' THEN 'MA'
        ELSE CASE source WHEN 'franimo' THEN 'FR' WHEN 'greenacres' THEN 'FR' WHEN 'lefigaro' THEN 'FR' WHEN 'akiyaportal' THEN 'JP' WHEN 'ok_bulgaria' THEN 'BG' WHEN 'bulgarianproperties' THEN 'BG'
        WHEN 'abruzzopropertyitaly' THEN 'IT' WHEN 'abruzzoruralproperty' THEN 'IT' WHEN 'centrarium' THEN 'ME' WHEN 'mubawab' THEN 'MA' WHEN 'homege' THEN 'GE' END END AS iso FROM listing"""
)
def country_of(spark, sf_dir):
    return D.listings(spark, sf_dir).select("id", country_for(F.lit(None).cast("string"), F.col("country"), F.col("source")).alias("iso"))


BOX = (-5.0, 10.0, 41.0, 51.5)


@query(
    f"""WITH {D.DUCK_LISTING}, xy AS (SELECT id, (lon + 5.0) / 15.0 * 600 AS x, (51.5 - lat) / 10.5 * 500 AS y FROM listing) SELECT id, round(x, 6) AS x, round(y, 6) AS y, x >= 0 AND x <= 600 AND y >= 0 AND y <= 500 AS inside FROM xy"""
)
def project_xy(spark, sf_dir):
    x, y, inside = project(F.col("lat"), F.col("lon"), BOX, 600, 500)
    return D.listings(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), inside.alias("inside"))
