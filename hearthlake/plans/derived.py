"""Listing-shaped views over the star schema, defined once for Spark and once as SQL for the oracle.

No table of property listings exists among the inputs, so orders stand for listings and line items
for sightings. Every mapping is deterministic and reaches nulls, zeros, blanks and bad coordinates.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.functions.text import SOURCE_NAMES

ASOF = datetime(1998, 12, 1)
PORTALS = [*SOURCE_NAMES, "new_portal-x"]
PORTAL_LIST = ", ".join(f"'{p}'" for p in PORTALS)
PRICE_RANGE = (50_000, 250_000)

LISTING_SELECT = """
    o_orderkey AS id,
    CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE {portal} END AS source,
    CAST(o_orderkey AS {string}) AS external_id,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'France' WHEN o_orderkey % 5 = 2 THEN 'bg' ELSE n_name END AS country,
    CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE o_orderpriority END AS type,
    c_name AS place, r_name AS region,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE n_name END AS dept_nl,
    CAST(o_custkey % 220 - 110 AS DOUBLE) AS lat,
    CASE WHEN o_orderkey % 41 = 0 THEN 139256123.0 ELSE CAST(o_custkey % 360 - 180 AS DOUBLE) END AS lon,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS price,
    CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 29 = 1 THEN 'USD' ELSE 'EUR' END AS currency,
    CASE o_orderkey % 7 WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) + 5000 WHEN 1 THEN CAST(0 AS BIGINT) WHEN 2 THEN CAST(1000 AS BIGINT) ELSE NULL END AS old_price,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS INT) END AS bedrooms,
    CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS INT) ELSE CAST(20 + o_custkey % 300 AS INT) END AS living_m2,
    CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS INT) ELSE CAST(100 + o_custkey % 3000 AS INT) END AS land_m2,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderstatus END AS energy_label,
    CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment ELSE NULL END AS agent,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Near ' || n_name || ', ' || c_mktsegment END AS description,
    CAST(NULL AS {string}) AS features,
    'ref-' || CAST(o_orderkey % 1000 AS {string}) AS reference,
    CAST(NULL AS {string}) AS snippet,
    o_orderdate AS first_seen,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS detail_fetched,
    CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate + INTERVAL 30 DAY ELSE NULL END AS gone_at
"""

SPARK_PORTAL = f"element_at(array({PORTAL_LIST}), CAST(o_custkey % {len(PORTALS)} + 1 AS INT))"
DUCK_PORTAL = f"list_extract([{PORTAL_LIST}], CAST(o_custkey % {len(PORTALS)} + 1 AS INT))"

OBSERVATION_SELECT = """
    CASE l_partkey % 3 WHEN 0 THEN 'franimo' WHEN 1 THEN 'homege' ELSE 'domaza' END AS source,
    CAST(l_partkey AS {string}) AS external_id, l_partkey AS listing_id, l_returnflag || l_linestatus AS search, l_shipdate AS ts,
    CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS price,
    CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS living_m2,
    CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_returnflag END AS type,
    l_orderkey AS page, l_linenumber AS pos, l_suppkey AS seq, l_extendedprice AS tie
"""
#: Total order of the sightings of one listing.
SIGHTING_ORDER = ["ts", "page", "pos", "seq", "tie"]

#: The views as common table expressions for the oracle.
DUCK_LISTING = "listing AS (SELECT" + LISTING_SELECT.format(portal=DUCK_PORTAL, string="VARCHAR") + "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
DUCK_HISTORY = "history AS (SELECT l_orderkey AS listing_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_extendedprice) AS id, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(floor(l_extendedprice * 4) AS BIGINT) END AS price FROM lineitem)"
DUCK_BRIDGE = "bridge AS (SELECT l_orderkey AS listing_id, l_returnflag || l_linestatus AS search, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL)"
DUCK_VIEW = f"""{DUCK_LISTING}, {DUCK_HISTORY}, {DUCK_BRIDGE},
facts AS (SELECT listing_id, arg_min_null(price, id) AS first_price, count(*) AS n_prices FROM history GROUP BY listing_id),
names AS (SELECT listing_id, string_agg(search, ',' ORDER BY search) AS searches FROM bridge GROUP BY listing_id),
view AS (SELECT listing.* REPLACE (coalesce(nullif(source, ''), 'franimo') AS source, coalesce(nullif(currency, ''), 'EUR') AS currency),
    CASE WHEN living_m2 > 0 THEN price::DOUBLE / living_m2 END AS eur_m2, CASE WHEN land_m2 > 0 THEN price::DOUBLE / land_m2 END AS eur_m2_land,
    first_price, coalesce(n_prices, 0) - 1 AS n_changes, CAST(trunc((epoch(TIMESTAMP '1998-12-01') - epoch(first_seen)) / 86400) AS INT) AS days_known, searches,
    CASE WHEN nullif(old_price, 0) > nullif(price, 0) THEN old_price - price WHEN nullif(first_price, 0) > nullif(price, 0) THEN first_price - price END AS price_drop
    FROM listing LEFT JOIN facts ON id = facts.listing_id LEFT JOIN names ON id = names.listing_id)"""
DUCK_OBSERVATION = "observation AS (SELECT" + OBSERVATION_SELECT.format(string="VARCHAR") + "FROM lineitem)"
DUCK_CLASSIFIED = f"""{DUCK_OBSERVATION}, seen AS (SELECT *, row_number() OVER own AS nth, last_value(price IGNORE NULLS) OVER (PARTITION BY listing_id ORDER BY ts, page, pos, seq, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM observation WINDOW own AS (PARTITION BY listing_id ORDER BY ts, page, pos, seq, tie)),
classified AS (SELECT *, CASE WHEN nth = 1 THEN 'new' WHEN price < before THEN 'price_drop' WHEN price > before THEN 'price_rise' ELSE 'same' END AS status FROM seen)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled_in(template: str, *names: str) -> Column:
    """A template with the values of columns for {name}: its pieces and theirs put together, which reads it once and not once for each name."""
    pieces = re.split("(" + "|".join(rf"\{{{name}\}}" for name in names) + ")", template)
    return F.concat(*(F.col(piece[1:-1]).cast("string") if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all tasks, before each becomes a document: a small file is read by one task, which would make and read all documents."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    joined = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*split_select(LISTING_SELECT.format(portal=SPARK_PORTAL, string="STRING")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr(
        "l_orderkey AS listing_id", "struct(l_shipdate, l_linenumber, l_suppkey, l_extendedprice) AS id", "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(floor(l_extendedprice * 4) AS BIGINT) END AS price"
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS listing_id", "l_returnflag || l_linestatus AS search", "l_shipdate AS last_seen").groupBy("listing_id", "search").agg(F.max("last_seen").alias("last_seen"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*split_select(OBSERVATION_SELECT.format(string="STRING")))


def split_select(text: str) -> list[str]:
    """The expressions of a select list: cut at commas outside parentheses and quotes."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]
