"""The table functions of sources.functions, called from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.plans import derived as D
from hearthlake.plans.source_queries import result_pages
from hearthlake.sources.functions import register_functions

#: Sightings of a listing, numbered in their order, which makes `at` unique.
SIGHTINGS = "SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY ts, page, pos, seq, tie) AS at, price FROM observation"


def sightings(spark: SparkSession, sf_dir: str) -> None:
    register_functions(spark)
    D.observations(spark, sf_dir).createOrReplaceTempView("observation")


def udtf_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings(spark, sf_dir)
    return spark.sql(f"SELECT * FROM per_key(TABLE(SELECT listing_id, CAST(at AS BIGINT) AS at, price FROM ({SIGHTINGS})), 'price_changes', 'listing_id')")


def udtf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's sightings are many: each day of it is a key, and the days' spans are put together."""
    sightings(spark, sf_dir)
    days = "SELECT struct(search, at div 86400 AS day) AS part, at FROM (SELECT search, unix_seconds(CAST(ts AS TIMESTAMP)) AS at FROM observation)"
    return spark.sql(f"SELECT part.search AS search, min(first_at) AS first_at, max(last_at) AS last_at, sum(n) AS n FROM per_key(TABLE({days}), 'spans', 'part') GROUP BY part.search")


def udtf_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of every raw page, by the source's name."""
    register_functions(spark)
    D.table(spark, sf_dir, "pages").createOrReplaceTempView("raw_pages")
    return spark.sql("SELECT CAST(url AS BIGINT) AS page_id, CAST(pos AS BIGINT) AS pos, link FROM page_cards(TABLE(SELECT CAST(page_id AS STRING) AS url, html FROM raw_pages), 'navigation')")


def udtf_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal's result pages by its name: the texts before any rule of the portal."""
    register_functions(spark)
    result_pages(spark, sf_dir, "domaza").createOrReplaceTempView("result_pages")
    return spark.sql("SELECT id AS external_id, price FROM page_cards(TABLE(result_pages), 'domaza')").withColumn("price", F.regexp_replace("price", "[^0-9]", "").cast("long"))


QUERIES = {"udtf_changes": udtf_changes, "udtf_spans": udtf_spans, "udtf_cards": udtf_cards, "udtf_portal": udtf_portal}
ORACLES = {
    "udtf_changes": f"WITH {D.DUCK_CLASSIFIED} SELECT listing_id, nth AS at, price, before, status FROM classified WHERE status <> 'same'",
    "udtf_spans": f"WITH {D.DUCK_OBSERVATION} SELECT search, epoch(min(ts))::BIGINT AS first_at, epoch(max(ts))::BIGINT AS last_at, count(*) AS n FROM observation GROUP BY search",
    "udtf_cards": """WITH lists AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)"', 1) AS links FROM pages)
        SELECT page_id, i - 1 AS pos, links[i] AS link FROM lists, unnest(range(1, len(links) + 1)) AS t(i)""",
    "udtf_portal": "SELECT o_orderkey::VARCHAR AS external_id, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders",
}
