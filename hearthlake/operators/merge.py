"""Merging sightings into the listing store: status, price history, searches and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthlake.functions.geo import clean_coordinate, country_for
from hearthlake.functions.text import blank_as_null
from hearthlake.operators.ranks import ranked
from hearthlake.schema import CARD_COLUMNS, DEFAULT_CURRENCY, DEFAULT_SOURCE, DETAIL_COLUMNS, LISTING

KEY = ["source", "external_id"]
#: Sources whose detail page always states the living area, so that a missing one clears the stored value.
CLEARS_LIVING = frozenset(["franimo"])


def with_identity(rows: DataFrame, default_source: str = DEFAULT_SOURCE) -> DataFrame:
    """rows with source and external_id filled in; an error where a row has neither an external id nor an id."""
    given = F.coalesce(F.col("external_id").cast("string"), F.col("id").cast("string")) if "id" in rows.columns else F.col("external_id").cast("string")
    return rows.withColumn("source", F.coalesce(blank_as_null(F.col("source")), F.lit(default_source))).withColumn(
        "external_id", F.when(given.isNull(), F.raise_error(F.lit("a listing needs an external id")).cast("string")).otherwise(given)
    )


def classified(sightings: DataFrame, known: DataFrame | None, order: list[str], key: list[str] = KEY) -> DataFrame:
    """sightings with before (the last price known before each) and status: new, price_drop, price_rise or same.

    known holds the stored listings (key, price). A listing seen twice in one run is compared with
    what its first sighting wrote: sightings count in the given order after the stored price. The
    window is the listing's own rows, partitioned by its key.
    """
    rows = sightings.withColumn("_stored", F.lit(0))
    if known is not None:
        seeds = known.select(*key, F.col("price")).withColumn("_stored", F.lit(1))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    own = W.partitionBy(*key).orderBy(F.col("_stored").desc(), *order)
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    before = F.last("price", ignorenulls=True).over(earlier)
    first = F.row_number().over(own) == 1
    status = F.when(first, "new").when(F.col("price") < before, "price_drop").when(F.col("price") > before, "price_rise").otherwise("same")
    return rows.withColumn("before", before).withColumn("status", status).where("_stored = 0").drop("_stored")


def new_history(classified_rows: DataFrame) -> DataFrame:
    """The sightings that add a price history row: every new listing, priced or not, and every change."""
    return classified_rows.where(F.col("status") != "same")


def run_counters(classified_rows: DataFrame, by: list[str], key: list[str] = KEY) -> DataFrame:
    """Per run: sightings by status, and seen, the number of different listings."""
    counts = {"new": "new", "price_drops": "price_drop", "price_rises": "price_rise", "same": "same"}
    return classified_rows.groupBy(*by).agg(*(F.count_if(F.col("status") == v).alias(k) for k, v in counts.items()), F.count_distinct(*key).alias("seen"))


def latest(column: str, order: Column) -> Column:
    """The last value of a column that is not null, in the given order; merged by partial aggregation."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)


def merged_snapshot(sightings: DataFrame, order: list[str], columns: list[str] | None = None, ts: str = "ts", key: list[str] = KEY) -> DataFrame:
    """One row a listing from all its sightings: a value overwrites, a null never blanks.

    Stored rows take part as the earliest sightings. first_seen and last_seen span them; gone_at is
    null, since a sighting brings a listing back. The aggregation is associative: partial results are
    made before the shuffle, and sightings may be merged batch by batch.
    """
    columns = columns if columns is not None else [c for c in [*CARD_COLUMNS, "country", "currency", "promoted"] if c in sightings.columns]
    at = F.struct(*map(F.col, order))
    return sightings.groupBy(*key).agg(
        *(latest(c, at) for c in columns), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("gone_at")
    )


def raw_country(rows: DataFrame) -> Column:
    """The country that a row's raw fields name; null where they are no JSON or name none."""
    return F.get_json_object("raw_fields", "$.country") if "raw_fields" in rows.columns else F.lit(None).cast("string")


def card_values(cards: DataFrame) -> DataFrame:
    """cards as they are written: coordinates in range only, beds as bedrooms, promoted, currency and country always set.

    The country is the first that resolves to a code: raw fields, the card, the portal's home; null leaves the stored one.
    """
    found = cards
    if "source" in cards.columns:
        stated = F.col("country") if "country" in cards.columns else F.lit(None).cast("string")
        found = found.withColumn("country", country_for(raw_country(cards), stated, F.col("source")))
    if "lat" in cards.columns:
        found = found.withColumn("lat", clean_coordinate(F.col("lat"), 90)).withColumn("lon", clean_coordinate(F.col("lon"), 180))
    if "beds" in cards.columns:
        found = found.withColumn("bedrooms", F.coalesce("beds", "bedrooms") if "bedrooms" in cards.columns else F.col("beds")).drop("beds")
    if "promoted" in cards.columns:
        found = found.withColumn("promoted", F.coalesce(F.col("promoted").cast("boolean"), F.lit(False)))
    if "currency" in cards.columns:
        found = found.withColumn("currency", F.coalesce(blank_as_null(F.col("currency")), F.lit(DEFAULT_CURRENCY)))
    return found


def backfilled(listings: DataFrame) -> DataFrame:
    """Stored rows from before some columns: blank sources, external ids, currencies and countries are filled in.

    A country comes from the raw fields or the portal's home; one that is there stays as it is.
    """
    source = F.coalesce(blank_as_null(F.col("source")), F.lit(DEFAULT_SOURCE))
    return listings.withColumns(
        {
            "source": source,
            "external_id": F.coalesce(blank_as_null(F.col("external_id")), F.col("id").cast("string")),
            "currency": F.coalesce(blank_as_null(F.col("currency")), F.lit(DEFAULT_CURRENCY)),
            "country": F.coalesce(blank_as_null(F.col("country")), country_for(raw_country(listings), F.lit(None).cast("string"), source), F.col("country")),
        }
    )


def migrated(listings: DataFrame, layout: str = LISTING) -> DataFrame:
    """An older store with every column of the layout: those it lacks are null, then blanks are filled in; columns beyond the layout stay."""
    missing = [part.split(" ", 1) for part in layout.split(", ") if part.split(" ", 1)[0] not in listings.columns]
    return backfilled(listings.withColumns({name: F.lit(None).cast(kind) for name, kind in missing}))


def logged_runs(log: DataFrame, runs: DataFrame, last_id: int) -> DataFrame:
    """The run log with a row for each run of runs, numbered after last_id by when it began; ties by search."""
    added = ranked(runs, [F.col("started_at"), F.col("search")], "id", first=last_id + 1)
    return log.unionByName(added, allowMissingColumns=True)


def merge_bridge(bridge: DataFrame, seen: DataFrame) -> DataFrame:
    """listing_id, search, last_seen after the sightings of seen (same columns)."""
    return bridge.unionByName(seen).groupBy("listing_id", "search").agg(F.max("last_seen").alias("last_seen"))


def numbered(new_keys: DataFrame, last_id: int, order: list[str]) -> DataFrame:
    """New listings with ids after last_id in order of first sighting."""
    return ranked(new_keys, [F.col(c) for c in order], "id", first=last_id + 1)


def apply_details(listings: DataFrame, details: DataFrame, ts: Column) -> DataFrame:
    """listings with the values of their detail pages (id and detail columns, one row an id).

    A value overwrites and a null leaves what is stored, except that sources which always state the
    living area lose a stored one when their facts were read and it is not among them. Every listing
    with a detail gets detail_fetched; its price history is not touched.
    """
    named = [c for c in DETAIL_COLUMNS if c in details.columns and c in listings.columns]
    renamed = details.select("id", F.lit(True).alias("_has"), *(F.col(c).alias(f"_new_{c}") for c in named))
    joined = listings.join(renamed, "id", "left")
    values = {}
    for c in named:
        new = F.col(f"_new_{c}")
        if c in ("lat", "lon"):
            new = clean_coordinate(new, 90 if c == "lat" else 180)
        values[c] = F.coalesce(new, F.col(c))
    if "living_m2" in values and "raw_fields" in named:
        facts = F.coalesce(F.col("_new_raw_fields"), F.lit(""))
        clears = F.col("_has") & F.col("source").isin(*CLEARS_LIVING) & ~facts.isin("", "{}")
        values["living_m2"] = F.when(F.coalesce(clears, F.lit(False)), F.col("_new_living_m2")).otherwise(values["living_m2"])
    values["detail_fetched"] = F.when(F.col("_has"), ts).otherwise(F.col("detail_fetched"))
    return joined.withColumns(values).select(*listings.columns)


def needs_detail(listings: DataFrame, ids: DataFrame) -> DataFrame:
    """id of the listings of ids whose detail page was never read."""
    return listings.where(F.col("detail_fetched").isNull()).join(ids.select("id").distinct(), "id", "left_semi").select("id")


def detail_queue(listings: DataFrame, limit: int) -> DataFrame:
    """The next listings to read in detail, cheapest first, unpriced ones last; ties by id."""
    return listings.where(F.col("detail_fetched").isNull()).select("id", "price").orderBy(F.col("price").asc_nulls_last(), "id").limit(limit)


def crawl_queue(listings: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """The next of the listings of seen (id, pos) to read in detail, in the order in which the crawl first met them."""
    met = seen.groupBy("id").agg(F.min("pos").alias("pos"))
    return met.join(needs_detail(listings, met), "id").orderBy("pos", "id").limit(limit)


def early_stop(pages: DataFrame) -> DataFrame:
    """Cards of a cheapest-first list up to its first page that has cards of which none is kept (search, page, kept)."""
    dry = pages.groupBy("search", "page").agg(F.count_if("kept").alias("n_kept")).where("n_kept = 0").groupBy("search").agg(F.min("page").alias("last_page"))
    return pages.join(dry, "search", "left").where(F.col("last_page").isNull() | (F.col("page") <= F.col("last_page"))).drop("last_page")
