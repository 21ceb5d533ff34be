"""The listing view: stored rows with what is derived from their price history and searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.text import blank_as_null, fold
from hearthlake.schema import DEFAULT_CURRENCY, DEFAULT_SOURCE

#: Columns that lists never show; they are read on demand, by id.
HEAVY = ("photos", "raw_fields")


def per_area(price: Column, area: Column) -> Column:
    return F.when(area > 0, price.cast("double") / area)


def truthy(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def price_drop(price: Column, old_price: Column, first_price: Column) -> Column:
    """The advertised drop, else the drop since the first sighting, else null; zero prices count as unknown."""
    now, old, first = truthy(price), truthy(old_price), truthy(first_price)
    return F.when(old > now, old - now).when(first > now, first - now)


def days_since(moment: Column, asof: datetime) -> Column:
    """Whole days from moment to asof, cut towards zero."""
    seconds = F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))
    return (seconds / 86400).cast("int")


def history_facts(history: DataFrame) -> DataFrame:
    """listing_id, first_price, n_prices; one partial aggregation, whatever the number of changes of a listing."""
    return history.groupBy("listing_id").agg(F.min_by("price", "id").alias("first_price"), F.count("*").alias("n_prices"))


def searches_of(bridge: DataFrame) -> DataFrame:
    """listing_id, searches: the names of its searches in order, comma-joined."""
    return bridge.groupBy("listing_id").agg(F.array_join(F.array_sort(F.collect_list("search")), ",").alias("searches"))


def listing_view(listings: DataFrame, history: DataFrame, bridge: DataFrame, asof: datetime, light: bool = True) -> DataFrame:
    """Every listing with eur_m2, eur_m2_land, first_price, n_changes, days_known, searches and price_drop.

    Both lookups are grouped before they are joined, so each is one shuffle on the listing's id and
    the joins reuse it. asof is a parameter: the same call gives the same rows on any day.
    """
    facts, names = history_facts(history), searches_of(bridge)
    joined = listings.join(facts.withColumnRenamed("listing_id", "id"), "id", "left").join(names.withColumnRenamed("listing_id", "id"), "id", "left")
    found = joined.withColumns(
        {
            "eur_m2": per_area(F.col("price"), F.col("living_m2")),
            "eur_m2_land": per_area(F.col("price"), F.col("land_m2")),
            "n_changes": F.coalesce("n_prices", F.lit(0)) - 1,
            "days_known": days_since(F.col("first_seen"), asof),
            "price_drop": price_drop(F.col("price"), F.col("old_price"), F.col("first_price")),
            "source": F.coalesce(blank_as_null(F.col("source")), F.lit(DEFAULT_SOURCE)),
            "currency": F.coalesce(blank_as_null(F.col("currency")), F.lit(DEFAULT_CURRENCY)),
        }
    ).drop("n_prices")
    return found.drop(*HEAVY) if light else found


def by_id(view: DataFrame, listing_id: int) -> DataFrame:
    return view.where(F.col("id") == listing_id)


def with_photos(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """rows with the photos (id, photos) of each; an empty list where there are none."""
    return rows.drop("photos").join(photos.select("id", "photos"), "id", "left").withColumn("photos", F.coalesce("photos", F.array().cast("array<string>")))


def with_outlines(rows: DataFrame, countries: DataFrame, departments: DataFrame) -> DataFrame:
    """rows with the outline of their country and, in France, of their department.

    countries (code, outline) and departments (name, outline) are the few outlines that a map ships; the
    planner broadcasts them. A department matches by its folded French name, else by its Dutch one.
    """
    folded = departments.select(fold(F.col("name")).alias("_name"), F.col("outline").alias("_outline")).groupBy("_name").agg(F.max("_outline").alias("_outline"))
    found = rows.join(countries.select(F.col("code").alias("country"), "outline"), "country", "left")
    for name in ("dept_fr", "dept_nl"):
        key = F.when(F.col("country") == "FR", blank_as_null(fold(F.col(name))))
        found = found.withColumn("_key", key).join(folded.select(F.col("_name").alias("_key"), F.col("_outline").alias(f"_{name}")), "_key", "left").drop("_key")
    return found.withColumn("department", F.coalesce("_dept_fr", "_dept_nl")).select(*rows.columns, "outline", "department")


def minute(moment: Column) -> Column:
    """A moment as its date and time up to the minute."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


#: The collation of sorted texts: case and accents count after letters.
LOCALE = "nl"


def blanks_last(column: str, ascending: bool = True) -> Column:
    """Sort key: direction holds for values, blanks come last either way; texts sort by the rules of LOCALE."""
    value = F.collate(F.expr(f"nullif(`{column}`, '')"), LOCALE) if column in TEXT_COLUMNS else F.col(column)
    return value.asc_nulls_last() if ascending else value.desc_nulls_last()


TEXT_COLUMNS = frozenset(["source", "type", "place", "region", "dept_nl", "energy_label", "searches", "currency", "agent", "reference", "country"])


def sorted_page(view: DataFrame, column: str = "eur_m2", ascending: bool = True, limit: int = 300, offset: int = 0) -> DataFrame:
    """A page of the view; ties by id. Spark keeps only limit + offset rows of each task."""
    page = view.orderBy(blanks_last(column, ascending), F.col("id"))
    return (page.offset(offset) if offset else page).limit(limit)
