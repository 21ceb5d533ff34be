"""Listings that a search no longer finds, with a guard against runs that ended early; pruning by price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A run below this share of the known listings is not believed, unless so few are missing.
LEAST_SEEN, SMALL_LOSS = 0.6, 5


def completeness(bridge: DataFrame, runs: DataFrame) -> DataFrame:
    """Per search of runs (search, ts): seen, missing, believed. One aggregation over the bridge; runs has a row a search, broadcast where the planner finds it small."""
    at_run = F.col("last_seen") == F.col("ts")
    counts = bridge.join(runs, "search").groupBy("search", "ts").agg(F.count_if(at_run).alias("seen"), F.count_if(~at_run).alias("missing"))
    believed = (F.col("seen") > 0) & ((F.col("missing") <= SMALL_LOSS) | (F.col("seen") >= LEAST_SEEN * (F.col("seen") + F.col("missing"))))
    return counts.withColumn("believed", believed)


def missing_listings(bridge: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """listing_id, gone_at of what believed runs no longer found; the earliest run counts where several miss one."""
    # Forced runs need no counts, so the bridge is read once.
    trusted = runs if force else completeness(bridge, runs).where("believed")
    absent = bridge.join(trusted.select("search", "ts"), "search").where(F.col("last_seen") != F.col("ts"))
    return absent.groupBy("listing_id").agg(F.min("ts").alias("missed_at"))


def mark_gone(listings: DataFrame, bridge: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """listings with gone_at set where it was null and a believed run missed them; one seen through another search is marked too."""
    missed = missing_listings(bridge, runs, force).withColumnRenamed("listing_id", "id")
    return listings.join(missed, "id", "left").withColumn("gone_at", F.coalesce("gone_at", "missed_at")).select(*listings.columns)


def doomed(price: Column, least: int, most: int, drop_priceless: bool = False) -> Column:
    """Whether pruning removes a price; unknown ones only if asked."""
    outside = F.coalesce((price > most) | (price < least), F.lit(False))
    return outside | price.isNull() if drop_priceless else outside


def prune(listings: DataFrame, children: list[DataFrame], least: int, most: int, drop_priceless: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The listings that stay and the child rows (listing_id) that stay with them."""
    gone = listings.where(doomed(F.col("price"), least, most, drop_priceless)).select(F.col("id").alias("listing_id"))
    return listings.where(~doomed(F.col("price"), least, most, drop_priceless)), [c.join(gone, "listing_id", "left_anti") for c in children]


def prune_counts(listings: DataFrame, least: int, most: int, drop_priceless: bool = False) -> DataFrame:
    out = doomed(F.col("price"), least, most, drop_priceless)
    return listings.agg(F.count_if(out).alias("doomed"), F.count_if(~out).alias("keep"), F.count_if(F.col("price").isNull()).alias("priceless"))


def prune_report(listings: DataFrame, bridge: DataFrame, least: int, most: int, drop_priceless: bool = False) -> DataFrame:
    """search, n: how many listings of each search pruning would remove, most first; ties by name."""
    gone = listings.where(doomed(F.col("price"), least, most, drop_priceless)).select(F.col("id").alias("listing_id"))
    return bridge.join(gone, "listing_id").groupBy("search").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "search")
