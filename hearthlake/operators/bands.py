"""Price bands that each fit under a portal's page ceiling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where halving stops.
LEAST_WIDTH, MOST_DEPTH = 500, 8


def split_bands(pages_for: Callable[[int, int], int | None], lo: int, hi: int, ceiling: int, least_width: int = LEAST_WIDTH, most_depth: int = MOST_DEPTH) -> list[tuple[int, int]]:
    """Bands that cover lo..hi without overlap, halved until each has at most ceiling pages; an unmeasurable one stays whole."""
    found, waiting = [], [(lo, hi, 0)]
    while waiting:
        a, b, depth = waiting.pop()
        pages = pages_for(a, b)
        if pages is None or pages <= ceiling or depth >= most_depth or b - a <= least_width:
            found.append((a, b))
        else:
            middle = (a + b) // 2
            waiting += [(middle + 1, b, depth + 1), (a, middle, depth + 1)]
    return found


def price_histogram(listings: DataFrame, lo: int, hi: int, depth: int = MOST_DEPTH) -> DataFrame:
    """cell, n: listings in each of the 2^depth cells into which halving can cut lo..hi; one aggregation for all bands."""
    inside = listings.where(F.col("price").between(lo, hi))
    low, high, path = F.lit(lo), F.lit(hi), F.lit(0)
    for _ in range(depth):
        middle = F.floor((low + high) / 2)
        right = F.col("price") > middle
        low, high, path = F.when(right, middle + 1).otherwise(low), F.when(right, high).otherwise(middle), path * 2 + right.cast("int")
        inside = inside.withColumns({"_low": low, "_high": high, "_path": path})
        low, high, path = F.col("_low"), F.col("_high"), F.col("_path")
    return inside.groupBy(F.col("_path").cast("long").alias("cell")).agg(F.min("_low").cast("long").alias("lo"), F.max("_high").cast("long").alias("hi"), F.count("*").alias("n"))


def bands_of(listings: DataFrame, lo: int, hi: int, ceiling: int, page_size: int) -> list[tuple[int, int]]:
    """Bands for the listings of a catalogue; only the histogram, at most 2^depth rows, comes to the driver."""
    cells = [(r["lo"], r["hi"], r["n"]) for r in price_histogram(listings, lo, hi).collect()]

    def pages(a: int, b: int) -> int:
        return -(-sum(n for low, high, n in cells if low >= a and high <= b) // page_size)

    return split_bands(pages, lo, hi, ceiling)


def band_counts(listings: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """lo, hi, n of each band. The bands of a catalogue are few (2^depth at most) and in order, so a row's band is how many begin at or below its price."""
    table = listings.sparkSession.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(bands)], "band int, lo long, hi long")
    starts = F.array(*(F.lit(a).cast("long") for a, _ in bands))
    inside = listings.select("price", F.size(F.filter(starts, lambda a: a <= F.col("price"))).alias("band")).where(F.col("price").between(bands[0][0], bands[-1][1]))
    counts = inside.groupBy("band").agg(F.count("*").alias("n"))
    return table.join(counts, "band", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def planned_bands(total_pages: int | None, prices: tuple[int, int], pages_for: Callable[[int, int], int | None], ceiling: int) -> list[tuple[int, int] | None]:
    """The bands to crawl a search by; [None] for the search as it is: it fits, could not be measured, or has no upper price to split at."""
    if total_pages is None or total_pages <= ceiling or not prices[1]:
        return [None]
    return list(split_bands(pages_for, prices[0], prices[1], ceiling))


def union_of_bands(sightings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The sightings of several bands of one search, each listing once: bands meet at their bounds, and the first sighting counts."""
    at = F.struct(*map(F.col, order))
    rest = [c for c in sightings.columns if c not in key]
    return sightings.groupBy(*key).agg(F.min_by(F.struct(*rest), at).alias("first")).select(*key, "first.*").select(*sightings.columns)
