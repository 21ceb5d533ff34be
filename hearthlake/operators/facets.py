"""Facet counts, each under all filters but its own, in one scan of the view."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthlake.functions.text import pretty_source, source_rank
from hearthlake.operators.filters import FACETS, FilterSpec, facet_predicates, facet_values, matching, predicates
from hearthlake.operators.selection import upper_medians
from hearthlake.session import written

#: Values shown of a facet; the source facet shows more.
SHOWN, SHOWN_SOURCES = 8, 20


def labelled(facet: str):
    """Column function: a value as an entry of the facet."""
    return lambda value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))


def facet_counts(view: DataFrame, spec: FilterSpec, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """facet, value, n, first_id: every value of every facet with the rows that would remain if it were chosen.

    Each row is read once and gives its values for those facets whose leave-one-out condition it
    meets; what is shuffled is one partial count for each value and task.
    """
    own = facet_predicates(spec)
    for p in predicates(spec):
        view = view.where(p)
    entries = []
    for name in facets:
        others = reduce(and_, (p for k, p in own.items() if k != name), F.lit(True))
        entries.append(F.when(others, F.transform(facet_values(name), labelled(name))).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    rows = view.select("id", F.explode(F.flatten(F.array(*entries))).alias("at"))
    return rows.groupBy("at.facet", "at.value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def top_values(counts: DataFrame, shown: int = SHOWN, shown_sources: int = SHOWN_SOURCES) -> DataFrame:
    """The values that a facet shows, with place from 1: most rows first, ties by first appearance; sources in their fixed order."""
    is_source = F.col("facet") == "source"
    keys = [
        F.when(is_source, source_rank(F.col("value"))).otherwise(0),
        F.when(is_source, pretty_source(F.col("value"))),
        F.col("n").desc(),
        F.col("first_id"),
    ]
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy(*keys)))
    return ranked.where(F.col("place") <= F.when(is_source, shown_sources).otherwise(shown))


def facet(view: DataFrame, spec: FilterSpec, name: str) -> DataFrame:
    """value, n of one facet."""
    rows = matching(view, spec, skip=name).select(F.explode(facet_values(name)).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def summary(view: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row: n, total, median_price, median_eur_m2, drops, without_detail. Medians are of the rows that match; the view is read once."""
    matches = reduce(and_, [*predicates(spec), *facet_predicates(spec).values()], F.lit(True))
    some = written(view.select(F.coalesce(matches, F.lit(False)).alias("in"), "price", "eur_m2", (F.col("price_drop") > 0).alias("drop"), F.col("detail_fetched").isNull().alias("plain")), "summary")
    counts = some.agg(F.count_if("in").alias("n"), F.count("*").alias("total"), F.count_if(F.col("in") & F.col("drop")).alias("drops"), F.count_if(F.col("in") & F.col("plain")).alias("without_detail"))
    for column in ("price", "eur_m2"):
        middle = upper_medians(some.where("in"), column, []).withColumnRenamed(column, f"median_{column}")
        counts = counts.unionByName(middle, allowMissingColumns=True)
    # Three rows at most, each with columns of its own.
    return counts.agg(*(F.max(c).alias(c) for c in ("n", "total", "median_price", "median_eur_m2", "drops", "without_detail")))
