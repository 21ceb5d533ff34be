"""Exact medians without a task for all values of a group."""

import random

from pyspark.sql import functions as F

from hearthlake.operators.facets import summary
from hearthlake.operators.filters import FilterSpec
from hearthlake.operators.selection import upper_medians
from hearthlake.plans.listing_queries import listing_view_of


def brute(rows):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([v] if v is not None else [])
    return {g: sorted(x)[len(x) // 2] if x else None for g, x in groups.items()}


def test_equals_sorting_through_many_rounds(spark):
    rng = random.Random(1)
    rows = [("even", float(i)) for i in range(1000)] + [("odd", -float(i)) for i in range(999)]
    rows += [("copies", 5.0)] * 700 + [("copies", float(i)) for i in range(300)] + [("two", 1.0)] * 400 + [("two", 2.0)] * 400
    rows += [("wide", 10.0 ** rng.uniform(-300, 300)) for _ in range(500)] + [("none", None)] * 3 + [("one", 7.5), (None, 1.0), (None, 3.0)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for held, ranges in ((5, 20), (10_000, 100)):
        found = upper_medians(table, "v", ["g"], held, ranges).collect()
        assert len(found) == len({r["g"] for r in found}) and {r["g"]: r["v"] for r in found} == brute(rows)


def test_whole_numbers_beyond_doubles_stay_exact(spark):
    rows = [(2**60 + i,) for i in range(101)]
    assert upper_medians(spark.createDataFrame(rows, "v long"), "v", [], 5, 8).collect()[0]["v"] == 2**60 + 50
    assert upper_medians(spark.createDataFrame([], "v long"), "v", []).count() == 0


def test_summary_sorts_no_whole_group(spark):
    view = listing_view_of(spark, "/root/testdata/sf0.001")
    found = summary(view, FilterSpec())
    assert "percentile" not in found._jdf.queryExecution().toString().replace("percentile_approx", "")
    prices = sorted(r["price"] for r in view.where("gone_at is null and price is not null").select("price").collect())
    assert found.first()["median_price"] == prices[len(prices) // 2]
    assert summary(view.where(F.lit(False)), FilterSpec()).first().asDict() == {"n": 0, "total": 0, "median_price": None, "median_eur_m2": None, "drops": 0, "without_detail": 0}
