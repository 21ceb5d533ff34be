"""Forced runs are believed whatever they saw, so nothing is counted for them."""

from hearthlake.operators import gone


def test_forced_runs_read_the_bridge_once(spark):
    bridge = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "b", 1), (3, "a", 1), (4, "c", 5)], "listing_id long, search string, last_seen long")
    runs = spark.createDataFrame([("a", 2), ("b", 4), ("none", 9)], "search string, ts long")
    missed = gone.missing_listings(bridge, runs, force=True)
    assert sorted(map(tuple, missed.collect())) == [(2, 2), (3, 2)]
    assert missed._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
