"""The state rules of the store: merging, prices, absence, details, against a fold over the sightings in order."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthlake.operators import bands, gone, merge, probe
from hearthlake.operators.filters import ingest_skip_by_spec
from hearthlake.operators.ranks import ranked

ORDER = ["ts", "page", "pos"]
T = [datetime(2024, 1, d) for d in range(1, 10)]


def sightings(spark, rows):
    return spark.createDataFrame(rows, "source string, external_id string, ts timestamp_ntz, page int, pos int, price long, living_m2 int")


def fold(rows, known=()):
    """What one listing after another does to the store, card by card."""
    price, seen, statuses = dict(known), set(dict(known)), []
    for source, ext, ts, page, pos, new, _ in sorted(rows, key=lambda r: r[2:5]):
        key, status = (source, ext), "same"
        if key not in seen:
            status = "new"
        elif new is not None and price.get(key) is not None and new != price[key]:
            status = "price_drop" if new < price[key] else "price_rise"
        seen.add(key)
        if new is not None:
            price[key] = new
        statuses.append((*key, ts, page, pos, status))
    return statuses, price


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_statuses_equal_the_fold(spark, seed):
    draw = random.Random(seed)
    rows = [("a" if draw.random() < 0.5 else "b", str(draw.randint(1, 6)), draw.choice(T), i // 10, i % 10, draw.choice([None, 100, 100, 120, 90]), draw.choice([None, 50, 60])) for i in range(120)]
    wanted, prices = fold(rows)
    found = merge.classified(sightings(spark, rows), None, ORDER).select("source", "external_id", "ts", "page", "pos", "status").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    snapshot = merge.merged_snapshot(sightings(spark, rows), ORDER, ["price", "living_m2"]).collect()
    assert {(r["source"], r["external_id"]): r["price"] for r in snapshot} == {k: prices.get(k) for k in {(r[0], r[1]) for r in rows}}
    early, late = [r for r in rows if r[2] < T[4]], [r for r in rows if r[2] >= T[4]]
    _, known = fold(early)
    stored = merge.merged_snapshot(sightings(spark, early), ORDER, ["price"])
    found = merge.classified(sightings(spark, late), stored, ORDER).select("source", "external_id", "ts", "page", "pos", "status").collect()
    assert sorted(map(tuple, found)) == sorted(fold(late, {(r[0], r[1]): known.get((r[0], r[1])) for r in early})[0])


def test_identity(spark):
    rows = spark.createDataFrame([(7, None, ""), (8, "x", "homege")], "id long, external_id string, source string")
    assert sorted(map(tuple, merge.with_identity(rows).select("source", "external_id").collect())) == [("franimo", "7"), ("homege", "x")]
    with pytest.raises(Exception, match="external id"):
        merge.with_identity(spark.createDataFrame([(None, "")], "external_id string, source string")).collect()


def listing(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, living_m2 int, price long, raw_fields string, lat double, lon double, detail_fetched timestamp_ntz, gone_at timestamp_ntz")


def test_details_fill_and_clear(spark):
    stored = listing(spark, [(i, s, 80, 1000, None, 1.0, 2.0, None, None) for i, s in enumerate(("franimo", "franimo", "homege", "homege"))])
    details = spark.createDataFrame([(0, None, 900, '{"a": "b"}', 5.0, 139256123.0), (1, None, None, "", None, None), (2, None, 900, '{"a": "b"}', None, None)], "id long, living_m2 int, price long, raw_fields string, lat double, lon double")
    found = {r["id"]: r for r in merge.apply_details(stored, details, F.lit(T[3]).cast("timestamp_ntz")).collect()}
    assert [found[i]["living_m2"] for i in range(4)] == [None, 80, 80, 80]
    assert [found[i]["price"] for i in range(4)] == [900, 1000, 900, 1000] and (found[0]["lat"], found[0]["lon"]) == (5.0, 2.0)
    assert [found[i]["detail_fetched"] for i in range(4)] == [T[3], T[3], T[3], None]


@pytest.mark.parametrize(("known", "seen", "force", "marked"), [(20, 9, False, 0), (20, 0, False, 0), (1000, 970, False, 30), (8, 5, False, 3), (20, 2, True, 18), (8, 3, False, 5)])
def test_absence_is_believed_only_of_whole_runs(spark, known, seen, force, marked):
    bridge = spark.createDataFrame([(i, "s", T[2] if i < seen else T[1]) for i in range(known)], "listing_id long, search string, last_seen timestamp_ntz")
    runs = spark.createDataFrame([("s", T[2])], "search string, ts timestamp_ntz")
    stored = listing(spark, [(i, "a", None, None, None, None, None, None, None) for i in range(known)])
    assert gone.mark_gone(stored, bridge, runs, force).where("gone_at is not null").count() == marked


def test_a_sighting_brings_a_listing_back(spark):
    rows = merge.merged_snapshot(sightings(spark, [("a", "1", T[0], 1, 1, 5, None)]), ORDER, ["price"])
    assert rows.first()["gone_at"] is None


def test_cards_as_written(spark):
    cards = spark.createDataFrame([(95.0, 10.0, 3, None, None, ""), (45.0, 139256123.0, None, 2, True, "USD")], "lat double, lon double, beds int, bedrooms int, promoted boolean, currency string")
    assert [tuple(r) for r in merge.card_values(cards).select("lat", "lon", "bedrooms", "promoted", "currency").collect()] == [(None, 10.0, 3, False, "EUR"), (45.0, None, 2, True, "USD")]


def test_skip_rules_by_search(spark):
    specs = spark.createDataFrame([("s", (True, 100, None)), ("t", None)], "search string, skip struct<priceless:boolean,above:long,below:long>")
    cards = spark.createDataFrame([("s", 50), ("s", 150), ("s", None), ("t", None), ("u", 1)], "search string, price long")
    assert sorted(map(tuple, ingest_skip_by_spec(cards, specs).collect()), key=repr) == sorted([("s", 50), ("t", None), ("u", 1)], key=repr)


@pytest.mark.parametrize("ceiling", [5, 20, 60])
def test_bands_cover_touch_and_fit(ceiling):
    pages = lambda a, b: (b - a) // 1500 + 1
    found = bands.split_bands(pages, 0, 150_000, ceiling)
    assert found[0][0] == 0 and found[-1][1] == 150_000 and all(b + 1 == c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert all(pages(a, b) <= ceiling for a, b in found)
    assert bands.split_bands(lambda a, b: None, 0, 9000, 1) == [(0, 9000)]


def test_histogram_bands_equal_counting(spark):
    draw = random.Random(4)
    prices = [int(draw.triangular(0, 100_000, 10_000)) for _ in range(3000)]
    rows = spark.createDataFrame([(p,) for p in prices], "price long")
    count = lambda a, b: -(-sum(a <= p <= b for p in prices) // 20)
    assert bands.bands_of(rows, 0, 100_000, 10, 20) == bands.split_bands(count, 0, 100_000, 10)


@pytest.mark.parametrize(("ours", "live", "drifts"), [(10129, 10140, False), (10129, 10496, True), (1000, 1040, False), (1000, 1050, True), (11, 12, True), (None, 5, False)])
def test_drift(spark, ours, live, drifts):
    assert spark.range(1).select(probe.is_drift(F.lit(ours).cast("long"), F.lit(live).cast("long")).alias("x")).first()["x"] is drifts


def test_live_count_and_report(spark):
    count, kind = probe.live_count(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(58), F.lit(3), F.lit(6))
    assert tuple(spark.range(1).select(count, kind).first()) == (345, "estimate")
    seeds = spark.createDataFrame([("a", "s", 100, "x" * 100, 300, None, 1, 2, 20, True, "USD"), ("b", "s", None, "Just a moment..." + "x" * 80, 5, None, 1, 2, 20, False, None), ("c", "s", 5, "", None, None, 1, 2, 20, False, None)],
                                  "search string, source string, ours long, html string, total long, result_count long, pages long, cards long, page_size long, has_skip boolean, catalogue_currency string")
    report = probe.probe(seeds)
    assert {r["search"]: r["note"] for r in report.collect()} == {"a": "exact; list wider than skip; USD catalogue drift", "b": "blocked", "c": "error"}
    assert tuple(probe.drift_summary(report).first()) == (3, 1, 1, 1, True)
    assert all("  " in r["line"] for r in probe.report_lines(report).collect())


def test_early_stop_and_queue(spark):
    pages = spark.createDataFrame([("s", 1, True), ("s", 1, False), ("s", 2, False), ("s", 3, True), ("t", 1, True)], "search string, page int, kept boolean")
    assert sorted((r["search"], r["page"]) for r in merge.early_stop(pages).collect()) == [("s", 1), ("s", 1), ("s", 2), ("t", 1)]
    stored = listing(spark, [(1, "a", None, 50, None, None, None, None, None), (2, "a", None, None, None, None, None, None, None), (3, "a", None, 10, None, None, None, None, None), (4, "a", None, 1, None, None, None, T[0], None)])
    assert [r["id"] for r in merge.detail_queue(stored, 9).collect()] == [3, 1, 2]


def test_numbers_in_order_within_groups(spark):
    rows = spark.createDataFrame([("a" if i % 5 else "b", i) for i in range(500)], "g string, v int").repartition(7)
    found = ranked(rows, [F.col("v").desc()], "n", within="g").collect()
    for g in ("a", "b"):
        assert [r["v"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["n"])] == [v for v in range(499, -1, -1) if ("a" if v % 5 else "b") == g]
        assert sorted(r["n"] for r in found if r["g"] == g) == list(range(sum(r["g"] == g for r in found)))
    assert sorted(r["n"] for r in ranked(rows, [F.col("v")], "n", first=10).collect()) == list(range(10, 510))
    assert ranked(rows.limit(0), [F.col("v")], "n").count() == 0


def test_bands_are_planned_only_where_they_help():
    pages = lambda a, b: (b - a) // 1000
    assert bands.planned_bands(20, (0, 90_000), pages, 20) == bands.planned_bands(None, (0, 90_000), pages, 20) == bands.planned_bands(25, (0, 0), pages, 20) == [None]
    found = bands.planned_bands(90, (0, 90_000), pages, 20)
    assert found == bands.split_bands(pages, 0, 90_000, 20) and len(found) > 1


def test_texts_sort_by_the_rules_of_their_language(spark):
    from hearthlake.operators.view import sorted_page

    rows = spark.createDataFrame(list(enumerate(["Zeist", "ézé", "ezel", "", None, "Édam", "aap"])), "id long, place string")
    assert [r["place"] for r in sorted_page(rows, "place").collect()][:5] == ["aap", "Édam", "ézé", "ezel", "Zeist"]


def test_a_store_from_before_some_columns(spark):
    from hearthlake.schema import LISTING

    old = spark.createDataFrame([(7, '{"country": "Spain"}', 3), (8, "{", 4)], "id long, raw_fields string, odd int")
    new = merge.migrated(old)
    assert [p.split(" ", 1)[0] for p in LISTING.split(", ")] == [c for c in [p.split(" ", 1)[0] for p in LISTING.split(", ")] if c in new.columns]
    assert sorted((r["id"], r["source"], r["external_id"], r["country"], r["odd"]) for r in new.collect()) == [(7, "franimo", "7", "ES", 3), (8, "franimo", "8", "FR", 4)]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as Some

    from hearthlake.session import shared_dir

    def session(master, given=None):
        folder = Some(isEmpty=lambda: True)
        conf = Some(get=lambda name, default: given)
        return Some(sparkContext=Some(getConf=lambda: conf, master=master, _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: folder))))

    assert shared_dir(session("spark://h:7077", "hdfs://n/shared/")) == "hdfs://n/shared"
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://h:7077"))
