"""A stream with keyed state leaves what one batch would, restarts, and writes no listing that it did not see."""

from datetime import datetime

from pyspark.sql import functions as F

from hearthlake.operators import merge
from hearthlake.plans import derived as D
from hearthlake.streaming.keyed_state import GoneStream, KeyedStore

SF = "/root/testdata/sf0.001"
COLUMNS = ["price", "living_m2", "type"]


def arrivals(rows, path, bounds):
    for i, (a, b) in enumerate(bounds):
        rows.where(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.parquet(f"{path}/{i}")
        yield i


def test_state_survives_restarts_and_touches_only_what_it_sees(spark, tmp_path):
    rows = D.observations(spark, SF).where("listing_id <= 60")
    store = KeyedStore(spark, f"{tmp_path}/store", COLUMNS, D.SIGHTING_ORDER)
    seen = []
    for i in arrivals(rows, f"{tmp_path}/in", (("1900-01-01", "1998-01-01"), ("1998-01-01", "1998-02-01"), ("1998-02-01", "2100-01-01"))):
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        assert store.start(stream, f"{tmp_path}/cp").awaitTermination(120)  # a new query each time
        seen.append(spark.read.parquet(f"{tmp_path}/in/{i}").select("source", "external_id").distinct().count())
    wanted = merge.merged_snapshot(rows, D.SIGHTING_ORDER, COLUMNS).drop("gone_at")
    same = lambda: not store.listings().select(*wanted.columns).exceptAll(wanted).count() and store.listings().count() == wanted.count()
    history = merge.new_history(merge.classified(rows, None, D.SIGHTING_ORDER)).select("source", "external_id", "ts", "price", "before", "status")
    kept = lambda: not store.history().exceptAll(history).count() and store.history().count() == history.count()
    assert same() and kept()
    written = [r["n"] for r in store.log().groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert written == seen and written[1] < wanted.count()
    store.compact()
    assert same() and kept() and store.log().select("batch").distinct().count() == 1


def test_a_run_end_decides_and_a_late_sighting_brings_back(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    shape = "listing_id long, search string, ts timestamp_ntz"
    gone, n = GoneStream(spark, f"{tmp_path}/gone"), iter(range(9))

    def arrive(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{next(n)}")
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        assert gone.start(stream, f"{tmp_path}/cp").awaitTermination(60)
        return {(r["listing_id"], r["missed_at"]) for r in gone.marks().collect()}

    assert arrive([(i, "a", day(1)) for i in range(20)] + [(None, "a", day(1))]) == set()
    assert arrive([(i, "a", day(2)) for i in range(8)]) == set()  # the run has not ended
    assert arrive([(i, "a", day(2)) for i in range(8, 16)] + [(None, "a", day(2))]) == {(i, day(2)) for i in range(16, 20)}
    assert arrive([(17, "a", day(3))]) == {(i, day(2)) for i in (16, 18, 19)}
    # A run that sees too little is not believed.
    assert arrive([(0, "a", day(4)), (None, "a", day(4))]) == {(i, day(2)) for i in (16, 18, 19)}
