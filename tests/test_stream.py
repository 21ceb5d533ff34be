"""A stream of sightings leaves the store that one batch would."""

import pytest

from hearthlake.operators import merge
from hearthlake.plans import derived as D
from hearthlake.streaming.merge_stream import Store, new_by_day

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_replays(spark, tmp_path):
    rows = D.observations(spark, SF)
    for i, (a, b) in enumerate((("1900-01-01", "1994-01-01"), ("1994-01-01", "1997-01-01"), ("1997-01-01", "2100-01-01"))):
        rows.where(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    columns = ["price", "living_m2", "type"]
    store = Store(spark, f"{tmp_path}/store", columns, D.SIGHTING_ORDER)
    assert store.start(stream, f"{tmp_path}/cp").awaitTermination(180)
    wanted = merge.merged_snapshot(rows, D.SIGHTING_ORDER, columns).drop("gone_at")
    same = lambda: not store.listings(2).select(*wanted.columns).exceptAll(wanted).count() and store.listings(2).count() == wanted.count()
    statuses = lambda: {r["status"]: r["count"] for r in store.history().groupBy("status").count().collect()}
    batch = merge.new_history(merge.classified(rows, None, D.SIGHTING_ORDER))
    assert same() and statuses() == {r["status"]: r["count"] for r in batch.groupBy("status").count().collect()}
    before = statuses()
    store.merge(spark.read.parquet(f"{tmp_path}/in/2"), 2)  # a replayed batch
    assert same() and statuses() == before and store.last() == 2
    with pytest.raises(FileNotFoundError):
        store.merge(rows, 7)  # version 6 is missing


def test_daily_counts_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    running = new_by_day(stream).writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    closed = {(r["day"], r["event_type"]): r["n"] for r in spark.table("days").collect()}
    whole = {(r["day"], r["event_type"]): r["n"] for r in new_by_day(events).collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())
