"""The store that a stream of sightings leaves: three arrivals, each merged when it is there, with the SQL of one batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.plans import derived as D
from hearthlake.plans.listing_queries import ORACLES as LISTING_ORACLES
from hearthlake.plans.listing_queries import W_CLASSIFIED, gone_inputs
from hearthlake.session import shared_dir
from hearthlake.streaming.keyed_state import GoneStream, KeyedStore
from hearthlake.streaming.merge_stream import Store

COLUMNS = ["price", "living_m2", "type"]
ARRIVALS = ["ts < '1994-01-01'", "ts >= '1994-01-01' AND ts < '1997-01-01'", "ts >= '1997-01-01'"]


def streamed(spark: SparkSession, sf_dir: str) -> Store:
    """The store after the sightings arrived in three parts, in order of time; the stream is started for each and goes on where it ended."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = D.observations(spark, sf_dir)
    store = Store(spark, f"{root}/store", COLUMNS, D.SIGHTING_ORDER)
    for n, arrived in enumerate(ARRIVALS):
        rows.where(arrived).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        store.start(stream, f"{root}/progress").awaitTermination()
    return store


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = streamed(spark, sf_dir)
    return store.listings(store.last()).select("source", "external_id", *COLUMNS, "first_seen", "last_seen")


def stream_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir).history().groupBy("status").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


QUERIES = {"stream_snapshot": stream_snapshot, "stream_statuses": stream_statuses}
ORACLES = {
    "stream_snapshot": LISTING_ORACLES["merge_snapshot"],
    "stream_statuses": W_CLASSIFIED + "SELECT status, count(*) AS n, count(price) AS priced FROM classified WHERE status <> 'same' GROUP BY status",
}


def keyed(spark: SparkSession, sf_dir: str) -> KeyedStore:
    """The store of the stream with keyed state after the same three arrivals."""
    root = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    rows = D.observations(spark, sf_dir)
    store = KeyedStore(spark, f"{root}/store", COLUMNS, D.SIGHTING_ORDER)
    for n, arrived in enumerate(ARRIVALS):
        rows.where(arrived).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        store.start(stream, f"{root}/progress").awaitTermination()
    return store


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).listings().select("source", "external_id", *COLUMNS, "first_seen", "last_seen")


def stream_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of every search, then the ends of its runs, each in an arrival of its own."""
    root = f"{shared_dir(spark)}/gone-{uuid.uuid4().hex}"
    daily, runs = gone_inputs(spark, sf_dir)
    seen = daily.select("listing_id", "search", F.col("last_seen").alias("ts"))
    late = F.pmod("listing_id", F.lit(3)) == 0
    ends = runs.select(F.lit(None).cast("long").alias("listing_id"), "search", "ts")
    stream = GoneStream(spark, f"{root}/store")
    for n, arrived in enumerate((seen.where(late), seen.where(~late).unionByName(ends))):
        arrived.write.parquet(f"{root}/in/{n}")
        source = spark.readStream.schema(seen.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        stream.start(source, f"{root}/progress").awaitTermination()
    return stream.applied(D.listings(spark, sf_dir).select("id", "gone_at"))


QUERIES |= {"stream_state": stream_state, "stream_gone": stream_gone}
ORACLES |= {"stream_state": LISTING_ORACLES["merge_snapshot"], "stream_gone": LISTING_ORACLES["mark_gone_guarded"]}
