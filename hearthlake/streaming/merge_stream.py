"""Sightings as a stream: each micro-batch is merged into the stored listings, history and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthlake.operators.merge import KEY, classified, merged_snapshot, new_history


class Store:
    """Listings as versioned snapshots, history as batches: a batch that is replayed writes the same files again."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], order: list[str]):
        self.spark, self.path, self.columns, self.order = spark, path.rstrip("/"), columns, order

    def version(self, n: int) -> str:
        return f"{self.path}/listings/v{n}"

    def listings(self, n: int) -> DataFrame:
        return self.spark.read.parquet(self.version(n))

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/history")

    def exists(self, n: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.version(n) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def last(self) -> int:
        """The number of the newest whole version."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/listings")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        return max(n for n in (int(s.getPath().getName()[1:]) for s in found) if self.exists(n))

    def merge(self, batch: DataFrame, n: int) -> None:
        """Batch n of sightings on top of version n - 1: writes its history rows, then version n."""
        if n and not self.exists(n - 1):
            raise FileNotFoundError(f"{self.version(n - 1)} is missing: without it every listing of batch {n} would count as new")
        known = self.listings(n - 1) if n else None
        statuses = classified(batch, known, self.order)
        new_history(statuses).select(*KEY, "ts", "price", "status").write.mode("overwrite").parquet(f"{self.path}/history/batch={n}")
        seen = batch.select(*KEY, *self.order, *(c for c in self.columns if c not in self.order), F.col("ts").alias("_from"), F.col("ts").alias("_to"))
        if known is not None:
            # A stored row counts as the earliest sighting of all.
            stored = known.select(*KEY, *self.columns, F.col("first_seen").alias("_from"), F.col("last_seen").alias("_to"))
            seen = seen.unionByName(stored, allowMissingColumns=True)
        merged = merged_snapshot(seen.withColumn("ts", F.coalesce("ts", "_from")), self.order, self.columns)
        spans = seen.groupBy(*KEY).agg(F.min("_from").alias("first_seen"), F.max("_to").alias("last_seen"))
        merged.drop("first_seen", "last_seen").join(spans, KEY).write.mode("overwrite").parquet(self.version(n))

    def start(self, sightings: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges a streaming DataFrame until its source is exhausted; started again, it goes on where it ended."""
        return sightings.writeStream.foreachBatch(lambda batch, n: self.merge(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_by_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events (ts, event_type, value) counted by day and type, final once the watermark has passed the day."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")
