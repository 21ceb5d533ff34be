"""Sightings as a stream with keyed state: a batch reads and writes the shelves that its own listings lie on, no others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from hearthlake.operators import gone
from hearthlake.operators.merge import KEY

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "struct<ts:timestamp_ntz,price:bigint,before:bigint,status:string>"
#: Keys of the state, and shelves of each. A listing lies on the shelf that its hash says, and stays there: neither can change for a stream that has begun.
BUCKETS, SHELVES = 2048, 16
MOMENT = pa.timestamp("us")


def written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket of a batch as one row."""
    for batch in batches:
        if batch.num_rows:
            table = batch.take(pc.sort_indices(batch.column("_bucket")))
            bucket = table.column("_bucket").to_numpy()
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = pa.Table.from_batches([table]).drop_columns(["_bucket"])
            parts = [written(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(parts, pa.binary())], ["_bucket", "rows"])


def picked(values: pa.ChunkedArray, at: np.ndarray) -> pa.ChunkedArray:
    """The values at some places, null where a place is under zero."""
    return values.take(pa.array(at, mask=at < 0))


def least(values: pa.ChunkedArray, starts: np.ndarray, sign: int) -> pa.Array:
    """The earliest moment of each group, the latest with sign -1; null where a group has none."""
    none = np.iinfo(np.int64).max
    whole = values.cast(pa.int64())
    found = np.minimum.reduceat(np.where(whole.is_valid().to_numpy(), sign * whole.fill_null(0).to_numpy(), none), starts)
    return pa.array(np.where(found == none, 0, sign * found), mask=found == none).cast(MOMENT)


class ListingState(StatefulProcessor):
    """The last value of each column with the place it was seen at, the last price, and the span of sightings of each listing.

    Sightings of a batch are taken in their order; the price of each is compared with the last one known.
    A column's value is replaced by later sightings only, so batches that come late leave newer values alone.
    The listings of a bucket are folded together, column by column; a shelf of it is read and written only if
    one of its listings is in the batch.
    """

    def __init__(self, columns: list[str], order: list[str], schema: StructType, ttl_ms: int | None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms
        kinds = {f.name: f.type for f in to_arrow_schema(schema)}
        places = [(f"{c}__{o}", kinds[o]) for c in columns for o in order]
        values = [(c, kinds[c]) for c in [*KEY, *columns]]
        self.held = pa.schema([*values, *places, ("before", kinds["price"]), ("first_seen", MOMENT), ("last_seen", MOMENT), ("_shelf", pa.int32()), ("_met", pa.int64())])
        changes = pa.list_(pa.struct([("ts", MOMENT), ("price", pa.int64()), ("before", pa.int64()), ("status", pa.string())]))
        self.shape = pa.schema([*values, ("first_seen", MOMENT), ("last_seen", MOMENT), ("changes", changes)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("listings", "shelf int", "held binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = pa.concat_tables([pa.ipc.open_stream(row["rows"]).read_all() for row in rows])
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
        shelves = [self.state.getValue((n,)) for n in pc.unique(new["_shelf"]).to_pylist()]
        held = pa.concat_tables([self.held.empty_table(), *(pa.ipc.open_stream(shelf[0]).read_all() for shelf in shelves if shelf is not None)])
        if self.ttl_ms is not None:
            held = held.filter(pc.greater(pc.add(held["_met"], self.ttl_ms), now))
        state, updates = self.folded(new, held, now)
        shelf = state["_shelf"].to_numpy()
        starts = np.flatnonzero(np.diff(shelf, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(shelf)], strict=True):
            self.state.updateValue((int(shelf[a]),), (written(state.slice(a, b - a)),))
        yield Row(updates=written(updates))

    def folded(self, new: pa.Table, held: pa.Table, now: int) -> tuple[pa.Table, pa.Table]:
        """The state after some sightings, by shelf, and a row for each listing that they are of."""
        # A row for each stored listing, one for each stored value at the place where it was seen, then the sightings: the last value in order is the one that holds.
        stored = held.select([*KEY, "_shelf", "before", "_met"]).append_column("_from", held["first_seen"]).append_column("_to", held["last_seen"])
        parts = [stored.append_column("_kind", pa.array(np.zeros(len(held), np.int8)))]
        for c in self.columns:
            seen = held.filter(held[c].is_valid())
            at = {o: seen[f"{c}__{o}"] for o in self.order}
            parts.append(pa.table({k: seen[k] for k in [*KEY, "_shelf"]} | at | {c: seen[c], "_kind": pa.array(np.ones(len(seen), np.int8))}))
        moment = new["ts"].cast(MOMENT)
        parts.append(new.append_column("_from", moment).append_column("_to", moment).append_column("_kind", pa.array(np.full(len(new), 2, np.int8))))
        rows = pa.concat_tables(parts, promote_options="default").combine_chunks()
        listing = rows["_shelf"].to_numpy().astype(np.int64)
        for k in KEY:
            codes = rows[k].combine_chunks().dictionary_encode("encode")
            listing = listing * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
        keys = [(k, "ascending") for k in ["_listing", *self.order, "_kind"]]
        rows = rows.append_column("_listing", pa.array(listing))
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        kind, group = rows["_kind"].to_numpy(), np.diff(rows["_listing"].to_numpy(), prepend=-1) != 0
        starts = np.flatnonzero(group)
        group = np.cumsum(group) - 1
        known = kind[starts] == 0
        base = np.where(known, starts, -1)
        out = {k: rows[k].take(pa.array(starts)) for k in [*KEY, "_shelf"]}
        for c in self.columns:
            last = np.maximum.reduceat(np.where(rows[c].is_valid().to_numpy(), np.arange(len(rows)), -1), starts)
            out |= {c: picked(rows[c], last)} | {f"{c}__{o}": picked(rows[o], last) for o in self.order}
        out |= {"first_seen": least(rows["_from"], starts, 1), "last_seen": least(rows["_to"], starts, -1)}

        # The sightings alone: the price before each is that of the last priced one of its listing, else the stored one.
        at = np.flatnonzero(kind == 2)
        sightings, of, n = rows.take(pa.array(at)), group[at], len(at)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        begins = np.repeat(first, np.diff([*first, n]))
        prices = pa.chunked_array([*sightings["price"].chunks, *picked(rows["before"], base).chunks], rows["price"].type)
        priced = np.where(sightings["price"].is_valid().to_numpy(), np.arange(n), -1)
        previous = np.concatenate(([-1], np.maximum.accumulate(priced)[:-1]))
        before = prices.take(pa.array(np.where(previous >= begins, previous, n + of)))
        lower, higher = (test(sightings["price"], before).fill_null(False).to_numpy() for test in (pc.less, pc.greater))
        status = np.select([(np.arange(n) == begins) & ~known[of], lower, higher], ["new", "price_drop", "price_rise"], "same")
        last = np.full(len(starts), -1)
        last[of[first]] = np.maximum.reduceat(priced, first)
        out["before"] = prices.take(pa.array(np.where(last >= 0, last, n + np.arange(len(starts)))))
        met = np.isin(np.arange(len(starts)), of[first])
        out["_met"] = pa.array(np.where(met, now, picked(rows["_met"], base).fill_null(0).to_numpy()))

        changed = np.flatnonzero(status != "same")
        what = sightings.take(pa.array(changed))
        fields = [what["_from"], what["price"], before.take(pa.array(changed)), pa.chunked_array([pa.array(status[changed].tolist(), pa.string())])]
        kinds = self.shape.field("changes").type
        entries = pa.StructArray.from_arrays([f.combine_chunks().cast(kinds.value_type.field(i).type) for i, f in enumerate(fields)], fields=list(kinds.value_type))
        ends = np.cumsum(np.bincount(of[changed], minlength=len(starts))[of[first]])
        updates = {c: picked(pa.chunked_array([out[c]]) if isinstance(out[c], pa.Array) else out[c], of[first]) for c in self.shape.names[:-1]}
        updates["changes"] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), entries).cast(kinds)
        return pa.table({c: out[c] for c in self.held.names}, schema=self.held), pa.table(updates, schema=self.shape)

    def close(self) -> None:
        pass


class KeyedStore:
    """Listings as a log of what each batch changed: a row for every listing that it saw, none for the others.

    The state is Spark's own, in the checkpoint of the stream, so a stream that is started again goes on with it.
    A batch that is replayed writes the same folder again. compact() folds the log into one row a listing.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], order: list[str]):
        self.spark, self.path, self.columns, self.order = spark, path.rstrip("/"), columns, order

    def start(self, sightings: DataFrame, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
        """Takes a streaming DataFrame until its source is exhausted. With ttl_ms the state of a listing not seen for so long goes, and a later sighting is new again."""
        needed = list(dict.fromkeys([*KEY, *self.order, *self.columns, "price", "ts"]))
        processor = ListingState(self.columns, self.order, sightings.select(*needed).schema, ttl_ms)
        shape = ", ".join([*(f"{c} {sightings.schema[c].dataType.simpleString()}" for c in [*KEY, *self.columns]), "first_seen timestamp_ntz, last_seen timestamp_ntz", f"changes array<{CHANGE}>"])
        place = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS * SHELVES))
        # Rows go to Python and back in whole tables: one at a time they cost a hundred times their fold.
        dealt = sightings.select(*needed, (place % BUCKETS).cast("int").alias("_bucket"), F.floor(place / BUCKETS).cast("int").alias("_shelf")).repartition("_bucket")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        states = dealt.mapInArrow(packed, "_bucket int, rows binary").groupBy("_bucket")
        updates = states.transformWithState(processor, "updates binary", "update", "None" if ttl_ms is None else "ProcessingTime")

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for update in batch.column("updates"):
                    yield from pa.ipc.open_stream(update.as_buffer()).read_all().to_batches()

        write = lambda batch, n: batch.select("updates").mapInArrow(unpacked, shape).write.mode("overwrite").parquet(f"{self.path}/log/batch={n}")
        return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")

    def listings(self) -> DataFrame:
        """The last row of every listing."""
        values = [*self.columns, "first_seen", "last_seen"]
        last = self.log().groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch").alias("last"))
        return last.select(*KEY, *(F.col(f"last.{c}").alias(c) for c in values))

    def history(self) -> DataFrame:
        return self.log().select(*KEY, F.explode("changes").alias("change")).select(*KEY, "change.*")

    def compact(self) -> None:
        """Folds all batches so far into the folder of the last one; a failure on the way leaves the log as it is, or with a batch twice, which reads the same."""
        last = self.log().agg(F.max("batch")).first()[0]
        if last is None:
            return
        changes = self.log().groupBy(*KEY).agg(F.array_sort(F.flatten(F.collect_list("changes"))).alias("changes"))
        folded = self.listings().join(changes, KEY)
        staged = f"{self.path}/staged"
        folded.write.mode("overwrite").parquet(staged)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        files = at(self.path).getFileSystem(conf)
        # The old folders go after the folded one is whole beside them; changes are told apart by their place in time.
        old = [s.getPath() for s in files.listStatus(at(f"{self.path}/log"))]
        for folder in old:
            files.delete(folder, True)
        files.rename(at(staged), at(f"{self.path}/log/batch={last}"))


class GoneStream:
    """Which listings a search no longer finds, decided when the marker of a run's end arrives in the stream.

    Rows are sightings (listing_id, search, ts) or run ends (null listing_id, search, ts). A batch first
    folds its sightings into the bridge log; then its run ends are judged against the bridge by the guard of
    completeness. Marks are kept with the run; a listing seen again after its mark is back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def bridge(self, up_to: int | None = None) -> DataFrame:
        log = self.spark.read.parquet(f"{self.path}/bridge")
        log = log if up_to is None else log.where(F.col("batch") <= up_to)
        return log.groupBy("listing_id", "search").agg(F.max("last_seen").alias("last_seen"))

    def take(self, batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        seen = batch.where(F.col("listing_id").isNotNull()).groupBy("listing_id", "search").agg(F.max("ts").alias("last_seen"))
        seen.write.mode("overwrite").parquet(f"{self.path}/bridge/batch={n}")
        ends = batch.where(F.col("listing_id").isNull()).groupBy("search").agg(F.max("ts").alias("ts"))
        gone.missing_listings(self.bridge(n), ends).write.mode("overwrite").parquet(f"{self.path}/marks/batch={n}")
        batch.unpersist()

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(lambda batch, n: self.take(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def marks(self) -> DataFrame:
        """listing_id, missed_at of the listings that are gone: marked in some batch and not seen in a later one."""
        marked = self.spark.read.parquet(f"{self.path}/marks").groupBy("listing_id").agg(F.max("batch").alias("marked"), F.min_by("missed_at", F.struct("batch", "missed_at")).alias("missed_at"))
        seen = self.spark.read.parquet(f"{self.path}/bridge").groupBy("listing_id").agg(F.max("batch").alias("seen"))
        return marked.join(seen, "listing_id", "left").where(F.col("seen").isNull() | (F.col("seen") <= F.col("marked"))).select("listing_id", "missed_at")

    def applied(self, listings: DataFrame) -> DataFrame:
        """listings with gone_at set where it was null and the listing is marked."""
        marks = self.marks().withColumnRenamed("listing_id", "id")
        return listings.join(marks, "id", "left").withColumn("gone_at", F.coalesce("gone_at", "missed_at")).select(*listings.columns)
