"""Shared scratch tables: what cuts a lineage or is read twice goes to the folder that all executors see."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.session import shared_dir


def sent(spark: SparkSession, value) -> Broadcast:
    """A broadcast of any object of this package; classes go along by value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast):
    """The object of sent(), inside a task."""
    return cloudpickle.loads(broadcast.value)


#: Rows that one task writes of a table known to be small: a file for each shuffle partition would cost more than its rows.
ROWS_A_FILE = 250_000
#: Bytes of rows that Spark hands to Python at a time.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes, so that long texts never fill a task's memory.

    The bound is a setting of the session, read when the plan is made; a smaller one is left as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)b?", conf.get(name))
    if given is None or int(given[1]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class Scratch:
    """Tables of one operator run, each written once and read back with its true size known to the planner."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str, rows: int | None = None, **options: str) -> DataFrame:
        """Write df and return the written table; where df has at most so many rows, in as few files as they fill."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        df.write.options(**options).mode("overwrite").parquet(self.path(table))
        self.tables.append(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def only(self, *tables: str) -> None:
        """Delete every table but those that the result still reads."""
        for table in set(self.tables) - set(tables):
            self.drop(table)
        self.tables = list(tables)


def global_rank(df: DataFrame, keys: list, scratch: Scratch, table: str, rank: str = "rank") -> DataFrame:
    """df with a gapless rank from 0 in the order of keys, without a single-partition sort.

    A range-partitioned sort is written with the row's place inside its partition; one count per
    partition (as many as there are shuffle partitions, never more) turns places into ranks.
    """
    placed = scratch.keep(df.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()), table)
    part = F.shiftright("_place", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return (
        placed.withColumn("_part", part.cast("long"))
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_place")
    )


#: Bits of a filter: 16 for each key, between these bounds, so that at most 32 MB are broadcast.
LEAST_BITS, MOST_BITS, PAGE_BITS = 1 << 18, 1 << 28, 1 << 15


def key_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bitmap over the hashes of a column, in pages of 4 KB (page, bitmap), and its number of bits; at most 32 MB."""
    bits, wanted = LEAST_BITS, min(MOST_BITS, 16 * keys.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    pages = keys.select((place / PAGE_BITS).cast("long").alias("page"), (place % PAGE_BITS).alias("bit"))
    return pages.groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")), bits


def bitmap_of(keys: DataFrame, key: str) -> np.ndarray:
    """A filter over a column of well-mixed 64-bit hashes, for tasks in Python: two bits for each, at most MOST_BITS in all."""
    bits, wanted = LEAST_BITS, min(MOST_BITS, 16 * keys.count())
    while bits < wanted:
        bits *= 2
    place = F.explode(F.array(F.col(key), F.shiftrightunsigned(key, 32))).alias("place")
    at = keys.select(place).select(F.col("place").bitwiseAND(F.lit(bits - 1)).alias("at"))
    pages = at.select((F.col("at") / PAGE_BITS).cast("long").alias("page"), (F.col("at") % PAGE_BITS).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")).collect():
        out[r["page"] * PAGE_BITS // 8 :][: PAGE_BITS // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be in the filter of bitmap_of."""
    found = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) & np.uint64(8 * len(bitmap) - 1)
        found &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


#: A key that more than one in so many rows share, and more than FEW rows, is hot; there are at most as many such keys.
HOT, FEW = 4096, 64


def joined_by_key(rows: DataFrame, table: DataFrame, key: list[str], n: str, scratch: Scratch, counts: DataFrame | None = None, way: str | None = None) -> DataFrame:
    """rows with the columns of table (one row for each key; column n: how many of rows have it), rows without a match left out.

    Rows of hot keys meet a broadcast of at most HOT rows where they are; only the others are
    shuffled by the key, at most FEW and one in HOT of all to a key. counts has the column n of all
    keys where that is cheaper to read than table; way is a hint for the join of the others.
    """
    stats = (table if counts is None else counts).agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    least = (stats["total"] or 0) // HOT + FEW
    hinted = (lambda df: df.hint(way)) if way else lambda df: df
    if (stats["most"] or 0) <= least:
        return rows.join(hinted(table), key)
    hot = scratch.keep(table.where(F.col(n) > least).repartition(1), f"hot-{uuid.uuid4().hex}")
    few = table.join(F.broadcast(hot.select(*key)), key, "left_anti")
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(hinted(few), key))


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores until no column has it."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def parted(rows: DataFrame, key: str, bitmap: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is certainly not in the filter, and those whose key may be. The bitmap is broadcast, bounded by MOST_BITS."""
    page, pages, maybe = (unused(n, rows.columns) for n in ("_page", "_bitmap", "_maybe"))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    paged = rows.withColumn(page, (place / PAGE_BITS).cast("long")).join(F.broadcast(bitmap.withColumnsRenamed({"page": page, "bitmap": pages})), page, "left")
    bit = place % PAGE_BITS
    byte = F.conv(F.hex(F.substring(pages, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = paged.withColumn(maybe, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
    return marked.where(~F.col(maybe)).select(*rows.columns), marked.where(maybe).select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows, all columns, whose key is not in ids; rows with a null key stay.

    Rows outside a bounded filter over ids stay where they are; only those that the filter lets
    through are shuffled to be told apart exactly.
    """
    outside, inside = parted(rows, key, *key_filter(ids, key))
    return outside.unionByName(inside.join(ids.select(key).hint("merge"), key, "left_anti").select(*rows.columns))
