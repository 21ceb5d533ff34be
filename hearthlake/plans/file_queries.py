"""What the engine reads from documents in files: outlines, published counts, search lists, packed exports; and counts of a stream by day.

The documents are written from the tables first, fifty rows each and one a line, so that the work grows with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.plans import derived as D
from hearthlake.session import shared_dir
from hearthlake.sources import files
from hearthlake.streaming.merge_stream import new_by_day

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
A_DOCUMENT = 50


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def documents(rows: DataFrame, key: str, entry: Column, around: tuple[str, str]) -> str:
    """A folder of documents, one a line, one for every A_DOCUMENT keys: the entries of its rows, comma-joined, inside a frame."""
    path = f"{shared_dir(rows.sparkSession)}/documents-{uuid.uuid4().hex}"
    parts = rows.groupBy(F.floor(F.col(key) / A_DOCUMENT).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("entries"))
    parts.select(F.concat(F.lit(around[0]), "entries", F.lit(around[1])).alias("value")).write.text(path)
    return path


@query(
    """SELECT 'n' || c_custkey AS name, 'C' AS code, CASE WHEN x <= 39 THEN 'M' || x || '.0 0.0L' || (x + 2) || '.0 0.0L' || (x + 2) || '.0 2.0L' || x || '.0 2.0L' || x || '.0 0.0Z' ELSE '' END AS path
    FROM (SELECT c_custkey, c_custkey % 50 AS x FROM customer)"""
)
def outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of a collection, those in a window, without points that hardly matter, as paths."""
    x = F.col("c_custkey") % 50
    point = lambda a, b: F.concat(F.lit("["), x + a, F.lit(f",{b}]"))
    ring = F.concat_ws(",", point(0, "0"), point(1, "0.001"), point(2, "0"), point(2, "2"), point(0, "2"), point(0, "0"))
    nested = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"Polygon","coordinates":[['), ring, F.lit("]]"))).otherwise(F.concat(F.lit('"MultiPolygon","coordinates":[[['), ring, F.lit("]]]")))
    name = F.when(F.col("c_custkey") % 3 == 0, "name").otherwise("nom")
    feature = F.concat(F.lit('{"properties":{"'), name, F.lit('":"n'), F.col("c_custkey"), F.lit('","code":"C"},"geometry":{"type":'), nested, F.lit("}}"))
    folder = documents(D.table(spark, sf_dir, "customer"), "c_custkey", feature, ('{"type":"FeatureCollection","features":[', "]}"))
    rows = files.simplify(files.inside(files.outlines(spark, folder, lines=True), -1, 40.5, -5, 5), 0.01)
    return rows.select("name", "code", files.svg_path(F.col("rings")).alias("path"))


@query("SELECT 's' || c_custkey AS search, c_custkey AS ours FROM customer WHERE c_custkey % 7 <> 0")
def published_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a build published; every seventh entry is malformed and left out."""
    i = F.col("c_custkey")
    entry = F.when(i % 7 == 0, F.when(i % 2 == 0, F.lit('{"search":"bad","n":"x"}')).otherwise('{"n":3}')).otherwise(F.concat(F.lit('{"search":"s'), i, F.lit('","n":'), i, F.lit("}")))
    return files.published_counts(spark, documents(D.table(spark, sf_dir, "customer"), "c_custkey", entry, ('{"searches":[', "]}")), lines=True)


@query(
    """SELECT 's' || c_custkey AS search, CASE WHEN c_custkey % 2 = 0 THEN 'homege' ELSE 'franimo' END AS source, c_custkey % 3 <> 0 AS enabled, '/p' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS above
    FROM customer WHERE c_custkey % 3 <> 0"""
)
def search_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search lists read, those switched on chosen: source and enabled have defaults."""
    i = F.col("c_custkey")
    fields = F.concat_ws(
        ",", F.concat(F.lit('"path":"/p'), i, F.lit('"')), F.when(i % 2 == 0, '"source":"homege"'), F.when(i % 3 == 0, '"enabled":false'), F.when(i % 4 == 0, F.concat(F.lit('"skip":{"above":'), i, F.lit("}")))
    )
    entry = F.concat(F.lit('"s'), i, F.lit('":{'), fields, F.lit("}"))
    specs = files.searches(spark, documents(D.table(spark, sf_dir, "customer"), "c_custkey", entry, ("{", "}")), lines=True)
    return files.enabled(specs).select("search", "source", "enabled", "path", F.col("skip.above").alias("above"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Agence' WHEN 1 THEN 'Makelaar' END AS agent, 'https://p.test/x/' || o_orderkey AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://cdn/a/' || o_orderkey || '.jpg' ELSE 'https://z/' || o_orderkey END AS thumb FROM orders"""
)
def packed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed exports opened: dictionary codes, picture directories and addresses are put back."""
    i = F.col("o_orderkey")
    thumb = F.when(i % 2 == 0, F.concat(F.lit('[0,"'), i, F.lit('.jpg"]'))).otherwise(F.concat(F.lit('"https://z/'), i, F.lit('"')))
    code = F.when(i % 3 == 2, "null").otherwise((i % 3).cast("string"))
    entry = F.concat(F.lit("["), i, F.lit(","), code, F.lit(',"/x/'), i, F.lit('",'), thumb, F.lit("]"))
    frame = ('{"v":2,"cols":["id","agent","url","thumb"],"dict":{"agent":["Agence","Makelaar"]},"imgPrefixes":["https://cdn/a/"],"urlPrefix":"https://p.test","rows":[', "]}")
    found = files.unpacked(spark, documents(D.table(spark, sf_dir, "orders"), "o_orderkey", entry, frame), lines=True)
    return found.select("id", *(F.col("facts")[c].alias(c) for c in ("agent", "url", "thumb")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by day as they stream in; each batch gives the days that it changed, the last row of a day counts."""
    root = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    events = D.table(spark, sf_dir, "events")
    events.select("ts", "event_type", "value").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.select("ts", "event_type", "value").schema).parquet(f"{root}/in")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    new_by_day(stream, "36500 days").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{root}/out").groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "last.n", F.round("last.total", 4).alias("total"))
