"""Readers of what a crawl leaves behind: page caches, search lists, published counts, packed exports, old stores."""

from __future__ import annotations

import gzip
import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hearthlake.schema import DEFAULT_SOURCE, SEARCH


def decoded(content: bytes | None, declared: str = "utf-8") -> str | None:
    """Bytes of a page as text: UTF-8, with a few broken characters if need be, else the declared charset with marks for what it can't read."""
    if content is None:
        return None
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("utf-8", "replace")
        if text.count("�") <= max(2, len(text) // 100):
            return text
        try:
            return content.decode(declared, "replace")
        except LookupError:
            return text


def page_files(spark: SparkSession, path: str | list[str], declared: str = "utf-8", with_path: bool = False) -> DataFrame:
    """key, fetched_at, html of cached page files, gzipped or plain; the key is the file's name, the hash of its address. With with_path its path, too.

    A file that cannot be unpacked has null html, so a freshness filter fetches it anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = []
            for content in batch.column(2).to_pylist():
                try:
                    html.append(decoded(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, declared))
                except (OSError, EOFError):
                    html.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(html, pa.string()), batch.column(3)], ["key", "fetched_at", "html", "path"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.html)?(?:\.gz)?$", 1)
    read = files.select(name.alias("key"), F.col("modificationTime").alias("fetched_at"), "content", "path").mapInArrow(run, "key string, fetched_at timestamp, html string, path string")
    return read if with_path else read.drop("path")


def fresh(pages: DataFrame, asof: Column, max_age_seconds: int | None) -> DataFrame:
    """The cached pages that are readable and no older than asked."""
    readable = pages.where(F.col("html").isNotNull())
    return readable if max_age_seconds is None else readable.where(F.unix_timestamp("fetched_at") > F.unix_timestamp(asof) - max_age_seconds)


def compact_pages(pages: DataFrame, path: str, files: int) -> None:
    """Rewrites many small page files as a few Parquet files, sorted by key for pruning."""
    pages.repartitionByRange(files, "key").sortWithinPartitions("key").write.mode("overwrite").option("compression", "zstd").parquet(path)


def documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """value: the documents under a path, one a file or, with lines, one a line; a million documents are then no million files."""
    return spark.read.option("wholetext", str(not lines).lower()).text(path)


def searches(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """search and its specification, one row each, from a JSON object keyed by name; source falls back to the default, enabled to true."""
    text = documents(spark, path, lines)
    entries = text.select(F.explode(F.from_json("value", f"map<string,struct<{ddl_fields(SEARCH)}>>")).alias("search", "s"))
    found = entries.select("search", "s.*")
    return found.withColumn("source", F.coalesce("source", F.lit(DEFAULT_SOURCE))).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def ddl_fields(ddl: str) -> str:
    """Field definitions of a table as those of a struct: `a string` becomes `a:string`."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[start:i].strip().replace(" ", ":", 1))
            start = i + 1
    return ",".join(parts)


def with_search(specs: DataFrame, added: DataFrame) -> DataFrame:
    """specs with the searches of added, which replace those of the same name."""
    return specs.join(added.select("search"), "search", "left_anti").unionByName(added, allowMissingColumns=True)


def searches_json(specs: DataFrame) -> DataFrame:
    """One row, value: the searches as the JSON object that searches() reads. A list of searches is a configuration, small by nature."""
    fields = [c for c in specs.columns if c != "search"]
    entries = F.array_sort(F.collect_list(F.struct("search", F.struct(*fields).alias("spec"))))
    return specs.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def enabled(specs: DataFrame, source: str | None = None, names: list[str] | None = None) -> DataFrame:
    """The searches to run: those named, else the enabled ones, of one source if asked."""
    chosen = specs.where(F.col("search").isin(names)) if names else specs.where("enabled")
    return chosen.where(F.col("source") == source) if source else chosen


def unknown_searches(specs: DataFrame, names: list[str]) -> DataFrame:
    """search: the names asked for that no specification has."""
    asked = specs.sparkSession.createDataFrame([(n,) for n in names], "search string")
    return asked.join(specs.select("search"), "search", "left_anti")


def published_counts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """search, ours from a published meta file; entries that are malformed are left out."""
    text = documents(spark, path, lines)
    rows = text.select(F.explode(F.from_json("value", "searches array<string>")["searches"]).alias("row"))
    found = rows.select(F.get_json_object("row", "$.search").alias("search"), F.get_json_object("row", "$.n").try_cast("long").alias("ours"))
    return found.where("search is not null and ours is not null")


def unpacked(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id and a map of column to text from a packed export: dictionary codes looked up, picture directories put back, addresses made whole."""
    shape = "v int, cols array<string>, dict map<string,array<string>>, imgPrefixes array<string>, urlPrefix string, rows array<array<string>>"
    packed = documents(spark, path, lines).select(F.from_json("value", shape).alias("x"))
    rows = packed.select(F.explode("x.rows").alias("row"), "x.cols", "x.dict", "x.imgPrefixes", "x.urlPrefix")
    rows = rows if lines else rows.repartition(spark.sparkContext.defaultParallelism)  # lines lie in all tasks already
    pairs = F.filter(F.arrays_zip(F.col("cols").alias("k"), F.col("row").alias("v")), lambda e: e["v"].isNotNull())

    def value(entry: Column) -> Column:
        name, text = entry["k"], entry["v"]
        coded = F.try_element_at(F.try_element_at(F.col("dict"), name), text.try_cast("int") + 1)
        thumb = F.from_json(text, "array<string>")
        whole = F.concat(F.try_element_at(F.col("imgPrefixes"), thumb[0].try_cast("int") + 1), thumb[1])
        address = F.when(F.startswith(text, F.lit("/")), F.concat("urlPrefix", text)).otherwise(text)
        return F.when(F.array_contains(F.map_keys("dict"), name), coded).when((name == "thumb") & F.startswith(text, F.lit("[")), whole).when(name == "url", address).otherwise(text)

    facts = F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["k"].alias("key"), value(e).alias("value"))))
    return rows.select(facts.alias("facts")).select(F.col("facts")["id"].try_cast("long").alias("id"), "facts")


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Row-id spans of one table, read by as many tasks."""

    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Span]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as store:
            low, high = store.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.options['table']}").fetchone()
        n = int(self.options.get("partitions", 4))
        step = max(1, -(-(high - low + 1) // n))
        return [Span(a, min(high, a + step - 1)) for a in range(low, high + 1, step)] or [Span(0, -1)]

    def read(self, span: Span) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as store:
            yield from store.execute(f"SELECT {names} FROM {self.options['table']} WHERE rowid BETWEEN ? AND ?", (span.low, span.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").schema(...).option("table", ...).load(path): an old store, without a driver jar."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as store:
            columns = store.execute(f"PRAGMA table_info({self.options['table']})").fetchall()
        kinds = {"INTEGER": "long", "REAL": "double", "TEXT": "string"}
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for _, name, kind, *_ in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A table of an SQLite store that every executor can open."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("table", table).option("partitions", str(partitions)).load(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows added to a table of files, such as the run log; what is there stays."""
    rows.write.mode("append").parquet(path)


def outlines(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """name, code, rings (each an array of [lon, lat]) of a GeoJSON collection: the exterior rings of polygons and multipolygons."""
    feature = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    features = documents(spark, path, lines).select(F.explode(F.from_json("value", feature)["features"]).alias("f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single = F.transform(F.slice(F.from_json(text, "array<array<array<double>>>"), 1, 1), lambda r: r)
    several = F.transform(F.from_json(text, "array<array<array<array<double>>>>"), lambda polygon: polygon[0])
    props = F.col("f.properties")
    return features.select(F.coalesce(props["name"], props["nom"], props["NAME"]).alias("name"), F.coalesce(props["code"], props["ISO_A2"]).alias("code"), F.when(shape == "Polygon", single).otherwise(several).alias("rings"))


def simplified(rings: pd.Series, tolerance: float) -> pd.Series:
    """Ramer-Douglas-Peucker on every ring of every row, without recursion."""

    def one(ring) -> list:
        points = [tuple(p) for p in ring]
        if len(points) < 3:
            return [list(p) for p in points]
        keep = {0, len(points) - 1}
        waiting = [(0, len(points) - 1)]
        while waiting:
            a, b = waiting.pop()
            (x1, y1), (x2, y2) = points[a], points[b]
            length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
            far, at = 0.0, None
            for i in range(a + 1, b):
                x, y = points[i]
                away = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
                if away > far:
                    far, at = away, i
            if at is not None and far > tolerance:
                keep.add(at)
                waiting += [(a, at), (at, b)]
        return [list(points[i]) for i in sorted(keep)]

    return rings.map(lambda row: [one(r) for r in row])


def simplify(rows: DataFrame, tolerance: float, column: str = "rings") -> DataFrame:
    """rows with simplified outlines."""
    apply = F.pandas_udf(lambda s: simplified(s, tolerance), "array<array<array<double>>>")
    return rows.withColumn(column, apply(column))


def inside(rows: DataFrame, west: float, east: float, south: float, north: float, column: str = "rings") -> DataFrame:
    """rows with only those rings whose bounding box has its centre in the window."""

    def centre(ring: Column, axis: int) -> Column:
        values = F.transform(ring, lambda p: p[axis])
        return (F.array_min(values) + F.array_max(values)) / 2

    return rows.withColumn(column, F.filter(column, lambda r: centre(r, 0).between(west, east) & centre(r, 1).between(south, north)))


def svg_path(rings: Column) -> Column:
    """Closed SVG subpaths of already projected rings, one decimal."""
    point = lambda p: F.format_string("%.1f %.1f", p[0], p[1])
    return F.array_join(F.transform(rings, lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, point), "L"), F.lit("Z"))), "")
