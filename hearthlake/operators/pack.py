"""The compact export: dictionary codes for repeating strings, directories once, photos apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.text import path_head, path_tail, photo_name
from hearthlake.operators.ranks import ranked

# What the export leaves out, and the share of rows up to which a dictionary pays.
LEFT_OUT = ("snippet", "eur_m2", "eur_m2_land", "price_drop", "days_known", "raw_fields", "photos")
REPEATING = 0.6


def export_columns(view: DataFrame) -> DataFrame:
    return view.drop(*LEFT_OUT)


def column_profile(view: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, n_rows, coded: one scan for all string columns; coded where a dictionary pays."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns)))
    values = view.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    counts = values.groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("n_rows"))
    return counts.withColumn("coded", (F.col("n_distinct") > 0) & (F.col("n_distinct") <= F.col("n_rows") * REPEATING))


def dictionaries(view: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, code from 0 in order of the values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns)))
    distinct = view.select(pairs.alias("p")).select("p.column", "p.value").where("value is not null").distinct()
    return ranked(distinct, [F.col("value")], "code", within="column")


def encoded(view: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """view with column replaced by its code in the dictionary; null stays null."""
    codes = dictionary.where(F.col("column") == column).select(F.col("value").alias(column), F.col("code").alias("_code"))
    return view.join(codes, column, "left").withColumn(column, F.col("_code")).select(*view.columns)


def decoded(view: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    values = dictionary.where(F.col("column") == column).select(F.col("code").alias(column), F.col("value").alias("_value"))
    return view.join(values, column, "left").withColumn(column, F.col("_value")).select(*view.columns)


def prefixes(rows: DataFrame, url: str, order: Column) -> DataFrame:
    """head, prefix (its number in order of first appearance)."""
    heads = rows.where(F.col(url).isNotNull()).groupBy(path_head(F.col(url)).alias("head")).agg(F.min(order).alias("first"))
    return ranked(heads, [F.col("first")], "prefix").select("head", "prefix")


def photo_index(listings: DataFrame) -> DataFrame:
    """id, head, names: one directory with short names, or no directory and whole addresses where photos lie in several."""
    heads = F.array_distinct(F.transform("photos", path_head))
    one = F.size(heads) == 1
    names = F.when(one, F.transform("photos", lambda p: photo_name(path_tail(p)))).otherwise(F.col("photos"))
    return listings.where(F.size("photos") > 0).select("id", F.when(one, heads[0]).alias("head"), names.alias("names"))


def as_json_rows(view: DataFrame) -> DataFrame:
    """id, row: the values of each row as one compact JSON array."""
    return view.select("id", F.to_json(F.array(*(F.col(c).cast("string") for c in view.columns))).alias("row"))
