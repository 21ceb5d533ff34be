"""Substring search by an inverted index of trigrams with posting bitmaps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.functions.text import contains_all, search_terms
from hearthlake.session import shared_dir

#: Letters of a gram, and identifiers that one bitmap stands for: those of a long, which partial aggregation holds in hashed rows and need not sort.
GRAM, PAGE = 3, 64


def grams(hay: Column) -> Column:
    """The different grams of the words of a text; none where they are shorter than a gram. Terms have no white space, so grams with it are never asked for."""
    # One pass of one pattern: a match of no length at every letter that has enough letters after it.
    return F.array_distinct(F.regexp_extract_all(hay, F.lit(rf"(?=(\S{{{GRAM}}}))"), F.lit(1)))


def grams_of(term: str) -> list[str]:
    return sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})


def page_of(identifier: str) -> Column:
    return F.shiftright(identifier, PAGE.bit_length() - 1)


def bit_of(identifier: str) -> Column:
    return F.pmod(identifier, F.lit(PAGE)).cast("int")


class TextIndex:
    """gram, page, bits: which identifiers of a page of PAGE have a gram, sorted by gram so that a search reads few row groups.

    A gram in every text costs some bits a text, not a row. Identifiers are whole numbers of any sign. The index
    is built from a text once; add() indexes further rows beside it, and a search takes all parts together.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/") if path else f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame, id_col: str, hay: Column) -> None:
        """Indexes rows that are not in the index yet, and keeps their lower-cased texts to verify by."""
        kept = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.lower(hay), F.lit("")).alias("hay"))
        part = f"part={uuid.uuid4().hex}"
        # By ranges of identifiers: a task then has few pages, so its partial bitmaps are few and full.
        kept.repartitionByRange("id").write.parquet(f"{self.path}/texts/{part}")
        texts = self.spark.read.parquet(f"{self.path}/texts/{part}")
        # All texts of a page in one task, so that its bitmaps are made there and only whole ones are shuffled, by gram.
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        paged = texts.select(page_of("id").alias("page"), F.expr(f"shiftleft(1L, CAST(pmod(id, {PAGE}) AS INT))").alias("bits"), "hay").repartitionByRange(tasks, "page")
        posted = paged.select("page", "bits", F.explode(grams(F.col("hay"))).alias("gram"))
        bitmaps = posted.groupBy("gram", "page").agg(F.bit_or("bits").alias("bits"))
        # Not by range, which would make the bitmaps twice; a gram that most texts have goes to several tasks.
        bitmaps.repartition("gram", F.shiftright("page", 14)).sortWithinPartitions("gram", "page").write.parquet(f"{self.path}/grams/{part}")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts").select("id", "hay")

    def met(self, terms: list[str]) -> DataFrame | None:
        """page, bits: which identifiers of a page have every gram of the terms; None where no term is as long as a gram, so that the index says nothing."""
        wanted = sorted({g for term in terms for g in grams_of(term)})
        if not wanted:
            return None
        # A page's parts may have been added apart: first the parts of a gram are put together, then the grams met.
        one = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(wanted)).groupBy("page", "gram").agg(F.bit_or("bits").alias("bits"))
        met = one.groupBy("page").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
        return met.where((F.col("n") == len(wanted)) & (F.col("bits") != 0)).select("page", "bits")

    def candidates(self, terms: list[str]) -> DataFrame | None:
        """id: which rows have every gram of the terms; None where the index says nothing."""
        met = self.met(terms)
        if met is None:
            return None
        bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda k: F.getbit("bits", k) == 1)).alias("bit")
        return met.select("page", bits).select((F.col("page") * PAGE + F.col("bit")).alias("id"))

    def search(self, query: str) -> DataFrame:
        """id of the rows whose text has every word of a query, as part of a word or whole.

        Only candidates are found; words shorter than a gram are verified, not searched for. A query
        of nothing but such words reads all texts; one without words finds every row.
        """
        terms = search_terms(query)
        met = self.met(terms)
        texts = self.texts().where(contains_all(F.col("hay"), terms))
        if met is None:
            return texts.select("id")
        # Texts meet the bitmap of their page, never a list of identifiers: Spark takes such a list for as small as
        # the bitmaps that it is made from, and would broadcast it through the driver. Dealt out by page, their own size is known.
        placed = texts.select("id", page_of("id").alias("page"), bit_of("id").alias("bit"))
        return placed.join(met.repartition("page"), "page").where(F.getbit("bits", F.col("bit")) == 1).select("id")
