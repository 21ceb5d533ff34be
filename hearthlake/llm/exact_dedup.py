"""Exact dedup by a log-structured merge index of digests, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, joined_by_key, key_filter, parted

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    """The digest of an already normalised text, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


#: Memtables that a table is dealt to; each is flushed as one run.
MEMTABLES = 4


class DigestIndex:
    """Which digest has which smallest identifier and how many rows, as sorted runs in levels, each run with a filter.

    append writes digests to a log, once, with the memtable that each row belongs to. flush turns a memtable
    into a run: one row for each digest, sorted, and a filter over its digests. compact merges two runs of a
    level into one of the next until one is left: only digests that the other run's filter lets through are
    shuffled and merged, keeping the smallest identifier and adding up the rows; the others go over as they
    are. Sums are made before every shuffle, so a digest that a third of all rows share costs one row a task.
    """

    def __init__(self, scratch: Scratch, digest=sha256):
        self.scratch, self.digest = scratch, digest
        self.logs: list[DataFrame] = []
        self.levels: list[list[DataFrame]] = [[]]

    def append(self, docs: DataFrame, id_col: str, text_col: str, memtables: int = MEMTABLES) -> None:
        """The rows of docs into the log, and its memtables into runs of level 0."""
        batch = docs.select(F.col(id_col).alias("doc_id"), self.digest(normalised(F.col(text_col))).alias("digest"))
        log = self.scratch.keep(batch.withColumn("memtable", F.pmod(F.xxhash64("digest", "doc_id"), F.lit(memtables)).cast("int")), f"log-{len(self.logs)}")
        self.logs.append(log)
        for n in range(memtables):
            self.flush(log.where(F.col("memtable") == n))

    def flush(self, memtable: DataFrame) -> None:
        rows = memtable.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        self.levels[0].append(self.scratch.keep(rows.sortWithinPartitions("digest"), f"run-0-{len(self.levels[0])}"))

    def entries(self) -> DataFrame:
        """The log: doc_id, digest of every row appended."""
        return reduce(DataFrame.unionByName, (log.select("doc_id", "digest") for log in self.logs))

    def merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs as one."""
        alone_one, both_one = parted(one, "digest", *key_filter(other, "digest"))
        alone_other, both_other = parted(other, "digest", *key_filter(one, "digest"))
        both = both_one.unionByName(both_other).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        return alone_one.unionByName(alone_other).unionByName(both)

    def compact(self) -> DataFrame:
        """The run that all runs so far merge into: digest, keep_id, n."""
        level = 0
        while len(runs := self.levels[level]) > 1:
            merged = [self.merged(a, b) for a, b in zip(runs[::2], runs[1::2], strict=False)]
            kept = [self.scratch.keep(run.sortWithinPartitions("digest"), f"run-{level + 1}-{k}") for k, run in enumerate(merged)]
            self.levels.append([*kept, *runs[2 * len(merged) :]])
            level += 1
        return self.levels[level][0]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when they are the same bytes after white space is collapsed; null counts as
    empty. Of equal texts the row with the smallest identifier is kept. The index says which digests
    repeat, and the row and count of each. Rows whose digest repeats are verified byte for byte: they
    are grouped by digest and whole text, and where one digest has two texts, their rows are told
    apart by text instead. Rows without an identifier never win against one that has it; repeated rows
    of one identifier count each and share its mark. An empty table gives no rows; other columns are
    not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    index = DigestIndex(scratch, digest)
    index.append(docs, id_col, text_col)
    run = index.compact()
    hits = scratch.keep(run.where("n > 1"), "hits")
    bitmap, bits = key_filter(hits, "digest")

    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))
    texts = parted(text, "digest", bitmap, bits)[1].groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts"))
    clashing = scratch.keep(texts.where("texts > 1").select("digest").join(hits, "digest", "left_semi"), "clashing")
    alone, again = parted(index.entries(), "digest", bitmap, bits)
    known = parted(run, "digest", bitmap, bits)[1].withColumnRenamed("n", "group_size")
    apart = None
    if not clashing.isEmpty():
        again, known = (x.join(clashing, "digest", "left_anti") for x in (again, known))
        rows = text.join(clashing, "digest", "left_semi")
        groups = rows.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = rows.join(groups, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
    found = alone.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = found.unionByName(joined_by_key(again, known, ["digest"], "group_size", scratch).select("doc_id", "digest", "keep_id", "group_size"))
    found = found.unionByName(apart) if apart is not None else found
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
