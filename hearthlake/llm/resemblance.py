"""Near copies by resemblance: SimHash words propose pairs, a join of shingle sets finds the others, the exact Jaccard of the sets decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.components import components
from hearthlake.llm.overlap import SEED, key_of, links_of_classes, lists, start_of
from hearthlake.llm.shared import Scratch, joined_by_key, mapped
from hearthlake.llm.simhash import Word, near_links
from hearthlake.llm.words import shingle_hashes, views


def marked_texts(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row, key (digest of the set of shingles), n (its size), fp, start for rows (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, words, starts = [], [], [], []
            for text in views(batch.column(2)):
                word, parts = Word(), [np.empty(0, "<u8")]
                for hashes in shingle_hashes(text, width, SEED):
                    word.add(hashes)
                    parts.append(np.unique(hashes))
                found = np.unique(np.concatenate(parts))
                keys.append(key_of(found)), sizes.append(len(found)), words.append(word.value()), starts.append(start_of(found, percent))
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), lists(starts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "key", "n", "fp", "start"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, row long, key binary, n long, fp long, start array<long>")


def word_pairs(words: DataFrame, radius: int, scratch: Scratch, rows: int) -> DataFrame:
    """Pairs a, b of keys whose SimHash words are equal or linked by near_links: each word stands for its smallest key."""
    firsts = scratch.keep(words.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "word-firsts", rows)
    same = words.select("fp", "key").join(firsts.where("n > 1"), "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    near = near_links(firsts.select("fp"), radius, Scratch(words.sparkSession, "resemblance-near"), rows)
    ends = [firsts.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_key")) for k in "ab"]
    return same.union(near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def later_copies(docs: DataFrame, width: int, radius: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifiers (column id_col) of the rows of docs whose group of near copies has a smaller one.

    Texts with the same set of shingles are one class. Pairs of classes are linked if the Jaccard resemblance
    of their sets is `least` or more; groups are chains of links. SimHash words within radius bits propose
    pairs; the join of overlap.py finds those that SimHash does not see, by the shingles that few texts
    share, so texts of one template meet only where they share more than the template. Rows without an
    identifier take no part.
    """
    percent = round(100 * least)
    if abs(percent - 100 * least) > 1e-9:
        raise ValueError("the resemblance must be a whole number of hundredths")
    scratch = Scratch(docs.sparkSession, "resemblance")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    marked = scratch.keep(marked_texts(rows, width, percent), "marked")
    count = marked.count()
    grouped = marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.min("fp").alias("fp"), F.min_by(F.struct("row", "start"), "row").alias("one"), F.count("*").alias("copies"))
    classes = scratch.keep(grouped.select("key", "least", "n", "fp", "one.row", "one.start", "copies"), "classes")
    some = classes.where("n > 0")
    proposed = scratch.keep(word_pairs(some, radius, scratch, count), "proposed", count)
    links = links_of_classes(some, rows, scratch, width, percent, count, proposed)
    roots = components(links, Scratch(docs.sparkSession, "resemblance-roots")).withColumnRenamed("node", "key")
    linked = roots.join(classes.select("key", "least"), "key")
    groups = linked.groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("size"))
    lowest = scratch.keep(joined_by_key(linked, groups, ["root"], "size", scratch).select("key", "lowest"), "lowest", count)
    known = scratch.keep(classes.join(lowest, "key", "left").select("key", "copies", F.coalesce("lowest", "least").alias("lowest")), "known", count)
    later = joined_by_key(marked.select("key", "doc_id"), known, ["key"], "copies", scratch).where("doc_id <> lowest").select(F.col("doc_id").alias(id_col)).distinct()
    ids = scratch.keep(later, "ids", count)
    scratch.only("ids")
    return ids
