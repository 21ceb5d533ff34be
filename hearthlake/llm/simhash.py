"""Near-dedup by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.components import components
from hearthlake.llm.shared import Scratch, joined_by_key, mapped, without
from hearthlake.llm.words import shingle_hashes, views

BITS, SEED = 64, 42
#: Members of one bucket up to which its pairs are compared directly; larger buckets are linked exactly through flipped keys.
DIRECT = 128
#: Byte value to eight byte lanes, each 0 or 1: adding such words counts eight bits at once, up to 255 rows.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit."""
    n = len(hashes)
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(n, 8)], np.arange(0, n, 255), axis=0)
    return np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)


class Word:
    """The signed 64-bit SimHash of hashes that come in several arrays; 0 where there are none."""

    def __init__(self) -> None:
        self.counts, self.n = np.zeros(BITS, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        self.counts += bit_counts(hashes)
        self.n += len(hashes)

    def value(self) -> int:
        return int(np.packbits(2 * self.counts > self.n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | memoryview | None, width: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, read a block at a time; 0 where it has no word."""
    word = Word()
    for hashes in shingle_hashes(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"", width, SEED):
        word.add(hashes)
    return word.value()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp for every row; no row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t, width) for t in views(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks such that two words that differ in at most radius bits agree under some mask.

    Every bit position carries a nonzero vector of radius + 1 bits. For each nonzero vector v the
    mask holds the positions whose vector has an odd inner product with v. At most radius differing
    positions span a space of at most radius dimensions, so some v is orthogonal to all of them and
    its mask leaves all of them out.
    """
    span = (1 << (radius + 1)) - 1
    carried = [1 + i % span for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (v & carried[i]).bit_count() % 2) for v in range(1, span + 1)]


def signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def near_links(distinct: DataFrame, radius: int, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """Links a, b between words fp of distinct: their components are those of all pairs within radius bits.

    Buckets of one member are set aside by counting first. The pairs of a bucket of up to DIRECT
    members are compared. A larger bucket is never paired out: each of its words gives as keys
    itself with every choice of at most half the radius of its bits flipped, and words that share a
    key are linked to the smallest of them. For an even radius two words share a key exactly if they
    differ in at most radius bits, so this keeps every component whole and joins nothing else.
    """
    if radius % 2 or not 0 < radius <= 6:
        raise ValueError("the radius must be 2, 4 or 6 bits")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)))
    masked = distinct.select("fp", F.explode(tables).alias("at")).select("fp", "at.t", "at.key")
    buckets = scratch.keep(masked.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets", rows)
    members = scratch.keep(masked.join(buckets, ["t", "key"]), "members", rows)
    few = members.where(F.col("n") <= DIRECT)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = members.where(F.col("n") > DIRECT).select("fp").distinct()
    return pairs.union(flip_links(many, radius // 2)).distinct()


def flip_links(words: DataFrame, most: int) -> DataFrame:
    """Links from the smallest word to each other word that shares a key with it, keys being words with at most `most` bits flipped."""
    flips = [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(BITS), n)]
    keys = words.select("fp", F.explode(F.transform(F.array(*(F.lit(signed(x)) for x in flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("key"))
    first = keys.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return keys.join(first, "key").where("fp <> a").select("a", F.col("fp").alias("b"))


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the smallest doc_id among all rows that a chain of fingerprints, each within
    radius bits of the next, leads to. A null or wordless text has fingerprint 0 and is linked like
    any other; a text of fewer words than a shingle is one shingle. Equal fingerprints are one word
    in the search, so copies, however many, are never paired. Rows without doc_id take part and get
    the component's id (null where no row of it has one); repeated rows each get their row. An empty
    table gives no rows; columns other than the two named are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, width, id_col, text_col), "marked")
    rows = marked.count()
    words = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "words", rows)
    links = scratch.keep(near_links(words.select("fp"), radius, scratch, rows), "near", rows)
    roots = components(links, scratch).withColumnRenamed("node", "fp")
    linked = roots.join(words, "fp")
    groups = linked.groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("n"))
    lowest = scratch.keep(joined_by_key(linked, groups, ["root"], "n", scratch).select("fp", "lowest"), "lowest", rows)
    known = scratch.keep(words.join(lowest, "fp", "left").select("fp", "copies", F.coalesce("lowest", "least").alias("component_id")), "known", rows)
    return joined_by_key(marked, known, ["fp"], "copies", scratch).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those whose group of near copies has a row with a smaller identifier.

    Groups are chains of pairs whose word shingles have a Jaccard resemblance of `least` or more;
    see resemblance.py. Rows without an identifier are kept: they can't be told from each other.
    """
    from hearthlake.llm.resemblance import later_copies

    return without(docs, later_copies(docs, width, radius, least, id_col, text_col), id_col)
