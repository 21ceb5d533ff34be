"""How the sources of a language differ in their terms: exact distances of all pairs of sources, and each source's marked terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, mapped
from hearthlake.llm.words import BLOCK, pieces_of, views

#: Documents of a language that a term must stand in, and what is added to every count.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Ranks of the marked terms.
TOP = 50
#: Different terms that a task counts before it hands them on.
HELD = 300_000
#: Letters, lower-cased, and every byte of other scripts stay; all else separates terms.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def term_counts(docs: DataFrame, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) for docs (lang, source, text), added up in each task; a null term for every group seen.

    A text longer than a block is counted in as many passes as it has blocks, each over the terms of one
    residue of a hash, so that its different terms are never held at once.
    """

    def counted(text: memoryview, part: int, parts: int) -> Counter:
        found: Counter = Counter()
        for piece in pieces_of(text, block):
            words = piece.translate(TERM_BYTES).split()
            found.update(words if parts == 1 else (w for w in words if hash(w) % parts == part))
        return found

    def table(groups: dict) -> Iterator[pa.RecordBatch]:
        rows = [(lang, source, term, n, docs) for (lang, source), terms in groups.items() for term, (n, docs) in terms.items()]
        rows += [(lang, source, None, 0, 0) for lang, source in groups]
        for at in range(0, len(rows), 1 << 16):
            lang, source, term, n, docs = zip(*rows[at : at + (1 << 16)], strict=True)
            columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), views(batch.column(2)), strict=True):
                parts = -(-len(text) // block) or 1
                for part in range(parts):
                    terms = groups.setdefault((lang, source), {})
                    size -= len(terms)
                    for term, n in counted(text, part, parts).items():
                        entry = terms.get(term)
                        if entry is None:
                            terms[term] = [n, 1]
                        else:
                            entry[0] += n
                            entry[1] += 1
                    size += len(terms)
                    if size > held:
                        yield from table(groups)
                        groups, size = {}, 0
        yield from table(groups)

    return mapped(docs, run, "lang string, source string, term string, n long, docs long")


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = wide(total) + F.lit(ADDED).cast("decimal(2,0)") * wide(terms)
    part = F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + F.lit(ADDED).cast("decimal(2,0)"))
    return F.lit(1) + F.call_function("div", part, over)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: distances between the sources of a language and the terms that mark each.

    Null text, lang and source count as ''. A language keeps the terms that stand in least_docs of its
    documents. With p the smoothed share of a kept term in a source, scaled to whole numbers, `pair`
    rows have the sum of |p - q| over all kept terms for each other source; `term` rows the `top` terms whose
    share exceeds the language's most. Repeated rows count as often as they stand there. A language without
    kept terms has pairs of distance 0; one with one source has none. An empty table gives no rows; columns
    other than the three named are not read.

    Distances are never summed over the vocabulary. A source's terms are priced as if the other source
    had none of them, from its histogram of counts; a constant prices the terms that neither has; and
    for the terms that both have, found by joining postings, a correction replaces both prices.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    text = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    # Dealt by language and term once: the sums for a source, and those for the language, need no other shuffle.
    dealt = term_counts(text).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    spread = summed.withColumn("everywhere", F.sum("n").over(of_term)).withColumn("first", F.min("source").over(of_term) == F.col("source")).withColumn("docs", F.sum("docs").over(of_term))
    kept = scratch.keep(spread.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "source", "term", "n", "everywhere", "first"), "kept")

    named = F.col("term").isNotNull()
    langs = kept.groupBy("lang").agg(F.count_if(named & F.col("first")).alias("terms"), F.sum("n").alias("lang_total"))
    sources = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"))
    sources = sources.join(langs, "lang").withColumn("none", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0))
    sources = scratch.keep(sources, "sources")
    priced = kept.where(named).join(sources, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    priced = scratch.keep(priced.withColumn("q", probability(F.col("everywhere"), F.col("lang_total"), F.col("terms"))).select("lang", "source", "term", "n", "p", "q", "none"), "priced")

    other = sources.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("support").alias("other_support"))
    least, most = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")
    histogram = priced.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count("*").alias("same"))
    one_sided = histogram.join(other, "lang").where("source <> other").select("lang", least, most, (F.col("same") * F.abs(F.col("p") - F.col("other_none"))).alias("value"))
    gap = F.abs(F.col("none") - F.col("other_none"))
    neither = sources.join(other, "lang").where("source < other").select("lang", least, most, ((F.col("terms") - F.col("support") - F.col("other_support")) * gap).alias("value"))
    posting = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("none").alias("other_none"))
    both = priced.join(posting, ["lang", "term"]).where("source < other")
    correction = F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_none")) - F.abs(F.col("other_p") - F.col("none")) + gap
    overlaps = both.select("lang", least, most, correction.alias("value"))
    distances = one_sided.unionByName(neither).unionByName(overlaps).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = distances.select("lang", "value", ends.alias("end")).select("lang", "end.source", F.lit("pair").alias("part"), "end.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    marks = priced.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(marks)
