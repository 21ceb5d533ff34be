"""A corpus pipeline of five of the library's operators; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm import contamination, line_dedup, pieces, quality, simhash
from hearthlake.llm.registry import held_out, table
from hearthlake.llm.shared import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels outside fold 1 of 3, gives 0.5 or more.

    Every row is judged by its own text, so rows that share an identifier are judged apart; null and empty
    texts are scored as empty. Without a usable label every row stays. Columns of any name pass.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(1, 3))
    return quality.at_least(docs, model, 0.5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that stand at an earlier place already, and their new lengths in n_chars, if docs has it.

    Every row stays. Null texts and rows without an identifier stay as they are; rows that share an
    identifier are told apart by their text; of equal chunks the one of the smallest identifier stays.
    """
    cut = line_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash and a join of shingle sets propose, the exact resemblance of five-word shingles decides.

    The smallest identifier of a group stays; null, empty and wordless texts are copies of each other. Rows
    without an identifier stay, rows that share one go or stay together.
    """
    return simhash.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null texts hold none, rows without an identifier stay, an empty benchmark drops nothing."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens (0 for null texts), and as text what the ids decode to; columns of these names are replaced."""
    decoded = pieces.decode_ids(pieces.encode_texts(docs), out_col="text")
    return decoded.withColumn("n_tokens", F.coalesce(F.size("token_ids"), F.lit(0)))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_repeats),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", tokenise),
]

#: The quality model and the Viterbi search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.only(f"stage-{k}")
    return docs
