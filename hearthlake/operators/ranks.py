"""Gapless numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.session import written

PLACE_BITS = 33


def ranked(rows: DataFrame, keys: list, name: str, within: str | None = None, first: int = 0) -> DataFrame:
    """rows with a gapless number from `first` in the order of keys, for each value of `within` if given.

    The sort is by range. Each row keeps its place inside its partition; one count for each partition
    (and value of within, which must be few) turns places into numbers. The placed rows are written to
    the shared folder once, so that a lost executor cannot sort ties anew.
    """
    by = [F.col(within)] if within else []
    placed = written(rows.orderBy(*by, *keys).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", PLACE_BITS)
    own = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    group = F.col(within) if within else F.lit("")
    counts = placed.groupBy(part.alias("part"), group.cast("string").alias("grp")).agg(F.count("*").alias("n"), F.min(own).alias("low")).collect()
    totals: dict[str, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: r["part"]):
        # The number of a row is its place less the partition's first place of its group, after what came before.
        starts.append((r["part"], r["grp"], first + totals.get(r["grp"], 0) - r["low"]))
        totals[r["grp"]] = totals.get(r["grp"], 0) + r["n"]
    offsets = placed.sparkSession.createDataFrame(starts or [(0, "", 0)], "_part long, _grp string, _start long")
    marked = placed.withColumn("_part", part).withColumn("_grp", group.cast("string")).join(F.broadcast(offsets), ["_part", "_grp"])
    return marked.withColumn(name, F.col("_start") + own).drop("_part", "_grp", "_start", "_place")
