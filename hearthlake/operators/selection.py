"""Exact medians of groups of any size: counts by range narrow a bracket around the middle rank until few values are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hearthlake.session import written

#: Values of a bracket that are sorted in the end; longer brackets are narrowed.
HELD = 4096
#: Ranges that a bracket is cut into by its approximate quantiles, and the accuracy of these.
RANGES, ACCURACY = 200, 5000


def upper_medians(rows: DataFrame, value: str, by: list[str], held: int = HELD, ranges: int = RANGES) -> DataFrame:
    """by, value: the middle value of each group of rows, of two middle ones the larger; null for groups without values.

    Each group has a bracket of values with the rank that is looked for inside it. A round takes quantile
    sketches of the bracket, which are merged from every task and bounded in size, picks the range around
    the rank, and counts exactly what lies below, on its ends and inside. The ends may be the value itself,
    however often it occurs; else the inside is the next bracket, a few hundredths of the last one. A bracket of
    at most `held` values is counted by value and read in order. So no task gets all values of a group.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    kept = written(rows.select(group.alias("g"), F.col(value).alias("v")), "selection")
    kind = kept.schema["v"].dataType
    nothing = F.lit(None).cast(kind)
    whole = isinstance(kind, IntegralType)
    sizes = kept.groupBy("g").agg(F.count("v").alias("n"), (F.min("v") if whole else nothing).alias("base"))
    state = written(sizes.select("g", "base", "n", F.floor(F.col("n") / 2).alias("k"), nothing.alias("low"), nothing.alias("high"), nothing.alias("found")), "brackets")
    settled = state.where("n = 0").select("g", "found")
    state = state.where("n > 0")
    while not state.isEmpty():
        few, many = state.where(F.col("n") <= held), state.where(F.col("n") > held)
        counted = inside(kept, few).groupBy("g", "k", "v").agg(F.count("*").alias("same"))
        up_to = F.sum("same").over(W.partitionBy("g").orderBy("v"))
        read = counted.withColumn("up_to", up_to).where("up_to > k").groupBy("g").agg(F.min("v").alias("found"))
        settled = settled.unionByName(written(read, "medians"))
        if many.isEmpty():
            break
        rest = inside(kept, many)
        # Sketches hold doubles, so whole numbers are taken from a number near by; a difference too large for them is left to the counts.
        near = F.coalesce("low", "base")
        cuts = rest.groupBy("g", "base", "n", "k", "low", "high").agg(F.percentile_approx(F.try_subtract("v", near) if whole else F.col("v"), [i / ranges for i in range(ranges + 1)], ACCURACY).alias("at"))
        cuts = cuts.withColumn("at", F.transform("at", lambda x: (x + near).cast(kind))) if whole else cuts
        # One range more on each side than the rank's own, since the quantiles are approximate.
        own = F.floor(F.col("k") * ranges / F.col("n")).cast("int")
        marks = cuts.withColumn("from", F.element_at("at", F.greatest(own, F.lit(1)))).withColumn("to", F.element_at("at", F.least(own + 3, F.lit(ranges + 1)))).drop("at")
        v, low, high = F.col("v"), F.col("from"), F.col("to")
        marks = written(marks, "marks")
        counts = rest.select("g", "v").join(marks, "g").groupBy(*marks.columns).agg(
            F.count_if(v < low).alias("below"), F.count_if(v == low).alias("first"), F.count_if((v > low) & (v < high)).alias("mid"), F.count_if((v == high) & (high > low)).alias("last")
        )
        state = written(narrowed(counts), "brackets")
        settled = settled.unionByName(state.where("found is not null").select("g", "found"))
        state = state.where("found is null").select("g", "base", "n", "k", "low", "high", "found")
    names = [F.col(f"g.{c}").alias(c) for c in by]
    return settled.select(*names, F.col("found").alias(value))


def inside(kept: DataFrame, brackets: DataFrame) -> DataFrame:
    """The values of kept that lie between the bounds of their group's bracket, which do not belong to it."""
    joined = kept.where("v is not null").join(brackets.drop("found"), "g")
    return joined.where((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))


def narrowed(counts: DataFrame) -> DataFrame:
    """The brackets after a round: where the rank fell among the counts; found where it fell on an end."""
    k = F.col("k")
    past = {"below": F.col("below")}
    for name, before in (("first", "below"), ("mid", "first"), ("last", "mid")):
        past[name] = past[before] + F.col(name)
    at = F.when(k < past["below"], "below").when(k < past["first"], "first").when(k < past["mid"], "mid").when(k < past["last"], "last").otherwise("above")
    rows = counts.withColumn("at", at)
    is_at = lambda name: F.col("at") == name
    return rows.select(
        "g",
        "base",
        F.when(is_at("below"), F.col("below")).when(is_at("mid"), F.col("mid")).otherwise(F.col("n") - past["last"]).alias("n"),
        F.when(is_at("below"), k).when(is_at("mid"), k - past["first"]).otherwise(k - past["last"]).alias("k"),
        F.when(is_at("below"), F.col("low")).when(is_at("mid"), F.col("from")).otherwise(F.col("to")).alias("low"),
        F.when(is_at("below"), F.col("from")).when(is_at("mid"), F.col("to")).otherwise(F.col("high")).alias("high"),
        F.when(is_at("first"), F.col("from")).when(is_at("last"), F.col("to")).alias("found"),
    )
