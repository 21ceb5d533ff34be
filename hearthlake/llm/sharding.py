"""Sharding by balanced label propagation over groups of linked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, global_rank

#: Resolution of the share of movers that a quota admits.
GRAIN = 1 << 20


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, grp (digest of the text) of every row; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp")
    )


def ranked_votes(open_shards: list[int]) -> Column:
    """The strongest open shard of a group, by neighbours there and then by a hash that spreads ties."""
    return F.array_max(F.transform(F.filter("votes", lambda v: v["shard"].isin(open_shards)), strength))


def strength(vote: Column) -> Column:
    return F.struct(vote["n"].alias("n"), F.xxhash64(F.col("grp"), vote["shard"]).alias("tie"), vote["shard"].alias("shard"))


def wishes(linked: DataFrame, open_shards: list[int], scratch: Scratch, turn: int, rows: int) -> DataFrame:
    """linked with want (the shard a row would move to, null if none) and gain (a power of two of the neighbours won)."""
    counts = linked.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    # At most one entry for each shard.
    votes = scratch.keep(counts.groupBy("grp").agg(F.collect_list(F.struct("shard", "n")).alias("votes")), f"votes-{turn}", rows)
    own = F.array_max(F.transform(F.filter("votes", lambda v: v["shard"] == F.col("shard")), strength))
    best = linked.join(votes, "grp").withColumn("best", ranked_votes(open_shards)).withColumn("own", own)
    moves = F.col("best.shard").isNotNull() & (F.col("best.shard") != F.col("shard")) & (F.col("best") > F.col("own"))
    return best.withColumn("want", F.when(moves, F.col("best.shard"))).withColumn(
        "gain", F.floor(F.log2(F.col("best.n") - F.col("own.n") + 1)).cast("int")
    ).select(*linked.columns, "want", "gain")


def quotas(asked: list, free: dict[int, int]) -> list[tuple[int, int, int]]:
    """(want, gain, admitted share in GRAIN) so that no shard takes more rows than it has free; greatest gains first."""
    shares = []
    for row in sorted(asked, key=lambda r: (r["want"], -r["gain"])):
        room = max(0, free[row["want"]])
        admitted = min(room, row["n"])
        free[row["want"]] = room - admitted
        shares.append((row["want"], row["gain"], admitted * GRAIN // row["n"]))
    return shares


def cut_rows(placed: DataFrame) -> int:
    """How many rows stand apart from the largest part of their group (grp, shard): the links that shards cut, counted at their rows."""
    parts = placed.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    return parts.groupBy("grp").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).first()["cut"]


def propagate(linked: DataFrame, shards: int, capacity: int, scratch: Scratch) -> DataFrame:
    """linked (doc_id, size, text_crc32, grp) with shard, after rounds of moves towards neighbours under capacity.

    Rounds go on as long as they lower the number of cut rows. Each round joins the rows to their group's votes, counts the wishes by target and gain (at most
    shards x 40 figures reach the driver), and admits the share that the target's free rows allow,
    chosen by a hash of the identifier. A full shard is closed: what is left of a group larger than
    a shard gathers in the next one.
    """
    spark = scratch.spark
    state = scratch.keep(linked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).cast("int")), "round-0")
    n, best, turn = state.count(), cut_rows(state), 0
    while best:
        turn += 1
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        free = {s: capacity - load.get(s, 0) for s in range(shards)}
        asked = scratch.keep(wishes(state, [s for s in free if free[s] > 0], scratch, turn, n), f"wishes-{turn}", n)
        wanted = asked.where("want is not null").groupBy("want", "gain").agg(F.count("*").alias("n")).collect()
        shares = [x for x in quotas(wanted, free) if x[2]]
        if not shares:
            break
        table = F.broadcast(spark.createDataFrame(shares, "want int, gain int, share int"))
        draw = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(GRAIN))
        moved = asked.join(table, ["want", "gain"], "left").withColumn("shard", F.when(draw < F.col("share"), F.col("want")).otherwise(F.col("shard")))
        after = scratch.keep(moved.select(*state.columns), f"round-{turn}", n)
        cut = cut_rows(after)
        if cut >= best:
            break
        state, best = after, cut
    return state


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs; shard sizes in rows differ by one at most.

    Rows of equal text are linked and kept in one shard as far as its capacity goes; rows without
    links fill what is left. The last step orders all rows by their label, with loose rows at both
    ends of each shard, and cuts that order into exact lengths, so the few rows by which a shard was
    off are loose ones. Null texts count as empty and equal; rows without doc_id and repeated rows
    are placed like others; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.keep(measured(docs, id_col, text_col), "measured")
    total = rows.count()
    shared = scratch.keep(rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "groups", total)
    tied = rows.join(shared, "grp", "left").select(*rows.columns, F.col("n").isNotNull().alias("tied"))
    tied = scratch.keep(tied, "tied", total)
    linked = propagate(tied.where("tied").drop("tied"), shards, -(-total // shards), scratch)
    load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    gaps = [max(0, total / shards - load.get(s, 0)) for s in range(shards)]
    fill, passed = F.lit(shards - 1), 0.0
    draw = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(GRAIN)) / GRAIN
    ends = []
    for s in range(shards):
        passed += gaps[s] / (sum(gaps) or 1)
        ends.append((s, passed))
    for s, end in reversed(ends):
        fill = F.when(draw < end, s).otherwise(fill)
    side = F.when(F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(2)) == 0, 0).otherwise(2)
    loose = tied.where("not tied").drop("tied").withColumn("shard", fill).withColumn("side", side)
    placed = linked.withColumn("side", F.lit(1)).unionByName(loose)
    order = global_rank(placed, ["shard", "side", "grp", "doc_id"], scratch, "order")
    least, larger = divmod(total, shards)
    split = larger * (least + 1)
    shard = F.when(F.col("rank") < split, F.floor(F.col("rank") / (least + 1))).otherwise(larger + F.floor((F.col("rank") - split) / max(1, least))).cast("int")
    start = F.when(shard <= larger, shard * (least + 1)).otherwise(split + (shard - larger) * least)
    return order.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rank") - start).cast("long").alias("slot"))
