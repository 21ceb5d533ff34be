"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, joined_by_key


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For every node that a link names: node, root (the smallest node that it reaches).

    links has columns a and b. Each round, every node takes the smallest label among itself and its
    neighbours, then the label of that label, so a chain of any length settles in about log(length)
    rounds. The labels of each round are a written table: lost executors redo one round only. Nodes
    with very many links, and labels that very many nodes have, are joined by broadcasts of bounded
    size, so no task gets all rows of one of them.
    """
    ends_count = 2 * links.count()
    keep = lambda df, table: scratch.keep(df, table, rows=ends_count)
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = keep(ends.union(ends.select(F.col("other"), F.col("node"))).where("node <> other").distinct(), "links")
    labels = keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels-0")
    degrees = keep(both.groupBy("other").agg(F.count("*").alias("links")), "degrees")
    turn = 0
    while True:
        turn += 1
        said = degrees.join(labels.withColumnRenamed("node", "other"), "other")
        heard = joined_by_key(both, said, ["other"], "links", scratch, degrees).select("node", "root")
        nearest = keep(heard.union(labels).groupBy("node").agg(F.min("root").alias("root")), f"near-{turn}")
        # A label is a node itself, so every row finds its label's label.
        shared = nearest.groupBy("root").agg(F.count("*").alias("rows"))
        jump = nearest.select(F.col("node").alias("root"), F.col("root").alias("beyond")).join(shared, "root")
        settled = keep(joined_by_key(nearest, jump, ["root"], "rows", scratch, shared).select("node", F.least("root", "beyond").alias("root"), F.col("root").alias("was")), f"jump-{turn}")
        moved = settled.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        scratch.drop(f"labels-{turn - 1}" if turn == 1 else f"jump-{turn - 1}")
        scratch.drop(f"near-{turn}")
        labels = settled.select("node", "root")
        if not moved:
            return labels
