"""Connected components by alternating large-star and small-star steps; no link or label ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for each node of edges (a, b), label being the smallest node reachable.

    Each round is written to the shared folder, so a lost executor costs that round at most. Only a count comes back to the
    driver: of the nodes that still have several links, one of them to a smaller node. Without such nodes, all links are
    between a component's smallest node and the others, and no round more is needed. No edges give no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        tidy(edges.sparkSession)
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        if both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).where("m < x and n > 1").agg(F.count("*")).first()[0] == 0:
            break
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("e"))
        links = materialize(small.select("e.u", F.col("e.w").alias("v")).where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
