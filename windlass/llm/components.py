"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import landed


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` (u, v): links in either direction, repeats and loops allowed. Returns
    (node, root): each linked node with the smallest node reachable, the roots included.

    Every step takes a minimum by key with map-side combining and joins it back, so a node with
    very many neighbours never has to fit one task (a join, unlike a window, can be split).
    Each round is written to the checkpoint folder; the rounds grow with the logarithm of the
    longest chain. An empty input gives an empty result.
    """
    pairs = landed(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                                      F.struct(F.col("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pairs = landed(small)
        # Done when it is a set of stars: every node has one parent, and no parent has one.
        many = pairs.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = pairs.join(pairs.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi").limit(1)
        if many.unionByName(chained.select("u", F.lit(1).cast("long").alias("n"))).isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
