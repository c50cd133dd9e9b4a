"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.storage import stored

ROUNDS = 50


def star_components(links: DataFrame, finish: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """links (a, b; any ordered type) as (node, root): the smallest node of each node's component, for all nodes of links but the roots themselves.

    The rounds grow with the logarithm of the nodes. A node's links are never gathered: a step takes the smallest neighbour by partial aggregation and joins it
    back. The smallest neighbours are written before the join, so that adaptive execution can split a hot node's rows in it; they are never broadcast, since
    their file says little of their rows. Every round is written. Null ends are dropped; links of a node with itself have no effect. finish gets the written links
    (a > b, each once) and may give the result itself; where it gives None, the rounds do.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if finish and (found := finish(edges)) is not None:
        return found
    seen = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select("b", "a"))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        pair = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = stored(large.join(low.hint("merge"), "a").select(pair.alias("e")).select("e.*").where("a <> b").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")
