"""Connected components by alternating large-star and small-star steps (links stay distributed).

Every step is a partial aggregate and a join, so a hub with any number of links is never collected;
rounds grow with the logarithm of the component size. Each round's links are cut with a reliable
checkpoint; the driver sees only whether they are stars by now, which ends the rounds without one more to confirm it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .tables import let_go


def _both(links: DataFrame, a: str, b: str, x: Column, y: Column) -> DataFrame:
    """Each link twice, as (a, b) = (u, x) and as (v, y), out of one pass."""
    return links.select(F.explode(F.array(F.struct(F.col("u").alias(a), x.alias(b)), F.struct(F.col("v").alias(a), y.alias(b)))).alias("l")).select(
        f"l.{a}", f"l.{b}")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one root at most, and no root hangs on another node."""
    ends = _both(links, "node", "up", F.lit(1), F.lit(0)).groupBy("node").agg(
        F.sum("up").alias("ups"), F.min("up").alias("root"), F.max("up").alias("leaf"))
    return ends.where((F.col("ups") > 1) | (F.col("root") < F.col("leaf"))).isEmpty()


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its smallest node."""
    a, b = F.col(x), F.col(y)
    links = cut_lineage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = _both(links, "a", "b", F.col("v"), F.col("u"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the link to the least neighbour itself keeps u, the others hand their end on to it
        small = large.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.distinct())
        done = _are_stars(links)
        del both, least, large, small
        let_go(links.sparkSession)
        if done:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", F.col("v").alias("component")).distinct())
