"""Connected components of an edge table, by alternating star operations.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every
round links each node's larger neighbours to its smallest neighbour (large
star), then each node's smaller neighbours to the smallest of them (small
star).  Both keep the components, and the edges turn into one star per
component, centred on its smallest node, in a logarithmic number of rounds.

Every round is one map-side combined ``min`` per node and one join on the node;
AQE splits the join partition of a node with very many neighbours.  Nothing is
gathered per component.  Each round is written to the shared folder, and removed
once the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langatlas.llm.common import drop_stages, stage


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                  .withColumn("m", F.least("a", "m")), "cc-least")
    out = stage(both.where("b > a").join(least, "a")
                .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
    drop_stages(least)
    return out


def _small_star(pairs: DataFrame) -> DataFrame:
    least = stage(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")),
                  "cc-least")
    out = stage(pairs.join(least.where("n > 1"), "a").where("b > m")
                .select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(least.select("a", F.col("m").alias("b"))).distinct(), "cc-small")
    drop_stages(least)
    return out


def _is_star_forest(pairs: DataFrame) -> bool:
    """Every larger end has one edge, and no centre has a smaller neighbour."""
    ends = (pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"))
            .union(pairs.select("b", F.lit(0)).distinct())
            .groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")))
    return ends.where("ups > 1 OR (ups > 0 AND n > ups)").isEmpty()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``edges`` (two columns of one orderable type) -> ``node, root``: every
    node of an edge between different nodes with the smallest node of its
    component.  Direction, repeats, self-loops and null ends do not matter (an
    edge with a null end is ignored); an empty table gives an empty table."""
    pairs = stage(edges.where(F.col(src) != F.col(dst))
                  .select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
                  .distinct(), "cc-edges")
    while not _is_star_forest(pairs):
        large = _large_star(pairs)
        drop_stages(pairs)
        pairs = _small_star(large)
        drop_stages(large)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
