"""Connected components of a distributed table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.tables import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node passes its smallest neighbour on: to its larger neighbours, or to the smaller ones and itself.

    ``links`` has a > b. The node's links are joined with its minimum, never gathered in one row, so a node with
    very many links is a skewed join, which Spark splits.
    """
    ends = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ends.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node in ``links`` (a, b long).

    Links may repeat, be in either order, or join a node to itself; such loops alone give no row. Each round is
    written to the shared checkpoint folder; the rounds grow with the logarithm of the number of nodes.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        now = checkpointed(_star(_star(now, True), False))
