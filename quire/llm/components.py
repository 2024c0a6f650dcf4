"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import materialise, shuffled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; ``edges`` (a, b) with a < b.  The minimum of each neighbourhood is joined to its edges, never collected."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        step = both.filter("v > u").join(shuffled(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        step = down.join(shuffled(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        step = step.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return step.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b; a < b, distinct) is connected to.

    Every step is written to the shared folder; the loop ends when a double step changes nothing.  Nodes without
    edges aren't listed.  An empty table gives an empty table.
    """

    def state(frame: DataFrame) -> tuple:
        row = frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(edges)
    while before[0]:
        edges = materialise(_star(_star(edges, True), False), "components")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
