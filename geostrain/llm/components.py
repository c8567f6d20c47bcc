"""Connected components by alternating large and small stars.

Each step hangs neighbours onto the smallest id known; the number of steps
grows with the logarithm of the number of nodes.  Minima combine on the map
side and are stored before they are joined back, so a node of any degree
spreads over tasks, and nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), "least")
    joined = both.join(least, F.col("u") == F.col("node"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return stored(out.where("u <> v").distinct(), "star")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """id and component (its least id) of every id in ``links`` (a, b)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = _star(_star(edges, True), False)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
