"""Connected components of small integer or date graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """id and least id of its component; ``edges``: a, b.

    Each round takes the least label around a node and then that label's own,
    so paths halve; rounds go on until no label moves.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        around = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(around, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("further"))
        new = written(new.join(jump, F.col("label") == F.col("at"), "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def date_clusters(pairs: DataFrame) -> DataFrame:
    """Cluster of each acquisition date, named by its first date."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    found = connected_components(pairs.select(day("date1").alias("a"), day("date2").alias("b")))
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    return found.select(date("id").alias("d"), date("label").alias("component"))


def is_connected(pairs: DataFrame) -> bool:
    return date_clusters(pairs).select("component").distinct().count() <= 1
