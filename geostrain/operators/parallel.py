"""User functions over boxes of pixels, and small helpers of series."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boxes(pixels: DataFrame, rows: int) -> DataFrame:
    """Pixels with the number of their box, ``rows`` lines each."""
    return pixels.withColumn("box", F.floor(F.col("y") / float(rows)).cast("int"))


def map_boxes(pixels: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 256) -> DataFrame:
    """A Python function over each box; its rows, of ``schema``, are united.

    Spark retries a box whose executor is lost, and a box is the unit of memory.
    """
    return boxes(pixels, rows).groupBy("box").applyInPandas(lambda g: f(g.drop(columns="box")), schema)


def with_model(series: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Series with the fitted values of a model table beside them."""
    return series.join(model.select(*keys, "d", F.col("disp").alias("mod")), [*keys, "d"], "left")


def set_missing(series: DataFrame, first: str, last: str) -> DataFrame:
    """Values between two dates as null."""
    inside = F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return series.withColumn("disp", F.when(~inside, F.col("disp")))


def distinct_offsets(offsets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Offsets, those within a tolerance of each other once."""
    return offsets.groupBy(F.round(F.col("mjd") / tolerance).cast("long").alias("_k")).agg(F.min("mjd").alias("mjd")).drop("_k")
