"""Filters and predicates (F01 - F16), set operations (U), ordering (O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_box(lat: Column, lon: Column, snwe: list[float]) -> Column:
    s, n, w, e = snwe
    return lat.between(s, n) & lon.between(w, e)


def timespan(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Epochs strictly inside the bounds; with a start alone the last epoch goes."""
    if start is None and end is None:
        return series
    if end is None:
        last = F.max("d").over(Window.partitionBy("site"))
        return series.withColumn("_last", last).where((F.col("d") > F.lit(start).cast("date")) & (F.col("d") < F.col("_last"))).drop("_last")
    rows = series.where(F.col("d") < F.lit(end).cast("date"))
    return rows if start is None else rows.where(F.col("d") > F.lit(start).cast("date"))


def refined_duration(start: Column, end: Column, lo: str, hi: str) -> Column:
    """Years of a span inside [lo, hi]."""
    return F.datediff(F.least(end, F.lit(hi).cast("date")), F.greatest(start, F.lit(lo).cast("date"))) / 365.25


def without_outliers(df: DataFrame, columns: list[str], sigma: float = 3.0) -> DataFrame:
    """Drop rows beyond ``sigma`` times the root mean square, one column after another.

    Each root mean square is of the rows that the columns before it left.
    """
    for c in columns:
        rms = df.agg(F.sqrt(F.avg(F.col(c) * F.col(c))).alias("_rms"))
        df = df.crossJoin(F.broadcast(rms)).where(F.abs(F.col(c)) <= sigma * F.col("_rms")).drop("_rms")  # one row
    return df


def steps_inside(series: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps strictly between the first and the last epoch of their site."""
    span = series.groupBy("site").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return steps.join(span, "site").where((F.col("d") > F.col("lo")) & (F.col("d") < F.col("hi"))).select("site", "d")


def valid_pixels(stack: DataFrame, reference: tuple[int, int] | None = None) -> DataFrame:
    """Pixels whose temporal mean is neither null nor 0; the reference stays."""
    mean = stack.groupBy("y", "x").agg(F.avg(F.when(~F.isnan("disp"), F.col("disp"))).alias("mean"))
    ok = F.col("mean").isNotNull() & (F.col("mean") != 0)
    if reference:
        ok = ok | (F.col("y") == reference[0]) & (F.col("x") == reference[1])
    return mean.where(F.coalesce(ok, F.lit(False)))


def densification_mask(stack: DataFrame, n_dates: int, reference: tuple[int, int]) -> DataFrame:
    """False where a pixel has all its dates (or is the reference), else True."""
    n = stack.groupBy("y", "x").agg(F.count_if(F.col("disp") != 0).alias("n"))
    full = (F.col("n") == n_dates - 1) | (F.col("y") == reference[0]) & (F.col("x") == reference[1])
    return n.select("y", "x", (~full).alias("mask"))


def select_interferograms(pairs: DataFrame, dropped: DataFrame | None = None, start: int | None = None, end: int | None = None, invert: bool = False) -> DataFrame:
    """Pairs with flag ``kept``: baseline inside [start, end] and not dropped.

    ``invert`` keeps only the dropped ones of that range.
    """
    days = F.datediff("date2", "date1")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (days >= start)
    if end is not None:
        inside = inside & (days <= end)
    rows = pairs.withColumn("days", days).withColumn("inside", inside)
    if dropped is not None:
        rows = rows.join(dropped.select("date1", "date2", F.lit(True).alias("listed")).distinct(), ["date1", "date2"], "left")
    else:
        rows = rows.withColumn("listed", F.lit(None).cast("boolean"))
    listed = F.coalesce("listed", F.lit(False))
    return rows.select("date1", "date2", "days", (F.col("inside") & (listed if invert else ~listed)).alias("kept"))


def resolve_dropped(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs named in a drop list, by ``yyyymmdd_yyyymmdd`` or by index; unknown names match nothing."""
    name = F.concat_ws("_", F.date_format("date1", "yyyyMMdd"), F.date_format("date2", "yyyyMMdd"))
    named = pairs.withColumn("name", name)
    by_name = named.join(entries.where(F.col("entry").contains("_")), F.col("name") == F.col("entry"), "left_semi")
    by_index = named.join(entries.where(~F.col("entry").contains("_")), F.col("idx").cast("string") == F.col("entry"), "left_semi")
    return by_name.unionByName(by_index).select("idx", "date1", "date2").distinct()


def extent_of_data(stack: DataFrame, value: str) -> DataFrame:
    """First and last row and column with a value that isn't 0 (a NaN counts)."""
    return stack.where((F.col(value) != 0) | F.isnan(value)).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def covered(tiles: DataFrame, keys: list[str], value: str, most_missing: float = 0.99) -> DataFrame:
    """Tiles whose share of missing values isn't above a limit."""
    missing = F.col(value).isNull() | F.isnan(value)
    return tiles.groupBy(*keys).agg(F.avg(missing.cast("double")).alias("missing")).where(F.col("missing") <= most_missing)


def window_box(attrs: dict[str, float], y0: Column, y1: Column, x0: Column, x1: Column) -> list[Column]:
    """South, north, west, east of a pixel window."""
    lat = lambda y: F.lit(attrs["Y_FIRST"]) + y * F.lit(attrs["Y_STEP"])
    lon = lambda x: F.lit(attrs["X_FIRST"]) + x * F.lit(attrs["X_STEP"])
    return [lat(y1), lat(y0), lon(x0), lon(x1)]


def box_to_extent(s: Column, n: Column, w: Column, e: Column) -> Column:
    return F.array(w, e, s, n)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segment AB meets segment CD (columns or numbers)."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0)


def barrier_mask(pairs: DataFrame, barrier: list[tuple[float, float, float, float]]) -> DataFrame:
    """1 where the segment between the two points of a pair crosses the barrier.

    The barrier is a literal list of segments, so the test is one expression a
    row; ``pairs`` has lon1, lat1, lon2, lat2.
    """
    hit = F.lit(False)
    for cx, cy, dx, dy in barrier:
        hit = hit | segments_cross(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), F.lit(cx), F.lit(cy), F.lit(dx), F.lit(dy))
    return pairs.withColumn("crosses", hit.cast("int"))


def keep_dates(dates: DataFrame, excluded: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates with a flag: kept if inside the bounds and not excluded."""
    ok = F.lit(True)
    if start:
        ok = ok & (F.col("d") >= F.lit(start).cast("date"))
    if end:
        ok = ok & (F.col("d") <= F.lit(end).cast("date"))
    rows = dates.withColumn("ok", ok)
    if excluded is not None:
        rows = rows.join(excluded.select("d", F.lit(True).alias("out")).distinct(), "d", "left").withColumn("ok", F.col("ok") & F.col("out").isNull()).drop("out")
    return rows


def empty_dates(stack: DataFrame) -> DataFrame:
    """Dates at which all pixels are 0."""
    return stack.groupBy("d").agg(F.sum(F.abs("disp")).alias("total")).where("total = 0").select("d")


def unite_steps(quakes: DataFrame, others: DataFrame) -> DataFrame:
    """Earthquake rows and, without repeats, the other rows."""
    return others.distinct().unionByName(quakes, allowMissingColumns=True)
