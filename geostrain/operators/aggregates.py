"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..sources.shared import written


def no_nan(c: Column) -> Column:
    """NaN as null: medians and means then skip it."""
    return F.when(~F.isnan(c), c)


def mad(df: DataFrame, key: str, value: str, scale: float = 1.0) -> DataFrame:
    centre = df.groupBy(key).agg(F.median(value).alias("_c"))
    off = df.join(centre, key).withColumn("_off", F.abs(F.col(value) - F.col("_c")))
    return off.groupBy(key).agg(F.first("_c").alias("median"), (scale * F.median("_off")).alias("mad"))


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def root_median_square(value: Column) -> Column:
    return F.sqrt(F.median(value * value))


def weighted_rms(predicted: Column, target: Column, weight: Column) -> Column:
    """Weights count even where the difference is missing."""
    off = no_nan(predicted - target)
    return F.sqrt(F.try_divide(F.sum(weight * off * off), F.sum(weight)))


def weighted_average(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean, count, variance, mean square error and std, nulls where a sum is 0.

    One pass: the sums of w, wx and wx^2 give the residual sum of squares.
    """
    x, w = F.col(value), F.col(weight)
    sums = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.count(x).alias("n"))
    sums = sums.withColumn("mean", F.try_divide(F.nullif(F.col("wx"), F.lit(0.0)), F.col("w")))
    ss = F.nullif(F.col("wxx") - F.col("mean") * F.col("wx"), F.lit(0.0))
    sums = sums.withColumn("ss", ss).withColumn("dof", F.col("n") - 1)
    return sums.select(*keys, "mean", "dof", F.try_divide("ss", F.col("dof") * F.col("w")).alias("variance"), F.try_divide("ss", "dof").alias("mse"), F.sqrt(F.try_divide(F.try_divide("ss", F.col("dof") * F.col("w")), F.try_divide("ss", "dof"))).alias("std"))


def duration(series: DataFrame, gap: int = 6) -> DataFrame:
    """First and last date, years between, and gaps longer than ``gap`` days."""
    before = F.lag("d").over(Window.partitionBy("site").orderBy("d"))
    return series.withColumn("_gap", F.datediff("d", before)).groupBy("site").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), (F.datediff(F.max("d"), F.min("d")) / 365.25).alias("duration"), F.sum((F.col("_gap") > gap).cast("int")).cast("long").alias("n_gaps"))


def gap_percentage(series: DataFrame, start: str, end: str) -> DataFrame:
    """Percent of missing days between start and end, which count as samples."""
    day = lambda s: F.datediff(F.lit(s).cast("date"), F.lit("1858-11-17").cast("date"))
    inside = series.where((F.col("d") > F.lit(start).cast("date")) & (F.col("d") < F.lit(end).cast("date")))
    times = inside.select("site", F.datediff("d", F.lit("1858-11-17").cast("date")).cast("double").alias("t"))
    ends = series.select("site").distinct().select("site", F.explode(F.array(day(start), day(end)).cast("array<double>")).alias("t"))
    diff = F.lead("t").over(Window.partitionBy("site").orderBy("t")) - F.col("t")
    rows = times.unionByName(ends).withColumn("missing", F.when(diff - 1 > 1e-6, F.ceil(diff) - 1).otherwise(0))
    return rows.groupBy("site").agg((100.0 * F.sum("missing") / (F.count("*") + F.sum("missing"))).alias("gap_pct"))


def equal_width_bin(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Index of one of ``n`` bins on [lo, hi]; the maximum is in the last."""
    return F.coalesce(F.least(F.floor(F.try_divide(value - lo, (hi - lo) / n)), F.lit(n - 1)), F.lit(0)).cast("int")


def binned(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """count, mean, median, population std and sum in bins of equal width."""
    span = df.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    rows = df.crossJoin(F.broadcast(span)).withColumn("bin", equal_width_bin(F.col(by), F.col("_lo"), F.col("_hi"), n))  # one row
    v = F.col(value)
    return rows.groupBy("bin").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.sum(v).alias("total"), (F.first("_lo") + (F.col("bin") + 0.5) * (F.first("_hi") - F.first("_lo")) / n).alias("centre"))


def edge_bin(value: Column, edges: list[float]) -> Column:
    """Index i of the bin [edges[i], edges[i+1]); the last is closed; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        inside = (value >= edges[i]) & ((value <= edges[i + 1]) if i == len(edges) - 2 else (value < edges[i + 1]))
        out = F.when(inside, i).otherwise(out)
    return out


def covariance_bins(pairs: DataFrame, stations: DataFrame, edges: list[float], n_least: int) -> tuple[DataFrame, DataFrame]:
    """(C0, bins): signal variance, and per distance bin the mean product.

    ``stations`` has d1, d2, n1, n2; ``pairs`` has dist, a1 and b2 (component 1
    of one point, component 2 of the other).
    """
    c0 = stations.agg((0.5 * (F.avg(F.col("d1") ** 2) - F.avg(F.col("n1") ** 2)) + 0.5 * (F.avg(F.col("d2") ** 2) - F.avg(F.col("n2") ** 2))).alias("c0"))
    rows = pairs.withColumn("bin", edge_bin(F.col("dist"), edges)).where("bin is not null").withColumn("p", F.col("a1") * F.col("b2"))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), F.try_divide(F.sum("p"), F.count("*") - 1).alias("cov"), F.stddev_pop("p").alias("std")).where(F.col("n") >= 2 * n_least)
    return c0, bins


def correlation_bins(pairs: DataFrame, edges: list[float], n_least: int) -> DataFrame:
    """Normalised correlation per bin; means and deviations are of distinct values.

    Of the pairs only sums for each value are kept: the sum of (a - m)(b - l) is
    sum(ab) - m sum(b) - l sum(a) + n m l.
    """
    rows = pairs.select(edge_bin(F.col("dist"), edges).alias("bin"), "a1", "b2").where("bin is not null")
    of_a = rows.groupBy("bin", "a1").agg(F.count("*").alias("n"), F.sum("b2").alias("sb"), F.count("b2").alias("nb"))
    of_b = rows.groupBy("bin", "b2").agg(F.sum("a1").alias("sa"))
    # a product with a null is null, which sums leave out
    a = of_a.groupBy("bin").agg(F.sum("n").alias("n"), F.avg("a1").alias("ma"), F.stddev_pop("a1").alias("da"), F.sum(F.col("a1") * F.col("sb")).alias("ab"), F.sum(F.when(F.col("a1").isNotNull(), F.col("sb"))).alias("sb"), F.sum(F.when(F.col("a1").isNotNull(), F.col("nb"))).alias("np"))
    b = of_b.groupBy("bin").agg(F.avg("b2").alias("mb"), F.stddev_pop("b2").alias("db"), F.sum(F.when(F.col("b2").isNotNull(), F.col("sa"))).alias("sa"))
    total = F.col("ab") - F.col("ma") * F.col("sb") - F.col("mb") * F.col("sa") + F.col("np") * F.col("ma") * F.col("mb")
    return a.join(b, "bin").select("bin", "n", F.try_divide(F.try_divide(total, F.col("da") * F.col("db")), F.col("n") - 1).alias("corr")).where(F.col("n") >= n_least)


def rounded(value: Column, digits: int = 6) -> Column:
    """``value`` to so many decimals, half away from zero, by arithmetic on doubles as SQL engines do.

    Spark's own ``round`` writes each double as decimal text, which takes most of
    the time where a row is a pair; very large values still go there.
    """
    scaled = F.abs(value * 10.0**digits)
    return F.when(scaled < 2.0**52, F.signum(value) * F.floor(scaled + 0.5) / 10.0**digits + 0.0).otherwise(F.round(value, digits))


#: Rows of a block up to the most blocks, blocks of a side at least and at most, and tasks that the meetings of blocks are dealt over at most.
PAIR_BLOCK, LEAST_BLOCKS, MOST_BLOCKS, MOST_TASKS = 1024, 8, 44, 1000


def block_count(side: DataFrame) -> int:
    """Blocks of a side; each row is copied once for a block of the other side, so copies grow with the rows alone."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-side.count() // PAIR_BLOCK)))


def _meeting(one: DataFrame, two: DataFrame, key1: str, key2: str) -> DataFrame:
    """Every row of ``one`` beside every row of ``two``, in blocks of their keys.

    Every two blocks are a key of their own, and keys are dealt over a number of
    tasks that follows from the counted rows: tables of sites are small files,
    which a plain join would broadcast and leave to the one task that reads them.
    """
    spark = one.sparkSession
    n, m = (block_count(side) for side in (one, two))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n * m, MOST_TASKS))
    block = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = one.withColumn("_b1", block(key1, n)).withColumn("_b2", every(m)).repartition(tasks, "_b1", "_b2")
    right = two.withColumn("_b2", block(key2, m)).withColumn("_b1", every(n)).repartition(tasks, "_b1", "_b2")
    return left.join(right.hint("shuffle_hash"), ["_b1", "_b2"]).drop("_b1", "_b2")


def site_pairs(sites: DataFrame, distance: Column | None = None) -> DataFrame:
    """Every pair i < j of a network, with columns 1 and 2.

    Sites are dealt by ranges of ids, and a block meets itself and those after it
    alone: half of all meetings, as no pair i > j comes up between two blocks.
    Ids that are no numbers are dealt by hash and meet both ways.
    """
    side = lambda k: sites.select(*(F.col(c).alias(f"{c}{k}") for c in sites.columns))
    if not isinstance(sites.schema["site"].dataType, NumericType):
        return _meeting(side(1), side(2), "site1", "site2").where("site1 < site2")
    n = block_count(sites)
    cuts = sites.agg(F.percentile_approx("site", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    ends = F.array(*(F.lit(c) for c in cuts)).cast(ArrayType(sites.schema["site"].dataType))
    block = lambda key: F.when(F.col(key).isNotNull(), F.size(F.filter(ends, lambda c: c < F.col(key))))
    tasks = max(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n * (n + 1) // 2, MOST_TASKS))
    left = side(1).withColumn("_b1", block("site1")).withColumn("_b2", F.explode(F.sequence(F.col("_b1"), F.lit(n - 1)))).repartition(tasks, "_b1", "_b2")
    right = side(2).withColumn("_b2", block("site2")).withColumn("_b1", F.explode(F.sequence(F.lit(0), F.col("_b2")))).repartition(tasks, "_b1", "_b2")
    return left.join(right.hint("shuffle_hash"), ["_b1", "_b2"]).drop("_b1", "_b2").where("site1 < site2")


def pair_matrix(first: DataFrame, second: DataFrame, key1: str, key2: str) -> DataFrame:
    """Every row of ``first`` beside every row of ``second``: the result is the matrix.

    Both sides are dealt by blocks of their keys, so no task holds more than the
    product of two blocks, and neither side is broadcast.
    """
    return _meeting(first, second, key1, key2)


#: Cells of the range of values in which the first pass of ``medians_by_cells`` counts.
CELLS = 512


def medians_by_cells(rows: DataFrame, keys: list[str], value: str, top: float) -> DataFrame:
    """keys and ``m``, the exact median of ``value`` (0 to ``top``), for few groups of many rows.

    A median's state is every distinct value.  Here the first pass counts the rows
    of narrow cells, which tells the cells of the two middle ranks; the second one
    counts the distinct values of these cells alone.
    """
    cell = F.least(F.floor(F.col(value) / top * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), cell.alias("_cell"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    counted = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_k"))
    counted = counted.withColumn("_upto", F.sum("_k").over(order)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_n") - 1) / 2) + 1, F.floor(F.col("_n") / 2) + 1
    before = F.col("_upto") - F.col("_k")
    chosen = counted.where((low > before) & (low <= F.col("_upto")) | (high > before) & (high <= F.col("_upto")))
    chosen = written(chosen.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_cell").alias("_c"), before.alias("_before"), low.alias("_low"), high.alias("_high")))
    near = rows.join(F.broadcast(chosen), [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_cell") == F.col("_c")])  # two rows a group at most
    values = near.groupBy(*keys, "_before", "_low", "_high", "_cell", "_v").agg(F.count("*").alias("_k"))
    values = values.withColumn("_upto", F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_cell").orderBy("_v")))
    hit = lambda rank: F.max(F.when((F.col(rank) > F.col("_upto") - F.col("_k")) & (F.col(rank) <= F.col("_upto")), F.col("_v")))
    return values.groupBy(*keys).agg(((hit("_low") + hit("_high")) / 2).alias("m"))


def structure_function(pairs: DataFrame, keys: list[str], spacing: float, dvmax: float = 10.0, km: bool = False) -> DataFrame:
    """Spatial structure function: inverted median difference per distance bin.

    ``pairs`` has dist, v1, v2.  Rows: keys, bin (-1 for the start (0, 1)),
    centre, ssf.  Keys without a usable pair give no rows.
    """
    dv = F.abs(F.col("v1") - F.col("v2"))
    rows = pairs.withColumn("dv", dv).where((F.col("dv") < dvmax) & (F.col("dist") != 0) & ~F.isnan("dist"))
    span = rows.groupBy(*keys).agg(F.max("dist").alias("dmax"), F.min("dist").alias("dmin"))
    span = span.withColumn("w", F.when(F.col("dmax") < spacing, F.round("dmin", 1)).otherwise(F.lit(spacing)))
    if not keys:  # one row, used several times: the pairs are made once for it
        span = written(span)
    joined = rows.join(span, keys) if keys else rows.crossJoin(F.broadcast(span))
    if km:
        position, n_edges = F.col("dist") / F.col("w"), F.ceil(F.col("dmax") / F.col("w"))
        edge = lambda i: i * F.col("w")
    else:
        position, n_edges = (F.log10("dist") + 2) / F.col("w"), F.ceil((F.col("dmax") + 2) / F.col("w"))
        edge = lambda i: F.pow(F.lit(10.0), i * F.col("w") - 2)
    joined = joined.withColumn("bin", F.floor(position).cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < n_edges - 1))
    centre = F.sqrt(edge(F.col("bin")) * edge(F.col("bin") + 1))
    medians = joined.groupBy(*keys, "bin", "w").agg(F.median("dv").alias("m")) if keys else medians_by_cells(joined, ["bin", "w"], "dv", dvmax)
    bins = medians.withColumn("inverse", 1 / F.nullif(F.col("m"), F.lit(0.0)))
    top = Window.partitionBy(*(keys or [F.lit(0)]))
    out = bins.select(*keys, "bin", centre.alias("centre"), F.try_divide(F.col("inverse"), F.max("inverse").over(top)).alias("ssf"))
    first = span.select(*keys, F.lit(-1).alias("bin"), F.lit(0.0).alias("centre"), F.lit(1.0).alias("ssf"))
    return out.unionByName(first)


def neighbour_variability(edges: DataFrame, values: DataFrame) -> DataFrame:
    """RMS and MAD of the differences to a site's neighbours; edges both ways."""
    v = values.select("site", "v")
    rows = edges.join(v.select(F.col("site").alias("src"), F.col("v").alias("v1")), "src").join(v.select(F.col("site").alias("dst"), F.col("v").alias("v2")), "dst").select("src", (F.col("v1") - F.col("v2")).alias("dv"))
    spread = mad(rows, "src", "dv")
    return rows.groupBy("src").agg(rms(F.col("dv")).alias("rms"), F.count("*").alias("n")).join(spread.select("src", "mad"), "src")


def neighbour_distances(edges: DataFrame) -> DataFrame:
    """Distances to neighbours; a distance of 0 is missing."""
    d = F.nullif(F.col("dist"), F.lit(0.0))
    return edges.groupBy("src").agg(F.min(d).alias("dmin"), F.max(d).alias("dmax"), F.avg(d).alias("dmean"), F.median(d).alias("dmedian"), F.count(d).alias("n"))


def date_counts(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("date1", "date2")).alias("d")).groupBy("d").agg(F.count("*").alias("n"))


#: Rows of a stack that one task counts, about.
COUNTED_ROWS = 1 << 20


def pixel_counts(stack: DataFrame, least: int = 2) -> DataFrame:
    """Per date and pixel, the interferograms with a value; 0 for dates with few pairs.

    ``stack``: date1, date2, y, x, value.  Pixels are dealt over tasks that follow
    from the counted rows, and the counts of a pixel are made in its task.
    """
    pairs = written(stack.groupBy("date1", "date2").agg(F.count("*").alias("rows")))
    n_pairs = pairs.select(F.explode(F.array("date1", "date2")).alias("d")).groupBy("d").agg(F.count("*").alias("n_pairs"))
    tasks = (pairs.agg(F.sum("rows")).first()[0] or 0) // COUNTED_ROWS
    tasks = max(int(stack.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    rows = stack.repartition(tasks, "y", "x").select(F.explode(F.array("date1", "date2")).alias("d"), "y", "x", "value")
    counts = rows.groupBy("d", "y", "x").agg(F.count_if(F.col("value") != 0).alias("n"))
    return counts.join(F.broadcast(n_pairs), "d").select("d", "y", "x", F.when(F.col("n_pairs") >= least, F.col("n")).otherwise(0).cast("long").alias("n"))


def mean_without_zeros(stack: DataFrame) -> DataFrame:
    return stack.groupBy("y", "x").agg(F.avg(F.when(F.col("disp") != 0, F.col("disp"))).alias("mean"))


def moving_variance(pairs: DataFrame, c0: float, radius: float, least: int = 7, fill: float | None = None) -> DataFrame:
    """Local signal deviation from the neighbours within a radius, self included.

    ``pairs``: site, x (neighbour's value), dist; a left row without neighbours
    has a null x.
    """
    near = F.col("dist") < radius
    x = F.when(near, F.col("x"))
    sums = pairs.groupBy("site").agg(F.count(x).alias("n"), F.sum(x * x).alias("ss"), F.avg(x).alias("mean"))
    m = (F.col("mean") + c0) / 2
    few = F.lit(fill) if fill is not None else F.sqrt((F.col("ss") + (least - F.col("n")) * m * m) / (least - 1))
    return sums.select("site", "n", F.when(F.col("n") == 0, F.sqrt(F.lit(c0))).when(F.col("n") < least, few).otherwise(F.sqrt(F.col("ss") / (F.col("n") - 1))).alias("sigma"))


def fit_statistics(df: DataFrame, observed: str, fitted: str, n_parameters: int = 3) -> DataFrame:
    """RMSE with n - p degrees of freedom, and SSR over SST."""
    mean = df.agg(F.avg(observed).alias("_m"))
    o, f = F.col(observed), F.col(fitted)
    rows = df.crossJoin(F.broadcast(mean))  # one row
    return rows.agg(F.sqrt(F.try_divide(F.sum((o - f) ** 2), F.count("*") - n_parameters)).alias("rmse"), F.try_divide(F.sum((f - F.col("_m")) ** 2), F.sum((o - F.col("_m")) ** 2)).alias("r2"))


def covariance_fit_quality(df: DataFrame, observed: str, fitted: str, c0: Column) -> DataFrame:
    o, f = F.col(observed), F.col(fitted)
    return df.agg((F.sum(F.abs(o - f)) / F.first(c0)).alias("misfit"), (F.sum(F.when(F.col("bin") < 3, F.abs(o - f))) / F.first(c0)).alias("misfit3"), F.corr(o, f).alias("r"))
