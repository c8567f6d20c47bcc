"""Robust trends from pairs of epochs about one year apart.

``pair_rates`` is the relational form: an equi join on site and target day, no
range condition.  ``robust_trend`` is the exact kernel with its fallback for
epochs without a partner, segments between steps, and both run directions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import YEAR_DAYS

SCALE = 1.4826
TOLERANCE = 0.001
#: Days that count as one year within the tolerance, for daily epochs.
ONE_YEAR = 365


def pair_rates(series: DataFrame, days: int = ONE_YEAR) -> DataFrame:
    """site and slope of every pair of epochs exactly ``days`` apart."""
    later = series.select("site", F.date_sub("d", days).alias("d"), F.col("disp").alias("disp2"))
    return series.join(later, ["site", "d"]).select("site", ((F.col("disp2") - F.col("disp")) / (days / YEAR_DAYS)).alias("s"))


def scaled_mad(values: DataFrame, key: str, value: str, centre: DataFrame | None = None, scale: float = SCALE) -> DataFrame:
    """Median and scaled median absolute deviation of each key."""
    if centre is None:
        centre = values.groupBy(key).agg(F.median(value).alias("centre"))
    off = values.join(centre, key).select(key, "centre", F.abs(F.col(value) - F.col("centre")).alias("off"))
    return off.groupBy(key).agg(F.first("centre").alias("centre"), (scale * F.median("off")).alias("mad"))


def pair_trend(series: DataFrame) -> DataFrame:
    """Rate, number of pairs kept and their scaled MAD for every site.

    One shuffle, by site: partners are looked up in a range window that holds
    the epochs of one day, one year on; medians are windows over the site.
    """
    day = F.datediff("d", F.lit("2000-01-01").cast("date"))
    year_on = Window.partitionBy("site").orderBy("t").rangeBetween(ONE_YEAR, ONE_YEAR)
    partners = series.select("site", day.alias("t"), "disp").withColumn("later", F.collect_list("disp").over(year_on))
    slope = (F.col("disp2") - F.col("disp")) / (ONE_YEAR / YEAR_DAYS)
    site = Window.partitionBy("site")
    rows = partners.select("site", "disp", F.explode("later").alias("disp2")).select("site", slope.alias("s")).withColumn("v0", F.median("s").over(site))
    rows = rows.withColumn("sigma", SCALE * F.median(F.abs(F.col("s") - F.col("v0"))).over(site)).where(F.abs(F.col("s") - F.col("v0")) < 2.0 * F.col("sigma"))
    rows = rows.withColumn("vel", F.median("s").over(site))
    found = rows.groupBy("site").agg(F.first("vel").alias("vel"), F.count("*").alias("n_pairs"), (SCALE * F.median(F.abs(F.col("s") - F.col("vel")))).alias("mad"))
    return found.select("site", F.round(F.col("vel") * 1000.0, 6).alias("vel_mm"), "n_pairs", F.round(F.col("mad") * 1000.0, 6).alias("mad_mm"))


# ------------------------------------------------------------ kernel


def segment_ids(years: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Segment of each epoch: the epoch nearest to a step opens a segment.

    Of two epochs equally near, the later in run order counts.
    """
    n = len(years)
    opens = np.zeros(n, np.int64)
    for s in np.unique(steps) if n else ():
        gap = np.abs(years - s)
        opens[n - 1 - int(np.argmin(gap[::-1]))] = 1
    opens[:1] = 0
    return np.cumsum(opens)


def _one_direction(years: np.ndarray, steps: np.ndarray, tolerance: float) -> np.ndarray:
    """Pairs (i, j), j later in run order; ``years`` moves in one direction.

    Partners of an epoch are a range of the run, cut off where its segment ends;
    without any, the first epoch beyond a year stands in, if it is in the segment.
    """
    n = len(years)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    part = segment_ids(years, steps) if len(steps) else None  # never falls along the run
    along = np.abs(years - years[0])
    i = np.arange(n - 1)
    first = np.maximum(np.searchsorted(along, along[:-1] + 1 - tolerance, "right"), i + 1)
    last = np.searchsorted(along, along[:-1] + 1 + tolerance, "left")
    if part is not None:
        last = np.minimum(last, np.searchsorted(part, part[:-1], "right"))
    count = np.maximum(0, last - first)
    stand_in = (count == 0) & (i != n - 2) & (first < n)
    if part is not None:
        stand_in &= part[np.minimum(first, n - 1)] == part[:-1]
    count[stand_in] = 1
    own = np.repeat(i, count)
    other = np.repeat(first, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(np.stack([own, other], 1), axis=0)


def select_pairs(days: np.ndarray, steps: np.ndarray = (), tolerance: float = TOLERANCE) -> np.ndarray:
    """Pairs of both directions, earlier epoch first; duplicates stay."""
    years = np.asarray(days, float) / YEAR_DAYS
    cuts = np.asarray(steps, float) / YEAR_DAYS
    inside = cuts[(cuts > years[0]) & (cuts < years[-1])] if len(years) else cuts
    forward = _one_direction(years, inside, tolerance)
    backward = len(years) - 1 - _one_direction(years[::-1], inside, tolerance)[:, ::-1]
    return np.concatenate([forward, backward])


def trend(days, disp, steps=(), tolerance: float = TOLERANCE) -> dict:
    """Rate, sigma, intercept, residuals and counts of one series.

    Nothing but nulls where no pair, or a scale of zero, leaves no slope.
    """
    order = np.argsort(days, kind="stable")
    days, disp = np.asarray(days, float)[order], np.asarray(disp, float)[order]
    out = {"vel": None, "sigma": None, "intercept": None, "n_pairs": 0, "n_kept": 0, "residual": None}
    if not len(days):
        return out
    pairs = select_pairs(days, steps, tolerance)
    out["n_pairs"] = len(pairs)
    if not len(pairs):
        return out
    i, j = pairs.T
    slope = (disp[j] - disp[i]) / ((days[j] - days[i]) / YEAR_DAYS)
    slope = slope[np.isfinite(slope)]
    if not len(slope):
        return out
    v0 = np.median(slope)
    kept = slope[np.abs(slope - v0) < 2 * SCALE * np.median(np.abs(slope - v0))]
    if not len(kept):
        return out
    vel = float(np.median(kept))
    spread = SCALE * float(np.median(np.abs(kept - vel)))
    n = len(kept) // 4
    t = (days - days[0]) / YEAR_DAYS
    level = float(np.nanmedian(disp - vel * t))
    residual = disp - disp[0] - vel * t - (float(np.nanmedian(disp - disp[0] - vel * t)) + disp[0])
    return out | {"vel": vel, "sigma": 3 * math.sqrt(math.pi / 2) * spread / math.sqrt(n) if n else None, "intercept": level, "n_kept": len(kept), "residual": residual}


def _median(x: np.ndarray) -> float:
    """Median of finite values, without the general form's cost for each call."""
    x, n = np.sort(x), len(x)
    return float((x[(n - 1) // 2] + x[n // 2]) / 2)


def rate_of(days: np.ndarray, disp: np.ndarray, steps=(), tolerance: float = TOLERANCE) -> tuple[float | None, float | None]:
    """Rate and sigma as in ``trend``, nothing else; ``days`` ascend.  For very many short windows."""
    if len(days) < 2:
        return None, None
    i, j = select_pairs(days, steps, tolerance).T
    slope = (disp[j] - disp[i]) / ((days[j] - days[i]) / YEAR_DAYS)
    slope = slope[np.isfinite(slope)]
    if not len(slope):
        return None, None
    off = np.abs(slope - _median(slope))
    kept = slope[off < 2 * SCALE * _median(off)]
    if not len(kept):
        return None, None
    vel = _median(kept)
    spread = SCALE * _median(np.abs(kept - vel))
    n = len(kept) // 4
    return vel, 3 * math.sqrt(math.pi / 2) * spread / math.sqrt(n) if n else None


def medians(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Median of each of ``n`` groups of finite values; NaN for an empty one."""
    x = x[np.lexsort((x, group))]
    count = np.bincount(group, minlength=n)
    begin = np.cumsum(count) - count
    out = np.full(n, np.nan)
    some = count > 0
    out[some] = (x[(begin + (count - 1) // 2)[some]] + x[(begin + count // 2)[some]]) / 2
    return out


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whole numbers from each ``first`` on, ``count`` of them, one range after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def rates_of(days: np.ndarray, disp: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """``rate_of`` without steps in many ranges of epochs at once; NaN for no rate or no sigma.

    ``key`` ascends over all series: the days of each, moved by more than two years
    from those of any other, so that partners are looked up once for each epoch.
    """
    w = len(first)
    after = np.searchsorted(key, key + YEAR_DAYS * (1 - tolerance), "right"), np.searchsorted(key, key + YEAR_DAYS * (1 + tolerance), "left")
    before = np.searchsorted(key, key - YEAR_DAYS * (1 + tolerance), "right"), np.searchsorted(key, key - YEAR_DAYS * (1 - tolerance), "left")
    size = np.where(last - first > 1, last - first - 1, 0)
    window = np.repeat(np.arange(w), size)
    one, two, own = [], [], []
    # forward: all epochs of a window but its last; one without partners takes the first beyond a year, save the last but one
    e = _ragged(first, size)
    stop = last[window]
    a, b = np.minimum(after[0][e], stop), np.minimum(after[1][e], stop)
    count = np.maximum(0, b - a)
    count[(count == 0) & (e != stop - 2) & (a < stop)] = 1
    one.append(np.repeat(e, count))
    two.append(_ragged(a, count))
    own.append(np.repeat(window, count))
    # backward: all but its first
    e = e + 1
    start = first[window]
    a, b = np.maximum(before[0][e], start), np.maximum(before[1][e], start)
    count = np.maximum(0, b - a)
    alone = (count == 0) & (e != start + 1) & (b > start)
    count[alone], a[alone] = 1, b[alone] - 1
    one.append(_ragged(a, count))
    two.append(np.repeat(e, count))
    own.append(np.repeat(window, count))
    i, j, k = (np.concatenate(v) for v in (one, two, own))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (disp[j] - disp[i]) / ((days[j] - days[i]) / YEAR_DAYS)
    ok = np.isfinite(slope)
    slope, k = slope[ok], k[ok]
    off = np.abs(slope - medians(k, slope, w)[k])
    ok = off < 2 * SCALE * medians(k, off, w)[k]
    slope, k = slope[ok], k[ok]
    rate = medians(k, slope, w)
    spread = SCALE * medians(k, np.abs(slope - rate[k]), w)
    n = np.bincount(k, minlength=w) // 4
    return rate, np.where(n > 0, 3 * math.sqrt(math.pi / 2) * spread / np.sqrt(np.maximum(n, 1)), np.nan)


TREND = "site long, vel double, sigma double, intercept double, n_pairs long, n_kept long"


def robust_trend(series: DataFrame, steps: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The exact kernel for every site: columns site, d, disp; steps: site, d."""

    def one(key, group: pd.DataFrame, cuts: pd.DataFrame | None = None) -> pd.DataFrame:
        found = trend(group["t"].to_numpy(), group["disp"].to_numpy(), cuts["t"].to_numpy() if cuts is not None else (), tolerance)
        return pd.DataFrame([{"site": key[0], **{k: v for k, v in found.items() if k != "residual"}}])

    t = F.datediff("d", F.lit("2000-01-01").cast("date")).alias("t")
    rows = series.where("disp is not null and not isnan(disp)").select("site", t, "disp").groupBy("site")
    if steps is None:
        return rows.applyInPandas(lambda key, g: one(key, g), TREND)
    cut = steps.select("site", t).groupBy("site")
    return rows.cogroup(cut).applyInPandas(lambda key, g, c: one(key, g, c), TREND).where("n_pairs is not null")


def beside_steps(series: DataFrame, steps: DataFrame) -> DataFrame:
    """site, step, and the epochs before (or on), on (or after), and strictly after it.

    One pass in the order of days over epochs and steps together; no epoch meets a step it isn't next to.
    """
    t = F.datediff("d", F.lit("2000-01-01").cast("date")).alias("t")
    rows = series.select("site", t, F.col("d").alias("epoch"), F.lit(None).cast("date").alias("step")).unionByName(steps.distinct().select("site", t, F.lit(None).cast("date").alias("epoch"), F.col("d").alias("step")))
    up, down = Window.partitionBy("site").orderBy("t"), Window.partitionBy("site").orderBy(F.desc("t"))
    found = {
        "before": F.max("epoch").over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.min("epoch").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "later": F.min("epoch").over(down.rangeBetween(Window.unboundedPreceding, -1)),
    }
    return rows.withColumns(found).where("step is not null").select("site", "step", *found)


def nearest_epoch(series: DataFrame, steps: DataFrame) -> DataFrame:
    """The epoch nearest to each step of its site; ties go to the later one."""
    gap = lambda c: F.abs(F.datediff(c, "step"))
    near = beside_steps(series, steps).withColumn("epoch", F.when(F.col("before").isNull() | (gap("after") <= gap("before")), F.col("after")).otherwise(F.col("before")))
    return near.where("epoch is not null").select("site", "step", "epoch", gap("epoch").alias("gap_days"))


def first_after(series: DataFrame, steps: DataFrame) -> DataFrame:
    """The first epoch after each step, if there is one."""
    return beside_steps(series, steps).where("later is not null").select("site", F.col("step").alias("d"), F.col("later").alias("e"))


def pairs_of_sites(series: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The kernel's pairs of every site, as days: site, first, second."""
    t = F.datediff("d", F.lit("2000-01-01").cast("date")).alias("t")

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        days = np.sort(g["t"].to_numpy(float))
        i, j = select_pairs(days, (), tolerance).reshape(-1, 2).T
        return pd.DataFrame({"site": key[0], "first": days[i].astype(int), "second": days[j].astype(int)})

    return series.select("site", t).groupBy("site").applyInPandas(one, "site long, first long, second long")


def site_fits(series: DataFrame, steps: DataFrame, method: str = "robust") -> DataFrame:
    """Rate (mm/yr) and sigma of every site by ``robust``, ``ols`` or ``mle``, and an error instead of a failure."""
    from .noise import TrendModel, ml_trend
    from .regression import lscov

    def fit(days, disp, cuts) -> tuple[float | None, float | None]:
        if method == "robust":
            found = trend(days, disp, cuts)
            return found["vel"], found["sigma"]
        if method == "mle":
            found = ml_trend(days, disp, TrendModel(), cuts)
            return found["rate"], found["sigma"]
        years = (days - days[0]) / YEAR_DAYS
        inside = [c for c in np.unique(cuts) if days[0] < c < days[-1]]
        found = lscov(np.stack([np.ones(len(days)), years, *((days > c).astype(float) for c in inside)], 1), disp)
        return float(found["x"][1]), float(found["stdx"][1])

    def one(key, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        try:
            rate, sigma, error = *fit(g["t"].to_numpy(float), g["disp"].to_numpy(float), c["t"].to_numpy(float)), None
        except Exception as e:  # one site must not end the job
            rate, sigma, error = None, None, str(e)
        scaled = [None if v is None else 1000 * v for v in (rate, sigma)]
        return pd.DataFrame([[key[0], *scaled, error]], columns=["site", "rate", "sigma", "error"]).astype({"rate": "float64", "sigma": "float64"})

    t = F.datediff("d", F.lit("2000-01-01").cast("date")).alias("t")
    rows, cut = series.select("site", t, "disp").groupBy("site"), steps.select("site", t).groupBy("site")
    return rows.cogroup(cut).applyInPandas(one, "site long, rate double, sigma double, error string")
