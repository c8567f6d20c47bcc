"""Window and sequence operators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import WINDOW_YEAR_DAYS, YEAR_DAYS, decimal_year
from .robust import medians, rate_of, rates_of, trend


def _by_site():
    return Window.partitionBy("site").orderBy("d")


def rolling(series: DataFrame, k: int, value: str = "disp") -> DataFrame:
    """Median, mean and sample deviation of the last ``k`` rows; null before that."""
    w = _by_site().rowsBetween(-(k - 1), 0)
    full = F.count(value).over(w) == k
    ordered = F.sort_array(F.collect_list(value).over(w))  # of k values, where it counts
    median = ordered[k // 2] if k % 2 else (ordered[k // 2 - 1] + ordered[k // 2]) / 2
    return series.withColumns({"median_k": F.when(full, median), "mean_k": F.when(full, F.avg(value).over(w)), "std_k": F.when(full, F.stddev_samp(value).over(w))})


def difference(series: DataFrame, periods: int = 1, value: str = "disp") -> DataFrame:
    diff = F.col(value) - F.lag(value, periods).over(_by_site())
    return series.withColumns({"diff": diff, "jump": F.abs(diff)})


def smoothed_jumps(series: DataFrame, k: int, periods: int = 1, value: str = "disp") -> DataFrame:
    """Mean time and median value of the last ``k`` rows beside the change of that median.

    Times and values of one row lie side by side, so no join by row number is
    needed.  Rows before ``k`` are left out; ``change`` is null in the next ``periods``.
    """
    w = _by_site().rowsBetween(-(k - 1), 0)
    rows = rolling(series, k, value).withColumn("mean_time", F.avg(decimal_year(F.col("d"))).over(w))
    change = F.abs(F.col("median_k") - F.lag("median_k", periods).over(_by_site()))
    return rows.withColumn("change", change).where("median_k is not null")


def jumps(series: DataFrame, k: int, factor: float = 2.0) -> DataFrame:
    """Rows farther than ``factor`` rolling deviations from the rolling mean."""
    return rolling(series, k).withColumn("is_jump", F.coalesce(F.abs(F.col("disp") - F.col("mean_k")) > factor * F.col("std_k"), F.lit(False)))


def above_percentile(series: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows of each site above a percentile of the site's values."""
    limit = series.groupBy("site").agg(F.percentile(value, q).alias("limit"))
    return series.join(limit, "site").where(F.col(value) > F.col("limit"))


def reconstruction_error(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Mean squared error of standardised rows after projection on ``k`` principal components.

    Only sums of squares and products come to the driver.
    """
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    full = df.dropna(subset=columns)
    row = full.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if not row["n"]:
        return full.withColumn("error", F.lit(None).cast("double"))
    sd = [row[f"s{i}"] or 1.0 for i in range(p)]
    corr = np.zeros((p, p))
    for i, j in pairs:
        corr[i, j] = corr[j, i] = row[f"c{i}_{j}"] / sd[i] / sd[j]
    vectors = np.linalg.eigh(corr)[1][:, ::-1][:, :k]
    rest = np.eye(p) - vectors @ vectors.T
    z = [(F.col(c) - row[f"m{i}"]) / sd[i] for i, c in enumerate(columns)]
    parts = [sum((float(rest[i, j]) * z[j] for j in range(p)), F.lit(0.0)) for i in range(p)]
    return full.withColumn("error", sum((e * e for e in parts), F.lit(0.0)) / p)


# ------------------------------------------------------------ moving windows with recursive anchors


def anchors(days: np.ndarray, years: float, offset: float | None = None) -> np.ndarray:
    """Starts of windows; ``days`` ascend.

    Each is the first epoch beyond the last one plus the advance, which is
    ``offset`` years or half of the width.  Starts that the series goes on after
    for no more than the width are left out, but for the first.
    """
    if not len(days):
        return days
    advance, width = int(WINDOW_YEAR_DAYS * (years / 2 if offset is None else offset)), int(WINDOW_YEAR_DAYS * years)
    out, cur = [days[0]], days[0]
    while (at := int(np.searchsorted(days, cur + advance, "right"))) < len(days):
        cur = days[at]
        if int(days[-1] - cur) > width:
            out.append(cur)
    return np.array(out)


def fitted_ranges(days: np.ndarray, y: np.ndarray, n: np.ndarray, periods: Sequence[float], steps: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rate and its deviation in ranges of epochs of many series; NaN where a range doesn't fix them.

    ``days`` and ``y`` hold a series a row, of which the first ``n`` values count;
    ``steps`` ascend in a row and end in infinities.  ``owner`` is the row of each range.
    Running sums of products of the columns (constant, time, periodic terms and
    steps) give the normal equations of any range of epochs as differences; all
    ranges are solved in one batch.  A step takes part where it lies strictly
    between a range's first and last epoch, and of several steps between the same
    two epochs one does.  The base terms of the whole series are subtracted first,
    and time is counted from the middle of a range, to keep the sums small.
    """
    m, length = days.shape
    seen = (np.arange(length) < n[:, None]).astype(float)
    origin = (days * seen).sum(axis=1) / np.maximum(n, 1)
    t = (days - origin[:, None]) / YEAR_DAYS
    angles = [t * (2 * math.pi / p) for p in periods]
    base = [seen, t * seen, *(f(a) * seen for a in angles for f in (np.cos, np.sin))]
    n_base = len(base)
    design = np.stack(base, 2)
    across = np.swapaxes(design, 1, 2)
    x0 = (np.linalg.pinv(across @ design, hermitian=True) @ (across @ (y * seen)[:, :, None]))[:, :, 0]
    y = (y - (design @ x0[:, :, None])[:, :, 0]) * seen
    columns = base + [(days > steps[:, k, None]) * seen for k in range(steps.shape[1])]
    p, w = len(columns), len(first)
    rate, sigma = np.full(w, np.nan), np.full(w, np.nan)
    if not w or not length:
        return rate, sigma
    total = np.zeros((m, length + 1))

    def sums(values: np.ndarray) -> np.ndarray:
        np.cumsum(values, axis=1, out=total[:, 1:])
        return total[owner, last] - total[owner, first]

    g, r = np.zeros((w, p, p)), np.zeros((w, p))
    for i in range(p):
        r[:, i] = sums(columns[i] * y)
        for j in range(i, p):
            g[:, i, j] = g[:, j, i] = sums(columns[i] * columns[j])
    yy = sums(y * y)
    # time from the middle of the range
    end = np.maximum(n[owner] - 1, 0)
    lo, hi = (days[owner, np.clip(x, 0, end)] for x in (first, last - 1))
    shift = -((lo + hi) / 2 - origin[owner]) / YEAR_DAYS
    g[:, 1] += shift[:, None] * g[:, 0]
    g[:, :, 1] += shift[:, None] * g[:, :, 0]
    r[:, 1] += shift * r[:, 0]
    active = np.ones((w, p), bool)
    if steps.shape[1]:
        own = steps[owner]
        inside = (own > lo[:, None]) & (own < hi[:, None])
        before = np.stack([((days <= steps[:, k, None]) * seen).sum(axis=1) for k in range(steps.shape[1])], 1)
        active[:, n_base:] = inside & ~np.c_[np.zeros(w, bool), inside[:, :-1] & (before[:, 1:] == before[:, :-1])[owner]]
    g *= active[:, :, None] & active[:, None, :]
    at = np.arange(p)
    g[:, at, at] += ~active
    r *= active
    scale = np.sqrt(np.maximum(g[:, at, at], 1e-300))
    unit = g / (scale[:, :, None] * scale[:, None, :])
    dof = last - first - active.sum(axis=1)
    fixed = dof > 0
    fixed[fixed] = np.linalg.eigvalsh(unit[fixed])[:, 0] > 1e-10
    if fixed.any():
        inverse = np.linalg.inv(unit[fixed]) / (scale[fixed][:, :, None] * scale[fixed][:, None, :])
        x = (inverse @ r[fixed][:, :, None])[:, :, 0]
        left = np.maximum(0.0, yy[fixed] - (x * r[fixed]).sum(axis=1))
        rate[fixed] = x[:, 1] + x0[owner[fixed], 1]
        sigma[fixed] = np.sqrt(left / dof[fixed] * np.maximum(0.0, inverse[:, 1, 1]))
    return rate, sigma


class SlidingFits:
    """Least squares in many ranges of one series; see ``fitted_ranges``."""

    def __init__(self, days: np.ndarray, disp: np.ndarray, periods: Sequence[float] = (), steps: Sequence[float] = ()):
        ok = np.isfinite(disp)
        self.days, self.kept = np.asarray(days, float)[ok], np.r_[0, np.cumsum(ok)]
        self.y, self.periods, self.steps = np.asarray(disp, float)[ok], periods, np.unique(np.asarray(steps, float))

    def solve(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rate and its deviation for each range of epochs; NaN where the range doesn't fix them."""
        first, last = self.kept[np.asarray(first, int)], self.kept[np.maximum(first, last).astype(int)]
        return fitted_ranges(self.days[None], self.y[None], np.array([len(self.y)]), self.periods, self.steps[None], np.zeros(len(first), int), first, last)


def _members(days: np.ndarray, years: float, offset: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of windows and the range of epochs in each: strictly between its anchor and its end."""
    start = anchors(days, years, offset)
    first = np.searchsorted(days, start, "right")
    return start, first, np.maximum(first, np.searchsorted(days, start + int(WINDOW_YEAR_DAYS * years), "left"))


def window_rates(days, disp, years: float, steps=(), method: str = "robust", offset: float | None = None, periods: Sequence[float] = (), fits: SlidingFits | None = None) -> list[dict]:
    """Rate and deviation in each window; members lie strictly between its anchor and its end.  ``days`` ascend."""
    days, disp = np.asarray(days, float), np.asarray(disp, float)
    start, first, last = _members(days, years, offset)
    if method == "robust":
        found = [rate_of(days[a:b], disp[a:b], steps) for a, b in zip(first, last, strict=True)]
        return [{"anchor": float(a), "vel": v, "sigma": s} for a, (v, s) in zip(start, found, strict=True) if v is not None]
    rate, sigma = (fits or SlidingFits(days, disp, periods, steps)).solve(first, last)
    return [{"anchor": float(a), "vel": float(v), "sigma": float(s)} for a, v, s in zip(start, rate, sigma, strict=True) if np.isfinite(v)]


def all_rates(days, disp, sizes: Sequence[float], steps=(), method: str = "robust", offset: float | None = None, periods: Sequence[float] = ()) -> tuple[float | None, np.ndarray, np.ndarray]:
    """Rate of the whole series, and rates and deviations in the windows of all ``sizes``.

    Least squares solves the windows of all sizes, and the whole, in one batch.
    """
    days, disp = np.asarray(days, float), np.asarray(disp, float)
    if method == "robust":
        found = [w for s in sizes for w in window_rates(days, disp, s, steps, method, offset)]
        rate, sigma = (np.array([w[k] for w in found], float) for k in ("vel", "sigma"))
        return rate_of(days, disp, steps)[0], rate, sigma
    ranges = [_members(days, s, offset)[1:] for s in sizes]
    first, last = (np.concatenate([[end], *(r[i] for r in ranges)]) for i, end in enumerate((0, len(days))))
    rate, sigma = SlidingFits(days, disp, periods, steps).solve(first, last)
    ok = np.isfinite(rate[1:])
    return float(rate[0]) if np.isfinite(rate[0]) else None, rate[1:][ok], sigma[1:][ok]


def window_sizes(duration_years: float, least: int = 3, most: int | None = None) -> list[float]:
    """Whole years from ``least`` up to under ``most``, 3/4 of the duration; 1 counts as 1.1."""
    end = int(0.75 * duration_years) if most is None else most
    return [1.1 if s == 1 else float(s) for s in range(least, end)]


def _alike(a, b) -> np.ndarray:
    """Whether values of two arrays are equal, in their own type; null equals null."""
    a, b = pd.array(a), pd.array(b)
    both = a.isna() & b.isna()
    return np.asarray(pd.array(a == b, dtype="boolean").fillna(False), bool) | np.asarray(both, bool)


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole series, and where each begins and ends, from batches sorted by ``keys``; null keys are one key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if all(_alike(batch[k].array[-1:], held[0][k].array[:1])[0] for k in keys):
            continue  # one series over many batches
        part = pd.concat(held, ignore_index=True)
        same = np.logical_and.reduce([_alike(part[k].array[1:], part[k].array[:-1]) for k in keys])
        cuts = np.flatnonzero(np.r_[True, ~same])
        yield part.iloc[: cuts[-1]], cuts
        held = [part.iloc[cuts[-1] :]]
    if held:
        part = pd.concat(held, ignore_index=True)
        yield part, np.array([0, len(part)])


def series_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """One series after another from batches sorted by ``keys``; null keys are one key."""
    for part, cuts in runs_of(batches, keys):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(part[k].iat[a] for k in keys), part.iloc[a:b]


#: Integers keep their type beside nulls.
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def _days(d: str) -> Column:
    return F.datediff(d, F.lit("2000-01-01").cast("date"))


def _site_kernel(series: DataFrame, keys: list[str], f, schema: str, steps: DataFrame | None = None) -> DataFrame:
    """Rows of ``f(days, values, steps)`` for each series, in one pass over sorted partitions.

    Many short series share a batch, so there is no exchange with Python for each.
    ``steps`` has ``d`` and the keys, or ``d`` alone for steps of every series; these
    come to the driver as a list of dates.
    """
    rows = series.where("disp is not null and not isnan(disp)").select(*keys, _days("d").alias("t"), "disp")
    common: list[float] = []
    if steps is not None and set(keys) <= set(steps.columns):
        rows = rows.unionByName(steps.where("d is not null").select(*keys, _days("d").alias("t"), F.lit(None).cast("double").alias("disp")).distinct())
    elif steps is not None:
        common = sorted(float(r["t"]) for r in steps.where("d is not null").select(_days("d").alias("t")).distinct().collect())
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for key, g in series_of((b.to_pandas(types_mapper=_NULLABLE.get) for b in batches), keys):
            own = {k: None if pd.isna(v) else v for k, v in zip(keys, key, strict=True)}
            t, disp = g["t"].to_numpy(float), g["disp"].to_numpy(float, na_value=np.nan)
            seen = np.isfinite(disp)
            if seen.any():
                out += [own | x for x in f(t[seen], disp[seen], np.r_[common, t[~seen]])]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in out], arrow)
                out = []
        yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in out], arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(run, schema)


class ManySeries:
    """Some series of finite values one after another, and windows of all of them at once.

    ``t`` ascends within a series; series ``k`` is ``begin[k]:begin[k + 1]``.  Its
    steps are row ``k`` of ``steps``, ascending, then infinities.
    """

    def __init__(self, t: np.ndarray, x: np.ndarray, begin: np.ndarray, steps: np.ndarray):
        self.t, self.x, self.begin, self.steps = t, x, begin, steps
        self.n = np.diff(begin)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)

    def keys(self, reach: float) -> tuple[np.ndarray, float, float]:
        """Days of all series in one ascending order: no series comes within ``reach`` days of another."""
        low = float(self.t.min())
        far = float(self.t.max()) - low + reach + 2
        return self.owner * far + (self.t - low), far, low

    def windows(self, years: float, offset: float | None, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Series, anchor and range of epochs of the windows of ``chosen`` series: as ``anchors`` and ``_members``."""
        advance, width = int(WINDOW_YEAR_DAYS * (years / 2 if offset is None else offset)), int(WINDOW_YEAR_DAYS * years)
        key, far, low = self.keys(max(advance, width))
        k, end = chosen, self.t[self.begin[1:] - 1]
        cur = self.t[self.begin[k]]
        found = [(k, cur)]
        while len(k):
            at = np.searchsorted(key, k * far + (cur + advance - low), "right")
            on = at < self.begin[k + 1]
            k, cur = k[on], self.t[at[on]]
            wide = np.floor(end[k] - cur) > width
            found.append((k[wide], cur[wide]))
        k, start = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((start, k))
        k, start = k[order], start[order]
        first = np.searchsorted(key, k * far + (start - low), "right")
        return k, start, first, np.maximum(first, np.searchsorted(key, k * far + (start + width - low), "left"))

    def rates(self, k: np.ndarray, first: np.ndarray, last: np.ndarray, method: str, periods: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Rate and deviation in ranges of epochs; NaN where there is none."""
        if method == "robust":
            if not self.steps.shape[1]:
                return rates_of(self.t, self.x, self.keys(2 * YEAR_DAYS)[0], first, last)
            found = [rate_of(self.t[a:b], self.x[a:b], self.steps[i][np.isfinite(self.steps[i])]) for i, a, b in zip(k, first, last, strict=True)]
            return tuple(np.array([np.nan if f[i] is None else f[i] for f in found], float) for i in (0, 1))
        rate, sigma = np.full(len(k), np.nan), np.full(len(k), np.nan)
        kind = np.frexp(self.n)[1]  # series of about one length lie side by side
        for size in np.unique(kind[k]).tolist():
            rows = np.flatnonzero(kind == size)
            for part in np.array_split(rows, math.ceil(len(rows) * 2**size / PADDED)):
                mine = np.flatnonzero((kind[k] == size) & (k >= part[0]) & (k <= part[-1]))
                n = self.n[part]
                at = self.begin[part][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
                own = np.searchsorted(part, k[mine])
                rate[mine], sigma[mine] = fitted_ranges(self.t[at], self.x[at], n, periods, self.steps[part], own, first[mine] - self.begin[k[mine]], last[mine] - self.begin[k[mine]])
        return rate, sigma


#: Values of padded series that are fitted at once.
PADDED = 1 << 18


def _many_kernel(series: DataFrame, keys: list[str], f, schema: str, steps: DataFrame | None = None) -> DataFrame:
    """As ``_site_kernel``, with ``f`` of a ``ManySeries``: the series' numbers and a column each of the values after the keys.

    A batch of rows is solved at once, so there is no Python for each series.  Tasks
    are as many as the shuffle's, not merged by bytes: the rows are few, the work isn't.
    """
    rows = series.where("disp is not null and not isnan(disp)").select(*keys, _days("d").alias("t"), F.col("disp").cast("double"))
    common = np.zeros(0)
    if steps is not None and set(keys) <= set(steps.columns):
        rows = rows.unionByName(steps.where("d is not null").select(*keys, _days("d").alias("t"), F.lit(None).cast("double").alias("disp")).distinct())
    elif steps is not None:
        common = np.array(sorted(float(r["t"]) for r in steps.where("d is not null").select(_days("d").alias("t")).distinct().collect()))
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in runs_of((b.to_pandas(types_mapper=_NULLABLE.get) for b in batches), keys):
            t, disp = part["t"].to_numpy(float), part["disp"].to_numpy(float, na_value=np.nan)
            owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            seen, cut = np.isfinite(disp), np.isnan(disp)
            n = np.bincount(owner[seen], minlength=len(cuts) - 1)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            if cut.any():
                own = np.split(t[cut], np.cumsum(np.bincount(owner[cut], minlength=len(cuts) - 1))[:-1])
                own = [np.unique(own[i]) for i in some]
                breaks = np.full((len(some), max(map(len, own))), np.inf)
                for i, v in enumerate(own):
                    breaks[i, : len(v)] = v
            else:
                breaks = np.tile(common, (len(some), 1))
            k, values = f(ManySeries(t[seen], disp[seen], np.r_[0, np.cumsum(n[some])], breaks))
            at = cuts[some[k]]
            columns = [pa.array(part[c].array.take(at), arrow.field(c).type, from_pandas=True) for c in keys]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v, arrow.field(c).type, from_pandas=True) for c, v in zip(names[len(keys) :], values, strict=True)], schema=arrow)

    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "t").mapInArrow(run, schema)


def _key_types(keys: Sequence[str]) -> str:
    return ", ".join(f"{k} long" if k == "site" else f"{k} int" for k in keys)


def temporal_variability(series: DataFrame, years: float, keys: tuple[str, ...] = ("site",), method: str = "robust", offset: float | None = None, periods: Sequence[float] = (), steps: DataFrame | None = None) -> DataFrame:
    """Rates and their deviations in the moving windows of one width, for each key.

    Windows begin ``offset`` years after one another, or half a width; least
    squares (``ols``) fit a line, ``periods`` (years) and the steps inside a window.
    """

    def f(many: ManySeries):
        k, start, first, last = many.windows(years, offset, np.arange(len(many.n)))
        rate, sigma = many.rates(k, first, last, method, periods)
        ok = np.isfinite(rate)
        return k[ok], [start[ok], rate[ok], sigma[ok]]

    return _many_kernel(series, list(keys), f, f"{_key_types(keys)}, anchor double, vel double, sigma double", steps)


def rate_deviation(series: DataFrame, least: int = 3, steps: DataFrame | None = None, start: str | None = None) -> DataFrame:
    """Root median square deviation of window rates, over all widths, from the whole series' rate."""
    if start is not None:
        series = series.where(F.col("d") > F.lit(start).cast("date"))
        steps = steps.where(F.col("d") > F.lit(start).cast("date")) if steps is not None else None

    def f(t, x, cuts):
        whole = trend(t, x, cuts)["vel"]
        rates = [w["vel"] for s in window_sizes((t[-1] - t[0]) / YEAR_DAYS, least) for w in window_rates(t, x, s, cuts)]
        if whole is None or not rates:
            return []
        return [{"vel": whole, "dv": float(np.sqrt(np.median((np.array(rates) - whole) ** 2))), "n_windows": len(rates)}]

    return _site_kernel(series, ["site"], f, "site long, vel double, dv double, n_windows long", steps)


def reduced(off: np.ndarray, sigma: np.ndarray, reduce: str) -> float | None:
    """One number of deviations ``off``: ``mad`` about their median with scale 1, ``median`` (root of the median square) or ``wrms``.

    ``wrms`` weights by the rates' inverse variances; rates whose deviation isn't
    known, or is 0, have no weight, and without any weight there is no number.
    """
    if reduce == "mad":
        return float(np.median(np.abs(off - np.median(off))))
    if reduce == "median":
        return float(np.sqrt(np.median(off**2)))
    if reduce != "wrms":
        raise ValueError(f"no such reduction: {reduce}")
    known = np.isfinite(sigma) & (sigma > 0)
    if not known.any():
        return None
    weight = (sigma[known].min() / sigma[known]) ** 2
    return float(np.sqrt((weight * off[known] ** 2).sum() / weight.sum()))


def reduced_by(k: np.ndarray, off: np.ndarray, sigma: np.ndarray, n: int, reduce: str) -> np.ndarray:
    """``reduced`` of each of ``n`` groups ``k``, none of them empty; NaN for no number."""
    if reduce == "mad":
        return medians(k, np.abs(off - medians(k, off, n)[k]), n)
    if reduce == "median":
        return np.sqrt(medians(k, off**2, n))
    if reduce != "wrms":
        raise ValueError(f"no such reduction: {reduce}")
    known = np.isfinite(sigma) & (sigma > 0)
    k, off, sigma = k[known], off[known], sigma[known]
    least = np.full(n, np.inf)
    np.minimum.at(least, k, sigma)
    weight = (least[k] / sigma) ** 2
    total = np.bincount(k, weight, n)
    return np.sqrt(np.divide(np.bincount(k, weight * off**2, n), total, out=np.full(n, np.nan), where=total > 0))


def variability(stack: DataFrame, least: int = 2, most: int | None = None, reduce: str = "mad", method: str = "robust", keys: tuple[str, ...] = ("y", "x"), offset: float | None = None, periods: Sequence[float] = (), steps: DataFrame | None = None) -> DataFrame:
    """One number (``reduced``) of the deviations of all window rates of a pixel from its whole rate."""

    def f(many: ManySeries):
        last = (many.t[many.begin[1:] - 1] - many.t[many.begin[:-1]]) / YEAR_DAYS
        every = np.arange(len(many.n))
        ends = [int(0.75 * y) if most is None else most for y in last]
        ranges = [(every, many.begin[:-1], many.begin[1:])]
        for size in range(least, max(ends)):
            k, _, a, b = many.windows(1.1 if size == 1 else float(size), offset, np.flatnonzero(np.array(ends) > size))
            ranges.append((k, a, b))
        k, a, b = (np.concatenate([r[i] for r in ranges]) for i in range(3))
        rate, sigma = many.rates(k, a, b, method, periods)
        whole, k, rate, sigma = rate[: len(every)], k[len(every) :], rate[len(every) :], sigma[len(every) :]
        ok = np.isfinite(rate) & np.isfinite(whole[k])
        k, rate, sigma = k[ok], rate[ok], sigma[ok]
        count = np.bincount(k, minlength=len(every))
        some = np.flatnonzero(count)
        return some, [whole[some], reduced_by(np.searchsorted(some, k), rate - whole[k], sigma, len(some), reduce), count[some]]

    return _many_kernel(stack, list(keys), f, f"{_key_types(keys)}, vel double, variability double, n_windows long", steps)


def variability_run(stack: DataFrame, attributes: dict[str, str] | None = None, reference: tuple[int, int] | None = None, dropped: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(dv of every pixel of ``stack``, key and value of the run's metadata).

    Dates in ``dropped`` don't take part.  Pixels whose values average to 0 or
    have none are not fitted, save the reference pixel; they, and those without
    windows, get 0.  A stack in millimetres (attribute UNIT) is turned into metres.
    """
    attributes = dict(attributes or {})
    if dropped:
        stack = stack.where(~F.col("d").isin([F.lit(x).cast("date") for x in dropped]))
    if attributes.get("UNIT") == "mm":
        stack = stack.withColumn("disp", F.col("disp") / 1000.0)
    means = stack.groupBy("y", "x").agg(F.avg(F.when(~F.isnan("disp"), F.col("disp"))).alias("mean"))
    fitted = F.coalesce(F.col("mean") != 0, F.lit(False))
    if reference is not None:
        fitted = fitted | (F.col("y") == reference[0]) & (F.col("x") == reference[1])
    mask = means.select("y", "x", fitted.alias("fitted"))
    found = variability(stack.join(mask.where("fitted"), ["y", "x"], "left_semi"), **options)
    values = mask.join(found.select("y", "x", "variability"), ["y", "x"], "left").select("y", "x", "fitted", F.coalesce("variability", F.lit(0.0)).alias("dv"))
    span = stack.agg(F.date_format(F.min("d"), "yyyyMMdd").alias("first"), F.date_format(F.max("d"), "yyyyMMdd").alias("last"))
    named = {"min_window": options.get("least", 2), "max_window": options.get("most"), "method": options.get("reduce", "mad"), "inv_method": options.get("method", "robust"), "window_offset": options.get("offset")}
    fixed = attributes | {"FILE_TYPE": "velocity", "UNIT": "m/year"} | {k: str(v) for k, v in named.items() if v is not None}
    if reference is not None:
        fixed |= {"REF_Y": str(reference[0]), "REF_X": str(reference[1])}
    dated = {"START_DATE": F.col("first"), "END_DATE": F.col("last"), "DATE12": F.concat_ws("_", "first", "last"), "REF_DATE": F.lit(attributes["REF_DATE"]) if "REF_DATE" in attributes else F.col("first")}
    if dropped:
        fixed["excludeDate"] = ",".join(sorted(dropped))
    pairs = {k: F.lit(v) for k, v in fixed.items() if k not in dated} | dated
    metadata = span.select(F.explode(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))).alias("key", "value"))
    return values, metadata


# ------------------------------------------------------------ tiles


def sliding_windows(length: Column, size: int, overlap: int, first: int = 0) -> Column:
    """Array of struct(start, stop): tiles every size - overlap; the last reaches the end."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((length - first - size) / step).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * step + first).cast("int"))
    return F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.when(i == n - 1, length).otherwise(s + size).cast("int").alias("stop")))


def moving_windows(pixels: DataFrame, size_y: int, size_x: int, overlap_y: int, overlap_x: int, value: str = "value") -> DataFrame:
    """Tiles (tile, y0, y1, x0, x1): the columns of each strip follow from its data."""
    data = pixels.where((F.col(value) != 0) | F.isnan(value)).select("y", "x")
    span = data.agg(F.min("y").alias("lo"), (F.max("y") + 1).alias("hi"))
    strips = span.where("lo is not null").select("lo", F.posexplode(sliding_windows(F.col("hi") - F.col("lo"), size_y, overlap_y)).alias("strip", "t")).select("strip", (F.col("t.start") + F.col("lo")).alias("y0"), (F.col("t.stop") + F.col("lo")).alias("y1"))
    rows = data.groupBy("y").agg(F.min("x").alias("xa"), F.max("x").alias("xb"))
    listed = strips.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    strip = rows.join(listed, "y").groupBy("strip", "y0", "y1").agg(F.min("xa").alias("lo"), (F.max("xb") + 1).alias("hi"))
    tiles = strip.select("strip", "y0", "y1", "lo", F.posexplode(sliding_windows(F.col("hi") - F.col("lo"), size_x, overlap_x)).alias("column", "t"))
    return tiles.select("strip", "column", "y0", "y1", (F.col("t.start") + F.col("lo")).alias("x0"), (F.col("t.stop") + F.col("lo")).alias("x1"))


def extended(tiles: DataFrame, by_y: int, by_x: int, length: int, width: int) -> DataFrame:
    """Tiles widened inside the raster, and where the core lies in them."""
    ey0, ey1 = F.greatest(F.col("y0") - by_y, F.lit(0)), F.least(F.col("y1") + by_y, F.lit(length))
    ex0, ex1 = F.greatest(F.col("x0") - by_x, F.lit(0)), F.least(F.col("x1") + by_x, F.lit(width))
    return tiles.withColumns({"ey0": ey0, "ey1": ey1, "ex0": ex0, "ex1": ex1, "py0": F.col("y0") - ey0, "py1": F.col("y1") - ey0, "px0": F.col("x0") - ex0, "px1": F.col("x1") - ex0})


def fill_gaps_regular(series: DataFrame, period: int = 1) -> DataFrame:
    """A regular series: missing days come in with null values."""
    after = F.lead("d").over(_by_site())
    rows = series.withColumn("_next", after)
    filled = F.when(F.datediff("_next", "d") > period, F.sequence(F.col("d"), F.date_sub(F.col("_next"), 1), F.expr(f"INTERVAL {period} DAY"))).otherwise(F.array("d"))
    out = rows.select("site", "disp", F.posexplode(filled).alias("_i", "day"))
    return out.select("site", F.col("day").alias("d"), F.when(F.col("_i") == 0, F.col("disp")).alias("disp"))


def adjust_steps(stack: DataFrame, step_dates: list[str], keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Subtract each step's offset inside the segment that begins at its epoch.

    The step epoch is the last one not after the step; the offset is the next
    value minus the value there, and isn't carried to later segments.
    """
    w = Window.partitionBy(*keys).orderBy("d")
    rows = stack.withColumn("_next", F.lead("d").over(w)).withColumn("_value", F.lead("disp").over(w))
    hit = F.lit(False)
    for s in step_dates:
        day = F.lit(s).cast("date")
        hit = hit | (F.col("d") <= day) & (F.col("_next") > day)
    rows = rows.withColumn("_opens", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("segment", F.sum(F.col("_opens").cast("int")).over(w))
    offset = F.first(F.when(F.col("_opens"), F.col("_value") - F.col("disp")), ignorenulls=True).over(Window.partitionBy(*keys, "segment"))
    return rows.select(*keys, "d", "disp", "segment", (F.col("disp") - F.coalesce(offset, F.lit(0.0))).alias("adjusted"))


def reference_to_mean(stack: DataFrame, keys: tuple[str, ...] = ("y", "x"), adjusted: str = "adjusted") -> DataFrame:
    """Subtract the mean of the adjusted series without zeros; the first epoch stays raw."""
    mean = F.avg(F.when(F.col(adjusted) != 0, F.col(adjusted))).over(Window.partitionBy(*keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("d")) == 1
    return stack.withColumn("referenced", F.when(first, F.col("disp")).otherwise(F.col("disp") - mean))


def running_offset(segments: DataFrame, order: str = "seq", length: str = "length") -> DataFrame:
    """Length of all segments before each one; a profile line is a short table."""
    w = Window.partitionBy("line").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0.0)))
