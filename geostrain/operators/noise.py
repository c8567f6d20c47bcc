"""Trends with coloured noise by maximum likelihood, and spectra.

The model is a polynomial with periodic and step terms plus a mix of white and
power-law noise, as published for station series (Bos et al., 2013): fractions
and spectral index maximise the likelihood of the residuals of the generalised
least-squares fit, with a Toeplitz covariance of the fractional difference.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of noise models (fixed values): spectral index, None if it is estimated.
#: RWFNWN has two coloured components, random walk and flicker, besides the white one.
#: Damping of the Gauss-Markov model a step (the published control file's 1 - phi).
DAMPING = {"GGMWN": 6.9e-6}
NOISE = {"WN": 0.0, "FNWN": -1.0, "RWWN": -2.0, "PLWN": None, "GGMWN": None, "RWFNWN": None}


@dataclass(frozen=True)
class TrendModel:
    """Options of a maximum-likelihood trend; unknown noise names are refused.

    ``restricted`` takes the likelihood of what the columns leave free, so that
    noise isn't underestimated by their number.  ``filter_iq`` removes epochs whose
    residual from ordinary least squares is farther from the median than so many
    interquartile ranges, again until none is.
    """

    poly_deg: int = 1
    periods: tuple[float, ...] = (1.0, 0.5)
    noise: str = "FNWN"
    sampling_days: float = 1.0
    restricted: bool = False
    filter_iq: float | None = None

    def __post_init__(self):
        if self.noise not in NOISE:
            raise ValueError(f"unknown noise model {self.noise!r}; known: {', '.join(NOISE)}")

    def periods_in_days(self) -> list[str]:
        return [f"{p * 365.25:.3f}" for p in self.periods]


def power_law_filter(n: int, index: float, damping: float = 0.0) -> np.ndarray:
    """Impulse response of fractionally integrated noise of a spectral index (0 to -2)."""
    k = np.arange(1, n)
    return np.cumprod(np.r_[1.0, (k - 1 - index / 2) / k * (1 - damping)])


def _covariance(days: np.ndarray, step: float, index: float, damping: float = 0.0) -> np.ndarray:
    """Covariance of power-law noise that begins at the first epoch, at the epochs there are.

    Steps follow one another, so that one row of all steps is held at a time.
    """
    at = np.rint((days - days[0]) / step).astype(int)
    h = power_law_filter(int(at[-1]) + 1, index, damping)
    out = np.empty((len(at), len(at)))
    row, k = h.copy(), 0
    for i, a in enumerate(at):
        while k < a:
            k += 1
            row[1:] = row[:-1] + h[k] * h[1:]
            row[0] = h[k]
        out[i] = row[at]
    return out


#: Longest matrix of all steps that a worker keeps (72 MB), and those it has: by index and damping.
KEPT_STEPS = 3000
_kept: dict[tuple[float, float], np.ndarray] = {}


def _shared_covariance(days: np.ndarray, step: float, index: float, damping: float = 0.0) -> np.ndarray:
    """``_covariance`` of an index that many series share: noise begins with each series, so all take their epochs from one matrix."""
    at = np.rint((days - days[0]) / step).astype(int)
    n = int(at[-1]) + 1
    if n > KEPT_STEPS:
        return _covariance(days, step, index, damping)
    whole = _kept.get((index, damping))
    if whole is None or len(whole) < n:
        if len(_kept) > 1 and whole is None:
            _kept.clear()
        whole = _kept[index, damping] = _covariance(np.arange(min(KEPT_STEPS, n + n // 8), dtype=float), 1.0, index, damping)
    return whole[at[:, None], at]


def _mean_variance(days: np.ndarray, step: float, index: float, damping: float = 0.0) -> float:
    """Mean of the covariance's diagonal for unit driving noise."""
    at = np.rint((days - days[0]) / step).astype(int)
    return float(np.cumsum(power_law_filter(int(at[-1]) + 1, index, damping) ** 2)[at].mean())


def _scaled(c: np.ndarray) -> np.ndarray:
    return c / np.trace(c) * len(c)


def _greatest(f, grid, tol: float) -> tuple[float, tuple]:
    """Argument and value of the greatest f (a tuple that begins with it): grid, then golden section around its best."""
    values = [f(g) for g in grid]
    k = max(range(len(grid)), key=lambda i: values[i][0])
    found = [(grid[k], values[k])]
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    r = (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        found += [(a, fa), (b, fb)]
        if fa[0] >= fb[0]:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return max([*found, (a, fa), (b, fb)], key=lambda v: v[1][0])


def event_column(days: np.ndarray, kind: str, day: float, tau: float | None = None) -> np.ndarray | None:
    """Column of a step, a relaxation (log, exp) after a day or a slow slip (tanh) around it; none where the series can't tell it.

    ``tau`` is in days.  A step counts after its day.  Slow slips are centred: their
    size is that from long before to long after.
    """
    if kind not in ("step", "log", "exp", "tanh"):
        raise ValueError(f"unknown event {kind!r}; known: step, log, exp, tanh")
    if day is None or not np.isfinite(day) or not len(days) or day >= days[-1] or (kind in ("step", "tanh") and day <= days[0]):
        return None
    since = days - day
    if kind == "step":
        return (since > 0).astype(float)
    if tau is None or not tau > 0:
        raise ValueError(f"{kind} needs a time constant above 0")
    if kind == "tanh":
        return 0.5 * np.tanh(since / tau)
    later = np.maximum(since, 0.0) / tau
    return np.log1p(later) if kind == "log" else 1 - np.exp(-later)


def without_outliers(a: np.ndarray, y: np.ndarray, factor: float) -> np.ndarray:
    """Epochs that stay when those far outside the residuals' interquartile range are removed until none is."""
    keep = np.ones(len(y), bool)
    while keep.sum() > a.shape[1]:
        r = y - a @ np.linalg.lstsq(a[keep], y[keep], rcond=None)[0]
        low, mid, high = np.percentile(r[keep], [25, 50, 75])
        far = keep & (np.abs(r - mid) > factor * (high - low))
        if not far.any() or high <= low:
            break
        keep &= ~far
    return keep


def _likelihood(a, y, d, restricted=False) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Of uncorrelated observations with variances proportional to ``d``."""
    root = np.sqrt(d)
    wa, wy = a / root[:, None], y / root
    q = np.linalg.inv(wa.T @ wa)
    x = q @ (wa.T @ wy)
    r = wy - wa @ x
    n = len(y) - (a.shape[1] if restricted else 0)
    s2 = float(r @ r) / n
    value = -0.5 * (n * math.log(2 * math.pi) + np.log(d).sum() + n * math.log(max(s2, 1e-300)) + n)
    if restricted:
        value += 0.5 * (np.linalg.slogdet(q)[1] + np.linalg.slogdet(a.T @ a)[1])
    return value, x, q, s2


def _best_fraction(a, y, c, restricted=False) -> tuple:
    """(likelihood, x, q, s2, fraction) of the best mix of white noise and ``c``.

    In the axes of ``c`` every mix is diagonal, so one decomposition serves all.
    """
    w, u = np.linalg.eigh(c)
    w, a, y = np.maximum(w, 0.0), u.T @ a, u.T @ y
    f, got = _greatest(lambda f: _likelihood(a, y, (1 - f) + f * w, restricted), np.linspace(0, 0.9999, 21), 1e-5)
    return *got, f


def ml_trend(days, obs, model: TrendModel = TrendModel(), steps=(), events=()) -> dict:
    """Rate (per year), its deviation, noise fraction and index of one series.

    The whole series is fitted: work grows with the cube of its epochs, memory
    with their square.  Of RWFNWN, ``kappa`` is none and ``walk`` is the share of
    the random walk in the coloured noise.  ``events`` are (kind, day, tau), as in
    ``event_column``; ``effects`` gives the size and deviation of those that the
    series can tell, and ``n`` the epochs that were fitted.  ``components`` are deviation and index
    of the white noises that drive each part.
    """
    days, obs = np.asarray(days, float), np.asarray(obs, float)
    ok = np.isfinite(obs)
    days, obs = days[ok], obs[ok]
    out = {"rate": None, "sigma": None, "fraction": None, "kappa": None, "loglik": None, "n": len(days), "effects": []}
    step = model.sampling_days
    t = (days - days.mean()) / 365.25 if len(days) else days
    cols = [t**k for k in range(model.poly_deg + 1)]
    for p in model.periods:
        cols += [np.cos(2 * np.pi * t / p), np.sin(2 * np.pi * t / p)]
    cols += [(days > s).astype(float) for s in steps if len(days) and days[0] < s < days[-1]]
    told = [(e, column) for e in events if (column := event_column(days, *e)) is not None]
    first = len(cols)
    cols += [column for _, column in told]
    if len(days) <= len(cols) + 2:
        return out
    a = np.stack(cols, 1)
    if model.filter_iq is not None:
        keep = without_outliers(a, obs, model.filter_iq)
        days, obs, a = days[keep], obs[keep], a[keep]
        still = [i for i in range(len(cols)) if i < first or np.ptp(a[:, i]) > 0]  # an event may have lost its epochs
        told, a = [told[i - first] for i in still if i >= first], a[:, still]
        if len(days) <= len(cols) + 2:
            return out | {"n": len(days)}
    fixed = NOISE[model.noise]
    walk = {}
    if model.noise == "WN":
        got, k = (*_likelihood(a, obs, np.ones(len(days)), model.restricted), 0.0), 0.0
    elif model.noise == "RWFNWN":
        flicker, random = (_scaled(_shared_covariance(days, step, NOISE[n])) for n in ("FNWN", "RWWN"))
        share, got = _greatest(lambda g: _best_fraction(a, obs, (1 - g) * flicker + g * random, model.restricted), np.linspace(0, 1, 6), 1e-3)
        k, walk = None, {"walk": float(share)}
    else:
        covariance = _covariance if fixed is None else _shared_covariance
        of = lambda k: _best_fraction(a, obs, _scaled(covariance(days, step, k, DAMPING.get(model.noise, 0.0))), model.restricted)
        k, got = (fixed, of(fixed)) if fixed is not None else _greatest(of, np.linspace(-2, -0.05, 7), 1e-3)
    ll, x, q, s2, f = got
    parts = [(1 - walk["walk"], NOISE["FNWN"]), (walk["walk"], NOISE["RWWN"])] if walk else [(1.0, k)]
    driving = [(math.sqrt(s2 * f * share / _mean_variance(days, step, index, DAMPING.get(model.noise, 0.0))), index) for share, index in parts] if model.noise != "WN" else []
    walk["components"] = [(math.sqrt(s2 * (1 - f) if driving else s2), 0.0), *driving]
    effects = [(*e, float(x[i]), float(math.sqrt(s2 * q[i, i]))) for i, (e, _) in enumerate(told, first)]
    return {"rate": float(x[1]), "sigma": float(math.sqrt(s2 * q[1, 1])), "fraction": float(f), "kappa": None if k is None else float(k), "loglik": float(ll), "n": len(days), "effects": effects} | walk


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by their keys over as many tasks as the shuffle's, which aren't merged by bytes: series are small, their work isn't."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ml_trends(series: DataFrame, keys: list[str], model: TrendModel = TrendModel()) -> DataFrame:
    """Maximum-likelihood trend of every key; an ``error`` column instead of failures."""
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    names = ["rate", "sigma", "fraction", "kappa", "loglik", "error"]

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        try:
            row = ml_trend(g["t"], g["disp"], model) | {"error": None}
        except Exception as e:  # one series must not end the job
            row = dict.fromkeys(names) | {"error": str(e)}
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | row], columns=[*keys, *names]).astype({n: "float64" for n in names[:-1]})

    t = F.datediff("d", F.lit("2000-01-01").cast("date")).alias("t")
    return _dealt(series.select(*keys, t, "disp"), keys).groupBy(*keys).applyInPandas(one, f"{types}, rate double, sigma double, fraction double, kappa double, loglik double, error string")


#: Longest series, steps from first to last epoch at most, and matrix elements at once, that ``_many`` takes together.
SHORT, SHORT_STEPS, ELEMENTS = 128, 1024, 1 << 22


def _many(days: np.ndarray, obs: np.ndarray, model: TrendModel) -> dict[str, np.ndarray]:
    """``ml_trend`` of many series of one length with finite values, whose noise has a fixed index: rows of ``days`` and ``obs``.

    The steps of the search are those of ``_greatest``, for all series at once.
    """
    m, n = days.shape
    index = NOISE[model.noise]
    at = np.rint((days - days[:, :1]) / model.sampling_days).astype(int)
    every = np.arange(int(at.max()) + 1, dtype=float)
    c = _covariance(every, 1.0, index)[at[:, :, None], at[:, None, :]]
    c *= (n / np.trace(c, axis1=1, axis2=2))[:, None, None]
    t = (days - days.mean(axis=1, keepdims=True)) / 365.25
    cols = [t**k for k in range(model.poly_deg + 1)]
    for p in model.periods:
        cols += [np.cos(2 * np.pi * t / p), np.sin(2 * np.pi * t / p)]
    w, u = np.linalg.eigh(c)
    w, u = np.maximum(w, 0.0), np.swapaxes(u, 1, 2)
    a, y = u @ np.stack(cols, 2), (u @ obs[:, :, None])[:, :, 0]

    def fitted(f: np.ndarray) -> tuple[np.ndarray, ...]:
        d = (1 - f)[:, None] + f[:, None] * w
        root = np.sqrt(d)
        wa, wy = a / root[:, :, None], y / root
        left = np.swapaxes(wa, 1, 2)
        q = np.linalg.inv(left @ wa)
        x = q @ (left @ wy[:, :, None])
        r = wy - (wa @ x)[:, :, 0]
        s2 = (r * r).sum(axis=1) / n
        return -0.5 * (n * math.log(2 * math.pi) + np.log(d).sum(axis=1) + n * np.log(np.maximum(s2, 1e-300)) + n), x[:, :, 0], q, s2

    value = lambda f: fitted(f)[0]
    grid = np.linspace(0, 0.9999, 21)
    values = np.stack([value(np.full(m, g)) for g in grid])
    k = values.argmax(axis=0)
    best, found = grid[k], values[k, np.arange(m)]
    lo, hi = grid[np.maximum(0, k - 1)], grid[np.minimum(len(grid) - 1, k + 1)]
    r = (math.sqrt(5) - 1) / 2
    p, q = hi - r * (hi - lo), lo + r * (hi - lo)
    fp, fq = value(p), value(q)
    while True:
        for f, v in ((p, fp), (q, fq)):
            more = v > found
            best, found = np.where(more, f, best), np.where(more, v, found)
        on = hi - lo > 1e-5
        if not on.any():
            break
        down = on & (fp >= fq)
        up = on & ~down
        lo, hi = np.where(up, p, lo), np.where(down, q, hi)
        p, q, fp, fq = np.where(up, q, p), np.where(down, p, q), np.where(up, fq, fp), np.where(down, fp, fq)
        p, q = np.where(down, hi - r * (hi - lo), p), np.where(up, lo + r * (hi - lo), q)
        new = value(np.where(down, p, q))
        fp, fq = np.where(down, new, fp), np.where(up, new, fq)
    ll, x, cov, s2 = fitted(best)
    return {"rate": x[:, 1], "sigma": np.sqrt(s2 * cov[:, 1, 1]), "fraction": best, "kappa": np.full(m, float(index)), "loglik": ll}


def ml_trends_of_short(series: DataFrame, keys: list[str], model: TrendModel = TrendModel()) -> DataFrame:
    """As ``ml_trends``, for very many short series such as pixels: those of one length are solved together.

    A row holds a whole series.  Longer series, and noises whose index is sought, go one by one.
    """
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    names = ["rate", "sigma", "fraction", "kappa", "loglik"]
    together = NOISE[model.noise] is not None and model.noise != "WN" and not model.restricted and model.filter_iq is None and model.poly_deg > 0
    parameters = model.poly_deg + 1 + 2 * len(model.periods)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, obs = (batch.column(k) for k in (len(keys), len(keys) + 1))
            cuts = np.r_[0, np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))].astype(int)
            at, obs = (v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (at, obs))
            ok = np.isfinite(obs)
            sizes = np.array([int(ok[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], int)
            out, error = {k: np.full(batch.num_rows, np.nan) for k in names}, [None] * batch.num_rows

            def alone(i: int) -> None:
                try:
                    row = ml_trend(at[cuts[i] : cuts[i + 1]], obs[cuts[i] : cuts[i + 1]], model)
                    for k in names:
                        out[k][i] = np.nan if row[k] is None else row[k]
                except Exception as e:  # one series must not end the job
                    error[i] = str(e)

            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                if n <= parameters + 2 or n > SHORT or not together:
                    for i in rows.tolist() if n > parameters + 2 else ():
                        alone(i)
                    continue
                own = np.stack([np.flatnonzero(ok[cuts[i] : cuts[i + 1]]) + cuts[i] for i in rows])
                days, seen = at[own], obs[own]
                span = days[:, -1] - days[:, 0]
                easy = np.isfinite(days).all(axis=1) & (span / model.sampling_days < SHORT_STEPS)
                for i in rows[~easy].tolist():
                    alone(i)
                rows, days, seen = rows[easy], days[easy], seen[easy]
                size = max(1, ELEMENTS // (n * n))
                for k in range(0, len(rows), size):
                    part = slice(k, k + size)
                    try:
                        for name, v in _many(days[part], seen[part], model).items():
                            out[name][rows[part]] = v
                    except np.linalg.LinAlgError:  # one of them is singular
                        for i in rows[part].tolist():
                            alone(i)
            columns = [batch.column(k) for k in range(len(keys))] + [pa.array(out[k], from_pandas=True) for k in names] + [pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *names, "error"])

    t = F.datediff("d", F.lit("2000-01-01").cast("date"))
    whole = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(t.alias("t"), F.col("disp").cast("double").alias("disp")))).alias("_s"))
    return whole.select(*keys, F.col("_s.t").alias("_t"), F.col("_s.disp").alias("_disp")).mapInArrow(solved, f"{types}, rate double, sigma double, fraction double, kappa double, loglik double, error string")


def ml_trends_with_events(series: DataFrame, events: DataFrame, keys: list[str], model: TrendModel = TrendModel()) -> DataFrame:
    """As ``ml_trends``, with the events of each key and a row of their sizes.

    ``events``: the keys, kind (step, log, exp, tanh), d, tau (days; null for a
    step).  Repeated events count once, those without a day not at all; keys
    without a series are left out.  ``effects`` are in order of kind and day.
    """
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    names = ["rate", "sigma", "fraction", "kappa", "loglik", "n", "effects", "error"]
    schema = f"{types}, rate double, sigma double, fraction double, kappa double, loglik double, n long, effects array<struct<kind:string,t:double,tau:double,size:double,sigma:double>>, error string"

    def one(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if g.empty:
            return pd.DataFrame(columns=[*keys, *names])
        g = g.sort_values("t")
        e = e.drop_duplicates(["kind", "t", "tau"]).sort_values(["kind", "t", "tau"])
        own = [(r.kind, r.t, None if pd.isna(r.tau) else r.tau) for r in e.itertuples(index=False) if not pd.isna(r.t)]
        try:
            row = ml_trend(g["t"], g["disp"], model, events=own) | {"error": None}
            row["effects"] = [dict(zip(("kind", "t", "tau", "size", "sigma"), v, strict=True)) for v in row["effects"]]
        except Exception as x:  # one series must not end the job
            row = dict.fromkeys(names) | {"error": str(x)}
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | row], columns=[*keys, *names]).astype({n: "float64" for n in names[:5]} | {"n": "Int64"})

    t = F.datediff("d", F.lit("2000-01-01").cast("date"))
    left = _dealt(series.select(*keys, t.alias("t"), "disp"), keys).groupBy(*keys)
    right = _dealt(events.select(*keys, "kind", t.cast("double").alias("t"), F.col("tau").cast("double")), keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(one, schema)


def welch(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density with Hann windows of n/4 samples that overlap by n/8."""
    x = np.asarray(x, float)
    x = np.where(np.isfinite(x), x, 0.0)
    n = max(8, len(x) // 4)
    hop = max(1, n - max(1, len(x) // 8))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [np.abs(np.fft.rfft(w * (x[i : i + n] - x[i : i + n].mean()))) ** 2 for i in range(0, len(x) - n + 1, hop)]
    p = np.mean(parts, axis=0) / (fs * (w**2).sum())
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def model_spectrum(f: np.ndarray, sigma: float, index: float, fs: float, damping: float = 0.0) -> np.ndarray:
    """One-sided density of power-law noise that white noise of ``sigma`` drives; infinite at 0 for an index below 0."""
    with np.errstate(divide="ignore"):
        return 2 * sigma**2 / fs * np.abs(1 - (1 - damping) * np.exp(-2j * np.pi * np.asarray(f, float) / fs)) ** index


def spectra(series: DataFrame, keys: list[str], sampling_days: float = 1.0, model: TrendModel | None = None) -> DataFrame:
    """Frequency (cycles per year) and density of every key's series.

    With ``model``, also the density of the noise model fitted to the series, null
    at frequency 0 and where the fit failed.
    """
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    fs = 365.25 / sampling_days

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        f, p = welch(g["disp"].to_numpy(float), fs)
        columns = dict(zip(keys, key, strict=True)) | {"frequency": f, "density": p}
        if model is not None:
            parts = ml_trend(g["t"], g["disp"], model).get("components")
            total = sum(model_spectrum(f, s, k, fs, DAMPING.get(model.noise, 0.0) if k else 0.0) for s, k in parts) if parts else np.full(len(f), np.nan)
            columns["model"] = [float(v) if np.isfinite(v) else None for v in total]
        return pd.DataFrame(columns)

    t = F.datediff("d", F.lit("2000-01-01").cast("date")).alias("t")
    schema = f"{types}, frequency double, density double" + (", model double" if model is not None else "")
    return _dealt(series.select(*keys, t, "disp"), keys).groupBy(*keys).applyInPandas(one, schema)


def observation_lines(series: DataFrame, sampling_days: float = 1.0, offsets: list[float] = ()) -> DataFrame:
    """Text lines of one series: a header, then ``MJD value`` of each observation."""
    m = F.datediff("d", F.lit("1858-11-17").cast("date"))
    head = [f"# sampling period {sampling_days}", *(f"# offset {o}" for o in dict.fromkeys(round(o, 6) for o in offsets))]
    header = series.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "ord int, value string")
    body = series.where("disp is not null and not isnan(disp)").select(m.alias("ord"), F.format_string("%.1f %13.6f", m.cast("double"), F.col("disp")).alias("value"))
    return header.unionByName(body).orderBy("ord")
