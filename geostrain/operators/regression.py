"""Least squares: distributed normal equations and dense kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import PLANE_TERMS, plane_design, plane_value, plane_variance, time_design

# ------------------------------------------------------------ dense


def lscov(a, b, weights=None) -> dict:
    """Weighted least squares with rank reduction.

    Columns whose pivot in the triangular factor is under the tolerance are
    dropped (coefficient 0).  qxx isn't scaled by the mean square error.
    """
    a, b = np.asarray(a, float), np.asarray(b, float).ravel()
    w = np.ones(len(b)) if weights is None else np.asarray(weights, float).ravel()
    root = np.sqrt(w)
    wa, wb = a * root[:, None], b * root
    m, n = wa.shape
    chosen: list[int] = []
    rest, norms = wa.copy(), None
    tol = None
    for _ in range(min(m, n)):  # pivoting: the column with the most left is next
        norms = np.linalg.norm(rest, axis=0)
        norms[chosen] = -1
        j = int(np.argmax(norms))
        tol = norms[j] * max(m, n) * np.finfo(float).eps if tol is None else tol
        if norms[j] <= tol:
            break
        q = rest[:, j] / norms[j]
        rest = rest - np.outer(q, q @ rest)
        chosen.append(j)
    keep = sorted(chosen)
    x, qxx = np.zeros(n), np.zeros((n, n))
    if keep:
        sub = wa[:, keep]
        x[keep] = np.linalg.lstsq(sub, wb, rcond=None)[0]
        qxx[np.ix_(keep, keep)] = np.linalg.inv(sub.T @ sub)
    fitted = a @ x
    res = b - fitted
    dof = m - len(keep)
    mse = float((w * res * res).sum() / dof) if dof > 0 else 0.0
    return {"x": x, "qxx": qxx, "mse": mse, "stdx": np.sqrt(mse * np.diag(qxx)), "res": res, "fitted": fitted, "rank": len(keep), "dof": dof}


def normal_solve(a, b, weights=None) -> dict:
    """Cholesky solution of the normal equations; the pseudo-inverse if they are singular."""
    a, b = np.asarray(a, float), np.asarray(b, float).ravel()
    w = np.ones(len(b)) if weights is None else np.asarray(weights, float).ravel()
    n, r = (a * w[:, None]).T @ a, (a * w[:, None]).T @ b
    try:
        low = np.linalg.cholesky(n)
        inv = np.linalg.inv(low)
        q = inv.T @ inv
    except np.linalg.LinAlgError:
        q = np.linalg.pinv(n)
    x = q @ r
    e = b - a @ x
    dof = len(b) - len(x)
    s0 = float(np.sqrt((w * e * e).sum() / dof)) if dof > 0 else 0.0
    return {"x": x, "stdx": s0 * np.sqrt(np.diag(q)), "s0": s0, "qxx": q, "e": e}


# ------------------------------------------------------------ distributed


def normal_sums(df: DataFrame, keys: list[str], design: list[Column], observed: Column, weight: Column | None = None) -> DataFrame:
    """Sums of the normal equations of every key, in one aggregate.

    Columns: n, yy, r0.., and n0_0.. for the upper triangle.  They are sums, so
    each task sends one row a key.
    """
    p, w = len(design), F.lit(1.0) if weight is None else weight
    names = [f"_a{i}" for i in range(p)]
    rows = df.withColumns({n: c for n, c in zip(names, design, strict=True)} | {"_y": observed, "_w": w}).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    a = [F.col(n) for n in names]
    sums = [F.count("*").alias("n"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("yy")]
    sums += [F.sum(F.col("_w") * a[i] * F.col("_y")).alias(f"r{i}") for i in range(p)]
    sums += [F.sum(F.col("_w") * a[i] * a[j]).alias(f"n{i}_{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy(*keys).agg(*sums)


def solved(sums: DataFrame, keys: list[str], p: int) -> DataFrame:
    """x, std, mse and n of each key, from its sums; 0 deviations if singular."""
    types = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join(filter(None, [types, "n long, x array<double>, std array<double>, mse double, q array<double>"]))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        n[i, j] = n[j, i] = row[f"n{i}_{j}"]
                r = np.array([row[f"r{i}"] for i in range(p)])
                scale = np.sqrt(np.maximum(np.diag(n), 1e-300))
                unit = n / np.outer(scale, scale)
                singular = np.linalg.matrix_rank(unit, tol=1e-12) < p
                q = (np.linalg.pinv(unit, rcond=1e-12) if singular else np.linalg.inv(unit)) / np.outer(scale, scale)
                x = q @ r
                dof = row["n"] - p
                ss = max(0.0, row["yy"] - float(x @ r))
                mse = ss / dof if dof > 0 else 0.0
                std = np.zeros(p) if singular or dof <= 0 else np.sqrt(mse * np.maximum(np.diag(q), 0))
                out.append({**{k: row[k] for k in keys}, "n": row["n"], "x": x.tolist(), "std": std.tolist(), "mse": mse, "q": q.ravel().tolist()})
            yield pd.DataFrame(out, columns=[*keys, "n", "x", "std", "mse", "q"])

    return sums.mapInPandas(solve, schema)


def fit_function(series: DataFrame, keys: list[str], poly_deg: int = 1, periods: list[float] = (), steps: list[str] = (), scale: float = 1000.0) -> DataFrame:
    """Least-squares time function of every key, coefficients in mm with ``scale`` 1000.

    Time is in years since 2000-01-01, centred terms keep the sums well
    conditioned; the rate does not depend on the origin.
    """
    t = F.datediff("d", F.lit("2000-01-01").cast("date")) / 365.25
    cuts = [F.datediff(F.lit(s).cast("date"), F.lit("2000-01-01").cast("date")) / 365.25 for s in steps]
    design = list(time_design(t, poly_deg, list(periods), cuts).values())
    found = solved(normal_sums(series, keys, design, F.col("disp")), keys, len(design))
    return found.select(*keys, "n", F.transform("x", lambda v: v * scale).alias("x"), F.transform("std", lambda v: v * scale).alias("std"))


def linear_rate(series: DataFrame, keys: list[str]) -> DataFrame:
    """Degree 1 by the built-in aggregates."""
    t = F.datediff("d", F.lit("2000-01-01").cast("date")) / 365.25
    return series.groupBy(*keys).agg(F.regr_slope("disp", t).alias("rate"), F.regr_intercept("disp", t).alias("level"), F.regr_count("disp", t).alias("n"))


def fit_plane(pixels: DataFrame, keys: list[str], order: float, value: str = "value", std: str | None = None, extra_weight: Column | None = None) -> DataFrame:
    """Weighted polynomial surface of every key: x, std, q of the terms of ``PLANE_TERMS``."""
    weight = F.lit(1.0) if std is None else 1 / (F.col(std) * F.col(std))
    if extra_weight is not None:
        weight = weight * extra_weight
    design = plane_design(F.col("lon"), F.col("lat"), order)
    return solved(normal_sums(pixels, keys, design, F.col(value), weight), keys, len(design))


def plane_on(pixels: DataFrame, planes: DataFrame, keys: list[str], order: float, std: str | None = None) -> DataFrame:
    """The plane at each pixel and its deviation, combined with the data's."""
    p = len(PLANE_TERMS[order])
    rows = pixels.join(planes.select(*keys, F.col("x").alias("_x"), F.col("q").alias("_q"), "mse"), keys) if keys else pixels.crossJoin(F.broadcast(planes.select(F.col("x").alias("_x"), F.col("q").alias("_q"), "mse")))
    coefficients = [F.col("_x")[i] for i in range(p)]
    q = [[F.col("_q")[i * p + j] for j in range(p)] for i in range(p)]
    variance = F.greatest(F.lit(0.0), plane_variance(F.col("lon"), F.col("lat"), q, order))
    total = variance if std is None else variance + F.col(std) * F.col(std)
    return rows.withColumns({"plane": plane_value(F.col("lon"), F.col("lat"), coefficients, order), "plane_std": F.sqrt(total)}).drop("_x", "_q", "mse")


def incomplete_beta(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
    return np.where(swap, 1 - front * h, front * h)


def f_survival(x: np.ndarray, d1: float, d2: float) -> np.ndarray:
    """Probability that an F value of d1 and d2 degrees of freedom is above x."""
    x = np.maximum(np.asarray(x, float), 0.0)
    return incomplete_beta(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def residual_diagnostics(rows: DataFrame, n_parameters: int) -> DataFrame:
    """Studentised residuals, Cook's distance and residual variance; rows have res, mse, h."""
    stud = F.col("res") / F.sqrt(F.col("mse") * (1 - F.col("h")))
    return rows.withColumns({"studentised": stud, "cook": stud * stud / n_parameters * F.col("h") / (1 - F.col("h")), "res_var": F.col("mse") * (1 - F.col("h"))})


def core_weight(y: Column, x: Column, box: list[int], pad: int) -> Column:
    """Epanechnikov weight of the mean distance to the core's four centre pixels; 1 in the core."""
    y0, y1, x0, x1 = box
    cy, cx = (y0 + y1 - 1) / 2, (x0 + x1 - 1) / 2
    corners = [(np.floor(cy), np.floor(cx)), (np.floor(cy), np.ceil(cx)), (np.ceil(cy), np.floor(cx)), (np.ceil(cy), np.ceil(cx))]
    dist = sum((F.sqrt((y - float(a)) ** 2 + (x - float(b)) ** 2) for a, b in corners), F.lit(0.0)) / 4
    reach = float(np.hypot(y1 - y0, x1 - x0) / 2 + pad)
    core = y.between(y0, y1 - 1) & x.between(x0, x1 - 1)
    return F.when(core, 1.0).otherwise(F.greatest(F.lit(0.0), 0.75 * (1 - (dist / reach) ** 2)))


def is_symmetric(a: np.ndarray, tolerance: float = 1e-8) -> bool:
    return bool(np.allclose(a, np.asarray(a).T, atol=tolerance))


def is_positive_definite(a: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(np.asarray(a, float))
    except np.linalg.LinAlgError:
        return False
    return True


def cook_p_values(rows: DataFrame, n_parameters: int) -> DataFrame:
    """``residual_diagnostics`` with ``p_value``: that of Cook's distance as an F value of parameters and free rows.

    It is null where the distance is (leverage 1) or no row is free.
    """
    free = rows.count() - n_parameters
    out = residual_diagnostics(rows, n_parameters)
    if free <= 0:
        return out.withColumn("p_value", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def p_value(cook: pd.Series) -> pd.Series:
        known = cook.notna().to_numpy()
        value = np.full(len(cook), np.nan)
        value[known] = f_survival(cook.to_numpy(float)[known], n_parameters, free)
        return pd.Series(value).astype(object).where(known, None)

    return out.withColumn("p_value", p_value("cook"))
