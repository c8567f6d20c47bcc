"""Plate rotation: poles from velocities, their uncertainty, moving plates apart."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import inverse_arrays, direct_arrays, local_frame


def estimate_pole(sites: DataFrame) -> dict:
    """Rotation vector (rad/yr), pole, covariance and fit statistics of station velocities.

    ``sites``: lon, lat, ve, vn, se, sn (mm/yr).  Each site's 2 x 2 weight is
    the inverse of [[se^2, c], [c, sn^2]] with c = se sn sqrt(se^2 + sn^2); where
    that isn't positive definite the site's correlation is left out.  Nine sums
    come to the driver.
    """
    rows = local_frame(F.col("lon"), F.col("lat"))
    e2, n2 = F.col("se") ** 2, F.col("sn") ** 2
    c = F.col("se") * F.col("sn") * F.sqrt(e2 + n2)
    c = F.when(e2 * n2 - c * c > 0, c).otherwise(0.0)
    df = sites.withColumns({f"_e{j}": rows[0][j] for j in range(3)} | {f"_n{j}": rows[1][j] for j in range(3)} | {"_c": c})
    det = e2 * n2 - F.col("_c") * F.col("_c")
    df = df.withColumns({"_w11": n2 / det, "_w22": e2 / det, "_w12": -F.col("_c") / det})

    def product(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        return F.col("_w11") * a[0] * b[0] + F.col("_w22") * a[1] * b[1] + F.col("_w12") * (a[0] * b[1] + a[1] * b[0])

    d = [(F.col(f"_e{j}"), F.col(f"_n{j}")) for j in range(3)]
    y = (F.col("ve"), F.col("vn"))
    sums = df.agg(F.count("*").alias("n"), *(F.sum(product(d[i], d[j])).alias(f"n{i}{j}") for i in range(3) for j in range(i, 3)), *(F.sum(product(d[i], y)).alias(f"r{i}") for i in range(3))).first()
    n = np.array([[sums[f"n{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    q = np.linalg.inv(n)
    w = q @ np.array([sums[f"r{i}"] for i in range(3)])
    re = F.col("ve") - sum((F.col(f"_e{j}") * float(w[j]) for j in range(3)), F.lit(0.0))
    rn = F.col("vn") - sum((F.col(f"_n{j}") * float(w[j]) for j in range(3)), F.lit(0.0))
    res = df.withColumns({"re": re, "rn": rn})
    r = (F.col("re"), F.col("rn"))
    stats = res.agg(F.sum(product(r, r)).alias("chi2"), F.sum(F.col("re") ** 2 + F.col("rn") ** 2).alias("ss"), F.sum(F.col("re") ** 2 / F.col("se") ** 2 + F.col("rn") ** 2 / F.col("sn") ** 2).alias("ws"), F.sum(1 / F.col("se") ** 2 + 1 / F.col("sn") ** 2).alias("w")).first()
    rate = w * 1e-6
    lon, lat, omega = vector_to_pole(*rate)
    dof = 2 * sums["n"] - 3
    return {"w": rate, "cov": q * 1e-12, "lon": lon, "lat": lat, "omega": omega, "rms": math.sqrt(stats["ss"] / 2 / sums["n"]), "wrms": math.sqrt(stats["ws"] / stats["w"]), "chi2": stats["chi2"], "dof": dof, "reduced_chi": math.sqrt(stats["chi2"] / dof) if dof > 0 else None}


def vector_to_pole(wx: float, wy: float, wz: float) -> tuple[float, float, float]:
    w = math.sqrt(wx * wx + wy * wy + wz * wz)
    return math.degrees(math.atan2(wy, wx)), 90.0 - math.degrees(math.acos(wz / w)), math.degrees(w) * 1e6


def pole_uncertainty(lon: float, lat: float, omega: float, cov: np.ndarray, compat: bool = False) -> dict:
    """Axes (degrees) and azimuth of the pole's error ellipse, deviation of the rate.

    ``compat`` takes the difference of variances in the minor axis and twice the
    arc tangent in the azimuth, as an older formula does.
    """
    lo, la = math.radians(lon), math.radians(lat)
    r = np.array([[-math.sin(lo), math.cos(lo), 0], [-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)], [math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]])
    nw = math.radians(omega) * 1e-6
    s = r @ np.asarray(cov) @ r.T
    a, b, c = s[0, 0], s[0, 1], s[1, 1]
    root = math.hypot(a - c, 2 * b)
    axis = lambda v: math.degrees(math.atan(math.sqrt(max(0.0, v)) / nw))
    if compat:
        return {"max": axis(0.5 * (a + c + root)), "min": axis(0.5 * (a - c + root)), "azimuth": math.degrees(2 * math.atan(2 * b / (a - c))), "s_omega": math.degrees(math.sqrt(s[2, 2])) * 1e6}
    return {"max": axis(0.5 * (a + c + root)), "min": axis(0.5 * (a + c - root)), "azimuth": math.degrees(0.5 * math.atan2(2 * b, a - c)), "s_omega": math.degrees(math.sqrt(s[2, 2])) * 1e6}


def rigid_velocity(lon: Column, lat: Column, w: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """East and north velocity (mm/yr) of a rotation vector in rad/yr."""
    rows = local_frame(lon, lat)
    return tuple(sum((rows[k][j] * w[j] * 1e6 for j in range(3)), F.lit(0.0)) for k in range(2))


# ------------------------------------------------------------ polygons


def in_polygon(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over a ring, an array of struct(lon, lat); open or closed."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return spans & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def on_plates(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points with the plate whose polygon they lie in.

    The plates of the Earth are some dozens of polygons, so they are broadcast.
    """
    return points.join(F.broadcast(polygons), in_polygon(F.col("lon"), F.col("lat"), F.col("ring"))).drop("ring")


def central_plate(points: DataFrame) -> DataFrame:
    """The plate whose centroid is nearest to the centroid of all points."""
    each = points.groupBy("plate_ix").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    whole = points.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    from ..functions.geodesy import haversine

    d = each.crossJoin(F.broadcast(whole)).withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")))  # one row
    return d.agg(F.min_by("plate_ix", F.struct("d", "plate_ix")).alias("plate_ix"))


def hull(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise."""
    p = np.c_[lon, lat]
    order = sorted(range(len(p)), key=lambda i: (p[i, 0], p[i, 1]))
    if len(order) < 3:
        return np.array(order)
    turn = lambda o, a, b: (p[a, 0] - p[o, 0]) * (p[b, 1] - p[o, 1]) - (p[a, 1] - p[o, 1]) * (p[b, 0] - p[o, 0])
    half = []
    for seq in (order, order[::-1]):
        part: list[int] = []
        for i in seq:
            while len(part) > 1 and turn(part[-2], part[-1], i) <= 0:
                part.pop()
            part.append(i)
        half += part[:-1]
    return np.array(half)


def hull_vertices(points: DataFrame) -> DataFrame:
    """Exact hull vertices of each plate.

    Each batch gives the hulls of its own points, which hold every vertex of the
    whole; these few meet by plate.
    """
    schema = points.select("plate_ix", F.col("lon").cast("double"), F.col("lat").cast("double")).schema

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["lon", "lat"])
        return pdf.iloc[hull(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())]

    def of_batches(batches):
        for pdf in batches:
            for _, own in pdf.groupby("plate_ix"):
                yield corners(own)

    known = points.select(*(F.col(f.name).cast(f.dataType) for f in schema)).where("plate_ix is not null and not isnan(lon) and not isnan(lat)")  # a null is no point either
    return known.mapInPandas(of_batches, schema).groupBy("plate_ix").applyInPandas(corners, schema)


def near_plates(points: DataFrame, dist_km: float) -> pd.DataFrame:
    """Pairs of plates whose hulls come closer than a distance, and the shift they need (km)."""
    v = hull_vertices(points).toPandas()
    out = []
    names = sorted(v["plate_ix"].unique())
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            p, q = v[v["plate_ix"] == a], v[v["plate_ix"] == b]
            ia, ib = np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p))
            d = inverse_arrays(p["lon"].to_numpy()[ia], p["lat"].to_numpy()[ia], q["lon"].to_numpy()[ib], q["lat"].to_numpy()[ib])[0] / 1000
            close = d[d < dist_km]
            if len(close):
                out.append({"ix1": a, "ix2": b, "shift": float((dist_km - close).max() + 1)})
    return pd.DataFrame(out, columns=["ix1", "ix2", "shift"])


def _azimuth(points: DataFrame, ix1: int, ix2: int) -> float:
    """Azimuth from the centroid of one plate to that of another."""
    c = {r["plate_ix"]: r for r in points.where(F.col("plate_ix").isin(ix1, ix2)).groupBy("plate_ix").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).collect()}
    return float(inverse_arrays(c[ix1]["lon"], c[ix1]["lat"], c[ix2]["lon"], c[ix2]["lat"])[1][0])


def _moved(points: DataFrame, moves: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """Points with plates moved by (azimuth, km), one move after another, in one pass."""

    @F.pandas_udf("lon double, lat double")
    def moved(plate: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
        x, y = lon.to_numpy(float).copy(), lat.to_numpy(float).copy()
        for ix, own in moves.items():
            hit = (plate == ix).to_numpy()
            for azimuth, dist_km in own if hit.any() else ():
                x[hit], y[hit] = direct_arrays(x[hit], y[hit], np.full(hit.sum(), azimuth), np.full(hit.sum(), dist_km * 1000))
        return pd.DataFrame({"lon": x, "lat": y})

    m = moved(F.col("plate_ix"), F.col("lon"), F.col("lat"))
    hit = F.col("plate_ix").isin(list(moves))
    return points.withColumn("_m", m).withColumns({k: F.when(hit, F.col(f"_m.{k}")).otherwise(F.col(k)) for k in ("lon", "lat")}).drop("_m")


def shift_plate(points: DataFrame, ix1: int, ix2: int, dist_km: float) -> DataFrame:
    """Points with plate ``ix2`` moved away from ``ix1`` along their centroids' azimuth."""
    return _moved(points, {ix2: [(_azimuth(points, ix1, ix2), dist_km)]})


def separate_plates(points: DataFrame, dist_km: float, central: int, patience: int = 20) -> DataFrame:
    """Shift plates away from the central one, then from each other, until no two are nearer than a distance.

    Each round shifts every pair that was close at its start, by whole kilometres
    as published.  If the sum of the shifts hasn't become less for ``patience``
    rounds, that is an error: unfinished positions are never returned.
    """
    moves: dict[int, list[tuple[float, float]]] = {}

    def shift(fixed: int, ix: int, km: float) -> None:
        azimuth = _azimuth(_moved(points, moves), fixed, ix)
        moves.setdefault(ix, []).append((azimuth, km))

    for ix in [r["plate_ix"] for r in points.select("plate_ix").distinct().where("plate_ix is not null").orderBy("plate_ix").collect()]:
        if ix != central:
            shift(central, ix, dist_km)
    least, idle = math.inf, 0
    while len(close := near_plates(_moved(points, moves), dist_km)):
        total = float(close["shift"].sum())
        least, idle = (total, 0) if total < least - 1e-3 else (least, idle + 1)
        if idle >= patience:
            raise RuntimeError(f"plates don't come {dist_km} km apart: {close.to_dict('records')}")
        for ix1, ix2, km in close.itertuples(index=False, name=None):
            fixed, ix = (ix2, ix1) if ix2 == central else (ix1, ix2)
            shift(int(fixed), int(ix), float(np.rint(km)))
    return _moved(points, moves)
