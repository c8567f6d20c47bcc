"""Numeric kernels against direct loops, known answers and properties."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrain.functions import geodesy as G
from geostrain.functions import time as T
from geostrain.operators import collocation, geostatistics, graph, los, network, noise, plates, rasters, regression, robust, windows
from geostrain.sources import stations


def daily(years=6, rate=0.003, noise_mm=2.0, seed=0, step=None, gap=None):
    rng = np.random.default_rng(seed)
    t = np.arange(int(years * 365.25))
    y = rate * t / 365.25 + 0.004 * np.sin(2 * np.pi * t / 365.25) + rng.normal(0, noise_mm / 1000, len(t))
    if step is not None:
        y = y + np.where(t >= step, 0.02, 0.0)
    keep = np.ones(len(t), bool)
    if gap:
        keep[gap[0] : gap[1]] = False
    return t[keep].astype(float), y[keep]


def test_robust_rate_of_a_seasonal_series():
    t, y = daily()
    assert abs(robust.trend(t, y)["vel"] * 1000 - 3) < 0.2


def test_pairs_do_not_cross_a_step():
    t, y = daily(step=1100)
    for i, j in robust.select_pairs(t, [1100.0]):
        assert not t[i] < 1100 < t[j]  # the epoch of the step itself is of either side, by direction
    assert abs(robust.trend(t, y, [1100.0])["vel"] * 1000 - 3) < 0.3


def brute_pairs(t, tolerance=0.001):
    out = []
    for days in (t, t[::-1]):
        n, part = len(days), []
        for i in range(n - 1):
            g = np.abs(days - days[i]) / 365.25
            exact = [j for j in range(i + 1, n) if 1 - tolerance < g[j] < 1 + tolerance]
            later = [j for j in range(i + 1, n) if g[j] > 1 - tolerance]
            if exact:
                part += [(i, j) for j in exact]
            elif i != n - 2 and later:
                part.append((i, later[0]))
        part = np.sort(np.array(part).reshape(-1, 2), axis=0)
        out += [tuple(p) for p in (part if days is t else n - 1 - part[:, ::-1])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_a_direct_search(seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(1500, 180, replace=False)).astype(float)
    assert sorted(map(tuple, robust.select_pairs(t).tolist())) == brute_pairs(t)


def test_zero_scale_leaves_nothing():
    t = np.arange(1200.0)
    assert robust.trend(t, np.zeros(len(t)))["vel"] is None


def test_rate_scales_and_ignores_row_order():
    t, y = daily(seed=3)
    order = np.random.default_rng(1).permutation(len(t))
    a = robust.trend(t, y)["vel"]
    assert robust.trend(t[order], y[order])["vel"] == pytest.approx(a, rel=1e-12)
    assert robust.trend(t, 5 * y)["vel"] == pytest.approx(5 * a, rel=1e-9)


def test_relational_and_kernel_rates_agree(spark):
    t, y = daily(seed=5)
    days = pd.to_datetime("2001-01-01") + pd.to_timedelta(t, "D")
    df = spark.createDataFrame(pd.DataFrame({"site": 1, "d": days.date, "disp": y}))
    one = robust.pair_trend(df).first()
    assert one.vel_mm == pytest.approx(robust.robust_trend(df).first().vel * 1000, abs=0.05)


def test_series_edge_cases(spark):
    df = spark.createDataFrame([(1, "2001-01-01", 1.0), (1, "2001-01-02", None), (2, "2001-01-01", float("nan"))], "site long, d string, disp double").withColumn("d", F.col("d").cast("date"))
    assert [r.vel for r in robust.robust_trend(df).collect()] == [None]
    assert robust.pair_trend(df).count() == 0


def test_known_geodesics():
    # a published line of the WGS84 ellipsoid, and a quarter of the meridian
    d, a, _ = G.inverse_arrays(0.0, 0.0, 0.0, 90.0)
    assert d[0] == pytest.approx(10001965.729, abs=1e-2) and a[0] == pytest.approx(0, abs=1e-9)
    lon, lat = G.direct_arrays([10.0], [45.0], [60.0], [250_000.0])
    back = G.inverse_arrays(10.0, 45.0, lon, lat)
    assert back[0][0] == pytest.approx(250_000, abs=1e-4) and back[1][0] == pytest.approx(60, abs=1e-8)
    assert G.inverse_arrays(0, 0, 179.9, 0.1)[0][0] > 1.9e7


def test_local_plane_round_trip():
    rng = np.random.default_rng(0)
    lon, lat = -120 + rng.random(50) * 4, 33 + rng.random(50) * 4
    la = np.radians(lat)
    m0 = G.A * G._meridian(np.radians(35.0), np.sin)
    n = G.A / np.sqrt(1 - G.POLY_E**2 * np.sin(la) ** 2)
    e = np.radians(lon + 118) * np.sin(la)
    x, y = n / np.tan(la) * np.sin(e) / 1000, (G.A * G._meridian(la, np.sin) - m0 + n / np.tan(la) * (1 - np.cos(e))) / 1000
    back = G.from_local_arrays(x, y, -118.0, 35.0)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9


def test_weighted_least_squares_with_lost_rank():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 3))
    b, w = a @ [1.0, -2.0, 0.5] + rng.normal(0, 0.01, 30), rng.random(30) + 0.5
    got, other = regression.lscov(a, b, w), regression.normal_solve(a, b, w)
    assert np.allclose(got["x"], other["x"]) and np.allclose(got["stdx"], other["stdx"])
    twin = np.c_[a, a[:, 0]]
    assert regression.lscov(twin, b, w)["rank"] == 3


@pytest.mark.parametrize("order", [0, 1, 1.5, 2, 3])
def test_planes_are_recovered(spark, order):
    rng = np.random.default_rng(7)
    terms = regression.PLANE_TERMS[order]
    coef = rng.normal(size=len(terms))
    lon, lat = rng.random(200), rng.random(200)
    value = sum(c * lon**i * lat**j for c, (i, j) in zip(coef, terms, strict=True))
    pdf = pd.DataFrame({"k": 1, "lon": lon, "lat": lat, "value": value, "std": 0.1 + rng.random(200)})
    pdf.loc[::17, "value"] = np.nan
    df = spark.createDataFrame(pdf)
    got = regression.fit_plane(df, ["k"], order, "value", "std")
    assert np.allclose(got.first().x, coef, atol=1e-7)
    on = regression.plane_on(df, got, ["k"], order, "std").toPandas()
    assert np.allclose(on["plane"], sum(c * on["lon"] ** i * on["lat"] ** j for c, (i, j) in zip(coef, terms, strict=True)), atol=1e-7)


def _design(inc, azi):
    i, a = np.radians(inc), np.radians(azi)
    return np.array([np.sin(i) * np.cos(a), -np.sin(i) * np.sin(a), np.cos(i)])


@pytest.mark.parametrize("azimuths,prior", [((80, -80, 80, -80), None), ((80, -80, 80), (0.4, 0.0)), ((80, 80), (0.4, 0.3)), ((80,), None), ((80, 80), (0.0, 0.3)), ((80, 80), (0.4, 0.0))])
def test_decomposition_equals_least_squares(spark, azimuths, prior):
    rng = np.random.default_rng(11)
    rows = [(1, 1, k, float(rng.normal(5, 2)), 1 + k / 10, 30.0 + 3 * k, float(a)) for k, a in enumerate(azimuths)]
    df = spark.createDataFrame(rows, "y int, x int, track int, los double, std double, inc double, azi double")
    p = None if prior is None else spark.createDataFrame([(1, 1, prior[0], 0.2, prior[1], 0.3)], "y int, x int, ns double, ns_std double, ew double, ew_std double")
    got = los.decompose(df, p).first()
    ns, ew = prior or (0.0, 0.0)
    g = [_design(r[5], r[6]) for r in rows]
    two = any(v[1] < 0 for v in g) and any(v[1] > 0 for v in g)
    a, b, w = list(g), [r[3] for r in rows], [1 / r[4] ** 2 for r in rows]
    if ns:
        a, b, w = [*a, np.array([1.0, 0, 0])], [*b, ns], [*w, 1 / 0.04 if prior else 1.0]
    if not two and ew:
        a, b, w = [*a, np.array([0, 1.0, 0])], [*b, ew], [*w, 1 / 0.09]
    use = [0, 1, 2] if (two and (ns or ew)) or (not two and ns and ew) else [1, 2] if two or (not ns and ew) else [0, 2] if ns else [2]
    if len(b) < len(use):
        assert got.v is None
        return
    want = regression.lscov(np.array(a)[:, use], b, w)
    for name, k in (("n", 0), ("e", 1), ("v", 2)):
        assert (got[name] is None) == (k not in use)
        if k in use:
            assert got[name] == pytest.approx(want["x"][use.index(k)], abs=1e-6)
    assert got.n_geom == (2 if two else 1)


def test_interpolation_of_a_plane(spark):
    rng = np.random.default_rng(4)
    s = pd.DataFrame({"site": range(40), "lon": rng.random(40), "lat": rng.random(40)})
    s["v"] = 2 * s["lon"] - s["lat"] + 1
    t = spark.createDataFrame(pd.DataFrame({"lon": [0.5, 0.4, 9.0], "lat": [0.5, 0.6, 9.0]}))
    got = network.interpolate(spark.createDataFrame(s), t, ["v"]).toPandas()["v"]
    assert sorted(got.dropna()) == pytest.approx([1.2, 1.5]) and got.isna().sum() == 1


def test_rotation_is_recovered(spark):
    rng = np.random.default_rng(0)
    sites = spark.createDataFrame(pd.DataFrame({"lon": -120 + 20 * rng.random(50), "lat": 30 + 15 * rng.random(50), "se": 0.3, "sn": 0.4}))
    w = np.radians([0.0066, -0.1928, -0.0176]) * 1e-6
    ve, vn = plates.rigid_velocity(F.col("lon"), F.col("lat"), tuple(F.lit(float(x)) for x in w))
    got = plates.estimate_pole(sites.withColumns({"ve": ve, "vn": vn}))
    assert np.allclose(got["w"], w, rtol=1e-6) and got["rms"] < 1e-6 and got["dof"] == 97
    u = plates.pole_uncertainty(got["lon"], got["lat"], got["omega"], got["cov"])
    assert u["max"] >= u["min"] > 0
    assert len(stations.ITRF2014) == 11


def test_hull_vertices_are_exact(spark):
    """Every vertex is found, also where more than a direction's worth lie between two."""
    rng = np.random.default_rng(6)
    angle = np.r_[rng.random(250) * 2 * np.pi, rng.random(50) * 2 * np.pi]
    reach = np.r_[np.ones(250), np.sqrt(rng.random(50))]
    x, y = -118 + 3 * reach * np.cos(angle), 36 + 2 * reach * np.sin(angle)
    plate = np.arange(300) % 2
    got = plates.hull_vertices(spark.createDataFrame(pd.DataFrame({"plate_ix": plate, "lon": x, "lat": y})).repartition(5)).toPandas()
    for k in (0, 1):
        p = np.c_[x, y][plate == k]
        side = (p[None, :, None, 0] - p[:, None, None, 0]) * (p[None, None, :, 1] - p[:, None, None, 1]) - (p[None, :, None, 1] - p[:, None, None, 1]) * (p[None, None, :, 0] - p[:, None, None, 0])
        edge = (side >= 0).all(axis=2)  # all points are left of the line from a to b
        np.fill_diagonal(edge, False)
        want = {tuple(v) for v in p[edge.any(axis=1)]}
        own = got[got["plate_ix"] == k]
        assert len(want) >= 120 and len(own) == len(want) and set(zip(own["lon"], own["lat"], strict=True)) == want
    assert len(got) > 180


def test_plates_are_moved_apart(spark):
    """Eight plates of one block: no two end nearer than the distance, and a block that can't be parted is an error."""
    x, y = np.meshgrid(np.arange(12) / 2.0, np.arange(6) / 2.0)
    plate = (y // 1.5).astype(int) * 4 + (x // 1.5).astype(int)
    points = spark.createDataFrame(pd.DataFrame({"plate_ix": plate.ravel(), "lon": x.ravel(), "lat": y.ravel()})).coalesce(1)
    got = plates.separate_plates(points, 300.0, 1)
    assert not len(plates.near_plates(got, 300.0)) and got.count() == plate.size
    same = points.where("plate_ix < 2").unionByName(points.where("plate_ix = 0").withColumn("plate_ix", F.lit(2).cast("long")))
    with pytest.raises(RuntimeError):
        plates.separate_plates(same, 30000.0, 1, patience=2)


def test_points_in_a_polygon(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))))
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 3.0), (5.0, 1.0)], "lon double, lat double")
    assert [r[0] for r in df.select(plates.in_polygon(F.col("lon"), F.col("lat"), ring)).collect()] == [True, False, True, False]


def test_variogram_fit():
    d = np.linspace(1, 100, 40)
    y = geostatistics.variogram_array("spherical", d, 2.0, 0.5, 60.0)
    p = geostatistics.bounded_fit(lambda v: geostatistics.variogram_array("spherical", d, *v), np.array([y[-1], y[0], 50.0]), np.zeros(3), np.full(3, 100.0), y, np.ones(40))
    assert np.allclose(p, [2.0, 0.5, 60.0], rtol=1e-2)
    with pytest.raises(ValueError):
        geostatistics.variogram_model("none")


def test_collocation_splits_observations(spark):
    rng = np.random.default_rng(0)
    s = pd.DataFrame({"lon": -118 + rng.random(30), "lat": 34 + rng.random(30), "ew": rng.normal(size=30), "ns": rng.normal(size=30), "noise_ew": 0.2, "noise_ns": 0.2})
    df = spark.createDataFrame(s)
    args = ((4.0, 3.0, 1.0), (200.0, 150.0, 100.0))
    got = collocation.collocate_stations(df, *args).toPandas().merge(s, on=["lon", "lat"])
    assert np.allclose(got["s_ew"] + got["n_ew"], got["ew"]) and np.allclose(got["s_ns"] + got["n_ns"], got["ns"])
    grid = collocation.collocate(df, df.select("lon", "lat"), *args).toPandas().merge(got, on=["lon", "lat"])
    assert np.allclose(grid["s_ew_x"], grid["s_ew_y"], atol=1e-6)


def test_collocation_in_blocks_equals_the_dense_one(spark):
    rng = np.random.default_rng(3)
    n, args = 90, ((4.0, 3.0, 1.0), (200.0, 150.0, 100.0))
    s = pd.DataFrame({"lon": -118 + 5 * rng.random(n), "lat": 34 + 5 * rng.random(n), "ew": rng.normal(size=n), "ns": rng.normal(size=n), "noise_ew": 0.1 + rng.random(n), "noise_ns": 0.1 + rng.random(n)})
    s.loc[1, ["lon", "lat"]] = s.loc[0, ["lon", "lat"]]  # two stations at one place
    grid = pd.DataFrame({"lon": -118 + 5 * rng.random(40), "lat": 34 + 5 * rng.random(40)})
    grid = pd.concat([grid, grid[:3]])
    blank = pd.DataFrame({"lon": [-117.0], "lat": [np.nan], "ew": [1.0], "ns": [1.0], "noise_ew": [0.1], "noise_ns": [0.1]})
    stations, targets = spark.createDataFrame(s).unionByName(spark.createDataFrame(blank)), spark.createDataFrame(grid)
    got = collocation.collocate(stations, targets, *args, size=32).toPandas().sort_values(["lon", "lat"], ignore_index=True)
    dense = geostatistics.Collocation(s, *args)
    want = dense.at(grid["lon"].to_numpy(), grid["lat"].to_numpy()).sort_values(["lon", "lat"], ignore_index=True)
    assert len(got) == 43 and np.allclose(got, want, atol=1e-9)
    own = collocation.collocate_stations(stations, *args, size=32).toPandas().sort_values(["lon", "lat", "n_ew"], ignore_index=True)
    at = dense.at(s["lon"].to_numpy(), s["lat"].to_numpy()).assign(n_ew=lambda d: s["ew"] - d["s_ew"], n_ns=lambda d: s["ns"] - d["s_ns"]).sort_values(["lon", "lat", "n_ew"], ignore_index=True)
    assert len(own) == n and np.allclose(own, at[own.columns], atol=1e-9)
    none = collocation.collocate(stations.limit(0), targets, *args).toPandas()
    assert len(none) == 43 and (none["s_ew"] == 0).all() and np.allclose(none["e_ns"], 3**0.5)
    assert collocation.collocate(stations, targets.limit(0), *args).count() == 0


def test_collocation_in_many_strips_and_squares(spark):
    """Blocks travel to squares of the inverse, a few times however many targets there are."""
    rng = np.random.default_rng(4)
    n, args = 70, ((4.0, 3.0, 1.0), (200.0, 150.0, 100.0))
    s = pd.DataFrame({"lon": -118 + 5 * rng.random(n), "lat": 34 + 5 * rng.random(n), "ew": rng.normal(size=n), "ns": rng.normal(size=n), "noise_ew": 0.1 + rng.random(n), "noise_ns": 0.1 + rng.random(n)})
    grid = pd.DataFrame({"lon": -118 + 5 * rng.random(600), "lat": 34 + 5 * rng.random(600)})
    got = collocation.collocate(spark.createDataFrame(s), spark.createDataFrame(grid), *args, size=10, held_bytes=1 << 15)
    want = geostatistics.Collocation(s, *args).at(grid["lon"].to_numpy(), grid["lat"].to_numpy()).sort_values(["lon", "lat"], ignore_index=True)
    assert np.allclose(got.toPandas().sort_values(["lon", "lat"], ignore_index=True), want, atol=1e-9)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 25), (25, 21), (21, 40)], "a long, b long")
    assert {r.id: r.label for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 25: 20, 21: 20, 40: 20}


def test_windows():
    t = np.arange(0.0, 3000.0)
    a = windows.anchors(t, 3.0)
    assert a[0] == 0 and a[1] == 548 and all(t[-1] - x > 3 * 365 for x in a[1:])
    assert windows.window_sizes(10.0, 1) == [1.1, 2, 3, 4, 5, 6]
    rates = windows.window_rates(t, 0.001 * t / 365.25, 3.0, method="ols")
    assert all(r["vel"] == pytest.approx(0.001) for r in rates)


def test_smoothing_in_blocks_equals_the_whole(spark):
    rng = np.random.default_rng(0)
    image = rng.random((30, 41))
    y, x = np.mgrid[:30, :41]
    df = spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "value": image.ravel()}).astype({"y": "int32", "x": "int32"}))
    got = rasters.smooth_pixels(df, 1.5, block=8).toPandas()
    want = rasters.smooth(image, 1.5, 1.5)
    assert len(got) == image.size and np.allclose(want[got["y"], got["x"]], got["smooth"])


def test_likelihood_trend():
    t, y = daily(years=4, noise_mm=1.0)
    got = noise.ml_trend(t, y, noise.TrendModel(noise="WN"))
    assert got["rate"] * 1000 == pytest.approx(3, abs=0.3) and got["sigma"] > 0
    with pytest.raises(ValueError):
        noise.TrendModel(noise="XX")
    f, p = noise.welch(np.random.default_rng(0).normal(size=4000), 1.0)
    assert np.mean(p[1:]) == pytest.approx(2.0, rel=0.15) and len(f) == len(p)


def _dense(t, y, c):
    """Likelihood and rate of a trend under a covariance, in the plain way."""
    a, n = np.c_[np.ones(len(t)), (t - t.mean()) / 365.25], len(t)
    q = np.linalg.inv(a.T @ np.linalg.solve(c, a))
    x = q @ a.T @ np.linalg.solve(c, y)
    s2 = (y - a @ x) @ np.linalg.solve(c, y - a @ x) / n
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + n * np.log(s2) + n), x[1]


def test_restricted_likelihood_events_and_outliers():
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(900, 400, replace=False)).astype(float)
    later = np.maximum(t - 300, 0) / 50
    y = 0.01 * t + 8 * (t > 500) + 5 * np.log1p(later) + 6 * 0.5 * np.tanh((t - 700) / 30) + rng.normal(size=len(t))
    y[[20, 200]] += [60, -80]
    events = [("step", 500.0, None), ("log", 300.0, 50.0), ("tanh", 700.0, 30.0), ("step", 2000.0, None), ("exp", 899.0, 10.0)]
    model = noise.TrendModel(periods=(), noise="WN", restricted=True, filter_iq=3.0)
    got = noise.ml_trend(t, y, model, events=events)
    assert got["n"] == 398 and [e[0] for e in got["effects"]] == ["step", "log", "tanh"]
    for (_, _, _, size, sigma), true in zip(got["effects"], (8, 5, 6), strict=True):
        assert abs(size - true) < 5 * sigma
    # the restricted likelihood is that of contrasts free of the columns
    keep = np.ones(len(t), bool)
    keep[[20, 200]] = False
    a = np.stack([np.ones(398), (t[keep] - t.mean()) / 365.25, (t > 500)[keep], np.log1p(later)[keep], 0.5 * np.tanh((t[keep] - 700) / 30)], 1)
    free = np.linalg.svd(a)[0][:, 5:].T @ y[keep]
    n, s2 = len(free), (free @ free) / len(free)
    assert got["loglik"] == pytest.approx(-0.5 * (n * np.log(2 * np.pi) + n * np.log(s2) + n))
    c = 0.3 * np.eye(398) + 0.7 * np.cov(rng.normal(size=(398, 1500)))
    w, u = np.linalg.eigh(c)
    z = np.linalg.svd(a)[0][:, 5:]
    mine, fz = noise._likelihood(u.T @ a, u.T @ y[keep], w, True)[0], z.T @ c @ z
    s2 = z.T @ y[keep] @ np.linalg.solve(fz, z.T @ y[keep]) / n
    assert mine == pytest.approx(-0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(fz)[1] + n * np.log(s2) + n))
    with pytest.raises(ValueError):
        noise.ml_trend(t, y, model, events=[("ramp", 10.0, None)])


def test_trends_with_events_of_each_key(spark):
    t = np.arange(0.0, 400, 4)
    day = lambda v: (pd.Timestamp("2000-01-01") + pd.Timedelta(days=float(v))).date()
    rng = np.random.default_rng(2)
    rows = [(s, day(v), float(0.02 * v + (7.0 if s == 1 and v > 200 else 0.0) + 0.1 * rng.normal())) for s in (1, 2, 3) for v in t]
    series = spark.createDataFrame(rows, "site long, d date, disp double")
    events = [(1, "step", day(200), None), (1, "step", day(200), None), (2, "step", None, None), (3, "log", day(100), None), (9, "step", day(50), None)]
    found = noise.ml_trends_with_events(series, spark.createDataFrame(events, "site long, kind string, d date, tau double"), ["site"], noise.TrendModel(periods=(), noise="WN"))
    got = {r.site: r for r in found.collect()}
    assert sorted(got) == [1, 2, 3] and got[3].error and got[3].rate is None
    assert [e.kind for e in got[1].effects] == ["step"] and got[1].effects[0]["size"] == pytest.approx(7, abs=0.3)
    assert got[2].effects == [] and got[2].n == 100 and got[2].rate == pytest.approx(0.02 * 365.25, rel=0.05)
    empty = series.limit(0)
    assert noise.ml_trends_with_events(empty, spark.createDataFrame(events, "site long, kind string, d date, tau double"), ["site"]).count() == 0


def test_f_values(spark):
    for d1, d2 in ((2, 10), (2, 998), (3, 7), (40, 60)):
        x = np.array([0.0, 1e-6, 0.3, 1.0, 2.5, 40.0])
        got = regression.f_survival(x, d1, d2)
        if d1 == 2:
            assert np.allclose(got, (1 + 2 * x / d2) ** (-d2 / 2), rtol=1e-11, atol=1e-300)
            continue
        v = np.linspace(0, 1, 400_001)[1:-1] ** 3  # the integral itself, fine near 0
        dens = v ** (d2 / 2 - 1) * (1 - v) ** (d1 / 2 - 1)
        area = np.r_[0, np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(v))]
        assert np.allclose(got[1:], np.interp(d2 / (d2 + d1 * x[1:]), v, area / area[-1]), atol=2e-3)
    df = spark.createDataFrame([(1.0, 2.0, 0.1), (None, 2.0, 0.1), (3.0, 2.0, 1.0)], "res double, mse double, h double")
    out = [r.p_value for r in regression.cook_p_values(df.where("h < 1 or res is null"), 1).collect()]
    assert 0 < out[0] < 1 and out[1] is None


def test_likelihood_of_whole_series():
    """More than 400 epochs, with gaps: no grid of mixes of the whole covariance is likelier."""
    rng = np.random.default_rng(9)
    t = np.sort(rng.choice(1100, 520, replace=False)).astype(float)
    at = (t - t[0]).astype(int)
    coloured = np.convolve(rng.normal(size=at[-1] + 1), noise.power_law_filter(at[-1] + 1, -1.0))[at]
    y = 0.01 * t + coloured + 1.5 * rng.normal(size=len(t))
    c = {}
    for k in (-1.0, -2.0):
        h = noise.power_law_filter(at[-1] + 1, k)
        rows = np.stack([np.r_[h[: i + 1][::-1], np.zeros(at[-1] - i)] for i in at])
        c[k] = rows @ rows.T
        assert np.allclose(noise._covariance(t, 1.0, k), c[k])
        c[k] *= len(t) / np.trace(c[k])
    got = noise.ml_trend(t, y, noise.TrendModel(periods=()))
    ll, rate = _dense(t, y, (1 - got["fraction"]) * np.eye(len(t)) + got["fraction"] * c[-1.0])
    assert got["loglik"] == pytest.approx(ll) and got["rate"] == pytest.approx(rate)
    assert got["loglik"] >= max(_dense(t, y, (1 - f) * np.eye(len(t)) + f * c[-1.0])[0] for f in np.linspace(0, 0.98, 25)) - 1e-6


def test_two_coloured_components():
    rng = np.random.default_rng(12)
    n = 200
    t = np.arange(n, dtype=float)
    part = lambda k: np.convolve(rng.normal(size=n), noise.power_law_filter(n, k))[:n]
    y = 0.02 * t + 0.5 * part(-2.0) + part(-1.0) + 0.5 * rng.normal(size=n)
    got = noise.ml_trend(t, y, noise.TrendModel(periods=(), noise="RWFNWN"))
    assert got["kappa"] is None and 0 <= got["walk"] <= 1
    for one in ("FNWN", "RWWN"):  # each is a case of the mix
        assert got["loglik"] >= noise.ml_trend(t, y, noise.TrendModel(periods=(), noise=one))["loglik"] - 1e-6
    free = noise.ml_trend(t, y, noise.TrendModel(periods=(), noise="PLWN"))
    around = [noise._best_fraction(np.c_[np.ones(n), (t - t.mean()) / 365.25], y, noise._scaled(noise._covariance(t, 1.0, k)))[0] for k in np.linspace(-2, -0.05, 30)]
    assert free["loglik"] >= max(around) - 1e-3


def test_dates(spark):
    df = spark.createDataFrame([("15JAN01",), ("99DEC31",), ("68feb29",)], "t string")
    assert [str(r[0]) for r in df.select(T.parse_yymmmdd(F.col("t"))).collect()] == ["2015-01-01", "1999-12-31", "2068-02-29"]


def test_series_files(spark, tmp_path):
    jpl = " ".join(map(str, [2001.0, 0.1, 0.2, 0.3, 1, 1, 1, 0, 0, 0, 5.0, 2001, 1, 2, 12, 0, 0]))
    unr = "ABCD 01JAN02 2001.0027 51911 1095 2 -118.0 0 0.1 0 0.2 0 0.3 0 1 1 1 0 0 0 34.0 -118.0 10.0"
    (tmp_path / "WXYZ.series").write_text(jpl + "\n")
    (tmp_path / "ABCD.tenv3").write_text("site YYMMMDD yyyy\n" + unr + "\n")
    a = stations.read_series(spark, str(tmp_path / "WXYZ.series"), "jpl").first()
    b = stations.read_series(spark, str(tmp_path / "ABCD.tenv3"), "unr").first()
    assert (a.site, str(a.time), a.e) == ("WXYZ", "2001-01-02 12:00:00", 0.1)
    assert (b.site, str(b.d), b.east, b.MJD) == ("ABCD", "2001-01-02", 0.1, 51911)
    stations.save(spark.createDataFrame([(1, 2.0)], "k int, v double"), str(tmp_path / "t"), ["k"])
    assert stations.load(spark, str(tmp_path / "t")).count() == 1


def test_series_of_batches():
    """Series that end inside a batch, span several, or have null keys."""
    rng = np.random.default_rng(2)
    keys = np.repeat([np.nan, 1.0, 2.0, 3.0, 4.0], [3, 1, 40, 2, 9])
    df = pd.DataFrame({"site": keys, "t": np.arange(len(keys))})
    for _ in range(30):
        cuts = np.sort(rng.choice(len(df) + 1, 6))
        batches = [df.iloc[a:b] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(df)], strict=True)]
        got = [(k[0], g["t"].tolist()) for k, g in windows.series_of(iter(batches), ["site"])]
        want = [(k, g["t"].tolist()) for k, g in df.groupby("site", dropna=False, sort=False)]
        assert [(str(k), t) for k, t in got] == [(str(k), t) for k, t in want]
    assert list(windows.series_of(iter([df.iloc[:0]]), ["site"])) == []


def test_entry_without_corpus_package(tmp_path):
    """A copy of the repository without the corpus folders imports and answers."""
    root = Path(__file__).resolve().parent.parent
    for name in ("geostrain", "__spark_entry__.py"):
        source = root / name
        copy = shutil.copytree if source.is_dir() else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "fine", done.stderr


def test_entry_gives_rates(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["site", "vel_mm", "n_pairs", "mad_mm"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isfinite(entry.entry(spark).first().vel_mm)


def test_pairs_and_windows_against_loops():
    """Partners by ranges and rates by running sums, against direct loops over epochs."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 40, 300):
        days = np.sort(rng.choice(2600, n, replace=False)).astype(float)
        cuts = rng.choice(2600, 3).astype(float)
        years = days / robust.YEAR_DAYS
        for run in (years, years[::-1]):
            part, want = robust.segment_ids(run, cuts / robust.YEAR_DAYS), []
            along = np.abs(run - run[0]) if n else run
            for i in range(n - 1):
                exact = [j for j in range(i + 1, n) if 1 - 0.02 < along[j] - along[i] < 1 + 0.02 and part[j] == part[i]]
                later = [j for j in range(i + 1, n) if along[j] - along[i] > 1 - 0.02][:1]
                want += [(i, j) for j in exact] if exact else [(i, j) for j in later if part[j] == part[i] and i != n - 2]
            got = robust._one_direction(run, cuts / robust.YEAR_DAYS, 0.02)
            assert got.tolist() == np.sort(np.array(want, np.int64).reshape(-1, 2), axis=0).tolist()
        disp = rng.normal(size=n)
        disp[rng.random(n) < 0.1] = np.nan
        for years_ in (1.1, 3.0):
            got = windows.window_rates(days, disp, years_, method="ols")
            want = []
            for a in windows.anchors(days, years_):
                m = (days > a) & (days < a + int(365 * years_))
                t, y = days[m & np.isfinite(disp)] / 365.25, disp[m & np.isfinite(disp)]
                want += [(a, np.polyfit(t - t.mean(), y, 1)[0])] if len(np.unique(t)) > 1 and len(t) > 2 else []
            assert [w["anchor"] for w in got] == [a for a, _ in want]
            assert np.allclose([w["vel"] for w in got], [v for _, v in want], atol=1e-8)


def test_station_position_at_the_first_epoch(spark):
    rows = [(1, 2, -115.0, 9.0, 0.0, 9.0, 0.0), (1, 1, -115.0, 40000.0, 0.25, 3900000.0, -0.5), (2, 1, 10.0, -5000.0, 0.0, -4100000.0, 0.0), (3, 1, 10.0, None, 0.0, 1.0, 0.0)]
    got = {r.site: r for r in stations.station_positions(spark.createDataFrame(rows, "site int, d int, ref_lon double, e0 double, east double, n0 double, north double"), ["site"]).collect()}
    for site, lon, e, n in ((1, -115.0, 40000.25, 3899999.5), (2, 10.0, -5000.0, -4100000.0)):
        x, y = (float(v[0]) for v in G.direct_arrays(lon, 0.0, np.degrees(np.arctan2(e, n)), np.hypot(e, n))[:2])
        assert (got[site].lon, got[site].lat) == pytest.approx((x, y), abs=1e-7)
    assert got[1].d == 1 and got[3].lat is None


def test_covariance_that_series_share(monkeypatch):
    """Equal to each series' own to the last bit; one matrix of an index serves all series up to its length, longer series keep none."""
    made = []
    own = noise._covariance
    monkeypatch.setattr(noise, "_kept", {})
    monkeypatch.setattr(noise, "_covariance", lambda days, *a: made.append(len(days)) or own(days, *a))
    rng = np.random.default_rng(5)
    for n in (500, 520, 100, 499):
        days = np.sort(rng.choice(n, n // 4, replace=False)) * 2.0 + 7
        for index in (-1.0, -2.0):
            assert np.array_equal(noise._shared_covariance(days, 2.0, index), own(days, 2.0, index))
    assert len(made) == 2
    monkeypatch.setattr(noise, "KEPT_STEPS", 50)
    days = np.arange(0.0, 120, 3)
    assert np.array_equal(noise._shared_covariance(days, 1.0, -1.0), own(days, 1.0, -1.0)) and made[2:] == [40]


def test_series_are_dealt_over_tasks(spark):
    """A few hundred kilobytes of series are hours of work: adaptive execution doesn't merge their tasks."""
    df = spark.range(4000).selectExpr("id % 40 AS site", "date_add(date '2000-01-01', int(id div 40)) AS d", "double(id % 7) AS disp")
    plan = noise.ml_trends(df, ["site"])._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") <= 2
