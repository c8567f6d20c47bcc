"""Overlap planes and joint referencing against a direct least-squares solution; smoothing, spectra."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrain.operators import network, noise, tracks, windows

SCHEMA = "y int, x int, track int, lon double, lat double, value double, std double"


def scene(noisy=0.0, seed=1):
    """Three tracks of one surface in a chain of overlaps, each with a plane of its own."""
    rng = np.random.default_rng(seed)
    planes = {1: (1.0, 0.3, -0.2), 2: (-2.0, 0.1, 0.4), 3: (0.5, -0.6, 0.1)}
    rows = []
    for t, columns in ((1, range(0, 14)), (2, range(8, 26)), (3, range(20, 34))):
        a, b, c = planes[t]
        for y in range(8):
            for x in columns:
                lon, lat = x / 10, y / 10
                truth = math.sin(lon) + math.cos(3 * lat)
                rows.append((y, x, t, lon, lat, truth - a - b * lon - c * lat + noisy * rng.normal(), 1 + 0.1 * t))
    return rows, planes


def direct(rows, order):
    terms = (lambda lon, lat: [1.0]) if order == 0 else (lambda lon, lat: [1.0, lon, lat])
    p = len(terms(0, 0))
    at = {}
    for r in rows:
        at.setdefault((r[0], r[1]), []).append(r)
    a, b, w = [], [], []
    for group in at.values():
        for i in group:
            for j in group:
                if i[2] < j[2]:
                    row = np.zeros(3 * p)
                    row[(i[2] - 1) * p : i[2] * p] = terms(i[3], i[4])
                    row[(j[2] - 1) * p : j[2] * p] = np.negative(terms(i[3], i[4]))
                    a.append(row)
                    b.append(j[5] - i[5])
                    w.append(1 / (i[6] ** 2 + j[6] ** 2))
    root = np.sqrt(w)
    zero = 1e6 * np.tile(np.eye(p), 3)  # planes of mean 0
    return np.linalg.lstsq(np.vstack([np.array(a) * root[:, None], zero]), np.r_[np.array(b) * root, np.zeros(p)], rcond=None)[0].reshape(3, p)


@pytest.mark.parametrize("order", [0, 1])
def test_overlap_planes_are_the_direct_solution(spark, order):
    rows, _ = scene(0.2)
    got = {r["track"]: r for r in tracks.overlap_planes(spark.createDataFrame(rows, SCHEMA), order).collect()}
    want = direct(rows, order)
    for t in (1, 2, 3):
        assert sorted(got[t]["x"]) == pytest.approx(sorted(want[t - 1]), abs=1e-6)
    assert got[2]["n"] == got[1]["n"] + got[3]["n"]


def test_levelled_tracks_agree(spark):
    rows, _ = scene()
    got = tracks.level_tracks(spark.createDataFrame(rows, SCHEMA), 1)
    worst = got.groupBy("y", "x").agg((F.max("value") - F.min("value")).alias("gap")).agg(F.max("gap")).first()[0]
    assert worst < 1e-8


def test_track_without_overlap_keeps_its_values(spark):
    rows, _ = scene()
    rows += [(50, 50, 9, 5.0, 5.0, 3.5, 1.0)]
    got = tracks.level_tracks(spark.createDataFrame(rows, SCHEMA), 1).where("track = 9").first()
    assert got["value"] == 3.5 and got["std"] == 1.0
    assert tracks.overlap_planes(spark.createDataFrame([], SCHEMA), 1).count() == 0


def test_mosaic_leaves_out_missing_values(spark):
    got = tracks.mosaic(spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 2.0, 1.0), (0, 0, 2, 0.0, 0.0, 5.0, 2.0), (0, 0, 3, 0.0, 0.0, None, 1.0)], SCHEMA)).first()
    assert got["n"] == 2 and got["mosaic"] == pytest.approx((2 + 5 / 4) / 1.25) and got["mosaic_std"] == pytest.approx(math.sqrt(1 / 1.25))


def test_referencing_recovers_the_plane(spark):
    rows, _ = scene()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("value", "los").withColumns({"gnss_std": F.lit(0.1), "gnss_los": F.when((F.col("x") + F.col("y")) % 5 == 0, F.col("los") + 2 + 0.5 * F.col("lon") - 0.25 * F.col("lat"))})
    got = tracks.reference_tracks(df, 1).agg(F.max(F.abs(F.col("corrected") - F.col("los") - 2 - 0.5 * F.col("lon") + 0.25 * F.col("lat")))).first()[0]
    assert got < 1e-8
    assert tracks.reference_tracks(df.withColumn("gnss_los", F.lit(None).cast("double")), 1).count() == 0


def test_smoothing_changes_filled_pixels_alone(spark):
    image = {(y, x): float(1 + (3 * y + 5 * x) % 7) for y in range(9) for x in range(9)}
    holes = {(2, 2), (2, 3), (5, 6), (8, 8)}
    df = spark.createDataFrame([(y, x, 0.0 if (y, x) in holes else v) for (y, x), v in image.items()], "y int, x int, value double")
    plain = {(r["y"], r["x"]): r["value"] for r in network.fill_by_distance(df, 3).collect()}
    want = dict(plain)
    for _ in range(2):
        want = {k: np.mean([want[k[0] + i, k[1] + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (k[0] + i, k[1] + j) in want]) if k in holes else v for k, v in want.items()}
    got = {(r["y"], r["x"]): r["value"] for r in network.fill_by_distance(df, 3, smoothing=2).collect()}
    assert got == pytest.approx(want)


def test_components_make_the_series_variance():
    rng = np.random.default_rng(5)
    n = 500
    y = 2.0 * rng.normal(size=n) + np.convolve(1.5 * rng.normal(size=n), noise.power_law_filter(n, -1.0))[:n]
    got = noise.ml_trend(np.arange(n), y, noise.TrendModel(periods=()))
    (white, zero), (flicker, index) = got["components"]
    assert (zero, index) == (0.0, -1.0)
    assert white == pytest.approx(2.0, rel=0.25) and flicker == pytest.approx(1.5, rel=0.4)


def test_model_spectrum_of_white_noise_is_flat_and_matches_the_estimate():
    rng = np.random.default_rng(6)
    f, p = noise.welch(rng.normal(0, 3.0, 4000), 365.25)
    m = noise.model_spectrum(f, 3.0, 0.0, 365.25)
    assert np.ptp(m) < 1e-12 and np.mean(p[1:-1]) == pytest.approx(m[0], rel=0.1)


def test_model_beside_the_spectrum(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame({"site": 1, "k": range(400), "disp": rng.normal(0, 1, 400)})).select("site", F.date_add(F.lit("2010-01-01").cast("date"), F.col("k").cast("int")).alias("d"), "disp")
    got = noise.spectra(df, ["site"], model=noise.TrendModel(periods=())).orderBy("frequency").collect()
    assert got[0]["model"] is None and all(r["model"] > 0 for r in got[1:])
    high = [r for r in got if r["frequency"] > 60]
    assert np.mean([r["density"] for r in high]) == pytest.approx(np.mean([r["model"] for r in high]), rel=0.35)
