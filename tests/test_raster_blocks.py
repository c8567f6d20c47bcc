"""Raster operators in blocks against the whole raster in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrain.operators import rasters, windows


@pytest.mark.parametrize("h,w,block,angle", [(30, 41, 100, 0.0), (17, 24, 1 << 20, 0.0), (26, 19, 60, 30.0), (1, 9, 4, 0.0)])
def test_lowpass_in_blocks_equals_the_whole(spark, h, w, block, angle):
    rng = np.random.default_rng(h)
    image = rng.random((h, w))
    y, x = np.mgrid[:h, :w]
    keep = rng.random(h * w) > 0.2  # missing pixels are 0
    keep[[0, -1]] = True
    image.ravel()[~keep] = 0
    pdf = pd.DataFrame({"y": y.ravel() + 5, "x": x.ravel() - 3, "value": image.ravel()}).astype({"y": "int32", "x": "int32"})[keep]
    pdf.iloc[len(pdf) // 2, 2] = np.nan
    image[pdf.iloc[len(pdf) // 2, 0] - 5, pdf.iloc[len(pdf) // 2, 1] + 3] = 0
    got = rasters.lowpass_pixels(spark.createDataFrame(pdf).repartition(3), 8, 11, cut_off=1.5, angle=angle, block=block).toPandas()
    want = rasters.hamming_lowpass(image, 8, 11, 1.5, angle)
    assert len(got) == keep.sum() and np.abs(got["low"] - want[got["y"] - 5, got["x"] + 3]).max() < 1e-9


def test_lowpass_is_the_filter_of_the_spectrum():
    """One wave inside the window stays but for its weight, one outside goes."""
    y, x = np.mgrid[:32, :32]
    wave = lambda k: np.cos(2 * np.pi * k * x / 32)
    assert np.abs(rasters.hamming_lowpass(wave(12), 10, 10)).max() < 1e-12
    low = rasters.hamming_lowpass(wave(2), 10, 10)
    share = (low * wave(2)).sum() / (wave(2) ** 2).sum()
    assert 0.3 < share < 1 and np.abs(low - share * wave(2)).max() < 0.35


def test_lowpass_of_nothing(spark):
    assert rasters.lowpass_pixels(spark.createDataFrame([], "y int, x int, value double"), 4, 4).count() == 0


def test_pixels_meet_their_tiles(spark):
    rng = np.random.default_rng(2)
    tiles = [(k, *(int(v) for v in (a, a + d, b, b + e))) for k, (a, b, d, e) in enumerate(rng.integers([-5, -5, 0, 1], [30, 40, 25, 9], (25, 4)))]
    df = spark.createDataFrame(tiles, "tile int, ey0 int, ey1 int, ex0 int, ex1 int")
    pixels = spark.range(48 * 58).select((F.floor(F.col("id") / 58) - 8).cast("int").alias("y"), (F.col("id") % 58 - 8).cast("int").alias("x"))
    joined = rasters.in_tiles(pixels, df)
    got = sorted((r.y, r.x, r.tile) for r in joined.collect())
    assert got == sorted((y, x, k) for k, a, b, c, d in tiles for y in range(max(-8, a), min(40, b)) for x in range(max(-8, c), min(50, d)))
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()
    assert rasters.in_tiles(pixels, df.limit(0)).count() == 0


def test_tiles_of_a_ragged_raster(spark):
    """Strips over all rows with data, columns from each strip's own data."""
    rng = np.random.default_rng(4)
    image = (rng.random((47, 60)) < 0.15) * 1.0
    image[:9] = 0
    y, x = np.mgrid[:47, :60]
    df = spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "value": image.ravel()}).astype({"y": "int32", "x": "int32"}))
    got = {(r.y0, r.y1, r.x0, r.x1) for r in windows.moving_windows(df, 15, 20, 5, 5).collect()}

    def cuts(lo, hi, size, overlap):
        n = max(1, -(-(hi - lo - size) // (size - overlap)) + 1)
        return [(lo + i * (size - overlap), hi if i == n - 1 else lo + i * (size - overlap) + size) for i in range(n)]

    ys = np.flatnonzero(image.any(axis=1))
    want = set()
    for a, b in cuts(ys[0], ys[-1] + 1, 15, 5):
        xs = np.flatnonzero(image[a:b].any(axis=0))
        want |= {(a, b, c, d) for c, d in cuts(xs[0], xs[-1] + 1, 20, 5)}
    assert got == want


def test_pixel_counts_are_dealt_by_rows(spark, monkeypatch):
    """Tasks follow from the rows of the stack, and counts equal a loop's."""
    import datetime
    import re

    import numpy as np

    from geostrain.operators import aggregates

    rng = np.random.default_rng(8)
    dates = [datetime.date(2020, 1, 1) + datetime.timedelta(days=30 * i) for i in range(5)]
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4)]
    rows = [(dates[i], dates[j], y, x, None if rng.random() < 0.1 else float(rng.integers(0, 3))) for i, j in pairs for y in range(6) for x in range(5) if rng.random() < 0.9]
    monkeypatch.setattr(aggregates, "COUNTED_ROWS", 10)
    found = aggregates.pixel_counts(spark.createDataFrame(rows, "date1 date, date2 date, y int, x int, value double"))
    plan = found._jdf.queryExecution().toString()
    assert re.search(rf"hashpartitioning\(y#\d+L?, x#\d+L?, {len(rows) // 10}\), REPARTITION_BY_NUM", plan)
    n_pairs = {k: sum(k in p for p in pairs) for k in range(5)}
    want = {}
    for a, b, y, x, v in rows:
        for d in (a, b):
            want[d, y, x] = want.get((d, y, x), 0) + (v is not None and v != 0 and n_pairs[dates.index(d)] >= 2)
    assert {(r.d, r.y, r.x): r.n for r in found.collect()} == want
