"""Rasters: smoothing, low-pass filters, referencing to stations, profiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import los_sigma, los_value, unit_vector
from .aggregates import equal_width_bin
from .regression import fit_plane, plane_on

#: Values of a raster that a task of the transform holds, about.
BLOCK_VALUES = 1 << 20


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def smooth(image: np.ndarray, sigma_y: float, sigma_x: float) -> np.ndarray:
    """Separable Gaussian smoothing; the nearest edge pixel goes on outside."""
    out = np.asarray(image, float)
    for axis, s in ((0, sigma_y), (1, sigma_x)):
        k = gaussian_kernel(s)
        r = len(k) // 2
        pad = [(r, r) if a == axis else (0, 0) for a in range(2)]
        p = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(p, np.arange(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def smooth_pixels(pixels: DataFrame, sigma: float, value: str = "value", block: int = 256) -> DataFrame:
    """Gaussian smoothing of a pixel table by blocks with a halo of the kernel's reach."""
    reach = len(gaussian_kernel(sigma)) // 2
    if reach > block:
        raise ValueError("the kernel reaches beyond a neighbouring block")
    bounds = pixels.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda o: F.floor((F.col(c) + o) / block).cast("int")))
    halo = pixels.select("y", "x", value).withColumn("_by", F.explode(near("y"))).withColumn("_bx", F.explode(near("x")))

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = max(bounds[0], key[0] * block - reach), max(bounds[2], key[1] * block - reach)
        y1, x1 = min(bounds[1], (key[0] + 1) * block - 1 + reach), min(bounds[3], (key[1] + 1) * block - 1 + reach)
        if y1 < y0 or x1 < x0:
            return pd.DataFrame({"y": [], "x": [], "smooth": []})
        image = np.zeros((y1 - y0 + 1, x1 - x0 + 1))
        inside = g["y"].between(y0, y1) & g["x"].between(x0, x1)
        g = g[inside]
        image[g["y"] - y0, g["x"] - x0] = g[value].fillna(0)
        s = smooth(image, sigma, sigma)
        own = (g["y"] // block == key[0]) & (g["x"] // block == key[1])
        return pd.DataFrame({"y": g["y"][own], "x": g["x"][own], "smooth": s[g["y"][own] - y0, g["x"][own] - x0]})

    return halo.groupBy("_by", "_bx").applyInPandas(one, "y int, x int, smooth double")


def hamming_mask(h: int, w: int, size_y: int, size_x: int, cut_off: float, angle: float, columns: np.ndarray) -> np.ndarray:
    """Some columns of a centred, rotated square-root Hamming window over a raster of h by w frequencies."""
    ky, kx = min(size_y, h), min(size_x, w)
    y0, x0 = (h - ky) // 2, (w - kx) // 2
    yy, xx = np.meshgrid(np.arange(h), columns, indexing="ij")
    if angle:
        cy, cx = (h - 1) / 2, (w - 1) / 2
        a = math.radians(angle)
        dy, dx = yy - cy, xx - cx
        yy = np.rint(cy + dy * math.cos(a) - dx * math.sin(a)).astype(int)
        xx = np.rint(cx + dy * math.sin(a) + dx * math.cos(a)).astype(int)
    inside = (yy >= y0) & (yy < y0 + ky) & (xx >= x0) & (xx < x0 + kx)
    window = np.sqrt(np.outer(np.hamming(ky), np.hamming(kx)))
    return np.where(inside, window[np.clip(yy - y0, 0, ky - 1), np.clip(xx - x0, 0, kx - 1)], 0.0) ** cut_off


def hamming_lowpass(image: np.ndarray, size_y: int, size_x: int, cut_off: float = 1.0, angle: float = 0.0) -> np.ndarray:
    """Low-pass in the frequency domain of a raster in memory."""
    h, w = image.shape
    mask = hamming_mask(h, w, size_y, size_x, cut_off, angle, np.arange(w))
    return np.real(np.fft.ifft2(np.fft.ifftshift(np.fft.fftshift(np.fft.fft2(image)) * mask)))


def fft_size(extent: Column, wavelength: float) -> Column:
    """Even kernel size of a filter of a wavelength over an extent in metres."""
    return (F.rint(F.ceil(extent / wavelength) / 2) * 2).cast("int")


def lowpass_pixels(pixels: DataFrame, size_y: int, size_x: int, value: str = "value", cut_off: float = 1.0, angle: float = 0.0, block: int = BLOCK_VALUES) -> DataFrame:
    """The filter over a whole raster, whose transform is spread over tasks.

    Blocks of rows are transformed along x and cut into blocks of columns; a
    shuffle brings all pieces of such a block together, where it is transformed
    along y, masked and transformed back; a second shuffle returns the pieces to
    their rows.  Only columns inside the window travel.  A task holds ``block``
    values, or one row or column.  Null values and missing pixels count as 0.
    """
    span = pixels.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    if span["y0"] is None:
        return pixels.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(0.0).alias("low"))
    y0, x0, h, w = span["y0"], span["x0"], span["y1"] - span["y0"] + 1, span["x1"] - span["x0"] + 1
    # columns of the centred spectrum in which the window isn't 0, and where they are in the transform
    reach = (min(size_x, w) if not angle else math.ceil(math.hypot(size_y, size_x)) + 2) // 2 + 1
    centred = np.arange(max(0, w // 2 - reach), min(w, w // 2 + reach + 1))
    places = (centred - w // 2) % w
    n_rows, n_columns = max(1, block // w), max(1, block // h)
    pieces = [slice(i, i + n_columns) for i in range(0, len(centred), n_columns)]
    rows = pixels.select("y", "x", F.col(value).cast("double").alias("value"), F.floor((F.col("y") - y0) / n_rows).cast("int").alias("yb"))
    piece = "yb int, xb int, data binary"

    def along_rows(g: pd.DataFrame) -> pd.DataFrame:
        yb = int(g["yb"].iloc[0])
        image = np.zeros((min(n_rows, h - yb * n_rows), w))
        image[g["y"] - y0 - yb * n_rows, g["x"] - x0] = g["value"].fillna(0)
        found = np.fft.fft(image, axis=1)[:, places]
        return pd.DataFrame({"yb": yb, "xb": range(len(pieces)), "data": [found[:, s].tobytes() for s in pieces]})

    def along_columns(g: pd.DataFrame) -> pd.DataFrame:
        xb = int(g["xb"].iloc[0])
        own = centred[pieces[xb]]
        image = np.zeros((h, len(own)), complex)
        for yb, data in zip(g["yb"], g["data"], strict=True):
            part = np.frombuffer(data, complex).reshape(-1, len(own))
            image[yb * n_rows : yb * n_rows + len(part)] = part
        mask = np.fft.ifftshift(hamming_mask(h, w, size_y, size_x, cut_off, angle, own), axes=0)
        back = np.fft.ifft(np.fft.fft(image, axis=0) * mask, axis=0)
        starts = range(0, h, n_rows)
        return pd.DataFrame({"yb": range(len(starts)), "xb": xb, "data": [back[i : i + n_rows].tobytes() for i in starts]})

    def back_in_rows(own: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"y": [], "x": [], "low": []})
        yb = int(own["yb"].iloc[0])
        image = np.zeros((min(n_rows, h - yb * n_rows), w), complex)
        for xb, data in zip(g["xb"], g["data"], strict=True):
            image[:, places[pieces[xb]]] = np.frombuffer(data, complex).reshape(len(image), -1)
        low = np.real(np.fft.ifft(image, axis=1))
        return pd.DataFrame({"y": own["y"], "x": own["x"], "low": low[own["y"] - y0 - yb * n_rows, own["x"] - x0]})

    spectrum = rows.groupBy("yb").applyInPandas(along_rows, piece).groupBy("xb").applyInPandas(along_columns, piece)
    return rows.groupBy("yb").cogroup(spectrum.groupBy("yb")).applyInPandas(back_in_rows, "y int, x int, low double")


def residual_surface(pixels: DataFrame, size_y: int, size_x: int, reach: int = 5) -> DataFrame:
    """Station minus raster line of sight, filled, and low-passed: y, x, filled, low."""
    from .network import fill_by_distance

    rows = pixels.withColumn("value", F.when(F.coalesce("mask", F.lit(True)), F.col("gnss_los") - F.col("insar")).otherwise(0.0)).select("y", "x", F.coalesce("value", F.lit(0.0)).alias("value"))
    filled = fill_by_distance(rows, reach)
    return filled.withColumnRenamed("value", "filled").join(lowpass_pixels(filled, size_y, size_x), ["y", "x"])


def project_stations(pixels: DataFrame, compat: bool = False) -> DataFrame:
    """Line-of-sight value and deviation of interpolated station velocities."""
    unit = unit_vector(F.col("inc"), F.col("azi"))
    return pixels.withColumns({"gnss_los": los_value(F.col("ns"), F.col("ew"), F.col("v"), unit), "gnss_std": los_sigma(F.col("sn"), F.col("se"), F.col("sv"), unit, compat)})


def in_tiles(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each pixel with every tile whose extended bounds hold it.

    Tiles are listed in the cells of a grid as wide as a tile, pixels have one
    cell: an equi-join, whatever the number of tiles.
    """
    size = tiles.agg(F.greatest(F.lit(1.0), F.avg(F.col("ey1") - F.col("ey0"))).alias("y"), F.greatest(F.lit(1.0), F.avg(F.col("ex1") - F.col("ex0"))).alias("x")).first()
    cell = lambda c, by: F.floor(c / (by or 1.0)).cast("long")
    listed = tiles.where("ey0 < ey1 and ex0 < ex1")
    for axis in "yx":
        listed = listed.withColumn(f"_c{axis}", F.explode(F.sequence(cell(F.col(f"e{axis}0"), size[axis]), cell(F.col(f"e{axis}1") - 1, size[axis]))))
    placed = pixels.withColumns({f"_c{axis}": cell(F.col(axis), size[axis]) for axis in "yx"})
    inside = (F.col("y") >= F.col("ey0")) & (F.col("y") < F.col("ey1")) & (F.col("x") >= F.col("ex0")) & (F.col("x") < F.col("ex1"))
    return placed.join(listed, ["_cy", "_cx"]).where(inside).drop("_cy", "_cx")


def reference_tiles(pixels: DataFrame, tiles: DataFrame, order: float = 1.5, most_missing: float = 0.99) -> DataFrame:
    """Calibrated pixels: a plane of station minus raster per tile, later tiles over earlier.

    ``pixels``: y, x, lon, lat, insar, std, gnss_los, gnss_std; ``tiles``: tile,
    core bounds y0.. and extended bounds ey0...
    """
    joined = in_tiles(pixels, tiles)
    core = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    joined = joined.withColumns({"core": core, "residual": F.col("gnss_los") - F.col("insar"), "both_std": F.sqrt(F.col("std") ** 2 + F.coalesce("gnss_std", F.lit(0.0)) ** 2)})
    missing = F.col("residual").isNull() | F.isnan("residual")
    covered = joined.where("core").groupBy("tile").agg(F.avg(missing.cast("double")).alias("missing")).where(F.col("missing") <= most_missing).select("tile")
    used = joined.join(covered, "tile")
    planes = fit_plane(used, ["tile"], order, "residual", "both_std")
    on = plane_on(used.where("core"), planes, ["tile"], order, "std")
    return on.groupBy("y", "x").agg(F.max_by("plane", "tile").alias("plane"), F.max_by("plane_std", "tile").alias("plane_std"), F.first("insar").alias("insar")).withColumn("calibrated", F.col("insar") + F.col("plane"))


def subset_reference(stack: DataFrame, ref_date: str | None = None, ref_yx: tuple[int, int] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of a box (y0, y1, x0, x1), relative to a date and to a pixel."""
    rows = stack
    if ref_yx:
        spot = stack.where((F.col("y") == ref_yx[0]) & (F.col("x") == ref_yx[1])).select("d", F.col("disp").alias("_r"))
        rows = rows.join(spot, "d", "left").withColumn("disp", F.col("disp") - F.col("_r")).drop("_r")
    if box:
        rows = rows.where((F.col("y") >= box[0]) & (F.col("y") < box[1]) & (F.col("x") >= box[2]) & (F.col("x") < box[3]))
    if ref_date:
        at = rows.where(F.col("d") == F.lit(ref_date).cast("date")).select("y", "x", F.col("disp").alias("_r"))
        rows = rows.join(at, ["y", "x"], "left").withColumn("disp", F.col("disp") - F.col("_r")).drop("_r")
    return rows


def profile(pixels: DataFrame, p1: tuple[float, float], p2: tuple[float, float], n_bins: int, radius: float, value: str = "value") -> DataFrame:
    """Mean and deviation in bins along a line, of pixels within a radius of it (plane degrees)."""
    length = math.hypot(p2[0] - p1[0], p2[1] - p1[1])
    ux, uy = (p2[0] - p1[0]) / length, (p2[1] - p1[1]) / length
    dx, dy = F.col("lon") - p1[0], F.col("lat") - p1[1]
    lo = [min(a, b) - radius for a, b in zip(p1, p2, strict=True)]
    hi = [max(a, b) + radius for a, b in zip(p1, p2, strict=True)]
    rows = pixels.where(F.col("lon").between(lo[0], hi[0]) & F.col("lat").between(lo[1], hi[1])).withColumns({"along": dx * ux + dy * uy, "across": dy * ux - dx * uy})
    rows = rows.where((F.abs("across") <= radius) & F.col("along").between(0, length))
    rows = rows.withColumn("bin", equal_width_bin(F.col("along"), F.lit(0.0), F.lit(length), n_bins))
    return rows.groupBy("bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn("distance", (F.col("bin") + 0.5) * length / n_bins)


def profile_line(pixels: DataFrame, points: list[tuple[float, float]], n_bins: int, radius: float, value: str = "value") -> DataFrame:
    """Profiles of a polyline's segments, with the running distance."""
    out, before = None, 0.0
    for k, (a, b) in enumerate(zip(points[:-1], points[1:], strict=True)):
        part = profile(pixels, a, b, n_bins, radius, value).withColumns({"segment": F.lit(k), "distance": F.col("distance") + before})
        out = part if out is None else out.unionByName(part)
        before += math.hypot(b[0] - a[0], b[1] - a[1])
    return out
