"""Overlapping tracks: joint referencing to stations, planes from overlaps, mosaics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import PLANE_TERMS, plane_design, quasi_vertical
from .regression import fit_plane, normal_sums, plane_on


def to_quasi_vertical(tracks: DataFrame) -> DataFrame:
    """``value`` and ``std`` of line-of-sight rows, as if nothing moved sideways."""
    value, std = quasi_vertical(F.col("los"), F.col("std"), F.col("inc"))
    return tracks.withColumns({"value": value, "std": std})


def reference_tracks(tracks: DataFrame, order: float = 1) -> DataFrame:
    """All tracks with one plane added that is fitted to the stations' differences of all of them.

    ``tracks``: y, x, track, lon, lat, los, std, gnss_los, gnss_std; rows without
    a station have a null gnss_los.  No station at all gives no row.
    """
    rows = tracks.withColumns({"difference": F.col("gnss_los") - F.col("los"), "both_std": F.sqrt(F.col("std") ** 2 + F.col("gnss_std") ** 2)})
    plane = fit_plane(rows.withColumn("_all", F.lit(0)), ["_all"], order, "difference", "both_std").drop("_all")
    return plane_on(rows, plane, [], order, "std").withColumn("corrected", F.col("los") + F.col("plane")).drop("difference", "both_std")


def overlap_planes(tracks: DataFrame, order: float = 0) -> DataFrame:
    """One plane a track, such that the tracks agree best where they overlap: track, n, x, q, mse.

    ``tracks``: y, x, track, lon, lat, value, std.  Overlaps fix planes only up to
    one common to all tracks that hang together; of these, the planes have mean 0.
    A track without overlap has plane 0.  Each pair of tracks becomes one row of
    sums, and the joint system is solved on these rows alone.
    """
    p = len(PLANE_TERMS[order])
    first = tracks.select("y", "x", "lon", "lat", F.col("track").alias("track1"), F.col("value").alias("v1"), F.col("std").alias("s1"))
    second = tracks.select("y", "x", F.col("track").alias("track2"), F.col("value").alias("v2"), F.col("std").alias("s2"))
    both = first.join(second, ["y", "x"]).where("track1 < track2")
    sums = normal_sums(both, ["track1", "track2"], plane_design(F.col("lon"), F.col("lat"), order), F.col("v2") - F.col("v1"), 1 / (F.col("s1") ** 2 + F.col("s2") ** 2))
    kind = tracks.schema["track"].dataType.simpleString()

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pairs["track1"]) | set(pairs["track2"]))
        at = {t: slice(p * i, p * i + p) for i, t in enumerate(names)}
        n, r, rows = np.zeros((p * len(names),) * 2), np.zeros(p * len(names)), dict.fromkeys(names, 0)
        for row in pairs.to_dict("records"):
            block = np.array([[row[f"n{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            right = np.array([row[f"r{i}"] for i in range(p)])
            for t, sign in ((row["track1"], 1), (row["track2"], -1)):
                n[at[t], at[t]] += block
                r[at[t]] += sign * right
                rows[t] += row["n"]
            n[at[row["track1"]], at[row["track2"]]] -= block
            n[at[row["track2"]], at[row["track1"]]] -= block
        scale = np.tile(np.sqrt(np.maximum(np.diag(n).reshape(-1, p).max(axis=0), 1e-300)), len(names))  # the same for all tracks keeps their mean 0
        unit = n / np.outer(scale, scale)
        rank = np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True)
        q = np.linalg.pinv(unit, rcond=1e-10, hermitian=True) / np.outer(scale, scale)
        x = q @ r
        dof = int(pairs["n"].sum()) - int(rank)
        mse = max(0.0, float(pairs["yy"].sum()) - float(x @ r)) / dof if dof > 0 else 0.0
        return pd.DataFrame([{"track": t, "n": rows[t], "x": x[at[t]].tolist(), "q": q[at[t], at[t]].ravel().tolist(), "mse": mse} for t in names], columns=["track", "n", "x", "q", "mse"])

    found = sums.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, f"track {kind}, n long, x array<double>, q array<double>, mse double")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    all_tracks = tracks.select("track").distinct().join(found, "track", "left")
    return all_tracks.select("track", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", zeros(p)).alias("x"), F.coalesce("q", zeros(p * p)).alias("q"), F.coalesce("mse", F.lit(0.0)).alias("mse"))


def level_tracks(tracks: DataFrame, order: float = 0) -> DataFrame:
    """Tracks with their overlap planes added to ``value``, and the planes' deviations to ``std``."""
    planes = F.broadcast(overlap_planes(tracks, order))  # one row a track
    rows = plane_on(tracks, planes, ["track"], order, "std")
    return rows.withColumns({"value": F.col("value") + F.col("plane"), "std": F.col("plane_std")}).drop("plane_std")


def mosaic(tracks: DataFrame) -> DataFrame:
    """Weighted mean of the tracks of each pixel: y, x, n, mosaic, mosaic_std."""
    weight: Column = 1 / (F.col("std") * F.col("std"))
    used = tracks.where("value is not null and not isnan(value)")
    return used.groupBy("y", "x").agg(F.count("*").alias("n"), (F.sum(weight * F.col("value")) / F.sum(weight)).alias("mosaic"), (1 / F.sqrt(F.sum(weight))).alias("mosaic_std"))
