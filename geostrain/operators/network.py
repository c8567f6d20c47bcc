"""Station networks: Delaunay neighbours, network metrics, interpolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import geodesic_distance
from ..sources.shared import written
from .aggregates import structure_function
from .triangulation import delaunay, edges, triangle_edges, triangles

__all__ = ["delaunay", "triangle_edges", "triangles", "edges", "neighbours", "network_structure", "triangle_table", "interpolate", "barycentric", "fill_by_distance"]


def neighbours(sites: DataFrame, network: str | None = None) -> DataFrame:
    """src, dst and distance (km) of Delaunay neighbours, both ways, in each network."""
    net = F.lit("") if network is None else F.col(network).cast("string")
    at = sites.select(net.alias("_net"), "site", "lon", "lat").dropDuplicates(["_net", "site"])
    side = lambda k: at.select("_net", F.col("site").alias(k), F.col("lon").alias(f"lon_{k}"), F.col("lat").alias(f"lat_{k}"))
    rows = edges(triangles(sites, network)).join(side("src"), ["_net", "src"]).join(side("dst"), ["_net", "dst"])
    # stored: the distance is a long expression, and edges are used several times
    return written(rows.select("src", "dst", geodesic_distance(F.col("lon_src"), F.col("lat_src"), F.col("lon_dst"), F.col("lat_dst"), "km").alias("dist")))


def network_structure(edges: DataFrame, sites: DataFrame, spacing: float = 25.0, dvmax: float = 10.0) -> DataFrame:
    """Median of the structure function over each site and its neighbours."""
    star = edges.select(F.col("src").alias("centre_site"), F.col("dst").alias("member")).unionByName(edges.select(F.col("src").alias("centre_site"), F.col("src").alias("member")).distinct())
    at = sites.select(F.col("site").alias("member"), "lon", "lat", "v")
    rows = star.join(at, "member")
    a, b = rows.select("centre_site", *(F.col(c).alias(f"{c}_1") for c in ("member", "lon", "lat", "v"))), rows.select("centre_site", *(F.col(c).alias(f"{c}_2") for c in ("member", "lon", "lat", "v")))
    pairs = a.join(b, "centre_site").where("member_1 < member_2")
    pairs = pairs.select("centre_site", F.col("v_1").alias("v1"), F.col("v_2").alias("v2"), geodesic_distance(F.col("lon_1"), F.col("lat_1"), F.col("lon_2"), F.col("lat_2"), "km").alias("dist"))
    ssf = structure_function(pairs, ["centre_site"], spacing, dvmax, km=True)
    n = star.groupBy("centre_site").agg((F.count("*") - 1).alias("n_neighbours"))
    return n.join(ssf.groupBy("centre_site").agg(F.median("ssf").alias("ssf")), "centre_site", "left")


def triangle_table(points: DataFrame, fields: list[str]) -> DataFrame:
    """_net, a, b, c, and the position (xa, ya, ...) and fields (<field>_a, ...) of the corners of each Delaunay triangle."""
    found = triangles(points)
    for k in "abc":
        own = points.groupBy(F.col("site").alias(k)).agg(F.min(F.struct("lon", "lat", *fields)).alias("_p"))
        found = found.join(own.select(k, F.col("_p.lon").alias(f"x{k}"), F.col("_p.lat").alias(f"y{k}"), *(F.col(f"_p.{f}").alias(f"{f}_{k}") for f in fields)), k)
    return found


def interpolate(points: DataFrame, targets: DataFrame, fields: list[str]) -> DataFrame:
    """Linear interpolation over the Delaunay triangles of ``points``; null outside their hull.

    A grid of cells, about one for each point, is the index: each triangle is
    listed in the cells of its box, row by row as far as the triangle reaches
    there, and a target meets the triangles of its own cell.  Of triangles that
    share a target on their border the first counts.
    """
    corners = written(triangle_table(points, fields))
    span = corners.agg(F.min(F.least("xa", "xb", "xc")).alias("x0"), F.max(F.greatest("xa", "xb", "xc")).alias("x1"), F.min(F.least("ya", "yb", "yc")).alias("y0"), F.max(F.greatest("ya", "yb", "yc")).alias("y1"), F.count("*").alias("n")).first()
    if not span["n"]:
        return targets.withColumns({f: F.lit(None).cast("double") for f in fields})
    m = max(1, int(np.sqrt(span["n"] / 2)))
    step = lambda c, a, b: F.floor((c - span[a]) / (max(span[b] - span[a], 1e-12) / m)).cast("long")
    listed = corners.withColumn("_cy", F.explode(F.sequence(step(F.least("ya", "yb", "yc"), "y0", "y1"), step(F.greatest("ya", "yb", "yc"), "y0", "y1"))))
    # where the triangle crosses the row: its corners inside and the crossings of its sides
    low, high = span["y0"] + F.col("_cy") * (max(span["y1"] - span["y0"], 1e-12) / m), span["y0"] + (F.col("_cy") + 1) * (max(span["y1"] - span["y0"], 1e-12) / m)
    xs = [F.when(F.col(f"y{k}").between(low, high), F.col(f"x{k}")) for k in "abc"]
    for s, t in ("ab", "bc", "ca"):
        for level in (low, high):
            share = (level - F.col(f"y{s}")) / F.nullif(F.col(f"y{t}") - F.col(f"y{s}"), F.lit(0.0))
            xs.append(F.when(share.between(0, 1), F.col(f"x{s}") + share * (F.col(f"x{t}") - F.col(f"x{s}"))))
    eps = 1e-9 * max(1.0, abs(span["x0"]), abs(span["x1"]))
    reach = F.array_compact(F.array(*xs))
    listed = listed.withColumn("_xs", reach).where(F.size("_xs") > 0).withColumn("_cx", F.explode(F.sequence(step(F.array_min("_xs") - eps, "x0", "x1"), step(F.array_max("_xs") + eps, "x0", "x1")))).drop("_xs")
    at = targets.select(F.col("lon").cast("double").alias("_x"), F.col("lat").cast("double").alias("_y")).distinct()
    placed = at.withColumns({"_cx": step(F.col("_x"), "x0", "x1"), "_cy": step(F.col("_y"), "y0", "y1")})
    det = (F.col("yb") - F.col("yc")) * (F.col("xa") - F.col("xc")) + (F.col("xc") - F.col("xb")) * (F.col("ya") - F.col("yc"))
    u = ((F.col("yb") - F.col("yc")) * (F.col("_x") - F.col("xc")) + (F.col("xc") - F.col("xb")) * (F.col("_y") - F.col("yc"))) / det
    v = ((F.col("yc") - F.col("ya")) * (F.col("_x") - F.col("xc")) + (F.col("xa") - F.col("xc")) * (F.col("_y") - F.col("yc"))) / det
    met = placed.join(listed, ["_cx", "_cy"]).withColumns({"_u": u, "_v": v}).withColumn("_w", 1 - F.col("_u") - F.col("_v")).where("_u >= -1e-9 and _v >= -1e-9 and _w >= -1e-9")
    values = [(F.col("_u") * F.col(f"{f}_a") + F.col("_v") * F.col(f"{f}_b") + F.col("_w") * F.col(f"{f}_c")).alias(f) for f in fields]
    best = met.groupBy("_x", "_y").agg(F.min(F.struct("a", "b", "c", *values)).alias("_best"))
    out = targets.join(best, (F.col("lon").cast("double") == F.col("_x")) & (F.col("lat").cast("double") == F.col("_y")), "left")
    return out.select(*(F.col(c) for c in targets.columns), *(F.col(f"_best.{f}").alias(f) for f in fields))


def barycentric(xy: np.ndarray, tri: np.ndarray, values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.full((len(x), values.shape[1]), np.nan)
    for t in tri:
        a, b, c = xy[t]
        d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
        m = np.flatnonzero((x >= min(a[0], b[0], c[0])) & (x <= max(a[0], b[0], c[0])) & (y >= min(a[1], b[1], c[1])) & (y <= max(a[1], b[1], c[1])))
        u = ((b[1] - c[1]) * (x[m] - c[0]) + (c[0] - b[0]) * (y[m] - c[1])) / d
        v = ((c[1] - a[1]) * (x[m] - c[0]) + (a[0] - c[0]) * (y[m] - c[1])) / d
        w = 1 - u - v
        ok = (u >= -1e-9) & (v >= -1e-9) & (w >= -1e-9)
        out[m[ok]] = np.c_[u, v, w][ok] @ values[t]
    return out


def fill_by_distance(pixels: DataFrame, reach: int, value: str = "value", nodata: float = 0.0, smoothing: int = 0) -> DataFrame:
    """Fill nodata pixels with the inverse-distance mean of data within ``reach`` pixels.

    A range join on blocks of ``reach`` pixels: each hole meets the nine blocks
    around it.  ``smoothing`` passes then replace each filled pixel by the mean of
    the 3 x 3 pixels around it that have data or were filled.
    """
    hole = F.col(value).isNull() | (F.col(value) == nodata)
    block = lambda c: F.floor(F.col(c) / reach).cast("int")
    holes = pixels.where(hole).select("y", "x").withColumn("_by", F.explode(F.array(block("y") - 1, block("y"), block("y") + 1))).withColumn("_bx", F.explode(F.array(block("x") - 1, block("x"), block("x") + 1)))
    data = pixels.where(~hole).select(F.col("y").alias("y2"), F.col("x").alias("x2"), F.col(value).alias("v2"), block("y").alias("_by"), block("x").alias("_bx"))
    d = F.sqrt((F.col("y") - F.col("y2")) ** 2 + (F.col("x") - F.col("x2")) ** 2)
    near = holes.join(data, ["_by", "_bx"]).withColumn("d", d).where(F.col("d") <= reach)
    filled = near.groupBy("y", "x").agg((F.sum(F.col("v2") / F.col("d")) / F.sum(1 / F.col("d"))).alias("_f"))
    rows = pixels.join(filled, ["y", "x"], "left").withColumn("_v", F.when(hole, F.col("_f")).otherwise(F.col(value)))
    for _ in range(smoothing):
        around = F.array(*(F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        near = rows.where("_v is not null").select("_v", F.explode(around).alias("_p")).groupBy("_p.y", "_p.x").agg(F.avg("_v").alias("_m"))
        rows = rows.join(near, ["y", "x"], "left").withColumn("_v", F.when(F.col("_f").isNotNull(), F.col("_m")).otherwise(F.col("_v"))).drop("_m")
    return rows.withColumn(value, F.coalesce("_v", F.lit(nodata))).drop("_f", "_v")
