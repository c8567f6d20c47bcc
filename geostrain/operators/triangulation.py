"""Delaunay triangulation of any number of points, in tiles with halos.

Points are dealt to tiles of about ``TILE`` points by quantiles of longitude, and
of latitude within a strip.  Each tile triangulates its own points and those of a
halo around them.  A triangle there is one of the whole set if its circumcircle,
cut to the convex hull of all points, lies inside the tile's known rectangle: no
unseen point can lie in it.  A tile whose own points have only such triangles is
done; else its halo grows, for that tile alone, by what its circles need on each side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .plates import hull

#: Points of a tile, about.
TILE = 400
#: Width of the first halo, in sizes of the tile.
HALO = 0.25
#: Tiles that a task triangulates, about.
TILES_IN_TASK = 8
#: Relative size of a determinant up to which rounding may have turned its sign.
FLAT = 1e-13

# ------------------------------------------------------------ one tile


def _whole(p: np.ndarray) -> list[list[int]]:
    """Coordinates as integers of one common power of two: exactly those given."""
    ratios = [[float(v).as_integer_ratio() for v in row] for row in p]
    unit = max(d for row in ratios for _, d in row)
    return [[n * (unit // d) for n, d in row] for row in ratios]


def _turn(p: np.ndarray, a, b, c, whole: list[list[int]] | None = None) -> np.ndarray:
    """Twice the signed area of a triangle; 0 where it is lost in rounding, or its exact sign there from ``whole``."""
    u = (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1])
    v = (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])
    d = u - v
    d = np.where(np.abs(d) > FLAT * (np.abs(u) + np.abs(v)), d, 0.0)
    for k in np.flatnonzero(d == 0).tolist() if whole is not None else ():
        (ax, ay), (bx, by), (cx, cy) = whole[a[k]], whole[b[k]], whole[c[k]]
        left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
        d[k] = (left > right) - (left < right)
    return d


def _inside_circle(p: np.ndarray, tri: np.ndarray, i: int, whole: list[list[int]]) -> np.ndarray:
    """Whether point ``i`` lies strictly in the circles of counter-clockwise triangles; exact where rounding leaves it open."""
    a, b, c = (p[tri[:, k]] - p[i] for k in range(3))
    a2, b2, c2 = ((v**2).sum(1) for v in (a, b, c))
    terms = [a2 * b[:, 0] * c[:, 1], -a2 * b[:, 1] * c[:, 0], b2 * c[:, 0] * a[:, 1], -b2 * c[:, 1] * a[:, 0], c2 * a[:, 0] * b[:, 1], -c2 * a[:, 1] * b[:, 0]]
    total = sum(terms)
    inside = total > 0
    for k in np.flatnonzero(np.abs(total) <= FLAT * sum(np.abs(t) for t in terms)).tolist():
        x, y = whole[i]
        (ax, ay), (bx, by), (cx, cy) = ((whole[j][0] - x, whole[j][1] - y) for j in tri[k].tolist())
        inside[k] = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0
    return inside


def delaunay(x, y) -> np.ndarray:
    """Triangles (indices, counter-clockwise) by incremental insertion; none for points on a line.

    Beyond every edge of the hull lies a triangle with the vertex -1, whose
    "circle" is the half-plane outside, so the hull needs no far-away points.  Of
    equal points only the first takes part.

    Signs that rounding leaves open are taken exactly, of the coordinates as they
    are given: on a lattice, tolerances would open cavities that don't hang together.
    Of points on one circle the order of insertion decides alone, so tiles that
    insert in one order agree.
    """
    p = np.c_[np.asarray(x, float), np.asarray(y, float)]
    rest = np.sort(np.unique(p, axis=0, return_index=True)[1]).tolist() if len(p) else []
    if len(rest) < 3:
        return np.zeros((0, 3), int)
    a, b, whole = rest[0], rest[1], _whole(p)
    turns = _turn(p, np.full(len(rest), a), np.full(len(rest), b), np.array(rest), whole)
    if not turns.any():
        return np.zeros((0, 3), int)
    c = rest[int(np.flatnonzero(turns)[0])]
    if turns[np.flatnonzero(turns)[0]] < 0:
        a, b = b, a
    tri = np.array([[a, b, c], [b, a, -1], [c, b, -1], [a, c, -1]])
    for i in rest:
        if i in (a, b, c):
            continue
        ghost = tri[:, 2] < 0
        bad = np.zeros(len(tri), bool)
        bad[~ghost] = _inside_circle(p, tri[~ghost], i, whole)
        u, v = tri[ghost, 0], tri[ghost, 1]
        side = _turn(p, u, v, np.full(len(u), i), whole)
        along = ((p[u] - p[i]) * (p[v] - p[i])).sum(1)
        bad[ghost] = (side > 0) | (side == 0) & (along < 0)
        out = tri[bad]
        edges = np.concatenate([out[:, [0, 1]], out[:, [1, 2]], out[:, [2, 0]]])
        known = {tuple(e) for e in edges.tolist()}
        new = []
        for s, t in edges.tolist():
            if (t, s) not in known:
                new.append((t, i, -1) if s < 0 else (i, s, -1) if t < 0 else (s, t, i))
        tri = np.concatenate([tri[~bad], np.array(new, int).reshape(-1, 3)])
    tri = tri[tri[:, 2] >= 0]
    return tri[_turn(p, *tri.T) > 0] if len(tri) else tri


def triangle_edges(tri: np.ndarray) -> np.ndarray:
    """Undirected edges of triangles, both ways, each once."""
    e = np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]) if len(tri) else np.zeros((0, 2), int)
    return np.unique(np.vstack([e, e[:, ::-1]]), axis=0)


def circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of circumcircles."""
    a, b, c = (p[tri[:, k]] for k in range(3))
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    ux = (c[:, 1] * (b**2).sum(1) - b[:, 1] * (c**2).sum(1)) / d
    uy = (b[:, 0] * (c**2).sum(1) - c[:, 0] * (b**2).sum(1)) / d
    return a + np.c_[ux, uy], np.hypot(ux, uy)


def box_of_cut_circle(centre: np.ndarray, radius: float, corners: np.ndarray) -> np.ndarray:
    """(x0, x1, y0, y1) of the part of a circle inside a convex polygon, or of a bit more."""
    margin = 1e-9 * max(1.0, float(np.abs(corners).max()))
    nexts = np.roll(corners, -1, axis=0)
    found = [corners[((corners - centre) ** 2).sum(1) <= (radius * (1 + 1e-12)) ** 2]]
    d, f = nexts - corners, corners - centre
    qa, qb, qc = (d**2).sum(1), 2 * (d * f).sum(1), (f**2).sum(1) - radius**2
    disc = qb**2 - 4 * qa * qc
    for sign in (-1, 1):
        ok = (disc >= 0) & (qa > 0)
        s = (-qb[ok] + sign * np.sqrt(disc[ok])) / (2 * qa[ok])
        hit = (s >= -1e-9) & (s <= 1 + 1e-9)
        found.append((corners[ok] + s[:, None] * d[ok])[hit])
    tips = centre + radius * np.array([[1, 0], [-1, 0], [0, 1], [0, -1]])
    cross = d[:, 0] * (tips[:, None, 1] - corners[:, 1]) - d[:, 1] * (tips[:, None, 0] - corners[:, 0])
    found.append(tips[(cross >= -margin).all(axis=1)])
    at = np.concatenate(found)
    if not len(at):
        return np.array([np.inf, -np.inf, np.inf, -np.inf])
    return np.array([at[:, 0].min() - margin, at[:, 0].max() + margin, at[:, 1].min() - margin, at[:, 1].max() + margin])


def box_beyond(a: np.ndarray, b: np.ndarray, corners: np.ndarray) -> np.ndarray | None:
    """(x0, x1, y0, y1) of the part of a convex polygon to the right of the line from a to b; None if there is none."""
    side = (b[0] - a[0]) * (corners[:, 1] - a[1]) - (b[1] - a[1]) * (corners[:, 0] - a[0])
    out = side < -1e-12 * float(np.ptp(corners, axis=0).sum()) ** 2
    if not out.any():
        return None
    nexts, after = np.roll(corners, -1, axis=0), np.roll(side, -1)
    cut = (side < 0) != (after < 0)
    share = (side[cut] / (side[cut] - after[cut]))[:, None]
    at = np.concatenate([corners[out], corners[cut] + share * (nexts[cut] - corners[cut]), [a, b]])
    margin = 1e-9 * max(1.0, float(np.abs(corners).max()))
    return np.array([at[:, 0].min() - margin, at[:, 0].max() + margin, at[:, 1].min() - margin, at[:, 1].max() + margin])


def tile_triangles(p: np.ndarray, own: np.ndarray, boxes: np.ndarray, reach: int, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(triangles whose least point is one of ``own``, None), or (none, the boxes to try next).

    ``p`` are the points inside ``boxes`` (rows of x0, x1, y0, y1, or NaN), in one
    order for all tiles; ``corners`` is the hull of the whole set.  Box 0 is the
    tile with its halo; box ``k`` is for circles that leave it by the sides in the
    bits of ``k``, so a corner's tile grows along both borders and not over all
    between them.  Boxes end ``2^reach`` tile sizes from box 0.
    """
    every = np.array([corners[:, 0].min(), corners[:, 0].max(), corners[:, 1].min(), corners[:, 1].max()])
    outward = np.array([-1, 1, -1, 1])
    clipped = lambda b: np.where(outward * b > outward * every, every, b)
    covers = lambda need: bool((outward * boxes >= outward * need).all(axis=1).any())
    wider = lambda a, b: np.where(np.isnan(a) | (outward * b > outward * a), b, a)
    tri = delaunay(*p.T)
    mine = tri[own[tri].any(axis=1)] if len(tri) else tri
    done = lambda: mine[own[mine.min(axis=1)]] if len(mine) else mine
    if covers(every):
        return done(), None
    box = boxes[0]
    size = np.repeat([box[1] - box[0], box[3] - box[2]], 2)
    size = np.maximum(size, 1e-6 * max(1e-300, float(size.max()), float((every[[1, 3]] - every[[0, 2]]).max())))
    new, ready = boxes.copy(), True
    limit = box + outward * size * 2.0**reach

    def ask(need: np.ndarray) -> bool:
        """Whether ``need`` is known; else the box of the sides it leaves by grows."""
        need = clipped(need)
        if covers(need):
            return True
        sides = int((outward * need > outward * box) @ [1, 2, 4, 8])
        wanted = need + outward * 0.1 * size
        new[sides] = wider(new[sides], np.where(outward * wanted > outward * limit, limit, wanted))
        return False

    if len(mine):
        centre, radius = circles(p, mine)
        wide = radius + 1e-9 * max(1.0, float(np.abs(corners).max()))  # an unseen point may lie on the circle
        plain = np.c_[centre[:, 0] - wide, centre[:, 0] + wide, centre[:, 1] - wide, centre[:, 1] + wide]
        cut = np.where(outward * plain > outward * every, every, plain)
        for k in np.flatnonzero((outward * cut > outward * box).any(axis=1)):
            ready &= ask(box_of_cut_circle(centre[k], radius[k], corners) if np.isfinite(radius[k]) else every)
        # beyond an own edge without a second triangle nothing may lie
        directed = np.vstack([mine[:, [0, 1]], mine[:, [1, 2]], mine[:, [2, 0]]])
        border = directed[~np.isin(directed[:, 1] * len(p) + directed[:, 0], directed[:, 0] * len(p) + directed[:, 1])]
        for i, j in border[own[border].any(axis=1)]:
            beyond = box_beyond(p[i], p[j], corners)
            ready &= beyond is None or ask(beyond)
    if len(np.setdiff1d(np.flatnonzero(own), mine)):  # a point without any triangle
        ready = False
        new[0] = clipped(box + outward * size)
    if ready:
        return done(), None
    return np.zeros((0, 3), int), new


# ------------------------------------------------------------ all tiles


def _hulls(points: DataFrame) -> DataFrame:
    """_net and its corners: hulls of tiles, then of strips, then of the whole."""

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["lon", "lat"])
        return pdf.iloc[hull(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())]

    rows = points.select("_net", "strip", "cell", "lon", "lat")
    for keys in (["_net", "strip", "cell"], ["_net", "strip"], ["_net"]):
        rows = rows.groupBy(*keys).applyInPandas(corners, rows.schema)
    # the last rows of a net come from one group, in the hull's order
    own = Window.partitionBy("_net").orderBy("_order")
    rows = rows.withColumn("_order", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(own))
    return rows.groupBy("_net").agg(F.array_sort(F.collect_list(F.struct("_k", "lon", "lat"))).alias("corners"))


def triangles(sites: DataFrame, network: str | None = None, tile: int = TILE) -> DataFrame:
    """_net, a, b, c: the sites of every Delaunay triangle, of each network.

    Rows without a position are no points; of sites at one position the least
    takes part.  Circles through four points may be cut either way.
    """
    net = F.lit("") if network is None else F.col(network).cast("string")
    points = sites.select(net.alias("_net"), "site", F.col("lon").cast("double"), F.col("lat").cast("double")).where("not isnan(lon) and not isnan(lat) and lon is not null and lat is not null")
    points = written(points.groupBy("_net", "lon", "lat").agg(F.min("site").alias("site")))
    most = points.groupBy("_net").count().agg(F.max("count")).first()[0]
    if not most:
        return points.select("_net", F.col("site").alias("a"), F.col("site").alias("b"), F.col("site").alias("c"))
    m = int(np.ceil(np.sqrt(most / tile)))
    shares = [i / m for i in range(1, m)] or [0.5]
    own_m = F.ceil(F.sqrt(F.col("n") / tile)).cast("int")
    cut = lambda c: F.percentile_approx(c, shares, 10 * max(100, m)).alias("cuts")
    picked = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda i: F.element_at("cuts", F.greatest(F.lit(1), F.floor(i * m / F.col("m")).cast("int"))))
    chosen = F.when(F.col("m") > 1, picked).otherwise(F.array().cast("array<double>"))
    place = lambda c: F.size(F.filter("cuts", lambda b: b < F.col(c)))
    nets = points.groupBy("_net").agg(F.count("*").alias("n"), cut("lon"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    nets = written(nets.withColumn("m", own_m).withColumn("cuts", chosen))
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1e-12))
    bucket = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / span(a, b) * F.col("m")).cast("int"), F.col("m") - 1)
    placed = points.join(nets, "_net").withColumn("strip", place("lon")).withColumn("bx", bucket("lon", "lon0", "lon1")).withColumn("by", bucket("lat", "lat0", "lat1"))
    placed = written(placed.select("_net", "site", "lon", "lat", "strip", "bx", "by"))
    strips = written(placed.join(nets.select("_net", "m"), "_net").groupBy("_net", "strip", "m").agg(cut("lat")).withColumn("cuts", chosen))
    placed = written(placed.join(strips.select("_net", "strip", "cuts"), ["_net", "strip"]).withColumn("cell", place("lat")).drop("cuts"))
    size = F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"))
    first = [F.min("lon") - HALO * size, F.max("lon") + HALO * size, F.min("lat") - HALO * size, F.max("lat") + HALO * size]
    active = written(placed.groupBy("_net", "strip", "cell").agg(F.concat(F.array(*first), F.array_repeat(F.lit(float("nan")), 60)).alias("boxes")))
    hulls = written(_hulls(placed))
    schema = f"_net string, strip int, cell int, a {points.schema['site'].dataType.simpleString()}, b {points.schema['site'].dataType.simpleString()}, c {points.schema['site'].dataType.simpleString()}, boxes array<double>"

    def one(key, own: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("site", ignore_index=True)
        boxes = np.array(about["boxes"].iloc[0], float).reshape(16, 4)
        corners = np.array([[c["lon"], c["lat"]] for c in about["corners"].iloc[0]], float)
        mine = ((own["strip"] == key[1]) & (own["cell"] == key[2])).to_numpy()
        tri, again = tile_triangles(own[["lon", "lat"]].to_numpy(float), mine, boxes, int(about["reach"].iloc[0]), corners)
        head = {"_net": key[0], "strip": key[1], "cell": key[2]}
        if again is not None:
            return pd.DataFrame([head | {"a": None, "b": None, "c": None, "boxes": again.ravel().tolist()}])
        site = own["site"].to_numpy()
        tri = np.sort(tri, axis=1)
        return pd.DataFrame({**head, "a": site[tri[:, 0]], "b": site[tri[:, 1]], "c": site[tri[:, 2]], "boxes": None})

    done, n_shuffle = [], int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = 0
    while True:
        about = active.join(nets.select("_net", "m", "lon0", "lon1", "lat0", "lat1"), "_net")
        inside = lambda c, a, b: F.greatest(F.lit(0), F.least(F.col("m") - 1, F.floor((F.col(c) - F.col(a)) / span(a, b) * F.col("m")).cast("int")))
        box = lambda i: F.element_at("boxes", F.col("k") * 4 + i)
        cells = about.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumns({"x0": box(1), "x1": box(2), "y0": box(3), "y1": box(4)}).where("not isnan(x0)")
        cells = cells.withColumn("bx", F.explode(F.sequence(inside("x0", "lon0", "lon1"), inside("x1", "lon0", "lon1")))).withColumn("by", F.explode(F.sequence(inside("y0", "lat0", "lat1"), inside("y1", "lat0", "lat1"))))
        cells = cells.select("_net", "bx", "by", F.col("strip").alias("s"), F.col("cell").alias("k"), "x0", "x1", "y0", "y1")
        seen = placed.join(cells, ["_net", "bx", "by"]).where("lon between x0 and x1 and lat between y0 and y1").select("_net", "s", "k", "site", "lon", "lat", "strip", "cell").distinct()
        # a tile is little data and much work: partitions by tiles, not by bytes
        n = max(n_shuffle, active.count() // TILES_IN_TASK)
        one_side, other = seen.repartition(n, "_net", "s", "k"), active.join(hulls, "_net").withColumn("reach", F.lit(reach)).repartition(n, "_net", "strip", "cell")
        rows = one_side.groupBy("_net", "s", "k").cogroup(other.groupBy("_net", "strip", "cell")).applyInPandas(one, schema)
        rows = written(rows)
        done.append(rows.where("a is not null").select("_net", "a", "b", "c"))
        active = rows.where("a is null").select("_net", "strip", "cell", "boxes")
        reach += 1
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)


def edges(found: DataFrame) -> DataFrame:
    """_net, src and dst of every edge of triangles, both ways, each once."""
    ends = F.array(*(F.struct(F.col(s).alias("src"), F.col(t).alias("dst")) for s in "abc" for t in "abc" if s != t))
    return found.select("_net", F.explode(ends).alias("e")).select("_net", "e.src", "e.dst").where("src <> dst").distinct()
