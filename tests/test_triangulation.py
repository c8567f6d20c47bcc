"""Tiled triangulation against the empty-circle rule and against one task; interpolation over a cell index."""

import itertools

import numpy as np
import pandas as pd
import pytest

from geostrain.operators import network, plates, triangulation
from geostrain.operators.plates import hull


def test_empty_circles_fill_the_hull():
    rng = np.random.default_rng(4)
    for p in (rng.random((60, 2)), rng.normal(size=(200, 2)) * [1, 1e-3], np.c_[rng.random(50), rng.random(50)] * 1e4 - 5e5):
        tri = triangulation.delaunay(*p.T)
        centre, radius = triangulation.circles(p, tri)
        for c, r in zip(centre, radius, strict=True):
            assert (((p - c) ** 2).sum(1) < r**2 * (1 - 1e-7)).sum() == 0
        assert len(tri) == 2 * len(p) - 2 - len(plates.hull(*p.T))


def test_degenerate_points():
    assert len(triangulation.delaunay([0, 1, 2, 5], [0, 1, 2, 5])) == 0 and len(triangulation.delaunay([], [])) == 0
    assert len(triangulation.delaunay([1, 1, 1], [2, 2, 2])) == 0
    square = triangulation.delaunay([0, 1, 1, 0, 1, 0.5], [0, 0, 1, 1, 1, 0])  # an equal point, and one on a side
    assert sorted(np.unique(square)) == [0, 1, 2, 3, 5] and len(square) == 3


def test_box_of_cut_circle():
    corners = np.array([[0.0, 0], [4, 0], [4, 2], [0, 2]])
    rng = np.random.default_rng(2)
    for _ in range(200):
        c, r = rng.uniform(-3, 7, 2), rng.uniform(0.1, 6)
        at = rng.uniform(0, 1, (4000, 2)) * [4, 2]
        at = at[((at - c) ** 2).sum(1) < r * r]
        box = triangulation.box_of_cut_circle(c, r, corners)
        if len(at):
            assert box[0] <= at[:, 0].min() and box[1] >= at[:, 0].max() and box[2] <= at[:, 1].min() and box[3] >= at[:, 1].max()


def points(kind, rng):
    if kind == "uniform":
        return rng.random((1200, 2))
    if kind == "clusters":
        return np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 1, 300), ((5, 5), 0.01, 700), ((0, 40), 0.05, 200))])
    return np.stack(np.meshgrid(np.arange(25.0), np.arange(30.0)), -1).reshape(-1, 2)  # circles through four points everywhere


def frame(spark, p, **more):
    return spark.createDataFrame(pd.DataFrame({"site": np.arange(len(p)), "lon": p[:, 0], "lat": p[:, 1], **more})).repartition(4)


@pytest.mark.parametrize("kind", ["uniform", "clusters", "lattice"])
def test_tiles_equal_one_task(spark, kind, monkeypatch):
    p = points(kind, np.random.default_rng(7))
    want = {tuple(sorted(t)) for t in triangulation.delaunay(*p.T).tolist()}
    got = [(r.a, r.b, r.c) for r in triangulation.triangles(frame(spark, p), tile=100).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_task_holds_all_points(spark, tmp_path):
    """The largest group of points that a tile sees, counted by the kernel itself."""
    seen = []
    inner = triangulation.tile_triangles

    def spy(p, own, boxes, reach, corners):
        (tmp_path / f"{len(p)}-{len(seen)}-{np.random.default_rng().integers(1 << 60)}").touch()
        return inner(p, own, boxes, reach, corners)

    triangulation.tile_triangles = spy
    try:
        triangulation.triangles(frame(spark, np.random.default_rng(1).random((3000, 2))), tile=100).count()
    finally:
        triangulation.tile_triangles = inner
    sizes = [int(f.name.split("-")[0]) for f in tmp_path.iterdir()]
    assert max(sizes) < 1500


def test_networks_nulls_and_equal_positions(spark):
    rng = np.random.default_rng(3)
    p = rng.random((80, 2))
    rows = [(i, float(x), float(y), "ab"[i % 2]) for i, (x, y) in enumerate(p)]
    rows += [(900, *rows[0][1:]), (901, None, 1.0, "a"), (902, float("nan"), 1.0, "b"), (903, 5.0, 5.0, "alone"), (904, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "site long, lon double, lat double, net string")
    got = {(r.src, r.dst) for r in network.neighbours(df, "net").collect()}
    want = set()
    for net in "ab":
        own = [r for r in rows[:80] if r[3] == net]
        tri = triangulation.delaunay([r[1] for r in own], [r[2] for r in own])
        want |= {(own[a][0], own[b][0]) for a, b in triangulation.triangle_edges(tri).tolist()}
    assert got == want
    assert network.neighbours(df.limit(0)).count() == 0


def test_interpolation_equals_barycentric(spark):
    rng = np.random.default_rng(5)
    p, v = rng.random((150, 2)) * [3, 1], rng.normal(size=(150, 2))
    t = np.concatenate([rng.random((700, 2)) * [3.6, 1.2] - [0.3, 0.1], p[:20], [[9.0, 9.0]]])
    df = frame(spark, p, v=v[:, 0], w=v[:, 1])
    targets = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(t)), "lon": t[:, 0], "lat": t[:, 1]})).repartition(3)
    got = network.interpolate(df, targets, ["v", "w"]).toPandas().sort_values("k")
    want = network.barycentric(p, triangulation.delaunay(*p.T), v, *t.T)
    assert np.allclose(got[["v", "w"]].to_numpy(float), want, equal_nan=True, atol=1e-7) and np.isfinite(want).any() and np.isnan(want).any()
    flat = network.interpolate(df.where("site < 2"), targets, ["v"])
    assert flat.count() == len(t) and flat.where("v is not null").count() == 0
    plan = network.interpolate(df, targets, ["v"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_edges_of_triangles():
    tri = np.array([[0, 1, 2], [1, 3, 2]])
    assert {tuple(e) for e in triangulation.triangle_edges(tri).tolist()} == {e for a, b in ((0, 1), (1, 2), (0, 2), (1, 3), (2, 3)) for e in itertools.permutations((a, b))}


def rounded_lattice(box):
    """Sites of 60 copies of a table: a quarter of a lattice of hundredths, in a box."""
    k = np.arange(60_000)
    p = np.c_[-120 + ((k * k * 37 + k * 101) % 1009) / 100, 33 + ((k * k * 53 + k * 211) % 997) / 100]
    p = p[(p[:, 0] > box[0]) & (p[:, 0] < box[1]) & (p[:, 1] > box[2]) & (p[:, 1] < box[3])]
    return p[np.sort(np.unique(p, axis=0, return_index=True)[1])]


@pytest.mark.parametrize("box", [(-119.2, -118.0, 33.0, 34.0), (-118.4, -117.2, 34.6, 35.7)])
def test_triangles_of_a_rounded_lattice_cover_their_hull_once(box):
    """Tolerances broke the cavities: triangles multiplied until a tile never ended."""
    p = rounded_lattice(box)
    tri = triangulation.delaunay(*p.T)
    a, b, c = (p[tri[:, i]] for i in range(3))
    area = 0.5 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    h = p[hull(*p.T)]
    whole = 0.5 * abs((h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)).sum())
    assert len(tri) < 2 * len(p) and (area > 0).all() and abs(area.sum() - whole) < 1e-9


def test_tiles_of_a_rounded_lattice_agree(spark):
    p = rounded_lattice((-119.2, -118.0, 33.0, 34.0))
    want = {tuple(sorted(t)) for t in triangulation.delaunay(*p.T).tolist()}
    got = [(r.a, r.b, r.c) for r in triangulation.triangles(frame(spark, p), tile=100).collect()]
    assert len(got) == len(set(got)) and set(got) == want
