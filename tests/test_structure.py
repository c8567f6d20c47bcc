"""The structure function from blocks of sites: equal to that of rows of pairs, which are no rows any more."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrain.operators import aggregates as A
from geostrain.operators import structure as S
from geostrain.plans import registry


def _by_rows(sites, spacing, km):
    pairs = A.site_pairs(sites).withColumn("dist", F.sqrt((F.col("lon1") - F.col("lon2")) ** 2 + (F.col("lat1") - F.col("lat2")) ** 2))
    return {r.bin: (r.centre, r.ssf) for r in A.structure_function(pairs, [], spacing, km=km).collect()}


@pytest.mark.parametrize("km", [True, False])
def test_blocks_give_what_rows_of_pairs_give(spark, monkeypatch, km):
    """Ties, repeated ids, equal places, missing values and distances on the edges of bins."""
    rng = np.random.default_rng(8)
    rows = [(int(i), round(float(rng.integers(0, 60)) / 10, 2), round(float(rng.integers(0, 60)) / 10, 2), round(float(rng.normal(0, 4)), 1 + i % 3)) for i in rng.integers(0, 170, 200)]
    rows += [(900, float("nan"), 1.0, 1.0), (901, None, 1.0, 1.0), (902, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0), (903, 1.0, 1.0, float("nan"))]
    sites = spark.createDataFrame(rows, "site long, lon double, lat double, v double")
    expected = _by_rows(sites, 0.5 if km else 0.25, km)
    for values in (S.VALUES, 40):  # few values at once: cells are divided
        monkeypatch.setattr(S, "VALUES", values)
        got = {r.bin: (r.centre, r.ssf) for r in S.network_function(sites, 0.5 if km else 0.25, km=km).collect()}
        assert got.keys() == expected.keys() and len(got) > 3
        assert all(got[k] == pytest.approx(expected[k], rel=1e-12) for k in got)


def test_small_networks(spark):
    names = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.3, 0.0, 2.0), ("c", 0.0, 0.4, 4.0)], "site string, lon double, lat double, v double")
    for sites in (names, names.limit(1), names.limit(0)):
        got = {r.bin: (r.centre, r.ssf) for r in S.network_function(sites, 0.1, km=True).collect()}
        expected = _by_rows(sites, 0.1, True)
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got) and got[-1] == (0.0, 1.0)


def test_bins_are_those_of_the_logarithm():
    least = S.least_of_bins(0.25, 16)
    near = np.concatenate([[math.nextafter(x, 0), x, math.nextafter(x, 9e9)] for x in least])
    dist = np.r_[near, np.random.default_rng(4).exponential(1, 4000), 0.1, 1.0, 10.0, 1e-9, 1e9]
    inside = [math.floor((math.log10(x) + 2) / 0.25) for x in dist.tolist()]
    assert S.bins_from(least)(dist).tolist() == [min(16, max(-1, k)) for k in inside]


def test_pairs_are_no_rows(spark, sf):
    """Every pass made each pair a row of a join: 65 billion pairs of 360,000 sites, three times."""
    import __spark_entry__  # noqa: F401, the catalog

    for name in ("A12_structure_function", "A12_structure_function_log"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and "_b1" not in plan
    sites = spark.range(3000).selectExpr("id AS site", "rand(1) * 9 AS lon", "rand(2) * 9 AS lat", "rand(3) AS v")
    assert S.tiles(sites).count() == S.LEAST_BLOCKS * (S.LEAST_BLOCKS + 1) // 2
