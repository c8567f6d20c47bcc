"""Queries without SQL read whole tables: no station and no pixel is left out."""

import pytest

from geostrain.plans import catalog, catalog_solvers, registry
from geostrain.plans.views import view

assert catalog
N = 1010


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """More stations than any bound that the queries had."""
    path = str(tmp_path_factory.mktemp("many"))
    spark.range(1, N + 1).selectExpr("id AS s_suppkey", "double(id * 7919 % 10007) - 900 AS s_acctbal").write.parquet(f"{path}/supplier.parquet")
    return path


def test_all_pairs_of_stations(spark, many):
    run = registry.queries()
    pairs = N * (N - 1) // 2
    assert run["M01_geodesic_distance"](spark, many).count() == pairs
    assert run["J07_pair_matrix"](spark, many).count() == N * N
    assert run["L03_moving_covariance"](spark, many).count() == pairs
    assert catalog_solvers._station_pairs(spark, many).count() == pairs


def test_collocation_of_all_stations(spark, many):
    got = registry.queries()["L05_collocation_at_stations"](spark, many).toPandas()
    assert len(got) == N and got.notna().all(axis=None)


@pytest.mark.parametrize("name, table, keys", [("V08_ml_trend", "v_series", ["site"]), ("V10_pixel_ml_trend", "v_pixel", ["y", "x"]), ("V11_spectrum", "v_series", ["site"])])
def test_every_series(spark, sf, name, table, keys):
    got = registry.queries()[name](spark, sf).select(*keys).distinct().count()
    assert got == view(spark, sf, table).select(*keys).distinct().count()
