"""Pairs of stations in blocks: spread over tasks, complete, and summed like the plain forms."""

import numpy as np
from pyspark.sql import functions as F

from geostrain.operators import aggregates as A
from geostrain.plans import registry


def _sites(spark, n):
    return spark.range(1, n + 1).selectExpr("id AS site", "double(id * 7919 % 1009) / 100 AS lon", "double(id * 104729 % 997) / 100 AS lat", "double(id * 31 % 83) / 9 AS v").coalesce(1)


def test_pairs_of_one_small_file_meet_in_many_tasks(spark):
    """A small table was broadcast and its one task made every pair."""
    pairs = A.site_pairs(_sites(spark, 500))
    got = pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 500 * 499 // 2
    assert len(got) >= 16 and max(r.n for r in got) < 500 * 499 // 2 // 4
    matrix = A.pair_matrix(_sites(spark, 90).select("site"), _sites(spark, 70).select(F.col("site").alias("other")), "site", "other")
    assert matrix.distinct().count() == matrix.count() == 90 * 70
    assert matrix.select(F.spark_partition_id()).distinct().count() >= 8


def test_medians_by_cells_are_exact(spark):
    rng = np.random.default_rng(5)
    values = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 1001), (3, 5000)) for v in rng.exponential(2, n) % 10]
    values += [(4, 3.0)] * 7 + [(4, 9.999)] * 7 + [(5, 0.0), (5, 0.0)]
    got = {r.k: r.m for r in A.medians_by_cells(spark.createDataFrame(values, "k int, x double"), ["k"], "x", 10.0).collect()}
    assert got == {k: float(np.median([v for i, v in values if i == k])) for k in range(6)}


def test_no_median_state_and_no_regrouped_pairs(spark, sf):
    """Whole medians and groups of one pair kept a state for each pair."""
    plan = lambda name: registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median(" not in plan("A12_structure_function") and "percentile" not in plan("A12_structure_function_log")
    assert "aggregate" not in plan("L11_pair_betas")


def test_correlation_is_that_of_distinct_values(spark):
    pairs = A.site_pairs(_sites(spark, 120)).withColumn("dist", F.sqrt((F.col("lon1") - F.col("lon2")) ** 2 + (F.col("lat1") - F.col("lat2")) ** 2)).withColumnsRenamed({"v1": "a1"}).withColumn("b2", F.when(F.col("site2") % 9 != 0, F.col("v2")))
    rows = pairs.select("dist", "a1", "b2").toPandas()
    for r in A.correlation_bins(pairs, [0.0, 2.0, 6.0], 2).collect():
        own = rows[(rows.dist < 2) if r.bin == 0 else (rows.dist >= 2) & (rows.dist <= 6)]
        a, b = own.a1.drop_duplicates(), own.b2.dropna().drop_duplicates()
        p = (own.a1 - a.mean()) * (own.b2 - b.mean()) / (a.std(ddof=0) * b.std(ddof=0))
        assert r.n == len(own) and abs(r.corr - p.sum() / (len(own) - 1)) < 1e-9


def test_blocks_of_sites_meet_once(spark, sf):
    """Every two blocks met both ways, and half of what they made was thrown away; a round went by decimal text."""
    sites = _sites(spark, 600).unionByName(_sites(spark, 1).withColumn("site", F.lit(None).cast("long")))
    assert A.site_pairs(sites).distinct().count() == A.site_pairs(sites).count() == 600 * 599 // 2
    import __spark_entry__  # noqa: F401, the catalog

    for name in ("L11_pair_betas", "L14_kernel_of_distance", "L15_two_sample_variance"):
        assert "xxhash64" not in registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_by_arithmetic(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(0, 1, 2000).tolist(), *rng.normal(0, 1e-6, 500).tolist(), 0.0, -0.0, -2e-7, 0.5e-6, -1.5e-6, 3e15, -7.25e300, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", A.rounded(F.col("x")).alias("a"), F.round("x", 6).alias("b")).collect()
    same = [r for r in rows if r.a == r.b or r.a != r.a and r.b != r.b]
    assert len(same) == len(values) and all(np.copysign(1, r.a) == 1 for r in rows if r.a == 0)


def test_pairs_of_names_and_of_repeated_ids(spark):
    names = spark.createDataFrame([(f"s{i}", float(i)) for i in range(40)], "site string, v double")
    assert A.site_pairs(names).where("site1 < site2").count() == 40 * 39 // 2
    twice = spark.createDataFrame([(i // 2, float(i)) for i in range(80)], "site long, v double")
    assert A.site_pairs(twice).count() == 40 * 39 // 2 * 4
