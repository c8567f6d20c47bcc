"""Copies of sites in the meetings of blocks: bounded for each site, whatever the network."""

import re

from geostrain.operators import aggregates as A


def test_copies_grow_with_the_sites(spark, monkeypatch):
    """A site was copied for every 1024 others: what was shuffled grew with the square of the sites."""
    monkeypatch.setattr(A, "PAIR_BLOCK", 4)
    sites = spark.range(1, 601).selectExpr("id AS site", "double(id % 83) AS v")
    pairs = A.site_pairs(sites)
    matrix = A.pair_matrix(sites.selectExpr("site AS i", "v"), sites.selectExpr("site AS j", "v AS w").limit(90), "i", "j")
    for df, count in ((pairs, 600 * 599 // 2), (matrix, 600 * 90)):
        plan = df._jdf.queryExecution().analyzed().toString()
        ends = [int(x) for x in re.findall(r"sequence\([^)]*?, (\d+), ", plan)]
        assert ends and max(ends) < 44
        assert df.distinct().count() == df.count() == count
