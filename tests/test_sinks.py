"""Partitioned sinks: files follow the partitions, not the tasks."""

from pyspark.sql import functions as F

from geostrain.sources import stations


def test_a_file_for_each_partition(spark, tmp_path):
    """Every task wrote a file into every partition."""
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 20).alias("box"), "id")
    stations.save(rows, str(tmp_path / "t"), ["box"])
    assert len(list((tmp_path / "t").glob("box=*/*.parquet"))) == 20
    assert stations.load(spark, str(tmp_path / "t")).count() == 4000
