"""Station lists, series and steps from text; tables as sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import geodesic_forward

from ..functions import time as T
from ..operators.filters import in_box

#: Providers: where their lists and series are (fixed values by source; paths are the caller's).
PROVIDERS = {
    "jpl": {"suffix": ".series", "epoch": 2000.0, "frame": "IGS14", "ellipsoid": "WGS84"},
    "unr": {"suffix": ".tenv3", "epoch": 2000.0, "frame": "IGS14", "ellipsoid": "WGS84"},
    "cors": {"suffix": None, "epoch": 2010.0, "frame": "IGS14", "ellipsoid": "GRS80"},
}
#: Column names of the two series layouts, by position (fixed values).
JPL_COLUMNS = "decimal_yr e n v sn se sv en_cor ev_cor nv_cor J2000_time_s yyyy mm dd h m s".split()
UNR_COLUMNS = "site yyyymmdd decimal_yr MJD GNSS_week day ref_lon e0 east n0 north v0 v ant se sn sv en_cor ev_cor nv_cor lat lon h".split()
#: ITRF2014 plate rotation vectors, degrees per million years (fixed values).
ITRF2014 = [
    ("ANTA", -0.0688, -0.0900, 0.1874),
    ("ARAB", 0.3205, -0.0378, 0.4011),
    ("AUST", 0.4194, 0.3284, 0.3375),
    ("EURA", -0.0235, -0.1476, 0.2140),
    ("INDI", 0.3205, -0.0014, 0.4038),
    ("NAZC", -0.0925, -0.4290, 0.4508),
    ("NOAM", 0.0066, -0.1928, -0.0176),
    ("NUBI", 0.0274, -0.1704, 0.2037),
    ("PCFC", -0.1135, 0.2907, -0.6025),
    ("SOAM", -0.0751, -0.0835, -0.0389),
    ("SOMA", -0.0336, -0.2206, 0.2454),
]


def plates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITRF2014, "plate string, omega_x double, omega_y double, omega_z double")


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def wrapped_longitude(lon: Column) -> Column:
    """Longitude within 180 degrees of 0; halves round to even."""
    return lon - F.rint(lon / 360) * 360


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of one file with their row numbers from 0.

    A station list is one short file: its order is that of one partition.
    """
    return lines.coalesce(1).withColumn("_i", F.monotonically_increasing_id())


def station_list_jpl(lines: DataFrame, snwe: list[float] | None = None, skip: int = 7) -> DataFrame:
    """Alternating lines after a header: position (site, type, lat, lon), velocity (site, type, n, e, v, sn, se, sv)."""
    rows = numbered(lines).where(F.col("_i") >= skip).select(((F.col("_i") - skip) / 2).cast("long").alias("k"), ((F.col("_i") - skip) % 2).alias("odd"), _fields(F.col("value")).alias("f"))
    at = lambda i: F.col("f")[i].cast("double")
    position = rows.where("odd = 0").select("k", F.col("f")[0].alias("site"), at(2).cast("float").alias("lat"), at(3).cast("float").alias("lon"))
    velocity = rows.where("odd = 1").select("k", *(at(2 + i).alias(c) for i, c in enumerate(("n", "e", "v", "sn", "se", "sv"))))
    out = position.join(velocity, "k").drop("k")
    return out if snwe is None else out.where(in_box(F.col("lat"), F.col("lon"), snwe))


def station_list_unr(lines: DataFrame, snwe: list[float] | None = None) -> DataFrame:
    """Site, position, first and last date, duration in years; the first line is a header."""
    f = F.col("f")
    rows = numbered(lines).where("_i > 0").select(_fields(F.col("value")).alias("f"))
    out = rows.select(f[0].alias("site"), f[1].cast("double").cast("float").alias("lat"), wrapped_longitude(f[2].cast("double")).cast("float").alias("lon"), F.to_date(f[7]).alias("start_date"), F.to_date(f[8]).alias("end_date"))
    out = out.withColumn("duration", (F.datediff("end_date", "start_date") / 365.25).cast("float"))
    return out if snwe is None else out.where(in_box(F.col("lat"), F.col("lon"), snwe))


def read_series(spark: SparkSession, paths: list[str] | str, layout: str) -> DataFrame:
    """Series files of a provider; the site is the file's name, or its first column."""
    rows = spark.read.text(paths).select(_fields(F.col("value")).alias("f"), F.col("_metadata.file_name").alias("file"))
    names = JPL_COLUMNS if layout == "jpl" else UNR_COLUMNS
    text = {"site", "yyyymmdd"} if layout == "unr" else set()
    whole = {"MJD", "GNSS_week", "day"}
    rows = rows.where((F.size("f") == len(names)) & (F.col("f")[2].try_cast("double").isNotNull()))
    kind = lambda c: "string" if c in text else "int" if c in whole else "double"
    out = rows.select(*(F.col("f")[i].cast(kind(c)).alias(c) for i, c in enumerate(names)), "file")
    if layout == "jpl":
        return out.withColumn("site", F.regexp_extract("file", r"^([^.]+)", 1)).drop("file").withColumn("time", T.epoch_of_parts(*(F.col(c) for c in ("yyyy", "mm", "dd", "h", "m", "s"))))
    return out.drop("file").withColumn("d", T.parse_yymmmdd(F.col("yyyymmdd")))


def read_steps(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """Steps of known sites: earthquake rows (7 fields) and, once each, the other rows.

    The last line of the file is incomplete and left out.
    """
    rows = numbered(lines)
    last = rows.agg(F.max("_i").alias("_last"))
    rows = rows.crossJoin(F.broadcast(last)).where("_i < _last").select(_fields(F.col("value")).alias("f"))  # one row
    rows = rows.withColumn("site", F.col("f")[0]).join(sites.select("site"), "site", "left_semi")
    f = F.col("f")
    quake = rows.where(F.size("f") > 5).select("site", f[1].alias("date"), f[2].alias("code"), f[6].alias("description"), f[3].cast("double").alias("threshold_distance"), f[4].cast("double").alias("site_distance_from_eq"), f[5].cast("double").alias("mag"))
    other = rows.where(F.size("f") <= 5).select("site", f[1].alias("date"), f[2].alias("code"), f[3].alias("description")).distinct()
    return other.unionByName(quake, allowMissingColumns=True).withColumn("d", T.parse_yymmmdd(F.col("date")))


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files to fetch: the wanted names that aren't there yet."""
    return wanted.join(present.select("name"), "name", "left_anti")


def series_paths(sites: DataFrame, base: str, provider: str) -> DataFrame:
    """Name and path of each site's series file."""
    suffix = PROVIDERS[provider]["suffix"]
    if suffix is None:
        raise ValueError(f"{provider} has no series")
    return sites.select("site", F.concat("site", F.lit(suffix)).alias("name"), F.concat(F.lit(base.rstrip("/") + "/"), "site", F.lit(suffix)).alias("ts_path"))


def save(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write a table, by partitions of ``keys``; written partitions replace themselves alone.

    Rows are dealt by ``keys`` before, so that there is a file for each partition and
    not one for each task and partition; adaptive execution divides large ones.
    """
    writer = (df.hint("rebalance", *keys) if keys else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pairs(pairs: DataFrame, kept_path: str, dropped_path: str) -> None:
    """Kept and dropped interferograms as blank-separated text."""
    name = F.concat_ws("_", F.date_format("date1", "yyyyMMdd"), F.date_format("date2", "yyyyMMdd")).alias("pair")
    for flag, path in ((True, kept_path), (False, dropped_path)):
        pairs.where(F.col("kept") == flag).select(name, "days").write.mode("overwrite").csv(path, sep=" ", header=True)


def metadata_box(meta: DataFrame, snwe: list[float]) -> DataFrame:
    """Pixel box and extent of a geographic subset, from a table with a ``meta`` map."""
    v = lambda k: F.col("meta")[k].cast("double")
    y = lambda lat: F.floor((F.lit(lat) - v("Y_FIRST")) / v("Y_STEP") + 0.01).cast("int")
    x = lambda lon: F.floor((F.lit(lon) - v("X_FIRST")) / v("X_STEP") + 0.01).cast("int")
    rows = meta.select(y(snwe[1]).alias("y0"), y(snwe[0]).alias("y1"), x(snwe[2]).alias("x0"), x(snwe[3]).alias("x1"), v("HEADING").alias("heading"), v("Y_FIRST").alias("_yf"), v("Y_STEP").alias("_ys"), v("X_FIRST").alias("_xf"), v("X_STEP").alias("_xs"))
    extent = F.array(F.col("_xf") + F.col("x0") * F.col("_xs"), F.col("_xf") + F.col("x1") * F.col("_xs"), F.col("_yf") + F.col("y1") * F.col("_ys"), F.col("_yf") + F.col("y0") * F.col("_ys"))
    return rows.select("y0", "y1", "x0", "x1", "heading", extent.alias("extent"))


def profile_segments(points: DataFrame) -> DataFrame:
    """Segments between consecutive vertices of a line."""
    w = Window.partitionBy("line").orderBy("seq")
    return points.withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)}).where("lon2 is not null")


def station_positions(series: DataFrame, keys: list[str], order: str = "d") -> DataFrame:
    """Position of each station at its first epoch: from the reference longitude on the equator by east and north metres.

    ``series``: keys, order, ref_lon, e0, east, n0, north (whole and fractional
    metres).  Of epochs that are equal the least values count; a null in them
    gives a null position.
    """
    first = series.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.min(F.struct(order, "ref_lon", "e0", "east", "n0", "north")).alias("_f"))
    e, n = F.col("_f.e0") + F.col("_f.east"), F.col("_f.n0") + F.col("_f.north")
    to = geodesic_forward(F.col("_f.ref_lon"), F.lit(0.0), F.degrees(F.atan2(e, n)), F.sqrt(e * e + n * n))
    return first.select(*keys, F.col(f"_f.{order}").alias(order), to.alias("_p")).select(*keys, order, "_p.lon", "_p.lat")
