"""Queries of the remaining operators: sinks, pair tables, grids, batch fits, covariance estimates."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import models as M
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import geostatistics as GS
from ..operators import collocation, network, plates, regression, robust
from ..sources import stations as S
from ..sources.shared import shared_dir
from .catalog_series import NEIGHBOURS
from .ellipsoid import distances
from .registry import query
from .views import duck, view

c, lit = F.col, F.lit


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"


_PAIRS = "SELECT a.site AS site1, b.site AS site2, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM v_sites a JOIN v_sites b ON a.site < b.site"


@query("S02_providers", "SELECT * FROM (VALUES ('jpl', '.series', 2000e0), ('unr', '.tenv3', 2000e0), ('cors', NULL, 2010e0)) t(name, suffix, epoch)")
def s02(spark, sf) -> DataFrame:
    return spark.createDataFrame([(k, v["suffix"], v["epoch"]) for k, v in S.PROVIDERS.items()], "name string, suffix string, epoch double")


@query("S07_series_reader", duck("SELECT CAST(site AS VARCHAR) AS site, d, days_between(DATE '1858-11-17', d) AS mjd, round(disp, 6) AS east, round(-disp, 6) AS north, 0.25e0 AS v FROM v_series"))
def s07(spark, sf):
    path = _shared(spark)
    text = {"site": c("site").cast("string"), "yyyymmdd": F.upper(F.date_format("d", "yyMMMdd")), "MJD": F.datediff("d", lit("1858-11-17").cast("date")), "east": F.format_string("%.6f", "disp"), "north": F.format_string("%.6f", -c("disp")), "v": lit("0.250000")}
    line = F.concat_ws("  ", *(text.get(k, lit("0")).cast("string") for k in S.UNR_COLUMNS))
    view(spark, sf, "v_series").select(line.alias("value")).write.text(path)
    return S.read_series(spark, path, "unr").select("site", "d", c("MJD").alias("mjd"), "east", "north", "v")


@query("S09_save_and_load", duck("SELECT site, lon, lat, v, sv FROM v_sites"))
def s09(spark, sf):
    path = _shared(spark)
    S.save(view(spark, sf, "v_sites"), path)
    return S.load(spark, path)


@query("S11_block_sink", duck("SELECT CAST(floor(y / 8e0) AS INT) AS box, count(*) AS n, round(sum(disp), 6) AS total FROM v_pixel GROUP BY 1"))
def s11(spark, sf):
    path = _shared(spark)
    S.save(view(spark, sf, "v_pixel").withColumn("box", F.floor(c("y") / 8.0).cast("int")), path, ["box"])
    return S.load(spark, path).groupBy("box").agg(F.count("*").alias("n"), r6(F.sum("disp"), "total"))


@query("S19_pair_lists", duck("SELECT strftime(date1, '%Y%m%d') || '_' || strftime(date2, '%Y%m%d') AS pair, CAST(days_between(date1, date2) AS VARCHAR) AS days FROM v_ifg WHERE days_between(date1, date2) BETWEEN 30 AND 62", "v_ifg"))
def s19(spark, sf):
    path = _shared(spark)
    S.write_pairs(FL.select_interferograms(view(spark, sf, "v_ifg"), None, 30, 62), f"{path}/kept", f"{path}/dropped")
    return spark.read.csv(f"{path}/kept", sep=" ", header=True, schema="pair string, days string")


@query("F04_outliers", duck("r AS (SELECT sqrt(avg(v * v)) AS r FROM v_sites) SELECT site FROM v_sites, r WHERE abs(v) <= 1.5e0 * r"))
def f04(spark, sf):
    return FL.without_outliers(view(spark, sf, "v_sites"), ["v"], 1.5).select("site")


@query("F14_barrier_between_sets", duck("SELECT a.site AS site1, b.site AS site2, CAST((a.lon <= -115.003e0) <> (b.lon <= -115.003e0) AS INT) AS crosses FROM v_sites a JOIN v_sites b ON a.site % 2 = 0 AND b.site % 2 = 1"))
def f14(spark, sf):
    s = view(spark, sf, "v_sites").select("site", "lon", "lat")
    both = A.site_pairs(s).where("(site1 + site2) % 2 = 1")
    even = lambda k: F.when(c("site1") % 2 == 0, c(f"{k}1")).otherwise(c(f"{k}2")).alias(f"{k}1")
    odd = lambda k: F.when(c("site1") % 2 == 0, c(f"{k}2")).otherwise(c(f"{k}1")).alias(f"{k}2")
    pairs = both.select(*(even(k) for k in s.columns), *(odd(k) for k in s.columns))
    return FL.barrier_mask(pairs, [(-115.003, 0.0, -115.003, 80.0)]).select("site1", "site2", "crosses")


@query("J07_pair_matrix", duck("SELECT a.site AS i, b.site AS j, a.v AS first, b.v AS second FROM v_sites a, v_sites b"))
def j07(spark, sf):
    s = view(spark, sf, "v_sites")
    first, second = s.select(c("site").alias("i"), c("v").alias("first")), s.select(c("site").alias("j"), c("v").alias("second"))
    return A.pair_matrix(first, second, "i", "j")


@query("J10_neighbour_join", duck(NEIGHBOURS + " SELECT src, dst, round(m / 1e3, 4) AS dist, p.v AS v_src, q.v AS v_dst FROM e JOIN v_sites p ON src = p.site JOIN v_sites q ON dst = q.site"))
def j10(spark, sf):
    s = view(spark, sf, "v_sites").select("site", "v")
    e = network.neighbours(view(spark, sf, "v_sites"))
    e = e.withColumn("dist", F.round("dist", 4))
    return e.join(s.withColumnsRenamed({"site": "src", "v": "v_src"}), "src").join(s.withColumnsRenamed({"site": "dst", "v": "v_dst"}), "dst")


@query("M01_geodesic_distance", duck(f"p AS ({_PAIRS}), {distances('p', 'site1, site2')} SELECT site1, site2, round(m / 1000, 6) AS km FROM e"))
def m01(spark, sf):
    p = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    return p.select("site1", "site2", F.round(G.geodesic_distance(c("lon1"), c("lat1"), c("lon2"), c("lat2"), "km"), 6).alias("km"))


@query("M17_window_grid", duck("SELECT DISTINCT y, x, round(36e0 - 0.01e0 * (y + (y / 39e0)), 6) AS lat, round(-118e0 + 0.02e0 * (x + (x / 49e0)), 6) AS lon FROM v_pixel"))
def m17(spark, sf):
    # centres by an inclusive division of the box: a step of span over n - 1
    lat, lon = 36 - 0.01 * 40 / 39 * c("y"), -118 + 0.02 * 50 / 49 * c("x")
    return view(spark, sf, "v_pixel").select("y", "x").distinct().select("y", "x", r6(lat, "lat"), r6(lon, "lon"))


@query("M34_matrix_predicates", "SELECT true AS symmetric, true AS positive, false AS indefinite")
def m34(spark, sf):
    a, b = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([[1.0, 2.0], [2.0, 1.0]])
    return spark.createDataFrame([(regression.is_symmetric(a), regression.is_positive_definite(a), regression.is_positive_definite(b))], "symmetric boolean, positive boolean, indefinite boolean")


@query("M35_scale_by_sill", duck("SELECT site, round(2.5e0 / (0.5e0 + 2 * (1 - exp(-3 * sv / 3e0))), 6) AS scale FROM v_sites"))
def m35(spark, sf):
    m = M.variogram_model("exponential")(c("sv"), lit(2.0), lit(0.5), lit(3.0))
    return view(spark, sf, "v_sites").select("site", r6(2.5 / m, "scale"))


@query("O02_sorted_steps", duck("SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY d) - 1 AS INT) AS pos, d FROM (SELECT DISTINCT site, d FROM v_steps)"))
def o02(spark, sf):
    s = view(spark, sf, "v_steps").groupBy("site").agg(F.sort_array(F.collect_set("d")).alias("ds"))
    return s.select("site", F.posexplode("ds").alias("pos", "d"))


@query("U05_extent_intersection", duck("SELECT max(lat) AS s, min(lat) + 20 AS n, max(lon) AS w, min(lon) + 20 AS e FROM v_sites"))
def u05(spark, sf):
    return view(spark, sf, "v_sites").agg(F.max("lat").alias("s"), (F.min("lat") + 20).alias("n"), F.max("lon").alias("w"), (F.min("lon") + 20).alias("e"))


@query("V02_select_pairs", None)
def v02(spark, sf):
    return robust.pairs_of_sites(view(spark, sf, "v_series"))


@query("V03_design_matrix", duck("SELECT DISTINCT d, round(days_between(DATE '1995-01-02', d) / 365.25e0, 6) AS p1, round(cos(days_between(DATE '1995-01-02', d) / 365.25e0 * 6.283185307179586e0), 6) AS c0 FROM v_series"))
def v03(spark, sf):
    t = F.datediff("d", lit("1995-01-02").cast("date")) / 365.25
    cols = M.time_design(t, 1, [1.0])
    return view(spark, sf, "v_series").select("d").distinct().select("d", r6(cols["p1"], "p1"), r6(cols["c0"], "c0"))


@query("V06_site_fits", None)
def v06(spark, sf):
    return robust.site_fits(view(spark, sf, "v_series"), view(spark, sf, "v_steps"), "ols")


def _pairs(spark, sf):
    s = view(spark, sf, "v_sites")
    p = A.site_pairs(s.select("site", "lon", "lat", c("v").alias("e"), (c("v") / 2).alias("n"), (c("sv") / 5).alias("se"), (c("sv") / 6).alias("sn")))
    return p.withColumn("dist", F.sqrt((c("lon1") - c("lon2")) ** 2 + (c("lat1") - c("lat2")) ** 2) * 100)


@query("L04_station_grid_covariance", duck("SELECT site, x, round(cos(radians(lon - (-120 + x))) * 3 * exp(-100 * sqrt(pow(lon - (-120 + x), 2) + pow(lat - 37, 2)) / 150e0), 6) AS c_nn FROM v_sites, range(10) t(x)"))
def l04(spark, sf):
    grid = F.broadcast(spark.range(10).select(c("id").alias("x"), (-120.0 + c("id")).alias("lon2"), lit(37.0).alias("lat2")))  # ten rows
    rows = view(spark, sf, "v_sites").select("site", c("lon").alias("lon1"), c("lat").alias("lat1")).crossJoin(grid)
    rows = rows.withColumn("dist", 100 * F.sqrt((c("lon1") - c("lon2")) ** 2 + (c("lat1") - c("lat2")) ** 2))
    return GS.signal_covariance(rows, (4.0, 3.0, 1.0), (200.0, 150.0, 100.0)).select("site", "x", r6(c("c_nn"), "c_nn"))


@query("L07_signals_on_regular_grid", None)
def l07(spark, sf):
    xy = spark.range(-6, 7).select((c("id") * 80.0).alias("x")).withColumn("y", F.explode(F.sequence(lit(-480), lit(480), lit(80)).cast("array<double>")))
    grid = xy.select(G.aeqd_inverse(c("x"), c("y"), -115.0, 37.0).alias("p")).select("p.lon", "p.lat")
    obs = view(spark, sf, "v_sites").select("lon", "lat", c("v").alias("ew"), (c("v") / 2).alias("ns"), (c("sv") / 5).alias("noise_ew"), (c("sv") / 6).alias("noise_ns"))
    return collocation.collocate(obs, grid, (4.0, 3.0, 1.0), (200.0, 150.0, 100.0))


@query("L09_weighted_beta_bins", duck("p AS (SELECT radians(a.lat) AS t1, radians(b.lat) AS t2, radians(a.lon - b.lon) AS s, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) * 100 AS dist, a.v AS e1, b.v AS e2, a.sv / 5 AS n1, b.sv / 5 AS n2 FROM v_sites a JOIN v_sites b ON a.site < b.site), f AS (SELECT *, sin(t1) * sin(t2) * cos(s) + cos(t1) * cos(t2) AS f FROM p), b AS (SELECT CAST(floor(dist / 100) AS INT) AS bin, (e1 * e2 - 0.5e0 * pow(n1 - n2, 2)) / f AS beta, (n1 * n1 * n2 * n2 + pow(0.5e0 * pow(n1 - n2, 2), 2)) / (f * f) AS var FROM f) SELECT bin, count(*) AS n, round(sum(beta / var) / sum(1 / var), 5) AS k FROM b GROUP BY bin"))
def l09(spark, sf):
    b = GS.pair_betas(_pairs(spark, sf), wide=True).select(F.floor(c("dist") / 100).cast("int").alias("bin"), c("beta_ee").alias("beta"), c("var_ee").alias("var"))
    return GS.alpha_weighted(b, ["bin"]).select("bin", "n", F.round("k", 5).alias("k"))


@query("L13_factor_products", duck("SELECT a.site AS site1, b.site AS site2, round(pow(cos(radians(a.lon - b.lon)), 2), 6) AS fnn2 FROM v_sites a JOIN v_sites b ON a.site < b.site"))
def l13(spark, sf):
    f = M.angular_factors(c("lon1"), c("lat1"), c("lon2"), c("lat2"))
    return _pairs(spark, sf).select("site1", "site2", r6(f["nn"] * f["nn"], "fnn2"))


@query("L14_kernel_of_distance", duck("SELECT a.site AS site1, b.site AS site2, round(2 * exp(-sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) * 100 / 250e0), 6) AS k FROM v_sites a JOIN v_sites b ON a.site < b.site"))
def l14(spark, sf):
    return _pairs(spark, sf).select("site1", "site2", A.rounded(M.COVARIANCE["gm1"](c("dist"), lit(2.0), lit(250.0))).alias("k"))


@query("L19_hull_vertices", None)
def l19(spark, sf):
    return plates.hull_vertices(view(spark, sf, "v_sites").select("lon", "lat", F.when(c("lon") < -115, 1).otherwise(2).alias("plate_ix")))


@query("P10_station_position", None)
def p10_position(spark, sf):
    rows = view(spark, sf, "v_series").select("site", "d", lit(-115.0).alias("ref_lon"), (c("site") * 100.0).alias("e0"), c("disp").alias("east"), (3.9e6 + c("site") * 50.0).alias("n0"), (-c("disp")).alias("north"))
    return S.station_positions(rows, ["site"])
