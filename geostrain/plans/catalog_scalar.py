"""Queries of sources, filters, joins, dates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import models as M
from ..functions import time as T
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import noise, plates, rasters, regression, robust
from ..sources import stations as S
from .ellipsoid import distances
from .registry import query
from .views import duck, view

c, lit = F.col, F.lit


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def day(text: str):
    return lit(text).cast("date")


# ------------------------------------------------------------ S


@query("S01_missing_files", duck("SELECT CAST(s_suppkey AS VARCHAR) || '.tenv3' AS name FROM supplier WHERE s_suppkey % 3 <> 0"))
def s01(spark: SparkSession, sf: str) -> DataFrame:
    wanted = S.series_paths(view(spark, sf, "supplier").select(c("s_suppkey").cast("string").alias("site")), "/data", "unr").select("name")
    present = view(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.concat(c("s_suppkey").cast("string"), lit(".tenv3")).alias("name"))
    return S.missing_files(wanted, present)


@query("S03_series_paths", duck("SELECT CAST(s_suppkey AS VARCHAR) AS site, CAST(s_suppkey AS VARCHAR) || '.series' AS name, '/data/' || CAST(s_suppkey AS VARCHAR) || '.series' AS ts_path FROM supplier"))
def s03(spark, sf):
    return S.series_paths(view(spark, sf, "supplier").select(c("s_suppkey").cast("string").alias("site")), "/data/", "jpl")


@query("S04_station_list_jpl", duck("SELECT CAST(site AS VARCHAR) AS site, round(CAST(CAST(lat AS FLOAT) AS DOUBLE), 4) AS lat, round(CAST(CAST(lon AS FLOAT) AS DOUBLE), 4) AS lon, round(v, 6) AS v, round(sv, 6) AS sv FROM v_sites WHERE CAST(lat AS FLOAT) BETWEEN 34 AND 42 AND CAST(lon AS FLOAT) BETWEEN -119 AND -111"))
def s04(spark, sf):
    sites = view(spark, sf, "v_sites")
    two = F.array(F.concat_ws(" ", "site", lit("POS"), "lat", "lon"), F.concat_ws(" ", "site", lit("VEL"), lit("0"), lit("0"), "v", lit("1"), lit("1"), "sv"))
    lines = sites.coalesce(1).select(F.explode(two).alias("value"))
    head = spark.range(0, 7, 1, 1).select(lit("header").alias("value"))
    got = S.station_list_jpl(head.unionByName(lines), [34, 42, -119, -111])
    return got.select("site", F.round(c("lat").cast("double"), 4).alias("lat"), F.round(c("lon").cast("double"), 4).alias("lon"), r6(c("v"), "v"), r6(c("sv"), "sv"))


@query("S05_station_list_unr", duck("SELECT CAST(site AS VARCHAR) AS site, round(CAST(CAST(lon AS FLOAT) AS DOUBLE), 4) AS lon, DATE '2001-01-01' AS start_date, DATE '2001-01-01' + CAST(site * 7 % 5000 AS INT) AS end_date, round(CAST(CAST(CAST(site * 7 % 5000 AS INT) / 365.25e0 AS FLOAT) AS DOUBLE), 4) AS duration FROM v_sites"))
def s05(spark, sf):
    sites = view(spark, sf, "v_sites").coalesce(1)
    end = F.date_add(day("2001-01-01"), (c("site") * 7 % 5000).cast("int"))
    lines = sites.select(F.concat_ws(" ", "site", "lat", c("lon") + 360, lit("0"), lit("x"), lit("y"), lit("z"), lit("2001-01-01"), end).alias("value"))
    head = spark.range(0, 1, 1, 1).select(lit("Sta Lat Long").alias("value"))
    got = S.station_list_unr(head.unionByName(lines))
    return got.select("site", F.round(c("lon").cast("double"), 4).alias("lon"), "start_date", "end_date", F.round(c("duration").cast("double"), 4).alias("duration"))


@query("S08_steps", duck("SELECT DISTINCT CAST(site AS VARCHAR) AS site, d, CASE WHEN site % 4 = 0 THEN 7.1e0 END AS mag FROM v_steps"))
def s08(spark, sf):
    steps = view(spark, sf, "v_steps").coalesce(1)
    date = F.upper(F.date_format("d", "yyMMMdd"))
    plain, quake = F.concat_ws(" ", "site", date, lit("1"), lit("antenna")), F.concat_ws(" ", "site", date, lit("2"), lit("100"), lit("50"), lit("7.1"), lit("event"))
    lines = steps.select(F.when(c("site") % 4 == 0, quake).otherwise(plain).alias("value"))
    tail = spark.range(0, 1, 1, 1).select(lit("incompl").alias("value"))
    sites = view(spark, sf, "v_sites").select(c("site").cast("string").alias("site"))
    return S.read_steps(lines.unionByName(tail), sites).select("site", "d", "mag").distinct()


@query("S10_subset_reference", duck("r AS (SELECT d, disp AS r FROM v_pixel WHERE y = 1 AND x = 1), b AS (SELECT p.y, p.x, p.d, p.disp - r.r AS disp FROM v_pixel p LEFT JOIN r ON p.d = r.d WHERE p.y < 3), f AS (SELECT y, x, disp AS f FROM b WHERE d = DATE '1995-01-01') SELECT b.y, b.x, b.d, round(b.disp - f.f, 6) + 0e0 AS disp FROM b LEFT JOIN f ON b.y = f.y AND b.x = f.x"))
def s10(spark, sf):
    got = rasters.subset_reference(view(spark, sf, "v_pixel"), "1995-01-01", (1, 1), (0, 3, 0, 1 << 20))
    return got.select("y", "x", "d", (F.round("disp", 6) + 0.0).alias("disp"))


@query("S12_metadata_box", "SELECT 100 AS y0, 300 AS y1, 50 AS x0, 150 AS x1, -12e0 AS heading")
def s12(spark, sf):
    meta = spark.range(1).select(F.create_map(*(lit(x) for kv in {"X_FIRST": "-118.0", "X_STEP": "0.01", "Y_FIRST": "36.0", "Y_STEP": "-0.01", "HEADING": "-12.0"}.items() for x in kv)).alias("meta"))
    return S.metadata_box(meta, [33.0, 35.0, -117.5, -116.5]).drop("extent")


@query("S13_keep_dates", duck("SELECT d, d >= DATE '1993-01-01' AND d <= DATE '1997-06-01' AND month(d) <> 7 AS ok FROM v_acq"))
def s13(spark, sf):
    acq = view(spark, sf, "v_acq")
    return FL.keep_dates(acq, acq.where(F.month("d") == 7), "1993-01-01", "1997-06-01")


@query("S16_profile_segments", duck("SELECT seq, lon, lat, lon2, lat2 FROM (SELECT site AS seq, lon, lat, lead(lon) OVER (PARTITION BY site % 5 ORDER BY site) AS lon2, lead(lat) OVER (PARTITION BY site % 5 ORDER BY site) AS lat2 FROM v_sites) WHERE lon2 IS NOT NULL"))
def s16(spark, sf):
    return S.profile_segments(view(spark, sf, "v_sites").select((c("site") % 5).alias("line"), c("site").alias("seq"), "lon", "lat")).drop("line")


@query("S17_observation_lines", duck("SELECT d - DATE '1858-11-17' AS ord, printf('%.1f %13.6f', CAST(d - DATE '1858-11-17' AS DOUBLE), disp) AS value FROM v_series WHERE site = 1"))
def s17(spark, sf):
    return noise.observation_lines(view(spark, sf, "v_series").where("site = 1")).where("ord > 1000").select(c("ord").cast("long").alias("ord"), "value")


@query("S18_control_periods", "SELECT * FROM (VALUES ('365.250', 'FNWN'), ('182.625', 'FNWN')) t(period_days, noise)")
def s18(spark, sf):
    model = noise.TrendModel()
    return spark.createDataFrame([(p, model.noise) for p in model.periods_in_days()], "period_days string, noise string")


@query("S20_plates", "SELECT 11 AS n, round(sum_z, 6) AS sum_z FROM (SELECT 0.1874e0 + 0.4011 + 0.3375 + 0.2140 + 0.4038 + 0.4508 - 0.0176 + 0.2037 - 0.6025 - 0.0389 + 0.2454 AS sum_z)")
def s20(spark, sf):
    return S.plates(spark).agg(F.count("*").cast("int").alias("n"), r6(F.sum("omega_z"), "sum_z"))


# ------------------------------------------------------------ F


@query("F01_bbox", duck("SELECT site, lon, lat FROM v_sites WHERE lat BETWEEN 35 AND 39 AND lon BETWEEN -118 AND -113"))
def f01(spark, sf):
    return view(spark, sf, "v_sites").where(FL.in_box(c("lat"), c("lon"), [35, 39, -118, -113])).select("site", "lon", "lat")


@query("F02_timespan_start", duck("SELECT site, d FROM (SELECT site, d, max(d) OVER (PARTITION BY site) AS last FROM v_series) WHERE d > DATE '1996-01-01' AND d < last"))
def f02a(spark, sf):
    return FL.timespan(view(spark, sf, "v_series"), "1996-01-01").select("site", "d")


@query("F02_timespan_both", duck("SELECT site, d FROM v_series WHERE d > DATE '1994-01-01' AND d < DATE '1996-06-30'"))
def f02b(spark, sf):
    return FL.timespan(view(spark, sf, "v_series"), "1994-01-01", "1996-06-30").select("site", "d")


@query("F03_duration_filter", duck("s AS (SELECT site, min(d) AS a, max(d) AS b FROM v_series GROUP BY site), t AS (SELECT site, datediff('day', greatest(a, DATE '1997-01-01'), least(b, DATE '2001-06-01')) / 365.25e0 AS years FROM s WHERE b > DATE '2001-01-01') SELECT site, round(years, 6) AS years FROM t WHERE years > 3"))
def f03(spark, sf):
    s = view(spark, sf, "v_series").groupBy("site").agg(F.min("d").alias("a"), F.max("d").alias("b")).where(c("b") > day("2001-01-01"))
    s = s.withColumn("years", FL.refined_duration(c("a"), c("b"), "1997-01-01", "2001-06-01")).where("years > 3")
    return s.select("site", r6(c("years"), "years"))


@query("F05_sequential_outliers", duck("a AS (SELECT sqrt(avg(v * v)) AS r FROM v_sites), p AS (SELECT s.* FROM v_sites s, a WHERE abs(v) <= 1.2e0 * r), b AS (SELECT sqrt(avg(sv * sv)) AS r FROM p) SELECT site, v, sv FROM p, b WHERE abs(sv) <= 1.2e0 * r"))
def f05(spark, sf):
    return FL.without_outliers(view(spark, sf, "v_sites"), ["v", "sv"], 1.2).select("site", "v", "sv")


@query("F06_steps_inside", duck("m AS (SELECT site, min(d) AS lo, max(d) AS hi FROM v_series GROUP BY site) SELECT s.site, s.d FROM v_steps s JOIN m ON s.site = m.site WHERE s.d > lo AND s.d < hi"))
def f06(spark, sf):
    return FL.steps_inside(view(spark, sf, "v_series"), view(spark, sf, "v_steps"))


@query("F07_valid_pixels", duck("SELECT y, x, round(mean, 6) AS mean FROM (SELECT y, x, avg(CASE WHEN x % 7 = 0 THEN 0 ELSE disp END) AS mean FROM v_pixel GROUP BY y, x) WHERE mean <> 0 OR (y = 1 AND x = 7)"))
def f07(spark, sf):
    stack = view(spark, sf, "v_pixel").withColumn("disp", F.when(c("x") % 7 == 0, 0.0).otherwise(c("disp")))
    return FL.valid_pixels(stack, (1, 7)).select("y", "x", r6(c("mean"), "mean"))


@query("F08_densification_mask", duck("SELECT y, x, NOT (n = 24 OR (y = 1 AND x = 1)) AS mask FROM (SELECT y, x, count(*) FILTER (WHERE disp <> 0) AS n FROM v_pixel GROUP BY y, x)"))
def f08(spark, sf):
    return FL.densification_mask(view(spark, sf, "v_pixel"), 25, (1, 1))


_DROPPED = "k AS (SELECT date1, date2 FROM v_ifg WHERE month(date1) = 3)"


@query("F09_select_interferograms", duck(_DROPPED + " SELECT i.date1, i.date2, days_between(i.date1, i.date2) AS days, days_between(i.date1, i.date2) BETWEEN 30 AND 62 AND k.date1 IS NULL AS kept FROM v_ifg i LEFT JOIN k ON i.date1 = k.date1 AND i.date2 = k.date2", "v_ifg"))
def f09(spark, sf):
    ifg = view(spark, sf, "v_ifg")
    return FL.select_interferograms(ifg, ifg.where(F.month("date1") == 3), 30, 62).withColumn("days", c("days").cast("long"))


@query("F09_select_inverted", duck(_DROPPED + " SELECT i.date1, i.date2 FROM v_ifg i JOIN k ON i.date1 = k.date1 AND i.date2 = k.date2 WHERE days_between(i.date1, i.date2) BETWEEN 30 AND 62", "v_ifg"))
def f09i(spark, sf):
    ifg = view(spark, sf, "v_ifg")
    return FL.select_interferograms(ifg, ifg.where(F.month("date1") == 3), 30, 62, invert=True).where("kept").select("date1", "date2")


@query("F10_drop_list", duck("SELECT date1, date2 FROM v_ifg WHERE (date1 = DATE '1995-01-01' AND date2 = DATE '1995-02-01') OR (year(date1) * 12 + month(date1)) * 1000 + days_between(date1, date2) = 23941031", "v_ifg"))
def f10(spark, sf):
    pairs = view(spark, sf, "v_ifg").withColumn("idx", (F.year("date1") * 12 + F.month("date1")) * 1000 + F.datediff("date2", "date1"))
    entries = spark.createDataFrame([("19950101_19950201",), ("23941031",), ("20990101_20990201",)], "entry string")
    return FL.resolve_dropped(pairs, entries).select("date1", "date2")


@query("F11_extent", duck("SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v_pixel WHERE disp > 0.3"))
def f11(spark, sf):
    return FL.extent_of_data(view(spark, sf, "v_pixel").withColumn("disp", F.when(c("disp") > 0.3, c("disp")).otherwise(0.0)), "disp")


@query("F12_coverage", duck("SELECT ty, round(missing, 6) AS missing FROM (SELECT CAST(floor(y / 4e0) AS INT) AS ty, avg(CASE WHEN disp < 0.3e0 THEN 1e0 ELSE 0e0 END) AS missing FROM v_pixel GROUP BY 1) WHERE missing <= 0.5"))
def f12(spark, sf):
    rows = view(spark, sf, "v_pixel").select(F.floor(c("y") / 4.0).cast("int").alias("ty"), F.when(c("disp") >= 0.3, c("disp")).alias("disp"))
    return FL.covered(rows, ["ty"], "disp", 0.5).select("ty", r6(c("missing"), "missing"))


@query("F13_barrier_mask", duck("p AS (SELECT a.site AS site1, b.site AS site2, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM v_sites a JOIN v_sites b ON a.site < b.site) SELECT site1, site2, CAST((lon1 <= -115.003e0) <> (lon2 <= -115.003e0) AS INT) AS crosses FROM p"))
def f13(spark, sf):
    pairs = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    return FL.barrier_mask(pairs, [(-115.003, 0.0, -115.003, 80.0)]).select("site1", "site2", "crosses")


@query("F15_window_box", duck("SELECT DISTINCT y, round(36e0 + (y + 10) * -0.01e0, 6) AS s, round(36e0 + y * -0.01e0, 6) AS n FROM v_pixel"))
def f15(spark, sf):
    box = FL.window_box({"X_FIRST": -118.0, "X_STEP": 0.01, "Y_FIRST": 36.0, "Y_STEP": -0.01}, c("y"), c("y") + 10, c("y"), c("y") + 10)
    return view(spark, sf, "v_pixel").select("y").distinct().select("y", r6(box[0], "s"), r6(box[1], "n"))


@query("F16_extent_order", duck("SELECT site, lon AS w, lon + 1 AS e, lat AS s, lat + 2 AS n FROM v_sites"))
def f16(spark, sf):
    e = FL.box_to_extent(c("lat"), c("lat") + 2, c("lon"), c("lon") + 1)
    return view(spark, sf, "v_sites").select("site", e[0].alias("w"), e[1].alias("e"), e[2].alias("s"), e[3].alias("n"))


# ------------------------------------------------------------ J


@query("J01_update_by_site", duck("n AS (SELECT site, count(*) AS n FROM v_series WHERE disp > 0.04 GROUP BY site) SELECT s.site, coalesce(n.n, -1) AS n FROM v_sites s LEFT JOIN n ON s.site = n.site"))
def j01(spark, sf):
    n = view(spark, sf, "v_series").where("disp > 0.04").groupBy("site").agg(F.count("*").alias("n"))
    return view(spark, sf, "v_sites").select("site").join(n, "site", "left").select("site", F.coalesce("n", lit(-1)).alias("n"))


@query("J02_metric_merge", duck("SELECT s.site, s.v, m.n FROM v_sites s JOIN (SELECT site, count(*) AS n FROM v_steps GROUP BY site) m ON s.site = m.site"))
def j02(spark, sf):
    return view(spark, sf, "v_sites").select("site", "v").join(view(spark, sf, "v_steps").groupBy("site").agg(F.count("*").alias("n")), "site")


@query("J03_steps_of_sites", duck("SELECT site, d FROM v_steps WHERE site IN (SELECT site FROM v_sites WHERE v > 2)"))
def j03(spark, sf):
    return view(spark, sf, "v_steps").join(view(spark, sf, "v_sites").where("v > 2"), "site", "left_semi")


@query("J04_pairs_not_dropped", duck("SELECT date1, date2 FROM v_ifg i WHERE NOT EXISTS (SELECT 1 FROM v_acq a WHERE month(a.d) = 3 AND a.d = i.date1)", "v_ifg"))
def j04(spark, sf):
    return view(spark, sf, "v_ifg").join(view(spark, sf, "v_acq").where(F.month("d") == 3), c("date1") == c("d"), "left_anti")


@query("J05_one_year_pairs", duck("SELECT a.site, a.d, round((b.disp - a.disp) / (365 / 365.25e0), 6) AS s FROM v_series a JOIN v_series b ON a.site = b.site AND days_between(a.d, b.d) = 365"))
def j05(spark, sf):
    later = view(spark, sf, "v_series").select("site", F.date_sub("d", 365).alias("d"), c("disp").alias("disp2"))
    return view(spark, sf, "v_series").join(later, ["site", "d"]).select("site", "d", r6((c("disp2") - c("disp")) / (365 / 365.25), "s"))


@query("J06_nearest_epoch", duck("g AS (SELECT t.site, t.d AS step, s.d AS epoch, abs(days_between(t.d, s.d)) AS gap FROM v_steps t JOIN v_series s ON t.site = s.site) SELECT site, step, epoch, gap AS gap_days FROM g QUALIFY row_number() OVER (PARTITION BY site, step ORDER BY gap, epoch DESC) = 1"))
def j06(spark, sf):
    return robust.nearest_epoch(view(spark, sf, "v_series"), view(spark, sf, "v_steps")).withColumn("gap_days", c("gap_days").cast("long"))


_POINTS = "SELECT a.site AS site1, b.site AS site2, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM v_sites a JOIN v_sites b ON a.site < b.site"


@query("J08_distance_pairs", duck(f"p AS ({_POINTS}), {distances('p', 'site1, site2')} SELECT site1, site2, round(m / 1000, 5) AS dist FROM e"))
def j08(spark, sf):
    pairs = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    return pairs.select("site1", "site2", F.round(G.geodesic_distance(c("lon1"), c("lat1"), c("lon2"), c("lat2"), "km"), 5).alias("dist"))


@query("J09_upper_triangle", duck("SELECT a.site AS site1, b.site AS site2, round(abs(a.v - b.v), 6) AS dv FROM v_sites a JOIN v_sites b ON a.site < b.site"))
def j09(spark, sf):
    return A.site_pairs(view(spark, sf, "v_sites").select("site", "v")).select("site1", "site2", r6(F.abs(c("v1") - c("v2")), "dv"))


@query("J11_pixel_of_station", duck("p AS (SELECT site, CAST(floor((lon + 120e0) / 0.5e0 + 0.01e0) AS INT) AS x, CAST(floor((lat - 43e0) / -0.5e0 + 0.01e0) AS INT) AS y FROM v_sites), m AS (SELECT y, x, avg(disp) AS mean FROM v_pixel GROUP BY y, x) SELECT p.site, p.y, p.x, round(m.mean, 6) AS mean FROM p JOIN m ON p.y = m.y AND p.x = m.x"))
def j11(spark, sf):
    x, y = G.pixel_index(c("lat"), c("lon"), [33.0, 43.0, -120.0, -109.0], [-0.5, 0.5])
    m = view(spark, sf, "v_pixel").groupBy("y", "x").agg(F.avg("disp").alias("mean"))
    return view(spark, sf, "v_sites").select("site", y.alias("y"), x.alias("x")).join(m, ["y", "x"]).select("site", "y", "x", r6(c("mean"), "mean"))


@query("J12_points_on_plates", duck("SELECT site, CASE WHEN lon < -115.0033e0 THEN 1 ELSE 2 END AS plate_ix FROM v_sites"))
def j12(spark, sf):
    ring = lambda x0, x1: F.array(*(F.struct(lit(x).alias("lon"), lit(y).alias("lat")) for x, y in ((x0, 0.0), (x1, 0.0), (x1, 80.0), (x0, 80.0))))
    polygons = spark.range(1).select(lit(1).alias("plate_ix"), ring(-150.0, -115.0033).alias("ring")).unionByName(spark.range(1).select(lit(2).alias("plate_ix"), ring(-115.0033, -60.0).alias("ring")))
    return plates.on_plates(view(spark, sf, "v_sites").select("site", "lon", "lat"), polygons).select("site", "plate_ix")


@query("J13_track_overlap", duck("SELECT a.site AS s1, b.site AS s2, greatest(a.lat, b.lat) AS s, least(a.lat, b.lat) + 2 AS n, greatest(a.lon, b.lon) AS w, least(a.lon, b.lon) + 2 AS e FROM v_sites a JOIN v_sites b ON a.site < b.site WHERE greatest(a.lat, b.lat) < least(a.lat, b.lat) + 2 AND greatest(a.lon, b.lon) < least(a.lon, b.lon) + 2"))
def j13(spark, sf):
    p = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    p = p.select(c("site1").alias("s1"), c("site2").alias("s2"), F.greatest("lat1", "lat2").alias("s"), (F.least("lat1", "lat2") + 2).alias("n"), F.greatest("lon1", "lon2").alias("w"), (F.least("lon1", "lon2") + 2).alias("e"))
    return p.where("s < n and w < e")


@query("J14_pairs_of_date", duck("SELECT a.d, i.date1, i.date2 FROM v_acq a JOIN v_ifg i ON a.d = i.date1 OR a.d = i.date2"))
def j14(spark, sf):
    pairs = view(spark, sf, "v_ifg").select(F.explode(F.array("date1", "date2")).alias("d"), "date1", "date2")
    return view(spark, sf, "v_acq").join(pairs, "d")


@query("J15_prior", duck("p AS (SELECT y, x, 0.5e0 AS ns FROM v_pixel WHERE x % 2 = 0 GROUP BY y, x) SELECT l.y, l.x, l.track, coalesce(p.ns, 0e0) AS ns, CASE WHEN p.ns IS NULL THEN 1e0 ELSE 2e0 END AS ns_std FROM v_los l LEFT JOIN p ON l.y = p.y AND l.x = p.x"))
def j15(spark, sf):
    from ..operators.los import with_prior

    prior = view(spark, sf, "v_pixel").where("x % 2 = 0").select("y", "x").distinct().select("y", "x", lit(0.5).alias("ns"), lit(2.0).alias("ns_std"), lit(None).cast("double").alias("ew"), lit(None).cast("double").alias("ew_std"))
    return with_prior(view(spark, sf, "v_los"), prior).select("y", "x", "track", "ns", "ns_std")


# ------------------------------------------------------------ T


@query("T01_parse_date", duck("SELECT DISTINCT d, d AS parsed FROM v_series"))
def t01(spark, sf):
    text = F.upper(F.date_format("d", "yyMMMdd"))
    return view(spark, sf, "v_series").select("d").distinct().select("d", T.parse_yymmmdd(text).alias("parsed"))


@query("T02_parse_any", duck("SELECT DISTINCT strftime(d, '%Y%m%d') AS text, CAST(d AS TIMESTAMP) AS t FROM v_series"))
def t02(spark, sf):
    s = view(spark, sf, "v_series").select(F.date_format("d", "yyyyMMdd").alias("text")).distinct()
    return s.select("text", T.parse_any(c("text")).cast("timestamp_ntz").alias("t"))


@query("T03_years_between", duck("SELECT date1, date2, round(days_between(date1, date2) / 365.25e0, 6) AS years FROM v_ifg", "v_ifg"))
def t03(spark, sf):
    return view(spark, sf, "v_ifg").select("date1", "date2", r6(T.years_between(c("date1"), c("date2")), "years"))


@query("T03_years_between_times", "SELECT user_id, ts, round(datediff('second', TIMESTAMP '2020-01-01', ts) / 86400e0 / 365.25e0, 6) AS years FROM events")
def t03b(spark, sf):
    return view(spark, sf, "events").select("user_id", "ts", r6(T.years_between_times(lit("2020-01-01").cast("timestamp_ntz"), c("ts").cast("timestamp_ntz")), "years"))


@query("T04_decimal_year", duck("SELECT DISTINCT d, round(year(d) + (dayofyear(d) - 1) / 365.25e0, 6) AS y FROM v_series"))
def t04(spark, sf):
    return view(spark, sf, "v_series").select("d").distinct().select("d", r6(T.decimal_year(c("d")), "y"))


@query("T05_from_decimal_year", duck("y AS (SELECT DISTINCT d, year(d) + (dayofyear(d) - 1 + 0.3e0) / 365.25e0 AS y FROM v_series) SELECT d, make_date(CAST(floor(y) AS BIGINT), 1, 1) + CAST(floor((y - floor(y)) * 365.25e0) AS INT) AS back FROM y"))
def t05(spark, sf):
    return view(spark, sf, "v_series").select("d").distinct().select("d", T.from_decimal_year(F.year("d") + (F.dayofyear("d") - 1 + 0.3) / 365.25).alias("back"))


@query("T06_mjd_to_year", duck("SELECT DISTINCT d, round((datediff('day', DATE '1858-11-17', d) - 51544) / 365.25e0 + 2000, 6) AS y FROM v_series"))
def t06(spark, sf):
    return view(spark, sf, "v_series").select("d").distinct().select("d", r6(T.mjd_to_decimal_year(T.mjd(c("d"))), "y"))


@query("T07_mjd", duck("SELECT DISTINCT d, datediff('day', DATE '1858-11-17', d) AS mjd FROM v_series"))
def t07(spark, sf):
    return view(spark, sf, "v_series").select("d").distinct().select("d", T.mjd(c("d")).cast("long").alias("mjd"))


@query("T08_from_mjd", duck("SELECT DISTINCT d, d AS back FROM v_series"))
def t08(spark, sf):
    return view(spark, sf, "v_series").select("d").distinct().select("d", T.from_mjd(T.mjd(c("d"))).alias("back"))


@query("T09_epoch_of_parts", duck("SELECT DISTINCT d, CAST(d AS TIMESTAMP) + INTERVAL 43200 SECOND AS t FROM v_series"))
def t09(spark, sf):
    return view(spark, sf, "v_series").select("d").distinct().select("d", T.epoch_of_parts(F.year("d"), F.month("d"), F.dayofmonth("d"), lit(12.0), lit(0.0), lit(0.0)).alias("t"))


@query("T10_temporal_baseline", duck("SELECT date1, date2, days_between(date1, date2) AS days FROM v_ifg", "v_ifg"))
def t10(spark, sf):
    return view(spark, sf, "v_ifg").select("date1", "date2", T.temporal_baseline(c("date1"), c("date2")).cast("long").alias("days"))


# ------------------------------------------------------------ M

_PAIRS = "p AS (SELECT a.site AS site1, b.site AS site2, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM v_sites a JOIN v_sites b ON a.site < b.site)"
_HAV = "6378137e0 * acos(greatest(-1e0, least(1e0, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))))"


@query("M03_haversine", duck(f"{_PAIRS} SELECT site1, site2, round({_HAV} / 1000, 3) AS km FROM p"))
def m03(spark, sf):
    p = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    return p.select("site1", "site2", F.round(G.haversine(c("lat1"), c("lon1"), c("lat2"), c("lon2")) / 1000, 3).alias("km"))


@query("M04_vincenty", None)
def m04(spark, sf):
    p = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    return p.select("site1", "site2", G.vincenty(c("lat1"), c("lon1"), c("lat2"), c("lon2")).alias("g")).select("site1", "site2", "g.*")


@query("M02_geodesic_forward", duck("SELECT site, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_sites"))
def m02(spark, sf):
    s = view(spark, sf, "v_sites").select("site", G.geodesic_forward(c("lon"), c("lat"), lit(30.0), lit(50000.0)).alias("p"), "lon", "lat")
    back = G.vincenty(c("p.lat"), c("p.lon"), c("lat"), c("lon"))
    s = s.withColumn("b", back).select("site", G.geodesic_forward(c("p.lon"), c("p.lat"), c("b.azimuth1"), c("b.distance")).alias("q"))
    return s.select("site", r6(c("q.lon"), "lon"), r6(c("q.lat"), "lat"))


_STEPS = "SELECT site, 0 AS way, lon AS lon1, lat AS lat1, lon AS lon2, lat + 0.01e0 AS lat2 FROM v_sites UNION ALL SELECT site, 1, lon, lat, lon + 0.01e0, lat FROM v_sites"


@query("M05_pixel_metres", duck(f"p AS ({_STEPS}), {distances('p', 'site, way')} SELECT site, round(max(CASE WHEN way = 0 THEN m END), 3) AS north, round(max(CASE WHEN way = 1 THEN m END), 3) AS east FROM e GROUP BY site"))
def m05(spark, sf):
    n, e = G.pixel_metres(c("lat"), c("lon"), lit(0.01), lit(0.01))
    return view(spark, sf, "v_sites").select("site", F.round(n, 3).alias("north"), F.round(e, 3).alias("east"))


@query("M06_enu_matrix", duck("SELECT site, round(-sin(radians(lon)), 6) AS r00, round(cos(radians(lon)), 6) AS r01, round(-sin(radians(lat)) * cos(radians(lon)), 6) AS r10, round(-sin(radians(lat)) * sin(radians(lon)), 6) AS r11, round(cos(radians(lat)), 6) AS r12, round(cos(radians(lat)) * cos(radians(lon)), 6) AS r20, round(cos(radians(lat)) * sin(radians(lon)), 6) AS r21, round(sin(radians(lat)), 6) AS r22 FROM v_sites"))
def m06(spark, sf):
    m = G.enu_matrix(c("lon"), c("lat"))
    return view(spark, sf, "v_sites").select("site", *(r6(m[i][j], f"r{i}{j}") for i in range(3) for j in range(3) if (i, j) != (0, 2)))


_XYZ = "g AS (SELECT site, lon, lat, 6378137e0 / sqrt(1 - 0.0066943799901413165e0 * sin(radians(lat)) * sin(radians(lat))) AS n FROM v_sites), q AS (SELECT site, lon, lat, n * cos(radians(lat)) * cos(radians(lon)) AS px, n * cos(radians(lat)) * sin(radians(lon)) AS py, n * (1 - 0.0066943799901413165e0) * sin(radians(lat)) AS pz FROM g)"


@query("M07_local_frame", duck(f"{_XYZ} SELECT site, round(cos(radians(lon)) * -pz / 1000, 3) AS a00, round(-sin(radians(lon)) * pz / 1000, 3) AS a01, round((sin(radians(lon)) * py + cos(radians(lon)) * px) / 1000, 3) AS a02 FROM q"))
def m07(spark, sf):
    m = G.local_frame(c("lon"), c("lat"))
    return view(spark, sf, "v_sites").select("site", F.round(m[0][0], 3).alias("a00"), F.round(m[0][1], 3).alias("a01"), F.round(m[0][2], 3).alias("a02"))


@query("M08_pole_of_rate", duck("SELECT site, round(degrees(atan2(sv, v)), 6) AS lon, round(90 - degrees(acos(lat / sqrt(v * v + sv * sv + lat * lat))), 6) AS lat, round(degrees(sqrt(v * v + sv * sv + lat * lat) * 1e-9) * 1e6, 6) AS omega FROM v_sites"))
def m08(spark, sf):
    lo, la, om = G.rate_to_pole(c("v") * 1e-9, c("sv") * 1e-9, c("lat") * 1e-9)
    return view(spark, sf, "v_sites").select("site", r6(lo, "lon"), r6(la, "lat"), r6(om, "omega"))


@query("M09_rate_of_pole", duck("SELECT site, round(cos(radians(lat)) * cos(radians(lon)) * radians(sv) * 1000, 6) AS wx, round(cos(radians(lat)) * sin(radians(lon)) * radians(sv) * 1000, 6) AS wy, round(sin(radians(lat)) * radians(sv) * 1000, 6) AS wz FROM v_sites"))
def m09(spark, sf):
    w = G.pole_to_rate(c("lon"), c("lat"), c("sv"))
    return view(spark, sf, "v_sites").select("site", *(r6(x * 1e9, n) for x, n in zip(w, ("wx", "wy", "wz"), strict=True)))


@query("M10_geocentric", duck(f"{_XYZ} SELECT site, round(px, 3) AS px, round(py, 3) AS py, round(pz, 3) AS pz FROM q"))
def m10(spark, sf):
    x, y, z = G.geocentric(c("lat"), c("lon"))
    return view(spark, sf, "v_sites").select("site", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"), F.round(z, 3).alias("pz"))


@query("M11_geodetic", duck("SELECT site, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_sites"))
def m11(spark, sf):
    x, y, z = G.geocentric(c("lat"), c("lon"), 100.0)
    return view(spark, sf, "v_sites").select("site", G.geodetic(x, y, z).alias("g")).select("site", r6(c("g.lon"), "lon"), r6(c("g.lat"), "lat"))


_POLY = "k AS (SELECT 0.08209443794970e0 AS e), m AS (SELECT e, 1 - pow(e, 2) / 4 - 3 * pow(e, 4) / 64 - 5 * pow(e, 6) / 256 AS m1, 3 * pow(e, 2) / 8 + 3 * pow(e, 4) / 32 + 45 * pow(e, 6) / 1024 AS m2, 15 * pow(e, 4) / 256 + 45 * pow(e, 6) / 1024 AS m3, 35 * pow(e, 6) / 3072 AS m4, radians(37e0) AS l0 FROM k), b AS (SELECT site, radians(lat) AS la, radians(lon + 115) AS sp, e, m1, m2, m3, m4, l0, 6378137e0 / sqrt(1 - e * e * sin(radians(lat)) * sin(radians(lat))) AS n FROM v_sites, m)"


@query("M12_to_local", duck(f"{_POLY} SELECT site, round(n * cos(la) / sin(la) * sin(sp * sin(la)) / 1000, 6) AS x, round((6378137e0 * (m1 * la - m2 * sin(2 * la) + m3 * sin(4 * la) - m4 * sin(6 * la)) - 6378137e0 * (m1 * l0 - m2 * sin(2 * l0) + m3 * sin(4 * l0) - m4 * sin(6 * l0)) + n * cos(la) / sin(la) * (1 - cos(sp * sin(la)))) / 1000, 6) AS y FROM b"))
def m12(spark, sf):
    x, y = G.to_local(c("lon"), c("lat"), -115.0, 37.0)
    return view(spark, sf, "v_sites").select("site", r6(x, "x"), r6(y, "y"))


@query("M13_from_local", duck("SELECT site, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_sites"))
def m13(spark, sf):
    x, y = G.to_local(c("lon"), c("lat"), -115.0, 37.0)
    return view(spark, sf, "v_sites").select("site", G.from_local(x, y, -115.0, 37.0).alias("g")).select("site", r6(c("g.lon"), "lon"), r6(c("g.lat"), "lat"))


@query("M14_pixel_index", duck("SELECT site, CAST(floor((lon + 120e0) / 0.1e0 + 0.01e0) AS INT) AS x, CAST(floor((lat - 43e0) / -0.1e0 + 0.01e0) AS INT) AS y FROM v_sites"))
def m14(spark, sf):
    x, y = G.pixel_index(c("lat"), c("lon"), [33.0, 43.0, -120.0, -109.0], [-0.1, 0.1])
    return view(spark, sf, "v_sites").select("site", x.alias("x"), y.alias("y"))


@query("M15_box_of", "SELECT 100 AS y1, 300 AS y2, 50 AS x1, 150 AS x2, 100 AS width, 200 AS length")
def m15(spark, sf):
    box = G.box_of([33.0, 35.0, -117.5, -116.5], [30.0, 36.0, -118.0, -110.0], [-0.01, 0.01])
    return spark.range(1).select(*(lit(v).alias(k) for k, v in box.items()))


@query("M16_grid", "SELECT i, j, round(33 + i * 2e0 / 9, 6) AS lat, round(-118 + j * 3e0 / 14, 6) AS lon FROM range(10) a(i), range(15) b(j)")
def m16(spark, sf):
    rows = spark.range(10).select(c("id").alias("i")).withColumn("j", F.explode(F.sequence(lit(0), lit(14)).cast("array<long>")))
    return rows.select("i", "j", r6(33 + c("i") * 2.0 / 9, "lat"), r6(-118 + c("j") * 3.0 / 14, "lon"))


@query("M18_degrees_of_metres", "SELECT * FROM (VALUES (100, 0.000925926), (90, 0.000833334), (60, 0.000555556), (50, 0.000462963), (30, 0.000277778), (20, 0.000185185), (10, 0.000092593)) t(metres, degrees)")
def m18(spark, sf):
    return spark.createDataFrame(list(G.DEGREES_OF_METRES.items()), "metres int, degrees double").withColumn("degrees", c("degrees").cast("decimal(10,9)"))


@query("M19_round_to_exponent", duck("SELECT site, round(ceil(v / pow(10e0, ceil(log10(abs(v))) - 2)) * pow(10e0, ceil(log10(abs(v))) - 2), 6) AS up, round(floor(v / pow(10e0, ceil(log10(abs(v))) - 2)) * pow(10e0, ceil(log10(abs(v))) - 2), 6) AS down FROM v_sites WHERE v <> 0"))
def m19(spark, sf):
    return view(spark, sf, "v_sites").where("v <> 0").select("site", r6(G.ceil_to_exponent(c("v"), 2), "up"), r6(G.floor_to_exponent(c("v"), 2), "down"))


@query("M20_network_centre", duck("SELECT round((max(lon) - min(lon)) / 2 + min(lon), 1) AS lon0, round((max(lat) - min(lat)) / 2 + min(lat), 1) AS lat0 FROM v_sites"))
def m20(spark, sf):
    mid = lambda x: (F.max(x) - F.min(x)) / 2 + F.min(x)
    return view(spark, sf, "v_sites").agg(F.round(mid("lon"), 1).alias("lon0"), F.round(mid("lat"), 1).alias("lat0"))


@query("M21_regular_grid", None)
def m21(spark, sf):
    rows = spark.range(-10, 11).select((c("id") * 50.0).alias("x")).withColumn("y", F.explode(F.sequence(lit(-500), lit(500), lit(50)).cast("array<double>")))
    return rows.select("x", "y", G.aeqd_inverse(c("x"), c("y"), -115.0, 37.0).alias("p")).select("x", "y", r6(c("p.lon"), "lon"), r6(c("p.lat"), "lat"))


_UNIT = "u AS (SELECT y, x, track, los, std, sin(radians(inc)) * cos(radians(azi)) AS dn, -sin(radians(inc)) * sin(radians(azi)) AS de, cos(radians(inc)) AS dv FROM v_los)"


@query("M22_unit_vector", duck(f"{_UNIT} SELECT y, x, track, round(dn, 6) AS dn, round(de, 6) AS de, round(dv, 6) AS dv FROM u"))
def m22(spark, sf):
    dn, de, dv = M.unit_vector(c("inc"), c("azi"))
    return view(spark, sf, "v_los").select("y", "x", "track", r6(dn, "dn"), r6(de, "de"), r6(dv, "dv"))


@query("M23_los_projection", duck(f"{_UNIT} SELECT y, x, track, round(3 * dn + 2 * de - dv, 6) AS los_value, round(sqrt(pow(0.5 * de, 2) + pow(0.4 * dn, 2) + pow(0.8 * dv, 2)), 6) AS sigma FROM u"))
def m23(spark, sf):
    unit = M.unit_vector(c("inc"), c("azi"))
    return view(spark, sf, "v_los").select("y", "x", "track", r6(M.los_value(lit(3.0), lit(2.0), lit(-1.0), unit), "los_value"), r6(M.los_sigma(lit(0.4), lit(0.5), lit(0.8), unit), "sigma"))


@query("M24_quasi_vertical", duck("SELECT y, x, track, round(los * cos(radians(inc)), 6) AS qv, round(std * cos(radians(inc)), 6) AS qs FROM v_los"))
def m24(spark, sf):
    q, s = M.quasi_vertical(c("los"), c("std"), c("inc"))
    return view(spark, sf, "v_los").select("y", "x", "track", r6(q, "qv"), r6(s, "qs"))


_COV = {
    "gm1": "2 * exp(-d / 3e0)", "gm2": "2 * exp(-(d * d) / 9e0)", "reilly": "2 * (1 - 0.5 * d * d / 9e0) * exp(-0.5 * d * d / 9e0)",
    "markov1": "2 * (1 + d / 3e0) * exp(-d / 3e0)", "markov2": "2 * (1 + d / 3e0 + d * d / 27e0) * exp(-d / 3e0)", "tri": "2 * (1 - d / 6e0)",
    "lauer": "2 / pow(d, 3e0)", "gauss": "2 * exp(-9e0 * d * d)", "log": "2 * 9e0 / (9e0 + d * d)", "vestol": "2 * (3 * d * d + 0.02e0 * d + 1)",
}


@query("M25_covariance_models", duck("s AS (SELECT site, sv AS d FROM v_sites) SELECT site, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _COV.items()) + " FROM s"))
def m25(spark, sf):
    d = c("sv")
    return view(spark, sf, "v_sites").select("site", *(r6(f(d, lit(2.0), lit(3.0), *([lit(0.02)] if k == "vestol" else [])), k) for k, f in M.COVARIANCE.items()))


_VAR = {
    "spherical": "CASE WHEN d > 3 THEN 2.5e0 ELSE 0.5e0 + 2 * (1.5e0 * (d / 3e0) - 0.5e0 * pow(d / 3e0, 3)) END", "exponential": "0.5e0 + 2 * (1 - exp(-3 * d / 3e0))",
    "gaussian": "0.5e0 + 2 * (1 - exp(-pow(2 * d / 3e0, 2)))", "cubic": "CASE WHEN d >= 3 THEN 2.5e0 ELSE 0.5e0 + 2 * (7 - pow(d / 3e0, 2) - 8.75e0 * pow(d / 3e0, 3) + 3.5e0 * pow(d / 3e0, 5) - 0.75e0 * pow(d / 3e0, 7)) END",
    "hole_effect": "0.5e0 + 2 * (1 - (1 - d) * exp(-d))", "power": "0.5e0 + 2 * pow(d, 0.003e0)", "linear": "0.5e0 + 2 * d",
}


@query("M26_variogram_models", duck("s AS (SELECT site, abs(v) AS d FROM v_sites) SELECT site, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _VAR.items()) + " FROM s"))
def m26(spark, sf):
    return view(spark, sf, "v_sites").select("site", *(r6(M.variogram_model(k)(F.abs("v"), lit(2.0), lit(0.5), lit(3.0)), k) for k in M.VARIOGRAM))


@query("M28_angular_factors", duck(f"{_PAIRS} SELECT site1, site2, round(sin(radians(lat1)) * sin(radians(lat2)) * cos(radians(lon1 - lon2)) + cos(radians(lat1)) * cos(radians(lat2)), 6) AS ee, round(sin(radians(lon1 - lon2)) * sin(radians(lat1)), 6) AS en, round(sin(radians(lon2 - lon1)) * sin(radians(lat2)), 6) AS ne, round(cos(radians(lon1 - lon2)), 6) AS nn FROM p"))
def m28(spark, sf):
    p = A.site_pairs(view(spark, sf, "v_sites").select("site", "lon", "lat"))
    f = M.angular_factors(c("lon1"), c("lat1"), c("lon2"), c("lat2"))
    return p.select("site1", "site2", *(r6(x, k) for k, x in f.items()))


@query("M29_time_design", duck("t AS (SELECT site, d, days_between(DATE '1992-01-01', d) / 365.25e0 AS t FROM v_series) SELECT site, d, 1e0 AS p0, round(t, 6) AS p1, round(t * t / 2, 6) AS p2, round(cos(t * 6.283185307179586e0), 6) AS c0, round(sin(t * 6.283185307179586e0), 6) AS s0, CASE WHEN t > 3 THEN 1e0 ELSE 0e0 END AS h0, round(CASE WHEN t > 3 THEN 1 - exp(-(t - 3) / 0.5e0) ELSE 0 END, 6) AS e0, round(CASE WHEN t > 3 THEN ln(1 + (t - 3) / 0.5e0) ELSE 0 END, 6) AS l0 FROM t"))
def m29(spark, sf):
    t = F.datediff("d", day("1992-01-01")) / 365.25
    cols = M.time_design(t, 2, [1.0], [lit(3.0)], [(lit(3.0), 0.5)], [(lit(3.0), 0.5)])
    return view(spark, sf, "v_series").select("site", "d", *(r6(x, k) for k, x in cols.items()))


@query("M30_plane_design", duck("SELECT site, lon * lon AS t0, lat * lat AS t1, lon * lat AS t2, lon AS t3, lat AS t4, 1e0 AS t5 FROM v_sites"))
def m30(spark, sf):
    return view(spark, sf, "v_sites").select("site", *(x.alias(f"t{i}") for i, x in enumerate(M.plane_design(c("lon"), c("lat"), 2))))


@query("M31_plane_value", duck("SELECT site, round(0.1e0 * lon + 0.2e0 * lat + 0.03e0 * lon * lat + 4, 6) AS plane FROM v_sites"))
def m31(spark, sf):
    return view(spark, sf, "v_sites").select("site", r6(M.plane_value(c("lon"), c("lat"), [0.1, 0.2, 0.03, 4.0], 1.5), "plane"))


@query("M32_plane_variance", duck("SELECT site, round(lon * lon * 0.2e0 + lat * lat * 0.3e0 + 0.5e0 + 2 * (lon * lat * 0.01e0 + lon * 0.02e0 + lat * 0.03e0), 6) AS variance FROM v_sites"))
def m32(spark, sf):
    return view(spark, sf, "v_sites").select("site", r6(M.plane_variance(c("lon"), c("lat"), [[0.2, 0.01, 0.02], [0.01, 0.3, 0.03], [0.02, 0.03, 0.5]], 1), "variance"))


@query("M33_unit_metres", duck("SELECT y, x, d, disp * 0.001e0 AS disp FROM v_pixel"))
def m33(spark, sf):
    return view(spark, sf, "v_pixel").select("y", "x", "d", (c("disp") * F.when(lit("mm") == "mm", 0.001).otherwise(1.0)).alias("disp"))


@query("V30_core_weight", duck("SELECT DISTINCT y, x, round(CASE WHEN y BETWEEN 2 AND 3 AND x BETWEEN 10 AND 29 THEN 1 ELSE greatest(0, 0.75 * (1 - pow(((sqrt(pow(y - 2, 2) + pow(x - 19, 2)) + sqrt(pow(y - 2, 2) + pow(x - 20, 2)) + sqrt(pow(y - 3, 2) + pow(x - 19, 2)) + sqrt(pow(y - 3, 2) + pow(x - 20, 2))) / 4) / (sqrt(404e0) / 2 + 5), 2))) END, 6) AS w FROM v_pixel"))
def v30(spark, sf):
    return view(spark, sf, "v_pixel").select("y", "x").distinct().select("y", "x", r6(regression.core_weight(c("y"), c("x"), [2, 4, 10, 30], 5), "w"))


@query("V35_residual_diagnostics", duck("SELECT site, round(v / sqrt(2 * (1 - sv / 10)), 6) AS studentised, round(v * v / (2 * (1 - sv / 10)) / 3 * (sv / 10) / (1 - sv / 10), 6) AS cook, round(2 * (1 - sv / 10), 6) AS res_var FROM v_sites"))
def v35(spark, sf):
    rows = view(spark, sf, "v_sites").select("site", c("v").alias("res"), lit(2.0).alias("mse"), (c("sv") / 10).alias("h"))
    return regression.residual_diagnostics(rows, 3).select("site", *(r6(c(k), k) for k in ("studentised", "cook", "res_var")))


@query("V35_cook_p_values", duck("k AS (SELECT site, v * v / (2 * (1 - sv / 10)) / 2 * (sv / 10) / (1 - sv / 10) AS cook, count(*) OVER () - 2 AS free FROM v_sites) SELECT site, round(cook, 6) AS cook, round(pow(1 + 2 * cook / free, -free / 2e0), 6) AS p_value FROM k"))
def v35_p(spark, sf):
    rows = view(spark, sf, "v_sites").select("site", c("v").alias("res"), lit(2.0).alias("mse"), (c("sv") / 10).alias("h"))
    return regression.cook_p_values(rows, 2).select("site", r6(c("cook"), "cook"), r6(c("p_value"), "p_value"))
