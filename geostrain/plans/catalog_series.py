"""Queries of aggregations, windows, ordering, sets, series and networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import graph, network, robust, structure
from ..operators import windows as W
from .registry import FLAGSHIP, query
from .ellipsoid import distances
from .views import duck, view

c, lit = F.col, F.lit


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# ------------------------------------------------------------ flagship

_Q0 = """
p AS (SELECT a.site, (b.disp - a.disp) / (NULLIF(days_between(a.d, b.d), 0) / 365.25e0) AS s
  FROM v_series a JOIN v_series b ON a.site = b.site AND days_between(a.d, b.d) = 365),
m AS (SELECT site, median(s) AS v0 FROM p GROUP BY site),
k AS (SELECT p.site, 1.4826e0 * median(abs(s - v0)) AS sg FROM p JOIN m ON p.site = m.site GROUP BY p.site),
t AS (SELECT p.site, s FROM p JOIN m ON p.site = m.site JOIN k ON p.site = k.site WHERE abs(s - v0) < 2e0 * sg),
r AS (SELECT site, median(s) AS vel, count(*) AS n FROM t GROUP BY site)
SELECT r.site, round(max(r.vel) * 1000e0, 6) AS vel_mm, max(r.n) AS n_pairs,
       round(1.4826e0 * median(abs(t.s - r.vel)) * 1000e0, 6) AS mad_mm
FROM r JOIN t ON r.site = t.site GROUP BY r.site"""


@query(FLAGSHIP, duck(_Q0))
def q0(spark, sf):
    return robust.pair_trend(view(spark, sf, "v_series"))


# ------------------------------------------------------------ A


@query("A01_median", duck("SELECT site, round(median(disp), 6) AS m FROM v_series GROUP BY site"))
def a01(spark, sf):
    return view(spark, sf, "v_series").groupBy("site").agg(r6(F.median(A.no_nan(c("disp"))), "m"))


def _mad_sql(scale: str) -> str:
    return duck(f"m AS (SELECT site, median(disp) AS m FROM v_series GROUP BY site) SELECT s.site, round(any_value(m.m), 6) AS median, round({scale} * median(abs(s.disp - m.m)), 6) AS mad FROM v_series s JOIN m ON s.site = m.site GROUP BY s.site")


@query("A02_scaled_mad", _mad_sql("1.4826e0"))
def a02(spark, sf):
    got = A.mad(view(spark, sf, "v_series"), "site", "disp", robust.SCALE)
    return got.select("site", r6(c("median"), "median"), r6(c("mad"), "mad"))


@query("A03_mad", _mad_sql("1e0"))
def a03(spark, sf):
    got = A.mad(view(spark, sf, "v_series"), "site", "disp")
    return got.select("site", r6(c("median"), "median"), r6(c("mad"), "mad"))


@query("A04_rms", duck("SELECT site, round(sqrt(avg(disp * disp)), 6) AS rms, round(sqrt(median(disp * disp)), 6) AS rmeds FROM v_series GROUP BY site"))
def a04(spark, sf):
    return view(spark, sf, "v_series").groupBy("site").agg(r6(A.rms(c("disp")), "rms"), r6(A.root_median_square(c("disp")), "rmeds"))


@query("A05_weighted_rms", duck("SELECT y, x, round(sqrt(sum(CASE WHEN track <> 3 THEN 1 / (std * std) * (los - 4) * (los - 4) END) / sum(1 / (std * std))), 6) AS wrms FROM v_los WHERE track <> 3 OR los > 0 GROUP BY y, x"))
def a05(spark, sf):
    w = 1 / (c("std") * c("std"))
    return view(spark, sf, "v_los").groupBy("y", "x").agg(r6(A.weighted_rms(F.when(c("track") != 3, c("los")), lit(4.0), w), "wrms"))


@query("A06_weighted_average", duck("s AS (SELECT y, x, sum(w) AS w, sum(w * los) AS wx, sum(w * los * los) AS wxx, count(*) - 1 AS dof FROM (SELECT y, x, los, 1 / (std * std) AS w FROM v_los) GROUP BY y, x HAVING count(*) > 2), m AS (SELECT *, wxx - wx * wx / w AS ss FROM s) SELECT y, x, dof, round(wx / w, 6) AS mean, round(sqrt(1 / w), 6) AS std FROM m WHERE ss > 1e-9"))
def a06(spark, sf):
    rows = view(spark, sf, "v_los").withColumn("w", 1 / (c("std") * c("std")))
    got = A.weighted_average(rows, ["y", "x"], "los", "w").where("dof > 1 and mse * dof > 1e-9")
    return got.select("y", "x", "dof", r6(c("mean"), "mean"), r6(c("std"), "std"))


@query("A07_duration", duck("g AS (SELECT site, d, days_between(lag(d) OVER (PARTITION BY site ORDER BY d), d) AS gap FROM v_series) SELECT site, min(d) AS start_date, max(d) AS end_date, round(days_between(min(d), max(d)) / 365.25e0, 6) AS duration, count(*) FILTER (WHERE gap > 6) AS n_gaps FROM g GROUP BY site").replace("days_between(lag(d) OVER (PARTITION BY site ORDER BY d), d)", "datediff('day', lag(d) OVER (PARTITION BY site ORDER BY d), d)").replace("days_between(min(d), max(d))", "datediff('day', min(d), max(d))"))
def a07(spark, sf):
    return A.duration(view(spark, sf, "v_series")).withColumn("duration", F.round("duration", 6))


@query("A08_gap_percentage", duck("b AS (SELECT datediff('day', DATE '1858-11-17', DATE '1996-01-01') AS lo, datediff('day', DATE '1858-11-17', DATE '2000-01-01') AS hi), t AS (SELECT site, datediff('day', DATE '1858-11-17', d) AS t FROM v_series WHERE d > DATE '1996-01-01' AND d < DATE '2000-01-01' UNION ALL SELECT DISTINCT site, lo FROM v_series, b UNION ALL SELECT DISTINCT site, hi FROM v_series, b), g AS (SELECT site, lead(t) OVER (PARTITION BY site ORDER BY t) - t AS diff FROM t) SELECT site, round(100e0 * sum(CASE WHEN diff > 1 THEN diff - 1 ELSE 0 END) / (count(*) + sum(CASE WHEN diff > 1 THEN diff - 1 ELSE 0 END)), 6) AS gap_pct FROM g GROUP BY site"))
def a08(spark, sf):
    return A.gap_percentage(view(spark, sf, "v_series"), "1996-01-01", "2000-01-01").withColumn("gap_pct", F.round("gap_pct", 6))


@query("A09_binned", duck("m AS (SELECT min(lon) AS lo, max(lon) AS hi FROM v_sites), b AS (SELECT v, least(CAST(floor((lon - lo) / ((hi - lo) / 8)) AS INT), 7) AS bin FROM v_sites, m) SELECT bin, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(sum(v), 6) AS total FROM b GROUP BY bin"))
def a09(spark, sf):
    got = A.binned(view(spark, sf, "v_sites"), "lon", "v", 8)
    return got.select("bin", "n", *(r6(c(k), k) for k in ("mean", "median", "std", "total")))


_DEG = "p AS (SELECT a.v AS v1, b.v AS v2, a.sv AS s1, b.sv AS s2, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) AS dist FROM v_sites a JOIN v_sites b ON a.site < b.site)"


def _degree_pairs(spark, sf):
    p = A.site_pairs(view(spark, sf, "v_sites"))
    return p.withColumn("dist", F.sqrt((c("lon1") - c("lon2")) ** 2 + (c("lat1") - c("lat2")) ** 2))


@query("A10_covariance_bins", duck(f"{_DEG}, b AS (SELECT CASE WHEN dist < 1 THEN 0 WHEN dist < 3 THEN 1 WHEN dist < 5 THEN 2 WHEN dist <= 8 THEN 3 END AS bin, v1 * s2 AS p FROM p) SELECT bin, count(*) AS n, round(sum(p) / (count(*) - 1), 6) AS cov, round(stddev_pop(p), 6) AS std FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 40"))
def a10(spark, sf):
    p = _degree_pairs(spark, sf).withColumnsRenamed({"v1": "a1", "sv2": "b2"})
    s = view(spark, sf, "v_sites").select(c("v").alias("d1"), c("sv").alias("d2"), lit(0.1).alias("n1"), lit(0.1).alias("n2"))
    bins = A.covariance_bins(p, s, [0.0, 1.0, 3.0, 5.0, 8.0], 20)[1]
    return bins.select("bin", "n", r6(c("cov"), "cov"), r6(c("std"), "std"))


@query("A10_signal_variance", duck("SELECT round(0.5e0 * (avg(v * v) - 0.01e0) + 0.5e0 * (avg(sv * sv) - 0.01e0), 6) AS c0 FROM v_sites"))
def a10b(spark, sf):
    s = view(spark, sf, "v_sites").select(c("v").alias("d1"), c("sv").alias("d2"), lit(0.1).alias("n1"), lit(0.1).alias("n2"))
    p = _degree_pairs(spark, sf).withColumnsRenamed({"v1": "a1", "sv2": "b2"})
    return A.covariance_bins(p, s, [0.0, 1.0], 20)[0].select(r6(c("c0"), "c0"))


@query("A11_correlation_bins", duck(f"{_DEG}, b AS (SELECT CASE WHEN dist < 1 THEN 0 WHEN dist < 3 THEN 1 WHEN dist <= 5 THEN 2 END AS bin, v1, s2 FROM p), u AS (SELECT bin, avg(v1) AS m1, stddev_pop(v1) AS d1 FROM (SELECT DISTINCT bin, v1 FROM b) GROUP BY bin), w AS (SELECT bin, avg(s2) AS m2, stddev_pop(s2) AS d2 FROM (SELECT DISTINCT bin, s2 FROM b) GROUP BY bin) SELECT b.bin, count(*) AS n, round(sum((v1 - m1) * (s2 - m2) / (d1 * d2)) / (count(*) - 1), 6) AS corr FROM b JOIN u ON b.bin = u.bin JOIN w ON b.bin = w.bin GROUP BY b.bin HAVING count(*) >= 20"))
def a11(spark, sf):
    p = _degree_pairs(spark, sf).withColumnsRenamed({"v1": "a1", "sv2": "b2"})
    return A.correlation_bins(p, [0.0, 1.0, 3.0, 5.0], 20).select("bin", "n", r6(c("corr"), "corr"))


@query("A12_structure_function", duck(f"{_DEG}, k AS (SELECT dist, abs(v1 - v2) AS dv FROM p WHERE abs(v1 - v2) < 10 AND dist <> 0), s AS (SELECT max(dist) AS dmax FROM k), b AS (SELECT CAST(floor(dist / 0.5e0) AS INT) AS bin, median(dv) AS m FROM k, s WHERE floor(dist / 0.5e0) < ceil(dmax / 0.5e0) - 1 GROUP BY 1) SELECT bin, round(sqrt(bin * 0.5e0 * (bin + 1) * 0.5e0), 6) AS centre, round((1 / m) / (max(1 / m) OVER ()), 6) AS ssf FROM b UNION ALL SELECT -1, 0e0, 1e0"))
def a12(spark, sf):
    got = structure.network_function(view(spark, sf, "v_sites"), 0.5, km=True)
    return got.select("bin", r6(c("centre"), "centre"), r6(c("ssf"), "ssf"))


@query("A12_structure_function_log", duck(f"{_DEG}, k AS (SELECT dist, abs(v1 - v2) AS dv FROM p WHERE abs(v1 - v2) < 10 AND dist <> 0), s AS (SELECT max(dist) AS dmax FROM k), b AS (SELECT CAST(floor((log10(dist) + 2) / 0.25e0) AS INT) AS bin, median(dv) AS m FROM k, s WHERE floor((log10(dist) + 2) / 0.25e0) BETWEEN 0 AND ceil((dmax + 2) / 0.25e0) - 2 GROUP BY 1) SELECT bin, round((1 / m) / (max(1 / m) OVER ()), 6) AS ssf FROM b UNION ALL SELECT -1, 1e0"))
def a12b(spark, sf):
    got = structure.network_function(view(spark, sf, "v_sites"), 0.25)
    return got.select("bin", r6(c("ssf"), "ssf"))


#: Triangles of three sites, counter-clockwise, whose circle holds no other site: every triple is tried.
TRIANGLES = """
h AS (SELECT a.site AS a, b.site AS b, c.site AS c, a.lon AS xa, a.lat AS ya, b.lon AS xb, b.lat AS yb, c.lon AS xc, c.lat AS yc
  FROM v_sites a JOIN v_sites b ON a.site < b.site JOIN v_sites c ON b.site < c.site),
o AS (SELECT *, (xb - xa) * (yc - ya) - (yb - ya) * (xc - xa) AS turn FROM h WHERE abs((xb - xa) * (yc - ya) - (yb - ya) * (xc - xa)) > 1e-9),
i AS (SELECT a, b, c, max(sign(turn) * (
    ((xa - s.lon) * (xa - s.lon) + (ya - s.lat) * (ya - s.lat)) * ((xb - s.lon) * (yc - s.lat) - (xc - s.lon) * (yb - s.lat))
  - ((xb - s.lon) * (xb - s.lon) + (yb - s.lat) * (yb - s.lat)) * ((xa - s.lon) * (yc - s.lat) - (xc - s.lon) * (ya - s.lat))
  + ((xc - s.lon) * (xc - s.lon) + (yc - s.lat) * (yc - s.lat)) * ((xa - s.lon) * (yb - s.lat) - (xb - s.lon) * (ya - s.lat)))) AS inside
  FROM o JOIN v_sites s ON s.site NOT IN (a, b, c) GROUP BY a, b, c),
tri AS (SELECT o.* FROM o JOIN i ON o.a = i.a AND o.b = i.b AND o.c = i.c WHERE i.inside <= 1e-9),
pair AS (SELECT a AS src, b AS dst FROM tri UNION SELECT b, a FROM tri UNION SELECT a, c FROM tri UNION SELECT c, a FROM tri UNION SELECT b, c FROM tri UNION SELECT c, b FROM tri),
ends AS (SELECT src, dst, p.lon AS lon1, p.lat AS lat1, q.lon AS lon2, q.lat AS lat2 FROM pair JOIN v_sites p ON src = p.site JOIN v_sites q ON dst = q.site),
"""
NEIGHBOURS = TRIANGLES + distances("ends", "src, dst")


@query("A13_neighbour_variability", duck(TRIANGLES + """
f AS (SELECT src, p.v - q.v AS dv FROM pair JOIN v_sites p ON src = p.site JOIN v_sites q ON dst = q.site),
m AS (SELECT *, median(dv) OVER (PARTITION BY src) AS centre FROM f)
SELECT src, round(sqrt(avg(dv * dv)), 6) AS rms, count(*) AS n, round(median(abs(dv - centre)), 6) AS mad FROM m GROUP BY src"""))
def a13(spark, sf):
    sites = view(spark, sf, "v_sites")
    got = A.neighbour_variability(network.neighbours(sites), sites)
    return got.select("src", r6(c("rms"), "rms"), "n", r6(c("mad"), "mad"))


@query("A14_network_structure", None)
def a14(spark, sf):
    sites = view(spark, sf, "v_sites")
    return network.network_structure(network.neighbours(sites), sites)


@query("A15_neighbour_distances", duck(NEIGHBOURS + ", k AS MATERIALIZED (SELECT src, m FROM e) SELECT src, round(min(m) / 1e3, 4) AS dmin, round(max(m) / 1e3, 4) AS dmax, round(avg(m) / 1e3, 4) AS dmean, round(median(m) / 1e3, 4) AS dmedian, count(*) AS n FROM k WHERE m <> 0 GROUP BY src"))
def a15(spark, sf):
    got = A.neighbour_distances(network.neighbours(view(spark, sf, "v_sites")))
    return got.select("src", *(F.round(k, 4).alias(k) for k in ("dmin", "dmax", "dmean", "dmedian")), "n")


@query("A16_date_counts", duck("SELECT d, count(*) AS n FROM (SELECT date1 AS d FROM v_ifg UNION ALL SELECT date2 FROM v_ifg) GROUP BY d", "v_ifg"))
def a16(spark, sf):
    return A.date_counts(view(spark, sf, "v_ifg"))


_STACK = "z AS (SELECT i.date1, i.date2, p.y, p.x, CASE WHEN p.x % 5 = 0 THEN 0 ELSE p.disp END AS value FROM v_ifg i JOIN v_pixel p ON i.date1 = p.d)"


def _ifg_stack(spark, sf):
    p = view(spark, sf, "v_pixel").select("y", "x", c("d").alias("date1"), F.when(c("x") % 5 == 0, 0.0).otherwise(c("disp")).alias("value"))
    return view(spark, sf, "v_ifg").join(p, "date1")


@query("A17_pixel_counts", duck(f"{_STACK}, e AS (SELECT date1 AS d, * FROM z UNION ALL SELECT date2 AS d, * FROM z), n AS (SELECT d, count(*) AS n_pairs FROM (SELECT DISTINCT d, date1, date2 FROM e) GROUP BY d) SELECT e.d, y, x, CASE WHEN any_value(n_pairs) >= 2 THEN count(*) FILTER (WHERE value <> 0) ELSE 0 END AS n FROM e JOIN n ON e.d = n.d GROUP BY e.d, y, x", "v_ifg", "v_pixel"))
def a17(spark, sf):
    return A.pixel_counts(_ifg_stack(spark, sf))


@query("A18_connected_components", duck("e AS (SELECT date1 AS a, date2 AS b FROM v_ifg WHERE month(date1) <> 6), n AS (SELECT DISTINCT d FROM (SELECT a AS d FROM e UNION ALL SELECT b FROM e)), t AS (SELECT d, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.a < n.d AND e.b >= n.d) THEN 1 ELSE 0 END AS head FROM n), g AS (SELECT d, sum(head) OVER (ORDER BY d) AS k FROM t) SELECT d, min(d) OVER (PARTITION BY k) AS component FROM g", "v_ifg"))
def a18(spark, sf):
    return graph.date_clusters(view(spark, sf, "v_ifg").where(F.month("date1") != 6))


@query("A19_mean_without_zeros", duck("SELECT y, x, round(avg(CASE WHEN disp <> 0 THEN disp END), 6) AS mean FROM v_pixel GROUP BY y, x"))
def a19(spark, sf):
    return A.mean_without_zeros(view(spark, sf, "v_pixel")).withColumn("mean", F.round("mean", 6))


_AROUND = "n AS (SELECT a.site, b.v AS x, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) AS dist FROM v_sites a JOIN v_sites b ON true)"


@query("A20_moving_variance", duck(f"{_AROUND}, s AS (SELECT site, count(*) AS n, sum(x * x) AS ss, avg(x) AS m FROM n WHERE dist < 1 GROUP BY site) SELECT site, n, round(CASE WHEN n < 7 THEN sqrt((ss + (7 - n) * pow((m + 2) / 2, 2)) / 6) ELSE sqrt(ss / (n - 1)) END, 6) AS sigma FROM s"))
def a20(spark, sf):
    s = view(spark, sf, "v_sites")
    around = A.pair_matrix(s.select("site", "lon", "lat"), s.select(c("site").alias("other"), c("v").alias("x"), c("lon").alias("lon2"), c("lat").alias("lat2")), "site", "other")
    around = around.select("site", "x", F.sqrt((c("lon") - c("lon2")) ** 2 + (c("lat") - c("lat2")) ** 2).alias("dist")).where("dist < 1")
    return A.moving_variance(around, 2.0, 1.0).withColumn("sigma", F.round("sigma", 6))


@query("A21_distinct_steps", duck("SELECT DISTINCT site, d FROM v_steps"))
def a21(spark, sf):
    return view(spark, sf, "v_steps").select("site", "d").distinct()


@query("A23_fit_statistics", duck("m AS (SELECT avg(v) AS m FROM v_sites) SELECT round(sqrt(sum(pow(v - sv, 2)) / (count(*) - 3)), 6) AS rmse, round(sum(pow(sv - m, 2)) / sum(pow(v - m, 2)), 6) AS r2 FROM v_sites, m"))
def a23(spark, sf):
    got = A.fit_statistics(view(spark, sf, "v_sites"), "v", "sv")
    return got.select(r6(c("rmse"), "rmse"), r6(c("r2"), "r2"))


@query("A24_covariance_fit_quality", duck("SELECT round(sum(abs(v - sv)) / 2, 6) AS misfit, round(sum(CASE WHEN site < 3 THEN abs(v - sv) END) / 2, 6) AS misfit3, round(corr(v, sv), 6) AS r FROM v_sites"))
def a24(spark, sf):
    got = A.covariance_fit_quality(view(spark, sf, "v_sites").withColumn("bin", c("site")), "v", "sv", lit(2.0))
    return got.select(*(r6(c(k), k) for k in ("misfit", "misfit3", "r")))


# ------------------------------------------------------------ W

_W = "OVER (PARTITION BY site ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query("W01_rolling", duck(f"SELECT site, d, CASE WHEN count(*) {_W} = 30 THEN round(median(disp) {_W}, 6) END AS median_k, CASE WHEN count(*) {_W} = 30 THEN round(avg(disp) {_W}, 6) END AS mean_k, CASE WHEN count(*) {_W} = 30 THEN round(stddev_samp(disp) {_W}, 6) END AS std_k FROM v_series"))
def w01(spark, sf):
    return W.rolling(view(spark, sf, "v_series"), 30).select("site", "d", *(r6(c(k), k) for k in ("median_k", "mean_k", "std_k")))


_J16 = f"r AS (SELECT site, d, count(*) {_W} AS k, avg(year(d) + (dayofyear(d) - 1) / 365.25e0) {_W} AS t, median(disp) {_W} AS m FROM v_series), l AS (SELECT *, lag(CASE WHEN k = 30 THEN m END, 2) OVER (PARTITION BY site ORDER BY d) AS b FROM r)"


@query("J16_smoothed_jumps", duck(f"{_J16} SELECT site, d, round(t, 6) AS mean_time, round(m, 6) AS median_k, round(abs(m - b), 6) AS change FROM l WHERE k = 30"))
def j16(spark, sf):
    return W.smoothed_jumps(view(spark, sf, "v_series"), 30, 2).select("site", "d", *(r6(c(k), k) for k in ("mean_time", "median_k", "change")))


@query("W02_difference", duck("SELECT site, d, round(disp - lag(disp, 2) OVER (PARTITION BY site ORDER BY d), 6) AS diff, round(abs(disp - lag(disp, 2) OVER (PARTITION BY site ORDER BY d)), 6) AS jump FROM v_series"))
def w02(spark, sf):
    return W.difference(view(spark, sf, "v_series"), 2).select("site", "d", r6(c("diff"), "diff"), r6(c("jump"), "jump"))


@query("W03_jumps", duck(f"SELECT site, d FROM (SELECT site, d, count(*) {_W} = 30 AND abs(disp - avg(disp) {_W}) > 2 * stddev_samp(disp) {_W} AS j FROM v_series) WHERE j"))
def w03(spark, sf):
    return W.jumps(view(spark, sf, "v_series"), 30).where("is_jump").select("site", "d")


@query("W04_above_percentile", duck("p AS (SELECT site, quantile_cont(disp, 0.99) AS q FROM v_series GROUP BY site) SELECT s.site, s.d FROM v_series s JOIN p ON s.site = p.site WHERE s.disp > p.q"))
def w04(spark, sf):
    return W.above_percentile(view(spark, sf, "v_series"), "disp").select("site", "d")


@query("W05_reconstruction_error", None)
def w05(spark, sf):
    return W.reconstruction_error(view(spark, sf, "v_sites"), ["lon", "lat", "v"]).select("site", r6(c("error"), "error"))


@query("W06_temporal_variability", None)
def w06(spark, sf):
    return W.temporal_variability(view(spark, sf, "v_series"), 3.0, steps=view(spark, sf, "v_steps"))


@query("W07_rate_deviation", None)
def w07(spark, sf):
    return W.rate_deviation(view(spark, sf, "v_series"), steps=view(spark, sf, "v_steps"))


def _window_sql(widths: str, advance: str) -> str:
    """Lines through moving windows: anchors by recursion over each epoch's next anchor."""
    return f"""
e AS (SELECT y, x, min(d) AS d0, max(d) AS d1 FROM v_pixel GROUP BY y, x),
k AS (SELECT e.*, CAST(size AS DOUBLE) AS years, CAST(floor(365e0 * size) AS INT) AS width, CAST(floor({advance}) AS INT) AS advance FROM e, {widths}),
t AS (SELECT p.y, p.x, k.years, p.d, min(q.d) AS next FROM v_pixel p JOIN k ON p.y = k.y AND p.x = k.x JOIN v_pixel q ON p.y = q.y AND p.x = q.x AND days_between(p.d, q.d) > k.advance GROUP BY p.y, p.x, k.years, p.d),
a(y, x, years, d) AS (
  SELECT y, x, years, d0 FROM k
  UNION ALL
  SELECT a.y, a.x, a.years, t.next FROM a JOIN t ON a.y = t.y AND a.x = t.x AND a.years = t.years AND a.d = t.d),
f AS (
  SELECT k.y, k.x, k.years, a.d, count(*) AS n, regr_slope(p.disp, days_between(k.d0, p.d) / 365.25e0) AS vel,
         regr_sxx(p.disp, days_between(k.d0, p.d) / 365.25e0) AS sxx, regr_syy(p.disp, days_between(k.d0, p.d) / 365.25e0) AS syy, regr_sxy(p.disp, days_between(k.d0, p.d) / 365.25e0) AS sxy
  FROM k JOIN a ON k.y = a.y AND k.x = a.x AND k.years = a.years AND (a.d = k.d0 OR days_between(a.d, k.d1) > k.width)
  JOIN v_pixel p ON p.y = k.y AND p.x = k.x AND days_between(a.d, p.d) > 0 AND days_between(a.d, p.d) < k.width
  GROUP BY k.y, k.x, k.years, a.d HAVING count(*) > 2)"""


def _recursive(body: str) -> str:
    return duck(body).replace("WITH ", "WITH RECURSIVE ", 1)


W08_SQL = _recursive(_window_sql("(SELECT 2 AS size)", "365e0 * 0.25e0") + """
SELECT y, x, CAST(days_between(DATE '2000-01-01', d) AS DOUBLE) AS anchor, round(vel, 6) AS vel, round(sqrt(greatest(0e0, syy - vel * sxy) / (n - 2) / sxx), 6) AS sigma FROM f""")

W09_SQL = _recursive(_window_sql("(SELECT unnest(range(2, 40)) AS size) WHERE size < CAST(floor(0.75e0 * days_between(d0, d1) / 365.25e0) AS INT)", "365e0 * size / 2") + """,
v AS (SELECT y, x, regr_slope(disp, days_between(DATE '2000-01-01', d) / 365.25e0) AS vel FROM v_pixel GROUP BY y, x HAVING count(*) > 2),
o AS (SELECT f.y, f.x, v.vel, f.vel - v.vel AS off, sqrt(greatest(0e0, f.syy - f.vel * f.sxy) / (f.n - 2) / f.sxx) AS sigma FROM f JOIN v ON f.y = v.y AND f.x = v.x),
m AS (SELECT *, median(off) OVER (PARTITION BY y, x) AS centre FROM o)
""")


@query("W08_window_rates", W08_SQL)
def w08(spark, sf):
    got = W.temporal_variability(view(spark, sf, "v_pixel"), 2.0, ("y", "x"), method="ols", offset=0.25)
    return got.select("y", "x", "anchor", r6(c("vel"), "vel"), r6(c("sigma"), "sigma"))


@query("W08_robust_window_rates", None)
def w08_robust(spark, sf):
    return W.temporal_variability(view(spark, sf, "v_pixel"), 3.0, ("y", "x"))


@query("W08_seasonal_window_rates", None)
def w08_seasonal(spark, sf):
    """Lines, annual terms and the stack's steps in windows."""
    steps = view(spark, sf, "v_steps").select("d").where("d in (date '1994-03-07', date '1996-08-19') or day(d) = 17 and month(d) = 5")
    return W.temporal_variability(view(spark, sf, "v_pixel"), 3.0, ("y", "x"), method="ols", periods=[1.0], steps=steps)


@query("W09_robust_variability", None)
def w09_robust(spark, sf):
    return W.variability(view(spark, sf, "v_pixel"), 2, reduce="median", method="robust")


@query("W09_pixel_variability", W09_SQL + "SELECT y, x, round(any_value(vel), 6) AS vel, round(median(abs(off - centre)), 6) AS variability, count(*) AS n_windows FROM m GROUP BY y, x")
def w09(spark, sf):
    got = W.variability(view(spark, sf, "v_pixel"), 2, method="ols")
    return got.select("y", "x", r6(c("vel"), "vel"), r6(c("variability"), "variability"), "n_windows")


@query("W09_median_variability", W09_SQL + "SELECT y, x, round(any_value(vel), 6) AS vel, round(sqrt(median(off * off)), 6) AS variability, count(*) AS n_windows FROM m GROUP BY y, x")
def w09_median(spark, sf):
    got = W.variability(view(spark, sf, "v_pixel"), 2, method="ols", reduce="median")
    return got.select("y", "x", r6(c("vel"), "vel"), r6(c("variability"), "variability"), "n_windows")


P06_VALUES_SQL = W09_SQL + """
, r AS (SELECT y, x, sqrt(median(off * off)) AS dv FROM m GROUP BY y, x)
SELECT p.y, p.x, p.fitted, round(CASE WHEN p.fitted THEN coalesce(r.dv, 0e0) / 1000e0 ELSE 0e0 END, 9) AS dv
FROM (SELECT y, x, coalesce(avg(disp) <> 0, FALSE) OR (y = 1 AND x = 1) AS fitted FROM v_pixel GROUP BY y, x) p LEFT JOIN r ON p.y = r.y AND p.x = r.x"""


def _patch(spark, sf):
    return W.variability_run(view(spark, sf, "v_pixel"), {"UNIT": "mm", "PROJECT": "stack"}, (1, 1), least=2, reduce="median", method="ols")


@query("P06_patch_variability", P06_VALUES_SQL)
def p06(spark, sf):
    return _patch(spark, sf)[0].select("y", "x", "fitted", F.round("dv", 9).alias("dv"))


@query("P06_patch_metadata", duck("""
s AS (SELECT strftime(min(d), '%Y%m%d') AS a, strftime(max(d), '%Y%m%d') AS b FROM v_pixel)
SELECT unnest(['PROJECT', 'FILE_TYPE', 'UNIT', 'min_window', 'method', 'inv_method', 'REF_Y', 'REF_X', 'START_DATE', 'END_DATE', 'DATE12', 'REF_DATE']) AS key,
       unnest(['stack', 'velocity', 'm/year', '2', 'median', 'ols', '1', '1', a, b, a || '_' || b, a]) AS value FROM s"""))
def p06_metadata(spark, sf):
    return _patch(spark, sf)[1]


@query("W10_sliding_windows", "w AS (SELECT length, greatest(1, CAST(ceil((length - 40) / 30e0) AS INT) + 1) AS n FROM (SELECT CAST(range AS INT) AS length FROM range(20, 200))) SELECT length, CAST(i * 30 AS INT) AS start, CASE WHEN i = n - 1 THEN length ELSE CAST(i * 30 + 40 AS INT) END AS stop FROM w, range(10) r(i) WHERE i < n".join(["WITH ", ""]))
def w10(spark, sf):
    rows = spark.range(20, 200).select(c("id").cast("int").alias("length"))
    return rows.select("length", F.explode(W.sliding_windows(c("length"), 40, 10)).alias("t")).select("length", "t.start", "t.stop")


@query("W11_moving_windows", None)
def w11(spark, sf):
    return W.moving_windows(view(spark, sf, "v_pixel").select("y", "x", c("disp").alias("value")), 15, 20, 5, 5)


@query("W12_extended_windows", duck("t AS (SELECT DISTINCT y AS y0, y + 5 AS y1, 10 AS x0, 30 AS x1 FROM v_pixel) SELECT y0, greatest(y0 - 3, 0) AS ey0, least(y1 + 3, 40) AS ey1, y0 - greatest(y0 - 3, 0) AS py0, y1 - greatest(y0 - 3, 0) AS py1 FROM t"))
def w12(spark, sf):
    t = view(spark, sf, "v_pixel").select(c("y").alias("y0"), (c("y") + 5).alias("y1"), lit(10).alias("x0"), lit(30).alias("x1")).distinct()
    return W.extended(t, 3, 3, 40, 50).select("y0", "ey0", "ey1", "py0", "py1")


@query("W13_fill_gaps", duck("s AS (SELECT site, min(d) AS a, max(d) AS b FROM v_series GROUP BY site), g AS (SELECT site, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM s) SELECT g.site, g.d, v.disp FROM g LEFT JOIN v_series v ON g.site = v.site AND g.d = v.d"))
def w13(spark, sf):
    return W.fill_gaps_regular(view(spark, sf, "v_series"))


_ADJ = "n AS (SELECT y, x, d, disp, lead(d) OVER w AS nd, lead(disp) OVER w AS nv FROM v_pixel WINDOW w AS (PARTITION BY y, x ORDER BY d)), o AS (SELECT *, CASE WHEN (d <= DATE '1997-02-15' AND nd > DATE '1997-02-15') OR (d <= DATE '1999-05-15' AND nd > DATE '1999-05-15') THEN 1 ELSE 0 END AS opens FROM n), g AS (SELECT *, sum(opens) OVER (PARTITION BY y, x ORDER BY d) AS segment FROM o), f AS (SELECT y, x, d, disp, segment, disp - coalesce(max(CASE WHEN opens = 1 THEN nv - disp END) OVER (PARTITION BY y, x, segment), 0) AS adjusted FROM g)"


@query("W14_adjust_steps", duck(f"{_ADJ} SELECT y, x, d, segment, round(adjusted, 6) + 0e0 AS adjusted FROM f", "v_pixel"))
def w14(spark, sf):
    return W.adjust_steps(view(spark, sf, "v_pixel"), ["1997-02-15", "1999-05-15"]).select("y", "x", "d", "segment", (F.round("adjusted", 6) + 0.0).alias("adjusted"))


@query("W15_reference_to_mean", duck(f"{_ADJ} SELECT y, x, d, round(CASE WHEN row_number() OVER (PARTITION BY y, x ORDER BY d) = 1 THEN disp ELSE disp - avg(nullif(adjusted, 0)) OVER (PARTITION BY y, x) END, 6) + 0e0 AS referenced FROM f", "v_pixel"))
def w15(spark, sf):
    return W.reference_to_mean(W.adjust_steps(view(spark, sf, "v_pixel"), ["1997-02-15", "1999-05-15"])).select("y", "x", "d", (F.round("referenced", 6) + 0.0).alias("referenced"))


@query("W16_running_offset", duck("SELECT site, round(coalesce(sum(sv) OVER (PARTITION BY site % 5 ORDER BY site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS o FROM v_sites"))
def w16(spark, sf):
    s = view(spark, sf, "v_sites").select("site", (c("site") % 5).alias("line"), c("site").alias("seq"), c("sv").alias("length"))
    return W.running_offset(s).select("site", r6(c("offset"), "o"))


# ------------------------------------------------------------ O, U


@query("O01_sorted_pairs", duck("p AS (SELECT a.site, b.d AS i, a.d AS j FROM v_series a JOIN v_series b ON a.site = b.site AND days_between(b.d, a.d) = 365), r AS (SELECT site, i, row_number() OVER (PARTITION BY site ORDER BY i) AS k FROM p), s AS (SELECT site, j, row_number() OVER (PARTITION BY site ORDER BY j) AS k FROM p) SELECT r.site, r.i, s.j FROM r JOIN s ON r.site = s.site AND r.k = s.k"))
def o01(spark, sf):
    s = view(spark, sf, "v_series").select("site", "d")
    p = s.select("site", c("d").alias("i"), F.date_add("d", 365).alias("d")).join(s, ["site", "d"]).select("site", "i", c("d").alias("j"))
    z = p.groupBy("site").agg(F.arrays_zip(F.sort_array(F.collect_list("i")).alias("i"), F.sort_array(F.collect_list("j")).alias("j")).alias("z"))
    return z.select("site", F.explode("z").alias("z")).select("site", "z.i", "z.j")


@query("O03_first_match", duck("SELECT site, d, min(e) AS e FROM (SELECT a.site, a.d, b.d AS e FROM v_steps a JOIN v_series b ON a.site = b.site AND b.d > a.d) GROUP BY site, d"))
def o03(spark, sf):
    from ..operators.robust import first_after

    return first_after(view(spark, sf, "v_series"), view(spark, sf, "v_steps"))


@query("O04_nearest_centroid", duck("g AS (SELECT CAST(site % 4 AS INT) AS plate_ix, avg(lon) AS lon, avg(lat) AS lat FROM v_sites GROUP BY 1), w AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM v_sites), d AS (SELECT plate_ix, acos(least(1e0, sin(radians(lat)) * sin(radians(lat0)) + cos(radians(lat)) * cos(radians(lat0)) * cos(radians(lon0 - lon)))) AS d FROM g, w) SELECT arg_min(plate_ix, d) AS plate_ix FROM d"))
def o04(spark, sf):
    from ..operators.plates import central_plate

    return central_plate(view(spark, sf, "v_sites").withColumn("plate_ix", (c("site") % 4).cast("int")))


@query("U01_set_difference", duck("SELECT site, d FROM v_steps EXCEPT SELECT site, d FROM v_steps WHERE month(d) <= 6"))
def u01(spark, sf):
    s = view(spark, sf, "v_steps")
    return s.subtract(s.where(F.month("d") <= 6))


@query("U02_concat_columns", duck("SELECT DISTINCT site, d, NULL::DOUBLE AS mag FROM v_steps WHERE site % 2 = 0 UNION ALL SELECT site, d, 6.5e0 FROM v_steps WHERE site % 2 = 1"))
def u02(spark, sf):
    s = view(spark, sf, "v_steps")
    return FL.unite_steps(s.where("site % 2 = 1").withColumn("mag", lit(6.5)), s.where("site % 2 = 0"))


@query("U03_sites_and_grid", duck("SELECT lon, lat, 'sites' AS grid_type FROM v_sites UNION ALL SELECT -120e0 + i, 33e0, 'grid' FROM range(10) t(i)"))
def u03(spark, sf):
    grid = spark.range(10).select((-120.0 + c("id")).alias("lon"), lit(33.0).alias("lat"), lit("grid").alias("grid_type"))
    return view(spark, sf, "v_sites").select("lon", "lat", lit("sites").alias("grid_type")).unionByName(grid)


@query("U04_both_directions", duck("SELECT site, count(*) AS n FROM (SELECT a.site FROM v_series a JOIN v_series b ON a.site = b.site AND days_between(a.d, b.d) = 365 UNION ALL SELECT a.site FROM v_series a JOIN v_series b ON a.site = b.site AND days_between(b.d, a.d) = 365) GROUP BY site"))
def u04(spark, sf):
    p = robust.pair_rates(view(spark, sf, "v_series"))
    return p.unionAll(p).groupBy("site").agg(F.count("*").alias("n"))


@query("U06_excluded_dates", duck("SELECT DISTINCT d FROM v_acq WHERE month(d) IN (1, 7) OR year(d) = 1995"))
def u06(spark, sf):
    a = view(spark, sf, "v_acq")
    return a.where(F.month("d").isin(1, 7)).union(a.where(F.year("d") == 1995)).distinct()


@query("U07_drop_missing", duck("SELECT site, d FROM (SELECT site, d, lag(disp) OVER (PARTITION BY site ORDER BY d) AS b FROM v_series) WHERE b IS NOT NULL"))
def u07(spark, sf):
    b = F.lag("disp").over(Window.partitionBy("site").orderBy("d"))
    return view(spark, sf, "v_series").withColumn("b", b).dropna(subset=["b"]).select("site", "d")


@query("V22_delaunay_edges", duck(NEIGHBOURS + " SELECT src, dst, round(m / 1e3, 4) AS dist FROM e"))
def v22(spark, sf):
    return network.neighbours(view(spark, sf, "v_sites")).select("src", "dst", F.round("dist", 4).alias("dist"))


@query("V01_robust_trend", None)
def v01(spark, sf):
    return robust.robust_trend(view(spark, sf, "v_series"), view(spark, sf, "v_steps"))


@query("V07_station_durations", duck("g AS (SELECT site, d, datediff('day', lag(d) OVER (PARTITION BY site ORDER BY d), d) AS gap FROM v_series) SELECT s.site, s.v, m.n_gaps FROM v_sites s JOIN (SELECT site, count(*) FILTER (WHERE gap > 30) AS n_gaps FROM g GROUP BY site) m ON s.site = m.site"))
def v07(spark, sf):
    return view(spark, sf, "v_sites").select("site", "v").join(A.duration(view(spark, sf, "v_series"), 30).select("site", "n_gaps"), "site")

