"""Line-of-sight decomposition into north, east and up.

A pixel's tracks become the six sums of its normal equations in one aggregate.
Which components are solved follows from the geometries and the priors; the
system of one, two or three unknowns is solved by closed expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import unit_vector


def with_prior(tracks: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Tracks with the prior north and east components, 0 with deviation 1 where none is."""
    if prior is None:
        return tracks.withColumns({"ns": F.lit(0.0), "ns_std": F.lit(1.0), "ew": F.lit(0.0), "ew_std": F.lit(1.0)})
    rows = tracks.join(prior, ["y", "x"], "left")
    return rows.withColumns({"ns": F.coalesce("ns", F.lit(0.0)), "ns_std": F.coalesce("ns_std", F.lit(1.0)), "ew": F.coalesce("ew", F.lit(0.0)), "ew_std": F.coalesce("ew_std", F.lit(1.0))})


def _inverse(n: list[list[Column]]) -> list[list[Column]]:
    """Inverse of a symmetric 3 x 3 matrix, null if it is singular."""
    (a, b, c), (_, d, e), (_, _, f) = n
    det = F.nullif(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d), F.lit(0.0))
    co = [[d * f - e * e, c * e - b * f, b * e - c * d], [None, a * f - c * c, b * c - a * e], [None, None, a * d - b * b]]
    return [[co[min(i, j)][max(i, j)] / det for j in range(3)] for i in range(3)]


def decompose(tracks: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """n, e, v with deviations, mean square error and number of geometries of each pixel."""
    rows = with_prior(tracks, prior).where("los is not null and not isnan(los)")
    dn, de, dv = unit_vector(F.col("inc"), F.col("azi"))
    rows = rows.withColumns({"dn": dn, "de": de, "dv": dv, "w": 1 / (F.col("std") * F.col("std"))})
    d = ["dn", "de", "dv"]
    used = F.col("los") != 0  # observations of exactly 0 are left out
    part = lambda c: F.sum(F.when(used, c).otherwise(0.0))
    sums = [F.first(c).alias(c) for c in ("ns", "ns_std", "ew", "ew_std")]
    sums += [F.bool_or(F.col("de") < 0).alias("asc"), F.bool_or(F.col("de") > 0).alias("dsc"), F.count_if(used).alias("m"), part(F.col("w") * F.col("los") * F.col("los")).alias("yy")]
    sums += [part(F.col("w") * F.col(a) * F.col("los")).alias(f"r{i}") for i, a in enumerate(d)]
    sums += [part(F.col("w") * F.col(d[i]) * F.col(d[j])).alias(f"n{i}{j}") for i in range(3) for j in range(i, 3)]
    g = rows.groupBy("y", "x").agg(*sums)
    two = F.coalesce(F.col("asc"), F.lit(False)) & F.coalesce(F.col("dsc"), F.lit(False))
    no_n, no_e = F.col("ns") == 0, F.col("ew") == 0
    g = g.withColumn("n_geom", F.when(two, 2).otherwise(1))
    use_n = F.when(two, ~(no_n & no_e)).otherwise(~no_n)
    use_e = F.when(two, F.lit(True)).otherwise(~no_e)
    g = g.withColumns({"use_n": use_n, "use_e": use_e})
    # priors are rows (1, 0, 0) and (0, 1, 0); a prior of exactly 0 is left out like any such observation
    prior_n = F.when(~no_n, 1 / (F.col("ns_std") ** 2)).otherwise(0.0)
    prior_e = F.when(~two & ~no_e, 1 / (F.col("ew_std") ** 2)).otherwise(0.0)
    g = g.withColumns({"pn": prior_n, "pe": prior_e})
    off = lambda use: (~F.col(use)).cast("double")  # noqa: E731  an unused unknown: its row is that of the unit matrix
    on_n, on_e = 1 - off("use_n"), 1 - off("use_e")
    n = [
        [F.col("n00") * on_n + F.col("pn") * on_n + off("use_n"), F.col("n01") * on_n * on_e, F.col("n02") * on_n],
        [None, F.col("n11") * on_e + F.col("pe") * on_e + off("use_e"), F.col("n12") * on_e],
        [None, None, F.col("n22")],
    ]
    r = [(F.col("r0") + F.col("pn") * F.col("ns")) * on_n, (F.col("r1") + F.col("pe") * F.col("ew")) * on_e, F.col("r2")]
    q = _inverse(n)
    flat = {f"q{i}{j}": q[i][j] for i in range(3) for j in range(i, 3)} | {f"b{i}": r[i] for i in range(3)}
    g = g.withColumns(flat)
    at = lambda i, j: F.col(f"q{min(i, j)}{max(i, j)}")
    x = [sum((at(i, j) * F.col(f"b{j}") for j in range(3)), F.lit(0.0)) for i in range(3)]
    g = g.withColumns({f"x{i}": x[i] for i in range(3)})
    rows_used = F.col("m") + (F.col("pn") > 0).cast("int") + (F.col("pe") > 0).cast("int")
    unknowns = 1 + F.col("use_n").cast("int") + F.col("use_e").cast("int")
    total = F.col("yy") + F.col("pn") * F.col("ns") ** 2 + F.col("pe") * F.col("ew") ** 2
    ss = F.greatest(F.lit(0.0), total - sum((F.col(f"x{i}") * F.col(f"b{i}") for i in range(3)), F.lit(0.0)))
    g = g.withColumns({"rows": rows_used, "unknowns": unknowns})
    mse = F.when(F.col("rows") > F.col("unknowns"), ss / (F.col("rows") - F.col("unknowns"))).otherwise(0.0)
    g = g.withColumn("mse", mse)
    solvable = F.col("rows") >= F.col("unknowns")
    std = lambda i: F.sqrt(at(i, i) * F.when(F.round("mse", 4) == 0, F.col("rows")).otherwise(F.col("mse")))
    ok = lambda use, c: F.when(solvable & use, c)
    return g.select(
        "y", "x", "n_geom",
        ok(F.col("use_n"), F.col("x0")).alias("n"), ok(F.col("use_e"), F.col("x1")).alias("e"), ok(F.lit(True), F.col("x2")).alias("v"),
        ok(F.col("use_n"), std(0)).alias("sn"), ok(F.col("use_e"), std(1)).alias("se"), ok(F.lit(True), std(2)).alias("sv"),
        ok(F.lit(True), F.round("mse", 4)).alias("mse"),
    )
