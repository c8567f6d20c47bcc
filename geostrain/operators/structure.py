"""The structure function of a whole network, from every two sites.

Sites are dealt into blocks, and every two blocks meet in a task, where their
pairs are counted in arrays: a pair never becomes a row.  Medians are exact.  A
pass counts the differences in cells, of which those that hold the two middle
ranks are divided again, until so few values are left that these are counted.
The number of blocks is bounded, so what is shuffled grows with the sites alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .aggregates import LEAST_BLOCKS, MOST_BLOCKS

#: Sites of a block, about; a network of more sites than ``MOST_BLOCKS`` of these has larger blocks.
BLOCK = 4096
#: Pairs that one step of a task handles, rows that it holds back, and cells that a cell is divided into.
STEP, HELD, CELLS = 1 << 16, 1 << 20, 512
#: Cells that a task counts in one array at most; more are counted by their keys.
ARRAY = 1 << 22
#: Values that are counted one by one at most, unless cells are divided ``DEEPEST`` times.
VALUES, DEEPEST = 1 << 22, 4

#: Lower bits of a distance, which its cell leaves out.
_LOWER = 46
_SIDE = ["site", "lon", "lat", "v"]


def tiles(sites: DataFrame) -> DataFrame:
    """One row for every two blocks of sites, i <= j, with the arrays of both."""
    rows = sites.select("site", *(F.col(c).cast("double") for c in _SIDE[1:]))
    rows = rows.where("site is not null and " + " and ".join(f"{c} is not null and not isnan({c})" for c in _SIDE[1:]))
    n = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-rows.count() // BLOCK)))
    blocks = written(rows.groupBy(F.pmod(F.xxhash64("site"), F.lit(n)).cast("int").alias("i")).agg(F.collect_list(F.struct(*_SIDE)).alias("rows")))
    side = lambda k: [F.col(f"rows.{c}").alias(f"{c}{k}") for c in _SIDE]
    left = blocks.select("i", F.explode(F.sequence(F.col("i"), F.lit(n - 1))).alias("j"), *side(1))
    right = blocks.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"), *side(2))
    return left.join(right, ["i", "j"]).repartition(n * (n + 1) // 2, "i", "j")


def _pairs(tile, top: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances and differences of a tile's usable pairs, some at a time."""
    (x, y, v), (x2, y2, v2) = ([np.asarray(side, float) for side in sides] for sides in ((tile.lon1, tile.lat1, tile.v1), (tile.lon2, tile.lat2, tile.v2)))
    order = order2 = None
    if tile.i == tile.j:  # equal ids are no pair, and each pair counts once
        names, order = np.unique(tile.site1, return_inverse=True)
        order2 = np.searchsorted(names, tile.site2)
    step = max(1, STEP // len(x2))
    for a in range(0, len(x), step):
        own = slice(a, a + step)
        dist = x[own, None] - x2
        np.multiply(dist, dist, out=dist)
        other = y[own, None] - y2
        np.multiply(other, other, out=other)
        np.sqrt(np.add(dist, other, out=dist), out=dist)
        dv = np.abs(np.subtract(v[own, None], v2, out=other), out=other)
        usable = (dv < top) & (dist > 0) & (dist < np.inf)
        if order is not None:
            usable &= order[own, None] < order2
        yield dist[usable], dv[usable]


def _each(work: Callable) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile in batch.itertuples(index=False):
                yield from work(tile)

    return run


def spanned(top: float) -> Callable:
    def work(tile) -> Iterator[pd.DataFrame]:
        ends = [(d.min(), d.max()) for d, _ in _pairs(tile, top) if len(d)]
        if ends:
            yield pd.DataFrame({"dmin": [min(e[0] for e in ends)], "dmax": [max(e[1] for e in ends)]})

    return _each(work)


def least_of_bins(w: float, n: int) -> np.ndarray:
    """The least distance of each of ``n`` logarithmic bins, and of the one after them."""
    out = []
    for k in range(n + 1):
        reached = lambda d, k=k: (math.log10(d) + 2) / w >= k
        d = 10.0 ** (k * w - 2)
        while reached(d):
            d = math.nextafter(d, 0.0)
        while not reached(d):
            d = math.nextafter(d, math.inf)
        out.append(d)
    return np.array(out)


def bins_from(least: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The last of ``least`` that a distance reaches, or -1, as ``searchsorted`` finds it.

    The upper bits of a distance give a cell, which knows the bin that it begins
    in and where the next one begins.
    """
    first, last = (np.ascontiguousarray(least[[0, -1]]).view(np.int64) >> _LOWER).tolist()
    begun = np.searchsorted(least, (np.arange(first - 1, last + 2) << _LOWER).view(float), "right")
    if (np.diff(begun) > 1).any():
        return lambda dist: np.searchsorted(least, dist, "right") - 1
    following = np.r_[least, np.inf][begun]

    def bins(dist: np.ndarray) -> np.ndarray:
        cell = np.clip((dist.view(np.int64) >> _LOWER) - (first - 1), 0, len(begun) - 1)
        return begun.take(cell) + (dist >= following.take(cell)) - 1

    return bins


def counted(top: float, w: float, n: int, km: bool, level: int = 0, low: np.ndarray | None = None, high: np.ndarray | None = None, values: bool = False) -> Callable:
    """Pairs in the cells of each of ``n`` bins, or with each value.

    From level 1 on only differences from ``low`` to below ``high`` of their bin
    count, in cells of the first level.  Cells of a level divide those of the one
    before exactly: multiples by powers of two aren't rounded.
    """
    place = None if km else bins_from(least_of_bins(w, n))
    scale = CELLS / top
    if low is None:
        low, high = np.full(n, -np.inf), np.full(n, np.inf)
    low, high = np.r_[low, np.inf], np.r_[high, -np.inf]  # of what lies in no bin

    def bins(dist: np.ndarray) -> np.ndarray:
        if km:
            return np.minimum(dist / w, n).astype(np.int64)
        at = place(dist)
        at[at < 0] = n
        return at

    def rows(b: np.ndarray, key: np.ndarray) -> pd.DataFrame:
        found = pd.DataFrame({"bin": b, "key": key}).groupby(["bin", "key"], as_index=False).size()
        return found.rename(columns={"size": "n"}).astype({"bin": "int32", "key": float, "n": "int64"})

    def whole(tile) -> Iterator[pd.DataFrame]:
        wide = CELLS + 1  # a difference just below the top may round to it
        total = np.zeros((n + 1) * wide, np.int64)
        for dist, dv in _pairs(tile, top):
            total += np.bincount(bins(dist) * wide + (dv * scale).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total[: n * wide])
        yield pd.DataFrame({"bin": (at // wide).astype("int32"), "key": (at % wide).astype(float), "n": total[at]})

    def part(tile) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for dist, dv in _pairs(tile, top):
            b, u = bins(dist), dv * scale
            hit = np.flatnonzero((u >= low[b]) & (u < high[b]))
            held.append((b[hit], dv[hit] if values else np.floor(u[hit] * float(CELLS) ** level)))
            count += len(hit)
            if count >= HELD:
                yield rows(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
        if count:
            yield rows(*map(np.concatenate, zip(*held, strict=True)))

    return _each(part if level or (n + 1) * CELLS > ARRAY else whole)


_COUNTS = "bin int, key double, n long"


def medians(at: DataFrame, top: float, w: float, n: int, km: bool) -> DataFrame:
    """bin and ``m``, the exact median of the differences, from the ``tiles`` of a network."""
    spark = at.sparkSession
    low = high = before = ranks = None
    for level in range(DEEPEST):
        kept = written(at.mapInPandas(counted(top, w, n, km, level, low, high), _COUNTS).groupBy("bin", "key").agg(F.sum("n").alias("n")))
        upto = kept.withColumn("upto", F.sum("n").over(Window.partitionBy("bin").orderBy("key")))
        if ranks is None:
            upto = upto.withColumn("all", F.sum("n").over(Window.partitionBy("bin")))
            upto = upto.withColumn("low", F.floor((F.col("all") - 1) / 2) + 1).withColumn("high", F.floor(F.col("all") / 2) + 1).withColumn("before", F.lit(0))
        else:
            upto = upto.join(ranks, "bin").withColumn("upto", F.col("upto") + F.col("before"))
        hit = lambda rank: (F.col(rank) > F.col("upto") - F.col("n")) & (F.col(rank) <= F.col("upto"))
        found = upto.where(hit("low") | hit("high")).groupBy("bin").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min(F.col("upto") - F.col("n")).alias("before"), F.first("low").alias("low"), F.first("high").alias("high"), F.sum("n").alias("inside"))
        found = written(found)
        ranks = found.select("bin", "before", "low", "high")
        low, high, left = np.full(n, np.inf), np.full(n, -np.inf), 0
        for r in found.collect():  # a row a bin
            low[r["bin"]], high[r["bin"]] = r["first"] / float(CELLS) ** level, (r["last"] + 1) / float(CELLS) ** level
            left += r["inside"]
        if left <= VALUES:
            break
    kept = at.mapInPandas(counted(top, w, n, km, 1, low, high, values=True), _COUNTS).groupBy("bin", "key").agg(F.sum("n").alias("n"))
    kept = kept.join(F.broadcast(ranks), "bin").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy("key")))  # a row a bin
    of = lambda rank: F.max(F.when((F.col(rank) > F.col("upto") - F.col("n")) & (F.col(rank) <= F.col("upto")), F.col("key")))
    return kept.groupBy("bin").agg(((of("low") + of("high")) / 2).alias("m"))


def network_function(sites: DataFrame, spacing: float, dvmax: float = 10.0, km: bool = False) -> DataFrame:
    """``aggregates.structure_function`` of all pairs of ``sites`` (site, lon, lat, v), distances in degrees.

    Rows: bin (-1 for the start (0, 1)), centre, ssf.
    """
    at = tiles(sites)
    span = at.mapInPandas(spanned(dvmax), "dmin double, dmax double").agg(F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax"))
    span = span.withColumn("w", F.when(F.col("dmax") < spacing, F.round("dmin", 1)).otherwise(F.lit(spacing)))
    r = span.withColumn("edges", F.ceil((F.col("dmax") if km else F.col("dmax") + 2) / F.col("w"))).first()
    first = at.sparkSession.range(1).select(F.lit(-1).alias("bin"), F.lit(0.0).alias("centre"), F.lit(1.0).alias("ssf"))
    if r["edges"] is None or r["edges"] < 2:
        return first
    w = F.lit(r["w"])
    edge = (lambda i: i * w) if km else (lambda i: F.pow(F.lit(10.0), i * w - 2))
    bins = medians(at, dvmax, r["w"], r["edges"] - 1, km).withColumn("inverse", 1 / F.nullif(F.col("m"), F.lit(0.0)))
    centre = F.sqrt(edge(F.col("bin")) * edge(F.col("bin") + 1))
    return bins.select("bin", centre.alias("centre"), F.try_divide(F.col("inverse"), F.max("inverse").over(Window.partitionBy(F.lit(0)))).alias("ssf")).unionByName(first)
