"""Operator 9: quality rules and robust multivariate outliers.

One pass counts each text's statistics.  Rows that pass the base rules are
vectors of transformed statistics.  The minimum covariance determinant of a
group is searched from several starts: medians and absolute deviations, all
rows, and two halves of the rows by a hash.  In a concentration step the
``H_SHARE`` rows nearest to the current centre give the next centre and
covariance, which never enlarges the determinant; steps go on until no group's
determinant falls any more.  After ``TRIALS`` steps the start with the least
determinant is kept.  What it reaches is reweighted: rows within the ``REWEIGHT`` quantile of chi-squared give the final
estimate.  Rows with a large Mahalanobis distance to it are rejected.

Groups are the languages with their sources, the languages, and all rows.  The
estimate of a group is drawn towards that of the group above it, as if that had
``PRIOR`` rows; so a group of any size has one, and nothing switches with size.

A step is two aggregates with map-side partials (a histogram of the logarithms
of the distances, then sums and cross products), for all groups and starts at
once, so a group of any size costs a few rows a task; all rows take part.

Defined results: a null text has no words and fails the base rule; texts of any
length are counted whole; a null language or source is a group of its own; rows
at one distance are on one side together; repeated rows count each; a group of
equal rows has the least spread (``FLOOR``) and keeps them; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, join_by_size, mix, pieces, stored, text_buffer, trimmed

H_SHARE = 0.75
#: Halves of the rows that are starts, besides medians and all rows.
HALVES = 2
#: Determinants that fall by less than this share fall no more.
STABLE = 0.01
#: Steps of all starts before the best one goes on alone.
TRIALS = 2
#: Bins of a factor e of squared distance.
FINE = 64
#: Bytes of a group's state in a broadcast, at most.
STATE_BYTES = 1024
#: Rows of the group above that stand behind a group's estimate.
PRIOR = 100.0
#: Squared Mahalanobis distance from which a row is an outlier.
CUTOFF = 150.0
#: Least standard deviation of each transformed statistic.
FLOOR = (0.3, 0.15, 0.25, 0.3, 0.4)
#: Quantiles 0.5 and 0.975 of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN, REWEIGHT = 4.351, 12.833

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Words of each text in windows of ``n`` words that the text has twice or more."""
    counts, h = words.counts(), words.hashes()
    text = np.repeat(np.arange(len(counts)), counts)
    if len(h) < n:
        return np.zeros(len(counts), np.int64)
    window = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        window = mix(window * np.uint64(3) + h[j : len(h) - n + 1 + j])
    valid = np.flatnonzero(text[: len(h) - n + 1] == text[n - 1 :])
    key = mix(window[valid] ^ (text[valid].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 3)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(valid), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = valid[twice]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
    return covered[words.first[1:]] - covered[words.first[:-1]]


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            found += line in seen
            seen.add(line)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, at = text_buffer(batch.column(1))
        words = Words(data, at)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.start] += 1
        inside[words.end] -= 1
        points = np.r_[0, np.cumsum(((data & 0xC0) != 0x80) & (np.cumsum(inside[:-1]) > 0))]
        symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
        lines = [duplicate_lines(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [words.counts(), points[at[1:]] - points[at[:-1]], symbols[at[1:]] - symbols[at[:-1]], np.array(lines, np.int64), repeated_words(words)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(c, np.int64)) for c in columns), batch.column(2), batch.column(3)], ["doc_id", *STATISTICS, "lang", "source"])


def statistics(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS) + ", lang string, source string"
    counted = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(trimmed(_counted), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def transformed() -> list[Column]:
    n = F.col("n_words")
    return [F.log(n), F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n), F.log1p(F.col("n_dup_lines").cast("double")), F.log1p(100 * F.col("n_repeat_words") / n)]


P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with no variance below ``FLOOR``: correlations stay, and no direction is flat."""
    least = np.square(FLOOR)
    scale = np.sqrt(np.maximum(least, np.diag(cov)))
    scaled = cov / np.outer(scale, scale)
    np.fill_diagonal(scaled, 1.0)
    values, vectors = np.linalg.eigh(scaled)
    return (vectors * np.maximum(values, 1e-3)) @ vectors.T * np.outer(scale, scale)


def moments(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a count, sums and sums of products."""
    mean = np.array([row[f"s{i}"] for i in range(P)]) / row["n"]
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = row[f"q{i}{j}"] / row["n"] - mean[i] * mean[j]
    return mean, cov


def quadratic(cov: np.ndarray) -> list[float]:
    """Coefficients of the squared distance, in the order of ``_PAIRS``."""
    inv = np.linalg.inv(cov)
    return [float(inv[i, j]) * (1 if i == j else 2) for i, j in _PAIRS]


_STATE = "pool string, start int, centre array<double>, inverse array<double>, logdet double, falls boolean"


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, inverse covariance and determinant of each group and start from its sums.

    Where a determinant doesn't fall (``logdet`` is the one before), the state
    before stays.
    """
    for pdf in batches:
        made = []
        for row in pdf.to_dict("records"):
            mean, cov = moments(row)
            cov = floored(cov)
            logdet = float(np.linalg.slogdet(cov)[1])
            if logdet < row["logdet"]:
                made.append((mean.tolist(), quadratic(cov), logdet, logdet < row["logdet"] - STABLE))
            else:
                made.append((row["centre"], row["inverse"], row["logdet"], False))
        centre, inverse, logdet, falls = zip(*made, strict=True) if made else ((), (), (), ())
        yield pd.DataFrame({"pool": pdf["pool"], "start": pdf["start"], "centre": centre, "inverse": inverse, "logdet": logdet, "falls": falls})


X = [f"x{i}" for i in range(P)]


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(P)]
    return sum((F.col("inverse")[k] * d[i] * d[j] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS)]


def starts(vectors: DataFrame) -> DataFrame:
    """First centres and covariances of each pool."""
    spread = stored(vectors.groupBy("pool").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"m{c}") for c in X)), "medians")
    deviations = join_by_size(vectors, spread, "pool", "inner", STATE_BYTES * spread.count()).groupBy("pool").agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"m{c}")), 0.5, 1000).alias(f"d{c}") for c in X))
    scale = [F.greatest(F.pow(1.4826 * F.col(f"d{c}"), 2), F.lit(FLOOR[i] ** 2)) for i, c in enumerate(X)]
    inverse = F.array(*((1 / scale[i]) if i == j else F.lit(0.0) for i, j in _PAIRS))
    robust = spread.join(deviations, "pool").select("pool", F.lit(0).alias("start"), F.array(*(F.col(f"m{c}") for c in X)).alias("centre"), inverse.alias("inverse"), F.lit(float("inf")).alias("logdet"), F.lit(True).alias("falls"))
    halves = [F.when(F.pmod(F.xxhash64("row", F.lit(h)), F.lit(2)) == 0, h + 2) for h in range(HALVES)]
    dealt = vectors.withColumn("start", F.explode(F.array_compact(F.array(F.lit(1), *halves))))
    nothing = F.array().cast("array<double>")
    sums = dealt.groupBy("pool", "start").agg(*_sums()).withColumns({"centre": nothing, "inverse": nothing, "logdet": F.lit(float("inf"))})
    others = sums.mapInPandas(_estimates, _STATE)
    return stored(robust.unionByName(others.withColumn("logdet", F.lit(float("inf")))), "starts")


def concentrated(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """The state after one more step of every group and start."""
    size = STATE_BYTES * state.count()
    at = join_by_size(vectors, state.select("pool", "start", "centre", "inverse"), "pool", "inner", size)
    at = at.select("pool", "start", *X, F.floor(F.log(F.greatest(_distance(), F.lit(1e-9))) * FINE).cast("int").alias("bin"))
    counts = at.groupBy("pool", "start", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("pool", "start")
    reached = counts.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    bound = reached.where(F.col("upto") >= H_SHARE * F.col("all")).groupBy("pool", "start").agg(F.min("bin").alias("bound"))
    sums = join_by_size(at, bound, ["pool", "start"], "inner", size).where("bin <= bound").groupBy("pool", "start").agg(*_sums())
    before = join_by_size(sums, state.select("pool", "start", "centre", "inverse", "logdet"), ["pool", "start"], "inner", size)
    return stored(before.mapInPandas(_estimates, _STATE), "steps")


def least_determinants(vectors: DataFrame) -> DataFrame:
    """pool, centre, inverse of the least determinant that concentration steps reach."""
    state = starts(vectors)
    for _ in range(TRIALS):
        state = concentrated(vectors, state)
    best = F.min_by(F.struct("start", "centre", "inverse", "logdet", "falls"), F.struct("logdet", "start"))
    state = stored(state.groupBy("pool").agg(best.alias("best")).select("pool", "best.*"), "best")
    while not state.where("falls").isEmpty():  # each round but the last lowers a determinant, which the floor bounds, by a set share
        state = concentrated(vectors, state)
    return state.select("pool", "centre", "inverse")


def estimates(vectors: DataFrame) -> DataFrame:
    """pool and the sums of the rows that the reweighting step takes."""
    best = least_determinants(vectors)
    size = STATE_BYTES * best.count()
    at = join_by_size(vectors, best, "pool", "inner", size).select("pool", *X, _distance().alias("d2"))
    factor = stored(at.groupBy("pool").agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / CHI2_MEDIAN, F.lit(1.0)).alias("factor")), "factor")
    return stored(join_by_size(at, factor, "pool", "inner", size).where(F.col("d2") <= F.col("factor") * REWEIGHT).groupBy("pool").agg(*_sums()), "reweighted")


def drawn(row: dict, above: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """A group's mean and covariance, drawn towards those of the group above it."""
    mean, cov = moments(row)
    if above is None:
        return mean, cov
    share = row["n"] / (row["n"] + PRIOR)
    return share * mean + (1 - share) * above[0], share * cov + (1 - share) * above[1]


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Final centre and inverse of each group, from the sums of the levels above it."""
    for pdf in batches:
        centre, inverse = [], []
        for row in pdf.to_dict("records"):
            estimate = None
            for level in ("every", "tongue", "own"):
                estimate = drawn(row[level], estimate)
            centre.append(estimate[0].tolist())
            inverse.append(quadratic(floored(estimate[1])))
        yield pd.DataFrame({"pool": pdf["pool"], "centre": centre, "inverse": inverse})


def robust_distances(vectors: DataFrame) -> DataFrame:
    """row and d2 for rows with columns row, own (group), tongue (the one above) and x0 .. x4."""
    levels = F.array(F.concat(F.lit("own\t"), "own"), F.concat(F.lit("tongue\t"), "tongue"), F.lit("every"))
    pooled = stored(vectors.select("row", F.explode(levels).alias("pool"), *X), "pooled")
    found = estimates(pooled)
    sums = F.struct("n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _PAIRS))
    of = lambda level: found.select(F.col("pool").alias(f"{level}_pool"), sums.alias(level))
    groups = vectors.select(F.concat(F.lit("own\t"), "own").alias("own_pool"), F.concat(F.lit("tongue\t"), "tongue").alias("tongue_pool"), F.lit("every").alias("every_pool")).distinct()
    for level in ("own", "tongue", "every"):
        groups = groups.join(of(level), f"{level}_pool")
    final = stored(groups.select(F.col("own_pool").alias("pool"), "own", "tongue", "every").mapInPandas(_composed, "pool string, centre array<double>, inverse array<double>"), "final")
    at = vectors.select("row", F.concat(F.lit("own\t"), "own").alias("pool"), *X)
    return stored(join_by_size(at, final, "pool", "inner", STATE_BYTES * final.count()).select("row", _distance().alias("d2")), "distances")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, base_failed, robust distance d2 and kept of every row."""
    rows = stored(statistics(docs).withColumn("row", F.monotonically_increasing_id()), "statistics")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    x = [c.alias(f"x{i}") for i, c in enumerate(transformed())]
    vectors = rows.where("not base_failed").select("row", F.concat_ws("\t", name(F.col("lang")), name(F.col("source"))).alias("own"), name(F.col("lang")).alias("tongue"), *x)
    out = rows.join(robust_distances(stored(vectors, "vectors")), "row", "left")
    return out.select("doc_id", *STATISTICS, "base_failed", "d2", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"))
