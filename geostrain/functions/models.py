"""Covariance and variogram models, line-of-sight geometry, design columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------ covariance of distance


def _gm1(d, c0, d0):
    return c0 * F.exp(-d / d0)


def _gm2(d, c0, d0):
    return c0 * F.exp(-(d * d) / (d0 * d0))


def _reilly(d, c0, d0):
    u = d / d0
    return c0 * (1 - 0.5 * u * u) * F.exp(-0.5 * u * u)


def _markov1(d, c0, d0):
    return c0 * (1 + d / d0) * F.exp(-d / d0)


def _markov2(d, c0, d0):
    return c0 * (1 + d / d0 + d * d / (3 * d0 * d0)) * F.exp(-d / d0)


def _tri(d, c0, d0):
    return c0 * (1 - d / (2 * d0))


def _lauer(d, c0, d0):
    return c0 / F.pow(d, d0)


def _gauss(d, c0, alpha):
    return c0 * F.exp(-alpha * alpha * d * d)


def _log(d, c0, d0, m=2):
    top = F.pow(d0, F.lit(float(m)))
    return c0 * top / (top + F.pow(d, F.lit(float(m))))


def _vestol(d, c0, a, b):
    return c0 * (a * d * d + b * d + 1)


COVARIANCE: dict[str, Callable[..., Column]] = {"gm1": _gm1, "gm2": _gm2, "reilly": _reilly, "markov1": _markov1, "markov2": _markov2, "tri": _tri, "lauer": _lauer, "gauss": _gauss, "log": _log, "vestol": _vestol}


# ------------------------------------------------------------ variograms: distance, partial sill, nugget, range


def _capped(r: Column, dmax: Column | None) -> Column:
    """The range beyond which a model is flat: under the largest distance."""
    return r if dmax is None else F.when(r > dmax, dmax - 1).otherwise(r)


def _spherical(d, p, n, r, dmax=None):
    u = d / r
    return F.when(d > _capped(r, dmax), p + n).otherwise(n + p * (1.5 * u - 0.5 * F.pow(u, F.lit(3.0))))


def _exponential(d, p, n, r, dmax=None):
    return n + p * (1 - F.exp(-3 * d / r))


def _gaussian(d, p, n, r, dmax=None):
    u = 2 * d / r
    return n + p * (1 - F.exp(-u * u))


def _cubic(d, p, n, r, dmax=None):
    u = d / r
    pw = lambda k: F.pow(u, F.lit(float(k)))
    return F.when(d >= _capped(r, dmax), n + p).otherwise(n + p * (7 - pw(2) - 8.75 * pw(3) + 3.5 * pw(5) - 0.75 * pw(7)))


def _hole_effect(d, p, n, r, dmax=None):
    u = 3 * d / r
    return n + p * (1 - (1 - u) * F.exp(-u))


def _power(d, p, n, r, dmax=None):
    return n + p * F.pow(d, r / 1000.0)


def _linear(d, p, n, r=None, dmax=None):
    return n + p * d


VARIOGRAM: dict[str, Callable[..., Column]] = {"spherical": _spherical, "exponential": _exponential, "gaussian": _gaussian, "cubic": _cubic, "hole_effect": _hole_effect, "power": _power, "linear": _linear}


def variogram_model(name: str) -> Callable[..., Column]:
    if name not in VARIOGRAM:
        raise ValueError(f"unknown variogram model {name!r}; known: {', '.join(VARIOGRAM)}")
    return VARIOGRAM[name]


# ------------------------------------------------------------ correlation of velocity components on a sphere


def angular_factors(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> dict[str, Column]:
    """Factors ee, en, ne, nn between two points."""
    a, b, span = F.radians(lat1), F.radians(lat2), F.radians(lon1 - lon2)
    return {
        "ee": F.sin(a) * F.sin(b) * F.cos(span) + F.cos(a) * F.cos(b),
        "en": F.sin(span) * F.sin(a),
        "ne": -F.sin(span) * F.sin(b),
        "nn": F.cos(span),
    }


# ------------------------------------------------------------ line of sight


def unit_vector(incidence: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """North, east and up parts of the line of sight."""
    i, a = F.radians(incidence), F.radians(azimuth)
    return F.sin(i) * F.cos(a), -F.sin(i) * F.sin(a), F.cos(i)


def los_value(n: Column, e: Column, v: Column, unit: tuple[Column, Column, Column]) -> Column:
    return n * unit[0] + e * unit[1] + v * unit[2]


def los_sigma(sn: Column, se: Column, sv: Column, unit: tuple[Column, Column, Column], compat: bool = False) -> Column:
    """Propagated sigma: in quadrature, or as the older formula has it (the
    last term unsquared, no root) with ``compat``."""
    dn, de, dv = (F.abs(u) for u in unit)
    if compat:
        inner = F.sqrt((se * de) * (se * de) + (sn * dn) * (sn * dn) + sv * dv)
        return inner * inner
    return F.sqrt((se * de) * (se * de) + (sn * dn) * (sn * dn) + (sv * dv) * (sv * dv))


def quasi_vertical(los: Column, std: Column, incidence: Column) -> tuple[Column, Column]:
    up = F.cos(F.radians(incidence))
    return los * up, std * up


# ------------------------------------------------------------ design columns


def time_design(t: Column, poly_deg: int = 1, periods: list[float] = (), steps: list[Column] = (), exps: list[tuple[Column, float]] = (), logs: list[tuple[Column, float]] = (), when: Column | None = None) -> dict[str, Column]:
    """Columns of a time function; ``t`` is in years since the reference epoch.

    Steps, exponential and logarithmic terms compare ``when`` (default ``t``)
    with their onset, strictly.
    """
    when = t if when is None else when
    out = {f"p{i}": F.pow(t, F.lit(float(i))) / math.factorial(i) if i else F.lit(1.0) for i in range(poly_deg + 1)}
    for k, period in enumerate(periods):
        angle = t * (2 * math.pi / period)
        out |= {f"c{k}": F.cos(angle), f"s{k}": F.sin(angle)}
    out |= {f"h{k}": (when > at).cast("double") for k, at in enumerate(steps)}
    out |= {f"e{k}": F.when(when > at, 1 - F.exp(-(when - at) / tau)).otherwise(0.0) for k, (at, tau) in enumerate(exps)}
    out |= {f"l{k}": F.when(when > at, F.log1p((when - at) / tau)).otherwise(0.0) for k, (at, tau) in enumerate(logs)}
    return out


#: Terms of a plane by order: powers of x and y, in the order of coefficients.
PLANE_TERMS: dict[float, list[tuple[int, int]]] = {
    0: [(0, 0)],
    1: [(1, 0), (0, 1), (0, 0)],
    1.5: [(1, 0), (0, 1), (1, 1), (0, 0)],
    2: [(2, 0), (0, 2), (1, 1), (1, 0), (0, 1), (0, 0)],
    3: [(3, 0), (0, 3), (2, 0), (0, 2), (1, 1), (1, 0), (0, 1), (0, 0)],
}


def plane_design(x: Column, y: Column, order: float) -> list[Column]:
    """One list of terms serves design, evaluation and covariance."""
    def power(c: Column, k: int) -> Column:
        return F.lit(1.0) if k == 0 else c if k == 1 else c * power(c, k - 1)

    return [power(x, i) * power(y, j) for i, j in PLANE_TERMS[order]]


def plane_value(x: Column, y: Column, coefficients: list[Column] | list[float], order: float) -> Column:
    return sum((t * c for t, c in zip(plane_design(x, y, order), coefficients, strict=True)), F.lit(0.0))


def plane_variance(x: Column, y: Column, q: list[list[float]], order: float) -> Column:
    """a' Q a with the terms a at (x, y)."""
    terms = plane_design(x, y, order)
    return sum((terms[i] * terms[j] * q[i][j] for i in range(len(terms)) for j in range(len(terms))), F.lit(0.0))
