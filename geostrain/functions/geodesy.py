"""Geodesy: closed forms as columns, iterative forms as vectorised kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, INV_F = 6378137.0, 298.257223563
FLAT = 1 / INV_F
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
#: Eccentricity of the polyconic projection (a fixed value of its definition).
POLY_E = 0.08209443794970
#: Pixel size in metres -> degrees (fixed values).
DEGREES_OF_METRES = {100: 0.000925926, 90: 0.000833334, 60: 0.000555556, 50: 0.000462963, 30: 0.000277778, 20: 0.000185185, 10: 0.000092593}
PER_KM = {"cm": 1e2, "dm": 1e1, "m": 1.0, "km": 1e-3}


# ------------------------------------------------------------ geodesics


def inverse_arrays(lon1, lat1, lon2, lat2, azimuths: bool = True):
    """Vincenty's inverse problem: (distance m, forward and back azimuth, degrees).

    Without ``azimuths`` these are None.  Points that don't converge, near each other's antipode, get the distance on
    a sphere.
    """
    lon1, lat1, lon2, lat2 = (np.atleast_1d(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(v))) for v in (lat1, lat2))
    span = np.radians((lon2 - lon1 + 180) % 360 - 180)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span.copy()
    done = np.zeros(lam.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            ca2 = 1 - sa * sa
            c2m = np.where(ca2 == 0, 0.0, cs - 2 * su1 * su2 / ca2)
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = span + (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        us = ca2 * (A * A - B * B) / (B * B)
        big_a = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
        big_b = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m * c2m - 1) - big_b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
        dist = B * big_a * (sigma - ds)
        if not done.all():
            dist = np.where(done, dist, haversine_arrays(lat1, lon1, lat2, lon2))
        if not azimuths:
            return dist, None, None
        az1 = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
        az2 = np.degrees(np.arctan2(cu1 * np.sin(lam), -su1 * cu2 + cu1 * su2 * np.cos(lam)))
    return dist, az1, az2


def direct_arrays(lon, lat, azimuth, distance):
    """Vincenty's direct problem: (lon, lat) reached."""
    lon, lat, azimuth, distance = (np.atleast_1d(np.asarray(v, float)) for v in (lon, lat, azimuth, distance))
    az = np.radians(azimuth)
    u1 = np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    s1 = np.arctan2(np.tan(u1), np.cos(az))
    sa = np.cos(u1) * np.sin(az)
    ca2 = 1 - sa * sa
    us = ca2 * (A * A - B * B) / (B * B)
    big_a = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
    big_b = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
    first = distance / (B * big_a)
    sigma = first.copy()
    for _ in range(60):
        c2m = np.cos(2 * s1 + sigma)
        ss, cs = np.sin(sigma), np.cos(sigma)
        new = first + big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        if np.abs(new - sigma).max(initial=0) < 1e-13:
            sigma = new
            break
        sigma = new
    c2m, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    lat2 = np.arctan2(np.sin(u1) * cs + np.cos(u1) * ss * np.cos(az), (1 - FLAT) * np.hypot(sa, np.sin(u1) * ss - np.cos(u1) * cs * np.cos(az)))
    lam = np.arctan2(ss * np.sin(az), np.cos(u1) * cs - np.sin(u1) * ss * np.cos(az))
    c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    span = lam - (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return (lon + np.degrees(span) + 180) % 360 - 180, np.degrees(lat2)


def haversine_arrays(lat1, lon1, lat2, lon2):
    p, q = np.radians(lat1), np.radians(lat2)
    c = np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * np.cos(np.radians(np.asarray(lon2) - np.asarray(lon1)))
    return A * np.arccos(np.clip(c, -1, 1))


def geodesic_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Ellipsoidal distance in one of the units of ``PER_KM``."""
    factor = PER_KM[unit]

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(inverse_arrays(a, b, c, d, azimuths=False)[0] * factor)

    return distance(lon1, lat1, lon2, lat2)


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(distance, azimuth1, azimuth2)."""

    @F.pandas_udf("distance double, azimuth1 double, azimuth2 double")
    def solved(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        dist, az1, az2 = inverse_arrays(b, a, d, c)
        return pd.DataFrame({"distance": dist, "azimuth1": az1 % 360, "azimuth2": az2 % 360})

    return solved(lat1, lon1, lat2, lon2)


def geodesic_forward(lon: Column, lat: Column, azimuth: Column, distance: Column) -> Column:
    """struct(lon, lat) at a distance in metres along an azimuth."""

    @F.pandas_udf("lon double, lat double")
    def moved(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        lon2, lat2 = direct_arrays(a, b, c, d)
        return pd.DataFrame({"lon": lon2, "lat": lat2})

    return moved(lon, lat, azimuth, distance)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere, metres; the cosine is clipped to its range."""
    p, q = F.radians(lat1), F.radians(lat2)
    c = F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.lit(A) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def pixel_metres(lat: Column, lon: Column, dlat: Column, dlon: Column) -> tuple[Column, Column]:
    """Spacing of pixels in metres: (north, east)."""
    return geodesic_distance(lon, lat, lon, lat + dlat), geodesic_distance(lon, lat, lon + dlon, lat)


# ------------------------------------------------------------ frames


def enu_matrix(lon: Column, lat: Column) -> list[list[Column]]:
    """Rows east, north, up of the rotation from geocentric axes."""
    lo, la = F.radians(lon), F.radians(lat)
    return [
        [-F.sin(lo), F.cos(lo), F.lit(0.0)],
        [-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la)],
        [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)],
    ]


def geocentric(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    h = height if isinstance(height, Column) else F.lit(float(height))
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - E2) + h) * F.sin(la)


def geodetic_arrays(x, y, z):
    """(lon, lat, height): Bowring's start, then fixed-point steps."""
    p = np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - E2))
    for _ in range(12):
        n = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + E2 * n * np.sin(lat), p)
    n = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
    height = p * np.cos(lat) + z * np.sin(lat) - A * A / n
    return np.degrees(np.arctan2(y, x)), np.degrees(lat), height


def geodetic(x: Column, y: Column, z: Column) -> Column:
    @F.pandas_udf("lon double, lat double, height double")
    def solved(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        lon, lat, h = geodetic_arrays(a.to_numpy(), b.to_numpy(), c.to_numpy())
        return pd.DataFrame({"lon": lon, "lat": lat, "height": h})

    return solved(x, y, z)


def local_frame(lon: Column, lat: Column, height: Column | float = 0.0) -> list[list[Column]]:
    """Rows of the observation equations of a rotation vector: R times the cross-product matrix of X, in km."""
    r = enu_matrix(lon, lat)
    x, y, z = (c / 1000.0 for c in geocentric(lat, lon, height))
    cross = [[F.lit(0.0), z, -y], [-z, F.lit(0.0), x], [y, -x, F.lit(0.0)]]
    return [[r[i][0] * cross[0][j] + r[i][1] * cross[1][j] + r[i][2] * cross[2][j] for j in range(3)] for i in range(3)]


def rate_to_pole(wx: Column, wy: Column, wz: Column) -> tuple[Column, Column, Column]:
    """Rotation vector in rad/yr -> pole longitude and latitude, degrees per million years."""
    w = F.sqrt(wx * wx + wy * wy + wz * wz)
    return F.degrees(F.atan2(wy, wx)), 90.0 - F.degrees(F.acos(wz / w)), F.degrees(w) * 1e6


def pole_to_rate(lon: Column, lat: Column, omega: Column) -> tuple[Column, Column, Column]:
    w = F.radians(omega) * 1e-6
    lo, la = F.radians(lon), F.radians(lat)
    return F.cos(la) * F.cos(lo) * w, F.cos(la) * F.sin(lo) * w, F.sin(la) * w


# ------------------------------------------------------------ polyconic plane

_M = (
    1 - POLY_E**2 / 4 - 3 * POLY_E**4 / 64 - 5 * POLY_E**6 / 256,
    3 * POLY_E**2 / 8 + 3 * POLY_E**4 / 32 + 45 * POLY_E**6 / 1024,
    15 * POLY_E**4 / 256 + 45 * POLY_E**6 / 1024,
    35 * POLY_E**6 / 3072,
)


def _meridian(lat, sin):
    """Length of the meridian from the equator, over the radius."""
    return _M[0] * lat - _M[1] * sin(2 * lat) + _M[2] * sin(4 * lat) - _M[3] * sin(6 * lat)


def to_local(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Polyconic kilometres east and north of an origin."""
    la, span = F.radians(lat), F.radians(lon - lon0)
    m0 = A * _meridian(np.radians(lat0), np.sin)
    n = F.lit(A) / F.sqrt(1 - POLY_E**2 * F.sin(la) * F.sin(la))
    e = span * F.sin(la)
    cot = F.cos(la) / F.sin(la)
    flat = lat == 0
    x = F.when(flat, A * span / 1000).otherwise(n * cot * F.sin(e) / 1000)
    y = F.when(flat, F.lit(-m0 / 1000)).otherwise((A * _meridian(la, F.sin) - m0 + n * cot * (1 - F.cos(e))) / 1000)
    return x, y


def from_local_arrays(x, y, lon0: float, lat0: float):
    """Inverse of ``to_local`` by Newton steps in latitude, row by row."""
    x, y = np.asarray(x, float) * 1000, np.asarray(y, float) * 1000
    m0 = A * _meridian(np.radians(lat0), np.sin)
    a = (m0 + y) / A
    b = (x / A) ** 2 + a**2
    flat = np.abs(m0 + y) < 1e-9

    def gap(lat):
        m = _meridian(lat, np.sin)
        c = np.sqrt(1 - POLY_E**2 * np.sin(lat) ** 2) * np.tan(lat)
        return a * (c * m + 1) - m - 0.5 * (m * m + b) * c, c

    lat = np.where(flat, 0.5, a)
    for _ in range(100):
        h = 1e-6
        f, _ = gap(lat)
        slope = (gap(lat + h)[0] - gap(lat - h)[0]) / (2 * h)
        step = np.where(flat, 0.0, f / slope)
        lat = lat - step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    c = gap(lat)[1]
    lon = np.arcsin(np.clip(x * c / A, -1, 1)) / np.sin(lat)
    lon = np.where(flat, x / A, lon)
    return np.degrees(lon) + lon0, np.degrees(np.where(flat, 0.0, lat))


def from_local(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    @F.pandas_udf("lon double, lat double")
    def solved(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lon, lat = from_local_arrays(a.to_numpy(), b.to_numpy(), lon0, lat0)
        return pd.DataFrame({"lon": lon, "lat": lat})

    return solved(x, y)


# ------------------------------------------------------------ pixels and grids


def pixel_index(lat: Column, lon: Column, snwe: list[float], step: list[float], rounding: str = "floor") -> tuple[Column, Column]:
    """(x, y) of a point; ``step`` is (latitude, longitude)."""
    x, y = (lon - snwe[2]) / step[1] + 0.01, (lat - snwe[1]) / step[0] + 0.01
    f = {"floor": F.floor, "around": F.rint}[rounding]
    return f(x).cast("int"), f(y).cast("int")


def box_of(box: list[float], snwe: list[float], step: list[float]) -> dict[str, int]:
    """Pixel box, width and length of a geographic box (S, N, W, E)."""
    at = lambda v, start, d: int(np.floor((v - start) / d + 0.01))
    x1, x2 = at(box[2], snwe[2], step[1]), at(box[3], snwe[2], step[1])
    y1, y2 = at(box[1], snwe[1], step[0]), at(box[0], snwe[1], step[0])
    return {"y1": y1, "y2": y2, "x1": x1, "x2": x2, "width": x2 - x1, "length": y2 - y1}


def _decimal_exponent(v: Column, digits: int) -> Column:
    return F.ceil(F.log10(F.abs(v))) - digits


def ceil_to_exponent(v: Column, digits: int = 0) -> Column:
    p = F.pow(F.lit(10.0), _decimal_exponent(v, digits))
    return F.ceil(v / p) * p


def floor_to_exponent(v: Column, digits: int = 0) -> Column:
    p = F.pow(F.lit(10.0), _decimal_exponent(v, digits))
    return F.floor(v / p) * p


def aeqd_inverse(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """Azimuthal equidistant kilometres -> struct(lon, lat)."""
    return geodesic_forward(F.lit(lon0), F.lit(lat0), F.degrees(F.atan2(x, y)), F.sqrt(x * x + y * y) * 1000)
