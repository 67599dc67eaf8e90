"""The British national grid and geographic coordinates, in closed form.

The transverse Mercator projection on the Airy ellipsoid and its inverse, and the seven-parameter shift between that
datum and WGS 84, which is good to some metres, as the Ordnance Survey publishes them. Steps are columns of their own, so
that nothing is computed twice and all of it stays inside code generation. Other coordinate systems are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoids, the projection's origin and scale, and the datum shift (m, parts per million, arc seconds).
AIRY, WGS = (6377563.396, 6356256.909), (6378137.0, 6356752.3141)
SCALE, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
SHIFT, PPM, TURN = (446.448, -125.157, 542.060), -20.4894, (0.1502, 0.2470, 0.8421)
_A, _B = AIRY
_E2 = 1 - (_B / _A) ** 2
_N = (_A - _B) / (_A + _B)


def _arc(phi: Column) -> Column:
    """Length of the meridian from the origin's latitude."""
    d, s = phi - LAT0, phi + LAT0
    n2, n3 = _N * _N, _N**3
    return _B * SCALE * ((1 + _N + 1.25 * n2 + 1.25 * n3) * d - (3 * _N + 3 * n2 + 2.625 * n3) * F.sin(d) * F.cos(s) + (1.875 * n2 + 1.875 * n3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n3 * F.sin(3 * d) * F.cos(3 * s))


def to_grid(df: DataFrame, lat: str, lon: str, x: str = "x", y: str = "y") -> DataFrame:
    """Eastings and northings of latitudes and longitudes on the Airy ellipsoid, in degrees."""
    out = df.withColumns({"_p": F.radians(lat), "_l": F.radians(lon) - LON0})
    out = out.withColumns({"_s": F.sin("_p"), "_k": F.cos("_p"), "_t": F.tan("_p")})
    w = 1 - _E2 * F.col("_s") * F.col("_s")
    out = out.withColumns({"_nu": _A * SCALE / F.sqrt(w), "_rho": _A * SCALE * (1 - _E2) / (w * F.sqrt(w)), "_m": _arc(F.col("_p"))})
    out = out.withColumns({"_h": F.col("_nu") / F.col("_rho") - 1, "_t2": F.col("_t") * F.col("_t"), "_x": F.col("_l") * F.col("_k")})
    nu, h, t2, q, s, k = (F.col(c) for c in ("_nu", "_h", "_t2", "_x", "_s", "_k"))
    tan, q2 = F.col("_t"), F.col("_x") * F.col("_x")
    north = F.col("_m") + N0 + nu * tan * q2 * (0.5 + q2 / 24 * (5 - t2 + 9 * h) + q2 * q2 / 720 * (61 - 58 * t2 + t2 * t2))
    east = E0 + nu * q * (1 + q2 / 6 * (nu / F.col("_rho") - t2) + q2 * q2 / 120 * (5 - 18 * t2 + t2 * t2 + 14 * h - 58 * t2 * h))
    return out.withColumns({x: east, y: north}).drop("_p", "_l", "_s", "_k", "_t", "_nu", "_rho", "_m", "_h", "_t2", "_x")


def from_grid(df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon", rounds: int = 6) -> DataFrame:
    """Latitudes and longitudes on the Airy ellipsoid, in degrees, of eastings and northings."""
    out = df.withColumn("_p", (F.col(y) - N0) / (_A * SCALE) + LAT0)
    for _ in range(rounds):  # each round takes the error down by a factor of some hundred
        out = out.withColumn("_p", F.col("_p") + (F.col(y) - N0 - _arc(F.col("_p"))) / (_A * SCALE))
    out = out.withColumns({"_s": F.sin("_p"), "_k": F.cos("_p"), "_t": F.tan("_p"), "_e": F.col(x) - E0})
    w = 1 - _E2 * F.col("_s") * F.col("_s")
    out = out.withColumns({"_nu": _A * SCALE / F.sqrt(w), "_rho": _A * SCALE * (1 - _E2) / (w * F.sqrt(w))})
    out = out.withColumns({"_h": F.col("_nu") / F.col("_rho") - 1, "_t2": F.col("_t") * F.col("_t"), "_d": F.col("_e") / F.col("_nu")})
    nu, rho, h, t2, d, tan = (F.col(c) for c in ("_nu", "_rho", "_h", "_t2", "_d", "_t"))
    d2 = d * d
    phi = F.col("_p") - tan * nu / rho * d2 * (0.5 - d2 / 24 * (5 + 3 * t2 + h - 9 * t2 * h) + d2 * d2 / 720 * (61 + 90 * t2 + 45 * t2 * t2))
    lam = d / F.col("_k") * (1 - d2 / 6 * (nu / rho + 2 * t2) + d2 * d2 / 120 * (5 + 28 * t2 + 24 * t2 * t2) - d2 * d2 * d2 / 5040 * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2))
    return out.withColumns({lat: F.degrees(phi), lon: F.degrees(LON0 + lam)}).drop("_p", "_s", "_k", "_t", "_e", "_nu", "_rho", "_h", "_t2", "_d")


def shift_datum(df: DataFrame, lat: str, lon: str, to_wgs: bool = True) -> DataFrame:
    """Latitudes and longitudes of one datum in the other: to_wgs from the Airy ellipsoid, else to it."""
    (a, b), (a2, b2), sign = (AIRY, WGS, 1) if to_wgs else (WGS, AIRY, -1)
    e2, f2 = 1 - (b / a) ** 2, 1 - (b2 / a2) ** 2
    out = df.withColumns({"_p": F.radians(lat), "_l": F.radians(lon)})
    out = out.withColumn("_nu", a / F.sqrt(1 - e2 * F.sin("_p") * F.sin("_p")))
    out = out.withColumns({"_x": F.col("_nu") * F.cos("_p") * F.cos("_l"), "_y": F.col("_nu") * F.cos("_p") * F.sin("_l"), "_z": F.col("_nu") * (1 - e2) * F.sin("_p")})
    s, (rx, ry, rz) = 1 + sign * PPM * 1e-6, (sign * math.radians(t / 3600) for t in TURN)
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    out = out.withColumns({"_x": sign * SHIFT[0] + s * x - rz * y + ry * z, "_y": sign * SHIFT[1] + rz * x + s * y - rx * z, "_z": sign * SHIFT[2] - ry * x + rx * y + s * z})
    out = out.withColumn("_r", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).withColumn("_p", F.atan2(F.col("_z"), F.col("_r") * (1 - f2)))
    for _ in range(4):
        out = out.withColumn("_p", F.atan2(F.col("_z") + f2 * a2 / F.sqrt(1 - f2 * F.sin("_p") * F.sin("_p")) * F.sin("_p"), F.col("_r")))
    return out.withColumns({lat: F.degrees("_p"), lon: F.degrees(F.atan2(F.col("_y"), F.col("_x")))}).drop("_p", "_l", "_nu", "_x", "_y", "_z", "_r")


def sql_to_grid(lat: str, lon: str, table: str, key: str) -> str:
    """SQL of to_grid over a table, for the counterpart."""
    d, s, n2, n3 = f"(p-{LAT0!r})", f"(p+{LAT0!r})", _N * _N, _N**3
    arc = f"{_B * SCALE!r}*({1 + _N + 1.25 * n2 + 1.25 * n3!r}*{d}-{3 * _N + 3 * n2 + 2.625 * n3!r}*sin({d})*cos({s})+{1.875 * n2 + 1.875 * n3!r}*sin(2*{d})*cos(2*{s})-{35 / 24 * n3!r}*sin(3*{d})*cos(3*{s}))"
    a = f"SELECT {key}, radians({lat}) AS p, radians({lon})-({LON0!r}) AS l FROM {table}"
    b = f"SELECT *, 1-{_E2!r}*sin(p)*sin(p) AS w, tan(p)*tan(p) AS t2, l*cos(p) AS q, {arc} AS m FROM ({a})"
    c = f"SELECT *, {_A * SCALE!r}/sqrt(w) AS nu, {_A * SCALE * (1 - _E2)!r}/(w*sqrt(w)) AS rho FROM ({b})"
    e = f"SELECT *, nu/rho-1 AS h FROM ({c})"
    return (f"SELECT {key}, {E0}+nu*q*(1+q*q/6*(nu/rho-t2)+q*q*q*q/120*(5-18*t2+t2*t2+14*h-58*t2*h)) AS x, m+({N0})+nu*tan(p)*q*q*(0.5+q*q/24*(5-t2+9*h)+q*q*q*q/720*(61-58*t2+t2*t2)) AS y FROM ({e})")
