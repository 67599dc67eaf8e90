"""Solar geometry and clear-sky radiation as Column expressions; angles in degrees unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .physics import SOLAR, clamp


def trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def julian_day(ts: Column, whole: bool = True) -> Column:
    """Astronomical Julian day of a timestamp; whole gives that of its noon as an integer, else the day's fraction counts."""
    y, m = F.year(ts), F.month(ts)
    part = F.lit(0.5) if whole else (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400.0
    day = F.dayofmonth(ts) + part
    y, m = y - F.when(m < 3, 1).otherwise(0), m + F.when(m < 3, 12).otherwise(0)
    jd = F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + day - 1524.5
    century = F.floor(y / 100)
    jd = jd + F.when(jd > 2299160, 2 - century + F.floor(century / 4)).otherwise(0)
    return F.floor(jd).cast("int") if whole else jd


def solar_time(lt: Column, lon: Column | float, jd: Column, merid: float = 0.0, dst: float = 0.0) -> Column:
    """Hours of local solar time from hours lt."""
    lon = lon if isinstance(lon, Column) else F.lit(float(lon))
    m = 6.24004077 + 0.01720197 * (jd - 2451545)
    eot = -7.659 * F.sin(m) + 9.863 * F.sin(2 * m + 3.5932)
    return lt + (4 * (lon - merid) + eot) / 60 - dst


def declination(jd: Column) -> Column:
    """Radians."""
    return math.pi * 23.5 / 180 * F.cos(2 * math.pi * ((jd - 159.5) / 365.25))


def _sin_altitude(jd: Column, st: Column, lat: Column) -> Column:
    dec, phi = declination(jd), F.radians(lat)
    return F.sin(dec) * F.sin(phi) + F.cos(dec) * F.cos(phi) * F.cos(0.261799 * (st - 12))


def altitude(jd: Column, lt: Column, lat: Column, lon: Column) -> Column:
    sh = _sin_altitude(jd, solar_time(lt, lon, jd), lat)
    return F.degrees(F.atan2(sh, F.sqrt(F.greatest(F.lit(0.0), 1 - sh * sh))))


def zenith(jd: Column, lt: Column, lat: Column, lon: Column) -> Column:
    return F.degrees(F.acos(clamp(_sin_altitude(jd, solar_time(lt, lon, jd), lat), -1.0, 1.0)))


def azimuth(jd: Column, lt: Column, lat: Column, lon: Column) -> Column:
    """Degrees from north."""
    dec, phi = declination(jd), F.radians(lat)
    tt = 0.261799 * (solar_time(lt, lon, jd) - 12)
    east = F.cos(dec) * F.sin(tt)
    south = F.sin(phi) * F.cos(dec) * F.cos(tt) - F.cos(phi) * F.sin(dec)
    sh = _sin_altitude(jd, solar_time(lt, lon, jd), lat)
    sazi = east / F.sqrt(F.greatest(F.lit(1e-300), 1 - sh * sh))
    cazi = south / F.sqrt(east * east + south * south)
    az = 180 + F.degrees(F.atan2(sazi, F.sqrt(F.greatest(F.lit(0.0), 1 - sazi * sazi))))
    return F.when((cazi < 0) & (sazi < 0), 180 - az).when(cazi < 0, 540 - az).otherwise(az)


def day_length(jd: Column, lat: Column) -> Column:
    """Hours; 24 or 0 where the sun doesn't set or rise."""
    dec, phi = declination(jd), F.radians(lat)
    hc = -0.01453808 / (F.cos(phi) * F.cos(dec)) - F.tan(phi) * F.tan(dec)
    return F.when(hc < -1, 24.0).when(hc > 1, 0.0).otherwise(8 * F.degrees(F.acos(clamp(hc, -1.0, 1.0))) / 60)


def clear_sky(jd: Column, lt: Column, lat: Column, lon: Column, tc: float = 15.0, rh: float = 80.0, pk: float = 101.3) -> Column:
    """Clear-sky shortwave (W/m2); 0 by night."""
    return clear_sky_at(_sin_altitude(jd, solar_time(lt, lon, jd), lat), tc, rh, pk)


def clear_sky_at(sa: Column, tc: float = 15.0, rh: float = 80.0, pk: float = 101.3) -> Column:
    """clear_sky by the sine of the sun's altitude."""
    s = F.greatest(sa, F.lit(1e-12))
    m = 35 * s / F.sqrt(1224 * s * s + 1)
    tr = 1.021 - 0.084 * F.sqrt(m * (0.00949 * pk + 0.051))
    xx = math.log(rh / 100) + 17.27 * tc / (237.3 + tc)
    td = 237.3 * xx / (17.27 - xx)
    u = math.exp(0.1133 - math.log(3.78) + 0.0393 * td)
    tw = 1 - 0.077 * F.pow(u * m, F.lit(0.3))
    ta = F.pow(F.lit(0.935), m)
    return F.when(sa > 0, SOLAR * s * tr * tw * ta).otherwise(0.0)


def daily_clear_sky(df: DataFrame, jd: Column, lat: Column, lon: Column, to: str, per_hour: int = 1) -> DataFrame:
    """df with the mean clear-sky radiation of a day, sampled so many times an hour; no row is multiplied.

    Hours are columns, which compile; samples in between are folded over a sequence.
    """
    out = df.withColumns({"_jd": jd, "_phi": F.radians(lat), "_lon": lon}).withColumn("_dec", declination(F.col("_jd")))
    out = out.withColumns({"_a": F.sin("_dec") * F.sin("_phi"), "_b": F.cos("_dec") * F.cos("_phi"), "_st": solar_time(F.lit(0.0), F.col("_lon"), F.col("_jd"))})
    high = lambda h: F.col("_a") + F.col("_b") * F.cos(0.261799 * (F.col("_st") + h - 12))
    n = 24 * per_hour
    if per_hour == 1:
        hours = [f"_h{i}" for i in range(n)]
        out = out.withColumns({f"_s{i}": high(float(i)) for i in range(n)}).withColumns({h: clear_sky_at(F.col(f"_s{i}")) for i, h in enumerate(hours)})
        mean = sum((F.col(h) for h in hours), F.lit(0.0)) / n
    else:
        mean = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda total, i: total + clear_sky_at(high(i / float(per_hour)))) / n
    return out.withColumn(to, mean).select(*(c for c in df.columns if c != to), to)


def with_diffuse_fraction(df: DataFrame, to: str, sw: Column, jd: Column, lt: Column, lat: Column, lon: Column) -> DataFrame:
    """df with the diffuse share of shortwave radiation by the Skartveit-Olseth model; 1 by night and without radiation.

    Steps are columns of their own, so that none is computed twice and all stay inside code generation.
    """
    c = F.col
    out = df.withColumns({"_jd": jd, "_sw": sw}).withColumn("_sh", _sin_altitude(c("_jd"), solar_time(lt, lon, c("_jd")), lat))
    out = out.withColumn("_si", F.when((c("_sw") > 0) & (c("_sh") > 1e-6), F.least("_sh", F.lit(1.0))))
    out = out.withColumn("_zd", F.degrees(F.acos("_si"))).withColumn("_high", F.exp(-0.06 * (90 - c("_zd"))))
    out = out.withColumns({"_k1": 0.83 - 0.56 * c("_high"), "_kx": 0.56 - 0.32 * c("_high")})
    out = out.withColumns({"_k": F.least(F.greatest(c("_sw") / (1352 * c("_si")), F.lit(0.0)), "_k1"), "_k2": 0.95 * c("_k1")})
    out = out.withColumn("_rho", c("_k") / c("_k1"))
    rho, k, k1, k2, kx, zd = (c(n) for n in ("_rho", "_k", "_k1", "_k2", "_kx", "_zd"))
    out = out.withColumns({
        "_sigma": F.when(rho > 1.04, 0.12 + 0.65 * (rho - 1.04)).otherwise(0.021 + 0.397 * rho - 0.231 * rho * rho - 0.13 * F.exp(-F.pow((rho - 0.931) / 0.134, F.lit(2.0)) * 0.834)),
        "_d1": F.when(zd < 88.6, 0.07 + 0.046 * zd / (93 - zd)).otherwise(1.0),
        "_kk": 0.5 * (1 + F.sin(math.pi * (k - 0.22) / (k1 - 0.22) - math.pi / 2)),
    })
    out = out.withColumn("_d2", 1 - (1 - c("_d1")) * (0.11 * F.sqrt("_kk") + 0.15 * c("_kk") + 0.74 * c("_kk") * c("_kk")))
    out = out.withColumns({"_share": c("_d2") * k2 / (1 - k2), "_kb": F.pow(F.lit(0.81), F.pow(1 / c("_si"), F.lit(0.6)))})
    out = out.withColumn("_km", (c("_kb") + c("_share")) / (1 + c("_share")))
    share, km, pos = c("_share"), c("_km"), F.when(k > 0, k)
    level = F.when(k <= 0.22, 1.0).when(k <= k2, c("_d2")).when(k <= km, share * (1 - pos) / pos).otherwise(1 - km * (1 - share * (1 - km) / km) / pos)
    kl, kr, sig = (k - 0.14) / (kx - 0.14), (k - kx) / 0.71, F.greatest("_sigma", F.lit(0.0))
    low, top = -3 * kl * kl * (1 - kl) * F.pow(sig, F.lit(1.3)), 3 * kr * (1 - kr) * (1 - kr) * F.pow(sig, F.lit(0.6))
    delta = F.when(c("_sigma") <= 0.01, 0.0).when((k >= kx) & (k < kx + 0.71), top).when((k >= 0.14) & (k < kx), low).otherwise(0.0)
    whole = F.when(c("_sw").isNull() | c("_sh").isNull(), F.lit(None)).when(c("_si").isNull(), 1.0).otherwise(level + delta)
    return out.withColumn(to, whole).drop(*(n for n in out.columns if n not in df.columns))
