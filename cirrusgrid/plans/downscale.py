"""Daily to hourly, and coarse to fine, as compositions of operators and expressions.

Hourly columns of one cell and day are made by one window and one explode; coarse to fine is one join on computed
weights for all variables together. Rows of the fine grid are never expanded to hours before they need to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics, solar
from ..operators import bias, grid, rain, temporal, wind
from ..session import keep

DAILY = ("tmin", "tmax", "relhum", "pres", "swrad", "lwrad", "windspeed", "winddir", "prec")


def to_hourly(daily: DataFrame, cell: Sequence[str], day: str, lat: Column, lon: Column, min_humidity: float = 10.0, rain_cut: float = 0.0) -> DataFrame:
    """All variables of a daily table (columns DAILY) by the hour: temp, relhum, pres, swrad, lwrad, windspeed, winddir, prec.

    Humidity goes through specific humidity, wind through its components, radiation through the clear-sky share; every
    variable but temperature and direction keeps its daily mean where its limits allow.
    """
    mean = (F.col("tmin") + F.col("tmax")) / 2
    base = daily.withColumns({
        "q": physics.convert_humidity(F.col("relhum"), "relative", "specific", mean, F.col("pres")),
        "p": F.col("pres"), "u": physics.wind_u(F.col("windspeed"), F.col("winddir")), "v": physics.wind_v(F.col("windspeed"), F.col("winddir")),
        "r": F.when(F.col("prec") < rain_cut, 0.0).otherwise(F.col("prec")) / 24,
    })
    # The clear-sky share is a day's, and its neighbours are looked up, before a day becomes 24 rows.
    base = solar.daily_clear_sky(base, solar.julian_day(F.col(day)), lat, lon, "_c").withColumn("share", F.coalesce(F.try_divide(F.col("swrad"), F.col("_c")), F.lit(0.5)))
    base = base.withColumn("share", physics.clamp(F.col("share"), 0.0, 1.0)).drop("_c")
    keys = [*cell, day]
    of = Window.partitionBy(*keys)
    smooth = ["q", "p", "u", "v", "r", "share"]
    out = temporal.hourly_temperature(temporal.with_neighbours(base, cell, day, smooth), cell, day, lat, lon)
    out = temporal.between_neighbours(out, smooth).withColumn("cs", solar.clear_sky(solar.julian_day(F.col(day)), F.col("h").cast("double"), lat, lon))
    adjust = lambda value, d: temporal.adjust_to_daily(out, cell, day, value, F.col(d))
    out = out.withColumn("pk", adjust(F.col("p"), "pres"))
    out = out.withColumn("rh", physics.convert_humidity(F.col("q"), "specific", "relative", F.col("temp"), F.col("pk")))
    out = out.withColumn("rh", physics.clamp(adjust(F.col("rh"), "relhum"), min_humidity, 100.0))
    out = out.withColumn("sw", physics.clamp(adjust(F.col("share") * F.col("cs"), "swrad"), 0.0, physics.SOLAR))
    ea = physics.convert_humidity(F.col("rh"), "relative", "vapour pressure", F.col("temp"))
    em = F.least(F.lit(1.0), physics.clear_emissivity(physics.dewpoint(ea, F.col("temp")) + physics.KELVIN))
    out = out.withColumn("lw", em * physics.lw_up(F.col("temp"), 1.0)).withColumn("lw", adjust(F.col("lw"), "lwrad"))
    speed = physics.wind_speed(F.col("u"), F.col("v"))
    out = out.withColumns({"ws": speed, "wd": physics.wind_direction(F.col("u"), F.col("v"))}).withColumn("ws", adjust(F.col("ws"), "windspeed"))
    rain = F.col("r") * F.coalesce(F.try_divide(F.when(F.col("prec") < rain_cut, 0.0).otherwise(F.col("prec")), F.sum("r").over(of)), F.lit(1.0))
    return out.select(*keys, "h", "temp", F.col("rh").alias("relhum"), F.col("pk").alias("pres"), F.col("sw").alias("swrad"), F.col("lw").alias("lwrad"), F.col("ws").alias("windspeed"), F.col("wd").alias("winddir"), rain.alias("prec"))


def elevated(coarse: DataFrame, dtm: DataFrame, land: DataFrame, row: str, col: str, ts: str, temps: Sequence[str], fy: float, fx: float, others: dict[str, Column] | None = None, lift_in: float = 0.0, lift_out: float = 0.0, first: dict[str, Column] | None = None) -> DataFrame:
    """(row, col, ts, temps, lr_.., others) on the cells of land (row, col, zf and what is to come along): temperatures brought to sea level by the lapse rates of coarse cells, resampled and raised again.

    coarse has the temperatures, relhum and pres; dtm its elevations, null being sea at 0. lift_in and lift_out are heights of
    measurement above the ground. others are expressions over coarse, its elevation zc and what first makes of it, and are resampled along, so that all share one join.
    """
    rates = {f"lr_{t}": physics.lapse_rate(F.col(t), F.col("relhum"), F.col("pres")) for t in temps}
    height = F.when(F.col("zc").isNull(), 0.0).otherwise(F.col("zc") + lift_in)
    lifted = {f"_0_{t}": F.col(t) + F.col(f"lr_{t}") * height for t in temps} | (others or {})
    also = [c for c in land.columns if c not in (row, col)]
    # Coarse rows are dealt out with what is given of them, which takes less room than what is made of it.
    base = coarse.join(dtm.select(row, col, F.col("elev").alias("zc")), [row, col])
    at = grid.resample(land, base, row, col, [*rates, *lifted], fy, fx, keep=[ts], carry=also, make=lambda df: df.withColumns(first or {}).withColumns(rates).withColumns(lifted))
    return at.withColumns({t: F.col(f"_0_{t}") - F.col(f"lr_{t}") * (F.col("zf") + lift_out) for t in temps}).drop(*(f"_0_{t}" for t in temps))


def temperatures(coarse: DataFrame, coarse_dtm: DataFrame, fine_dtm: DataFrame, row: str, col: str, day: str, fy: float, fx: float, drainage: DataFrame | None = None, coast: tuple | None = None, height_in: float = 2.0, height_out: float = 2.0, wind_in: float = 10.0) -> DataFrame:
    """(row, col, day, tmin, tmax, tmean) on the fine grid, of a coarse table with tmin, tmax, relhum, pres, windspeed, lwrad.

    drainage (row, col, potential) lets cold air run down by night, when the air is stable, from tmin alone. coast is (exposed,
    sea): what coast.exposures gives, and (row, col, day, sst, windspeed, winddir) on the fine grid. tmax is never below tmin.
    """
    from ..operators import coast as shore

    land = fine_dtm.where("elev is not null").select(row, col, F.col("elev").alias("zf"))
    wind = physics.wind_height(F.col("windspeed"), wind_in, height_in) if wind_in != height_in else F.col("windspeed")
    if drainage is not None:
        land = land.join(drainage.select(row, col, "potential"), [row, col], "left")
    still = {"_still": physics.stability(F.col("tmin"), wind, F.lit(0.0), F.col("lwrad"), height_in)} if drainage is not None else {}
    out = elevated(coarse, coarse_dtm, land, row, col, day, ["tmin", "tmax", "tmean"], fy, fx, still, height_in, height_out, {"tmean": (F.col("tmin") + F.col("tmax")) / 2})
    if drainage is not None:
        out = drained(out)
    if coast is not None:
        exposed, sea = coast
        for t in ("tmin", "tmax", "tmean"):
            drawn = shore.temper(out.select(row, col, day, F.col(t).alias("temp")).join(sea, [row, col, day]), exposed, row, col, day)
            out = out.join(drawn.select(row, col, day, F.col("temp").alias("_drawn")), [row, col, day], "left").withColumn(t, F.coalesce("_drawn", t)).drop("_drawn")
    lo, hi = physics.ordered(F.col("tmin"), F.col("tmax"))
    return out.withColumns({"tmin": lo, "tmax": hi}).select(row, col, day, "tmin", "tmax", "tmean")


def drained(df: DataFrame) -> DataFrame:
    """df with tmin lowered by cold air that runs down by night, when the air is stable."""
    fall = physics.cold_air_drop(F.col("lr_tmin"), F.coalesce("potential", F.lit(0.0)), F.when(F.col("_still") >= 1, 1.0).otherwise(0.0))
    return df.withColumn("tmin", F.col("tmin") + fall)


def cloud_fraction(coarse: DataFrame, coarse_dtm: DataFrame, land: DataFrame, row: str, col: str, ts: str, value: str, fy: float, fx: float) -> DataFrame:
    """(row, col, ts, value): a clear-sky share on the cells of land (row, col, zf), shifted in logits by the height above the coarse terrain."""
    moved = shifts(coarse_dtm, land, row, col, fy, fx).withColumn("_known", F.lit(True))
    # Shifts come along with the cells, so that the rows of all steps need no join.
    at = grid.resample(land.select(row, col).join(moved, [row, col], "left"), coarse, row, col, [value], fy, fx, keep=[ts], carry=["_shift", "_known"])
    return bias.logit_over(at, value).where("_known").select(row, col, ts, physics.inverse_logit(F.col(value) + F.col("_shift")).alias(value))


def shifts(coarse_dtm: DataFrame, land: DataFrame, row: str, col: str, fy: float, fx: float) -> DataFrame:
    """(row, col, _shift): what the height above the coarse terrain adds to the logits of a clear-sky share."""
    z = coarse_dtm.select(row, col, F.coalesce("elev", F.lit(0.0)).alias("zc"))
    height = grid.resample(land, z, row, col, ["zc"], fy, fx, carry=["zf"])
    d, zc = F.col("zf") - F.col("zc"), F.col("zc")
    return height.select(row, col, (-9.938e-3 - 6.550e-4 * d + 4.966e-5 * zc + 1.358e-6 * zc * d).alias("_shift"))


def clear_share(total: Column, clear: Column) -> Column:
    """Radiation over clear-sky radiation, within 0 and 1; a half where both are 0, 1 where there is some without a clear sky."""
    return F.when(clear == 0, F.when(total > 0, 1.0).when(total < 0, 0.0).otherwise(0.5)).otherwise(physics.clamp(total / clear, 0.0, 1.0))


def shortwave(coarse: DataFrame, coarse_dtm: DataFrame, fine_dtm: DataFrame, row: str, col: str, day: str, fy: float, fx: float, where: tuple[Column, Column], fine_where: tuple[Column, Column]) -> DataFrame:
    """(row, col, day, swrad) on the fine grid: the daily clear-sky share, adjusted for elevation, of the clear-sky radiation there.

    where and fine_where are latitude and longitude as expressions over the rows of either grid.
    """
    jd = solar.julian_day(F.col(day))
    share = solar.daily_clear_sky(coarse.select(row, col, day, "swrad"), jd, *where, "_cs").withColumn("share", clear_share(F.col("swrad"), F.col("_cs")))
    land = fine_dtm.where("elev is not null").select(row, col, F.col("elev").alias("zf"))
    at = cloud_fraction(share.select(row, col, day, "share"), coarse_dtm, land, row, col, day, "share", fy, fx)
    return solar.daily_clear_sky(at, jd, *fine_where, "_cs").select(row, col, day, (F.col("share") * F.col("_cs")).alias("swrad"))


def shaded(df: DataFrame, horizons: DataFrame, sky: DataFrame, row: str, col: str, azimuth: Column, altitude: Column, diffuse: Column, directions: int = 24) -> DataFrame:
    """df with swrad cut by terrain and its diffuse part difrad: the beam where the sun stands above the horizon, and the diffuse share by the sky in view.

    horizons (row, col, coefficients) has the tangent of the horizon's angle in so many directions, sky (row, col, skyview).
    """
    at = wind.by_sector(df.withColumns({"_az": azimuth, "_alt": altitude, "_dp": diffuse}), horizons, [row, col], "_az", directions).join(sky, [row, col])
    lit = (F.col("_alt") >= 0) & ~(F.col("coefficient") > F.tan(F.radians("_alt")))
    scattered = F.col("_dp") * F.col("skyview") * F.col("swrad")
    beam = F.when(lit, (1 - F.col("_dp")) * F.col("swrad")).otherwise(0.0)
    return at.withColumns({"difrad": scattered, "swrad": beam + scattered}).drop("_az", "_alt", "_dp", "coefficient", "skyview")


def to_fine(coarse: DataFrame, coarse_dtm: DataFrame, fine_dtm: DataFrame, row: str, col: str, ts: str, fy: float, fx: float, min_humidity: float = 20.0, coefficients: DataFrame | None = None) -> DataFrame:
    """temp, relhum, pres, lwrad and wind of a coarse table on a fine grid, adjusted for elevation.

    coarse has row, col, ts and temp, relhum, pres, lwrad, windspeed, winddir; the DTMs row, col and elev (null is sea). Temperature and
    pressure are brought to sea level, resampled and raised again; humidity follows vapour pressure, longwave the change in emission.
    All variables share one join. With coefficients (row, col, an array of sectors) the wind follows the terrain.
    """
    land = fine_dtm.where("elev is not null").select(row, col, F.col("elev").alias("zf"))
    if coefficients is not None:
        land = land.join(coefficients.select(row, col, "coefficients"), [row, col], "left")
    out = elevated(coarse, coarse_dtm, land, row, col, ts, ["temp"], fy, fx, _sea_level("zc"))
    return _at_height(out, coefficients is not None, min_humidity).select(row, col, ts, "temp", *FINE)


FINE = ("relhum", "pres", "lwrad", "windspeed", "winddir")


def _sea_level(z: str) -> dict[str, Column]:
    """What is resampled for FINE, over a coarse table with elevations z."""
    return {
        "p0": physics.atmos_to_sea_pressure(F.col("pres"), F.col(z)), "ea": physics.satvap(F.col("temp")) * F.col("relhum") / 100, "lwrad": F.col("lwrad"),
        "up": physics.lw_up(F.col("temp")), "u": physics.wind_u(F.col("windspeed"), F.col("winddir")), "v": physics.wind_v(F.col("windspeed"), F.col("winddir")),
    }


def _at_height(out: DataFrame, sectors: bool, min_humidity: float) -> DataFrame:
    """out, which has _sea_level()'s columns, temp and zf on the fine grid, with FINE; with sectors the wind follows coefficients."""
    speed = physics.wind_speed(F.col("u"), F.col("v"))
    if sectors:
        out = out.withColumn("_way", physics.wind_direction(F.col("u"), F.col("v")))
        speed = speed * F.coalesce(wind.of_sector("_way", wind.SECTORS), F.lit(1.0))
    return out.withColumns({
        "relhum": physics.clamp(F.col("ea") / physics.satvap(F.col("temp")) * 100, min_humidity, 100.0),
        "pres": physics.sea_to_atmos_pressure(F.col("p0"), F.col("zf")),
        "lwrad": F.col("lwrad") + physics.lw_up(F.col("temp")) - F.col("up"),
        "windspeed": speed,
        "winddir": physics.wind_direction(F.col("u"), F.col("v")),
    })


def all_to_fine(coarse: DataFrame, coarse_dtm: DataFrame, fine_dtm: DataFrame, row: str, col: str, day: str, fy: float, fx: float, where: tuple[Column, Column], fine_where: tuple[Column, Column], drainage: DataFrame | None = None, coefficients: DataFrame | None = None, coast: tuple | None = None, dry: float = 0.0) -> DataFrame:
    """Every daily variable of a coarse table on a fine grid: tmin, tmax, tmean, relhum, pres, swrad, lwrad, windspeed, winddir, prec.

    coarse has tmin, tmax, relhum, pres, swrad, lwrad, windspeed, winddir, prec. Static tables of the terrain are given, not made
    anew: drainage and coast as temperatures() takes them, coefficients as wind.coefficients gives them.
    """
    keys, temps = [row, col, day], ["tmin", "tmax", "tmean"]
    if coast is not None:
        warm = temperatures(coarse, coarse_dtm, fine_dtm, row, col, day, fy, fx, drainage, coast)
        rest = all_to_fine(coarse, coarse_dtm, fine_dtm, row, col, day, fy, fx, where, fine_where, None, coefficients, None, dry)
        return warm.join(rest.drop(*temps), keys)
    cells = fine_dtm.where("elev is not null").select(row, col, "elev")
    zf = cells.withColumnRenamed("elev", "zf")
    land = zf.join(shifts(coarse_dtm, zf, row, col, fy, fx), [row, col], "left")
    if drainage is not None:
        land = land.join(drainage.select(row, col, "potential"), [row, col], "left")
    if coefficients is not None:
        land = land.join(coefficients.select(row, col, "coefficients"), [row, col], "left")
    # What is known of a coarse cell and day is made once, resampled in one join, and finished row by row.
    # It is stored, as cells are told by their rain which of their days become wet or dry, and meet the same rain again.
    coarse = keep(coarse, "coarse")
    base = grid.fill_gaps(coarse, row, col, "prec", [day]).drop("prec").withColumnRenamed("filled", "prec")
    wet = base.select(row, col, day, "prec")
    days = rain.numbered_days(rain.regional_ranks(wet, day, "prec"), day, "regional")
    base = solar.daily_clear_sky(base.join(F.broadcast(days.select(day, "_at", "_order")), day), solar.julian_day(F.col(day)), *where, "_cs")  # a row a step
    base = keep(base.withColumn("share", clear_share(F.col("swrad"), F.col("_cs"))).drop("swrad", "_cs"), "coarse")
    targets = rain.targets(base, coarse_dtm, cells, row, col, "prec", fy, fx, dry)
    land = keep(land.join(rain.limits(targets, base, row, col, "prec", fy, fx), [row, col], "left"), "cells")
    z = coarse_dtm.select(row, col, F.col("elev").alias("_z"), F.lit(1.0).alias("_there"))
    base = base.join(z, [row, col], "left")
    known = F.col("_there").isNotNull()  # only the share and the rain are also those of cells without elevation
    lift = F.when(F.col("_z").isNull(), 0.0).otherwise(F.col("_z") + 2.0)
    rates = {f"lr_{t}": F.when(known, physics.lapse_rate(F.col(t), F.col("relhum"), F.col("pres"))) for t in temps}
    made = {f"_0_{t}": F.col(t) + F.col(f"lr_{t}") * lift for t in temps} | {"_0_temp": F.col("temp") + F.col("lr_tmean") * F.coalesce("_z", F.lit(0.0))}
    made |= {n: F.when(known, e) for n, e in _sea_level("_z").items()}
    if drainage is not None:
        made["_still"] = F.when(known, physics.stability(F.col("tmin"), physics.wind_height(F.col("windspeed"), 10.0, 2.0), F.lit(0.0), F.col("lwrad"), 2.0))
    values = [*rates, *made, "share", "prec", "_there"]
    mean = (F.col("tmin") + F.col("tmax")) / 2
    out = grid.resample(land, base, row, col, values, fy, fx, [day, "_at", "_order"], carry=[c for c in land.columns if c not in (row, col)], make=lambda df: df.withColumns({"temp": mean, "tmean": mean}).withColumns(rates).withColumns(made))
    out = out.withColumn("prec", rain.adjusted("prec"))
    out = bias.logit_over(out, "share").where("_there is not null")
    out = out.withColumns({t: F.col(f"_0_{t}") - F.col(f"lr_{t}") * (F.col("zf") + 2.0) for t in temps} | {"temp": F.col("_0_temp") - F.col("lr_tmean") * F.col("zf")})
    if drainage is not None:
        out = drained(out)
    lo, hi = physics.ordered(F.col("tmin"), F.col("tmax"))
    out = _at_height(out.withColumns({"tmin": lo, "tmax": hi}), coefficients is not None, 20.0)
    out = out.withColumn("share", physics.inverse_logit(F.col("share") + F.col("_shift"))).select(*keys, *temps, *FINE, "share", "prec")
    out = solar.daily_clear_sky(out, solar.julian_day(F.col(day)), *fine_where, "_cs").withColumn("swrad", F.col("share") * F.col("_cs"))
    return out.select(*keys, *temps, "relhum", "pres", "lwrad", "windspeed", "winddir", "swrad", "prec")
