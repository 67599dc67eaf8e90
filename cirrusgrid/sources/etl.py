"""From tables of climate-model and reanalysis output, as they land from their files, to climate tables.

The files' own decoding is left to whatever lands them; here a table has one row for a cell and time, and the model's variables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, physics
from ..operators import grid, temporal

#: The decades in which files of the two kinds of model collections come (fixed values).
DECADES = {
    "land-rcm": [(f"{y}1201", f"{y + 10}1130") for y in range(1980, 2080, 10)],
    "land-gcm": [(f"{y}1201", f"{y + 10}1130") for y in range(1899, 2099, 10)],
}


def decades(spark: SparkSession, collection: str, start: str, end: str) -> DataFrame:
    """(decade, first, last) of the files that overlap the dates from start to end."""
    if collection not in DECADES:
        raise ValueError(f"collection is one of {sorted(DECADES)}")
    rows = spark.createDataFrame([(f"{a}-{b}", f"{a[:4]}-{a[4:6]}-{a[6:]}", f"{b[:4]}-{b[4:6]}-{b[6:]}") for a, b in DECADES[collection]], "decade string, first string, last string")
    rows = rows.select("decade", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    return rows.where((F.col("last") > F.to_date(F.lit(start))) & (F.col("first") < F.to_date(F.lit(end))))


def missing_files(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which of the expected files aren't there."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def model_daily(raw: DataFrame, dtm: DataFrame, cell: Sequence[str], hours: str, wind_height: float = 10.0, white: float = 0.19, black: float = 0.22) -> DataFrame:
    """Daily climate of a model with months of 30 days: (cell, d, tmin, tmax, relhum, pres, prec, cloud, windspeed, winddir, swrad, lwrad).

    raw has hours since 1970 in that calendar and tasmin, tasmax (°C), hurs (%), psl (hPa), pr (mm), clt (%), uas, vas (m/s), rls and
    rss (W/m2, net). Dates become real ones, days that these lack are interpolated, humidity is cut to 100 and radiation made downward.
    """
    values = ["tasmin", "tasmax", "hurs", "psl", "pr", "clt", "uas", "vas", "rls", "rss"]
    dated = raw.withColumn("d", calendar.repair_360day(calendar.decode_360day(F.col(hours)))).where("d is not null")
    full = temporal.fill_days(dated.select(*cell, "d", *values), cell, "d", values).join(dtm.select(*cell, "elev"), list(cell), "left")
    u, v, mean = F.col("uas"), F.col("vas"), (F.col("tasmin") + F.col("tasmax")) / 2
    return full.select(
        *cell, "d", F.col("tasmin").alias("tmin"), F.col("tasmax").alias("tmax"), F.when(F.col("hurs") > 100, 100.0).otherwise(F.col("hurs")).alias("relhum"),
        physics.change_units(F.col("psl"), "hPa", "kPa").alias("pres"), F.col("pr").alias("prec"), F.col("clt").alias("cloud"),
        physics.wind_speed(u, v).alias("windspeed"), physics.wind_direction(u, v).alias("winddir"),
        physics.sw_down(F.col("rss"), F.col("clt"), F.col("elev"), white, black).alias("swrad"), (F.col("rls") + physics.lw_up(mean)).alias("lwrad"),
    )


def reanalysis_hourly(raw: DataFrame, land: DataFrame, cell: Sequence[str], ts: str, factor: float = 1.285, zo: float = 2.0) -> DataFrame:
    """Hourly climate of a reanalysis: (cell, ts, temp, relhum, pres, swrad, difrad, lwrad, windspeed, winddir, prec).

    raw has t2m and d2m (K), sp (Pa), ssrd, fdir and strd (J/m2 an hour), u10 and v10 (m/s), tp (m); land the share of land of each
    cell, by which the daily range is widened at coasts. Wind is brought to height zo.
    """
    day = raw.withColumn("_d", F.to_date(ts)).withColumn("_t", physics.change_units(F.col("t2m"), "K", "degC"))
    least = day.groupBy(*cell, "_d").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    at = day.join(least, [*cell, "_d"]).join(land.select(*cell, "land"), list(cell))
    span = F.col("_hi") - F.col("_lo")
    share = F.coalesce(F.try_divide(F.col("_t") - F.col("_lo"), span), F.lit(0.0))
    wide = physics.coastal_range(span, F.col("land"), factor)
    at = at.withColumn("temp", share * wide + (F.col("_hi") + F.col("_lo")) / 2 - wide / 2)
    dew = physics.change_units(F.col("d2m"), "K", "degC")
    rh = physics.satvap(dew) / physics.satvap(F.col("_t")) * 100
    hourly = lambda c: F.greatest(F.col(c) / 3600, F.lit(0.0))
    u, v = F.col("u10"), F.col("v10")
    return at.select(
        *cell, ts, "temp", F.when(rh > 100, 100.0).otherwise(rh).alias("relhum"), physics.change_units(F.col("sp"), "Pa", "kPa").alias("pres"),
        hourly("ssrd").alias("swrad"), F.greatest((F.col("ssrd") - F.col("fdir")) / 3600, F.lit(0.0)).alias("difrad"), hourly("strd").alias("lwrad"),
        physics.wind_height(physics.wind_speed(u, v), 10.0, zo).alias("windspeed"), physics.wind_direction(u, v).alias("winddir"), physics.change_units(F.col("tp"), "m", "mm").alias("prec"),
    )


#: How a day's value comes from its hours.
DAILY_FOLDS: dict[str, tuple[str, str]] = {
    "tmin": ("temp", "min"), "tmax": ("temp", "max"), "tmean": ("temp", "mean"), "relhum": ("relhum", "mean"), "pres": ("pres", "mean"), "swrad": ("swrad", "mean"), "difrad": ("difrad", "mean"),
    "lwrad": ("lwrad", "mean"), "prec": ("prec", "sum"), "u": ("u", "mean"), "v": ("v", "mean"), "skyem": ("skyem", "mean"), "windspeed": ("windspeed", "mean"),
}


def hourly_to_daily(df: DataFrame, cell: Sequence[str], ts: str, wanted: Sequence[str] = tuple(DAILY_FOLDS), land: DataFrame | None = None) -> DataFrame:
    """The wanted daily variables of an hourly climate table in one fold; wind directions are those of the mean vector. With land, only its cells."""
    unknown = set(wanted) - {*DAILY_FOLDS, "winddir"}
    if unknown:
        raise ValueError(f"no daily fold for {sorted(unknown)}")
    rows = df.join(land.select(*cell).distinct(), list(cell), "left_semi") if land is not None else df
    speed, way = F.col("windspeed"), F.col("winddir")
    rows = rows.withColumns({"u": physics.wind_u(speed, way), "v": physics.wind_v(speed, way), "skyem": physics.sky_emissivity(F.col("lwrad"), physics.lw_up(F.col("temp")))})
    out = temporal.fold(rows, cell, ts, {n: DAILY_FOLDS[n] for n in dict.fromkeys([*(w for w in wanted if w in DAILY_FOLDS), "u", "v"])})
    return out.withColumn("winddir", physics.wind_direction(F.col("u"), F.col("v"))).select(*cell, "d", *wanted)


def sea_surface(sst: DataFrame, land: DataFrame, row: str, col: str, ts: str, value: str, start: str, end: str) -> DataFrame:
    """Sea temperatures from a month before start to a month after end, filled towards the coast step by step; land is null.

    The window's month on either side lets later steps interpolate in time.
    """
    kept = sst.where((F.col(ts) >= F.add_months(F.to_date(F.lit(start)), -1)) & (F.col(ts) <= F.add_months(F.to_date(F.lit(end)), 1)))
    cells = kept.select(row, col).distinct()
    steps = kept.select(ts).distinct()
    now = cells.crossJoin(F.broadcast(steps)).join(kept.select(row, col, ts, value), [row, col, ts], "left")  # steps are as few as months
    water = F.col("_land").isNull()
    for _ in range(5):
        filled = grid.focal_mean(now, row, col, value, 4, [ts])
        now = filled.select(row, col, ts, F.coalesce(value, "focal").alias(value))
    return now.join(land.select(row, col, F.lit(True).alias("_land")), [row, col], "left").select(row, col, ts, F.when(water, F.col(value)).alias(value))
