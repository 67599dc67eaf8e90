"""The package's scalar functions as SQL functions: each is a SQL expression, so that calls are inlined and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import calendar, physics, solar

_HUMIDITY = {f"{a}_to_{b}".replace(" ", "_"): (a, b) for a in physics.HUMIDITIES for b in physics.HUMIDITIES if a != b}


def _wind_at_height(speed: Column, zi: Column, zo: Column) -> Column:
    at = F.when((zo > 5.42 / 67.8) & (zo < 0.2), 0.2).otherwise(zo)
    return speed * F.ln(67.8 * at - 5.42) / F.ln(67.8 * zi - 5.42)


#: name -> (parameters with their types, what gives the expression of these columns)
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "saturation_vapour_pressure": ("tc double", physics.satvap),
    "dew_point": ("ea double, tc double", physics.dewpoint),
    "lapse_rate": ("tc double, rh double, pk double", physics.lapse_rate),
    "sea_to_atmos_pressure": ("psl double, z double", physics.sea_to_atmos_pressure),
    "atmos_to_sea_pressure": ("pres double, z double", physics.atmos_to_sea_pressure),
    "longwave_up": ("tc double", physics.lw_up),
    "shortwave_down": ("net double, cloud double, elev double", physics.sw_down),
    "wind_at_height": ("speed double, zi double, zo double", _wind_at_height),
    "wind_speed": ("u double, v double", physics.wind_speed),
    "wind_direction": ("u double, v double", physics.wind_direction),
    "wind_u": ("speed double, direction double", physics.wind_u),
    "wind_v": ("speed double, direction double", physics.wind_v),
    "cardinal_point": ("direction double", physics.cardinal),
    "julian_day": ("ts timestamp", solar.julian_day),
    "solar_time": ("lt double, lon double, jd int", solar.solar_time),
    "solar_altitude": ("jd int, lt double, lat double, lon double", solar.altitude),
    "solar_zenith": ("jd int, lt double, lat double, lon double", solar.zenith),
    "solar_azimuth": ("jd int, lt double, lat double, lon double", solar.azimuth),
    "day_length": ("jd int, lat double", solar.day_length),
    "clear_sky_radiation": ("jd int, lt double, lat double, lon double", solar.clear_sky),
    "real_date_of_360day_hours": ("hours double", lambda hours: calendar.repair_360day(calendar.decode_360day(hours))),
    **{f"humidity_{name}": ("h double, tc double, pk double", lambda h, tc, pk, ab=ab: physics.convert_humidity(h, *ab, tc, pk)) for name, ab in _HUMIDITY.items()},
}


def register(spark: SparkSession) -> list[str]:
    """Makes all FUNCTIONS temporary SQL functions of the session; returns their names."""
    for name, (parameters, make) in FUNCTIONS.items():
        names = [p.split()[0] for p in parameters.split(", ")]
        made = spark.createDataFrame([], parameters).select(make(*(F.col(n) for n in names)).alias("out"))
        expression = made._jdf.queryExecution().analyzed().expressions().head().child()
        kind = made.schema["out"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression.sql()}")
    return list(FUNCTIONS)
