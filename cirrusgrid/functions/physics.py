"""Humidity, pressure, radiation and wind as Column expressions. A null input gives null unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants the results depend on.
KELVIN, STEFAN, EMISSIVITY, SOLAR = 273.15, 5.67e-8, 0.97, 1352.778


def clamp(v: Column, lo, hi) -> Column:
    """v within [lo, hi]; null stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi)))


def satvap(tc: Column) -> Column:
    """Saturation vapour pressure (kPa), over ice below 0 °C."""
    form = lambda e0, latent: e0 * F.exp(latent / 461.5 * (1 / KELVIN - 1 / (tc + KELVIN)))
    return F.when(tc < 0, form(0.61078, F.lit(2.834e6))).otherwise(form(0.6112, 2.501e6 - 2340 * tc))


def dewpoint(ea: Column, tc: Column) -> Column:
    """Dew point (°C) of a vapour pressure, or frost point where that is below 0."""
    form = lambda e0, latent: 1 / (1 / KELVIN - 461.5 / latent * F.ln(ea / e0)) - KELVIN
    water = form(0.6112, 2.501e6 - 2340 * tc)
    return F.when(water < 0, form(0.61078, F.lit(2.834e6))).otherwise(water)


HUMIDITIES = ("relative", "absolute", "specific", "vapour pressure")


def convert_humidity(h: Column, intype: str, outtype: str, tc: Column | float = 11.0, pk: Column | float = 101.3) -> Column:
    """Between relative (%), absolute (kg/m3), specific (kg/kg) humidity and vapour pressure (kPa), by the Magnus form."""
    if intype not in HUMIDITIES or outtype not in HUMIDITIES:
        raise ValueError(f"humidity is one of {HUMIDITIES}")
    tc, pk = (x if isinstance(x, Column) else F.lit(float(x)) for x in (tc, pk))
    e0 = 0.6108 * F.exp(17.27 * tc / (tc + 237.3))
    ws = 18.02 / 28.97 * (e0 / pk)
    tk = tc + KELVIN
    into = {"relative": h, "vapour pressure": h / e0 * 100, "specific": h / ws * 100, "absolute": tk * h / 2.16679 / e0 * 100}
    rh = into[intype]
    return {"relative": rh, "vapour pressure": e0 * rh / 100, "specific": rh / 100 * ws, "absolute": 2.16679 * (e0 * rh / 100) / tk}[outtype]


def lapse_rate(tc: Column, rh: Column, pk: Column) -> Column:
    """Moist adiabatic lapse rate (°C/m)."""
    ea = satvap(tc) * rh / 100
    rv = 0.622 * ea / (pk - ea)
    tk = tc + KELVIN
    return 9.8076 * (1 + 2501000 * rv / (287 * tk)) / (1003.5 + 0.622 * 2501000.0**2 * rv / (287 * tk * tk))


def _height_factor(z: Column) -> Column:
    return F.pow((293 - 0.0065 * F.coalesce(z, F.lit(0.0))) / 293, F.lit(5.26))


def sea_to_atmos_pressure(psl: Column, z: Column) -> Column:
    """Pressure at height z (m); no height is sea level."""
    return psl * _height_factor(z)


def atmos_to_sea_pressure(pres: Column, z: Column) -> Column:
    return pres / _height_factor(z)


def lw_up(tc: Column, em: float = EMISSIVITY) -> Column:
    """Upward longwave radiation (W/m2)."""
    return STEFAN * em * F.pow(tc + KELVIN, F.lit(4.0))


def sw_down(net: Column, cloud: Column, elev: Column, ws: float = 0.19, bs: float = 0.22, sea: float = 0.065) -> Column:
    """Downward shortwave from net, by white- and black-sky albedo weighted by cloud (%); no elevation is sea."""
    c = cloud / 100
    albedo = F.when(elev.isNull(), F.lit(sea)).otherwise((1 - c) * bs + c * ws)
    return net / (1 - albedo)


def wind_height(speed: Column, zi: Column | float, zo: float) -> Column:
    """Wind speed at height zo from that at zi, by the logarithmic profile."""
    zi = zi if isinstance(zi, Column) else F.lit(float(zi))
    zo = 0.2 if 5.42 / 67.8 < zo < 0.2 else zo
    return speed * F.ln(F.lit(67.8 * zo - 5.42)) / F.ln(67.8 * zi - 5.42)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def floor_mod(a: Column, n: float) -> Column:
    return a - n * F.floor(a / n)


def wind_direction(u: Column, v: Column) -> Column:
    """Where the wind blows from, degrees from north in [0, 360)."""
    return floor_mod(F.degrees(F.atan2(u, v)) + 180, 360.0)


def wind_u(speed: Column, direction: Column) -> Column:
    """Component such that wind_direction gives the direction back."""
    return -speed * F.sin(F.radians(direction))


def wind_v(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


# The sixteen points, clockwise from north.
POINTS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def cardinal(direction: Column) -> Column:
    """One of sixteen points; null outside [0, 360]."""
    at = F.floor((direction + 11.25) / 22.5).cast("int") % 16
    return F.when((direction >= 0) & (direction <= 360), F.element_at(F.array(*map(F.lit, POINTS)), at + 1))


def stability(tc: Column, u2: Column, sw: Column, lw: Column, refhgt: float = 2.0) -> Column:
    """Stability of the air near the ground; cold air drains from 1 on."""
    d, zm = 0.65 * 0.12, 0.1 * 0.12
    uf = 0.4 * u2 / math.log((refhgt - d) / zm)
    heat = (sw + lw - lw_up(tc)) * 0.5
    return F.try_divide(-(0.4 * 9.81 * (refhgt - d) * heat), 1241 * (tc + KELVIN) * uf * uf * uf)


def cad_flag(tc: Column, u2: Column, sw: Column, lw: Column, refhgt: float = 2.0) -> Column:
    """1 where the air is stable enough for cold-air drainage, else 0."""
    return F.when(stability(tc, u2, sw, lw, refhgt) >= 1, 1.0).otherwise(0.0)


def coastal_range(dtr: Column, land: Column, factor: float = 1.285) -> Column:
    """Diurnal range widened by the share of sea in a cell."""
    return dtr * (1 + factor * (1 - land))


def clear_emissivity(td_kelvin: Column) -> Column:
    return 0.787 + 0.764 * F.ln(td_kelvin / KELVIN)


def sky_emissivity(lwdn: Column, lwup: Column) -> Column:
    return F.least(F.try_divide(lwdn, lwup), F.lit(1.0))


def coastal_weight(m: Column, res: float) -> Column:
    """Coastal exposure rescaled by resolution in logit space, on either side of one half; 0 and 1 stay."""
    r = math.log(res)
    low = (-6.74389 + 1.08141 * r, -0.6167 + 0.3197 * r)
    high = (-3.1163 + 0.4818 * r, 1.5842 - 0.7922 * r + 0.1104 * r * r)
    part = lambda ab: 1 / (1 + F.exp(-(ab[0] + ab[1] * F.ln(m / (1 - m)))))
    return F.when((m > 0) & (m <= 0.5), part(low)).when((m > 0.5) & (m < 1), part(high)).otherwise(m)


#: What a unit is times and plus to give another (fixed values).
UNITS = {("hPa", "kPa"): (0.1, 0.0), ("Pa", "kPa"): (0.001, 0.0), ("K", "degC"): (1.0, -KELVIN), ("degC", "K"): (1.0, KELVIN), ("m", "mm"): (1000.0, 0.0), ("1", "%"): (100.0, 0.0)}


def change_units(v: Column, unit: str, to: str) -> Column:
    if unit == to:
        return v
    if (unit, to) not in UNITS:
        raise ValueError(f"no conversion from {unit} to {to}")
    factor, offset = UNITS[unit, to]
    return v * factor + offset


def cold_air_drop(lapse: Column, multiplier: Column, flag: Column) -> Column:
    """Change in temperature by cold-air drainage."""
    return lapse * -multiplier * flag


def ordered(lo: Column, hi: Column) -> tuple[Column, Column]:
    """lo and hi, exchanged where they are the wrong way round; a null stays where it is."""
    wrong = hi < lo
    return F.when(wrong, hi).otherwise(lo), F.when(wrong, lo).otherwise(hi)


def logit(v: Column) -> Column:
    """Null at 0 and 1 and outside."""
    return F.when((v > 0) & (v < 1), F.ln(v / (1 - v)))


def inverse_logit(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def finite_logit(v: Column, lo: Column, hi: Column) -> Column:
    """logit with lo and hi, the least and greatest finite ones of the set, in place of those of 0 and 1."""
    return F.when(v == 0, lo).when(v == 1, hi).otherwise(logit(v))


def finite_log(v: Column, lo: Column) -> Column:
    """Logarithm with lo, the least finite one of the set, in place of that of 0."""
    return F.when(v == 0, lo).when(v > 0, F.ln(v))


def coastal_temperature(tc: Column, sst: Column, wind: Column, upwind: Column, around: Column) -> tuple[Column, Column]:
    """Temperature and the weight of the sea in it; upwind and around are logits of the share of land up-wind and in all directions."""
    p2 = 0.10420 * F.sqrt(wind) - 0.47852
    w = inverse_logit(-0.1095761 + p2 * (upwind + 3.401197) - 0.1553487 * around)
    return w * sst + (1 - w) * tc, w
