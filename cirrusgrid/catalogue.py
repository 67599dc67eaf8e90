"""The registered queries, each beside its DuckDB counterpart. Results are rounded, as the engines' last bits differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import sql, view
from .functions import calendar, physics, solar
from .operators import bias, grid, rain, temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of (load, spark), load giving a view or table by name."""
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return register


def rounded(df: DataFrame, keys: list[str], digits: int = 6, **values: Column) -> DataFrame:
    return df.select(*keys, *(F.round(v, digits).alias(n) for n, v in values.items()))


def plainly_rounded(value: Column, digits: int) -> Column:
    """What round gives for a double, which goes through a decimal for each value: only values next to a tie, or very large ones, need that."""
    unit = float(10**digits)
    scaled = value * unit
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-5)
    return F.when(plain, F.floor(scaled + 0.5) / unit).otherwise(F.round(value, digits))


def rounded_all(df: DataFrame) -> DataFrame:
    return df.select(*(plainly_rounded(F.col(c), 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# SQL of formulas, for the counterparts.
def s_satvap(t: str) -> str:
    return f"(CASE WHEN {t}<0 THEN 0.61078*exp(2.834e6/461.5*(1/273.15-1/({t}+273.15))) ELSE 0.6112*exp((2.501e6-2340*{t})/461.5*(1/273.15-1/({t}+273.15))) END)"


def s_jd(ts: str) -> str:
    y, m = f"(year({ts})-CASE WHEN month({ts})<3 THEN 1 ELSE 0 END)", f"(month({ts})+CASE WHEN month({ts})<3 THEN 12 ELSE 0 END)"
    return f"CAST(floor(floor(365.25*({y}+4716))+floor(30.6001*({m}+1))+day({ts})+0.5-1524.5+2-floor({y}/100.0)+floor(floor({y}/100.0)/4)) AS INT)"


def s_st(lt: str, lon: str, jd: str) -> str:
    m = f"(6.24004077+0.01720197*({jd}-2451545))"
    return f"({lt}+(4*({lon})+(-7.659*sin({m})+9.863*sin(2*{m}+3.5932)))/60)"


def s_dec(jd: str) -> str:
    return f"(pi()*23.5/180*cos(2*pi()*(({jd}-159.5)/365.25)))"


def s_sh(jd: str, st: str, lat: str) -> str:
    return f"(sin({s_dec(jd)})*sin(radians({lat}))+cos({s_dec(jd)})*cos(radians({lat}))*cos(0.261799*({st}-12)))"


# Sites have a latitude and longitude by their row and column.
LAT, LON = "(48+row_*0.5)", "(-6+col_*0.5)"
def lat() -> Column:
    return 48 + F.col("row_") * 0.5


def lon() -> Column:
    return -6 + F.col("col_") * 0.5


SUN = f"SELECT cell, ts, tc, jd, lt, {LAT} AS lat, {LON} AS lon, {s_st('lt', LON, 'jd')} AS st FROM (SELECT *, {s_jd('ts')} AS jd, hour(ts)+minute(ts)/60.0 AS lt FROM v_obs)"
SUNNY = f"-- with\ns AS ({SUN}), t AS (SELECT *, {s_sh('jd', 'st', 'lat')} AS sh, {s_dec('jd')} AS dec, 0.261799*(st-12) AS tt FROM s) "


def sunny(load) -> DataFrame:
    return load("v_obs").withColumns({"lat": lat(), "lon": lon(), "jd": solar.julian_day(F.col("ts")), "lt": F.hour("ts") + F.minute("ts") / 60.0})


def angles() -> list[Column]:
    return [F.col(c) for c in ("jd", "lt", "lat", "lon")]


@query("SELECT cell, CAST(ts AS DATE) AS d, round(min(tc),6) AS tmin, round(max(tc),6) AS tmax, round(avg(tc),6) AS tmean, round(sum(tc),4) AS tsum, count(*) AS n, "
       "round(avg(0.6108*exp(17.27*tc/(tc+237.3))),6) AS ea FROM v_obs GROUP BY cell, CAST(ts AS DATE)")
def hour_to_day(load):
    df = load("v_obs").withColumn("ea", physics.convert_humidity(F.lit(100.0), "relative", "vapour pressure", F.col("tc"))).withColumn("one", F.lit(1))
    folded = temporal.fold(df, ["cell"], "ts", {"tmin": ("tc", "min"), "tmax": ("tc", "max"), "tmean": ("tc", "mean"), "tsum": ("tc", "sum"), "n": ("one", "sum"), "ea": ("ea", "mean")})
    return folded.select("cell", "d", *(F.round(c, 6).alias(c) for c in ("tmin", "tmax", "tmean")), F.round("tsum", 4).alias("tsum"), "n", F.round("ea", 6).alias("ea"))


@query("SELECT cell, CAST(floor((rn-1)/24) AS BIGINT) AS block, round(avg(tc),6) AS tc FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) AS rn FROM v_obs) GROUP BY 1, 2")
def hour_to_day_positions(load):
    return rounded(temporal.fold_positions(load("v_obs"), ["cell"], "ts", "tc"), ["cell", "block"], tc=F.col("tc"))


@query("SELECT cell, d, CAST(h AS INT) AS h, round(tmean,6) AS tmean FROM v_day, unnest(range(24)) AS u(h)")
def day_to_hour_step(load):
    return rounded(temporal.hours(load("v_day")), ["cell", "d", "h"], tmean=F.col("tmean"))


LINEAR = ("SELECT cell, d, CAST(h AS INT) AS h, tmean, CASE WHEN h>=11 THEN tmean+(nx-tmean)*(h-11)/24.0 ELSE pv+(tmean-pv)*(h+13)/24.0 END AS v FROM (SELECT *, "
          "coalesce(lag(tmean) OVER w,tmean) AS pv, coalesce(lead(tmean) OVER w,tmean) AS nx FROM v_day WINDOW w AS (PARTITION BY cell ORDER BY d)), unnest(range(24)) AS u(h)")


@query(f"SELECT cell, d, h, round(v,6) AS v FROM ({LINEAR})")
def day_to_hour_linear(load):
    return rounded(temporal.day_to_hour(load("v_day"), ["cell"], "d", ["tmean"]), ["cell", "d", "h"], v=F.col("tmean"))


@query(f"SELECT cell, d, h, round(v*coalesce(tmean/nullif(avg(v) OVER (PARTITION BY cell, d),0),1),5) AS v FROM ({LINEAR})")
def adjust_daily_mean(load):
    df = temporal.day_to_hour(load("v_day").withColumn("v", F.col("tmean")), ["cell"], "d", ["v"])
    return rounded(df, ["cell", "d", "h"], 5, v=temporal.adjust_to_daily(df, ["cell"], "d", F.col("v"), F.col("tmean")))


FILL = ("-- with\ne AS (SELECT cell, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM v_day GROUP BY cell), "
        "j AS (SELECT e.cell, e.d, tmean FROM e LEFT JOIN v_day v ON e.cell=v.cell AND e.d=v.d), "
        "k AS (SELECT *, last_value(tmean IGNORE NULLS) OVER b AS v0, first_value(tmean IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN tmean IS NOT NULL THEN d END IGNORE NULLS) OVER b AS d0, "
        "first_value(CASE WHEN tmean IS NOT NULL THEN d END IGNORE NULLS) OVER a AS d1 FROM j WINDOW b AS (PARTITION BY cell ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "a AS (PARTITION BY cell ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ")


@query(FILL + "SELECT cell, d, round(coalesce(tmean, v0+(v1-v0)*(d-d0)/nullif(d1-d0,0)),6) AS tmean FROM k")
def fill_calendar(load):
    return rounded(temporal.fill_days(load("v_day").select("cell", "d", "tmean"), ["cell"], "d", ["tmean"]), ["cell", "d"], tmean=F.col("tmean"))


@query("SELECT cell, ts, round(tc,6) AS tc FROM v_obs WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'")
def subset_time(load):
    return rounded(load("v_obs").where("ts between timestamp'2024-01-10' and timestamp'2024-01-20'"), ["cell", "ts"], tc=F.col("tc"))


@query("SELECT o_orderkey, CAST(y AS INT) AS y, CAST(m AS INT) AS m, CAST(ceil((r-(m-1)*720)/24) AS INT) AS d FROM (SELECT *, ceil(r/720) AS m FROM (SELECT o_orderkey, floor(h/8640)+1970 AS y, "
       "h-floor(h/8640)*8640 AS r FROM (SELECT o_orderkey, o_orderkey*24+12.0 AS h FROM orders)))")
def decode_360day(load):
    ymd = calendar.decode_360day(F.col("o_orderkey") * 24 + 12.0)
    return load("orders").select("o_orderkey", ymd.alias("t")).select("o_orderkey", "t.y", "t.m", "t.d")


@query("SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', y, CASE WHEN m=2 AND d=1 THEN 1 WHEN m=2 AND d=30 THEN 3 ELSE m END, CASE WHEN m=3 THEN d+1 WHEN m=2 AND d=1 THEN 31 WHEN m=2 AND d=30 THEN 1 WHEN m=2 THEN d-1 ELSE d END) AS DATE) AS d "
       "FROM (SELECT o_orderkey, CAST(1970+floor(o_orderkey/360) AS INT) AS y, CAST(floor((o_orderkey%360)/30) AS INT)+1 AS m, CAST(o_orderkey%30 AS INT)+1 AS d FROM orders)")
def repair_360day(load):
    k = F.col("o_orderkey")
    ymd = F.struct((1970 + F.floor(k / 360)).cast("int").alias("y"), (F.floor((k % 360) / 30) + 1).cast("int").alias("m"), (k % 30 + 1).cast("int").alias("d"))
    return load("orders").select("o_orderkey", ymd.alias("t")).select("o_orderkey", calendar.repair_360day(F.col("t")).alias("d"))


@query("SELECT c.cell, c.d, CASE WHEN elev IS NOT NULL THEN prec END AS prec FROM v_coarse c LEFT JOIN v_dtmc m ON c.cell=m.cell")
def mask_land(load):
    return grid.mask(load("v_coarse"), load("v_dtmc"), ["cell"], "prec", "elev").select("cell", "d", "prec")


@query("SELECT c.cell, c.d, CASE WHEN elev IS NULL THEN prec END AS prec FROM v_coarse c LEFT JOIN v_dtmc m ON c.cell=m.cell")
def mask_inverse(load):
    return grid.mask(load("v_coarse"), load("v_dtmc"), ["cell"], "prec", "elev", inverse=True).select("cell", "d", "prec")


@query(f"SELECT cell, ts, round({s_satvap('tc')},6) AS es FROM v_obs")
def satvap(load):
    return rounded(load("v_obs"), ["cell", "ts"], es=physics.satvap(F.col("tc")))


@query(f"-- with\na AS (SELECT cell, ts, tc, {s_satvap('tc')}*0.7 AS ea FROM v_obs), b AS (SELECT *, 1/(1/273.15-461.5/(2.501e6-2340*tc)*ln(ea/0.6112))-273.15 AS w FROM a) "
       "SELECT cell, ts, round(CASE WHEN w<0 THEN 1/(1/273.15-461.5/2.834e6*ln(ea/0.61078))-273.15 ELSE w END,6) AS td FROM b")
def dewpoint(load):
    return rounded(load("v_obs"), ["cell", "ts"], td=physics.dewpoint(physics.satvap(F.col("tc")) * 0.7, F.col("tc")))


def _humidity(intype: str, outtype: str) -> None:
    e0 = "(0.6108*exp(17.27*tc/(tc+237.3)))"
    ws, tk = f"(18.02/28.97*({e0}/100.5))", "(tc+273.15)"
    h = {"relative": "60.0", "absolute": "0.008", "specific": "0.006", "vapour pressure": "0.9"}[intype]
    rh = {"relative": h, "vapour pressure": f"{h}/{e0}*100", "specific": f"{h}/{ws}*100", "absolute": f"{tk}*{h}/2.16679/{e0}*100"}[intype]
    out = {"relative": rh, "vapour pressure": f"{e0}*({rh})/100", "specific": f"({rh})/100*{ws}", "absolute": f"2.16679*({e0}*({rh})/100)/{tk}"}[outtype]
    name = f"convert_humidity_{intype}_to_{outtype}".replace(" ", "_")
    QUERIES[name] = lambda spark, d: rounded(view(spark, d, "v_obs"), ["cell", "ts"], h=physics.convert_humidity(F.lit(float(h)), intype, outtype, F.col("tc"), 100.5))
    ORACLE[name] = sql(f"SELECT cell, ts, round({out},6) AS h FROM v_obs")


for _a in physics.HUMIDITIES:
    for _b in physics.HUMIDITIES:
        if _a != _b:
            _humidity(_a, _b)


@query(f"SELECT cell, ts, round(9.8076*(1+2501000*rv/(287*(tc+273.15)))/(1003.5+0.622*2501000.0*2501000.0*rv/(287*(tc+273.15)*(tc+273.15))),8) AS lr FROM (SELECT *, 0.622*ea/(101.3-ea) AS rv FROM (SELECT *, {s_satvap('tc')}*80/100 AS ea FROM v_obs))")
def lapse_rate(load):
    return rounded(load("v_obs"), ["cell", "ts"], 8, lr=physics.lapse_rate(F.col("tc"), F.lit(80.0), F.lit(101.3)))


@query("SELECT c.cell, d, round(pres*power((293-0.0065*coalesce(elev,0))/293,5.26),6) AS p, round(pres/power((293-0.0065*coalesce(elev,0))/293,5.26),6) AS psl FROM v_coarse c JOIN v_dtmc m ON c.cell=m.cell")
def pressure_height(load):
    df = load("v_coarse").join(load("v_dtmc").select("cell", "elev"), "cell")
    return rounded(df, ["cell", "d"], p=physics.sea_to_atmos_pressure(F.col("pres"), F.col("elev")), psl=physics.atmos_to_sea_pressure(F.col("pres"), F.col("elev")))


@query("SELECT cell, ts, round(5.67e-8*0.97*power(tc+273.15,4),4) AS lw FROM v_obs")
def lwup(load):
    return rounded(load("v_obs"), ["cell", "ts"], 4, lw=physics.lw_up(F.col("tc")))


@query("SELECT c.cell, d, round(prec/(1-CASE WHEN elev IS NULL THEN 0.065 ELSE (1-relhum/100)*0.22+relhum/100*0.19 END),5) AS sw FROM v_coarse c JOIN v_dtmc m ON c.cell=m.cell")
def swdown(load):
    df = load("v_coarse").join(load("v_dtmc").select("cell", "elev"), "cell")
    return rounded(df, ["cell", "d"], 5, sw=physics.sw_down(F.col("prec"), F.col("relhum"), F.col("elev")))


@query("SELECT cell, d, round(windspeed*ln(67.8*2-5.42)/ln(67.8*10-5.42),6) AS w FROM v_coarse")
def wind_height(load):
    return rounded(load("v_coarse"), ["cell", "d"], w=physics.wind_height(F.col("windspeed"), 10.0, 2.0))


UV = "SELECT cell, d, windspeed, winddir, -windspeed*sin(radians(winddir))+0.0 AS u, -windspeed*cos(radians(winddir))+0.0 AS v FROM v_coarse"


@query(f"SELECT cell, d, round(u,6)+0.0 AS u, round(v,6)+0.0 AS v, round(speed,6) AS speed, CASE WHEN dir>=360 THEN 0 ELSE dir END AS dir FROM (SELECT *, sqrt(u*u+v*v) AS speed, CASE WHEN sqrt(u*u+v*v)<1e-9 THEN 180 ELSE round(degrees(atan2(u,v))+180-360*floor((degrees(atan2(u,v))+180)/360),3) END AS dir FROM ({UV}))")
def uv_to_speed_dir(load):
    """There and back; without wind the direction is 180, and what rounds to 360 is 0."""
    df = load("v_coarse").withColumns({"u": physics.wind_u(F.col("windspeed"), F.col("winddir")), "v": physics.wind_v(F.col("windspeed"), F.col("winddir"))})
    u, v = F.col("u"), F.col("v")
    speed = physics.wind_speed(u, v)
    way = F.when(speed < 1e-9, 180.0).otherwise(F.round(physics.wind_direction(u, v), 3))
    return df.select("cell", "d", (F.round(u, 6) + 0.0).alias("u"), (F.round(v, 6) + 0.0).alias("v"), F.round(speed, 6).alias("speed"), F.when(way >= 360, 0.0).otherwise(way).alias("dir"))


ROSE = "list_extract(['" + "','".join(physics.POINTS) + "'], CAST(CAST(floor((winddir+11.25)/22.5) AS INT)%16 AS INT)+1)"


@query(f"SELECT cell, d, CASE WHEN winddir BETWEEN 0 AND 360 THEN {ROSE} END AS point FROM v_coarse")
def cardinal(load):
    return load("v_coarse").select("cell", "d", physics.cardinal(F.col("winddir")).alias("point"))


@query(f"SELECT {ROSE} AS point, round(avg(windspeed),6) AS mean, round(max(windspeed),6) AS most, count(*) AS n FROM v_coarse WHERE winddir BETWEEN 0 AND 360 GROUP BY 1")
def wind_rose(load):
    df = load("v_coarse").withColumn("point", physics.cardinal(F.col("winddir"))).where("point is not null")
    return df.groupBy("point").agg(F.round(F.avg("windspeed"), 6).alias("mean"), F.round(F.max("windspeed"), 6).alias("most"), F.count(F.lit(1)).alias("n"))


@query("SELECT c.cell, d, CASE WHEN -(0.4*9.81*(2.0-0.078)*((200+relhum-5.67e-8*0.97*power(10+273.15,4))*0.5))/(1241*(10+273.15)*power(0.4*(windspeed+0.5)/ln((2.0-0.078)/0.012),3)) >= 1 THEN 1 ELSE 0 END AS flag FROM v_coarse c")
def cad_conditions(load):
    return load("v_coarse").select("cell", "d", physics.cad_flag(F.lit(10.0), F.col("windspeed") + 0.5, F.lit(200.0), F.col("relhum")).cast("int").alias("flag"))


@query("SELECT cell, d, round((tmax-tmin)*(1+1.285*(1-0.4)),6) AS dtr FROM v_day")
def coastal_range(load):
    return rounded(load("v_day"), ["cell", "d"], dtr=physics.coastal_range(F.col("tmax") - F.col("tmin"), F.lit(0.4)))


@query(f"SELECT cell, ts, {s_jd('ts')} AS jd FROM v_obs")
def julian_day(load):
    return load("v_obs").select("cell", "ts", solar.julian_day(F.col("ts")).alias("jd"))


@query(SUNNY + "SELECT cell, ts, round(st,6) AS st, round(degrees(atan2(sh,sqrt(greatest(0,1-sh*sh)))),6) AS alt, round(degrees(acos(greatest(-1,least(1,sh)))),5) AS zen FROM t")
def solar_altitude(load):
    df = sunny(load)
    return df.select("cell", "ts", F.round(solar.solar_time(F.col("lt"), F.col("lon"), F.col("jd")), 6).alias("st"), F.round(solar.altitude(*angles()), 6).alias("alt"), F.round(solar.zenith(*angles()), 5).alias("zen"))


@query(SUNNY + "SELECT cell, ts, round(CASE WHEN c<0 AND s<0 THEN 180-az WHEN c<0 THEN 540-az ELSE az END,4) AS azi FROM (SELECT *, 180+degrees(atan2(s,sqrt(greatest(0,1-s*s)))) AS az FROM "
       "(SELECT cell, ts, cos(dec)*sin(tt)/sqrt(greatest(1e-300,1-sh*sh)) AS s, (sin(radians(lat))*cos(dec)*cos(tt)-cos(radians(lat))*sin(dec))/sqrt(power(cos(dec)*sin(tt),2)+power(sin(radians(lat))*cos(dec)*cos(tt)-cos(radians(lat))*sin(dec),2)) AS c FROM t))")
def solar_azimuth(load):
    return rounded(sunny(load), ["cell", "ts"], 4, azi=solar.azimuth(*angles()))


@query("SELECT cell, d, round(CASE WHEN hc<-1 THEN 24 WHEN hc>1 THEN 0 ELSE 8*degrees(acos(greatest(-1,least(1,hc))))/60 END,6) AS dl FROM (SELECT cell, d, -0.01453808/(cos(p)*cos(dec))-tan(p)*tan(dec) AS hc FROM "
       f"(SELECT cell, d, radians({LAT}) AS p, {s_dec(s_jd('d'))} AS dec FROM v_day))")
def day_length(load):
    return rounded(load("v_day"), ["cell", "d"], dl=solar.day_length(solar.julian_day(F.col("d")), lat()))


CLEAR = ("(CASE WHEN sh>0 THEN 1352.778*s*(1.021-0.084*sqrt(m*(0.00949*101.3+0.051)))*(1-0.077*power(exp(0.1133-ln(3.78)+0.0393*(237.3*xx/(17.27-xx)))*m,0.3))*power(0.935,m) ELSE 0 END)")
CLEARLY = SUNNY + f", c AS (SELECT *, {CLEAR} AS cs FROM (SELECT *, 35*s/sqrt(1224*s*s+1) AS m, ln(0.8)+17.27*15/(237.3+15) AS xx FROM (SELECT *, greatest(sh,1e-12) AS s FROM t))) "


@query(CLEARLY + "SELECT cell, ts, round(cs,4) AS cs FROM c")
def clearsky_hourly(load):
    return rounded(sunny(load), ["cell", "ts"], 4, cs=solar.clear_sky(*angles()))


@query(CLEARLY.replace(SUN, f"SELECT cell, d, jd, lt, {LAT} AS lat, {LON} AS lon, {s_st('lt', LON, 'jd')} AS st FROM (SELECT *, {s_jd('d')} AS jd, h*1.0 AS lt FROM v_day, unnest(range(24)) AS u(h))") + "SELECT cell, d, round(avg(cs),4) AS cs FROM c GROUP BY cell, d")
def clearsky_daily(load):
    return rounded(solar.daily_clear_sky(load("v_day"), solar.julian_day(F.col("d")), lat(), lon(), "cs"), ["cell", "d"], 4, cs=F.col("cs"))


DIFFUSE = (SUNNY + ", a AS (SELECT cell, ts, 120+10*tc AS sw, sh, CASE WHEN 120+10*tc>0 AND sh>1e-6 THEN sh END AS si FROM t), b AS (SELECT *, degrees(acos(greatest(-1,least(1,si)))) AS zd FROM a), "
           "c AS (SELECT *, 0.83-0.56*exp(-0.06*(90-zd)) AS k1, 0.56-0.32*exp(-0.06*(90-zd)) AS kx FROM b), e AS (SELECT *, CASE WHEN sw/(1352*si)<0 THEN 0 WHEN sw/(1352*si)>k1 THEN k1 ELSE sw/(1352*si) END AS k FROM c), "
           "f AS (SELECT *, k/k1 AS rho, 0.95*k1 AS k2, CASE WHEN zd<88.6 THEN 0.07+0.046*zd/(93-zd) ELSE 1 END AS d1, 0.5*(1+sin(pi()*(k-0.22)/(k1-0.22)-pi()/2)) AS kk FROM e), "
           "g AS (SELECT *, CASE WHEN rho>1.04 THEN 0.12+0.65*(rho-1.04) ELSE 0.021+0.397*rho-0.231*rho*rho-0.13*exp(-power((rho-0.931)/0.134,2)*0.834) END AS sg, 1-(1-d1)*(0.11*sqrt(kk)+0.15*kk+0.74*kk*kk) AS d2 FROM f), "
           "i AS (SELECT *, d2*k2/(1-k2) AS sh2, power(0.81,power(1/si,0.6)) AS kb FROM g), j AS (SELECT *, (kb+sh2)/(1+sh2) AS km FROM i), l AS (SELECT *, sh2*(1-km)/km AS dm, (k-0.14)/(kx-0.14) AS kl, (k-kx)/0.71 AS kr, greatest(sg,0) AS s0 FROM j) "
           "SELECT cell, ts, round(CASE WHEN si IS NULL THEN 1 ELSE (CASE WHEN k<=0.22 THEN 1 WHEN k<=k2 THEN d2 WHEN k<=km THEN sh2*(1-k)/k ELSE 1-km*(1-dm)/k END)+(CASE WHEN sg<=0.01 THEN 0 WHEN k>=kx AND k<kx+0.71 THEN 3*kr*(1-kr)*(1-kr)*power(s0,0.6) "
           "WHEN k>=0.14 AND k<kx THEN -3*kl*kl*(1-kl)*power(s0,1.3) ELSE 0 END) END,5) AS dif FROM l")


@query(DIFFUSE)
def diffuse_fraction(load):
    return rounded(solar.with_diffuse_fraction(sunny(load), "dif", 120 + 10 * F.col("tc"), *angles()), ["cell", "ts"], 5, dif=F.col("dif"))


@query("SELECT cell, ts, round(sqrt((power(tc-coalesce(lag(tc) OVER w,tc),2)+power(tc-coalesce(lead(tc) OVER w,tc),2))/2),6) AS v FROM v_obs WINDOW w AS (PARTITION BY cell ORDER BY ts)")
def variability_index(load):
    return rounded(temporal.variability(load("v_obs"), ["cell"], "ts", "tc"), ["cell", "ts"], v=F.col("variability"))


@query("-- with\na AS (SELECT cell, d, prec, row_number() OVER (PARTITION BY cell ORDER BY d) AS i, count(*) OVER (PARTITION BY cell) AS n FROM v_coarse), b AS (SELECT cell, d, prec, i, true AS own FROM a UNION ALL SELECT cell, d, prec, i-n, false FROM a WHERE i>n-4) "
       "SELECT cell, d, round(m,6) AS m FROM (SELECT cell, d, own, CASE WHEN count(prec) OVER w=5 THEN avg(prec) OVER w END AS m FROM b WINDOW w AS (PARTITION BY cell ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE own")
def circular_moving_average(load):
    return rounded(temporal.moving_average(load("v_coarse"), ["cell"], "d", "prec", 5), ["cell", "d"], m=F.col("moving"))


@query("SELECT cell, min(d) AS \"start\", max(d) AS \"end\", count(*) AS days FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d)-row_number() OVER (PARTITION BY cell, prec>=30 ORDER BY d) AS g FROM v_coarse) WHERE prec>=30 GROUP BY cell, g")
def wet_spells(load):
    return temporal.spells(load("v_coarse"), ["cell"], "d", F.col("prec") >= 30)


@query("SELECT o.cell, ts, round(CASE WHEN hi>lo THEN (tc-lo)/(hi-lo) ELSE 0 END*(tmax+1-(tmin-1))+tmin-1,6) AS blended FROM (SELECT *, CAST(ts AS DATE) AS d, min(tc) OVER (PARTITION BY cell, CAST(ts AS DATE)) AS lo, max(tc) OVER (PARTITION BY cell, CAST(ts AS DATE)) AS hi FROM v_obs) o JOIN v_day v ON o.cell=v.cell AND o.d=v.d")
def blend_temperature(load):
    daily = load("v_day").withColumns({"tmin": F.col("tmin") - 1, "tmax": F.col("tmax") + 1})
    df = temporal.blend_temperature(load("v_obs").withColumn("d", F.to_date("ts")), daily, ["cell"], "d", "tc")
    return rounded(df, ["cell", "ts"], blended=F.col("blended"))


@query(None)
def temperature_hourly(load):
    """Hourly temperatures; each day's extremes are the daily ones."""
    return rounded(temporal.hourly_temperature(load("v_day"), ["cell"], "d", lat(), lon()), ["cell", "d", "h"], temp=F.col("temp"))


@query("SELECT CAST(floor((row_-1)/5) AS INT)+1 AS row_, CAST(floor((col_-1)/4) AS INT)+1 AS col_, round(avg(elev),6) AS elev FROM v_dtmf GROUP BY 1, 2")
def block_aggregate(load):
    df = load("v_dtmf").withColumns({"row_": F.floor((F.col("row_") - 1) / 5).cast("int") + 1, "col_": F.floor((F.col("col_") - 1) / 4).cast("int") + 1})
    return rounded(df.groupBy("row_", "col_").agg(F.avg("elev").alias("elev")), ["row_", "col_"], elev=F.col("elev"))


BILINEAR = ("SELECT f.row_, f.col_, sum(CASE WHEN c.elev IS NOT NULL THEN w*c.elev END)/nullif(sum(CASE WHEN c.elev IS NOT NULL THEN w END),0) AS elev FROM (SELECT row_, col_, r0+a AS r, c0+b AS c, (CASE WHEN a=0 THEN 1-(y-r0) ELSE y-r0 END)*(CASE WHEN b=0 THEN 1-(x-c0) ELSE x-c0 END) AS w FROM "
            "(SELECT *, CAST(floor(y) AS INT) AS r0, CAST(floor(x) AS INT) AS c0 FROM (SELECT row_, col_, (row_-0.5)/5+0.5 AS y, (col_-0.5)/4+0.5 AS x FROM v_dtmf)), unnest([0,1]) AS p(a), unnest([0,1]) AS q(b)) f JOIN v_dtmc c ON f.r=c.row_ AND f.c=c.col_ WHERE w<>0 GROUP BY f.row_, f.col_")


@query(f"SELECT row_, col_, round(elev,6) AS elev FROM ({BILINEAR})")
def resample_bilinear(load):
    return rounded(grid.resample(load("v_dtmf"), load("v_dtmc"), "row_", "col_", ["elev"], 5, 4), ["row_", "col_"], elev=F.col("elev"))


@query("SELECT f.row_, f.col_, round(c.elev,6) AS elev FROM v_dtmf f JOIN v_dtmc c ON c.row_=CAST(floor((f.row_-1)/5) AS INT)+1 AND c.col_=CAST(floor((f.col_-1)/4) AS INT)+1")
def resample_near(load):
    return rounded(grid.resample(load("v_dtmf"), load("v_dtmc"), "row_", "col_", ["elev"], 5, 4, method="near"), ["row_", "col_"], elev=F.col("elev"))


@query("SELECT a.row_, a.col_, round(avg(b.elev),6) AS focal FROM v_dtmf a LEFT JOIN v_dtmf b ON b.row_ BETWEEN a.row_-2 AND a.row_+2 AND b.col_ BETWEEN a.col_-2 AND a.col_+2 GROUP BY a.row_, a.col_")
def focal_mean(load):
    return rounded(grid.focal_mean(load("v_dtmf"), "row_", "col_", "elev", 2), ["row_", "col_"], focal=F.col("focal"))


def _time_stats(name: str, key: Callable[[], Column], key_sql: str) -> None:
    def run(spark, d):
        per = view(spark, d, "v_coarse").withColumn("k", key().cast("int")).groupBy("cell", "k").agg(F.avg("prec").alias("v"))
        return per.groupBy("k").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"), F.round(F.min("v"), 6).alias("least"))

    QUERIES[f"time_stats_{name}"] = run
    ORACLE[f"time_stats_{name}"] = sql(f"SELECT k, round(avg(v),6) AS mean, round(max(v),6) AS most, round(min(v),6) AS least FROM (SELECT cell, CAST({key_sql} AS INT) AS k, avg(prec) AS v FROM v_coarse GROUP BY 1, 2) GROUP BY k")


for _n, _k, _s in (
    ("year", lambda: F.year("d"), "year(d)"), ("month", lambda: F.month("d"), "month(d)"), ("week", lambda: F.weekofyear("d"), "weekofyear(d)"), ("doy", lambda: F.dayofyear("d"), "dayofyear(d)"),
    ("yearmonth", lambda: F.year("d") * 100 + F.month("d"), "year(d)*100+month(d)"),
    ("yearweek", lambda: F.year("d") * 100 + F.weekofyear("d"), "year(d)*100+weekofyear(d)"),
    ("7day", lambda: F.floor(F.datediff(F.col("d"), F.lit("1995-01-01").cast("date")) / 7), "floor((d-DATE '1995-01-01')/7)"),
):
    _time_stats(_n, _k, _s)


CHECKED = ("prec", "windspeed", "winddir", "relhum", "pres")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*)-count({c}) AS missing, round(min({c}),6) AS least, round(avg({c}),6) AS mean, round(max({c}),6) AS most FROM v_coarse" for c in CHECKED))
def check_summary(load):
    from .sources import climdata

    return climdata.summary(load("v_coarse"), CHECKED)


@query("SELECT d, round(avg(prec),6) AS mean, round(stddev_samp(prec),6) AS sd, round(median(prec),6) AS med FROM v_coarse GROUP BY d")
def spatial_stats(load):
    return load("v_coarse").groupBy("d").agg(F.round(F.avg("prec"), 6).alias("mean"), F.round(F.stddev_samp("prec"), 6).alias("sd"), F.round(F.median("prec"), 6).alias("med"))


RAINY = "SELECT cell, d, CASE WHEN prec<20 THEN 0 ELSE prec END AS r, sum(CASE WHEN prec<20 THEN 0 ELSE prec END) OVER (PARTITION BY d) AS reg FROM v_coarse"
ADJUST = ("b AS (SELECT *, count(*) OVER p AS n, sum(CASE WHEN r>0 THEN 1 ELSE 0 END) OVER p AS wet, min(CASE WHEN r>0 THEN r END) OVER p AS lo, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN r>0 THEN 1 ELSE 0 END, reg, d) AS dry, row_number() OVER (PARTITION BY cell ORDER BY r, d) AS rk FROM a WINDOW p AS (PARTITION BY cell)), "
          "c AS (SELECT *, floor({frac}*n+0.5) AS want FROM b), e AS (SELECT *, CASE WHEN wet<want AND NOT r>0 AND dry<=want-wet THEN coalesce(lo,5001) WHEN wet>want AND rk<=n-want THEN 0 ELSE r END AS v FROM c) "
          "SELECT cell, d, round(v*coalesce({total}/nullif(sum(v) OVER (PARTITION BY cell),0),1),5) AS adjusted FROM e")


def rainy(load) -> DataFrame:
    df = load("v_coarse").select("cell", "d", F.when(F.col("prec") < 20, 0.0).otherwise(F.col("prec")).alias("r"))
    return rain.with_regional(df, "d", "r", "reg")


@query(f"-- with\na AS ({RAINY}), " + ADJUST.format(frac="0.6", total="1000.0"))
def rain_adjust(load):
    return rounded(rain.adjust(rainy(load), ["cell"], "d", "r", "reg", F.lit(0.6), F.lit(1000.0)), ["cell", "d"], 5, adjusted=F.col("adjusted"))


RATIO = ("SELECT o.cell AS cell, to_/nullif(tm,0) AS mu_tot, fo/nullif(fm,0) AS mu_frac FROM (SELECT cell, sum(prec) AS to_, avg(CASE WHEN prec>=25 THEN 1 ELSE prec END) AS fo FROM v_coarse WHERE year(d)<1998 GROUP BY cell) o JOIN "
         "(SELECT cell, sum(prec) AS tm, avg(CASE WHEN prec>=25 THEN 1 ELSE prec END) AS fm FROM v_coarse WHERE year(d)>=1998 GROUP BY cell) m ON o.cell=m.cell")


@query(f"SELECT cell, round(mu_tot,6) AS mu_tot, round(mu_frac,6) AS mu_frac FROM ({RATIO})")
def precip_ratio_fit(load):
    df = load("v_coarse")
    return rounded(rain.fit_ratio(df.where("year(d) < 1998"), df.where("year(d) >= 1998"), ["cell"], "prec", 25.0), ["cell"], mu_tot=F.col("mu_tot"), mu_frac=F.col("mu_frac"))


@query(f"-- with\nm AS ({RATIO}), a AS (SELECT y.cell, d, r, reg, sum(r) OVER (PARTITION BY y.cell)*mu_tot AS tot, least(1.0, avg(CASE WHEN r>0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY y.cell)*mu_frac) AS fr FROM ({RAINY}) y JOIN m ON y.cell=m.cell), " + ADJUST.format(frac="fr", total="tot"))
def precip_ratio_apply(load):
    df = load("v_coarse")
    model = rain.fit_ratio(df.where("year(d) < 1998"), df.where("year(d) >= 1998"), ["cell"], "prec", 25.0)
    return rounded(rain.apply_ratio(rainy(load).drop("reg"), model, ["cell"], "d", "r"), ["cell", "d"], 5, adjusted=F.col("adjusted"))


@query(f"SELECT f.row_, f.col_, round(exp(9.039606e-3+1.818067e-3*(f.elev-c.elev)-2.923351e-4*f.elev-6.471352e-7*f.elev*(f.elev-c.elev)),6) AS total, round(exp(-2.787208e-3-2.787208e-3*(f.elev-c.elev)-2.787208e-3*f.elev-4.503742e-7*f.elev*(f.elev-c.elev)),6) AS share FROM v_dtmf f JOIN ({BILINEAR}) c ON f.row_=c.row_ AND f.col_=c.col_")
def precip_elevation(load):
    coarse = grid.resample(load("v_dtmf"), load("v_dtmc"), "row_", "col_", ["elev"], 5, 4).withColumnRenamed("elev", "zc")
    total, share = rain.elevation_factors(F.col("elev"), F.col("zc"))
    return rounded(load("v_dtmf").join(coarse, ["row_", "col_"]), ["row_", "col_"], total=total, share=share)


PAIR = ("SELECT a.cell AS cell, a.k AS rank, a.prec AS obs, b.prec AS mod FROM (SELECT cell, prec, row_number() OVER (PARTITION BY cell ORDER BY prec, d) AS k FROM v_coarse WHERE year(d)<1998) a JOIN "
        "(SELECT cell, prec, row_number() OVER (PARTITION BY cell ORDER BY prec, d) AS k FROM v_coarse WHERE year(d)>=1998) b ON a.cell=b.cell AND a.k=b.k")


def paired(load) -> DataFrame:
    df = load("v_coarse")
    return bias.pair_by_rank(df.where("year(d) < 1998"), df.where("year(d) >= 1998"), ["cell"], "prec", "d")


@query(f"SELECT cell, CAST(rank AS INT) AS rank, obs, mod FROM ({PAIR})")
def quantile_pair(load):
    return paired(load)


@query(f"-- with\np AS ({PAIR}), q AS (SELECT *, max(rank) OVER (PARTITION BY cell) AS n FROM p), k AS (SELECT cell, list(mod ORDER BY rank) AS x, list(obs ORDER BY rank) AS y FROM q WHERE rank=1 OR floor((rank-1)*10/greatest(n-1,1))>floor((rank-2)*10/greatest(n-1,1)) GROUP BY cell), "
       "v AS (SELECT c.cell, d, prec, x, y, len(list_filter(x, lambda z: z<=prec)) AS i FROM v_coarse c JOIN k ON c.cell=k.cell WHERE year(d)>=1998) "
       "SELECT cell, d, round(CASE WHEN i=0 THEN y[1]+prec-x[1] WHEN i>=len(x) THEN y[len(y)]+prec-x[len(x)] ELSE y[i]+(y[i+1]-y[i])*(prec-x[i])/nullif(x[i+1]-x[i],0) END,5) AS corrected FROM v")
def quantile_map_apply(load):
    model = bias.fit_knots(paired(load), ["cell"])
    return rounded(bias.apply_knots(load("v_coarse").where("year(d) >= 1998"), model, ["cell"], "prec"), ["cell", "d"], 5, corrected=F.col("corrected"))


@query(None)
def smooth_bias_correct(load):
    """A penalised spline a cell, fitted on ranked pairs and applied to later values."""
    model = bias.fit_smooth(paired(load), ["cell"])
    return rounded(bias.apply_smooth(load("v_coarse").where("year(d) >= 1998"), model, ["cell"], "prec"), ["cell", "d"], 4, corrected=F.col("corrected"))


@query("SELECT cell, d, round(CASE WHEN prec>me+0.5*(hi-me) THEN me+0.5*(hi-me) WHEN prec<me-0.5*(me-lo) THEN me-0.5*(me-lo) ELSE prec END,6) AS limited FROM (SELECT *, avg(prec) OVER p AS me, max(prec) OVER p AS hi, min(prec) OVER p AS lo FROM v_coarse WINDOW p AS (PARTITION BY cell))")
def range_limits(load):
    return rounded(bias.limit_range(load("v_coarse"), ["cell"], "prec", 0.5), ["cell", "d"], limited=F.col("limited"))


@query("SELECT a.cell, round(avg(a.tmax-b.tmean),6) AS mean, round(stddev_samp(a.tmax-b.tmean),6) AS sd, round(max(a.tmax-b.tmean),6) AS most, round(min(a.tmax-b.tmean),6) AS least FROM v_day a JOIN v_day b ON a.cell=b.cell AND a.d=b.d GROUP BY a.cell")
def bias_stats(load):
    a, b = load("v_day").select("cell", "d", "tmax"), load("v_day").select("cell", "d", "tmean")
    gap = F.col("tmax") - F.col("tmean")
    return a.join(b, ["cell", "d"]).groupBy("cell").agg(*(F.round(f(gap), 6).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("most", F.max), ("least", F.min))))


@query("SELECT coalesce(c.row_,m.row_) AS row_, coalesce(c.col_,m.col_) AS col_, n, round(elev,6) AS elev FROM (SELECT row_, col_, count(*) AS n FROM v_coarse WHERE prec>150 GROUP BY row_, col_) c FULL JOIN v_dtmc m ON c.row_=m.row_ AND c.col_=m.col_")
def full_outer_xy(load):
    c = load("v_coarse").where("prec > 150").groupBy("row_", "col_").agg(F.count(F.lit(1)).alias("n"))
    return rounded(c.join(load("v_dtmc").select("row_", "col_", "elev"), ["row_", "col_"], "full"), ["row_", "col_", "n"], elev=F.col("elev"))


@query("-- with\nx AS (SELECT row_-dr AS row_, col_-dc AS col_, elev AS near, (dc+1)*3+dr+2 AS code FROM v_dtmf, unnest([-1,0,1]) AS p(dr), unnest([-1,0,1]) AS q(dc) WHERE elev IS NOT NULL), y AS (SELECT *, min(near) OVER (PARTITION BY row_, col_) AS lo FROM x) "
       "SELECT y.row_, y.col_, CAST(round_even(avg(code),0) AS INT) AS flow FROM y JOIN v_dtmf f ON y.row_=f.row_ AND y.col_=f.col_ WHERE near=lo AND f.elev IS NOT NULL GROUP BY y.row_, y.col_")
def flow_direction(load):
    return grid.flow_direction(load("v_dtmf"), "row_", "col_", "elev")


def _shifts(azimuth: float) -> str:
    import math

    a = math.radians(azimuth)
    return ", ".join(f"({math.floor(-math.cos(a) * s * s)},{math.floor(math.sin(a) * s * s)},{s * s}.0)" for s in range(1, 11))


@query(f"SELECT f.row_, f.col_, round(greatest(max((coalesce(g.elev,0)/50-coalesce(f.elev,0)/50)/dist),0),6) AS horizon FROM v_dtmf f CROSS JOIN (VALUES {_shifts(225)}) AS o(dr,dc,dist) LEFT JOIN v_dtmf g ON g.row_=f.row_+dr AND g.col_=f.col_+dc GROUP BY f.row_, f.col_")
def horizon_direction(load):
    return rounded(grid.horizon(load("v_dtmf"), "row_", "col_", "elev", 225, 50), ["row_", "col_"], horizon=F.col("horizon"))


def _offset_values(moves) -> str:
    return ", ".join("(" + ",".join(map(str, m)) + ")" for m in moves)


SKY = " UNION ALL ".join(f"SELECT f.row_, f.col_, greatest(max((coalesce(g.elev,0)/50-coalesce(f.elev,0)/50)/dist),0) AS hz FROM v_dtmf f CROSS JOIN (VALUES {_shifts(360 / 8 * k)}) AS o(dr,dc,dist) LEFT JOIN v_dtmf g ON g.row_=f.row_+dr AND g.col_=f.col_+dc GROUP BY f.row_, f.col_" for k in range(8))


@query(f"SELECT row_, col_, round(0.5*cos(2*tan(avg(atan(hz))))+0.5,6) AS skyview FROM ({SKY}) GROUP BY row_, col_")
def sky_view(load):
    from .operators import terrain

    return rounded(terrain.sky_view(load("v_dtmf"), "row_", "col_", "elev", 50, 8), ["row_", "col_"], skyview=F.col("skyview"))


@query(f"SELECT row_, col_, round(1-atan(17*greatest(max(CASE WHEN s>=1.0/50/dist THEN s ELSE 0 END),0))/1.65,6) AS shelter FROM (SELECT f.row_, f.col_, dist, (coalesce(g.elev,0)/50-coalesce(f.elev,0)/50)/dist AS s FROM v_dtmf f CROSS JOIN (VALUES {_shifts(270)}) AS o(dr,dc,dist) LEFT JOIN v_dtmf g ON g.row_=f.row_+dr AND g.col_=f.col_+dc) GROUP BY row_, col_")
def wind_shelter(load):
    from .operators import terrain

    return rounded(terrain.shelter(load("v_dtmf"), "row_", "col_", "elev", [270.0], 50), ["row_", "col_"], shelter=F.col("shelter"))


def _ray(direction: float, far: int) -> str:
    import math

    a, out, k = math.radians(direction), [], 8
    while (d := (k / 8) ** 2) <= far:
        out.append((round(-math.cos(a) * d), round(math.sin(a) * d)))
        k += 1
    return _offset_values(out)


@query(f"SELECT f.row_, f.col_, round((1.0+coalesce(sum(CASE WHEN g.row_ IS NULL THEN NULL WHEN g.elev IS NULL THEN 0 ELSE 1 END),0))/(1+count(g.row_)),6) AS exposure FROM v_dtmf f CROSS JOIN (VALUES {_ray(225, 20)}) AS o(dr,dc) LEFT JOIN v_dtmf g ON g.row_=f.row_+dr AND g.col_=f.col_+dc WHERE f.elev IS NOT NULL GROUP BY f.row_, f.col_")
def coastal_exposure(load):
    from .operators import terrain

    return rounded(terrain.coastal_exposure(load("v_dtmf"), "row_", "col_", "elev", [225.0], 20), ["row_", "col_"], exposure=F.col("exposure"))


@query("-- with\na AS (SELECT cell, CAST(floor(winddir/45) AS INT)%8 AS dir, avg(windspeed) AS w FROM v_coarse GROUP BY 1, 2) SELECT a.cell, a.dir, round(0.25*p.w+0.5*a.w+0.25*n.w,6) AS smooth FROM a LEFT JOIN a p ON p.cell=a.cell AND p.dir=(a.dir+7)%8 LEFT JOIN a n ON n.cell=a.cell AND n.dir=(a.dir+1)%8")
def direction_smooth(load):
    df = load("v_coarse").groupBy("cell", (F.floor(F.col("winddir") / 45).cast("int") % 8).alias("dir")).agg(F.avg("windspeed").alias("w"))
    return rounded(grid.direction_smooth(df, ["cell"], "dir", "w", 8), ["cell", "dir"], smooth=F.col("smooth"))


@query("SELECT CAST(row_number() OVER (ORDER BY x, y) AS INT) AS tile_id, x*9000.0::DOUBLE AS xmin, CASE WHEN x=1 THEN 22000.0::DOUBLE ELSE 10000.0::DOUBLE END AS xmax, y*9000.0::DOUBLE AS ymin, CASE WHEN y=1 THEN 20000.0::DOUBLE ELSE 10000.0::DOUBLE END AS ymax FROM (VALUES (0),(1)) AS a(x), (VALUES (0),(1)) AS b(y)")
def tiles(load):
    return grid.tiles(load("region").sparkSession, 0, 22000, 0, 20000, 10000, 1000)


@query("-- with\na AS (SELECT row_, col_, elev AS va FROM v_dtmf WHERE col_<=24), b AS (SELECT row_, col_, elev+10 AS vb FROM v_dtmf WHERE col_>=17), j AS (SELECT coalesce(a.row_,b.row_) AS row_, coalesce(a.col_,b.col_) AS col_, va, vb FROM a FULL JOIN b ON a.row_=b.row_ AND a.col_=b.col_), "
       "s AS (SELECT min(col_) AS lo, max(col_) AS hi FROM j WHERE va IS NOT NULL AND vb IS NOT NULL) SELECT row_, col_, round(coalesce(va*(1-(col_-lo)/nullif((hi-lo)*1.0,0))+vb*(col_-lo)/nullif((hi-lo)*1.0,0),va,vb),6) AS elev FROM j, s")
def blend_tiles(load):
    f = load("v_dtmf").select("row_", "col_", "elev")
    a, b = f.where("col_ <= 24"), f.where("col_ >= 17").withColumn("elev", F.col("elev") + 10)
    return rounded(grid.blend_pair(a, b, ["row_", "col_"], "elev", "col_"), ["row_", "col_"], elev=F.col("elev"))


@query(None)
def basins(load):
    """Watersheds of the fine grid, made in tiles of twenty rows."""
    from .operators import terrain

    return terrain.basins(load("v_dtmf").withColumn("tile", F.floor((F.col("row_") - 1) / 20).cast("int")), "tile", "row_", "col_", "elev")


@query(None)
def cold_air_potential(load):
    """Flow accumulation over basin size, times the depth below the basin's top."""
    from .operators import terrain

    return terrain.cold_air_potential(load("v_dtmf").withColumn("tile", F.floor((F.col("row_") - 1) / 20).cast("int")), "tile", "row_", "col_", "elev")


def dailies(load) -> DataFrame:
    """All daily variables for the sites that v_day and v_coarse share, v_coarse's by day of the year: means over all years, of the wind by its components."""
    c = load("v_coarse").withColumns({"doy": F.dayofyear("d"), "u": physics.wind_u(F.col("windspeed"), F.col("winddir")), "v": physics.wind_v(F.col("windspeed"), F.col("winddir"))})
    c = c.groupBy("cell", "doy").agg(*(F.avg(n).alias(n) for n in ("relhum", "pres", "prec", "u", "v")))
    c = c.withColumns({"windspeed": physics.wind_speed(F.col("u"), F.col("v")), "winddir": physics.wind_direction(F.col("u"), F.col("v"))}).drop("u", "v")
    v = load("v_day").select("cell", "row_", "col_", "d", "tmin", "tmax", F.dayofyear("d").alias("doy"))
    return v.join(c, ["cell", "doy"]).drop("doy").withColumns({"swrad": 40 + F.col("tmax") * 2, "lwrad": 280 + F.col("tmin")})


@query(None)
def temporal_downscale(load):
    """Every variable of daily weather by the hour."""
    from .plans import downscale

    hourly = downscale.to_hourly(dailies(load), ["cell", "row_", "col_"], "d", lat(), lon())
    # A little more, so that what lies between two roundings goes the same way in either engine.
    return hourly.select(*(F.round(F.col(c) + 3e-7, 4).alias(c) if t == "double" else F.col(c) for c, t in hourly.dtypes))


def coarse_weather(load) -> DataFrame:
    return load("v_coarse").select("row_", "col_", "d", (5 + F.col("windspeed")).alias("temp"), "relhum", "pres", (280 + F.col("windspeed")).alias("lwrad"), "windspeed", "winddir")


S_LR = f"9.8076*(1+2501000*rv/(287*(temp+273.15)))/(1003.5+0.622*2501000.0*2501000.0*rv/(287*(temp+273.15)*(temp+273.15)))"


@query(f"-- with\nw AS (SELECT c.row_, c.col_, d, 5+windspeed AS temp, relhum, pres, 280+windspeed AS lwrad, windspeed, winddir, elev AS zc, {s_satvap('(5+windspeed)')}*relhum/100 AS ea FROM v_coarse c JOIN v_dtmc m ON c.cell=m.cell), "
       f"x AS (SELECT *, {S_LR} AS lr FROM (SELECT *, 0.622*ea/(pres-ea) AS rv FROM w)), y AS (SELECT row_, col_, d, lr, temp+lr*coalesce(zc,0) AS t0, pres/power((293-0.0065*coalesce(zc,0))/293,5.26) AS p0, ea, lwrad, 5.67e-8*0.97*power(temp+273.15,4) AS up, -windspeed*sin(radians(winddir)) AS u, -windspeed*cos(radians(winddir)) AS v FROM x), "
       "g AS (SELECT row_, col_, elev, r0+a AS r, c0+b AS c, (CASE WHEN a=0 THEN 1-(yy-r0) ELSE yy-r0 END)*(CASE WHEN b=0 THEN 1-(xx-c0) ELSE xx-c0 END) AS wt FROM (SELECT *, CAST(floor(yy) AS INT) AS r0, CAST(floor(xx) AS INT) AS c0 FROM (SELECT row_, col_, elev, (row_-0.5)/5+0.5 AS yy, (col_-0.5)/4+0.5 AS xx FROM v_dtmf WHERE elev IS NOT NULL)), unnest([0,1]) AS p(a), unnest([0,1]) AS q(b)), "
       "k AS (SELECT g.row_, g.col_, d, elev, " + ", ".join(f"sum(wt*{n})/nullif(sum(wt),0) AS {n}" for n in ("lr", "t0", "p0", "ea", "lwrad", "up", "u", "v")) + " FROM g JOIN y ON g.r=y.row_ AND g.c=y.col_ WHERE wt<>0 GROUP BY g.row_, g.col_, d, elev), l AS (SELECT *, t0-lr*elev AS temp FROM k) "
       f"SELECT row_, col_, d, round(temp,4) AS temp, round(CASE WHEN ea IS NOT NULL AND temp IS NOT NULL THEN greatest(20.0,least(100.0,ea/{s_satvap('temp')}*100)) END,4) AS relhum, round(p0*power((293-0.0065*elev)/293,5.26),4) AS pres, round(lwrad+5.67e-8*0.97*power(temp+273.15,4)-up,4) AS lwrad, round(sqrt(u*u+v*v),4) AS windspeed FROM l")
def spatial_downscale(load):
    from .plans import downscale

    fine = downscale.to_fine(coarse_weather(load), load("v_dtmc"), load("v_dtmf"), "row_", "col_", "d", 5, 4)
    return rounded_all(fine.drop("winddir"))


from . import catalogue_space, catalogue_time  # noqa: E402, F401  more queries, registered on import
