"""Queries on series, files and sources, each beside its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import CLEAR, FILL, LAT, LON, ORACLE, lat, lon, query, rounded, s_dec, s_jd, s_satvap, s_sh, s_st
from .fixtures import sql
from .functions import physics, solar
from .operators import bias, rain, temporal
from .sources import climdata, etl

S_DL = f"(SELECT *, CASE WHEN hc<-1 THEN 24.0 WHEN hc>1 THEN 0.0 ELSE 8*degrees(acos(greatest(-1,least(1,hc))))/60 END AS dl FROM (SELECT *, -0.01453808/(cos(radians(lat))*cos({s_dec('jd')}))-tan(radians(lat))*tan({s_dec('jd')}) AS hc FROM %s))"


def s_hourly_temperature(table: str) -> str:
    """CTEs that end in hourly(.., h, temp) of a table with cell, d, lat, lon, tmin and tmax."""
    return (f"t1 AS (SELECT *, {s_jd('d')} AS jd, CASE WHEN tmax=tmin THEN tmax+0.01 ELSE tmax END AS x, coalesce(lead(tmin) OVER w,tmin) AS aft, coalesce(lag(tmin) OVER w,tmin) AS bef FROM {table} WINDOW w AS (PARTITION BY cell ORDER BY d)), "
            f"t2 AS (SELECT *, {s_st('0.0', 'lon', 'jd')} AS stt FROM {S_DL % 't1'}), t3 AS (SELECT *, CASE WHEN stt+12-0.5*dl>0 THEN tmin ELSE bef END AS lo, CASE WHEN stt+12-0.5*dl>0 THEN aft ELSE tmin END AS nx FROM t2), "
            "t4 AS (SELECT *, greatest(0.01,least(0.99,0.04187957*((x-lo)*(1-dl/24))+0.4372056)) AS g FROM t3), t5 AS (SELECT t4.*, CAST(u.h AS INT) AS h, u.h+stt-(12-0.5*dl) AS raw, u.h+stt-24*floor((u.h+stt)/24) AS s24 FROM t4, unnest(range(24)) AS u(h)), t6 AS (SELECT *, raw-24*floor(raw/24) AS st FROM t5), "
            "t7 AS (SELECT *, CASE WHEN dl>=24 THEN (x-lo)*sin(pi()*st/28)+lo+(nx-lo)*st/24 WHEN dl<=0 THEN (x-lo)*sin(pi()*s24/24)+lo+(nx-lo)*s24/24 ELSE (x-lo)*(CASE WHEN st>dl THEN g*exp(-(st-dl)/(-(24-dl)/ln(0.09/g))) ELSE sin(pi()*st/(dl+2*(-0.5*dl*(pi()/(asin(g)-pi())+1)))) END)+lo+CASE WHEN h+stt>dl THEN (nx-lo)*(st-dl)/(24-dl) ELSE 0 END END AS t FROM t6), "
            "hourly AS (SELECT *, tmin+(t-min(t) OVER p)*(x-tmin)/nullif(max(t) OVER p-min(t) OVER p,0) AS temp FROM t7 WINDOW p AS (PARTITION BY cell, d))")


ORACLE["temperature_hourly"] = sql(f"-- with\nv1 AS (SELECT *, {LAT} AS lat, {LON} AS lon FROM v_day), " + s_hourly_temperature("v1") + " SELECT cell, d, h, round(temp,6) AS temp FROM hourly")

_LINE = "CASE WHEN h>=11 THEN {v}+(n_{v}-{v})*(h-11)/24.0 ELSE p_{v}+({v}-p_{v})*(h+13)/24.0 END AS i_{v}"
_SMOOTH = ("q", "p", "u", "v", "r", "share")
_E0 = "(0.6108*exp(17.27*{t}/({t}+237.3)))"
_WEATHER = ("w1 AS (SELECT cell, dayofyear(d) AS doy, avg(relhum) AS relhum, avg(pres) AS pres, avg(prec) AS prec, avg(-windspeed*sin(radians(winddir))) AS mu, avg(-windspeed*cos(radians(winddir))) AS mv FROM v_coarse GROUP BY 1, 2), "
            f"w2 AS (SELECT v.cell, v.row_, v.col_, v.d, v.tmin, v.tmax, {LAT.replace('row_', 'v.row_')} AS lat, {LON.replace('col_', 'v.col_')} AS lon, relhum, pres, prec, sqrt(mu*mu+mv*mv) AS windspeed, degrees(atan2(mu,mv))+180-360*floor((degrees(atan2(mu,mv))+180)/360) AS winddir, 40+v.tmax*2 AS swrad, 280+v.tmin AS lwrad FROM v_day v JOIN w1 ON v.cell=w1.cell AND dayofyear(v.d)=w1.doy), "
            f"sun AS (SELECT cell, d, lt, jd, lat, {s_st('lt', 'lon', 'jd')} AS st FROM (SELECT cell, d, lat, lon, {s_jd('d')} AS jd, h*1.0 AS lt FROM w2, unnest(range(24)) AS u(h))), sky AS (SELECT cell, d, lt, {CLEAR} AS cs FROM (SELECT *, 35*s/sqrt(1224*s*s+1) AS m, ln(0.8)+17.27*15/(237.3+15) AS xx FROM (SELECT *, greatest(sh,1e-12) AS s FROM (SELECT *, {s_sh('jd', 'st', 'lat')} AS sh FROM sun)))), "
            f"w3 AS (SELECT w2.*, relhum/100*(18.02/28.97*({_E0.format(t='((tmin+tmax)/2)')}/pres)) AS q, pres AS p, -windspeed*sin(radians(winddir)) AS u, -windspeed*cos(radians(winddir)) AS v, (CASE WHEN prec<0 THEN 0 ELSE prec END)/24 AS r, greatest(0.0,least(1.0,coalesce(swrad/nullif(c.cs,0),0.5))) AS share FROM w2 JOIN (SELECT cell, d, avg(cs) AS cs FROM sky GROUP BY 1, 2) c ON w2.cell=c.cell AND w2.d=c.d), "
            "w4 AS (SELECT *, " + ", ".join(f"coalesce(lag({n}) OVER w,{n}) AS p_{n}, coalesce(lead({n}) OVER w,{n}) AS n_{n}" for n in _SMOOTH) + " FROM w3 WINDOW w AS (PARTITION BY cell ORDER BY d)), ")
ORACLE["temporal_downscale"] = sql(
    "-- with\n" + _WEATHER + s_hourly_temperature("w4") + ", y1 AS (SELECT *, " + ", ".join(_LINE.format(v=n) for n in _SMOOTH) + " FROM hourly), "
    "y2 AS (SELECT y1.*, cs, i_p*coalesce(pres/nullif(avg(i_p) OVER (PARTITION BY y1.cell, y1.d),0),1) AS pk FROM y1 JOIN sky ON y1.cell=sky.cell AND y1.d=sky.d AND y1.h=sky.lt), "
    f"y3 AS (SELECT *, i_q/(18.02/28.97*({_E0.format(t='temp')}/pk))*100 AS rh0, i_share*cs AS sw0, sqrt(i_u*i_u+i_v*i_v) AS ws0 FROM y2), "
    "y4 AS (SELECT *, greatest(10.0,least(100.0,rh0*coalesce(relhum/nullif(avg(rh0) OVER p,0),1))) AS rh, greatest(0.0,least(1352.778,sw0*coalesce(swrad/nullif(avg(sw0) OVER p,0),1))) AS sw, ws0*coalesce(windspeed/nullif(avg(ws0) OVER p,0),1) AS ws, i_r*coalesce((CASE WHEN prec<0 THEN 0 ELSE prec END)/nullif(sum(i_r) OVER p,0),1) AS rain FROM y3 WINDOW p AS (PARTITION BY cell, d)), "
    f"y5 AS (SELECT *, {_E0.format(t='temp')}*rh/100 AS ea FROM y4), y6 AS (SELECT *, 1/(1/273.15-461.5/(2.501e6-2340*temp)*ln(ea/0.6112))-273.15 AS dw FROM y5), y7 AS (SELECT *, least(1.0,0.787+0.764*ln((CASE WHEN dw<0 THEN 1/(1/273.15-461.5/2.834e6*ln(ea/0.61078))-273.15 ELSE dw END+273.15)/273.15))*5.67e-8*power(temp+273.15,4) AS lw0 FROM y6) "
    "SELECT cell, row_, col_, d, h, round(temp+3e-7,4) AS temp, round(rh+3e-7,4) AS relhum, round(pk+3e-7,4) AS pres, round(sw+3e-7,4) AS swrad, round(lw0*coalesce(lwrad/nullif(avg(lw0) OVER (PARTITION BY cell, d),0),1)+3e-7,4) AS lwrad, round(ws+3e-7,4) AS windspeed, round(degrees(atan2(i_u,i_v))+180-360*floor((degrees(atan2(i_u,i_v))+180)/360)+3e-7,4) AS winddir, round(rain+3e-7,4) AS prec FROM y7"
)


@query("-- with\nk AS (SELECT cell, CAST(d AS TIMESTAMP) AS t, tmean AS v, count(*) OVER (PARTITION BY cell) AS n FROM v_day), a AS (SELECT c.cell, u.t FROM (SELECT DISTINCT cell FROM v_day) c, (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28', INTERVAL 7 HOUR)) AS t) u) "
       "SELECT a.cell, a.t AS ts, round(CASE WHEN coalesce(p.n,x.n)=1 THEN coalesce(p.v,x.v) ELSE p.v+(x.v-p.v)*coalesce(epoch(a.t-p.t)/nullif(epoch(x.t-p.t),0),0) END+3e-9,6) AS tmean FROM a ASOF LEFT JOIN k p ON a.cell=p.cell AND a.t>=p.t ASOF LEFT JOIN k x ON a.cell=x.cell AND a.t<=x.t")
def time_interp(load):
    """Daily means at steps of seven hours."""
    days = load("v_day").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    axis = days.sparkSession.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-28', interval 7 hours)")).alias("ts"))
    return rounded(temporal.at_times(days, ["cell"], "ts", "tmean", axis), ["cell", "ts"], tmean=F.col("tmean") + 3e-9)


_RUNS = "SELECT cell, min(d) AS s, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d)-row_number() OVER (PARTITION BY cell, prec>=30 ORDER BY d) AS g FROM v_coarse) WHERE prec>=30 GROUP BY cell, g"


@query(f"SELECT c.cell, min(s) AS \"start\" FROM (SELECT DISTINCT cell FROM v_coarse) c LEFT JOIN ({_RUNS}) r ON c.cell=r.cell AND n=3 GROUP BY c.cell")
def first_run(load):
    """Where the first run of exactly three wet days begins."""
    return temporal.first_run(load("v_coarse"), ["cell"], "d", F.col("prec") >= 30, 3)


@query("SELECT cell, d, CAST(j AS INT) AS j, round((1-j/4.0)*tmean+j/4.0*nx,6) AS blended FROM (SELECT *, lead(tmean) OVER (PARTITION BY cell ORDER BY d) AS nx FROM v_day), unnest(range(4)) AS u(j) WHERE nx IS NOT NULL")
def blend_steps(load):
    return rounded(temporal.blend_steps(load("v_day"), ["cell"], "d", "tmean", 4), ["cell", "d", "j"], blended=F.col("blended"))


@query("-- with\nl AS (SELECT d, avg(prec) AS m FROM v_coarse GROUP BY d), q AS (SELECT unnest([0.0::DOUBLE,0.5,0.9]) AS s, unnest(quantile_cont(m, [0.0,0.5,0.9])) AS v FROM l) SELECT s AS share, d, round(m,6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY abs(m-v), d) AS k FROM l, q) WHERE k=1")
def layers_at_quantiles(load):
    """The days whose mean rain is nearest to three quantiles of all days'."""
    return rounded(temporal.layers_at_quantiles(load("v_coarse"), "d", "prec", [0.0, 0.5, 0.9]), ["share", "d"], mean=F.col("mean"))


@query("SELECT cell, d, round(tmean,6) AS tmean FROM v_day WHERE d>=DATE '2024-02-10'-INTERVAL 1 MONTH AND d<=DATE '2023-12-20'+INTERVAL 1 MONTH")
def subset_month_pad(load):
    """Days from a month before one date to a month after another."""
    days = load("v_day").where((F.col("d") >= F.add_months(F.lit("2024-02-10").cast("date"), -1)) & (F.col("d") <= F.add_months(F.lit("2023-12-20").cast("date"), 1)))
    return rounded(days, ["cell", "d"], tmean=F.col("tmean"))


_DECADES = ", ".join(f"('{a}-{b}', DATE '{a[:4]}-{a[4:6]}-{a[6:]}', DATE '{b[:4]}-{b[4:6]}-{b[6:]}')" for a, b in etl.DECADES["land-rcm"])


@query(f"SELECT decade, first, last FROM (VALUES {_DECADES}) AS t(decade, first, last) WHERE last>DATE '1995-06-01' AND first<DATE '2001-02-01'")
def decade_overlap(load):
    return etl.decades(load("region").sparkSession, "land-rcm", "1995-06-01", "2001-02-01")


@query("SELECT v, c_nationkey FROM (VALUES ('tasmin'),('tasmax'),('pr')) AS x(v), (SELECT DISTINCT n_nationkey AS c_nationkey FROM nation) EXCEPT SELECT CASE WHEN c_custkey%2=0 THEN 'tasmin' ELSE 'pr' END, c_nationkey FROM customer WHERE c_custkey<60")
def missing_files(load):
    """Of files expected for every variable and nation, those that no customer has."""
    spark = load("region").sparkSession
    wanted = spark.createDataFrame([("tasmin",), ("tasmax",), ("pr",)], "v string").crossJoin(load("nation").select(F.col("n_nationkey").alias("c_nationkey")).distinct())  # three rows
    there = load("customer").where("c_custkey < 60").select(F.when(F.col("c_custkey") % 2 == 0, "tasmin").otherwise("pr").alias("v"), "c_nationkey")
    return etl.missing_files(wanted, there, ["v", "c_nationkey"])


@query("SELECT cell, CAST(ts AS DATE) AS d, CASE WHEN count(x)=count(*) THEN round(avg(x),6) END AS x FROM (SELECT cell, ts, CASE WHEN tc<30 THEN tc END AS x FROM v_obs) GROUP BY 1, 2")
def fold_strict(load):
    """Daily means that are null where an hour is."""
    df = load("v_obs").withColumn("x", F.when(F.col("tc") < 30, F.col("tc")))
    return rounded(temporal.fold(df, ["cell"], "ts", {"x": ("x", "mean")}, strict=True), ["cell", "d"], x=F.col("x"))


@query("SELECT cell, d, round(coalesce(lag(tmin) OVER w,tmin),6) AS before, round(coalesce(lead(tmin) OVER w,tmin),6) AS after FROM v_day WINDOW w AS (PARTITION BY cell ORDER BY d)")
def neighbour_days(load):
    out = temporal.with_neighbours(load("v_day"), ["cell"], "d", ["tmin"])
    return rounded(out, ["cell", "d"], before=F.col("_p_tmin"), after=F.col("_n_tmin"))


@query((FILL + "SELECT cell, d, round(coalesce(tmean, v0+(v1-v0)*(d-d0)/nullif(d1-d0,0), v0, v1),6) AS tmean FROM k").replace("SELECT cell, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM v_day GROUP BY cell", "SELECT cell, CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS d FROM v_day GROUP BY cell"))
def fill_to_edges(load):
    """Every day of a span, the first and last known value held beyond them."""
    days = load("v_day").select("cell", "d", "tmean")
    every = days.select("cell").distinct().withColumn("d", F.explode(F.expr("sequence(date'2023-12-28', date'2024-02-02')")))
    return rounded(temporal.interpolate(every.join(days, ["cell", "d"], "left"), ["cell"], "d", ["tmean"], edges=True), ["cell", "d"], tmean=F.col("tmean"))


@query(f"SELECT cell, ts, round({s_jd('ts')}-0.5+(hour(ts)*3600+minute(ts)*60+second(ts))/86400.0,6) AS jd FROM v_obs")
def julian_day_fraction(load):
    return rounded(load("v_obs"), ["cell", "ts"], jd=solar.julian_day(F.col("ts"), whole=False))


@query(f"-- with\nc AS (SELECT DISTINCT row_, col_ FROM v_day), t AS (SELECT row_, col_, {s_jd(chr(39) + '2024-01-15' + chr(39) + '::DATE')} AS jd, m/60.0 AS lt, {LAT} AS lat, {LON} AS lon FROM c, unnest(range(1440)) AS u(m)), s AS (SELECT *, {s_st('lt', 'lon', 'jd')} AS st FROM t), "
       f"z AS (SELECT *, 35*s/sqrt(1224*s*s+1) AS m, ln(0.8)+17.27*15/(237.3+15) AS xx FROM (SELECT *, greatest(sh,1e-12) AS s FROM (SELECT *, {s_sh('jd', 'st', 'lat')} AS sh FROM s))) SELECT row_, col_, round(avg({CLEAR}),3) AS cs FROM z GROUP BY row_, col_")
def clearsky_minutes(load):
    """The mean clear-sky radiation of a day by the minute, at every site."""
    sites = load("v_day").select("row_", "col_").distinct().withColumn("d", F.lit("2024-01-15").cast("date"))
    return rounded(solar.daily_clear_sky(sites, solar.julian_day(F.col("d")), lat(), lon(), "cs", 60), ["row_", "col_"], 3, cs=F.col("cs"))


@query("SELECT cell, d, CAST(h AS INT) AS h, round(em*coalesce(e/nullif(avg(em) OVER (PARTITION BY cell, d),0),1),6) AS em FROM (SELECT *, CASE WHEN h>=11 THEN e+(nx-e)*(h-11)/24.0 ELSE pv+(e-pv)*(h+13)/24.0 END AS em FROM (SELECT cell, d, e, coalesce(lag(e) OVER w,e) AS pv, coalesce(lead(e) OVER w,e) AS nx FROM (SELECT cell, d, least(1.0,0.7+tmean/100) AS e FROM v_day) WINDOW w AS (PARTITION BY cell ORDER BY d)), unnest(range(24)) AS u(h))")
def emissivity_hourly(load):
    """Sky emissivity by the hour, with its daily means."""
    df = load("v_day").withColumn("e", F.least(F.lit(1.0), 0.7 + F.col("tmean") / 100)).withColumn("em", F.col("e"))
    out = temporal.day_to_hour(df, ["cell"], "d", ["em"])
    return rounded(out, ["cell", "d", "h"], em=temporal.adjust_to_daily(out, ["cell"], "d", F.col("em"), F.col("e")))


@query("SELECT cell, d, round(prec*coalesce(100/nullif(sum(prec) OVER (PARTITION BY cell, year(d), month(d)),0),1),6) AS part FROM v_coarse")
def proportional_rain(load):
    """Rain scaled so that each cell's months add up to 100."""
    df = load("v_coarse").withColumns({"y": F.year("d"), "m": F.month("d")})
    return rounded(rain.to_total(df, ["cell", "y", "m"], "prec", F.lit(100.0)), ["cell", "d"], part=F.col("scaled"))


@query("-- with\na AS (SELECT d, sum(CASE WHEN prec<60 THEN 0 ELSE prec END)*0+sum(CASE WHEN prec>=220 THEN prec ELSE 0 END) AS s FROM v_coarse GROUP BY d), b AS (SELECT *, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM a), c AS (SELECT d, s, i, true AS own FROM b UNION ALL SELECT d, s, i-n, false FROM b WHERE i>n-9), "
       "e AS (SELECT *, CASE WHEN count(s) OVER w=10 THEN avg(s) OVER w END AS m FROM c WINDOW w AS (ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT d, round(CASE WHEN s<>0 THEN s WHEN m>0 THEN m ELSE 0.1 END,5) AS regional FROM e WHERE own")
def regional_rain(load):
    """Rain over all cells by day; dry days take the mean of ten days up to them."""
    df = load("v_coarse").withColumn("r", F.when(F.col("prec") >= 220, F.col("prec")).otherwise(0.0))
    return rounded(rain.regional_ranks(df, "d", "r"), ["d"], 5, regional=F.col("regional"))


@query("SELECT cell, d, prec, 'a' AS part FROM v_coarse WHERE year(d)<1998 UNION ALL SELECT cell, d, prec, 'b' FROM v_coarse WHERE year(d)>=1998")
def concatenated(load):
    """A series of two parts, one after the other."""
    df = load("v_coarse").select("cell", "d", "prec")
    return df.where("year(d) < 1998").withColumn("part", F.lit("a")).unionByName(df.where("year(d) >= 1998").withColumn("part", F.lit("b")))


@query("SELECT c.cell, c.d, round(prec/nullif(s,0),8) AS share FROM v_coarse c JOIN (SELECT d, sum(prec) AS s FROM v_coarse GROUP BY d) t ON c.d=t.d")
def share_of_region(load):
    """Each cell's part of a day's rain over all cells."""
    df = rain.with_regional(load("v_coarse"), "d", "prec", "s")
    return rounded(df, ["cell", "d"], 8, share=F.try_divide("prec", "s"))


@query("SELECT cell, arg_min(d, row(abs(prec-50), d)) AS d FROM v_coarse GROUP BY cell")
def nearest_day(load):
    """Each cell's day of rain nearest to a value, the earliest of several."""
    return load("v_coarse").groupBy("cell").agg(F.min_by("d", F.struct(F.abs(F.col("prec") - 50).alias("gap"), F.col("d").alias("day"))).alias("d"))


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate-INTERVAL 1 MONTH AS DATE) AS before, day(last_day(CAST(o_orderdate AS DATE))) AS days FROM orders")
def month_arithmetic(load):
    d = F.to_date("o_orderdate")
    return load("orders").select("o_orderkey", F.trunc(d, "month").alias("month"), F.add_months(d, -1).alias("before"), F.dayofmonth(F.last_day(d)).cast("long").alias("days"))


_MESSY = "SELECT cell, d, CASE WHEN prec>150 THEN NULL ELSE prec*20 END AS prec, relhum*1.1 AS relhum, pres*0.9 AS pres, CASE WHEN winddir<2 THEN 365 ELSE winddir END AS winddir FROM v_coarse"
_RULES = (("missing", "prec", "prec IS NULL"), ("missing", "relhum", "relhum IS NULL"), ("missing", "pres", "pres IS NULL"), ("missing", "winddir", "winddir IS NULL"), ("range", "prec", "prec<0 OR prec>1500"), ("range", "relhum", "relhum<0 OR relhum>100"),
          ("range", "pres", "pres<84 OR pres>109"), ("range", "winddir", "winddir<0 OR winddir>360"), ("saturated", "relhum", "relhum>100"), ("direction", "winddir", "winddir<0 OR winddir>=360"))


@query(f"-- with\nm AS ({_MESSY}), s AS (SELECT cell, d-lag(d) OVER (PARTITION BY cell ORDER BY d) AS gap FROM m) " + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{v}' AS variable, count(*) AS n FROM m WHERE {w}" for c, v, w in _RULES)
       + " UNION ALL SELECT 'step', 'd', count(*) FROM s WHERE gap<>1 UNION ALL SELECT 'whole days', 'd', 0")
def input_problems(load):
    """What a daily table breaks of the rules for inputs."""
    df = load("v_coarse").select("cell", "d", F.when(F.col("prec") <= 150, F.col("prec") * 20).alias("prec"), (F.col("relhum") * 1.1).alias("relhum"), (F.col("pres") * 0.9).alias("pres"), F.when(F.col("winddir") < 2, 365.0).otherwise(F.col("winddir")).alias("winddir"))
    return climdata.problems(df, ["cell"], "d", ["prec", "relhum", "pres", "winddir"], 24)


@query("SELECT p, d, round(sum(w*prec/3.7)/nullif(sum(CASE WHEN prec IS NOT NULL THEN w END),0),4) AS prec, round(sum(w*pres/3.7)/sum(w),5) AS pres FROM v_coarse c JOIN (SELECT row_, col_, CAST(row_%7 AS INT) AS p, (1+col_)*1.0 AS w FROM v_dtmc WHERE elev IS NOT NULL) x ON c.row_=x.row_ AND c.col_=x.col_ GROUP BY p, d")
def parcel_means(load):
    """Weighted means over parcels of cells."""
    weights = load("v_dtmc").where("elev is not null").select("row_", "col_", (F.col("row_") % 7).alias("p"), (1.0 + F.col("col_")).alias("weight"))
    cells = load("v_coarse").withColumns({"prec": F.col("prec") / 3.7, "pres": F.col("pres") / 3.7})
    return climdata.parcel_means(cells, weights, "p", "d", {"prec": 4, "pres": 5})


_RAW = "SELECT cell, ts, tc+273.15 AS t2m, tc+270 AS d2m, 100000+tc*50 AS sp, (tc+6)*36000 AS ssrd, (tc+6)*20000 AS fdir, 1000000+tc*1000 AS strd, tc+5.5 AS u10, 3-tc/10 AS v10, (tc+6)/1000 AS tp, row_ FROM v_obs"


@query(f"-- with\nr AS ({_RAW}), a AS (SELECT *, t2m-273.15 AS t, min(t2m-273.15) OVER p AS lo, max(t2m-273.15) OVER p AS hi, least(1.0,row_*0.1) AS land, d2m-273.15 AS dw FROM r WINDOW p AS (PARTITION BY cell, CAST(ts AS DATE))), b AS (SELECT *, (hi-lo)*(1+1.285*(1-land)) AS wide, {s_satvap('dw')}/{s_satvap('t')}*100 AS rh FROM a) "
       "SELECT cell, ts, round(coalesce((t-lo)/nullif(hi-lo,0),0)*wide+(hi+lo)/2-wide/2,5) AS temp, round(least(rh,100.0),5) AS relhum, round(sp/1000,6) AS pres, round(greatest(ssrd/3600,0),5) AS swrad, round(greatest((ssrd-fdir)/3600,0),5) AS difrad, round(greatest(strd/3600,0),5) AS lwrad, round(sqrt(u10*u10+v10*v10)*ln(67.8*2-5.42)/ln(67.8*10-5.42),5) AS windspeed, "
       "round(degrees(atan2(u10,v10))+180-360*floor((degrees(atan2(u10,v10))+180)/360),4) AS winddir, round(tp*1000,5) AS prec FROM b")
def reanalysis_hourly(load):
    """Hourly climate from a reanalysis' variables."""
    t = F.col("tc")
    raw = load("v_obs").select("cell", "row_", "ts", (t + 273.15).alias("t2m"), (t + 270).alias("d2m"), (100000 + t * 50).alias("sp"), ((t + 6) * 36000).alias("ssrd"), ((t + 6) * 20000).alias("fdir"), (1000000 + t * 1000).alias("strd"), (t + 5.5).alias("u10"), (3 - t / 10).alias("v10"), ((t + 6) / 1000).alias("tp"))
    land = raw.select("cell", F.least(F.lit(1.0), F.col("row_") * 0.1).alias("land")).distinct()
    out = etl.reanalysis_hourly(raw.drop("row_"), land, ["cell"], "ts")
    return out.select("cell", "ts", *(F.round(c, 6 if c == "pres" else 4 if c == "winddir" else 5).alias(c) for c in out.columns[2:]))


_HOURS = "SELECT cell, ts, tc AS temp, 60+tc AS relhum, 99+tc/50 AS pres, (tc+6)*10 AS swrad, (tc+6)*3 AS difrad, 300+tc AS lwrad, tc+6 AS windspeed, (tc+6)*9 AS winddir, (tc+6)/10 AS prec FROM v_obs"


@query(f"SELECT cell, d, round(tmin,6) AS tmin, round(tmax,6) AS tmax, round(tmean,6) AS tmean, round(relhum,6) AS relhum, round(pres,6) AS pres, round(swrad,6) AS swrad, round(difrad,6) AS difrad, round(lwrad,6) AS lwrad, round(prec,6) AS prec, round(skyem,6) AS skyem, round(windspeed,6) AS windspeed, round(degrees(atan2(u,v))+180-360*floor((degrees(atan2(u,v))+180)/360),3) AS winddir FROM "
       "(SELECT cell, CAST(ts AS DATE) AS d, min(temp) AS tmin, max(temp) AS tmax, avg(temp) AS tmean, avg(relhum) AS relhum, avg(pres) AS pres, avg(swrad) AS swrad, avg(difrad) AS difrad, avg(lwrad) AS lwrad, sum(prec) AS prec, avg(least(1.0,lwrad/(5.67e-8*0.97*power(temp+273.15,4)))) AS skyem, avg(windspeed) AS windspeed, avg(-windspeed*sin(radians(winddir))) AS u, avg(-windspeed*cos(radians(winddir))) AS v "
       f"FROM ({_HOURS}) GROUP BY 1, 2)")
def reanalysis_daily(load):
    """All daily variables of an hourly climate table."""
    t = F.col("tc")
    hours = load("v_obs").select("cell", "ts", t.alias("temp"), (60 + t).alias("relhum"), (99 + t / 50).alias("pres"), ((t + 6) * 10).alias("swrad"), ((t + 6) * 3).alias("difrad"), (300 + t).alias("lwrad"), (t + 6).alias("windspeed"), ((t + 6) * 9).alias("winddir"), ((t + 6) / 10).alias("prec"))
    names = ["tmin", "tmax", "tmean", "relhum", "pres", "swrad", "difrad", "lwrad", "prec", "skyem", "windspeed", "winddir"]
    out = etl.hourly_to_daily(hours, ["cell"], "ts", names)
    return out.select("cell", "d", *(F.round(c, 3 if c == "winddir" else 6).alias(c) for c in names))


_KNOTS = "SELECT cell, '{v}' AS variable, [1.0::DOUBLE, 50.0, 100.0] AS x, [{a}::DOUBLE, 55.0, 90.0] AS y FROM v_dtmc WHERE cell%{m}=0"
_MAPPED = "CASE WHEN m.x IS NULL THEN c.{v} ELSE (CASE WHEN c.{v}<m.x[1] THEN m.y[1]+c.{v}-m.x[1] WHEN c.{v}>=m.x[3] THEN m.y[3]+c.{v}-m.x[3] WHEN c.{v}<m.x[2] THEN m.y[1]+(m.y[2]-m.y[1])*(c.{v}-m.x[1])/(m.x[2]-m.x[1]) ELSE m.y[2]+(m.y[3]-m.y[2])*(c.{v}-m.x[2])/(m.x[3]-m.x[2]) END) END"


@query(f"SELECT c.cell, c.d, round({_MAPPED.format(v='prec')},5) AS prec, round(CASE WHEN h.x IS NULL THEN c.relhum ELSE greatest(0.0,least(100.0,{_MAPPED.format(v='relhum').replace('m.', 'h.')})) END,5) AS relhum FROM v_coarse c LEFT JOIN ({_KNOTS.format(v='prec', a='2.0', m=2)}) m ON c.cell=m.cell LEFT JOIN ({_KNOTS.format(v='relhum', a='0.5', m=3)}) h ON c.cell=h.cell")
def bias_all_variables(load):
    """Two variables mapped along the knots of their cells, where these have a model."""
    cells = load("v_dtmc")
    model = lambda v, a, m: cells.where(F.col("cell") % m == 0).select("cell", F.lit(v).alias("variable"), F.array(*map(F.lit, (1.0, 50.0, 100.0))).alias("x"), F.array(*map(F.lit, (a, 55.0, 90.0))).alias("y"))
    out = bias.apply_all(load("v_coarse"), model("prec", 2.0, 2).unionByName(model("relhum", 0.5, 3)), ["cell"], ["prec", "relhum"], {"relhum": (0.0, 100.0)})
    return rounded(out, ["cell", "d"], 5, prec=F.col("prec"), relhum=F.col("relhum"))


@query("SELECT cell, d, round(CASE WHEN cs=0 THEN CASE WHEN sw>0 THEN 1 WHEN sw<0 THEN 0 ELSE 0.5 END ELSE greatest(0.0,least(1.0,sw/cs)) END,6) AS share FROM (SELECT cell, d, prec-20 AS sw, CASE WHEN winddir<60 THEN 0 ELSE relhum END AS cs FROM v_coarse)")
def clear_share(load):
    """The clear-sky share of radiation, with and without a sun."""
    from .plans import downscale

    clear = F.when(F.col("winddir") < 60, 0.0).otherwise(F.col("relhum"))
    return rounded(load("v_coarse"), ["cell", "d"], share=downscale.clear_share(F.col("prec") - 20, clear))


@query("SELECT cell, ts, round(es,6) AS es, round(w,6) AS w FROM (SELECT cell, ts, " + s_satvap("tc") + " AS es, (tc+6)*ln(67.8*2-5.42)/ln(67.8*10-5.42) AS w FROM v_obs)")
def registered_functions(load):
    """Functions of this package, called from SQL text."""
    from . import sqlfunctions

    obs = load("v_obs")
    sqlfunctions.register(obs.sparkSession)
    return obs.sparkSession.sql("SELECT cell, ts, round(saturation_vapour_pressure(tc), 6) AS es, round(wind_at_height(tc + 6, 10D, 2D), 6) AS w FROM {obs}", obs=obs)
