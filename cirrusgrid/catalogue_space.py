"""Queries on grids, tiles and terrain, each beside its DuckDB counterpart."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .catalogue import lat, lon, plainly_rounded, query, rounded, rounded_all, s_jd, s_satvap, s_sh, s_st
from .functions import crs, physics
from .operators import bias, coast, grid, rain, terrain, wind
from .operators.grid import Grid

#: Where the fine grid of the queries lies: forty columns of 50 m.
FINE = Grid(xmin=160000.0, ymax=40000.0, xres=50.0, yres=50.0)


def s_resample(cells: str, coarse: str, values: list[str], fy: float, fx: float, keys: tuple[str, ...] = ()) -> str:
    """SQL of bilinear resampling of coarse (row_, col_, keys, values) to the centres of cells (row_, col_)."""
    part = f"SELECT row_, col_, r0+a AS r, c0+b AS c, (CASE WHEN a=0 THEN 1-(y-r0) ELSE y-r0 END)*(CASE WHEN b=0 THEN 1-(x-c0) ELSE x-c0 END) AS w FROM (SELECT *, CAST(floor(y) AS INT) AS r0, CAST(floor(x) AS INT) AS c0 FROM (SELECT row_, col_, (row_-0.5)/{fy}+0.5 AS y, (col_-0.5)/{fx}+0.5 AS x FROM {cells})), unnest([0,1]) AS p(a), unnest([0,1]) AS q(b)"
    found = ", ".join(f"sum(CASE WHEN c.{v} IS NOT NULL THEN w*c.{v} END)/nullif(sum(CASE WHEN c.{v} IS NOT NULL THEN w END),0) AS {v}" for v in values)
    more = "".join(f", {k}" for k in keys)
    return f"(SELECT f.row_, f.col_{more}, {found} FROM ({part}) f JOIN {coarse} c ON f.r=c.row_ AND f.c=c.col_ WHERE w<>0 GROUP BY f.row_, f.col_{more})"


def s_blocks(table: str, value: str, k: int) -> str:
    return f"(SELECT CAST(floor((row_-1)/{k}) AS INT)+1 AS row_, CAST(floor((col_-1)/{k}) AS INT)+1 AS col_, avg({value}) AS {value} FROM {table} GROUP BY 1, 2)"


def _filled(k: int) -> str:
    return s_resample("v_dtmf", s_blocks("v_dtmf", "elev", k), ["elev"], k, k)


@query("SELECT f.row_, f.col_, round(coalesce(f.elev, CASE WHEN size<5 THEN a.elev END, CASE WHEN size>=5 THEN b.elev END, CASE WHEN size>=10 THEN c.elev END, CASE WHEN size>=100 THEN d.elev END, whole),6) AS filled FROM v_dtmf f CROSS JOIN (SELECT greatest(max(row_),max(col_)) AS size, avg(elev) AS whole FROM v_dtmf) "
       + " ".join(f"LEFT JOIN {_filled(k)} {n} ON f.row_={n}.row_ AND f.col_={n}.col_" for k, n in ((2, "a"), (5, "b"), (10, "c"), (100, "d"))))
def fill_gaps(load):
    return rounded(grid.fill_gaps(load("v_dtmf"), "row_", "col_", "elev"), ["row_", "col_"], filled=F.col("filled"))


def _kernel_sql(cubic: bool) -> str:
    d = lambda v, at: f"abs({v}-{at})"
    near = (lambda t: f"1.5*{t}*{t}*{t}-2.5*{t}*{t}+1", lambda t: f"-0.5*{t}*{t}*{t}+2.5*{t}*{t}-4*{t}+2") if cubic else (lambda t: f"(4-6*{t}*{t}+3*{t}*{t}*{t})/6", lambda t: f"(2-{t})*(2-{t})*(2-{t})/6")
    k = lambda t: f"(CASE WHEN {t}<1 THEN {near[0](t)} WHEN {t}<2 THEN {near[1](t)} ELSE 0 END)"
    return ("SELECT f.row_, f.col_, round(sum(CASE WHEN c.elev IS NOT NULL THEN w*c.elev END)/nullif(sum(CASE WHEN c.elev IS NOT NULL THEN w END),0),5) AS elev FROM (SELECT row_, col_, r0+a AS r, c0+b AS c, "
            f"{k(d('y-r0', 'a'))}*{k(d('x-c0', 'b'))} AS w FROM (SELECT *, CAST(floor(y) AS INT) AS r0, CAST(floor(x) AS INT) AS c0 FROM (SELECT row_, col_, (row_-0.5)/5+0.5 AS y, (col_-0.5)/4+0.5 AS x FROM v_dtmf)), unnest([-1,0,1,2]) AS p(a), unnest([-1,0,1,2]) AS q(b)) f "
            "JOIN v_dtmc c ON f.r=c.row_ AND f.c=c.col_ WHERE w<>0 GROUP BY f.row_, f.col_")


@query(_kernel_sql(True))
def resample_cubic(load):
    return rounded(grid.resample(load("v_dtmf"), load("v_dtmc"), "row_", "col_", ["elev"], 5, 4, method="cubic"), ["row_", "col_"], 5, elev=F.col("elev"))


@query(_kernel_sql(False))
def resample_cubicspline(load):
    return rounded(grid.resample(load("v_dtmf"), load("v_dtmc"), "row_", "col_", ["elev"], 5, 4, method="cubicspline"), ["row_", "col_"], 5, elev=F.col("elev"))


@query("SELECT row_, col_, elev FROM v_dtmf WHERE row_ BETWEEN 3 AND 20 AND col_ BETWEEN 5 AND 24")
def crop_extent(load):
    return grid.crop(load("v_dtmf"), "row_", "col_", FINE, 160210.0, 161190.0, 39010.0, 39890.0).select("row_", "col_", "elev")


POINTS = "SELECT c_custkey, CAST(160000+c_custkey*37%2600 AS DOUBLE) AS x, CAST(40000-c_custkey*53%9000 AS DOUBLE) AS y FROM customer"


@query(f"SELECT c_custkey, round(x,3) AS x, round(y,3) AS y, round(elev,6) AS elev FROM ({POINTS}) p LEFT JOIN v_dtmf f ON f.row_=CAST(floor((40000-y)/50) AS INT)+1 AND f.col_=CAST(floor((x-160000)/50) AS INT)+1")
def point_lookup(load):
    k = F.col("c_custkey")
    points = load("customer").select("c_custkey", (160000 + (k * 37 % 2600) * 1.0).alias("x"), (40000 - (k * 53 % 9000) * 1.0).alias("y"))
    return rounded(grid.lookup(points, load("v_dtmf"), "row_", "col_", FINE, "x", "y", ["elev"]), ["c_custkey", "x", "y"], elev=F.col("elev"))


def _passes(n: int) -> str:
    steps = ["p0 AS (SELECT row_, col_, CASE WHEN elev IS NULL AND (row_+col_)%7=0 THEN 10+row_*0.1+col_*0.01 END AS sst FROM v_dtmf)"]
    for i in range(1, n + 1):
        steps.append(f"p{i} AS (SELECT a.row_, a.col_, coalesce(a.sst, b.m) AS sst FROM p{i - 1} a LEFT JOIN (SELECT x.row_+dr AS row_, x.col_+dc AS col_, avg(sst) AS m FROM p{i - 1} x, range(-4,5) AS p(dr), range(-4,5) AS q(dc) WHERE sst IS NOT NULL GROUP BY 1, 2) b ON a.row_=b.row_ AND a.col_=b.col_)")
    return "-- with\n" + ", ".join(steps) + f" SELECT p{n}.row_, p{n}.col_, round(CASE WHEN elev IS NULL THEN sst END,6) AS sst FROM p{n} JOIN v_dtmf f ON f.row_=p{n}.row_ AND f.col_=p{n}.col_"


@query(_passes(5))
def fill_coast(load):
    """Sea temperatures that only some sea cells have, filled towards the coast."""
    f = load("v_dtmf")
    sea = f.select("row_", "col_", F.when(F.col("elev").isNull() & ((F.col("row_") + F.col("col_")) % 7 == 0), 10 + F.col("row_") * 0.1 + F.col("col_") * 0.01).alias("sst"))
    return rounded(grid.fill_coast(sea, f.where("elev is not null"), "row_", "col_", "sst"), ["row_", "col_"], sst=F.col("sst"))


def three(load):
    f = load("v_dtmf").select("row_", "col_", "elev")
    return [f.where("col_ <= 20"), f.where("col_ between 15 and 30").withColumn("elev", F.col("elev") + 10), f.where("col_ >= 25").withColumn("elev", F.col("elev") - 5)]


THREE = "SELECT row_, col_, elev, 0 AS t FROM v_dtmf WHERE col_<=20 UNION ALL SELECT row_, col_, elev+10, 1 FROM v_dtmf WHERE col_ BETWEEN 15 AND 30 UNION ALL SELECT row_, col_, elev-5, 2 FROM v_dtmf WHERE col_>=25"


@query(f"SELECT row_, col_, round(arg_min(elev, t) FILTER (elev IS NOT NULL),6) AS elev FROM ({THREE}) GROUP BY row_, col_")
def merge_tiles(load):
    return rounded(grid.merge_tiles(three(load), ["row_", "col_"], "elev"), ["row_", "col_"], elev=F.col("elev"))


@query(f"SELECT row_, col_, round(avg(elev),6) AS elev FROM ({THREE}) GROUP BY row_, col_")
def mosaic_mean(load):
    return rounded(grid.mosaic(three(load), ["row_", "col_"], "elev"), ["row_", "col_"], elev=F.col("elev"))


@query(f"SELECT row_, col_, round(min(elev),6) AS elev FROM ({THREE}) GROUP BY row_, col_")
def mosaic_min(load):
    return rounded(grid.mosaic(three(load), ["row_", "col_"], "elev", "min"), ["row_", "col_"], elev=F.col("elev"))


CUTS = "(VALUES (1,1,30,1,24),(2,1,30,17,40),(3,23,60,1,24),(4,23,60,17,40))"


@query(f"SELECT row_, col_, round(sum(w*v)/sum(w),6) AS elev FROM (SELECT row_, col_, elev+t AS v, least(1.0,(least(row_-r0,r1-row_)+0.5)/8)*least(1.0,(least(col_-c0,c1-col_)+0.5)/8) AS w FROM v_dtmf JOIN {CUTS} AS x(t,r0,r1,c0,c1) ON row_ BETWEEN r0 AND r1 AND col_ BETWEEN c0 AND c1 WHERE elev IS NOT NULL) GROUP BY row_, col_")
def blend_grid(load):
    """Four tiles that overlap in rows and columns, and in the middle all four."""
    f = load("v_dtmf")
    cuts = f.sparkSession.createDataFrame([(1, 1, 30, 1, 24), (2, 1, 30, 17, 40), (3, 23, 60, 1, 24), (4, 23, 60, 17, 40)], "t int, r0 int, r1 int, c0 int, c1 int")
    inside = F.col("row_").between(F.col("r0"), F.col("r1")) & F.col("col_").between(F.col("c0"), F.col("c1"))
    cells = f.join(F.broadcast(cuts), inside).select("t", "row_", "col_", (F.col("elev") + F.col("t")).alias("elev"))  # four rows
    return rounded(grid.blend_grid(cells, cuts, "t", "row_", "col_", "elev", 8), ["row_", "col_"], elev=F.col("elev"))


EXTENTS = "SELECT p_partkey AS id, CAST((p_partkey%20)*900 AS DOUBLE) AS xmin, CAST((p_partkey%20)*900+1000 AS DOUBLE) AS xmax, CAST(floor(p_partkey/20)*900 AS DOUBLE) AS ymin, CAST(floor(p_partkey/20)*900+1000 AS DOUBLE) AS ymax FROM part"


@query(f"WITH e AS ({EXTENTS}) SELECT a.id AS a, b.id AS b, greatest(a.xmin,b.xmin) AS xmin, least(a.xmax,b.xmax) AS xmax, greatest(a.ymin,b.ymin) AS ymin, least(a.ymax,b.ymax) AS ymax FROM e a JOIN e b ON a.xmin<b.xmax AND b.xmin<a.xmax AND a.ymin<b.ymax AND b.ymin<a.ymax")
def overlapping_extents(load):
    """Of tiles in rows of twenty, which share an area."""
    spark = load("region").sparkSession
    e = spark.sql(EXTENTS.replace("FROM part", "FROM {part}"), part=load("part"))
    return grid.overlapping(e, e)


@query("SELECT l_orderkey, label, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS k FROM (SELECT DISTINCT l_orderkey, l_orderkey*7%1009 AS label FROM lineitem)")
def renumber_labels(load):
    df = load("lineitem").select("l_orderkey", (F.col("l_orderkey") * 7 % 1009).alias("label")).distinct()
    return grid.renumber(df, "label", "k").select("l_orderkey", "label", "k")


@query("SELECT CAST(floor((row_-1)/2) AS INT) AS row_, CAST(floor((col_-1)/2) AS INT) AS col_, count(DISTINCT elev) AS n FROM v_dtmf WHERE elev IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT DISTINCT -row_, -1, 0 FROM v_dtmf WHERE elev IS NULL")
def distinct_values(load):
    f = load("v_dtmf")
    some = f.where("elev is not null").groupBy(F.floor((F.col("row_") - 1) / 2).cast("int").alias("row_"), F.floor((F.col("col_") - 1) / 2).cast("int").alias("col_")).agg(F.countDistinct("elev").alias("n"))
    return some.unionByName(f.where("elev is null").select((-F.col("row_")).alias("row_"), F.lit(-1).alias("col_"), F.lit(0).cast("long").alias("n")).distinct())


def _sectors(n: int) -> str:
    return f"CAST(round_even(winddir/(360.0/{n}),0) AS INT)%{n}"


WIND_DIRS = "SELECT cell, CAST(floor(winddir/45) AS INT)%8 AS dir, avg(windspeed) AS w FROM v_coarse GROUP BY 1, 2"


@query(f"SELECT c.cell, c.d, round(c.windspeed*m.w/7,6) AS speed FROM v_coarse c LEFT JOIN ({WIND_DIRS}) m ON m.cell=c.cell AND m.dir={_sectors(8)}")
def direction_lookup(load):
    """A coefficient of each cell for the sector of the wind: one array a cell, so that the series is joined once."""
    df = load("v_coarse")
    table = df.groupBy("cell", (F.floor(F.col("winddir") / 45).cast("int") % 8).alias("dir")).agg(F.avg("windspeed").alias("w"))
    out = wind.by_sector(df, wind.as_arrays(table, ["cell"], "dir", "w", 8), ["cell"], "winddir", 8)
    return rounded(out, ["cell", "d"], speed=F.col("windspeed") * F.col("coefficient") / 7)


def _gain(wdir: float, res1: float, res2: float) -> str:
    return ", ".join(f"({-y},{x})" for x, y in wind.upwind_shifts(wdir, res1, res2))


@query(f"SELECT f.row_, f.col_, round((1+sum(CASE WHEN f.elev-g.elev IS NULL THEN 1.0 WHEN f.elev-g.elev<0 THEN 1.0 ELSE greatest(1.0, ln(67.8*(f.elev-g.elev+2)-5.42)/4.8699) END))/count(*),6) AS gain FROM v_dtmf f CROSS JOIN (VALUES {_gain(225, 50, 1000)}) AS o(dr,dc) LEFT JOIN v_dtmf g ON g.row_=f.row_+dr AND g.col_=f.col_+dc GROUP BY f.row_, f.col_")
def wind_height_gain(load):
    return rounded(wind.height_gain(load("v_dtmf"), "row_", "col_", "elev", [225.0], 50, 1000), ["row_", "col_"], gain=F.col("gain"))


@query("SELECT c.cell, c.d, round(lr*-elev*0.01*CASE WHEN windspeed<5 THEN 1.0 ELSE 0.0 END+3e-11,8) AS fall FROM (SELECT *, 0.005+relhum*1e-5 AS lr FROM v_coarse) c JOIN v_dtmc m ON c.cell=m.cell")
def cold_air_drop(load):
    df = load("v_coarse").join(load("v_dtmc").select("cell", "elev"), "cell")
    return rounded(df, ["cell", "d"], 8, fall=physics.cold_air_drop(0.005 + F.col("relhum") * 1e-5, F.col("elev") * 0.01, F.when(F.col("windspeed") < 5, 1.0).otherwise(0.0)) + 3e-11)


@query("SELECT cell, d, round(CASE WHEN hi<lo THEN hi ELSE lo END,6) AS lo, round(CASE WHEN hi<lo THEN lo ELSE hi END,6) AS hi FROM (SELECT cell, d, tmin+3 AS lo, tmax-3 AS hi FROM v_day)")
def ordered_extremes(load):
    lo, hi = physics.ordered(F.col("tmin") + 3, F.col("tmax") - 3)
    return rounded(load("v_day"), ["cell", "d"], lo=lo, hi=hi)


SHARES = "SELECT cell, d, CASE WHEN prec<30 THEN 0.0 WHEN prec>120 THEN 1.0 ELSE (prec-25)/100 END AS v FROM v_coarse"


@query(f"-- with\na AS ({SHARES}), b AS (SELECT *, CASE WHEN v>0 AND v<1 THEN ln(v/(1-v)) END AS l FROM a), c AS (SELECT min(l) AS lo, max(l) AS hi FROM b) SELECT cell, d, round(CASE WHEN v=0 THEN lo WHEN v=1 THEN hi ELSE l END,6) AS l FROM b, c")
def logit_set(load):
    v = F.when(F.col("prec") < 30, 0.0).when(F.col("prec") > 120, 1.0).otherwise((F.col("prec") - 25) / 100)
    return rounded(bias.logit_over(load("v_coarse").withColumn("v", v), "v"), ["cell", "d"], l=F.col("v"))


@query(f"-- with\na AS ({SHARES}), c AS (SELECT ln(min(v)) AS lo FROM a WHERE v>0) SELECT cell, d, round(CASE WHEN v=0 THEN lo ELSE ln(CASE WHEN v>0 THEN v END) END,6) AS l FROM a, c")
def log_set(load):
    v = F.when(F.col("prec") < 30, 0.0).when(F.col("prec") > 120, 1.0).otherwise((F.col("prec") - 25) / 100)
    return rounded(bias.log_over(load("v_coarse").withColumn("v", v), "v"), ["cell", "d"], l=F.col("v"))


@query("SELECT cell, d, round(least(prec, 0.8*max(CASE WHEN year(d)<1998 THEN prec END) OVER (PARTITION BY cell)),6) AS capped FROM v_coarse")
def cap_multiple(load):
    df = load("v_coarse")
    return rounded(bias.cap_at_multiple(df, df.where("year(d) < 1998"), ["cell"], "prec", 0.8), ["cell", "d"], capped=F.col("capped"))


@query("SELECT cell, ts, round(w*(tc+2)+(1-w)*tc,6) AS t, round(w,6) AS w FROM (SELECT *, 1/(1+exp(-(-0.1095761+(0.10420*sqrt(tc+6)-0.47852)*(row_*0.1-1+3.401197)-0.1553487*(col_*0.2-1)))) AS w FROM v_obs)")
def coastal_temperature(load):
    t, w = physics.coastal_temperature(F.col("tc"), F.col("tc") + 2, F.col("tc") + 6, F.col("row_") * 0.1 - 1, F.col("col_") * 0.2 - 1)
    return rounded(load("v_obs"), ["cell", "ts"], t=t, w=w)


def _coast(m: str, res: float) -> str:
    r = math.log(res)
    low, high = (-6.74389 + 1.08141 * r, -0.6167 + 0.3197 * r), (-3.1163 + 0.4818 * r, 1.5842 - 0.7922 * r + 0.1104 * r * r)
    part = lambda ab: f"1/(1+exp(-({ab[0]!r}+{ab[1]!r}*ln({m}/(1-{m})))))"
    return f"CASE WHEN {m}>0 AND {m}<=0.5 THEN {part(low)} WHEN {m}>0.5 AND {m}<1 THEN {part(high)} ELSE {m} END"


@query(f"SELECT cell, d, round({_coast('m', 100.0)},6) AS w FROM (SELECT cell, d, least(1.0,(prec-1)/100) AS m FROM v_coarse)")
def coastal_weight(load):
    return rounded(load("v_coarse"), ["cell", "d"], w=physics.coastal_weight(F.least(F.lit(1.0), (F.col("prec") - 1) / 100), 100.0))


@query("SELECT cell, d, round(least((200+prec)/(5.67e-8*power(windspeed+273.15,4)),1.0),6) AS em FROM v_coarse")
def sky_emissivity(load):
    return rounded(load("v_coarse"), ["cell", "d"], em=physics.sky_emissivity(200 + F.col("prec"), physics.lw_up(F.col("windspeed"), 1.0)))


@query("SELECT cell, ts, round(tc+273.15,6) AS k, round(tc*100*0.1,6) AS kpa, round(tc*1000,6) AS mm FROM v_obs")
def change_units(load):
    tc = F.col("tc")
    return rounded(load("v_obs"), ["cell", "ts"], k=physics.change_units(tc, "degC", "K"), kpa=physics.change_units(tc * 100, "hPa", "kPa"), mm=physics.change_units(tc, "m", "mm"))


@query("SELECT c_custkey, round(x,2) AS x, round(y,2) AS y FROM (" + crs.sql_to_grid("(49.9+c_custkey%900*0.01)", "(-6+c_custkey%700*0.01)", "customer", "c_custkey") + ")")
def to_national_grid(load):
    """Eastings and northings on the Airy ellipsoid of latitudes and longitudes there."""
    k = F.col("c_custkey")
    points = load("customer").select("c_custkey", (49.9 + k % 900 * 0.01).alias("lat"), (-6 + k % 700 * 0.01).alias("lon"))
    return rounded(crs.to_grid(points, "lat", "lon"), ["c_custkey"], 2, x=F.col("x"), y=F.col("y"))


# Weather of the coarse grid on the fine one.
LAND = "(SELECT row_, col_, elev FROM v_dtmf WHERE elev IS NOT NULL)"
S_SHIFT = f"SELECT f.row_, f.col_, -9.938e-3-6.550e-4*(elev-zc)+4.966e-5*zc+1.358e-6*zc*(elev-zc) AS shift FROM v_dtmf f JOIN {s_resample(LAND, '(SELECT row_, col_, coalesce(elev,0) AS zc FROM v_dtmc)', ['zc'], 5, 4)} z ON f.row_=z.row_ AND f.col_=z.col_"


def s_cloud(coarse: str) -> str:
    """CTEs that end in cloud(row_, col_, d, v) of a table with these columns."""
    return (f"g AS (SELECT *, CASE WHEN v>0 AND v<1 THEN ln(v/(1-v)) END AS l FROM {s_resample(LAND, coarse, ['v'], 5, 4, ('d',))}), k AS (SELECT min(l) AS lo, max(l) AS hi FROM g), e AS ({S_SHIFT}), "
            "cloud AS (SELECT g.row_, g.col_, g.d, 1/(1+exp(-(CASE WHEN v=0 THEN lo WHEN v=1 THEN hi ELSE l END+shift))) AS v FROM g JOIN e ON g.row_=e.row_ AND g.col_=e.col_, k)")


def land_of(load):
    return load("v_dtmf").where("elev is not null").select("row_", "col_", F.col("elev").alias("zf"))


@query("-- with\na AS (SELECT row_, col_, d, CASE WHEN prec<20 THEN 0.0 WHEN prec>140 THEN 1.0 ELSE prec/150 END AS v FROM v_coarse), " + s_cloud("a") + " SELECT row_, col_, d, round(v,6) AS v FROM cloud")
def cloud_fraction(load):
    from .plans import downscale

    share = F.when(F.col("prec") < 20, 0.0).when(F.col("prec") > 140, 1.0).otherwise(F.col("prec") / 150)
    df = load("v_coarse").select("row_", "col_", "d", share.alias("v"))
    return rounded(downscale.cloud_fraction(df, load("v_dtmc"), land_of(load), "row_", "col_", "d", "v", 5, 4), ["row_", "col_", "d"], v=F.col("v"))


def _sky(table: str, lat_: str, lon_: str) -> str:
    """SQL of (row_, col_, d, cs): the mean of 24 hours' clear-sky radiation for the distinct days and cells of a table."""
    from .catalogue import CLEAR

    sun = f"SELECT *, {s_st('lt', lon_, 'jd')} AS st, {lat_} AS lat FROM (SELECT row_, col_, d, {s_jd('d')} AS jd, h*1.0 AS lt FROM {table}, unnest(range(24)) AS u(h))"
    high = f"SELECT *, greatest(sh,1e-12) AS s FROM (SELECT *, {s_sh('jd', 'st', 'lat')} AS sh FROM ({sun}))"
    return f"SELECT row_, col_, d, avg({CLEAR}) AS cs FROM (SELECT *, 35*s/sqrt(1224*s*s+1) AS m, ln(0.8)+17.27*15/(237.3+15) AS xx FROM ({high})) GROUP BY row_, col_, d"


FINE_LAT, FINE_LON = "(48+row_*0.1)", "(-6+col_*0.1)"


@query(f"-- with\nc0 AS (SELECT row_, col_, d, 60+prec AS sw FROM v_coarse), s0 AS ({_sky('c0', '(48+row_*0.5)', '(-6+col_*0.5)')}), a AS (SELECT c0.row_, c0.col_, c0.d, CASE WHEN cs=0 THEN 1.0 ELSE greatest(0.0,least(1.0,sw/cs)) END AS v FROM c0 JOIN s0 ON c0.row_=s0.row_ AND c0.col_=s0.col_ AND c0.d=s0.d), "
       + s_cloud("a") + f", s1 AS ({_sky('cloud', FINE_LAT, FINE_LON)}) SELECT cloud.row_, cloud.col_, cloud.d, round(v*cs,3) AS swrad FROM cloud JOIN s1 ON cloud.row_=s1.row_ AND cloud.col_=s1.col_ AND cloud.d=s1.d")
def shortwave_downscale(load):
    from .plans import downscale

    df = load("v_coarse").select("row_", "col_", "d", (60 + F.col("prec")).alias("swrad"))
    fine_where = (48 + F.col("row_") * 0.1, -6 + F.col("col_") * 0.1)
    return rounded(downscale.shortwave(df, load("v_dtmc"), load("v_dtmf"), "row_", "col_", "d", 5, 4, (lat(), lon()), fine_where), ["row_", "col_", "d"], 3, swrad=F.col("swrad"))


_RATE = "9.8076*(1+2501000*{r}/(287*({t}+273.15)))/(1003.5+0.622*2501000.0*2501000.0*{r}/(287*({t}+273.15)*({t}+273.15)))"


def _lifted(t: str) -> str:
    ea = f"({s_satvap(t)}*relhum/100)"
    return f"(0.622*{ea}/(pres-{ea}))"


_TEMPS = {"tmin": "windspeed", "tmax": "(windspeed+relhum/20)", "tmean": "((windspeed+windspeed+relhum/20)/2)"}


@query("-- with\nb AS (SELECT c.row_, c.col_, c.d, coalesce(m.elev+2,0) AS zc, " + ", ".join(f"{e} AS {t}, {_RATE.format(t=e, r=_lifted(e))} AS lr_{t}" for t, e in _TEMPS.items()) + " FROM v_coarse c JOIN v_dtmc m ON c.row_=m.row_ AND c.col_=m.col_), z AS (SELECT *, "
       + ", ".join(f"{t}+lr_{t}*zc AS s_{t}" for t in _TEMPS) + f" FROM b), f AS (SELECT * FROM {s_resample(LAND, 'z', [*(f'lr_{t}' for t in _TEMPS), *(f's_{t}' for t in _TEMPS)], 5, 4, ('d',))}), "
       "t AS (SELECT f.row_, f.col_, f.d, " + ", ".join(f"s_{t}-lr_{t}*(elev+2) AS {t}" for t in _TEMPS) + " FROM f JOIN v_dtmf m ON f.row_=m.row_ AND f.col_=m.col_) "
       "SELECT row_, col_, d, round(CASE WHEN tmax<tmin THEN tmax ELSE tmin END,5) AS tmin, round(CASE WHEN tmax<tmin THEN tmin ELSE tmax END,5) AS tmax, round(tmean,5) AS tmean FROM t")
def temperature_downscale(load):
    """Daily temperatures by elevation, inland and without drainage."""
    from .plans import downscale

    df = load("v_coarse").select("row_", "col_", "d", F.col("windspeed").alias("tmin"), (F.col("windspeed") + F.col("relhum") / 20).alias("tmax"), "relhum", "pres", "windspeed", F.lit(300.0).alias("lwrad"))
    out = downscale.temperatures(df, load("v_dtmc"), load("v_dtmf"), "row_", "col_", "d", 5, 4)
    return out.select("row_", "col_", "d", *(plainly_rounded(F.col(t), 5).alias(t) for t in ("tmin", "tmax", "tmean")))


@query(None)
def wind_coefficients(load):
    """Coefficients of the wind over the fine grid in eight directions."""
    return wind.coefficients(load("v_dtmf"), "row_", "col_", "elev", 50, 2, 10).select("row_", "col_", F.transform("coefficients", lambda c: F.round(c, 6)).alias("coefficients"))


@query(None)
def wind_downscale(load):
    """Wind on the fine grid, by the terrain up-wind."""
    table = wind.coefficients(load("v_dtmf"), "row_", "col_", "elev", 50, 2, 10)
    return rounded(wind.downscale(load("v_coarse"), load("v_dtmf"), table, "row_", "col_", "d", 5, 4), ["row_", "col_", "d"], windspeed=F.col("windspeed"))


@query(None)
def rain_downscale(load):
    """Rain on the fine grid, its totals and wet days by elevation."""
    return rounded(rain.downscale(load("v_coarse"), load("v_dtmc"), load("v_dtmf"), "row_", "col_", "d", "prec", 5, 4, 20.0), ["row_", "col_", "d"], 5, prec=F.col("prec"))


@query(None)
def thin_plate_downscale(load):
    """Total rain on the fine grid by a thin-plate spline over position and elevation."""
    from .operators import splines

    totals = load("v_coarse").groupBy("row_", "col_").agg(F.sum("prec").alias("v")).join(load("v_dtmc").select("row_", "col_", "elev"), ["row_", "col_"])
    return rounded(splines.thin_plate(totals, load("v_dtmf"), "row_", "col_", "v", "elev", 5, 4, "log"), ["row_", "col_"], 3, v=F.col("v"))


@query(None)
def rain_patches(load):
    """Simulated patches of rain over the fine grid on one day."""
    from .operators import stochastic

    f = load("v_dtmf").where("elev is not null").select("row_", "col_", F.lit(1).alias("step"), (1 + F.col("elev") / 100).alias("v"))
    return rounded(stochastic.patches(f, "row_", "col_", "step", "v", 20), ["row_", "col_", "step"], 5, v=F.col("v"))


@query(None)
def rain_within_days(load):
    """Hourly rain of Bartlett-Lewis storms with each day's total."""
    from .operators import stochastic

    days = load("v_day").select("cell", "d", F.greatest(F.lit(0.0), F.col("tmean") / 3 - 2).alias("r"))
    return rounded(stochastic.subdaily_rain(days, ["cell"], "d", "r", (2.0, 6.0, 4.0, 12.0, 30.0), tries=100), ["cell", "d", "h"], 5, r=F.col("r"))


@query(None)
def coastal_exposures(load):
    """The share of land around each cell, of eight directions."""
    return rounded(coast.exposures(load("v_dtmf"), "row_", "col_", "elev", 50.0, 8, 5, 20), ["row_", "col_"], around=F.col("around"))


@query(None)
def spatial_downscale_all(load):
    """Every daily variable on the fine grid, with drainage and wind by terrain."""
    from .plans import downscale

    fine = load("v_dtmf")
    drainage = terrain.cold_air_potential(fine.withColumn("tile", F.floor((F.col("row_") - 1) / 20).cast("int")), "tile", "row_", "col_", "elev")
    table = wind.coefficients(fine, "row_", "col_", "elev", 50, 2, 10)
    df = load("v_coarse").select("row_", "col_", "d", F.col("windspeed").alias("tmin"), (F.col("windspeed") + F.col("relhum") / 20).alias("tmax"), "relhum", "pres", (60 + F.col("prec")).alias("swrad"), (280 + F.col("windspeed")).alias("lwrad"), "windspeed", "winddir", "prec")
    fine_where = (48 + F.col("row_") * 0.1, -6 + F.col("col_") * 0.1)
    out = downscale.all_to_fine(df, load("v_dtmc"), fine, "row_", "col_", "d", 5, 4, (lat(), lon()), fine_where, drainage, table, dry=20.0)
    return rounded_all(out)
