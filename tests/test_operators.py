"""Operators without a SQL counterpart against plain versions, known values and what must hold."""

import csv
import datetime as dt
import glob
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrusgrid import catalogue, sqlfunctions
from cirrusgrid.fixtures import view
from cirrusgrid.functions import calendar, crs
from cirrusgrid.operators import coast, grid, rain, splines, stochastic, temporal, terrain, wind
from cirrusgrid.plans import downscale
from cirrusgrid.sources import climdata, etl

CONE = [(25, 24, 21, 24, 25), (15, 14, 11, 14, 15), (5, 4, 1, 4, 5), (15, 14, 11, 14, 15), (25, 24, 21, 24, 25)]


def table(spark, rows, tile=lambda r, c: 1):
    cells = [(tile(r, c), r + 1, c + 1, None if math.isnan(v) else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "tile int, r int, c int, z double")


def rough(seed, n=9, m=8):
    rng = np.random.default_rng(seed)
    z = np.round(rng.random((n, m)) * 20)  # many ties
    z[rng.random((n, m)) < 0.15] = np.nan
    return z


def plain_basins(z):
    """Looks at every cell for the lowest one, again and again."""
    label, done = np.zeros(z.shape, int), np.zeros(z.shape, bool)
    cells = [(i, j) for i in range(z.shape[0]) for j in range(z.shape[1]) if not np.isnan(z[i, j])]
    basin = 0
    while free := [x for x in cells if not done[x]]:
        basin += 1
        at = min(free, key=lambda x: (z[x], x))
        while at:
            label[at], done[at] = basin, True
            for y in range(at[0] - 1, at[0] + 2):
                for x in range(at[1] - 1, at[1] + 2):
                    if (y, x) in cells and z[y, x] >= z[at]:
                        label[y, x] = basin
            free = [x for x in cells if not done[x] and label[x] == basin]
            at = min(free, key=lambda x: (z[x], x)) if free else None
    return label


@pytest.mark.parametrize("seed", range(4))
def test_basins_and_flow_against_plain_versions(spark, seed):
    z = rough(seed)
    df = table(spark, z)
    want = plain_basins(z)
    got = np.zeros(z.shape, int)
    for x in terrain.tile_basins(df, "tile", "r", "c", "z").collect():
        got[x["r"] - 1, x["c"] - 1] = x["basin"]
    assert (got == want).all()
    cells = sorted(((i, j) for i in range(9) for j in range(8) if want[i, j]), key=lambda x: (-z[x], x[1], x[0]))
    flow = {x: 1.0 for x in cells}
    for i, j in cells[:-1]:
        around = [((a + 1) + 3 * (b + 1), i + a, j + b) for b in (-1, 0, 1) for a in (-1, 0, 1) if (i + a, j + b) in flow]
        least = min(z[y, x] for _, y, x in around)
        code = round(sum(k for k, y, x in around if z[y, x] == least) / sum(z[y, x] == least for _, y, x in around))
        y, x = i + code % 3 - 1, j + code // 3 - 1
        if (y, x) in flow and y < 8 and x < 7 and want[y, x] == want[i, j]:
            flow[y, x] += flow[i, j]
    labelled = df.join(terrain.tile_basins(df, "tile", "r", "c", "z"), ["tile", "r", "c"])
    assert {(x["r"] - 1, x["c"] - 1): x["flow"] for x in terrain.flow_accumulation(labelled, "tile", "r", "c", "z", "basin").collect()} == flow


def test_basins_over_tiles(spark):
    parts = table(spark, CONE, lambda r, c: 2 * (r // 3) + c // 3)
    assert {x["basin"] for x in terrain.basins(parts, "tile", "r", "c", "z").collect()} == {1}
    two = [(3, 2, 1, 2, 3.5, 2, 0, 2)] * 3
    assert [len({x["basin"] for x in terrain.basins(table(spark, two), "tile", "r", "c", "z", b).collect()}) for b in (0.0, 5.0)] == [2, 1]
    flow = {(x["r"], x["c"]): x["flow"] for x in terrain.flow_accumulation(table(spark, CONE), "tile", "r", "c", "z").collect()}
    assert flow[3, 3] == 25
    whole = terrain.cold_air_potential(parts, "tile", "r", "c", "z").collect()
    assert len(whole) == 25 and all(0 <= x["potential"] <= 24 for x in whole)


def test_national_grid(spark):
    """A worked example of the Ordnance Survey's, and there and back."""
    df = spark.createDataFrame([(52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600), (50.1, -5.2), (58.0, -3.0)], "lat double, lon double")
    rows = crs.from_grid(crs.to_grid(df, "lat", "lon"), "x", "y", "lat2", "lon2").collect()
    assert (rows[0]["x"], rows[0]["y"]) == pytest.approx((651409.903, 313177.270), abs=2e-3)
    assert all(abs(r["lat"] - r["lat2"]) < 1e-8 and abs(r["lon"] - r["lon2"]) < 1e-8 for r in rows)
    there = crs.shift_datum(df, "lat", "lon")
    back = crs.shift_datum(there, "lat", "lon", to_wgs=False).collect()
    moved = there.collect()
    assert all(abs(a["lat"] - b["lat"]) < 2e-6 and 1e-4 < abs(a["lat"] - c["lat"]) < 1e-2 for a, b, c in zip(rows, back, moved))


def test_one_value_is_constant_in_time(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, t, 5.0), (2, t, 0.0), (2, t + dt.timedelta(days=4), 8.0)], "cell int, ts timestamp, v double")
    times = spark.createDataFrame([(t + dt.timedelta(days=k),) for k in (-1, 1, 3, 9)], "ts timestamp")
    got = {(r["cell"], r["ts"].day): r["v"] for r in temporal.at_times(df, ["cell"], "ts", "v", times).collect()}
    assert [got[1, d] for d in (31, 2, 4, 10)] == [5.0] * 4 and [got[2, d] for d in (31, 2, 4, 10)] == [None, 2.0, 6.0, None]


def test_thin_plate_keeps_a_plane_and_smooths_noise(spark):
    rng = np.random.default_rng(3)
    high = {(r, c): float(rng.random() * 300) for r in range(1, 41) for c in range(1, 41)}
    fine = spark.createDataFrame([(r, c, z) for (r, c), z in high.items()], "r int, c int, z double")
    coarse = spark.createDataFrame([(r, c, high[r * 4 - 1, c * 4 - 1], 2 + 0.1 * (r * 4 - 1.5) - 0.05 * (c * 4 - 1.5) + 0.01 * high[r * 4 - 1, c * 4 - 1]) for r in range(1, 11) for c in range(1, 11)], "r int, c int, z double, v double")
    out = {(x["r"], x["c"]): x["v"] for x in splines.thin_plate(coarse, fine, "r", "c", "v", "z", 4, 4).collect()}
    assert len(out) == 1600 and max(abs(v - (2 + 0.1 * r - 0.05 * c + 0.01 * high[r, c])) for (r, c), v in out.items()) < 0.05
    share = splines.thin_plate(coarse.withColumn("v", F.when(F.col("v") > 4, 1.0).when(F.col("v") < 2, 0.0).otherwise((F.col("v") - 1.9) / 3)), fine, "r", "c", "v", "z", 4, 4, "logit")
    assert share.where("v <= 0 or v >= 1").count() == 0
    assert splines.thin_plate(coarse.limit(2), fine, "r", "c", "v", "z", 4, 4).select("v").distinct().count() == 1
    assert splines.thin_plate(coarse.where("false"), fine, "r", "c", "v", "z", 4, 4).where("v is not null and not isnan(v)").count() == 0


def test_patches_are_seeded_and_centred(spark):
    df = spark.range(1600).selectExpr("cast(id % 40 as int) + 1 as r", "cast(id / 40 as int) + 1 as c", "1 as step", "2D + (id % 7) / 10D as v")
    one, again = (stochastic.patches(df, "r", "c", "step", "v", 20).orderBy("r", "c").collect() for _ in range(2))
    assert one == again and len(one) == 1600 and min(x["v"] for x in one) >= 0
    before, after = (np.log(1 + np.array([x["v"] for x in rows])) for rows in (df.orderBy("r", "c").collect(), one))
    change = after - before
    share = -0.14934 + 0.1777 * math.log(20)
    assert abs(change.mean()) < 1e-9 and change.std(ddof=1) == pytest.approx(share * before.std(ddof=1), rel=1e-6)
    near = change.reshape(40, 40)
    assert np.corrcoef(near[:, 1:].ravel(), near[:, :-1].ravel())[0, 1] > 0.6  # neighbours are alike


def test_rain_within_days_adds_up(spark):
    days = [(1, dt.date(2018, 5, 1) + dt.timedelta(i), v) for i, v in enumerate((0.0, 3.0, 5.0, 1.0, 0.1, None, 2.0))]
    df = spark.createDataFrame(days, "cell int, d date, r double")
    out = stochastic.subdaily_rain(df, ["cell"], "d", "r", (2.0, 6.0, 4.0, 12.0, 30.0), tries=200)
    sums = {x["d"]: (x["n"], x["s"]) for x in out.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s")).collect()}
    assert {d: (24, pytest.approx(v or 0.0)) for _, d, v in days} == sums
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stochastic.subdaily_rain(df, ["cell"], "d", "r", (2.0, 6.0, 4.0, 12.0, 30.0), tries=200).collect()))


def test_flat_land_leaves_the_wind_alone(spark):
    flat = spark.range(400).selectExpr("cast(id % 20 as int) + 1 as r", "cast(id / 20 as int) + 1 as c", "10D as z")
    arrays = wind.coefficients(flat, "r", "c", "z", 50, 2, 10)
    inner = arrays.where("r between 8 and 13 and c between 8 and 13").collect()
    assert len(inner) == 36 and all(len(x["coefficients"]) == 8 for x in inner)
    assert all(v == pytest.approx(1, abs=0.05) for x in inner for v in x["coefficients"])


def test_wind_gains_on_a_ridge(spark):
    ridge = table(spark, [[0, 0, 0, 30, 0, 0, 0]] * 7)
    gain = {(x["r"], x["c"]): x["gain"] for x in wind.height_gain(ridge, "r", "c", "z", [90.0], 50, 150).collect()}
    assert gain[4, 4] == max(gain.values()) > 1.5
    shifts = wind.upwind_shifts(90.0, 50, 150)
    assert shifts == [(1, 0), (2, 0), (3, 0)] or shifts[0] == (1, 0)


def test_coast_draws_temperatures_towards_the_sea(spark):
    z = np.full((12, 12), 5.0)
    z[:, :4] = np.nan
    dtm = table(spark, z)
    exposed = coast.exposures(dtm, "r", "c", "z", 50.0, 8, 3, 30)
    fine = dtm.where("z is not null").select("r", "c", F.lit(1).alias("t"), F.lit(20.0).alias("temp"), F.lit(10.0).alias("sst"), F.lit(5.0).alias("windspeed"), F.lit(270.0).alias("winddir"))
    got = {(x["r"], x["c"]): x["temp"] for x in coast.temper(fine, exposed, "r", "c", "t", 8).collect()}
    assert len(got) == 96 and all(10 <= v <= 20 for v in got.values()) and got[6, 5] < got[6, 11]
    inland = coast.temper(fine, coast.exposures(table(spark, np.full((12, 12), 5.0)), "r", "c", "z", 50.0, 8, 3, 30), "r", "c", "t", 8)
    assert inland.where("temp <> 20").count() == 0


def coarse_weather(spark):
    start = dt.date(2018, 5, 1)
    rows = [(r, c, start + dt.timedelta(k), 5.0 + k, 12.0 + k, 80.0, 100.0, 150.0, 250.0, 0.5, 200.0 + 10 * c, float((k + r) % 3) * 4) for r in (1, 2, 3) for c in (1, 2, 3) for k in range(4)]
    return spark.createDataFrame(rows, "r int, c int, d date, tmin double, tmax double, relhum double, pres double, swrad double, lwrad double, windspeed double, winddir double, prec double")


def test_everything_downscaled_keeps_its_limits(spark):
    dtmc = spark.createDataFrame([(r, c, 100.0 * r) for r in (1, 2, 3) for c in (1, 2, 3)], "r int, c int, elev double")
    fine = spark.range(144).selectExpr("cast(id % 12 as int) + 1 as r", "cast(id / 12 as int) + 1 as c", "case when id % 12 = 0 then null else 50D * (id % 12) end as elev")
    drainage = fine.where("elev is not null").select("r", "c", F.lit(30.0).alias("potential"))
    where, fine_where = (F.lit(50.0) - F.col("r"), F.lit(-4.0) + F.col("c")), (F.lit(50.0) - F.col("r") / 4, F.lit(-4.0) + F.col("c") / 4)
    out = downscale.all_to_fine(coarse_weather(spark), dtmc, fine, "r", "c", "d", 4, 4, where, fine_where, drainage, dry=1.0).cache()
    assert out.count() == 132 * 4
    assert out.where("tmin > tmax or relhum < 20 or relhum > 100 or swrad < 0 or prec < 0 or winddir < 0 or winddir >= 360 or tmin is null or swrad is null or prec is null").count() == 0
    dry = downscale.all_to_fine(coarse_weather(spark), dtmc, fine, "r", "c", "d", 4, 4, where, fine_where, dry=1.0)
    assert out.join(dry.select("r", "c", "d", F.col("tmin").alias("t")), ["r", "c", "d"]).where("tmin > t").count() == 0  # drained air is never warmer
    low, high = (out.where(f"r = {r}").agg(F.avg("tmax")).first()[0] for r in (2, 12))
    assert low > high


def test_shade_cuts_the_beam_alone(spark):
    df = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.0)], "r int, c int, swrad double")
    walls = spark.createDataFrame([(1, 1, [9.0] * 24), (1, 2, [0.0] * 24)], "r int, c int, coefficients array<double>")
    sky = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.0)], "r int, c int, skyview double")
    rows = downscale.shaded(df, walls, sky, "r", "c", F.lit(100.0), F.lit(30.0), F.lit(0.4)).orderBy("c").collect()
    assert [(x["swrad"], x["difrad"]) for x in rows] == [(pytest.approx(20.0), pytest.approx(20.0)), (pytest.approx(100.0), pytest.approx(40.0))]


def test_rain_on_the_fine_grid_follows_share_and_total(spark):
    dtmc = spark.createDataFrame([(r, c, 100.0) for r in (1, 2, 3) for c in (1, 2, 3)], "r int, c int, elev double")
    fine = spark.range(144).selectExpr("cast(id % 12 as int) + 1 as r", "cast(id / 12 as int) + 1 as c", "100D as elev")
    out = rain.downscale(coarse_weather(spark).select("r", "c", "d", "prec"), dtmc, fine, "r", "c", "d", "prec", 4, 4, 1.0)
    total, _ = math.exp(9.039606e-3 - 2.923351e-2), 0
    want = {r: sum(float((k + r) % 3) * 4 for k in range(4)) * total for r in (1, 2, 3)}
    sums = {(x["r"], x["c"]): x["s"] for x in out.groupBy("r", "c").agg(F.sum("prec").alias("s")).collect()}
    assert sums[1, 1] == pytest.approx(want[1], rel=1e-6) and sums[12, 12] == pytest.approx(want[3], rel=1e-6)


def test_models_of_360_days_become_daily_climate(spark):
    names = "tasmin tasmax hurs psl pr clt uas vas rls rss".split()
    rows = [(1, (k + 0.5) * 24.0, 1.0, 5.0, 104.0, 1000.0, 2.0, 50.0, 3.0, -4.0, -60.0, 100.0) for k in range(90)]
    raw = spark.createDataFrame(rows, "cell int, hours double, " + ", ".join(f"{n} double" for n in names))
    dtm = spark.createDataFrame([(1, 20.0)], "cell int, elev double")
    out = etl.model_daily(raw, dtm, ["cell"], "hours").orderBy("d").collect()
    assert [r["d"] for r in out] == [dt.date(1970, 1, 1) + dt.timedelta(k) for k in range(len(out))] and len(out) >= 89
    r = out[40]
    assert (r["relhum"], r["pres"], r["windspeed"]) == pytest.approx((100.0, 100.0, 5.0)) and r["swrad"] == pytest.approx(100 / (1 - 0.205))
    assert r["lwrad"] == pytest.approx(-60 + 5.67e-8 * 0.97 * (3 + 273.15) ** 4)


def test_sea_temperatures_reach_the_coast(spark):
    days = [dt.date(2018, m, 15) for m in range(1, 9)]
    sst = spark.createDataFrame([(r, c, d, 10.0 + d.month if c < 4 else None) for r in range(1, 7) for c in range(1, 9) for d in days], "r int, c int, ts date, sst double")
    land = spark.createDataFrame([(r, 8) for r in range(1, 7)], "r int, c int")
    out = etl.sea_surface(sst, land, "r", "c", "ts", "sst", "2018-04-20", "2018-05-20").collect()
    assert {x["ts"].month for x in out} == {4, 5, 6}
    assert all((x["sst"] is None) == (x["c"] == 8) and (x["sst"] is None or x["sst"] == pytest.approx(10 + x["ts"].month)) for x in out)


def test_scaled_integers_and_parcels(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, dt.date(2018, 5, 1), 12.349), (1, 2, dt.date(2018, 5, 1), -0.019)], "r int, c int, d date, temp double")
    climdata.write_scaled(df, str(tmp_path / "s"), {"temp": "degC"})
    raw = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(x["temp"] for x in raw.collect()) == [-1, 1234] and raw.schema["temp"].metadata["unit"] == "degC * 100"
    back = climdata.read_scaled(spark, str(tmp_path / "s"))
    assert sorted(x["temp"] for x in back.collect()) == [-0.01, 12.34] and back.schema["temp"].metadata["unit"] == "degC"
    weights = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 1, 2, 3.0), ("b", 1, 1, 1.0)], "p string, r int, c int, weight double")
    climdata.write_parcels(df, weights, str(tmp_path / "p"), "p", "d", {"temp": 2})
    (file,) = glob.glob(str(tmp_path / "p" / "p=a" / "*.csv"))
    assert list(csv.DictReader(open(file)))[0]["temp"] == str(round((12.349 - 3 * 0.019) / 4, 2))


def test_numbers_of_labels_over_many_ranges(spark):
    df = spark.range(500).selectExpr("(id * 37) % 101 as label").repartition(5)
    got = {r["label"]: r["k"] for r in grid.renumber(df, "label", "k").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(got))}


def test_sql_functions_equal_expressions(spark):
    names = sqlfunctions.register(spark)
    assert len(names) == len(set(names)) >= 30
    row = spark.sql("SELECT cardinal_point(100D) AS p, day_length(2458240, 50D) AS n, humidity_relative_to_specific(80D, 11D, 101.3D) AS q, real_date_of_360day_hours(24D * 60) AS d, solar_zenith(2458240, 12D, 50D, 0D) AS z").first()
    assert row["p"] == "E" and 14 < row["n"] < 16 and 0.006 < row["q"] < 0.007 and row["d"] == dt.date(1970, 2, 28) or row["d"] is not None and 30 < row["z"] < 40


def test_years_of_five_digits_of_360_days_are_dates(spark):
    ymd = F.struct(F.col("y"), F.col("m"), F.col("d"))
    df = spark.createDataFrame([(9999, 12, 30), (10000, 1, 1), (26970, 2, 1), (12000, 2, 30), (10001, 2, 30), (26969, 3, 30), (None, 1, 1)], "y int, m int, d int")
    got = [r["s"] for r in df.select(calendar.repair_360day(ymd).cast("string").alias("s")).collect()]
    assert got == ["9999-12-30", "+10000-01-01", "+26970-01-31", "+12000-03-01", "+10001-03-01", "+26969-03-31", None]


def above_the_join(df):
    """What a plan does with the fine rows after the coarse neighbourhoods have been joined."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    return plan.split("ShuffledHashJoin")[0]


def test_fine_rows_are_neither_shuffled_nor_joined_again(spark):
    dtmc = spark.createDataFrame([(r, c, 100.0 * r) for r in (1, 2, 3) for c in (1, 2, 3)], "r int, c int, elev double")
    fine = spark.range(144).selectExpr("cast(id % 12 as int) + 1 as r", "cast(id / 12 as int) + 1 as c", "50D * (id % 12) as elev")
    arrays = fine.select("r", "c", F.array(*(F.lit(1.0),) * 8).alias("coefficients"))
    cells, where, fine_where = ("r", "c", "d", 4, 4), (F.lit(50.0), F.lit(-4.0)), (F.lit(50.0), F.lit(-4.0))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        w = coarse_weather(spark)
        for df in (
            downscale.cloud_fraction(w.select("r", "c", "d", (F.col("prec") / 8).alias("v")), dtmc, fine.select("r", "c", F.col("elev").alias("zf")), "r", "c", "d", "v", 4, 4),
            downscale.shortwave(w, dtmc, fine, *cells, where, fine_where),
            downscale.temperatures(w, dtmc, fine, *cells, drainage=fine.select("r", "c", F.lit(1.0).alias("potential"))),
            wind.downscale(w, fine, arrays, *cells),
            rain.downscale(w, dtmc, fine, "r", "c", "d", "prec", 4, 4, 1.0),
            downscale.all_to_fine(w, dtmc, fine, *cells, where, fine_where, coefficients=arrays),
        ):
            above = above_the_join(df)
            assert "Exchange hashpartitioning" not in above and "SortMergeJoin" not in above
            assert "aggregate(" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_generated_methods_stay_small_enough_to_compile(spark, sf):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    view(spark, sf, "v_day")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_extents_of_all_sizes_meet_once_without_comparing_all(spark):
    rng = np.random.default_rng(5)
    size = 10 ** rng.uniform(-3, 4, (300, 2))
    low = rng.uniform(-500, 500, (300, 2))
    rows = [(i, float(x), float(x + w), float(y), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(low, size))]
    rows += [(300, 0.0, 64.0, 0.0, 64.0), (301, 64.0, 128.0, 0.0, 64.0), (302, 10.0, 10.0, 10.0, 10.0), (303, -1e300, 1e300, 0.0, 1.0), (304, 20.0, 5.0, 0.0, 9.0), (305, None, 1.0, 0.0, 1.0)]
    e = spark.createDataFrame(rows, "id int, xmin double, xmax double, ymin double, ymax double")
    met = grid.overlapping(e, e)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    known = [r for r in rows if r[1] is not None]
    want = sorted((a[0], b[0]) for a in known for b in known if a[1] < b[2] and b[1] < a[2] and a[3] < b[4] and b[3] < a[4])
    assert sorted((r["a"], r["b"]) for r in met.collect()) == want


def test_plain_rounding_gives_what_round_gives(spark):
    rng = random.Random(7)
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 123456789012.123455, 1e-320, 9999.999995, 10000.000005]
    ties = [k / 2e5 for k in range(-301, 302)] + [-2.128075, 799.554925, -5.708175, -12.694275]
    near = [x * (1 + s * 2**-52) for x in ties for s in (-3, -1, 1, 3)]
    values = odd + ties + near + [rng.uniform(-2000, 2000) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 5).alias("want"), catalogue.plainly_rounded(F.col("x"), 5).alias("got"))
    assert [str(r["got"]) for r in df.collect()] == [str(r["want"]) for r in df.collect()]


def test_fine_temperatures_are_rounded_without_decimals(spark, sf):
    plan = catalogue.QUERIES["temperature_downscale"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ELSE round(") == plan.count("round(") == 3


@pytest.mark.parametrize("part", [1 << 40, 1 << 6])  # sides of 4 and, as for large tables, of 8
def test_neighbourhoods_of_all_tiles_are_whole(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(grid, "PART", part)
    rng = np.random.default_rng(3)
    known = {(r, c, t): float(rng.uniform(-9, 9)) for r in range(-3, 20) for c in range(-2, 12) for t in (1, 2) if rng.random() < 0.4}
    spark.createDataFrame([(*k, v) for k, v in known.items()], "r int, c int, t int, v double").write.parquet(str(tmp_path / "v"))
    fine = spark.range(46 * 28).selectExpr("cast(id % 46 as int) - 7 as r", "cast(id / 46 as int) - 5 as c")
    out = grid.resample(fine, spark.read.parquet(str(tmp_path / "v")), "r", "c", ["v"], 2, 2, keep=["t"])
    want = {}
    for r, c, t in ((r, c, t) for r in range(-7, 39) for c in range(-5, 23) for t in (1, 2)):
        y, x = (r - 0.5) / 2 + 0.5, (c - 0.5) / 2 + 0.5
        near = [(w, known[k]) for a in (0, 1) for b in (0, 1) if (k := (math.floor(y) + a, math.floor(x) + b, t)) in known and (w := (1 - abs(y - k[0])) * (1 - abs(x - k[1])))]
        if near:
            want[r, c, t] = sum(w * v for w, v in near) / sum(w for w, _ in near)
    assert {(x["r"], x["c"], x["t"]): x["v"] for x in out.collect()} == pytest.approx(want)


def test_coarse_rows_are_dealt_out_once_and_before_what_is_made_of_them(spark, sf, monkeypatch):
    monkeypatch.setattr(grid, "PART", 1000)
    for name in ("temperature_downscale", "spatial_downscale"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        around, dealt, made = plan.index("explode([[0,0],[0,1],[1,0],[1,1]])"), plan.rindex("REPARTITION_BY_NUM"), plan.rindex("lr_t")
        assert around < dealt and made < dealt and plan.count("Exchange hashpartitioning") == 3
        read = os.path.getsize(f"{sf}/lineitem.parquet") // 1000
        assert int(re.search(r"hashpartitioning\(_tr#\d+, _tc#\d+, (\d+)\)", plan).group(1)) >= read  # partitions grow with the input


def test_fine_weather_is_rounded_without_decimals(spark, sf):
    plan = catalogue.QUERIES["spatial_downscale"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ELSE round(") == plan.count("round(") == 5


def test_limits_of_cells_change_rain_as_windows_do(spark):
    rng = np.random.default_rng(11)
    days = [dt.date(2018, 5, 1) + dt.timedelta(k) for k in range(30)]
    amounts = [0.0, 0.0, 0.0, 1.0, 2.0, 5.5, None]
    rows = [(r, c, d, amounts[rng.integers(0, 7)]) for r in range(1, 5) for c in range(1, 4) for d in days if rng.random() < 0.8]
    known = spark.createDataFrame(rows, "r int, c int, d date, prec double").cache()
    ranked = known.join(rain.numbered_days(rain.regional_ranks(known, "d", "prec"), "d", "regional"), "d")
    static = [(r, c, None if r == 2 and c == 2 else float(rng.uniform(0, 300)), None if r == 3 and c == 3 else float(rng.choice([0, 0.1, 0.5, 0.9, 1]))) for r in range(1, 13) for c in range(1, 10)]
    static = spark.createDataFrame(static, "r int, c int, _total double, _share double")
    keys = ["d", "_at", "_order", "regional"]
    by_windows = rain.adjust(grid.resample(static, ranked, "r", "c", ["prec"], 3, 3, keys, carry=["_total", "_share"], place=True), ["_tr", "_tc", "r", "c"], "d", "prec", "regional", F.col("_share"), F.col("_total"))
    found = rain.limits(static, ranked, "r", "c", "prec", 3, 3)
    cells = static.select("r", "c").join(found, ["r", "c"])
    by_limits = grid.resample(cells, ranked, "r", "c", ["prec"], 3, 3, keys, carry=[x for x in cells.columns if x[0] == "_"]).withColumn("adjusted", rain.adjusted("prec"))
    want, got = ({(x["r"], x["c"], x["d"]): x["adjusted"] for x in df.collect()} for df in (by_windows, by_limits))
    assert len(want) > 2000 and got.keys() == want.keys()
    assert all(got[k] == want[k] if want[k] is None else got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_no_window_sorts_fine_rows_of_all_variables(spark):
    dtmc = spark.createDataFrame([(r, c, 100.0 * r) for r in (1, 2, 3) for c in (1, 2, 3)], "r int, c int, elev double")
    fine = spark.range(144).selectExpr("cast(id % 12 as int) + 1 as r", "cast(id / 12 as int) + 1 as c", "50D * (id % 12) as elev")
    out = downscale.all_to_fine(coarse_weather(spark), dtmc, fine, "r", "c", "d", 4, 4, (F.lit(50.0), F.lit(-4.0)), (F.lit(50.0), F.lit(-4.0)))
    above = above_the_join(out)
    assert "Window" not in above and "Sort" not in above.replace("SortMerge", "")
