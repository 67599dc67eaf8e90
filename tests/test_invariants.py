"""What must hold whatever the data, for operators that SQL can't express, and the small worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cirrusgrid import catalogue
from cirrusgrid.fixtures import view
from cirrusgrid.functions import physics
from cirrusgrid.operators import bias, grid, rain, temporal
from cirrusgrid.plans import downscale
from cirrusgrid.sources import climdata


def days(spark, values, name="v"):
    start = dt.date(2018, 5, 1)
    return spark.createDataFrame([(1, start + dt.timedelta(i), float(v)) for i, v in enumerate(values)], f"cell int, d date, {name} double")


def test_fold_by_position(spark):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(48)], "cell int, ts int, v double")
    assert [r["v"] for r in temporal.fold_positions(df, ["cell"], "ts", "v").orderBy("block").collect()] == [12.5, 36.5]


def test_strict_fold_is_null_for_a_day_with_a_gap(spark):
    t = dt.datetime(2018, 5, 1)
    df = spark.createDataFrame([(1, t, 1.0), (1, t + dt.timedelta(hours=1), None)], "cell int, ts timestamp, v double")
    assert temporal.fold(df, ["cell"], "ts", {"v": ("v", "mean")}, strict=True).first()["v"] is None
    assert temporal.fold(df, ["cell"], "ts", {"v": ("v", "mean")}).first()["v"] == 1.0


def test_hourly_temperature_meets_the_extremes(spark, sf):
    lo_hi = view(spark, sf, "v_day").groupBy("cell", "d").agg(F.min("tmin").alias("a"), F.max("tmax").alias("b"))
    hourly = catalogue.QUERIES["temperature_hourly"](spark, sf).groupBy("cell", "d").agg(F.min("temp").alias("lo"), F.max("temp").alias("hi"), F.count("temp").alias("n"))
    joined = hourly.join(lo_hi, ["cell", "d"]).where("b > a")
    assert joined.where("n <> 24 or abs(lo - a) > 0.001 or abs(hi - b) > 0.02").count() == 0 < joined.count()


def test_moving_average_of_width_one(spark):
    out = temporal.moving_average(days(spark, [3, 1, 2]), ["cell"], "d", "v", 1)
    assert [r["moving"] for r in out.orderBy("d").collect()] == [3, 1, 2]


def test_fill_days(spark):
    df = days(spark, [1, 2, 3, 4]).where("v <> 2 and v <> 3")
    assert [r["v"] for r in temporal.fill_days(df, ["cell"], "d", ["v"]).orderBy("d").collect()] == pytest.approx([1, 2, 3, 4])


def test_cardinal_points(spark):
    want = {357.0: "N", 20.0: "NNE", 100.0: "E", 185.0: "S", 265.0: "W", 290.0: "WNW"}
    df = spark.createDataFrame([(k,) for k in want] + [(400.0,), (None,)], "x double").select("x", physics.cardinal(F.col("x")).alias("p"))
    assert {r["x"]: r["p"] for r in df.collect()} == want | {400.0: None, None: None}


@pytest.mark.parametrize("kind", physics.HUMIDITIES)
def test_humidity_round_trip(spark, kind):
    df = spark.createDataFrame([(h,) for h in (25.0, 50.0, 75.0, 90.0, 100.0)], "h double")
    there = df.withColumn("x", physics.convert_humidity(F.col("h"), "relative", kind))
    back = there.withColumn("y", physics.convert_humidity(F.col("x"), kind, "relative"))
    assert back.where("abs(y - h) > 1e-9").count() == 0


def test_pressure_round_trip(spark):
    df = spark.createDataFrame([(100.0, 250.0), (99.0, None)], "p double, z double")
    back = df.withColumn("q", physics.atmos_to_sea_pressure(physics.sea_to_atmos_pressure(F.col("p"), F.col("z")), F.col("z")))
    assert back.where("abs(p - q) > 1e-9").count() == 0


def test_bilinear_of_a_constant(spark):
    coarse = spark.createDataFrame([(r, c, 7.0) for r in range(1, 4) for c in range(1, 4)], "r int, c int, v double")
    fine = spark.createDataFrame([(r, c) for r in range(1, 13) for c in range(1, 13)], "r int, c int")
    out = grid.resample(fine, coarse, "r", "c", ["v"], 4, 4)
    assert out.count() == 144 and out.where("abs(v - 7) > 1e-9").count() == 0


def test_rain_adjustment_meets_share_and_total(spark, sf):
    df = catalogue.QUERIES["rain_adjust"](spark, sf).groupBy("cell").agg(F.sum("adjusted").alias("s"), F.count_if(F.col("adjusted") > 0).alias("wet"), F.count(F.lit(1)).alias("n"))
    assert df.where("abs(s - 1000) > 0.01 or wet <> floor(0.6 * n + 0.5)").count() == 0


def test_rain_adjustment_leaves_a_dry_cell_dry(spark):
    df = days(spark, [0, 0, 0]).withColumn("reg", F.lit(1.0))
    out = rain.adjust(df, ["cell"], "d", "v", "reg", F.lit(0.0), F.lit(10.0))
    assert [r["adjusted"] for r in out.collect()] == [0, 0, 0]


def test_smooth_maps_a_line_onto_itself(spark):
    pairs = spark.createDataFrame([(1, i, 2.0 * i + 1, float(i)) for i in range(1, 60)], "cell int, rank int, obs double, mod double")
    out = bias.apply_smooth(spark.createDataFrame([(1, 5.5), (1, 40.25)], "cell int, v double"), bias.fit_smooth(pairs, ["cell"]), ["cell"], "v")
    assert [r["corrected"] for r in out.orderBy("v").collect()] == pytest.approx([12.0, 81.5], abs=1e-4)


def test_hourly_weather_keeps_its_limits(spark):
    start = dt.date(2018, 5, 1)
    rows = [(1, start + dt.timedelta(i), a, b, rh, p, 150.0, 300.0, 4.0, 200.0, 2.4) for i, (a, b, rh, p) in enumerate(zip((10.0, 9.0, 12.0, 12.0, 6.0), (15.0, 15.0, 18.0, 20.0, 12.0), (80.0, 80.0, 70.0, 90.0, 80.0), (96.0, 97.0, 98.0, 99.0, 100.0)))]
    df = spark.createDataFrame(rows, "cell int, d date, tmin double, tmax double, relhum double, pres double, swrad double, lwrad double, windspeed double, winddir double, prec double")
    out = downscale.to_hourly(df, ["cell"], "d", F.lit(50.0), F.lit(-5.0)).cache()
    assert out.count() == 120
    assert out.where("relhum < 10 or relhum > 100 or swrad < 0 or swrad > 1352.778 or winddir < 0 or winddir >= 360").count() == 0
    mean = out.groupBy("d").agg(F.avg("pres").alias("p"), F.sum("prec").alias("r"), F.avg("windspeed").alias("w"), F.avg("lwrad").alias("l")).join(df, "d")
    assert mean.where("abs(p - pres) > 1e-6 or abs(r - prec) > 1e-6 or abs(w - windspeed) > 1e-6 or abs(l - lwrad) > 1e-6").count() == 0


def test_coarse_variables_by_day_of_the_year_are_of_all_years(spark):
    coarse = [(1, dt.date(y, 3, 1) if y % 4 else dt.date(y, 2, 29), rh, 100.0, 2.0, wd, p) for y, rh, wd, p in ((1993, 60.0, 350.0, 1.0), (1996, 80.0, 10.0, 3.0), (1997, 70.0, 0.0, 8.0))]
    day = [(1, 1, 2, dt.date(2024, 2, 29), 1.0, 5.0)]
    tables = {
        "v_coarse": spark.createDataFrame(coarse, "cell int, d date, relhum double, pres double, windspeed double, winddir double, prec double"),
        "v_day": spark.createDataFrame(day, "cell int, row_ int, col_ int, d date, tmin double, tmax double"),
    }
    (r,) = catalogue.dailies(tables.get).collect()
    assert (r["relhum"], r["pres"], r["prec"]) == pytest.approx((70.0, 100.0, 4.0))
    assert min(r["winddir"], 360 - r["winddir"]) < 1e-6 and 1.9 < r["windspeed"] < 2


def test_write_refuses_to_replace(spark, tmp_path):
    t = dt.datetime(2018, 5, 1)
    df = spark.createDataFrame([(1, 1, t, 3.5)], "row int, col int, ts timestamp, temp double")
    meta = climdata.Meta("g", "hour")
    climdata.write(df, meta, str(tmp_path / "x"))
    with pytest.raises(Exception, match="exists"):
        climdata.write(df, meta, str(tmp_path / "x"))
    back, m = climdata.read(spark, str(tmp_path / "x"))
    assert m == meta and back.collect() == df.collect()
    assert climdata.check(df.withColumn("relhum", F.lit(120.0)), ["temp", "relhum", "pres"]) == ["pres: no such column", "relhum: values from 120.0 to 120.0 are outside 0 to 100"]


def test_streaming_fold_equals_batch(spark, sf, tmp_path):
    from cirrusgrid.streaming import fold

    obs = view(spark, sf, "v_obs").select("cell", "ts", "tc")
    obs.repartition(2).write.parquet(str(tmp_path / "in"))
    made = fold.hour_to_day(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")), ["cell"], "ts", {"v": ("tc", "max")})
    query = made.writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = temporal.fold(obs, ["cell"], "ts", {"v": ("tc", "max")})
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, want.collect()))
