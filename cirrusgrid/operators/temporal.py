"""Folding hours to days, expanding days to hours, and filling time axes.

Windows are partitioned by cell (and day), so that every operator scales with the number of cells; expansions
are array functions that explode inside a stage. ``cell`` is any list of key columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics

FOLDS: dict[str, Callable] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def fold(df: DataFrame, cell: Sequence[str], ts: str, folds: dict[str, tuple[str, str]], strict: bool = False) -> DataFrame:
    """Values by cell and date: {new column: (column, mean|sum|min|max)}. strict gives null for a day with a null in it."""
    def one(col: str, how: str) -> Column:
        value = FOLDS[how](col)
        return F.when(F.count(col) == F.count(F.lit(1)), value) if strict else value

    return df.groupBy(*cell, F.to_date(ts).alias("d")).agg(*(one(*spec).alias(name) for name, spec in folds.items()))


def fold_positions(df: DataFrame, cell: Sequence[str], ts: str, value: str, how: str = "mean", step: int = 24) -> DataFrame:
    """Folds runs of step rows in time order, whatever their dates: (cell, block from 0, value)."""
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(ts)) - 1
    return df.withColumn("block", F.floor(at / step)).groupBy(*cell, "block").agg(FOLDS[how](value).alias(value))


def hours(df: DataFrame, day: str = "d") -> DataFrame:
    """Every row 24 times, with the column h from 0 to 23."""
    return df.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))


def with_neighbours(df: DataFrame, cell: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Values of the days before and after as _p_ and _n_ columns; the first and last day are their own."""
    w = Window.partitionBy(*cell).orderBy(day)
    near = {}
    for v in values:
        near |= {f"_p_{v}": F.coalesce(F.lag(v).over(w), F.col(v)), f"_n_{v}": F.coalesce(F.lead(v).over(w), F.col(v))}
    return df.withColumns(near)


def between_neighbours(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Of hours h of days with neighbours: values on the line between the two days' values, which stand at hour 11."""
    h = F.col("h")
    line = lambda v: F.when(h >= 11, F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * (h - 11) / 24).otherwise(F.col(f"_p_{v}") + (F.col(v) - F.col(f"_p_{v}")) * (h + 13) / 24)
    return df.withColumns({v: line(v) for v in values}).drop(*(f"_{e}_{v}" for v in values for e in "pn"))


def day_to_hour(df: DataFrame, cell: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Daily values interpolated to hours, a day's value at hour 11, held constant before the first and after the last."""
    return between_neighbours(hours(with_neighbours(df, cell, day, values)), values)


def adjust_to_daily(df: DataFrame, cell: Sequence[str], day: str, value: Column, daily: Column) -> Column:
    """value scaled so that its mean over the day is daily; unscaled where that mean is 0 or null."""
    mean = F.avg(value).over(Window.partitionBy(*cell, day))
    return value * F.coalesce(F.try_divide(daily, mean), F.lit(1.0))


def fill_days(df: DataFrame, cell: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Every day from a cell's first to its last; missing values by linear interpolation in time."""
    span = df.groupBy(*cell).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    every = span.select(*cell, F.explode(F.sequence("_a", "_b")).alias(day))
    return interpolate(every.join(df, [*cell, day], "left"), cell, day, values)


def interpolate(df: DataFrame, cell: Sequence[str], day: str, values: Sequence[str], edges: bool = False) -> DataFrame:
    """Nulls between known values by linear interpolation; with edges those outside take the nearest one."""
    back = Window.partitionBy(*cell).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*cell).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    out = df
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.col(day))
        before, after = F.last(v, True).over(back), F.first(v, True).over(ahead)
        t0, t1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
        line = before + (after - before) * F.datediff(F.col(day), t0) / F.datediff(t1, t0)
        outside = F.coalesce(before, after) if edges else F.lit(None)
        out = out.withColumn(f"_{v}", F.when(F.col(v).isNotNull(), F.col(v)).when(before.isNotNull() & after.isNotNull(), line).otherwise(outside))
    return out.withColumns({v: F.col(f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))


def moving_average(df: DataFrame, cell: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """Mean of a row and the width - 1 before it, wrapping to the series' end; null if any of them is."""
    w = Window.partitionBy(*cell).orderBy(order)
    count = F.count(F.lit(1)).over(Window.partitionBy(*cell))
    numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", count)
    tail = numbered.where(F.col("_i") > F.col("_n") - (width - 1)).withColumn("_i", F.col("_i") - F.col("_n")).withColumn("_tail", F.lit(True))
    both = numbered.withColumn("_tail", F.lit(False)).unionByName(tail)
    run = Window.partitionBy(*cell).orderBy("_i").rowsBetween(-(width - 1), 0)
    mean = F.when(F.count(value).over(run) == width, F.avg(value).over(run))
    return both.withColumn("moving", mean).where(~F.col("_tail")).drop("_i", "_n", "_tail")


def variability(df: DataFrame, cell: Sequence[str], order: str, value: str) -> DataFrame:
    """Root of half the squared differences from both neighbours; an edge is its own neighbour."""
    w = Window.partitionBy(*cell).orderBy(order)
    v = F.col(value)
    a, b = v - F.coalesce(F.lag(v).over(w), v), v - F.coalesce(F.lead(v).over(w), v)
    return df.withColumn("variability", F.sqrt((a * a + b * b) / 2))


def spells(df: DataFrame, cell: Sequence[str], day: str, wet: Column) -> DataFrame:
    """Runs of consecutive rows for which wet holds: (cell, start, end, days)."""
    w, own = Window.partitionBy(*cell).orderBy(day), Window.partitionBy(*cell, "_wet").orderBy(day)
    marked = df.withColumn("_wet", F.coalesce(wet, F.lit(False))).withColumn("_g", F.row_number().over(w) - F.row_number().over(own))
    return marked.where("_wet").groupBy(*cell, "_g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("days")).drop("_g")


def hourly_temperature(df: DataFrame, cell: Sequence[str], day: str, lat: Column, lon: Column, srte: float = 0.09) -> DataFrame:
    """Hourly temperature from tmin and tmax: sine by day, exponential decay by night, scaled to meet both.

    Expects columns tmin and tmax (°C); adds h and temp. Polar days and nights follow a sine over 28 and 24 hours.
    """
    import math

    from ..functions import solar

    w = Window.partitionBy(*cell).orderBy(day)
    tmin = F.col("tmin")
    out = df.withColumns({
        "_x": F.when(F.col("tmax") == tmin, F.col("tmax") + 0.01).otherwise(F.col("tmax")),
        "_after": F.coalesce(F.lead(tmin).over(w), tmin), "_before": F.coalesce(F.lag(tmin).over(w), tmin),
        "_jd": solar.julian_day(F.col(day)),
    })
    out = out.withColumn("_dl", solar.day_length(F.col("_jd"), lat)).withColumn("_stt", solar.solar_time(F.lit(0.0), lon, F.col("_jd")))
    dl, stt = F.col("_dl"), F.col("_stt")
    rises = stt + 12 - 0.5 * dl > 0
    out = out.withColumns({"_lo": F.when(rises, tmin).otherwise(F.col("_before")), "_next": F.when(rises, F.col("_after")).otherwise(tmin)})
    lo, nxt, x = F.col("_lo"), F.col("_next"), F.col("_x")
    gap = physics.clamp(0.04187957 * ((x - lo) * (1 - dl / 24)) + 0.4372056, 0.01, 0.99)
    out = hours(out.withColumn("_g", gap))
    h, g = F.col("h"), F.col("_g")
    st = physics.floor_mod(h + stt - (12 - 0.5 * dl), 24.0)
    k = -(24 - dl) / F.ln(srte / g)
    rho = dl + 2 * (-0.5 * dl * (math.pi / (F.asin(g) - math.pi) + 1))
    shape = F.when(st > dl, g * F.exp(-(st - dl) / k)).otherwise(F.sin(math.pi * st / rho))
    usual = (x - lo) * shape + lo + F.when(h + stt > dl, (nxt - lo) * (st - dl) / (24 - dl)).otherwise(0.0)
    s24 = physics.floor_mod(h + stt, 24.0)
    polar_day = (x - lo) * F.sin(math.pi * st / 28) + lo + (nxt - lo) * st / 24
    polar_night = (x - lo) * F.sin(math.pi * s24 / 24) + lo + (nxt - lo) * s24 / 24
    out = out.withColumn("_t", F.when(dl >= 24, polar_day).when(dl <= 0, polar_night).otherwise(usual))
    per_day = Window.partitionBy(*cell, day)
    least, most = F.min("_t").over(per_day), F.max("_t").over(per_day)
    # One linear map a day sends the curve's range to [tmin, tmax].
    temp = tmin + (F.col("_t") - least) * F.try_divide(x - tmin, most - least)
    return out.withColumn("temp", temp).drop("_x", "_after", "_before", "_jd", "_dl", "_stt", "_lo", "_next", "_g", "_t")


def blend_temperature(hourly: DataFrame, daily: DataFrame, cell: Sequence[str], day: str, value: str) -> DataFrame:
    """Hourly values stretched so that each day meets the daily table's tmin and tmax."""
    w = Window.partitionBy(*cell, day)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    shape = F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))
    return hourly.withColumn("_s", shape).join(daily.select(*cell, day, "tmin", "tmax"), [*cell, day]).withColumn("blended", F.col("_s") * (F.col("tmax") - F.col("tmin")) + F.col("tmin")).drop("_s")


def at_times(df: DataFrame, cell: Sequence[str], ts: str, value: str, times: DataFrame) -> DataFrame:
    """A series interpolated linearly to any other times, a table of one column named ts: (cell, ts, value).

    Times outside a cell's series are null; a series of one value is constant. times are as few as the steps of a series.
    """
    known = df.select(*cell, F.col(ts).alias("_t"), F.col(value).alias("_v")).where("_v is not null")
    asked = known.select(*cell).distinct().crossJoin(F.broadcast(times.select(F.col(ts).alias("_t")))).withColumn("_ask", F.lit(True))
    axis = known.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_v", F.lit(None).cast("double")))
    back = Window.partitionBy(*cell).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*cell).orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    at = F.when(F.col("_v").isNotNull(), F.col("_t"))
    sec = lambda c: F.unix_micros(F.to_timestamp(c)) / 1e6
    axis = axis.withColumns({"_t0": F.max(at).over(back), "_t1": F.min(at).over(ahead), "_n": F.count("_v").over(Window.partitionBy(*cell)), "_one": F.max("_v").over(Window.partitionBy(*cell))})
    axis = axis.withColumns({"_v0": F.max_by("_v", at).over(back), "_v1": F.min_by("_v", at).over(ahead)})
    share = F.coalesce(F.try_divide(sec(F.col("_t")) - sec(F.col("_t0")), sec(F.col("_t1")) - sec(F.col("_t0"))), F.lit(0.0))
    line = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_t0").isNotNull() & F.col("_t1").isNotNull(), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    return axis.where("_ask").select(*cell, F.col("_t").alias(ts), line.alias(value))


def first_run(df: DataFrame, cell: Sequence[str], day: str, wet: Column, n: int) -> DataFrame:
    """(cell, start): where the first run of exactly n consecutive rows for which wet holds begins; null where there is none."""
    found = spells(df, cell, day, wet).where(F.col("days") == n).groupBy(*cell).agg(F.min("start").alias("start"))
    return df.select(*cell).distinct().join(found, list(cell), "left")


def blend_steps(df: DataFrame, cell: Sequence[str], order: str, value: str, steps: int) -> DataFrame:
    """Each value blended into the next one in so many steps: (1 - j / steps) of itself and j / steps of the next, column j from 0; the last has no next and is left out."""
    w = Window.partitionBy(*cell).orderBy(order)
    near = df.withColumn("_next", F.lead(value).over(w)).where(F.col("_next").isNotNull()).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    share = F.col("j") / steps
    return near.withColumn("blended", (1 - share) * F.col(value) + share * F.col("_next")).drop("_next")


def layers_at_quantiles(df: DataFrame, ts: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(share, ts, mean): the layer whose mean over all cells is nearest to each quantile of the layers' means; ties take the earliest."""
    layers = df.groupBy(ts).agg(F.avg(value).alias("mean"))
    marks = layers.agg(F.percentile("mean", F.array(*map(F.lit, shares))).alias("q")).select(F.posexplode("q").alias("i", "q"))
    marks = marks.withColumn("share", F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.col("i") + 1))
    near = layers.crossJoin(F.broadcast(marks)).groupBy("share").agg(F.min(F.struct(F.abs(F.col("mean") - F.col("q")).alias("gap"), F.col(ts).alias("ts"), F.col("mean").alias("mean"))).alias("x"))
    return near.select("share", F.col("x.ts").alias(ts), F.col("x.mean").alias("mean"))
