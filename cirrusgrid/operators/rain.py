"""Rain: rank-based adjustment of wet days and totals, and ratio models of precipitation bias."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid, temporal


def adjust(df: DataFrame, cell: Sequence[str], day: str, rain: str, regional: str, frac: Column, total: Column) -> DataFrame:
    """Rain with a given share of wet days and a given total, per cell.

    Too few wet days: the dry days of least regional rain get the least rain there is. Too many: those of least rain
    become dry. Ties go by date. A cell whose first value is null keeps its values; one without rain stays dry.
    """
    of = Window.partitionBy(*cell)
    r = F.col(rain)
    out = df.withColumns({
        "_n": F.count(F.lit(1)).over(of), "_wet": F.sum(F.when(r > 0, 1).otherwise(0)).over(of), "_least": F.min(F.when(r > 0, r)).over(of),
        "_first": F.first(r).over(of.orderBy(day)),
        "_dry": F.row_number().over(of.orderBy(F.when(r > 0, 1).otherwise(0), F.col(regional), day)),
        "_rank": F.row_number().over(of.orderBy(r, day)),
    }).withColumn("_want", F.floor(frac * F.col("_n") + 0.5))
    more = (F.col("_wet") < F.col("_want")) & ~(r > 0) & (F.col("_dry") <= F.col("_want") - F.col("_wet"))
    fewer = (F.col("_wet") > F.col("_want")) & (F.col("_rank") <= F.col("_n") - F.col("_want"))
    out = out.withColumn("_v", F.when(more, F.coalesce("_least", F.lit(5001.0))).when(fewer, 0.0).otherwise(r))
    scaled = F.col("_v") * F.coalesce(F.try_divide(total, F.sum("_v").over(of)), F.lit(1.0))
    return out.withColumn("adjusted", F.when(F.col("_first").isNull(), r).otherwise(scaled)).drop("_n", "_wet", "_least", "_first", "_dry", "_rank", "_want", "_v")


def numbered_days(days: DataFrame, day: str, regional: str) -> DataFrame:
    """days, a row a day, with the places _at of each by date and _order by regional rain."""
    one = Window.partitionBy(F.lit(0))
    return days.withColumns({"_at": F.row_number().over(one.orderBy(day)), "_order": F.row_number().over(one.orderBy(regional, day))})


def limits(static: DataFrame, known: DataFrame, row: str, col: str, rain: str, fy: float, fx: float) -> DataFrame:
    """(row, col, and what adjusted() reads): how adjust() changes the rain of each cell of static (row, col, _total, _share), without a row for each of its days.

    known has row, col, rain and numbered_days(). The days of one coarse neighbourhood and its cells are in Python at a time; values are made
    there in the order of sums that grid.resample() has, so that they are the same to the last bit.
    """
    tiled, parts, side = grid.deal(known.select(row, col, "_at", "_order", rain), row, col)
    keys = ["_tr", "_tc", "_r", "_c"]
    around = grid.quads(tiled, row, col, [rain], 0, 1, ["_at", "_order"], side)
    cells = grid.placed(static.select(row, col, "_total", "_share"), row, col, fy, fx, side).repartition(parts, "_tr", "_tc")
    kind = dict(static.dtypes)

    def fit(_, cells: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        steps = [(a, b) for a in (0, 1) for b in (0, 1)]
        values = [days[f"{rain}_{a}_{b}"].to_numpy(float) for a, b in steps]
        exists, at, order = days["_in"].to_numpy(), days["_at"].to_numpy(), days["_order"].to_numpy()
        out = []
        ys, xs = cells["_y"].to_numpy(float), cells["_x"].to_numpy(float)
        totals, shares = cells["_total"].to_numpy(float), cells["_share"].to_numpy(float)
        for i in range(len(cells)):
            total = weight = np.zeros(len(days))
            there = np.zeros(len(days), bool)
            for k, (a, b) in enumerate(steps):
                w = max(1 - abs(ys[i] - a), 0.0) * max(1 - abs(xs[i] - b), 0.0)
                missing = np.isnan(values[k])
                total, weight = total + np.where(missing, 0.0, w * values[k]), weight + np.where(missing, 0.0, w)
                there |= ((exists >> k) & 1 == 1) & (w != 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = np.where(weight != 0, total / weight, np.nan)[there]
            if len(r):
                out.append((i, *_cuts(r, at[there], order[there], shares[i], totals[i])))
        found = pd.DataFrame(out, columns=["i", "_dried", "_dried_at", "_wetted", "_least", "_scale"])
        return pd.concat([cells[[row, col]].iloc[found["i"]].reset_index(drop=True), found.drop(columns="i")], axis=1)

    schema = f"{row} {kind[row]}, {col} {kind[col]}, _dried double, _dried_at int, _wetted int, _least double, _scale double"
    return cells.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInPandas(fit, schema)


def _cuts(r: np.ndarray, at: np.ndarray, order: np.ndarray, share: float, total: float) -> tuple:
    """Of one cell's days: up to which rain and day they become dry, up to which place by regional rain wet and by how much, and what all are multiplied by, NaN for as they are."""
    n, wet = len(r), r > 0
    least = r[wet].min() if wet.any() else 5001.0
    dried, dried_at, wetted, v = -np.inf, 0, 0, r
    want = np.floor(share * n + 0.5)
    if wet.sum() < want and not wet.all():
        dry = np.sort(order[~wet])
        wetted = int(dry[min(int(want - wet.sum()), len(dry)) - 1])
        v = np.where((r <= 0) & (order <= wetted), least, r)
    elif wet.sum() > want and n > want:
        low = np.where(np.isnan(r), -np.inf, r)
        last = np.lexsort((at, low))[int(min(n, n - want)) - 1]
        dried, dried_at = low[last], int(at[last])
        v = np.where((low < dried) | ((low == dried) & (at <= dried_at)), 0.0, r)
    whole = np.nansum(v)
    scale = total / whole if whole != 0 and not np.isnan(total) else 1.0
    return dried, dried_at, wetted, least, np.nan if np.isnan(r[at.argmin()]) else scale


def adjusted(rain: str) -> Column:
    """Rain as adjust() changes it, of rows that have limits() of their cell and _at and _order of their day."""
    r = F.col(rain)
    low = F.coalesce(r, F.lit(-math.inf))
    more = ~(r > 0) & (F.col("_order") <= F.col("_wetted"))
    fewer = (low < F.col("_dried")) | ((low == F.col("_dried")) & (F.col("_at") <= F.col("_dried_at")))
    value = F.when(more, F.col("_least")).when(fewer, 0.0).otherwise(r)
    return F.when(F.col("_scale").isNull() | F.isnan("_scale"), r).otherwise(value * F.col("_scale"))


def fit_ratio(obs: DataFrame, mod: DataFrame, cell: Sequence[str], rain: str, threshold: float = 0.01) -> DataFrame:
    """(cell, mu_tot, mu_frac): ratios of observed to modelled totals and wet-day shares. Days below the threshold count as their own amount."""
    def stats(df: DataFrame, tag: str) -> DataFrame:
        wet = F.avg(F.when(F.col(rain) >= threshold, 1.0).otherwise(F.col(rain)))
        return df.groupBy(*cell).agg(F.sum(rain).alias(f"_t{tag}"), wet.alias(f"_f{tag}"))

    both = stats(obs, "o").join(stats(mod, "m"), list(cell))
    return both.select(*cell, F.try_divide("_to", "_tm").alias("mu_tot"), F.try_divide("_fo", "_fm").alias("mu_frac"))


def apply_ratio(df: DataFrame, model: DataFrame, cell: Sequence[str], day: str, rain: str) -> DataFrame:
    """Rain adjusted to the modelled total times mu_tot and wet share times mu_frac, 1 at most."""
    of = Window.partitionBy(*cell)
    out = with_regional(df, day, rain, "_region").join(model, list(cell))
    out = out.withColumns({"_total": F.sum(rain).over(of) * F.col("mu_tot"), "_frac": F.least(F.lit(1.0), F.avg(F.when(F.col(rain) > 0, 1.0).otherwise(0.0)).over(of) * F.col("mu_frac"))})
    return adjust(out, cell, day, rain, "_region", F.col("_frac"), F.col("_total")).drop("_region", "_total", "_frac", "mu_tot", "mu_frac")


def to_total(df: DataFrame, keys: Sequence[str], rain: str, total: Column) -> DataFrame:
    """df with scaled: rain in proportion, such that each group of keys adds up to total; a group without rain keeps its zeros."""
    return df.withColumn("scaled", F.col(rain) * F.coalesce(F.try_divide(total, F.sum(rain).over(Window.partitionBy(*keys))), F.lit(1.0)))


def with_regional(df: DataFrame, day: str, rain: str, to: str) -> DataFrame:
    """df with the sum of rain over all cells of a day: summed before the shuffle and joined back, so that no task holds a day."""
    return df.join(df.groupBy(day).agg(F.sum(rain).alias(to)), day)


def regional_ranks(df: DataFrame, day: str, rain: str, width: int = 10, least: float = 0.1) -> DataFrame:
    """(day, regional): a day's rain over all cells; without any, the mean of width days up to it, wrapping round, or else least."""
    days = df.groupBy(day).agg(F.coalesce(F.sum(rain), F.lit(0.0)).alias("_sum")).withColumn("_one", F.lit(0))
    mean = temporal.moving_average(days, ["_one"], day, "_sum", width)  # a row a day
    full = F.when(F.col("_sum") != 0, F.col("_sum")).when(F.col("moving") > 0, F.col("moving")).otherwise(least)
    return mean.select(day, full.alias("regional"))


def downscale(coarse: DataFrame, coarse_dtm: DataFrame, fine_dtm: DataFrame, row: str, col: str, day: str, rain: str, fy: float, fx: float, dry: float = 0.0) -> DataFrame:
    """(row, col, day, rain) on a fine grid: resampled, then adjusted so that totals and wet shares follow the height above the coarse terrain.

    Nulls take the mean of blocks, then the median of their day. Days of dry and more count as wet. Coarse cells without elevation are at 0.
    """
    known = grid.fill_gaps(coarse.select(row, col, day, rain), row, col, rain, [day]).select(row, col, day, F.col("filled").alias(rain))
    land = fine_dtm.where("elev is not null").select(row, col, "elev")
    static = targets(known, coarse_dtm, land, row, col, rain, fy, fx, dry)
    ranked = known.join(F.broadcast(regional_ranks(known, day, rain)), day)  # a row a step
    # Rows of a fine cell lie together by the place of its coarse neighbourhood, so that the windows need no shuffle.
    daily = grid.resample(static, ranked, row, col, [rain], fy, fx, [day, "regional"], carry=["_total", "_share"], place=True)
    out = adjust(daily, ["_tr", "_tc", row, col], day, rain, "regional", F.col("_share"), F.col("_total"))
    return out.select(row, col, day, F.col("adjusted").alias(rain))


def targets(known: DataFrame, coarse_dtm: DataFrame, land: DataFrame, row: str, col: str, rain: str, fy: float, fx: float, dry: float) -> DataFrame:
    """(row, col, _total, _share): the total and the share of wet days that the cells of land (row, col, elev) are to have."""
    cells = known.groupBy(row, col).agg(F.sum(rain).alias("_total"), F.avg((F.col(rain) >= dry).cast("double")).alias("_share"))
    cells = cells.join(coarse_dtm.select(row, col, F.coalesce("elev", F.lit(0.0)).alias("_zc")), [row, col])
    static = grid.resample(land, cells, row, col, ["_total", "_share", "_zc"], fy, fx, carry=["elev"])
    total, share = elevation_factors(F.col("elev"), F.col("_zc"))
    return static.select(row, col, (F.col("_total") * total).alias("_total"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_share") * share)).alias("_share"))


def elevation_factors(zf: Column, zc: Column) -> tuple[Column, Column]:
    """Multipliers of rain total and wet share for the height of a fine cell above its coarse surroundings."""
    d = zf - zc
    total = F.exp(9.039606e-3 + 1.818067e-3 * d - 2.923351e-4 * zf - 6.471352e-7 * zf * d)
    share = F.exp(-2.787208e-3 - 2.787208e-3 * d - 2.787208e-3 * zf - 4.503742e-7 * zf * d)
    return total, share
