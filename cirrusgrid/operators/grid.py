"""Grids: block means, resampling, moving windows, masks, tiles.

A grid is a table of integer row and column; neighbourhoods are made by exploding offsets and joining on the
integer keys, so that they are equi-joins whatever the grid's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Where a grid lies: the borders of its first row and column, and the size of a cell."""

    xmin: float
    ymax: float
    xres: float
    yres: float

    def x(self, col: str) -> Column:
        return self.xmin + (F.col(col) - 0.5) * self.xres

    def y(self, row: str) -> Column:
        return self.ymax - (F.col(row) - 0.5) * self.yres


def block_mean(df: DataFrame, row: str, col: str, value: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """Mean of k x k blocks from the first row and column; blocks at the edges may be smaller, nulls don't count."""
    block = lambda c: (F.floor((F.col(c) - 1) / k) + 1).cast("int").alias(c)
    return df.groupBy(*keep, block(row), block(col)).agg(F.avg(value).alias(value))


def offsets(radius: int) -> Column:
    """Array of struct(dr, dc) of a square window."""
    steps = range(-radius, radius + 1)
    return F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in steps for b in steps))


def neighbours(df: DataFrame, row: str, col: str, value: str, radius: int, keep: Sequence[str] = ()) -> DataFrame:
    """Every cell with those of its window that exist: columns row, col, dr, dc and near. dr is the neighbour's row less the cell's."""
    moved = df.select(*keep, row, col, F.col(value).alias("near"), F.explode(offsets(radius)).alias("o"))
    return moved.select(*keep, (F.col(row) - F.col("o.dr")).alias(row), (F.col(col) - F.col("o.dc")).alias(col), "o.dr", "o.dc", "near")


def focal_mean(df: DataFrame, row: str, col: str, value: str, radius: int, keep: Sequence[str] = ()) -> DataFrame:
    """Mean over each cell's window, nulls left out: a value sent to each cell around it and summed there, so there is one shuffle."""
    sent = neighbours(df.where(F.col(value).isNotNull()), row, col, value, radius, keep)
    means = sent.groupBy(*keep, row, col).agg(F.avg("near").alias("focal"))
    return df.join(means, [*keep, row, col], "left")


def _corners(row: str, col: str, fy: float, fx: float) -> tuple[Column, Column, Column, Column]:
    """The coarse cell up and left of each fine cell's centre, and how far the centre lies beyond it in either direction."""
    y, x = (F.col(row) - 0.5) / fy + 0.5, (F.col(col) - 0.5) / fx + 0.5
    return F.floor(y).cast("int"), F.floor(x).cast("int"), y - F.floor(y), x - F.floor(x)


def placed(fine: DataFrame, row: str, col: str, fy: float, fx: float, side: int = 0) -> DataFrame:
    """fine with the neighbourhood _r, _c that each cell's centre lies in, how far beyond it as _y and _x, and with a side the neighbourhood's tile _tr, _tc."""
    r, c, y, x = _corners(row, col, fy, fx)
    out = fine.select("*", r.alias("_r"), c.alias("_c"), y.alias("_y"), x.alias("_x"))
    return out.withColumns({f"_t{n}": F.floor(F.col(f"_{n}") / side).cast("int") for n in "rc"}) if side else out


def _cubic(d: Column) -> Column:
    """Cubic convolution with a parameter of -1/2, of a distance d."""
    return F.when(d < 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)


def _spline(d: Column) -> Column:
    """The cubic B-spline of a distance d."""
    return F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)


KERNELS = {"bilinear": (lambda d: F.greatest(1 - d, F.lit(0.0)), 0, 1), "cubic": (_cubic, -1, 2), "cubicspline": (_spline, -1, 2)}


#: Bytes of input files for each partition of neighbourhoods, which take some fifty times as much.
PART = 1 << 21


def deal(coarse: DataFrame, row: str, col: str) -> tuple[DataFrame, int, int]:
    """coarse by square tiles _tr, _tc of neighbourhoods, with the number of partitions and the tiles' side.

    A cell goes to each tile that one of the four neighbourhoods it is in lies in, which is one alone for most. Partitions
    grow in number with the input, so that the neighbourhoods of one fit into a task's memory.
    """
    spark, read = coarse.sparkSession, 0
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # what is dealt alike by a part of a join's keys is joined as it lies
    leaves = coarse._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        size = int(leaves.apply(i).stats().sizeInBytes())
        read += size if size < 1 << 60 else 0  # as much stands for an unknown size
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parts, side = max(least, read // PART), 4 if read // PART <= least else 8
    tiles = lambda c: F.explode(F.sequence(*(F.floor((F.col(c) - k) / side).cast("int") for k in (1, 0))))
    return coarse.withColumn("_tr", tiles(row)).withColumn("_tc", tiles(col)).repartition(parts, "_tr", "_tc"), parts, side


def quads(coarse: DataFrame, row: str, col: str, values: Sequence[str], low: int, high: int, keep: Sequence[str] = (), side: int = 0) -> DataFrame:
    """One row for each cell _r, _c that has coarse cells around it, from low to high rows and columns on: their values as v_a_b, and which of them exist as bits of _in.

    The neighbourhoods are made of the coarse table, which is small next to the fine one, so that fine rows are joined once and not shuffled for a sum.
    With a side, coarse is dealt by tiles of it, within which the neighbourhoods are made without another shuffle.
    """
    steps = [(a, b) for a in range(low, high + 1) for b in range(low, high + 1)]
    tile = ["_tr", "_tc"] if side else []
    sent = coarse.select(*keep, *tile, row, col, *values, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))).alias("o"))
    sent = sent.select(*keep, *tile, (F.col(row) - F.col("o.a")).alias("_r"), (F.col(col) - F.col("o.b")).alias("_c"), "o.a", "o.b", *values)
    if side:
        sent = sent.where((F.floor(F.col("_r") / side) == F.col("_tr")) & (F.floor(F.col("_c") / side) == F.col("_tc")))
    at = lambda a, b: (F.col("a") == a) & (F.col("b") == b)
    aggs = [F.max(F.when(at(a, b), F.col(v))).alias(f"{v}_{a}_{b}") for v in values for a, b in steps]
    bit = sum((F.when(at(a, b), 1 << i).otherwise(0) for i, (a, b) in enumerate(steps)), F.lit(0))
    return sent.groupBy(*tile, "_r", "_c", *keep).agg(*aggs, F.bit_or(bit).alias("_in"))


def resample(fine: DataFrame, coarse: DataFrame, row: str, col: str, values: Sequence[str], fy: float, fx: float, keep: Sequence[str] = (), method: str = "bilinear", carry: Sequence[str] = (), place: bool = False, make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Coarse values at the centres of fine cells, by bilinear, cubic, cubicspline or near; weights are shared out anew over the cells that have a value.

    fine is a static grid and fy x fx of its cells make a coarse one; keep names key columns of coarse, such as the time. A fine
    cell without any coarse cell of weight other than 0 is left out. With the bilinear method, carry names further columns of fine
    that come along, so that the many rows of the result need no join for them, and place, with a keep, adds _tr and _tc, by which the result
    is dealt. make adds values to the rows of coarse; with the bilinear method and a keep it does so after they have been dealt out.
    """
    if make and (method != "bilinear" or not keep):
        coarse, make = make(coarse), None
    if method == "near":
        at = fine.select(row, col, (F.floor((F.col(row) - 1) / fy) + 1).cast("int").alias("_r"), (F.floor((F.col(col) - 1) / fx) + 1).cast("int").alias("_c"))
        source = coarse.select(*keep, F.col(row).alias("_r"), F.col(col).alias("_c"), *values)
        return at.join(source, ["_r", "_c"]).select(row, col, *keep, *values)
    if method not in KERNELS:
        raise ValueError(f"method is near or one of {sorted(KERNELS)}")
    kernel, low, high = KERNELS[method]
    if high - low > 1:
        return _summed(placed(fine, row, col, fy, fx), coarse, row, col, values, kernel, range(low, high + 1), keep)
    if keep:
        # A neighbourhood has many more steps than fine cells, so that the fine cells of a partition are few.
        tiled, parts, side = deal(coarse, row, col)
        cells = placed(fine.select(row, col, *carry), row, col, fy, fx, side).repartition(parts, "_tr", "_tc")
        joined = cells.hint("shuffle_hash").join(quads(make(tiled) if make else tiled, row, col, values, low, high, keep, side), ["_tr", "_tc", "_r", "_c"])
    else:
        joined = placed(fine.select(row, col, *carry), row, col, fy, fx).join(quads(coarse, row, col, values, low, high), ["_r", "_c"])
    steps = [(a, b) for a in range(low, high + 1) for b in range(low, high + 1)]
    joined = joined.withColumns({f"_w_{a}_{b}": kernel(F.abs(F.col("_y") - a)) * kernel(F.abs(F.col("_x") - b)) for a, b in steps})

    def mixed(v: str) -> Column:
        there = lambda a, b: F.col(f"{v}_{a}_{b}").isNotNull()
        total = sum((F.when(there(a, b), F.col(f"_w_{a}_{b}") * F.col(f"{v}_{a}_{b}")).otherwise(0.0) for a, b in steps), F.lit(0.0))
        weight = sum((F.when(there(a, b), F.col(f"_w_{a}_{b}")).otherwise(0.0) for a, b in steps), F.lit(0.0))
        return F.when(weight != 0, F.try_divide(total, weight)).alias(v)

    some = F.lit(False)
    for i, (a, b) in enumerate(steps):
        some |= (F.col("_in").bitwiseAND(1 << i) != 0) & (F.col(f"_w_{a}_{b}") != 0)
    return joined.where(some).select(*(("_tr", "_tc") if place else ()), row, col, *keep, *carry, *map(mixed, values))


def _summed(placed: DataFrame, coarse: DataFrame, row: str, col: str, values: Sequence[str], kernel, steps: range, keep: Sequence[str]) -> DataFrame:
    """resample() for kernels of many cells, whose sum as one expression would be too long to compile: a row a cell of the kernel, joined and added up."""
    corner = [F.struct((F.col("_r") + a).alias("r"), (F.col("_c") + b).alias("c"), (kernel(F.abs(F.col("_y") - a)) * kernel(F.abs(F.col("_x") - b))).alias("w")) for a in steps for b in steps]
    at = placed.select(row, col, F.explode(F.array(*corner)).alias("k")).select(row, col, F.col("k.r").alias("_r"), F.col("k.c").alias("_c"), F.col("k.w").alias("_w")).where("_w <> 0")
    source = coarse.select(*keep, F.col(row).alias("_r"), F.col(col).alias("_c"), *(F.col(v).alias(f"_{v}") for v in values))
    weighted = lambda v: F.try_divide(F.sum(F.col("_w") * F.col(f"_{v}")), F.sum(F.when(F.col(f"_{v}").isNotNull(), F.col("_w")))).alias(v)
    return at.join(source, ["_r", "_c"]).groupBy(row, col, *keep).agg(*map(weighted, values))


def crop(df: DataFrame, row: str, col: str, grid: Grid, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """The cells of an extent, which is snapped to the nearest cell borders; a filter on the integer keys that reaches the scan."""
    first, last = (round((grid.ymax - y) / grid.yres) for y in (ymax, ymin))
    left, right = (round((x - grid.xmin) / grid.xres) for x in (xmin, xmax))
    return df.where(F.col(row).between(first + 1, last) & F.col(col).between(left + 1, right))


def lookup(points: DataFrame, df: DataFrame, row: str, col: str, grid: Grid, x: str, y: str, values: Sequence[str]) -> DataFrame:
    """Points with the values of the cells they lie in; null outside the grid."""
    at = {"_r": (F.floor((grid.ymax - F.col(y)) / grid.yres) + 1).cast("int"), "_c": (F.floor((F.col(x) - grid.xmin) / grid.xres) + 1).cast("int")}
    cells = df.select(F.col(row).alias("_r"), F.col(col).alias("_c"), *values)
    return points.withColumns(at).join(cells, ["_r", "_c"], "left").drop("_r", "_c")


def fill_coast(sea: DataFrame, land: DataFrame, row: str, col: str, value: str, radius: int = 4, passes: int = 5) -> DataFrame:
    """Sea cells without a value take the mean of the window around them, in up to so many passes; land cells are null.

    sea has every cell, with nulls; land has those that are land. A pass fills null cells alone, from the values of the pass before.
    """
    water = sea.select(row, col, value).join(land.select(row, col), [row, col], "left_anti")
    now = sea.select(row, col, value)
    for _ in range(passes):
        if water.join(now.where(F.col(value).isNotNull()).select(row, col), [row, col], "left_anti").isEmpty():
            break
        now = focal_mean(now, row, col, value, radius).select(row, col, F.coalesce(value, "focal").alias(value))
    return sea.select(row, col).join(land.select(row, col, F.lit(True).alias("_land")), [row, col], "left").join(now, [row, col]).select(row, col, F.when(F.col("_land").isNull(), F.col(value)).alias(value))


def merge_tiles(tiles: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """One grid of tiles; of several values the first tile's counts that has one."""
    every = _stacked(tiles, keys, value)
    return every.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_tile"))).alias(value))


def mosaic(tiles: Sequence[DataFrame], keys: Sequence[str], value: str, how: str = "mean") -> DataFrame:
    """One grid of tiles; several values are combined by mean, min, max or sum, nulls left out."""
    return _stacked(tiles, keys, value).groupBy(*keys).agg({"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how](value).alias(value))


def _stacked(tiles: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    out = None
    for i, t in enumerate(tiles):
        t = t.select(*keys, F.col(value).cast("double").alias(value), F.lit(i).alias("_tile"))
        out = t if out is None else out.unionByName(t)
    return out


def blend_grid(cells: DataFrame, extents: DataFrame, tile: str, row: str, col: str, value: str, overlap: int) -> DataFrame:
    """One grid of overlapping tiles in rows and columns, weights falling linearly over the overlap towards a tile's inner edges, and in corners both ways.

    extents has the first and last row and column of each tile (r0, r1, c0, c1), and is as small as the number of tiles. At an outer
    edge, where no tile overlaps, a weight falls for all tiles alike and is evened out.
    """
    near = lambda at, lo, hi: F.least(F.lit(1.0), (F.least(F.col(at) - F.col(lo), F.col(hi) - F.col(at)) + 0.5) / overlap)
    placed = cells.join(extents.select(tile, "r0", "r1", "c0", "c1"), tile).where(F.col(value).isNotNull())
    w = near(row, "r0", "r1") * near(col, "c0", "c1")
    return placed.groupBy(row, col).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of extents (id, xmin, xmax, ymin, ymax) that share an area, with it. Only those that lie in one square are compared."""
    p, q = (t.select(*(F.col(c).alias(f"{n}_{c}") for c in ("id", "xmin", "xmax", "ymin", "ymax"))) for n, t in (("a", a), ("b", b)))
    low = lambda c: F.greatest(f"a_{c}", f"b_{c}")
    top = lambda c: F.least(f"a_{c}", f"b_{c}")
    # An extent lies in up to four squares whose side is the power of two next to its size. A pair is met in squares of the larger one's
    # side, in the one that holds the least corner of its area, so an extent is sent to its squares of each side that is in use.
    wide = lambda t, c: F.abs(F.col(f"{t}_{c}max") - F.col(f"{t}_{c}min"))
    level = lambda t: F.greatest(F.lit(-20), F.least(F.lit(62), F.ceil(F.log2(F.greatest(wide(t, "x"), wide(t, "y"), F.lit(2.0**-20)))))).cast("int")
    p, q = p.withColumn("a_level", level("a")), q.withColumn("b_level", level("b"))
    levels = sorted(r[0] for r in p.select("a_level").union(q.select("b_level")).distinct().collect() if r[0] is not None)  # 83 at most
    at = lambda c: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.col(c))) / F.pow(F.lit(2.0), "_level"))
    used = F.array(*map(F.lit, levels)).cast("array<int>")

    def spread(df: DataFrame, t: str) -> DataFrame:
        df = df.withColumn("_level", F.explode(F.filter(used, lambda x: x >= F.col(f"{t}_level"))))
        return df.withColumn("_x", F.explode(F.sequence(at(f"{t}_xmin"), at(f"{t}_xmax")))).withColumn("_y", F.explode(F.sequence(at(f"{t}_ymin"), at(f"{t}_ymax"))))

    once = (F.col("_level") == F.greatest("a_level", "b_level")) & (F.col("_x") == F.greatest(at("a_xmin"), at("b_xmin"))) & (F.col("_y") == F.greatest(at("a_ymin"), at("b_ymin")))
    share = (F.col("a_xmin") < F.col("b_xmax")) & (F.col("b_xmin") < F.col("a_xmax")) & (F.col("a_ymin") < F.col("b_ymax")) & (F.col("b_ymin") < F.col("a_ymax"))
    met = spread(p, "a").join(spread(q, "b"), ["_level", "_x", "_y"]).where(once & share)
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), low("xmin").alias("xmin"), top("xmax").alias("xmax"), low("ymin").alias("ymin"), top("ymax").alias("ymax"))


def renumber(df: DataFrame, label: str, to: str) -> DataFrame:
    """Labels numbered densely from 1 in their order: ranks within ranges of labels, moved on by the number in earlier ranges."""
    ranged = df.select(label).where(F.col(label).isNotNull()).distinct().repartitionByRange(label).withColumn("_part", F.spark_partition_id())
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(label)))
    sizes = ranked.groupBy("_part").count()  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    numbers = ranked.join(F.broadcast(before), "_part").select(label, (F.col("_rank") + F.col("_before")).cast("int").alias(to))
    return df.join(numbers, label, "left")


def fill_gaps(df: DataFrame, row: str, col: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nulls take block means resampled back to their cells, of the first blocks that give one: of 5 x 5 cells, then 10 and 100, then the mean of a layer.

    Blocks of k cells count on layers of k rows or columns and more; on layers of fewer than 5, blocks of 2 x 2 cells do. keep
    names the key columns of a layer, such as the time.
    """
    if df.where(F.col(value).isNull()).isEmpty():
        return df.withColumn("filled", F.col(value))
    layer = df.groupBy(*keep).agg(F.greatest(F.max(row), F.max(col)).alias("_size"), F.avg(value).alias("_all"))
    cells, out = df.select(row, col).distinct(), df
    for k in (2, 5, 10, 100):
        back = resample(cells, block_mean(df, row, col, value, k, keep), row, col, [value], k, k, keep).withColumnRenamed(value, f"_m{k}")
        out = out.join(back, [*keep, row, col], "left")
    out = out.join(layer, list(keep)) if keep else out.crossJoin(F.broadcast(layer))  # one row
    of = lambda k: F.when(F.col("_size") >= k, F.col(f"_m{k}"))
    filled = F.coalesce(value, F.when(F.col("_size") < 5, F.col("_m2")), of(5), of(10), of(100), "_all")
    return out.withColumn("filled", filled).drop("_size", "_all", "_m2", "_m5", "_m10", "_m100")


def mask(df: DataFrame, land: DataFrame, keys: Sequence[str], value: str, where: str, inverse: bool = False) -> DataFrame:
    """Null where the mask's column is null, or with inverse where it isn't."""
    known = F.col(where).isNull() if inverse else F.col(where).isNotNull()
    return df.join(land.select(*keys, where), list(keys), "left").withColumn(value, F.when(known, F.col(value))).drop(where)


def _starts(low: float, high: float, size: float, overlap: float) -> list[tuple[float, float]]:
    n = math.floor((high - low) / size)
    starts, at = [], low
    while at <= low + size * n - 1:
        starts.append(at)
        at += size - overlap
    ends = [s + size for s in starts]
    rest = high - ends[-1]
    if rest < -0.5 * size:
        starts, ends = starts[:-1], ends[:-1]
    if rest <= 0.5 * size:
        ends[-1] = high
    else:
        starts, ends = [*starts, ends[-1] - overlap], [*ends, high]
    return list(zip(starts, ends))


def tiles(spark, xmin: float, xmax: float, ymin: float, ymax: float, size: float, overlap: float) -> DataFrame:
    """Overlapping tiles of an extent; a rest of up to half a tile joins the last one."""
    cut = [(xa, xb, ya, yb) for xa, xb in _starts(xmin, xmax, size, overlap) for ya, yb in _starts(ymin, ymax, size, overlap)]
    return spark.createDataFrame([(i + 1, *map(float, c)) for i, c in enumerate(cut)], "tile_id int, xmin double, xmax double, ymin double, ymax double")


def blend_pair(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, axis: str) -> DataFrame:
    """Two tables of one grid that overlap along axis, the second further on: in the overlap the weight runs from a to b."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    span = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    w = 1 - F.coalesce(F.try_divide(F.col(axis) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    mixed = F.col("_a") * w + F.col("_b") * (1 - w)
    return both.crossJoin(F.broadcast(span)).select(*keys, F.coalesce(mixed, "_a", "_b").alias(value))  # one row


def flow_direction(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Code 1 to 9, by columns of the 3 x 3 window, of the lowest neighbour; ties take the mean code, rounded half to even."""
    near = neighbours(df, row, col, value, 1).where("near is not null")
    coded = near.withColumn("code", (F.col("dc") + 1) * 3 + F.col("dr") + 2)
    least = coded.groupBy(row, col).agg(F.min("near").alias("_m"), F.collect_list(F.struct("near", "code")).alias("_w"))  # nine at most
    low = F.filter("_w", lambda x: x["near"] == F.col("_m"))
    mean = F.aggregate(low, F.lit(0.0), lambda a, x: a + x["code"]) / F.size(low)
    known = df.where(F.col(value).isNotNull()).select(row, col)
    return least.select(row, col, F.bround(mean).cast("int").alias("flow")).join(known, [row, col], "left_semi")


def horizon(df: DataFrame, row: str, col: str, value: str, azimuth: float, res: float, steps: int = 10) -> DataFrame:
    """Largest tangent of the elevation angle to terrain in one direction, over squared steps; sea and outside are at 0."""
    a = math.radians(azimuth)
    shift = [(math.floor(-math.cos(a) * s * s), math.floor(math.sin(a) * s * s), s * s) for s in range(1, steps + 1)]
    at = F.array(*(F.struct(F.lit(x).alias("dr"), F.lit(y).alias("dc"), F.lit(float(d)).alias("dist")) for x, y, d in shift))
    z = F.coalesce(F.col(value), F.lit(0.0)) / res
    base = df.select(row, col, z.alias("z"))
    sent = base.select((F.col(row)).alias("_r"), F.col(col).alias("_c"), F.col("z").alias("far"))
    asked = base.select(row, col, "z", F.explode(at).alias("o")).select(row, col, "z", "o.dist", (F.col(row) + F.col("o.dr")).alias("_r"), (F.col(col) + F.col("o.dc")).alias("_c"))
    seen = asked.join(sent, ["_r", "_c"], "left")
    slope = (F.coalesce("far", F.lit(0.0)) - F.col("z")) / F.col("dist")
    return seen.groupBy(row, col).agg(F.greatest(F.max(slope), F.lit(0.0)).alias("horizon"))


def direction_smooth(df: DataFrame, cell: Sequence[str], direction: str, value: str, n: int) -> DataFrame:
    """A quarter of either neighbour and half of itself, around the circle of n directions from 0; a missing neighbour gives null."""
    whole = df.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct(direction, value))).alias("_m"))  # n entries a cell
    at = lambda k: F.try_element_at("_m", F.pmod(k, F.lit(n)).cast("int"))
    d = F.col(direction)
    smooth = 0.25 * at(d - 1) + 0.5 * F.col(value) + 0.25 * at(d + 1)
    return df.join(whole, list(cell)).withColumn("smooth", smooth).drop("_m")
