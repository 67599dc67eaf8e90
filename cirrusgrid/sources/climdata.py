"""Climate tables on disk, and their validation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Meta:
    """What holds for a whole table of facts."""

    grid_id: str
    step: str  # hour or day
    windheight_m: float = 10.0
    tempheight_m: float = 2.0


def write(facts: DataFrame, meta: Meta, path: str, overwrite: bool = False, ts: str = "ts") -> None:
    """Facts as Parquet by year and month, sorted by cell within files so that row groups prune; refuses to replace unless told."""
    parted = facts.withColumns({"year": F.year(ts), "month": F.month(ts)})
    # Ranges of months and cells, so that a month of very many cells is written by many tasks.
    by = ["year", "month", *(c for c in ("row", "col") if c in facts.columns), ts]
    parted = parted.repartitionByRange(*by).sortWithinPartitions(*by)
    mode = "overwrite" if overwrite else "errorifexists"
    parted.write.partitionBy("year", "month").mode(mode).parquet(f"{path}/facts")
    facts.sparkSession.createDataFrame([(json.dumps(asdict(meta)),)], "meta string").coalesce(1).write.mode(mode).json(f"{path}/meta")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Meta]:
    meta = Meta(**json.loads(spark.read.json(f"{path}/meta").first()["meta"]))
    return spark.read.parquet(f"{path}/facts").drop("year", "month"), meta


def write_scaled(df: DataFrame, path: str, values: dict[str, str], factor: int = 100) -> None:
    """Values, given with their units, as integers, times factor and cut towards zero; the unit is kept with the column."""
    scaled = [(F.col(v) * factor).cast("int").alias(v, metadata={"unit": f"{unit} * {factor}", "factor": factor}) for v, unit in values.items()]
    df.select(*(c for c in df.columns if c not in values), *scaled).write.parquet(path)


def read_scaled(spark: SparkSession, path: str) -> DataFrame:
    """What write_scaled wrote, as doubles in the columns' units."""
    df = spark.read.parquet(path)
    by = {f.name: f.metadata.get("factor") for f in df.schema.fields}
    return df.select(*((F.col(c) / by[c]).alias(c, metadata={"unit": df.schema[c].metadata["unit"].rsplit(" * ", 1)[0]}) if by[c] else F.col(c) for c in df.columns))


def write_parcels(cells: DataFrame, weights: DataFrame, path: str, parcel: str, ts: str, values: dict[str, int], mode: str = "errorifexists") -> None:
    """One CSV folder a parcel with the means that parcel_means gives."""
    parcel_means(cells, weights, parcel, ts, values).repartition(parcel).sortWithinPartitions(parcel, ts).write.partitionBy(parcel).mode(mode).option("header", True).csv(path)


def parcel_means(cells: DataFrame, weights: DataFrame, parcel: str, ts: str, values: dict[str, int]) -> DataFrame:
    """(parcel, ts, values): means over a parcel's cells by the weights (parcel, row, col, weight), rounded to so many digits; nulls don't count."""
    keys = [c for c in weights.columns if c not in (parcel, "weight")]
    w = F.col("weight")
    mean = lambda v: F.try_divide(F.sum(w * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), w)))
    return cells.join(weights, keys).groupBy(parcel, ts).agg(*(F.round(mean(v), n).alias(v) for v, n in values.items()))


def summary(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(variable, missing, least, mean, most), all variables in one pass."""
    one = df.agg(*(F.struct(F.count_if(F.col(v).isNull()).alias("missing"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most")).alias(v) for v in values))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("s")) for v in values)))
    return one.select(rows.alias("r")).select("r.variable", "r.s.missing", *(F.round(f"r.s.{c}", 6).alias(c) for c in ("least", "mean", "most")))


#: Values outside these are reported (fixed values).
TYPICAL = {"temp": (-50, 65), "tmin": (-50, 65), "tmax": (-50, 65), "relhum": (0, 100), "pres": (84, 109), "swrad": (0, 1350), "lwrad": (0, 600), "windspeed": (0, 100), "winddir": (0, 360), "prec": (0, 1500)}


def check(df: DataFrame, values: Sequence[str]) -> list[str]:
    """What is wrong with a table: columns that are missing, nulls, values out of their typical range."""
    found = [f"{v}: no such column" for v in values if v not in df.columns]
    for r in summary(df, [v for v in values if v in df.columns]).collect():  # a row for each variable
        low, high = TYPICAL.get(r["variable"], (float("-inf"), float("inf")))
        if r["missing"]:
            found.append(f"{r['variable']}: {r['missing']} values are missing")
        if r["least"] is not None and (r["least"] < low or r["most"] > high):
            found.append(f"{r['variable']}: values from {r['least']} to {r['most']} are outside {low} to {high}")
    return found


def problems(df: DataFrame, cell: Sequence[str], ts: str, values: Sequence[str], hours: int) -> DataFrame:
    """(check, variable, n): how many rows or cells break a rule, for all rules in two passes over the table.

    Rules: missing and outside the typical range for each variable; humidity over 100 and wind directions outside [0, 360)
    where there are such columns; for times, steps of a cell other than hours long, and cells whose steps don't fill whole days.
    """
    low = lambda v: F.lit(float(TYPICAL[v][0]))
    top = lambda v: F.lit(float(TYPICAL[v][1]))
    rules = [("missing", v, F.col(v).isNull()) for v in values]
    rules += [("range", v, (F.col(v) < low(v)) | (F.col(v) > top(v))) for v in values if v in TYPICAL]
    rules += [("saturated", "relhum", F.col("relhum") > 100)] if "relhum" in values else []
    rules += [("direction", "winddir", (F.col("winddir") < 0) | (F.col("winddir") >= 360))] if "winddir" in values else []
    counts = _as_rows(df.agg(*(F.count_if(F.coalesce(r, F.lit(False))).alias(f"c{i}") for i, (_, _, r) in enumerate(rules))), [(c, v) for c, v, _ in rules])
    w = Window.partitionBy(*cell).orderBy(ts)
    gap = (F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(w).cast("timestamp"))) / 3600
    steps = df.select(*cell, ts, gap.alias("_gap")).groupBy(*cell).agg(F.count_if(F.col("_gap") != hours).alias("_odd"), F.count(F.lit(1)).alias("_n"))
    axis = steps.agg(F.coalesce(F.sum("_odd"), F.lit(0)).alias("c0"), F.count_if(F.col("_n") * hours % 24 != 0).alias("c1"))
    return counts.unionByName(_as_rows(axis, [("step", ts), ("whole days", ts)]))


def _as_rows(one: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(v).alias("variable"), F.col(f"c{i}").cast("long").alias("n")) for i, (c, v) in enumerate(names))))
    return one.select(rows.alias("r")).select("r.*")
