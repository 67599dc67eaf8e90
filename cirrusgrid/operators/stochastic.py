"""Seeded simulation: patches of rain or cloud, and rain within days."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from . import bias, grid, temporal


def noise(keys: Sequence[Column], seed: int) -> Column:
    """A standard normal number for every distinct combination of keys, the same in every run."""
    even = lambda k: (F.xxhash64(*keys, F.lit(seed), F.lit(k)).cast("double") / 2.0**64 + 0.5)
    return F.sqrt(-2 * F.ln(F.greatest(even(1), F.lit(1e-300)))) * F.cos(2 * math.pi * even(2))


def patches(df: DataFrame, row: str, col: str, step: str, value: str, factor: int, kind: str = "precip", seed: int = 1) -> DataFrame:
    """value with patchy anomalies of every step, correlated over half a coarse cell, which factor fine cells make.

    Rain varies in logarithms and clear-sky shares in logits; an anomaly has mean 0 over a step's cells and a fixed share, by
    factor, of the values' own standard deviation. The field is a moving mean of independent normal numbers, which are hashes of
    the cell and step: its covariance falls to 0 at the window's width as a spherical one does.
    """
    if kind not in ("precip", "csfrac"):
        raise ValueError("kind is precip or csfrac")
    share = min(1.0, -0.14934 + 0.1777 * math.log(factor) if kind == "precip" else 0.012950 + 0.175718 * math.log(factor))
    radius = max(1, factor // 4)
    work = df.where(F.col(value).isNotNull()).select(row, col, step, F.col(value).alias("_v"))
    work = work.withColumn("_v", F.ln(F.col("_v") + 1)) if kind == "precip" else bias.logit_over(work, "_v")
    rough = work.select(row, col, step, noise([F.col(row), F.col(col), F.col(step)], seed).alias("_e"))
    field = grid.focal_mean(rough, row, col, "_e", radius, [step]).select(row, col, step, F.col("focal").alias("_a"))
    both = work.join(field, [row, col, step])
    stats = both.groupBy(step).agg(F.avg("_a").alias("_mean"), F.stddev_samp("_a").alias("_sa"), F.stddev_samp("_v").alias("_sv"))
    moved = F.col("_v") + (F.col("_a") - F.col("_mean")) * F.coalesce(F.try_divide(F.col("_sv") * share, F.col("_sa")), F.lit(0.0))
    back = F.greatest(F.exp(moved) - 1, F.lit(0.0)) if kind == "precip" else physics.inverse_logit(moved)
    return both.join(stats, step).select(row, col, step, back.alias(value))


def _storms(rng: np.random.Generator, par: Sequence[float], hours: int, steps: int) -> np.ndarray:
    """Rain of so many hours in steps an hour of a day by the Bartlett-Lewis rectangular pulse model: storms, whose cells begin while they last, each with a duration and intensity.

    par are the rates a day of storms (lambda), cells (beta) and a storm's end (gamma), of a cell's end (eta), and the mean intensity (mm a day).
    """
    storm, cell, over, end, mean = par
    days = hours / 24
    out = np.zeros(steps)
    width = days / steps
    for start in np.cumsum(rng.exponential(1 / storm, max(4, int(storm * days * 3) + 4))):
        if start >= days:
            break
        last, at = start + rng.exponential(1 / over), start
        while at <= last and at < days:
            stop, depth = min(days, at + rng.exponential(1 / end)), rng.exponential(mean)
            edges = np.arange(steps + 1) * width
            out += depth * np.maximum(0, np.minimum(edges[1:], stop) - np.maximum(edges[:-1], at))
            at += rng.exponential(1 / cell)
    return out


def _event(rng: np.random.Generator, rain: np.ndarray, par: Sequence[float], per_day: int, limit: float, tries: int) -> np.ndarray:
    """Hours of an event of wet days: the first simulated run of exactly as many wet days whose totals are like enough, else the event in two at its driest day, or the likest one found."""
    n, best = len(rain), None
    for _ in range(max(1, tries // 50)):
        days = 50 * n
        sim = _storms(rng, par, 24 * days, per_day * days).reshape(days, per_day)
        wet = np.concatenate([[0], (sim.sum(1) > 0).astype(int), [0]])
        starts, ends = np.flatnonzero(np.diff(wet) == 1), np.flatnonzero(np.diff(wet) == -1)
        for s in starts[ends - starts == n]:
            total = sim[s : s + n].sum(1)
            off = math.sqrt((np.log((rain + 0.1) / (total + 0.1)) ** 2).sum())
            if best is None or off < best[0]:
                best = (off, sim[s : s + n])
        if best is not None and best[0] <= limit:
            return best[1]
    if n > 1:
        cut = int(np.argmin(rain[:-1])) + 1
        return np.concatenate([_event(rng, part, par, per_day, limit, tries) for part in (rain[:cut], rain[cut:])])
    return best[1] if best is not None else np.full((n, per_day), 1.0)


def subdaily_rain(df: DataFrame, cell: Sequence[str], day: str, rain: str, par: Sequence[float], per_day: int = 24, limit: float = 0.2, tries: int = 1000, split: float = 0.2, seed: int = 1) -> DataFrame:
    """(cell, day, h, rain): daily rain in per_day parts. Runs of days over split are events of their own, and so is each day with less.

    Every part of a day adds up to its rain; null is dry. Each event is simulated by itself, seeded by its cell and first day, so
    that one task holds one event at a time.
    """
    df = df.select(*cell, day, F.coalesce(rain, F.lit(0.0)).cast("double").alias(rain))
    spans = temporal.spells(df, cell, day, F.col(rain) > split).select(*cell, F.col("start"), F.col("end"))
    wet = df.join(spans, list(cell)).where(F.col(day).between(F.col("start"), F.col("end")) & (F.col(rain) > split))
    light = df.where((F.col(rain) <= split) & (F.col(rain) > 0)).withColumn("start", F.col(day))
    events = wet.select(*cell, day, rain, "start").unionByName(light.select(*cell, day, rain, "start")).withColumn("_seed", F.abs(F.xxhash64(*cell, "start", F.lit(seed))))
    kinds = dict(df.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in cell)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        r = pdf[rain].to_numpy(float)
        sim = _event(np.random.default_rng(int(pdf["_seed"].iloc[0])), r, par, per_day, limit, tries)
        sim = sim * (r / np.maximum(sim.sum(1), 1e-300))[:, None]
        out = pdf.loc[pdf.index.repeat(per_day), [*cell, day]].reset_index(drop=True)
        return out.assign(h=np.tile(np.arange(per_day, dtype=np.int32), len(r)), **{rain: sim.ravel()})

    made = events.groupBy(*cell, "start").applyInPandas(run, f"{keys}, {day} {kinds[day]}, h int, {rain} double")
    dry = df.where(F.col(rain) <= 0).select(*cell, day, F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("h"), F.lit(0.0).alias(rain))
    return made.unionByName(dry)
