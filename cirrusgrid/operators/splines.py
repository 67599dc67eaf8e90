"""Thin-plate splines over position and elevation: fitted from a bounded number of coarse cells, evaluated for any number of fine ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bias

#: Knots a fit takes at most; of more cells, as many of the least hashes of their keys.
KNOTS = 1500


def _radial(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The basis of a thin plate over three coordinates: the distance."""
    return -np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(2), 0))


def _fit(points: np.ndarray, values: np.ndarray, penalty: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale, and coefficients of the radial and the linear part; without a penalty it is chosen by generalised cross-validation."""
    centre, scale = points.mean(0), np.maximum(points.std(0), 1e-12)
    x = (points - centre) / scale
    n = len(x)
    linear = np.column_stack([np.ones(n), x])
    q, _ = np.linalg.qr(linear, mode="complete")
    null = q[:, linear.shape[1] :]
    k = _radial(x, x)
    if not null.shape[1]:
        return centre, scale, np.zeros(n), np.linalg.lstsq(linear, values, rcond=None)[0]
    w, v = np.linalg.eigh(null.T @ k @ null)
    target = v.T @ (null.T @ values)

    def score(lam: float) -> float:
        left = lam * n / (w + lam * n)
        return float(((left * target) ** 2).sum() / n / max(left.sum() / n, 1e-12) ** 2)

    w = np.maximum(w, 1e-10)
    lam = penalty if penalty is not None else min((10.0**e for e in np.arange(-8, 2, 0.5)), key=score)
    c = null @ (v @ (target / (w + lam * n)))
    d = np.linalg.lstsq(linear, values - k @ c - lam * n * c, rcond=None)[0]
    return centre, scale, c, d


def thin_plate(coarse: DataFrame, fine: DataFrame, row: str, col: str, value: str, height: str, fy: float, fx: float, method: str = "normal", penalty: float | None = None, knots: int = KNOTS) -> DataFrame:
    """(row, col, value) for fine cells with a height: a smoothing spline of coarse values over row, column and height.

    method normal, log or logit says in what scale; 0 (and 1) take the least (and greatest) finite value there. Nulls take no part.
    Fewer than five cells give their mean. The fit is dense in the number of knots, which is bounded; predictions run by batch.
    """
    if method not in ("normal", "log", "logit"):
        raise ValueError("method is normal, log or logit")
    known = coarse.where(F.col(value).isNotNull() & F.col(height).isNotNull()).select(row, col, F.col(value).cast("double").alias(value), F.col(height).cast("double").alias(height))
    if method != "normal":
        known = (bias.log_over if method == "log" else bias.logit_over)(known, value).where(F.col(value).isNotNull())
    got = known.orderBy(F.xxhash64(row, col), row, col).limit(knots).toPandas()  # bounded by knots
    points = np.column_stack([(got[row].to_numpy(float) - 0.5) * fy + 0.5, (got[col].to_numpy(float) - 0.5) * fx + 0.5, got[height].to_numpy(float)])
    values = got[value].to_numpy(float)
    model = _fit(points, values, penalty) if len(values) >= 5 else None
    level = float(values.mean()) if len(values) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if model is None:
                out = np.full(len(pdf), np.nan if level is None else level)
            else:
                centre, scale, c, d = model
                x = (pdf[[row, col, height]].to_numpy(float) - centre) / scale
                knots_at = (points - centre) / scale
                out = np.concatenate([np.zeros(0), *(_radial(x[i : i + 2000], knots_at) @ c for i in range(0, len(x), 2000))]) + np.column_stack([np.ones(len(x)), x]) @ d
            out = {"normal": lambda v: v, "log": np.exp, "logit": lambda v: 1 / (1 + np.exp(-v))}[method](out)
            yield pd.DataFrame({row: pdf[row], col: pdf[col], value: out})

    cells = fine.where(F.col(height).isNotNull()).select(row, col, height)
    kinds = dict(fine.dtypes)
    return cells.mapInPandas(run, f"{row} {kinds[row]}, {col} {kinds[col]}, {value} double")
