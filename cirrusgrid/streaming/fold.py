"""The hourly to daily fold over a stream: tumbling windows of a day, closed by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import FOLDS


def hour_to_day(stream: DataFrame, cell: Sequence[str], ts: str, folds: dict[str, tuple[str, str]], late: str = "1 day") -> DataFrame:
    """As operators.temporal.fold, for a stream; values later than late after the newest are dropped by the watermark."""
    day = F.window(ts, "1 day").alias("_day")
    # A watermark needs a timestamp with a zone; one without is read in the session's.
    made = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(*cell, day).agg(*(FOLDS[how](c).alias(name) for name, (c, how) in folds.items()))
    return made.select(*cell, F.to_date("_day.start").alias("d"), *folds)
