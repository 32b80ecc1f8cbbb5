"""Row filters on samples, and series overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TIMESTAMPS = 25


def between(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Inclusive at both ends."""
    return samples.where(F.col("ts_ms").between(start, end))


def filter_by_value(samples: DataFrame, low: float, high: float) -> DataFrame:
    """Inclusive; NaN values go."""
    if low > high:
        raise ValueError("the least value must not be above the greatest")
    return samples.where(~F.isnan("value") & F.col("value").between(low, high))


def filter_by_ts(samples: DataFrame, timestamps: Sequence[int]) -> DataFrame:
    """Exactly these timestamps, MOST_TIMESTAMPS at most."""
    wanted = sorted(set(timestamps))
    if len(wanted) > MOST_TIMESTAMPS:
        raise ValueError(f"at most {MOST_TIMESTAMPS} timestamps")
    return samples.where(F.col("ts_ms").isin(wanted))


def overlapping(series: DataFrame, start: int, end: int) -> DataFrame:
    """series with first_ts and last_ts that have a sample span touching [start, end]."""
    return series.where((F.col("last_ts") >= start) & (F.col("first_ts") <= end))


def last_sample(samples: DataFrame, by: Sequence[str] = ("lk",)) -> DataFrame:
    """The newest sample of each series."""
    last = F.max(F.struct("ts_ms", "value"))
    return samples.groupBy(*by).agg(last.alias("_last")).select(*by, F.col("_last.ts_ms").alias("ts_ms"), F.col("_last.value").alias("value"))
