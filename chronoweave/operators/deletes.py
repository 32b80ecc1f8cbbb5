"""Deletes and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_range(samples: DataFrame, of: Column, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(samples that stay, samples deleted) for a predicate on rows and an inclusive range; series stay."""
    if start > end:
        raise ValueError("start must not be after end")
    gone = of & F.col("ts_ms").between(start, end)
    return samples.where(~F.coalesce(gone, F.lit(False))), samples.where(gone)


def delete_series(series: DataFrame, samples: DataFrame, of: Column, key: str = "series_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, samples, deleted series)."""
    gone = series.where(of)
    return series.where(~F.coalesce(of, F.lit(False))), samples.join(gone.select(key), key, "left_anti"), gone


def trim(samples: DataFrame, series: DataFrame, key: str = "series_id") -> DataFrame:
    """Samples older than their series' retention are dropped for good."""
    newest = samples.groupBy(key).agg(F.max("ts_ms").alias("_newest"))
    floors = newest.join(series.select(key, "retention_ms"), key).where(F.col("retention_ms") > 0).select(key, F.greatest(F.col("_newest") - F.col("retention_ms"), F.lit(0)).alias("_floor"))
    return samples.join(floors, key, "left").where(F.col("ts_ms") >= F.coalesce("_floor", F.lit(0))).drop("_floor")
