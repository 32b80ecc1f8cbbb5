"""Metadata: series, cardinality, label names and values, statistics. Input: lk, first_ts, last_ts, n per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ITEM, NAME, PAIR, full_name, key_map, label
from .scan import overlapping
from .selectors import Selector, predicate

TOP = 10


class NoSeries(ValueError):
    """No series matches."""


def matching(series: DataFrame, selectors: Sequence[Selector], start: int | None = None, end: int | None = None) -> DataFrame:
    out = series.where(predicate(selectors, lambda n: label(F.col("lk"), n)))
    return out if start is None or end is None else overlapping(out, start, end)


def require(series: DataFrame) -> DataFrame:
    if series.limit(1).count() == 0:
        raise NoSeries("no series found")
    return series


def limited(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def series_list(series: DataFrame, limit: int | None = None) -> DataFrame:
    return limited(series.select(full_name(F.col("lk")).alias("series"), key_map(F.col("lk")).alias("labels")), limit, "series")


def cardinality(series: DataFrame) -> DataFrame:
    return series.agg(F.count("*").alias("cardinality"))


def pairs(series: DataFrame) -> DataFrame:
    """lk, name, value of each label."""
    items = series.select("lk", F.explode(F.array_remove(F.split("lk", ITEM), "")).alias("_i"))
    return items.select("lk", F.substring_index("_i", PAIR, 1).alias("name"), F.substring_index("_i", PAIR, -1).alias("value"))


def label_names(series: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct names, always with the metric's."""
    names = pairs(series).select("name").union(series.sparkSession.range(1).select(F.lit(NAME).alias("name"))).distinct()
    return limited(names, limit, "name")


def label_values(series: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    got = series.select(label(F.col("lk"), name).alias("value")).where(F.col("value") != "").distinct()
    return limited(got, limit, "value")


def totals(series: DataFrame) -> DataFrame:
    """Numbers of series, of label names, of label pairs."""
    p = pairs(series).agg(F.countDistinct("name").alias("label_names"), F.countDistinct("name", "value").alias("label_pairs"))
    return series.agg(F.count("*").alias("series")).crossJoin(p)  # one row each


def top(df: DataFrame, count: str, limit: int | None, *ties: str) -> DataFrame:
    return df if limit is None else df.orderBy(F.desc(count), *ties).limit(limit)


def series_by_metric(series: DataFrame, limit: int | None = TOP) -> DataFrame:
    got = series.groupBy(label(F.col("lk"), NAME).alias("metric")).agg(F.count("*").alias("n"))
    return top(got, "n", limit, "metric")


def values_by_label(series: DataFrame, limit: int | None = TOP) -> DataFrame:
    # two plain aggregates instead of a distinct count that expands rows
    got = pairs(series).select("name", "value").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return top(got, "n", limit, "name")


def series_by_pair(series: DataFrame, limit: int | None = TOP) -> DataFrame:
    got = pairs(series).groupBy("name", "value").agg(F.count("*").alias("n")).select(F.concat("name", F.lit("="), "value").alias("pair"), "n")
    return top(got, "n", limit, "pair")


def bytes_by_label(series: DataFrame, limit: int | None = TOP) -> DataFrame:
    """Sum over a label's values of their length times one more than their series."""
    per = pairs(series).groupBy("name", "value").agg(F.count("*").alias("k"))
    got = per.groupBy("name").agg(F.sum(F.octet_length("value") * (1 + F.col("k"))).alias("bytes"))
    return top(got, "bytes", limit, "name")


def series_info(series: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per series of ``series`` (with its options): totals, first and last sample. Facts about chunks are
    NULL: Parquet has none."""
    spans = samples.groupBy("series_id").agg(
        F.count("*").alias("total_samples"), F.min("ts_ms").alias("first_timestamp"), F.max("ts_ms").alias("last_timestamp"), F.max_by("value", "ts_ms").alias("last_value")
    )
    none = F.lit(None).cast("bigint")
    return series.join(spans, "series_id", "left").select(
        "key", "metric", "labels", F.coalesce("total_samples", F.lit(0)).alias("total_samples"), "first_timestamp", "last_timestamp", "last_value",
        "retention_ms", "dedupe_ms", "dup_policy", "sig_digits", "chunk_size", none.alias("chunk_count"), none.alias("memory_usage"),
    )
