"""Windowed aggregates of streams: the bucketed aggregators over event time, with watermarks for late samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.buckets import aggregator
from .ingest import with_event_time


def _windowed(stream: DataFrame, window: Column, functions: Sequence[str], late: str, by: Sequence[str]) -> DataFrame:
    aggs = [aggregator(f, F.col("value"), F.col("ts_ms")).alias(f.replace(".", "_")) for f in functions]
    got = with_event_time(stream).withWatermark("at", late).groupBy(*by, window.alias("w")).agg(*aggs)
    names = [f.replace(".", "_") for f in functions]
    return got.select(*by, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), *names)


def tumbling(stream: DataFrame, width: str, functions: Sequence[str] = ("avg",), late: str = "10 minutes", by: Sequence[str] = ("series_id",)) -> DataFrame:
    return _windowed(stream, F.window("at", width), functions, late, by)


def sliding(stream: DataFrame, width: str, slide: str, functions: Sequence[str] = ("avg",), late: str = "10 minutes", by: Sequence[str] = ("series_id",)) -> DataFrame:
    return _windowed(stream, F.window("at", width, slide), functions, late, by)


def sessions(stream: DataFrame, gap: str, functions: Sequence[str] = ("count",), late: str = "10 minutes", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """A session ends when its series has been silent for ``gap``."""
    return _windowed(stream, F.session_window("at", gap), functions, late, by)
