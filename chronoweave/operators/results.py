"""Results in the shape of the HTTP API: matrix, vector, scalar, and their JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import key_map


def matrix(samples: DataFrame) -> DataFrame:
    """metric (map), values (array of ts_ms, value in order): one row a series. Gathers a series into a row, so it is
    for output only."""
    rows = samples.groupBy("lk").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "value"))).alias("values"))
    return rows.select(key_map(F.col("lk")).alias("metric"), "values")


def vector(samples: DataFrame) -> DataFrame:
    """metric, ts_ms, value: the newest sample of each series."""
    rows = samples.groupBy("lk").agg(F.max(F.struct("ts_ms", "value")).alias("v"))
    return rows.select(key_map(F.col("lk")).alias("metric"), F.col("v.ts_ms").alias("ts_ms"), F.col("v.value").alias("value"))


def text_of_value(v: Column) -> Column:
    """A value as the API writes it: NaN, +Inf, -Inf, whole numbers without a point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return (
        F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf")
        .when(whole, F.when(whole, v).cast("bigint").cast("string")).otherwise(v.cast("string"))
    )


def number_text(v: float) -> str:
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "+Inf" if v > 0 else "-Inf"
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def success(kind: str, result: object) -> dict:
    return {"status": "success", "data": {"resultType": kind, "result": result}}


def array_success(items: Iterable) -> dict:
    return {"status": "success", "data": list(items)}


def error(kind: str, text: str) -> dict:
    return {"status": "error", "errorType": kind, "error": text}


def matrix_json(samples: DataFrame, with_key: dict[str, str] | None = None) -> str:
    """The whole result as one document, through the driver: for results meant to be shown."""
    rows = sorted((sorted(r["metric"].items()), r["values"]) for r in matrix(samples).toLocalIterator())
    return json.dumps(success("matrix", [{"metric": dict(m), "values": [[x["ts_ms"], number_text(x["value"])] for x in v]} for m, v in rows]))


def vector_json(samples: DataFrame) -> str:
    rows = sorted((sorted(r["metric"].items()), r["ts_ms"], r["value"]) for r in vector(samples).toLocalIterator())
    return json.dumps(success("vector", [{"metric": dict(m), "value": [t, number_text(v)]} for m, t, v in rows]))
