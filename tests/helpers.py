"""Hand-made series for tests."""

from pyspark.sql import functions as F

from chronoweave.model import labels_key
from chronoweave.sources.tables import TableSource


def source(spark, rows):
    """rows: (labels dict, [(ts_ms, value), ...])."""
    names = sorted({n for labels, _ in rows for n in labels})
    flat = [(*[labels.get(n) for n in names], t, float(v)) for labels, samples in rows for t, v in samples]
    df = spark.createDataFrame(flat, ", ".join(f"`{n}` string" for n in names) + ", ts_ms bigint, value double")
    return TableSource(df, {n: F.col(f"`{n}`") for n in names}, F.col("ts_ms"), F.col("value"))


def points(df):
    """{(labels as text, ts): value}"""
    return {(r["lk"].replace("\x1e", ",").replace("\x1f", "="), r["ts_ms"]): r["value"] for r in df.collect()}


def samples(spark, rows):
    """rows: (labels dict, ts, value) as (lk, ts_ms, value)."""
    return source(spark, [(a, [(t, v)]) for a, t, v in rows]).df.select(
        labels_key({n: F.col(f"`{n}`") for n in sorted({k for a, _, _ in rows for k in a})}).alias("lk"), "ts_ms", "value"
    )
