"""RANGE: bucketed aggregation of samples, with alignment, gap filling and twelve aggregators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import NAN, max_or_nan, min_or_nan
from .scan import between, filter_by_ts, filter_by_value

EMPTY = {"sum": 0.0, "count": 0.0}
AGGREGATORS = ("first", "last", "min", "max", "avg", "sum", "count", "range", "std.p", "std.s", "var.p", "var.s")
#: Aggregators that a user adds: a function of the value and timestamp columns that gives an aggregate.
OWN: dict[str, Callable[[Column, Column], Column]] = {}


def register_aggregator(name: str, make: Callable[[Column, Column], Column], empty: float = NAN) -> None:
    """From now on RANGE knows the aggregator ``name``. empty: the value of a filled-in bucket."""
    name = name.lower()
    if name in AGGREGATORS:
        raise ValueError(f"{name!r} is built in")
    OWN[name] = make
    EMPTY[name] = empty


def aggregator(name: str, value: Column, ts: Column, scale: int | None = None) -> Column:
    """One of AGGREGATORS as an aggregate. scale: the values have so many decimals at most; sums are then exact and
    don't depend on the order of rows, and variances use the two-sum formula on them."""
    name = name.lower()
    if name in OWN:
        return OWN[name](value, ts)
    n = F.count(value)
    if scale is None:
        total, pop, samp = F.sum(value), F.var_pop(value), F.var_samp(value)
    else:
        exact = value.cast(f"decimal(18,{scale})")
        total, squares = F.sum(exact).cast("double"), F.sum(exact * exact).cast("double")
        mean = total / n
        m2 = F.greatest(squares - 2.0 * total * mean + mean * mean * n, F.lit(0.0))
        pop, samp = m2 / n, m2 / F.when(n > 1, n - 1)
    one = lambda c: F.when(n == 1, 0.0).otherwise(c)
    table = {
        "first": lambda: F.min_by(value, ts),
        "last": lambda: F.max_by(value, ts),
        "min": lambda: min_or_nan(value),
        "max": lambda: max_or_nan(value),
        "avg": lambda: total / n if scale is not None else F.avg(value),
        "sum": lambda: total,
        "count": lambda: n.cast("double"),
        "range": lambda: F.max(value) - F.min(value),
        "std.p": lambda: F.sqrt(pop),
        "std.s": lambda: one(F.sqrt(samp)),
        "var.p": lambda: pop,
        "var.s": lambda: one(samp),
    }
    if name not in table:
        raise ValueError(f"unknown aggregator {name!r}")
    return table[name]()


def bucket_start(ts: Column, width: int, align: int = 0) -> Column:
    """The start of the bucket, never negative."""
    return F.greatest(ts - F.pmod(ts - F.lit(align).cast("bigint"), F.lit(width).cast("bigint")), F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Aggregation:
    function: str
    width: int
    empty: bool = False
    label: str = "start"  # start (or -), mid, end (or +)

    def __post_init__(self) -> None:
        if self.function.lower() not in (*AGGREGATORS, *OWN):
            raise ValueError(f"unknown aggregator {self.function!r}")
        if self.width <= 0:
            raise ValueError("a bucket must have a positive width")
        if self.label not in ("start", "-", "mid", "~", "end", "+"):
            raise ValueError(f"unknown bucket timestamp {self.label!r}")

    @property
    def shift(self) -> int:
        return {"start": 0, "-": 0, "mid": self.width // 2, "~": self.width // 2}.get(self.label, self.width)


def range_query(
    samples: DataFrame,
    start: int,
    end: int,
    *,
    align: int | str = 0,
    by_value: tuple[float, float] | None = None,
    by_ts: Sequence[int] | None = None,
    aggregation: Aggregation | None = None,
    count: int | None = None,
    retention_ms: int | None = None,
    by: Sequence[str] = ("lk",),
    scale: int | None = None,
) -> DataFrame:
    """(by..., ts_ms, value) of every series in ``samples``. Timestamps given by_ts take the place of the range. With
    an aggregation, count limits buckets, filled ones included, else rows; both per series."""
    if start > end:
        raise ValueError("start must not be after end")
    if retention_ms:
        newest = samples.groupBy(*by).agg(F.max("ts_ms").alias("_newest"))
        samples = samples.join(newest, list(by)).where(F.col("ts_ms") >= F.greatest(F.col("_newest") - retention_ms, F.lit(0))).drop("_newest")
    rows = filter_by_ts(samples, by_ts) if by_ts is not None else between(samples, start, end)
    if by_value is not None:
        rows = filter_by_value(rows, *by_value)
    if aggregation is None:
        return first_rows(rows.select(*by, "ts_ms", "value"), count, by)
    at = {"start": start, "-": start, "end": end, "+": end}.get(align, align) if isinstance(align, str) else align
    width = aggregation.width
    out = rows.groupBy(*by, bucket_start(F.col("ts_ms"), width, int(at)).alias("_b")).agg(aggregator(aggregation.function, F.col("value"), F.col("ts_ms"), scale).alias("value"))
    if aggregation.empty:
        out = _filled(out, width, int(at), EMPTY.get(aggregation.function.lower(), NAN), by)
    out = out.select(*by, (F.col("_b") + aggregation.shift).alias("ts_ms"), "value")
    return first_rows(out, count, by)


def _filled(out: DataFrame, width: int, align: int, empty: float, by: Sequence[str]) -> DataFrame:
    """Rows for the empty buckets between two non-empty ones: each bucket makes the gap up to its successor, so no
    dense calendar is joined."""
    following = F.lead("_b").over(Window.partitionBy(*by).orderBy("_b"))
    # a bucket clamped to 0 may be narrower: the next one starts at the first aligned multiple behind it
    after = F.col("_b") + F.lit(width) - F.pmod(F.col("_b") - F.lit(align).cast("bigint"), F.lit(width).cast("bigint"))
    with_next = out.withColumn("_next", following)
    gap = with_next.where(after < F.col("_next")).select(*by, F.explode(F.sequence(after, F.col("_next") - 1, F.lit(width).cast("bigint"))).alias("_b"), F.lit(empty).alias("value"))
    return out.select(*by, "_b", "value").unionByName(gap)


def first_rows(df: DataFrame, count: int | None, by: Sequence[str]) -> DataFrame:
    if count is None:
        return df
    if count < 1:
        raise ValueError("COUNT must be positive")
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("ts_ms")))
    return ranked.where(F.col("_n") <= count).drop("_n")


# ---- partial states: kept in a table, and put together with what comes later
_STATE = ("n", "total", "squares", "low", "high", "first_ts", "first", "last_ts", "last")


def bucket_states(samples: DataFrame, width: int, align: int = 0, by: Sequence[str] = ("lk",)) -> DataFrame:
    """(by..., ts_ms, n, total, squares, low, high, first_ts, first, last_ts, last): of each bucket as much as every one of
    AGGREGATORS needs. States of parts of the data can be stored and merged in any order."""
    v, t = F.col("value"), F.col("ts_ms")
    return samples.groupBy(*by, bucket_start(t, width, align).alias("_b")).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), min_or_nan(v).alias("low"), max_or_nan(v).alias("high"),
        F.min(t).alias("first_ts"), F.min_by(v, t).alias("first"), F.max(t).alias("last_ts"), F.max_by(v, t).alias("last"),
    ).withColumnRenamed("_b", "ts_ms")


def merge_states(states: DataFrame, by: Sequence[str] = ("lk",)) -> DataFrame:
    """One state for each bucket out of several."""
    return states.groupBy(*by, "ts_ms").agg(
        *[F.sum(c).alias(c) for c in _STATE[:3]], min_or_nan(F.col("low")).alias("low"), max_or_nan(F.col("high")).alias("high"),
        F.min("first_ts").alias("first_ts"), F.min_by("first", "first_ts").alias("first"), F.max("last_ts").alias("last_ts"), F.max_by("last", "last_ts").alias("last"),
    )


def from_states(states: DataFrame, function: str) -> DataFrame:
    """The states with a column ``value``, what the aggregator gives for all samples that went into them."""
    n, total = F.col("n"), F.col("total")
    m2 = F.greatest(F.col("squares") - total * total / n, F.lit(0.0))
    one = lambda c: F.when(n == 1, 0.0).otherwise(c)
    table = {
        "first": F.col("first"), "last": F.col("last"), "min": F.col("low"), "max": F.col("high"), "avg": total / n, "sum": total, "count": n.cast("double"), "range": F.col("high") - F.col("low"),
        "std.p": F.sqrt(m2 / n), "std.s": one(F.sqrt(m2 / F.when(n > 1, n - 1))), "var.p": m2 / n, "var.s": one(m2 / F.when(n > 1, n - 1)),
    }
    if function.lower() not in table:
        raise ValueError(f"unknown aggregator {function!r}")
    return states.withColumn("value", table[function.lower()])
