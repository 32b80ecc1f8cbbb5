"""Transforms: functions of each value by itself (POINTWISE), and of whole series on the grid (planner)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import INF, NAN, log

Args = list


def guarded(ok: Callable[[Column], Column], f: Callable[[Column], Column]) -> Callable[[Column, Args], Column]:
    """NaN where the function isn't defined."""
    return lambda v, a: F.when(ok(v) & ~F.isnan(v), f(v)).otherwise(NAN)


def rounded(v: Column, args: Args) -> Column:
    nearest = F.lit(1.0) if not args else args[0]
    return F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.floor(v / nearest + 0.5).cast("double") * nearest)


def whole(f: Callable[[Column], Column]) -> Callable[[Column, Args], Column]:
    """floor and ceil give bigints: infinities and NaN pass by."""
    return lambda v, a: F.when(F.isnan(v) | (F.abs(v) > 9e18), v).otherwise(f(F.when(~F.isnan(v) & (F.abs(v) <= 9e18), v)).cast("double"))


def bits(f: Callable[[Column, Column], Column]) -> Callable[[Column, Args], Column]:
    safe = lambda v: F.when(~F.isnan(v) & (F.abs(v) < 9e18), v).cast("bigint")
    return lambda v, a: f(safe(v), safe(a[0])).cast("double")


def at(v: Column) -> Column:
    """A value in seconds as a timestamp; NULL if it is none."""
    return F.timestamp_millis(F.when(~F.isnan(v) & (F.abs(v) < 2.5e11), v * 1000).cast("bigint"))


def date(f: Callable[[Column], Column]) -> Callable[[Column, Args], Column]:
    return lambda v, a: f(at(v)).cast("double")


def clamp(v: Column, low: Column | None, high: Column | None) -> Column:
    out = v
    if low is not None:
        out = F.when(~F.isnan(out) & (out < low), low).otherwise(out)
    if high is not None:
        out = F.when(~F.isnan(out) & (out > high), high).otherwise(out)
    return out


def simple(f: Callable[[Column], Column]) -> Callable[[Column, Args], Column]:
    return lambda v, a: f(v)


POINTWISE: dict[str, Callable[[Column, Args], Column]] = {
    "abs": simple(F.abs), "ceil": whole(F.ceil), "floor": whole(F.floor), "exp": simple(F.exp), "ln": simple(log),
    "log2": lambda v, a: log(v, 2.0), "log10": lambda v, a: log(v, 10.0), "sqrt": simple(F.sqrt), "sgn": simple(F.signum), "round": rounded,
    "clamp": lambda v, a: clamp(v, a[0], a[1]), "clamp_min": lambda v, a: clamp(v, a[0], None), "clamp_max": lambda v, a: clamp(v, None, a[0]),
    "deg": simple(F.degrees), "rad": simple(F.radians), "sin": simple(F.sin), "cos": simple(F.cos), "tan": simple(F.tan),
    "asin": guarded(lambda v: F.abs(v) <= 1, F.asin), "acos": guarded(lambda v: F.abs(v) <= 1, F.acos), "atan": simple(F.atan),
    "sinh": simple(F.sinh), "cosh": simple(F.cosh), "tanh": simple(F.tanh), "asinh": simple(F.asinh),
    "acosh": guarded(lambda v: v >= 1, F.acosh), "atanh": lambda v, a: F.when(v == 1, INF).when(v == -1, -INF).when(F.abs(v) < 1, F.atanh(v)).otherwise(NAN),
    "bitmap_and": bits(lambda a, b: a.bitwiseAND(b)), "bitmap_or": bits(lambda a, b: a.bitwiseOR(b)), "bitmap_xor": bits(lambda a, b: a.bitwiseXOR(b)),
    "year": date(F.year), "month": date(F.month), "day_of_month": date(F.dayofmonth), "day_of_year": date(F.dayofyear), "hour": date(F.hour), "minute": date(F.minute),
    "day_of_week": date(lambda t: F.dayofweek(t) - 1), "days_in_month": date(lambda t: F.dayofmonth(F.last_day(t))),
}
#: These take the evaluation time if they get no argument.
DATES = frozenset("year month day_of_month day_of_year hour minute day_of_week days_in_month".split())
#: Rounding and clamping leave a value of the metric itself; so do bounds by date.
KEEP_NAME = frozenset("ceil floor round clamp clamp_min clamp_max".split())
CONSTANTS = {"pi": math.pi}

#: One number for a whole series, then joined back: name -> aggregate of (v, g, number).
SERIES_STATS: dict[str, Callable[[Column, Column, list[float]], Column]] = {
    "range_sum": lambda v, g, a: F.sum(v), "range_avg": lambda v, g, a: F.avg(v), "range_min": lambda v, g, a: F.min(v), "range_max": lambda v, g, a: F.max(v),
    "range_first": lambda v, g, a: F.min_by(v, g), "range_last": lambda v, g, a: F.max_by(v, g), "range_median": lambda v, g, a: F.percentile(v, 0.5),
    "range_quantile": lambda v, g, a: F.percentile(v, a[0]), "range_stddev": lambda v, g, a: F.stddev_pop(v), "range_stdvar": lambda v, g, a: F.var_pop(v),
}
