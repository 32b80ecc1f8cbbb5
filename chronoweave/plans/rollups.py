"""Rollups: functions of one series' samples in the window (g - d, g] before each grid point g.

Samples are fanned out to the grid points whose windows hold them (at most ceil(d / step) each, worked out by
arithmetic, so there is no range join) and reduced by one hash aggregate per (series, g). Functions of steps between
samples take the previous sample from a lag over the series first. ``increase``-like functions also count the step
into the window, if the sample before it is not older than max(d, lookback) before the window's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import INF, NAN, divide, equal, less, log, max_or_nan, min_or_nan


@dataclass
class W:
    """Columns of a fanned-out row, and the call's numbers."""

    v: Column
    t: Column  # ms
    g: Column  # the point the window ends at, ms, moved by the offset
    d: int
    args: list[float]
    texts: list[str]
    pv: Column | None = None
    pt: Column | None = None
    reach: int = 0  # how far before the window the previous sample may lie

    @property
    def sec(self) -> Column:
        return (self.t - self.g) / 1000.0

    @property
    def ok(self) -> Column:
        """The previous sample counts."""
        return self.pt > self.g - (self.d + self.reach)

    @property
    def inside(self) -> Column:
        return self.pt > self.g - self.d

    @property
    def dv(self) -> Column:
        return self.v - self.pv

    @property
    def inc(self) -> Column:
        """The increase of a counter: after a reset the whole value."""
        return F.when(less(self.v, self.pv), self.v).otherwise(self.v - self.pv)

    @property
    def dt(self) -> Column:
        return (self.t - self.pt) / 1000.0

    def when(self, ok: Column, x: Column, other: float | None = 0.0) -> Column:
        return F.when(ok, x).otherwise(F.lit(other)) if other is not None else F.when(ok, x)


def fold(w: W) -> Column:
    """The window's values in order of time."""
    return F.transform(F.array_sort(F.collect_list(F.struct(w.t.alias("t"), w.v.alias("v")))), lambda s: s["v"])


def quantile(v: Column, q: float) -> Column:
    return F.lit(-INF) if q < 0 else F.lit(INF) if q > 1 else F.percentile(v, q)


def deviation(v: Column) -> Column:
    return F.stddev_pop(v)


def mad(values: Column) -> Column:
    """Median absolute deviation of an array."""
    med = sorted_quantile(F.array_sort(values), 0.5)
    return F.element_at(F.transform(F.array(med), lambda m: sorted_quantile(F.array_sort(F.transform(values, lambda x: F.abs(x - m))), 0.5)), 1)


def sorted_quantile(a: Column, q: float) -> Column:
    at = (F.size(a) - 1) * F.lit(q)
    low = F.get(a, F.floor(at).cast("int"))
    high = F.get(a, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def holt_winters(w: W) -> Column:
    sf, tf = w.args
    values = fold(w)
    start = F.struct(F.get(values, F.lit(0)).alias("s"), (F.coalesce(F.get(values, F.lit(1)), F.get(values, F.lit(0))) - F.get(values, F.lit(0))).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        s = F.lit(sf) * x + F.lit(1 - sf) * (acc["s"] + acc["b"])
        return F.struct(s.alias("s"), (F.lit(tf) * (s - acc["s"]) + F.lit(1 - tf) * acc["b"]).alias("b"))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step, lambda a: a["s"])


def exponential(w: W) -> Column:
    sf, values = w.args[0], fold(w)
    return F.aggregate(values, F.get(values, F.lit(0)), lambda a, x: F.lit(sf) * x + F.lit(1 - sf) * a)


def hoeffding(w: W, sign: int) -> Column:
    phi = w.args[0]
    n = F.count(w.v)
    bound = (F.max(w.v) - F.min(w.v)) * F.sqrt(F.ln(F.lit(1 / (1 - phi))) / (2 * n))
    return F.avg(w.v) + sign * bound


def outlier_iqr(w: W) -> Column:
    q1, q3, last = F.percentile(w.v, 0.25), F.percentile(w.v, 0.75), F.max_by(w.v, w.t)
    return F.when((last < q1 - 1.5 * (q3 - q1)) | (last > q3 + 1.5 * (q3 - q1)), last)


def increase(w: W) -> Column:
    return F.sum(w.when(w.ok, w.inc))


def first_time(w: W) -> Column:
    """The time of the first sample that ``increase`` makes use of, in seconds before the point."""
    return F.min(F.when(w.ok, w.pt).otherwise(w.t))


def rate(w: W) -> Column:
    seconds = (F.max(w.t) - first_time(w)) / 1000.0
    return F.when(seconds > 0, increase(w) / seconds)


#: Functions that need no previous sample.
PLAIN: dict[str, Callable[[W], Column]] = {
    "default_rollup": lambda w: F.max_by(w.v, w.t),
    "last_over_time": lambda w: F.max_by(w.v, w.t),
    "first_over_time": lambda w: F.min_by(w.v, w.t),
    "count_over_time": lambda w: F.count(w.v).cast("double"),
    "sum_over_time": lambda w: F.sum(w.v),
    "sum2_over_time": lambda w: F.sum(w.v * w.v),
    "avg_over_time": lambda w: F.avg(w.v),
    "min_over_time": lambda w: min_or_nan(w.v),
    "max_over_time": lambda w: max_or_nan(w.v),
    "range_over_time": lambda w: max_or_nan(w.v) - min_or_nan(w.v),
    "geomean_over_time": lambda w: F.exp(F.avg(log(w.v))),
    "stddev_over_time": lambda w: deviation(w.v),
    "stdvar_over_time": lambda w: F.var_pop(w.v),
    "median_over_time": lambda w: F.percentile(w.v, 0.5),
    "quantile_over_time": lambda w: quantile(w.v, w.args[0]),
    "iqr_over_time": lambda w: F.percentile(w.v, 0.75) - F.percentile(w.v, 0.25),
    "mad_over_time": lambda w: mad(F.collect_list(w.v)),
    "mode_over_time": lambda w: F.mode(w.v, True),
    "distinct_over_time": lambda w: F.size(F.collect_set(w.v)).cast("double"),
    "present_over_time": lambda w: F.lit(1.0) + 0 * F.count(w.v),
    "tfirst_over_time": lambda w: F.min(w.t) / 1000.0,
    "tlast_over_time": lambda w: F.max(w.t) / 1000.0,
    "timestamp": lambda w: F.max(w.t) / 1000.0,
    "timestamp_with_name": lambda w: F.max(w.t) / 1000.0,
    "tmin_over_time": lambda w: F.max_by(w.t, F.struct(-w.v, w.t)) / 1000.0,
    "tmax_over_time": lambda w: F.max_by(w.t, F.struct(w.v, w.t)) / 1000.0,
    "lifetime": lambda w: (F.max(w.t) - F.min(w.t)) / 1000.0,
    "lag": lambda w: (F.max(w.g) - F.max(w.t)) / 1000.0,
    "stale_samples_over_time": lambda w: 0.0 * F.count(w.v),
    "delta_prometheus": lambda w: F.when(F.count(w.v) > 1, F.max_by(w.v, w.t) - F.min_by(w.v, w.t)),
    "rate_over_sum": lambda w: F.sum(w.v) / (w.d / 1000.0),
    "deriv": lambda w: F.regr_slope(w.v, w.sec),
    "predict_linear": lambda w: F.regr_intercept(w.v, w.sec) + F.regr_slope(w.v, w.sec) * w.args[0],
    "zscore_over_time": lambda w: divide(F.max_by(w.v, w.t) - F.avg(w.v), deviation(w.v)),
    "count_eq_over_time": lambda w: F.count_if(equal(w.v, F.lit(w.args[0]))).cast("double"),
    "count_ne_over_time": lambda w: F.count_if(~equal(w.v, F.lit(w.args[0]))).cast("double"),
    "count_gt_over_time": lambda w: F.count_if(less(F.lit(w.args[0]), w.v)).cast("double"),
    "count_le_over_time": lambda w: F.count_if(~F.isnan(w.v) & (w.v <= w.args[0])).cast("double"),
    "share_eq_over_time": lambda w: F.count_if(equal(w.v, F.lit(w.args[0]))) / F.count(w.v),
    "share_gt_over_time": lambda w: F.count_if(less(F.lit(w.args[0]), w.v)) / F.count(w.v),
    "share_le_over_time": lambda w: F.count_if(~F.isnan(w.v) & (w.v <= w.args[0])) / F.count(w.v),
    "sum_eq_over_time": lambda w: F.sum(F.when(equal(w.v, F.lit(w.args[0])), w.v).otherwise(0.0)),
    "sum_gt_over_time": lambda w: F.sum(F.when(less(F.lit(w.args[0]), w.v), w.v).otherwise(0.0)),
    "sum_le_over_time": lambda w: F.sum(F.when(~F.isnan(w.v) & (w.v <= w.args[0]), w.v).otherwise(0.0)),
    "outlier_iqr_over_time": outlier_iqr,
    "hoeffding_bound_lower": lambda w: hoeffding(w, -1),
    "hoeffding_bound_upper": lambda w: hoeffding(w, 1),
    "double_exponential_smoothing": holt_winters,
    "holt_winters": holt_winters,
    "smooth_exponential_over_time": exponential,
}
#: Functions of steps between samples.
STEPS: dict[str, Callable[[W], Column]] = {
    "increase": increase,
    "increase_pure": lambda w: F.sum(F.when(w.pt.isNull(), w.v).when(w.ok, w.inc).otherwise(0.0)),
    "increase_prometheus": lambda w: F.when(F.count(w.v) > 1, F.sum(w.when(w.inside, w.inc))),
    "rate": rate,
    "rate_prometheus": lambda w: F.when(F.count(w.v) > 1, F.sum(w.when(w.inside, w.inc)) / (w.d / 1000.0)),
    "irate": lambda w: F.max_by(w.when(w.ok, w.inc / w.dt, None), w.t),
    "delta": lambda w: F.max_by(w.v, w.t) - F.min_by(F.when(w.ok, w.pv).otherwise(w.v), w.t),
    "idelta": lambda w: F.max_by(w.when(w.ok, w.dv, None), w.t),
    "ideriv": lambda w: F.max_by(w.when(w.ok, w.dv / w.dt, None), w.t),
    "deriv_fast": lambda w: F.when(F.max(w.t) > first_time(w), (F.max_by(w.v, w.t) - F.min_by(F.when(w.ok, w.pv).otherwise(w.v), w.t)) / ((F.max(w.t) - first_time(w)) / 1000.0)),
    "resets": lambda w: F.count_if(w.ok & less(w.v, w.pv)).cast("double"),
    "changes": lambda w: F.count_if(w.ok & (w.dv != 0)).cast("double"),
    "changes_prometheus": lambda w: F.count_if(w.inside & (w.dv != 0)).cast("double"),
    "increases_over_time": lambda w: F.count_if(w.ok & less(w.pv, w.v)).cast("double"),
    "decreases_over_time": lambda w: F.count_if(w.ok & less(w.v, w.pv)).cast("double"),
    "ascent_over_time": lambda w: F.sum(w.when(w.ok, F.greatest(w.dv, F.lit(0.0)))),
    "descent_over_time": lambda w: F.sum(w.when(w.ok, F.greatest(-w.dv, F.lit(0.0)))),
    "tlast_change_over_time": lambda w: F.max(w.when(w.ok & (w.dv != 0), w.t, None)) / 1000.0,
    "integrate": lambda w: F.sum(w.when(w.ok, w.pv * w.dt)),
    "scrape_interval": lambda w: F.avg(w.when(w.ok, w.dt, None)),
    "duration_over_time": lambda w: F.sum(w.when(w.ok & (w.dt <= (w.args[0] if w.args else INF)), w.dt)),
}


def spread(x: Column) -> list[tuple[str, Column]]:
    return [("min", F.min(x)), ("max", F.max(x)), ("avg", F.avg(x))]


#: Functions with several results: (label's value, aggregate), the label is ``rollup`` unless the call names it.
SEVERAL: dict[str, Callable[[W], list[tuple[str, Column]]]] = {
    "rollup": lambda w: spread(w.v),
    "rollup_rate": lambda w: spread(w.when(w.ok, w.inc / w.dt, None)),
    "rollup_increase": lambda w: spread(w.when(w.ok, w.inc, None)),
    "rollup_delta": lambda w: spread(w.when(w.ok, w.dv, None)),
    "rollup_deriv": lambda w: spread(w.when(w.ok, w.dv / w.dt, None)),
    "rollup_scrape_interval": lambda w: spread(w.when(w.ok, w.dt, None)),
    "rollup_candlestick": lambda w: [("open", F.min_by(w.v, w.t)), ("high", F.max(w.v)), ("low", F.min(w.v)), ("close", F.max_by(w.v, w.t))],
    "quantiles_over_time": lambda w: [(f"{q:g}", quantile(w.v, q)) for q in w.args],
    "aggr_over_time": lambda w: [(n, {**PLAIN, **STEPS}[n](w)) for n in w.texts],
}
#: Functions of one window that group by the value too.
BY_VALUE = ("count_values_over_time", "histogram_over_time")
ABSENT = ("absent_over_time",)
NAMES = {*PLAIN, *STEPS, *SEVERAL, *BY_VALUE, *ABSENT}
#: Results that are still the metric's own quantity keep its name.
KEEP_NAME = set(
    "default_rollup avg_over_time first_over_time last_over_time geomean_over_time hoeffding_bound_lower hoeffding_bound_upper holt_winters double_exponential_smoothing "
    "iqr_over_time max_over_time min_over_time median_over_time mode_over_time predict_linear quantile_over_time quantiles_over_time rollup rollup_candlestick timestamp_with_name".split()
)
#: Which argument is the series (others: the last for those that take numbers first, else the first).
NUMBERS_FIRST = frozenset("quantile_over_time quantiles_over_time hoeffding_bound_lower hoeffding_bound_upper aggr_over_time count_values_over_time".split())



def register_rollup(name: str, make: Callable[[W], Column], steps: bool = False, keep_name: bool = False) -> None:
    """From now on queries know the rollup function ``name``: an aggregate over the columns of a window (see W). steps:
    it uses the sample before each (``pv``, ``pt``)."""
    if name in NAMES:
        raise ValueError(f"{name!r} is there already")
    (STEPS if steps else PLAIN)[name] = make
    NAMES.add(name)
    if keep_name:
        KEEP_NAME.add(name)


#: Functions that split into panes of one step: what a pane keeps, and how panes are joined.
PANES: dict[str, Callable[[], Column]] = {
    "count_over_time": lambda: F.sum("n").cast("double"),
    "sum_over_time": lambda: F.sum("s"),
    "sum2_over_time": lambda: F.sum("s2"),
    "avg_over_time": lambda: F.sum("s") / F.sum("n"),
    "min_over_time": lambda: min_or_nan(F.col("lo")),
    "max_over_time": lambda: max_or_nan(F.col("hi")),
    "range_over_time": lambda: max_or_nan(F.col("hi")) - min_or_nan(F.col("lo")),
    "present_over_time": lambda: F.lit(1.0) + 0 * F.sum("n"),
    "first_over_time": lambda: F.min_by("fv", "ft"),
    "last_over_time": lambda: F.max_by("lv", "lt"),
    "default_rollup": lambda: F.max_by("lv", "lt"),
    "tfirst_over_time": lambda: F.min("ft") / 1000.0,
    "tlast_over_time": lambda: F.max("lt") / 1000.0,
    "timestamp": lambda: F.max("lt") / 1000.0,
    "lifetime": lambda: (F.max("lt") - F.min("ft")) / 1000.0,
}


def pane_columns(v: Column, t: Column) -> list[Column]:
    return [
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), min_or_nan(v).alias("lo"), max_or_nan(v).alias("hi"),
        F.min_by(v, t).alias("fv"), F.min(t).alias("ft"), F.max_by(v, t).alias("lv"), F.max(t).alias("lt"),
    ]


def _rate(x: Column) -> Column:
    seconds = (F.max("lt") - F.min("pt")) / 1000.0
    return F.when(seconds > 0, x / seconds)


#: Functions of steps that split into panes: how panes are joined.
STEP_PANES: dict[str, Callable[[], Column]] = {
    "increase": lambda: F.sum("inc"),
    "rate": lambda: _rate(F.sum("inc")),
    "delta": lambda: F.max_by("lv", "lt") - F.min_by("fv", "ft"),
    "deriv_fast": lambda: _rate(F.max_by("lv", "lt") - F.min_by("fv", "ft")),
    "resets": lambda: F.sum("down").cast("double"),
    "decreases_over_time": lambda: F.sum("down").cast("double"),
    "increases_over_time": lambda: F.sum("up").cast("double"),
    "changes": lambda: F.sum("moved").cast("double"),
    "ascent_over_time": lambda: F.sum("rise"),
    "descent_over_time": lambda: F.sum("fall"),
    "integrate": lambda: F.sum("area"),
    "scrape_interval": lambda: F.sum("dt") / F.sum("pairs"),
}


def step_pane_columns(w: W, ok: Column) -> list[Column]:
    """What a pane keeps of its steps; those that no function asks for are pruned."""
    return [
        F.sum(w.when(ok, w.inc)).alias("inc"), F.count_if(ok & less(w.v, w.pv)).alias("down"), F.count_if(ok & less(w.pv, w.v)).alias("up"), F.count_if(ok & (w.dv != 0)).alias("moved"),
        F.sum(w.when(ok, F.greatest(w.dv, F.lit(0.0)))).alias("rise"), F.sum(w.when(ok, F.greatest(-w.dv, F.lit(0.0)))).alias("fall"), F.sum(w.when(ok, w.pv * w.dt)).alias("area"),
        F.sum(w.when(ok, w.dt, None)).alias("dt"), F.count_if(ok).alias("pairs"), F.min(F.when(ok, w.pt).otherwise(w.t)).alias("pt"), F.max(w.t).alias("lt"), F.max_by(w.v, w.t).alias("lv"),
        F.min_by(F.when(ok, w.pv).otherwise(w.v), w.t).alias("fv"), F.min(w.t).alias("ft"),
    ]


def vmrange(v: Column) -> Column:
    """The log-scale bucket of a value, 18 to a decade, as ``low...high``; NULL for what isn't positive."""
    k = F.floor(F.log10(v) * 18)
    return F.when(~F.isnan(v) & (v > 0) & (v < INF), F.format_string("%.3e...%.3e", F.pow(F.lit(10.0), k / 18.0), F.pow(F.lit(10.0), (k + 1) / 18.0)))


__all__ = ["ABSENT", "BY_VALUE", "KEEP_NAME", "NAMES", "NAN", "NUMBERS_FIRST", "PANES", "PLAIN", "SEVERAL", "STEPS", "STEP_PANES", "W", "pane_columns", "register_rollup", "step_pane_columns", "vmrange"]
