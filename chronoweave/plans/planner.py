"""From the syntax tree to one DataFrame plan. A vector is (lk, g, v): label string, grid point in ms, value; an
absent value is an absent row. A scalar is a function of g."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arguments import LOOKBACK_MS, parse_duration
from ..functions.numeric import INF, NAN, divide, less, log, max_or_nan, min_or_nan, remainder
from ..model import NAME, drop_labels, keep_labels, label, set_labels
from ..operators.results import text_of_value
from ..operators.selectors import Matcher, Selector
from . import labels as L
from . import rollups as R
from . import transforms as T
from .ast import Aggregate, Binary, Call, Duration, Node, Number, Series, Subquery, Text, Unary
from .parser import AGGREGATES, OWN_AGGREGATES, parse

MOST_POINTS = 1_000_000
#: From so many grid points a window on, samples are first summed up in panes of one step, where the function allows.
PANES_FROM = 4


class PlanError(ValueError):
    pass


class Source(Protocol):
    def scan(self, selectors: Sequence[Selector], start: int, end: int, keep: Sequence[str] | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class Scalar:
    at: Callable[[Column], Column]
    const: float | None = None


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    order: tuple | None = None  # for the sort functions
    grid: tuple[int, int, int] | None = None


def number(x: float) -> Scalar:
    return Scalar(lambda g: F.lit(float(x)), float(x))


class Planner:
    def __init__(self, spark: SparkSession, source: Source, start: int, end: int, step: int, lookback: int = LOOKBACK_MS):
        if start > end:
            raise PlanError("start must not be after end")
        if step <= 0:
            raise PlanError("the step must be positive")
        self.spark, self.source, self.start, self.step, self.lookback = spark, source, start, step, lookback
        self.n = (end - start) // step + 1
        self.end = start + (self.n - 1) * step
        if self.n > MOST_POINTS:
            raise PlanError(f"more than {MOST_POINTS} points")
        self.scans: dict[tuple, DataFrame] = {}

    # ---- entry
    def run(self, text: str | Node) -> Vector:
        node = parse(text) if isinstance(text, str) else text
        out = self.eval(node)
        return self.vector(out)

    def vector(self, x: Scalar | Vector) -> Vector:
        return x if isinstance(x, Vector) else Vector(self.grid().select(F.lit("").alias("lk"), "g", x.at(F.col("g")).cast("double").alias("v")))

    def grid(self) -> DataFrame:
        return self.spark.range(self.n).select((F.lit(self.start).cast("bigint") + F.col("id") * self.step).alias("g"))

    def eval(self, node: Node) -> Scalar | Vector:
        if isinstance(node, Number):
            return number(node.value)
        if isinstance(node, Duration):
            return number(parse_duration(node.text, self.step) / 1000.0)
        if isinstance(node, Series):
            if node.window is not None:
                return self.rollup("default_rollup", node, [], [])
            return self.rollup("default_rollup", replace(node, window=f"{self.lookback}ms"), [], [])
        if isinstance(node, Subquery):
            if node.window is None and node.step is None:
                return self.moved(node)
            return self.rollup("default_rollup", node, [], [])
        if isinstance(node, Unary):
            return self.pointwise(lambda v, a: -v, self.eval(node.expr), [], keep=False)
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, Aggregate):
            return self.aggregate(node)
        if isinstance(node, Call):
            return self.call(node)
        raise PlanError(f"a text can't stand here: {node}")

    # ---- arguments
    def const(self, node: Node) -> float:
        x = self.eval(node)
        if isinstance(x, Scalar) and x.const is not None:
            return x.const
        raise PlanError("this argument must be a number")

    def text(self, node: Node) -> str:
        if not isinstance(node, Text):
            raise PlanError("this argument must be a string")
        return node.value

    def instant(self, node: Node | None) -> int | None:
        if node is None:
            return None
        if isinstance(node, Call) and node.name in ("start", "end") and not node.args:
            return self.start if node.name == "start" else self.end
        return round(self.const(node) * 1000)

    # ---- rollups
    def scan(self, selector: Selector, low: int, high: int) -> DataFrame:
        key = (selector, low, high)
        if key not in self.scans:  # equal selectors share one plan, which Spark then runs once
            self.scans[key] = self.source.scan([selector], low, high).select("lk", F.col("ts_ms").alias("t"), F.col("value").alias("v"))
        return self.scans[key]

    def moved(self, node: Subquery) -> Vector:
        offset = parse_duration(node.offset or "0", self.step)
        at = self.instant(node.at)
        if at is not None:
            inner = Planner(self.spark, self.source, at - offset, at - offset, self.step, self.lookback).vector(self._inner(at - offset, at - offset).eval(node.expr)).df
            return Vector(inner.select("lk", F.explode(self._points()).alias("g"), "v"))
        inner = self._inner(self.start - offset, self.end - offset)
        return Vector(inner.vector(inner.eval(node.expr)).df.select("lk", (F.col("g") + offset).alias("g"), "v"))

    def _inner(self, start: int, end: int, step: int | None = None) -> Planner:
        return Planner(self.spark, self.source, start, end, step or self.step, self.lookback)

    def _points(self) -> Column:
        return F.sequence(F.lit(self.start).cast("bigint"), F.lit(self.end).cast("bigint"), F.lit(self.step).cast("bigint"))

    def samples(self, node: Series | Subquery, before: Callable[[int], int]) -> tuple[DataFrame, int, int, int | None]:
        """(lk, t, v), the window, the offset, the fixed point. before: how far back from the window to read."""
        offset, at = parse_duration(node.offset or "0", self.step), self.instant(node.at)
        d = parse_duration(node.window, self.step) if node.window else self.lookback
        if d <= 0:
            raise PlanError("a window must be positive")
        first, last = (self.start, self.end) if at is None else (at, at)
        low, high = first - offset - d - before(d), last - offset
        if isinstance(node, Series):
            return self.scan(node.selector, low + 1, high), d, offset, at
        step = parse_duration(node.step, self.step) if node.step else self.step
        low = -(-low // step) * step  # subqueries stand on multiples of their step
        inner = self._inner(low, max(high, low), step)
        rows = inner.vector(inner.eval(node.expr)).df
        return rows.select("lk", F.col("g").alias("t"), "v"), d, offset, at

    def fanned(self, rows: DataFrame, d: int, offset: int, at: int | None) -> DataFrame:
        """Each row once for every grid point whose window holds it; column g."""
        t = F.col("t") + offset
        if at is not None:
            return rows.where((t <= at) & (t > at - d)).withColumn("g", F.lit(at).cast("bigint"))
        first = F.greatest(F.ceil((t - self.start) / self.step), F.lit(0)).cast("bigint")
        last = F.least(F.ceil((t + d - self.start) / self.step) - 1, F.lit(self.n - 1)).cast("bigint")
        if d <= self.step:  # one point at most, so nothing is exploded
            return rows.where(first <= last).withColumn("g", F.lit(self.start).cast("bigint") + first * self.step)
        points = F.sequence(F.lit(self.start).cast("bigint") + first * self.step, F.lit(self.start).cast("bigint") + last * self.step, F.lit(self.step).cast("bigint"))
        return rows.where(first <= last).select("*", F.explode(points).alias("g"))

    def rollup(self, name: str, node: Node, args: list[float], texts: list[str], keep: bool = False) -> Vector:
        if not isinstance(node, (Series, Subquery)):
            node = Subquery(node, None)
        if isinstance(node, Series) and node.window is None:
            node = replace(node, window=f"{max(self.step, 1)}ms" if name != "default_rollup" else f"{self.lookback}ms")
        elif isinstance(node, Subquery) and node.window is None:
            node = replace(node, window=f"{self.step}ms")
        steps = name in R.STEPS or name in ("rollup_rate", "rollup_increase", "rollup_delta", "rollup_deriv", "rollup_scrape_interval") or any(x in R.STEPS for x in texts)
        reach = lambda d: max(d, self.lookback) if steps else 0
        rows, d, offset, at = self.samples(node, reach)
        if name in R.ABSENT:
            present = self.fanned(rows, d, offset, at).select("g").distinct()
            return Vector(self.grid().join(present, "g", "left_anti").select(self._absent_labels(node).alias("lk"), "g", F.lit(1.0).alias("v")))
        if name in R.PANES and at is None and d % self.step == 0 and d // self.step >= PANES_FROM:
            return self._named(self._paned(rows, name, d, offset), name, keep)
        if steps:
            before = Window.partitionBy("lk").orderBy("t")
            rows = rows.withColumn("pt", F.lag("t").over(before)).withColumn("pv", F.lag("v").over(before))
        if name in R.STEP_PANES and at is None and d % self.step == 0 and d // self.step >= PANES_FROM:
            return self._named(self._paned_steps(rows, name, d, offset, reach(d)), name, keep)
        rows = self.fanned(rows, d, offset, at)
        w = R.W(F.col("v"), F.col("t"), F.col("g") - offset, d, args, texts, F.col("pv") if steps else None, F.col("pt") if steps else None, reach(d))
        if name in R.BY_VALUE:
            value = R.vmrange(w.v) if name == "histogram_over_time" else text_of_value(w.v)
            dst = "vmrange" if name == "histogram_over_time" else texts[0]
            got = rows.withColumn("x", value).where(F.col("x").isNotNull()).groupBy("lk", "g", "x").agg(F.count("*").cast("double").alias("v"))
            out = got.select(set_labels(F.col("lk"), {dst: F.col("x")}).alias("lk"), "g", "v")
        elif name in R.SEVERAL:
            several = R.SEVERAL[name](w)
            dst = texts[0] if name == "quantiles_over_time" else "rollup"
            if name.startswith("rollup") and texts:  # one of the results only, without the label
                several = [x for x in several if x[0] == texts[0]]
            got = rows.groupBy("lk", "g").agg(F.array(*[F.struct(F.lit(n).alias("x"), c.cast("double").alias("v")) for n, c in several]).alias("a"))
            out = got.select("lk", "g", F.inline("a")).where(F.col("v").isNotNull())
            one = name.startswith("rollup") and texts
            out = out.select((F.col("lk") if one else set_labels(F.col("lk"), {dst: F.col("x")})).alias("lk"), "g", "v")
        else:
            f = R.PLAIN.get(name) or R.STEPS[name]
            out = rows.groupBy("lk", "g").agg(f(w).cast("double").alias("v")).where(F.col("v").isNotNull())
        if at is not None:
            out = out.select("lk", F.explode(self._points()).alias("g"), "v")
        return self._named(out, name, keep)

    def _paned(self, rows: DataFrame, name: str, d: int, offset: int) -> DataFrame:
        """A window of k steps is k panes: samples are reduced to one row a pane before they are fanned out."""
        k = F.ceil((F.col("t") + offset - self.start) / self.step).cast("bigint")
        panes = rows.groupBy("lk", k.alias("k")).agg(*R.pane_columns(F.col("v"), F.col("t")))
        last = F.least(F.col("k") + d // self.step - 1, F.lit(self.n - 1).cast("bigint"))
        spread = panes.where((last >= 0) & (F.col("k") < self.n)).select("*", F.explode(F.sequence(F.greatest(F.col("k"), F.lit(0).cast("bigint")), last)).alias("i"))
        got = spread.groupBy("lk", "i").agg(R.PANES[name]().cast("double").alias("v")).where(F.col("v").isNotNull())
        return got.select("lk", (F.lit(self.start).cast("bigint") + F.col("i") * self.step).alias("g"), "v")

    def _paned_steps(self, rows: DataFrame, name: str, d: int, offset: int, reach: int) -> DataFrame:
        """The same of functions of steps. Whether the sample before counts depends on the point only if it lies far
        back, between ``reach`` and ``reach + d`` before its successor; those few samples are fanned out to their points,
        all others to panes."""
        long, start = lambda x: F.lit(x).cast("bigint"), self.start
        t, gap = F.col("t") + offset, F.col("t") - F.col("pt")
        k = F.ceil((t - start) / self.step).cast("bigint")
        reaches = lambda c: F.least(c + d // self.step - 1, long(self.n - 1))
        rows = rows.withColumn("k", k).where((reaches(F.col("k")) >= 0) & (F.col("k") < self.n))
        far = F.coalesce((gap > reach) & (gap < d + reach), F.lit(False))
        points = F.sequence(F.greatest(F.col("k"), long(0)), reaches(F.col("k")))
        rows = rows.select("lk", "t", "v", "pt", "pv", "k", F.explode(F.when(far, points).otherwise(F.array(F.lit(None).cast("bigint")))).alias("i"))
        w = R.W(F.col("v"), F.col("t"), long(start) + F.col("i") * self.step - offset, d, [], [], F.col("pv"), F.col("pt"), reach)
        ok = F.coalesce(F.when(F.col("i").isNull(), gap <= reach).otherwise(w.ok), F.lit(False))
        panes = rows.groupBy("lk", "k", "i").agg(*R.step_pane_columns(w, ok))
        at = F.when(F.col("i").isNull(), F.sequence(F.greatest(F.col("k"), long(0)), reaches(F.col("k")))).otherwise(F.array("i"))
        got = panes.withColumn("i", F.explode(at)).groupBy("lk", "i").agg(R.STEP_PANES[name]().cast("double").alias("v")).where(F.col("v").isNotNull())
        return got.select("lk", (long(start) + F.col("i") * self.step).alias("g"), "v")

    def _named(self, out: DataFrame, name: str, keep: bool) -> Vector:
        if keep or name in R.KEEP_NAME:
            return Vector(out)
        return Vector(out.withColumn("lk", drop_labels(F.col("lk"), [NAME])))

    def _absent_labels(self, node: Node) -> Column:
        """The labels that a selector fixes by equality."""
        sel = node.selector if isinstance(node, Series) else None
        if sel is None or len(sel.groups) != 1:
            return F.lit("")
        return set_labels(F.lit(""), {m.name: m.value for m in sel.groups[0] if m.op == "=" and m.name != NAME})

    # ---- calls
    def call(self, node: Call) -> Scalar | Vector:
        name, args = node.name, list(node.args)
        if name in R.NAMES:
            return self.rollup_call(node)
        if name in T.CONSTANTS and not args:
            return number(T.CONSTANTS[name])
        if name in ("time", "now", "start", "end", "step"):
            import time

            fixed = {"now": time.time(), "start": self.start / 1000, "end": self.end / 1000, "step": self.step / 1000}
            return Scalar(lambda g: g / 1000.0) if name == "time" else number(fixed[name])
        if name in T.DATES and not args:
            f = T.POINTWISE[name]
            return Scalar(lambda g: f(g / 1000.0, []))
        if name in T.POINTWISE:
            return self.pointwise(T.POINTWISE[name], self.eval(args[0]), [self.eval(a) for a in args[1:]], keep=node.keep_names or name in T.KEEP_NAME)
        if name in L.REWRITE:
            vec = self.vector(self.eval(args[0])).df
            texts = [a.value if isinstance(a, (Text, Number)) else self.text(a) for a in args[1:]]
            return Vector(vec.withColumn("lk", L.REWRITE[name](F.col("lk"), *texts)))
        if name in L.FILTER:
            return Vector(self.vector(self.eval(args[0])).df.where(L.FILTER[name](F.col("lk"), *[self.text(a) for a in args[1:]])))
        if name == "label_value":
            vec = self.vector(self.eval(args[0])).df
            v = label(F.col("lk"), self.text(args[1])).try_cast("double")
            return Vector(vec.withColumn("v", v).where(F.col("v").isNotNull()))
        handler = getattr(self, f"f_{name}", None)
        if handler is None:
            if name in T.SERIES_STATS:
                nums = [self.const(a) for a in args[:-1]]
                return self.joined(args[-1], lambda v, g: {"m": T.SERIES_STATS[name](v, g, nums)}, lambda v: F.col("m"))
            raise PlanError(f"unknown function {name!r}")
        return handler(args)

    def rollup_call(self, node: Call) -> Vector:
        name, args = node.name, list(node.args)
        if not args:
            if name == "timestamp":
                return self.vector(Scalar(lambda g: g / 1000.0))
            raise PlanError(f"{name} needs a series")
        is_series = [not isinstance(a, (Text, Number, Duration)) and not (isinstance(a, Call) and a.name in ("time", "pi")) for a in args]
        at = max((k for k, ok in enumerate(is_series) if ok), default=len(args) - 1) if name in R.NUMBERS_FIRST else next((k for k, ok in enumerate(is_series) if ok), 0)
        rest = [a for k, a in enumerate(args) if k != at]
        texts = [a.value for a in rest if isinstance(a, Text)]
        nums = [self.const(a) for a in rest if not isinstance(a, Text)]
        needed = {"quantile_over_time": 1, "predict_linear": 1, "hoeffding_bound_lower": 1, "hoeffding_bound_upper": 1, "holt_winters": 2, "double_exponential_smoothing": 2}
        if len(nums) < needed.get(name, 1 if "_eq_" in name or "_ne_" in name or "_gt_" in name or "_le_" in name else 0):
            raise PlanError(f"{name} needs more arguments")
        if name == "aggr_over_time" and not set(texts) <= {*R.PLAIN, *R.STEPS}:
            raise PlanError("aggr_over_time knows rollup functions of one result only")
        return self.rollup(name, args[at], nums, texts, node.keep_names)

    def pointwise(self, f: Callable[[Column, list[Column]], Column], x: Scalar | Vector, args: list[Scalar | Vector], keep: bool) -> Scalar | Vector:
        if any(isinstance(a, Vector) for a in args):
            raise PlanError("this argument must be a scalar")
        if isinstance(x, Scalar):
            return Scalar(lambda g: f(x.at(g), [a.at(g) for a in args]))
        df = x.df.withColumn("v", f(F.col("v"), [a.at(F.col("g")) for a in args]).cast("double")).where(F.col("v").isNotNull())
        return Vector(df if keep else df.withColumn("lk", drop_labels(F.col("lk"), [NAME])))

    def joined(self, arg: Node, stats: Callable[[Column, Column], dict[str, Column]], value: Callable[[Column], Column], stay: Column | None = None, drop: bool = True) -> Vector:
        """Numbers of the whole series next to each of its values."""
        vec = self.vector(self.eval(arg)).df
        per = vec.groupBy("lk").agg(*[c.alias(n) for n, c in stats(F.col("v"), F.col("g")).items()])
        out = vec.join(per, "lk")
        out = out.where(stay) if stay is not None else out
        out = out.select("lk", "g", value(F.col("v")).cast("double").alias("v")).where(F.col("v").isNotNull())
        return Vector(out.withColumn("lk", drop_labels(F.col("lk"), [NAME])) if drop else out)

    # ---- transforms over series and labels
    def f_vector(self, args: list[Node]) -> Vector:
        return self.vector(self.eval(args[0]))

    def f_scalar(self, args: list[Node]) -> Vector:
        if isinstance(args[0], Text):
            return self.vector(number(float(args[0].value)))
        vec = self.vector(self.eval(args[0])).df
        per = vec.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        return Vector(self.grid().join(per, "g", "left").select(F.lit("").alias("lk"), "g", F.when(F.col("n") == 1, F.col("v")).otherwise(NAN).alias("v")))

    def f_union(self, args: list[Node]) -> Vector:
        """All series; of those with the same labels the first argument's."""
        parts = [self.vector(self.eval(a)).df.withColumn("i", F.lit(k)) for k, a in enumerate(args)]
        both = reduce(lambda a, b: a.unionByName(b), parts)
        # a window, so that the arguments aren't worked out twice; it holds as many rows of a series as the grid has points
        first = F.min("i").over(Window.partitionBy("lk"))
        return Vector(both.withColumn("first", first).where(F.col("i") == F.col("first")).select("lk", "g", "v"))

    def f_absent(self, args: list[Node]) -> Vector:
        vec = self.vector(self.eval(args[0])).df
        return Vector(self.grid().join(vec.select("g").distinct(), "g", "left_anti").select(self._absent_labels(args[0]).alias("lk"), "g", F.lit(1.0).alias("v")))

    def f_drop_empty_series(self, args: list[Node]) -> Vector:
        return self.joined(args[0], lambda v, g: {"m": F.count_if(~F.isnan(v))}, lambda v: v, F.col("m") > 0, drop=False)

    def f_drop_common_labels(self, args: list[Node]) -> Vector:
        from ..model import ITEM

        vec = self.vector(self.eval(args[0])).df
        names = vec.select("lk").distinct()
        items = names.select("lk", F.explode(F.array_remove(F.split("lk", ITEM), "")).alias("i"))
        total = names.agg(F.count("*").alias("all"))
        common = items.groupBy("i").agg(F.count("*").alias("n")).crossJoin(total).where("n = all").agg(F.collect_set("i").alias("c"))  # one row
        rest = F.array_join(F.array_except(F.split("lk", ITEM), "c"), ITEM)
        return Vector(vec.crossJoin(F.broadcast(common)).select(rest.alias("lk"), "g", "v"))

    def over(self, args: list[Node], f: Callable[[Column, object], Column], drop: bool = True) -> Vector:
        vec = self.vector(self.eval(args[0])).df
        w = Window.partitionBy("lk").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = vec.withColumn("v", f(F.col("v"), w))
        return Vector(out.withColumn("lk", drop_labels(F.col("lk"), [NAME])) if drop else out)

    def f_running_sum(self, args: list[Node]) -> Vector:
        return self.over(args, lambda v, w: F.sum(v).over(w))

    def f_running_avg(self, args: list[Node]) -> Vector:
        return self.over(args, lambda v, w: F.avg(v).over(w))

    def f_running_min(self, args: list[Node]) -> Vector:
        return self.over(args, lambda v, w: F.min(v).over(w))

    def f_running_max(self, args: list[Node]) -> Vector:
        return self.over(args, lambda v, w: F.max(v).over(w))

    def f_remove_resets(self, args: list[Node]) -> Vector:
        vec = self.vector(self.eval(args[0])).df
        w = Window.partitionBy("lk").orderBy("g")
        before = vec.withColumn("p", F.lag("v").over(w))
        lost = F.sum(F.when(less(F.col("v"), F.col("p")), F.col("p")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return Vector(before.select("lk", "g", (F.col("v") + lost).alias("v")))

    def dense(self, arg: Node) -> DataFrame:
        """The series on every grid point, NULL where there is no value."""
        vec = self.vector(self.eval(arg)).df
        full = vec.select("lk").distinct().select("lk", F.explode(self._points()).alias("g"))
        return full.join(vec, ["lk", "g"], "left")

    def f_keep_last_value(self, args: list[Node]) -> Vector:
        w = Window.partitionBy("lk").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return Vector(self.dense(args[0]).withColumn("v", F.last("v", True).over(w)).where(F.col("v").isNotNull()))

    def f_keep_next_value(self, args: list[Node]) -> Vector:
        w = Window.partitionBy("lk").orderBy("g").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return Vector(self.dense(args[0]).withColumn("v", F.first("v", True).over(w)).where(F.col("v").isNotNull()))

    def f_interpolate(self, args: list[Node]) -> Vector:
        back = Window.partitionBy("lk").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = Window.partitionBy("lk").orderBy("g").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        point = F.when(F.col("v").isNotNull(), F.struct("g", "v"))
        out = self.dense(args[0]).withColumn("a", F.last(point, True).over(back)).withColumn("b", F.first(point, True).over(ahead))
        share = (F.col("g") - F.col("a.g")) / F.when(F.col("b.g") > F.col("a.g"), F.col("b.g") - F.col("a.g"))
        return Vector(out.select("lk", "g", F.coalesce("v", F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share).alias("v")).where(F.col("v").isNotNull()))

    def f_range_normalize(self, args: list[Node]) -> Vector:
        parts = [self.joined(a, lambda v, g: {"lo": F.min(v), "hi": F.max(v)}, lambda v: divide(v - F.col("lo"), F.col("hi") - F.col("lo"))).df for a in args]
        return Vector(reduce(lambda a, b: a.unionByName(b), parts))

    def f_range_zscore(self, args: list[Node]) -> Vector:
        return self.joined(args[0], lambda v, g: {"m": F.avg(v), "s": F.stddev_pop(v)}, lambda v: divide(v - F.col("m"), F.col("s")))

    def f_range_trim_zscore(self, args: list[Node]) -> Vector:
        z = self.const(args[0])
        return self.joined(args[1], lambda v, g: {"m": F.avg(v), "s": F.stddev_pop(v)}, lambda v: v, F.abs(F.col("v") - F.col("m")) <= z * F.col("s"), drop=False)

    def f_range_trim_spikes(self, args: list[Node]) -> Vector:
        phi = self.const(args[0])
        return self.joined(args[1], lambda v, g: {"lo": F.percentile(v, phi / 2), "hi": F.percentile(v, 1 - phi / 2)}, lambda v: v, F.col("v").between(F.col("lo"), F.col("hi")), drop=False)

    def with_mad(self, arg: Node) -> DataFrame:
        vec = self.vector(self.eval(arg)).df
        med = vec.groupBy("lk").agg(F.percentile("v", 0.5).alias("med"))
        both = vec.join(med, "lk")
        dev = both.groupBy("lk").agg(F.percentile(F.abs(F.col("v") - F.col("med")), 0.5).alias("mad"))
        return both.join(dev, "lk")

    def f_range_mad(self, args: list[Node]) -> Vector:
        return Vector(self.with_mad(args[0]).select(drop_labels(F.col("lk"), [NAME]).alias("lk"), "g", F.col("mad").alias("v")))

    def f_range_trim_outliers(self, args: list[Node]) -> Vector:
        k = self.const(args[0])
        return Vector(self.with_mad(args[1]).where(F.abs(F.col("v") - F.col("med")) <= k * F.col("mad")).select("lk", "g", "v"))

    def f_range_linear_regression(self, args: list[Node]) -> Vector:
        x = (F.col("g") - self.start) / 1000.0
        return self.joined(args[0], lambda v, g: {"a": F.regr_intercept(v, (g - self.start) / 1000.0), "b": F.regr_slope(v, (g - self.start) / 1000.0)}, lambda v: F.coalesce(F.col("a") + F.col("b") * x, v))

    def f_smooth_exponential(self, args: list[Node]) -> Vector:
        """s(i) = sf * v(i) + (1 - sf) * s(i - 1) over each series' values in order."""
        sf = self.const(args[1])
        vec = self.vector(self.eval(args[0])).df
        rows = vec.groupBy("lk").agg(F.array_sort(F.collect_list(F.struct("g", "v"))).alias("a"))  # as many as the grid has points

        def step(acc: Column, x: Column) -> Column:
            s = F.when(F.size(acc) == 0, x["v"]).otherwise(F.lit(sf) * x["v"] + F.lit(1 - sf) * F.element_at(acc, -1)["v"])
            return F.concat(acc, F.array(F.struct(x["g"].alias("g"), s.alias("v"))))

        out = F.aggregate("a", F.array().cast("array<struct<g:bigint,v:double>>"), step)
        return Vector(rows.select("lk", F.inline(out)))

    def f_ru(self, args: list[Node]) -> Vector:
        """Used share in percent of free and max."""
        return self.eval(parse_call("100 * (clamp_min(b - clamp_min(a, 0), 0)) / b", self, args))

    def f_ttf(self, args: list[Node]) -> Vector:
        """Seconds until free is used up, by the smoothed slope of the free values."""
        vec = self.vector(self.eval(args[0])).df
        w = Window.partitionBy("lk").orderBy("g")
        slope = (F.col("v") - F.lag("v").over(w)) / ((F.col("g") - F.lag("g").over(w)) / 1000.0)
        out = vec.withColumn("s", slope).where(F.col("s").isNotNull())
        return Vector(out.select(drop_labels(F.col("lk"), [NAME]).alias("lk"), "g", F.when(F.col("s") < 0, F.col("v") / F.when(F.col("s") < 0, -F.col("s"))).otherwise(INF).alias("v")))

    def random(self, args: list[Node], f: Callable[[int | None], Column]) -> Vector:
        seed = int(self.const(args[0])) if args else None
        return Vector(self.grid().select(F.lit("").alias("lk"), "g", f(seed).alias("v")))

    def f_rand(self, args: list[Node]) -> Vector:
        return self.random(args, lambda s: F.rand(s))

    def f_rand_normal(self, args: list[Node]) -> Vector:
        return self.random(args, lambda s: F.randn(s))

    def f_rand_exponential(self, args: list[Node]) -> Vector:
        return self.random(args, lambda s: -F.ln(1.0 - F.rand(s)))

    def f_timezone_offset(self, args: list[Node]) -> Scalar:
        zone = self.text(args[0])
        t = lambda g: F.timestamp_millis(g)
        return Scalar(lambda g: (F.unix_seconds(F.from_utc_timestamp(t(g), zone)) - F.unix_seconds(t(g))).cast("double"))

    def sorted_by(self, arg: Node, order: tuple) -> Vector:
        return Vector(self.vector(self.eval(arg)).df, order)

    def f_sort(self, args: list[Node]) -> Vector:
        return self.sorted_by(args[0], (F.asc("v"), F.asc("lk")))

    def f_sort_desc(self, args: list[Node]) -> Vector:
        return self.sorted_by(args[0], (F.desc("v"), F.asc("lk")))

    def by_labels(self, args: list[Node], direction: Callable, key: Callable[[Column], Column]) -> Vector:
        names = [self.text(a) for a in args[1:]]
        return self.sorted_by(args[0], tuple(direction(key(label(F.col("lk"), n))) for n in names))

    def f_sort_by_label(self, args: list[Node]) -> Vector:
        return self.by_labels(args, lambda c: c.asc(), lambda c: c)

    def f_sort_by_label_desc(self, args: list[Node]) -> Vector:
        return self.by_labels(args, lambda c: c.desc(), lambda c: c)

    def f_sort_by_label_numeric(self, args: list[Node]) -> Vector:
        return self.by_labels(args, lambda c: c.asc(), natural)

    def f_sort_by_label_numeric_desc(self, args: list[Node]) -> Vector:
        return self.by_labels(args, lambda c: c.desc(), natural)

    def f_limit_offset(self, args: list[Node]) -> Vector:
        limit, offset = int(self.const(args[0])), int(self.const(args[1]))
        vec = self.vector(self.eval(args[2])).df
        chosen = vec.select("lk").distinct().orderBy("lk").offset(offset).limit(limit)
        return Vector(vec.join(chosen, "lk", "left_semi"))

    # histograms
    def buckets(self, arg: Node) -> DataFrame:
        """gl (labels without le), g, b: (le, count) in order of le, counts made monotonic."""
        vec = self.to_le(self.vector(self.eval(arg)).df)
        le = F.col("le")
        rows = vec.groupBy("gl", "g", "le").agg(F.sum("v").alias("v")).groupBy("gl", "g").agg(F.array_sort(F.collect_list(F.struct(le, "v"))).alias("b"))  # one entry a bucket
        mono = F.aggregate("b", F.array().cast("array<struct<le:double,v:double>>"), lambda acc, x: F.concat(acc, F.array(F.struct(x["le"].alias("le"), F.greatest(x["v"], F.coalesce(F.try_element_at(acc, F.lit(-1))["v"], F.lit(0.0))).alias("v")))))
        return rows.withColumn("b", mono)

    def to_le(self, vec: DataFrame) -> DataFrame:
        """gl, g, le, v of bucketed series; vmrange buckets become cumulative ones first."""
        lk = F.col("lk")
        le, rng = label(lk, "le"), label(lk, "vmrange")
        bound = F.when(le != "", le).otherwise(F.substring_index(rng, "...", -1))
        rows = vec.where((le != "") | (rng != "")).select(
            drop_labels(lk, ["le", "vmrange", NAME]).alias("gl"), "g", (le == "").alias("ranged"), F.when(bound.isin("+Inf", "Inf"), INF).otherwise(bound.try_cast("double")).alias("le"), "v"
        ).where(F.col("le").isNotNull())
        w = Window.partitionBy("gl", "g", "ranged").orderBy("le")
        summed = rows.groupBy("gl", "g", "ranged", "le").agg(F.sum("v").alias("v"))
        summed = summed.withColumn("v", F.when(F.col("ranged"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(F.col("v"))).withColumn("last", F.lead("le").over(w).isNull())
        # the last range is followed by the bucket of everything
        top = F.col("ranged") & F.col("last") & (F.col("le") < INF)
        les = F.when(top, F.array(F.col("le"), F.lit(INF))).otherwise(F.array("le"))
        return summed.select("gl", "g", F.explode(les).alias("le"), "v")

    def quantile_of(self, phi: float) -> Column:
        b = F.col("b")
        total = F.element_at(b, -1)["v"]
        rank = F.lit(phi) * total
        k = F.array_size(F.filter(b, lambda x: x["v"] < rank))  # the first bucket that reaches the rank
        here = F.get(b, k)
        lower = F.when(k > 0, F.get(b, k - 1)["le"]).otherwise(F.when(here["le"] <= 0, here["le"]).otherwise(0.0))
        below = F.when(k > 0, F.get(b, k - 1)["v"]).otherwise(0.0)
        share = (rank - below) / F.when(here["v"] > below, here["v"] - below)
        inside = F.when(here["le"] == INF, F.when(F.size(b) > 1, F.get(b, F.size(b) - 2)["le"])).otherwise(F.coalesce(lower + (here["le"] - lower) * share, here["le"]))
        return F.when(total == 0, NAN).when(F.lit(phi) < 0, -INF).when(F.lit(phi) > 1, INF).otherwise(inside)

    def f_histogram_quantile(self, args: list[Node]) -> Vector:
        return Vector(self.buckets(args[1]).select(F.col("gl").alias("lk"), "g", self.quantile_of(self.const(args[0])).alias("v")).where(F.col("v").isNotNull()))

    def f_histogram_quantiles(self, args: list[Node]) -> Vector:
        dst, rows = self.text(args[0]), self.buckets(args[-1])
        phis = [self.const(a) for a in args[1:-1]]
        got = rows.select("gl", "g", F.inline(F.array(*[F.struct(F.lit(f"{p:g}").alias("p"), self.quantile_of(p).alias("v")) for p in phis])))
        return Vector(got.where(F.col("v").isNotNull()).select(set_labels(F.col("gl"), {dst: F.col("p")}).alias("lk"), "g", "v"))

    def f_histogram_share(self, args: list[Node]) -> Vector:
        le, b = self.const(args[0]), F.col("b")
        k = F.array_size(F.filter(b, lambda x: x["le"] <= le))
        low, high = F.get(b, F.greatest(k - 1, F.lit(0))), F.get(b, k)
        low_le, low_v = F.when(k > 0, low["le"]).otherwise(0.0), F.when(k > 0, low["v"]).otherwise(0.0)
        part = F.when(high.isNull() | (high["le"] == INF), low_v).otherwise(low_v + (high["v"] - low_v) * (F.lit(le) - low_le) / F.when(high["le"] > low_le, high["le"] - low_le))
        return Vector(self.buckets(args[1]).select(F.col("gl").alias("lk"), "g", divide(part, F.element_at(b, -1)["v"]).alias("v")))

    def moments(self, arg: Node, value: Callable[[Column, Column, Column], Column]) -> Vector:
        """Each bucket's count stands at the middle of its bounds."""
        rows = self.buckets(arg)
        b = F.col("b")
        parts = F.transform(b, lambda x, i: F.struct((x["v"] - F.when(i > 0, F.get(b, i - 1)["v"]).otherwise(0.0)).alias("n"), F.when(x["le"] == INF, F.when(i > 0, F.get(b, i - 1)["le"]).otherwise(0.0)).otherwise((x["le"] + F.when(i > 0, F.get(b, i - 1)["le"]).otherwise(0.0)) / 2).alias("m")))
        rows = rows.withColumn("p", parts)
        total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + f(x))
        rows = rows.withColumn("n", total(lambda x: x["n"])).withColumn("s", total(lambda x: x["n"] * x["m"])).withColumn("q", total(lambda x: x["n"] * x["m"] * x["m"]))
        return Vector(rows.select(F.col("gl").alias("lk"), "g", value(F.col("n"), F.col("s"), F.col("q")).alias("v")))

    def f_histogram_avg(self, args: list[Node]) -> Vector:
        return self.moments(args[0], lambda n, s, q: divide(s, n))

    def f_histogram_stdvar(self, args: list[Node]) -> Vector:
        return self.moments(args[0], lambda n, s, q: divide(q, n) - divide(s, n) * divide(s, n))

    def f_histogram_stddev(self, args: list[Node]) -> Vector:
        return self.moments(args[0], lambda n, s, q: F.sqrt(F.greatest(divide(q, n) - divide(s, n) * divide(s, n), F.lit(0.0))))

    def f_prometheus_buckets(self, args: list[Node]) -> Vector:
        vec = self.to_le(self.vector(self.eval(args[0])).df)
        return Vector(vec.select(set_labels(F.col("gl"), {"le": text_of_value(F.col("le"))}).alias("lk"), "g", "v"))

    def f_buckets_limit(self, args: list[Node]) -> Vector:
        """The n buckets with the most hits of their own; the first and last stay."""
        n, vec = int(self.const(args[0])), self.to_le(self.vector(self.eval(args[1])).df)
        total = vec.groupBy("gl", "le").agg(F.sum("v").alias("s"))
        v = Window.partitionBy("gl").orderBy("le")
        own = total.withColumn("hits", F.col("s") - F.coalesce(F.lag("s").over(v), F.lit(0.0))).withColumn("edge", (F.row_number().over(v) == 1) | F.lead("le").over(v).isNull())
        rank = own.withColumn("r", F.row_number().over(Window.partitionBy("gl").orderBy(F.desc("edge"), F.desc("hits"), "le"))).where(F.col("r") <= max(n, 3))
        kept = vec.join(rank.select("gl", "le"), ["gl", "le"], "left_semi")
        return Vector(kept.select(set_labels(F.col("gl"), {"le": text_of_value(F.col("le"))}).alias("lk"), "g", "v"))

    # ---- aggregates over series
    def grouped(self, node: Aggregate, vec: DataFrame) -> DataFrame:
        """vec with gl, the labels of its group."""
        lk = F.col("lk")
        if node.grouping == "by":
            gl = keep_labels(lk, list(node.labels))
        elif node.grouping == "without":
            gl = drop_labels(lk, [*node.labels, NAME])
        else:
            gl = F.lit("")
        return vec.withColumn("gl", gl)

    def aggregate(self, node: Aggregate) -> Vector:
        name, args = node.name, list(node.args)
        lead = {"quantile": 1, "topk": 1, "bottomk": 1, "limitk": 1, "outliersk": 1, "outliers_mad": 1, "count_values": 1}
        if name == "quantiles":
            params, series = args[:-1], args[-1:]
        elif name.startswith(("topk_", "bottomk_")):
            params, series = [args[0], *args[2:]], args[1:2]
        else:
            params, series = args[: lead.get(name, 0)], args[lead.get(name, 0) :]
        if not series:
            raise PlanError(f"{name} needs a vector")
        vecs = [self.vector(self.eval(s)).df for s in series]
        vec = self.grouped(node, reduce(lambda a, b: a.unionByName(b), vecs))
        out = self._aggregate(node, name, params, vec)
        if node.limit is not None:
            chosen = out.select("lk").distinct().orderBy("lk").limit(node.limit)
            out = out.join(chosen, "lk", "left_semi")
        return Vector(out)

    def _aggregate(self, node: Aggregate, name: str, params: list[Node], vec: DataFrame) -> DataFrame:
        v = F.col("v")
        simple: dict[str, Callable[[], Column]] = {
            "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: min_or_nan(v), "max": lambda: max_or_nan(v), "count": lambda: F.count(v).cast("double"),
            "group": lambda: F.lit(1.0) + 0 * F.count(v), "any": lambda: F.min_by(v, "lk"), "sum2": lambda: F.sum(v * v), "geomean": lambda: F.exp(F.avg(log(v))),
            "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v), "median": lambda: F.percentile(v, 0.5), "mode": lambda: F.mode(v, True),
            "quantile": lambda: R.quantile(v, self.const(params[0])),
        }
        simple |= {n: (lambda f=f: f(v)) for n, f in _OWN_AGGREGATES.items()}
        if name in simple:
            return vec.groupBy("gl", "g").agg(simple[name]().cast("double").alias("v")).select(F.col("gl").alias("lk"), "g", "v").where(F.col("v").isNotNull())
        if name == "distinct":  # two combined aggregates, not a set of values in one row
            return vec.select("gl", "g", "v").distinct().groupBy("gl", "g").agg(F.count("*").cast("double").alias("v")).select(F.col("gl").alias("lk"), "g", "v")
        if name == "quantiles":
            dst, phis = self.text(params[0]), [self.const(p) for p in params[1:]]
            got = vec.groupBy("gl", "g").agg(F.array(*[F.struct(F.lit(f"{p:g}").alias("p"), R.quantile(v, p).alias("v")) for p in phis]).alias("a"))
            return got.select("gl", "g", F.inline("a")).select(set_labels(F.col("gl"), {dst: F.col("p")}).alias("lk"), "g", "v")
        if name in ("count_values", "histogram"):
            dst = "vmrange" if name == "histogram" else self.text(params[0])
            x = R.vmrange(v) if name == "histogram" else text_of_value(v)
            got = vec.withColumn("x", x).where(F.col("x").isNotNull()).groupBy("gl", "g", "x").agg(F.count("*").cast("double").alias("v"))
            return got.select(set_labels(F.col("gl"), {dst: F.col("x")}).alias("lk"), "g", "v")
        if name in ("topk", "bottomk"):
            k = int(self.const(params[0]))
            order = F.desc("v") if name == "topk" else F.asc("v")
            rank = F.row_number().over(Window.partitionBy("gl", "g").orderBy(order, "lk"))
            return vec.where(~F.isnan(v)).withColumn("r", rank).where(F.col("r") <= k).select("lk", "g", "v")
        if name.startswith(("topk_", "bottomk_")):
            return self._ranked_series(name, params, vec)
        if name == "limitk":
            series = vec.select("gl", "lk").distinct().withColumn("r", F.row_number().over(Window.partitionBy("gl").orderBy(F.md5("lk"), "lk")))
            return vec.join(series.where(F.col("r") <= int(self.const(params[0]))), "lk", "left_semi").select("lk", "g", "v")
        if name in ("share", "zscore", "outliers_iqr"):
            stats = {
                "share": [F.sum(F.when(v >= 0, v)).alias("s")],
                "zscore": [F.avg(v).alias("m"), F.stddev_pop(v).alias("s")],
                "outliers_iqr": [F.percentile(v, 0.25).alias("a"), F.percentile(v, 0.75).alias("b")],
            }[name]
            both = vec.join(vec.groupBy("gl", "g").agg(*stats), ["gl", "g"])
            if name == "outliers_iqr":
                wide = 1.5 * (F.col("b") - F.col("a"))
                return both.where((v > F.col("b") + wide) | (v < F.col("a") - wide)).select("lk", "g", "v")
            value = F.when(v >= 0, divide(v, F.col("s"))) if name == "share" else divide(v - F.col("m"), F.col("s"))
            return both.select(drop_labels(F.col("lk"), [NAME]).alias("lk"), "g", value.alias("v")).where(F.col("v").isNotNull())
        med = vec.groupBy("gl", "g").agg(F.percentile(v, 0.5).alias("med"))
        both = vec.join(med, ["gl", "g"])
        away = F.abs(v - F.col("med"))
        if name in ("mad", "outliers_mad"):
            dev = both.groupBy("gl", "g").agg(F.percentile(away, 0.5).alias("mad"))
            if name == "mad":
                return dev.select(F.col("gl").alias("lk"), "g", F.col("mad").alias("v"))
            far = both.join(dev, ["gl", "g"]).where(away > self.const(params[0]) * F.col("mad")).select("lk").distinct()
            return vec.join(far, "lk", "left_semi").select("lk", "g", "v")
        if name == "outliersk":
            score = both.groupBy("gl", "lk").agg(F.sum(away * away).alias("s"))
            top = score.withColumn("r", F.row_number().over(Window.partitionBy("gl").orderBy(F.desc("s"), "lk"))).where(F.col("r") <= int(self.const(params[0])))
            return vec.join(top, "lk", "left_semi").select("lk", "g", "v")
        raise PlanError(f"unknown aggregate {name!r}")

    def _ranked_series(self, name: str, params: list[Node], vec: DataFrame) -> DataFrame:
        """Whole series ranked by one number; the others may be summed up under a label."""
        v = F.col("v")
        stat = {"min": F.min(v), "max": F.max(v), "avg": F.avg(v), "median": F.percentile(v, 0.5), "last": F.max_by(v, "g")}[name.split("_")[1]]
        order = F.desc("s") if name.startswith("topk") else F.asc("s")
        ranks = vec.groupBy("gl", "lk").agg(stat.alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("gl").orderBy(order, "lk")))
        top = ranks.where(F.col("r") <= int(self.const(params[0]))).select("lk")
        out = vec.join(top, "lk", "left_semi").select("lk", "g", "v")
        if len(params) > 1:
            rest_name, _, rest_value = self.text(params[1]).partition("=")
            rest = vec.join(top, "lk", "left_anti").groupBy("gl", "g").agg(F.sum(v).alias("v"))
            out = out.unionByName(rest.select(set_labels(F.col("gl"), {rest_name: rest_value or rest_name}).alias("lk"), "g", "v"))
        return out

    # ---- binary operators
    def binary(self, node: Binary) -> Scalar | Vector:
        a, b, op = self.eval(node.left), self.eval(node.right), node.op
        f = _ARITHMETIC.get(op)
        compare = _COMPARE.get(op)
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            if f:
                return Scalar(lambda g: f(a.at(g), b.at(g)))
            if compare:
                return Scalar(lambda g: F.when(compare(a.at(g), b.at(g)), F.lit(1.0) if node.as_bool else a.at(g)).otherwise(0.0 if node.as_bool else NAN))
            a = self.vector(a)
        if op in ("and", "or", "unless", "default", "if", "ifnot"):
            return self.sets(node, a, b)
        if isinstance(a, Scalar) or isinstance(b, Scalar):
            vec = (b if isinstance(a, Scalar) else a).df
            g, v = F.col("g"), F.col("v")
            x, y = (a.at(g), v) if isinstance(a, Scalar) else (v, b.at(g))
            return Vector(self._result(vec, node, f, compare, x, y, v))
        return self.matched(node, a.df, b.df, f, compare)

    def _result(self, df: DataFrame, node: Binary, f, compare, x: Column, y: Column, kept: Column) -> DataFrame:
        drop = lambda d: d if node.keep_names else d.withColumn("lk", drop_labels(F.col("lk"), [NAME]))
        if f:
            return drop(df.select("lk", "g", f(x, y).cast("double").alias("v"))).where(F.col("v").isNotNull())
        if node.as_bool:
            return drop(df.select("lk", "g", F.when(compare(x, y), 1.0).otherwise(0.0).alias("v")))
        return df.where(compare(x, y)).select("lk", "g", kept.alias("v"))

    def match_key(self, node: Binary, lk: Column) -> Column:
        if node.matching == "on":
            return keep_labels(lk, list(node.labels))
        return drop_labels(lk, [*(node.labels if node.matching == "ignoring" else ()), NAME])

    def unique(self, df: DataFrame, node: Binary, v: str, lk: str) -> DataFrame:
        """mk, g and the one value there; a second one fails the query."""
        n = F.count("*")
        some = F.concat(F.lit("several series match on one side of "), F.lit(node.op), F.lit(" for labels {"), F.first("mk"), F.lit("}"))
        value = F.when(n > 1, F.raise_error(some).cast("double")).otherwise(F.min("v"))
        return df.groupBy("mk", "g").agg(value.alias(v), F.min("lk").alias(lk))

    def matched(self, node: Binary, left: DataFrame, right: DataFrame, f, compare) -> Vector:
        left = left.withColumn("mk", self.match_key(node, F.col("lk")))
        right = right.withColumn("mk", self.match_key(node, F.col("lk")))
        if node.side == "group_right":
            one, many = self.unique(left, node, "x", "one_lk"), right.withColumnRenamed("v", "y")
            both = many.join(one, ["mk", "g"])
        else:
            one = self.unique(right, node, "y", "one_lk")
            many = left.withColumnRenamed("v", "x") if node.side else self.unique(left, node, "x", "lk")
            both = many.join(one, ["mk", "g"])
        if node.side and node.copied:
            both = both.withColumn("lk", set_labels(F.col("lk"), {n: label(F.col("one_lk"), n) for n in node.copied}))
        if not node.side and node.matching == "on":
            both = both.withColumn("lk", F.col("mk") if f or node.as_bool else keep_labels(F.col("lk"), [*node.labels, NAME]))
        elif not node.side and node.matching == "ignoring":
            both = both.withColumn("lk", drop_labels(F.col("lk"), list(node.labels)))
        return Vector(self._result(both, node, f, compare, F.col("x"), F.col("y"), F.col("x")))

    def sets(self, node: Binary, a: Scalar | Vector, b: Scalar | Vector) -> Vector:
        op = node.op
        if op == "default" and isinstance(b, Scalar):
            vec = self.vector(a).df
            full = vec.select("lk").distinct().select("lk", F.explode(self._points()).alias("g"))
            got = full.join(vec, ["lk", "g"], "left")
            return Vector(got.select("lk", "g", F.coalesce(F.when(~F.isnan("v"), F.col("v")), b.at(F.col("g"))).alias("v")))
        left = self.vector(a).df.withColumn("mk", self.match_key(node, F.col("lk")))
        right = self.vector(b).df.where(~F.isnan("v")).withColumn("mk", self.match_key(node, F.col("lk")))
        keys = right.select("mk", "g").distinct()
        if op in ("and", "if"):
            out = left.join(keys, ["mk", "g"], "left_semi")
        elif op in ("unless", "ifnot"):
            out = left.join(keys, ["mk", "g"], "left_anti")
        else:  # or, default
            there = left if op == "or" else left.where(~F.isnan("v"))
            out = there.select("lk", "g", "v").unionByName(right.join(there.select("mk", "g").distinct(), ["mk", "g"], "left_anti").select("lk", "g", "v"))
        return Vector(out.select("lk", "g", "v"))


def natural(c: Column) -> Column:
    """Digits in a label sort as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def parse_call(text: str, planner: Planner, args: list[Node]) -> Node:
    """A formula in a and b with the arguments put in."""
    node = parse(text)

    def put(n: object) -> object:
        if isinstance(n, Series) and n.selector == Selector(((Matcher(NAME, "=", "a"),),)):
            return args[0]
        if isinstance(n, Series) and n.selector == Selector(((Matcher(NAME, "=", "b"),),)):
            return args[1]
        if isinstance(n, tuple):
            return tuple(put(x) for x in n)
        if isinstance(n, Node) and not isinstance(n, Series):
            return replace(n, **{k: put(getattr(n, k)) for k in n.__dataclass_fields__ if isinstance(getattr(n, k), (Node, tuple))})
        return n

    return put(node)


_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": remainder, "^": lambda a, b: F.pow(a, b), "atan2": lambda a, b: F.atan2(a, b),
}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a == b), "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    "<": less, ">": lambda a, b: less(b, a), "<=": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a <= b), ">=": lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a >= b),
}


_OWN_AGGREGATES: dict[str, Callable[[Column], Column]] = {}


def register_aggregate(name: str, make: Callable[[Column], Column]) -> None:
    """From now on queries know the aggregate ``name`` over series: a function of the column of values."""
    if name in AGGREGATES or name in R.NAMES:
        raise ValueError(f"{name!r} is there already")
    _OWN_AGGREGATES[name] = make
    OWN_AGGREGATES.add(name)


def query_range(spark: SparkSession, source: Source, text: str, start: int, end: int, step: int, lookback: int = LOOKBACK_MS, rounding: int | None = None) -> DataFrame:
    """(lk, ts_ms, value) of a query on the grid start, start + step, ..., end."""
    got = Planner(spark, source, start, end, step, lookback).run(text)
    return _output(got, rounding)


def query(spark: SparkSession, source: Source, text: str, time: int, lookback: int = LOOKBACK_MS, rounding: int | None = None, step: int = LOOKBACK_MS) -> DataFrame:
    """An instant query: one point."""
    return _output(Planner(spark, source, time, time, step, lookback).run(text), rounding)


def _output(got: Vector, rounding: int | None) -> DataFrame:
    from ..functions.numeric import round_to_decimal_digits

    df = got.df
    if got.order:
        df = df.orderBy(*got.order)
    v = F.col("v") if rounding is None else round_to_decimal_digits(F.col("v"), rounding)
    return df.select("lk", F.col("g").alias("ts_ms"), v.alias("value"))
