"""Ingest: retention, dedupe interval, duplicate policies, and appends to a store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arguments import DuplicatePolicy
from ..functions.numeric import round_to_significant_digits

POLICIES = tuple(p.value for p in DuplicatePolicy)
#: Samples that are there already count as arrived before any others.
BEFORE_ALL = -(1 << 63)
ERROR_UNKNOWN, ERROR_OLD, ERROR_DUPLICATE, ERROR_EARLY, OK = "unknown series", "older than retention", "duplicate sample", "within dedupe interval", "ok"


def resolve(policy: Column, value: Column, seq: Column, present: Iterable[str] | None = None) -> Column:
    """The value that stays of all values at one timestamp, as an aggregate: seq is the order of arrival. NaN gives
    way to any number; under ``block`` the first stays. present: the only policies there are; others aren't worked out.
    All states are numbers, since text among them would make Spark sort instead of hash."""
    number, place = F.when(~F.isnan(value), value), F.when(~F.isnan(value), seq)
    found = POLICIES if present is None else sorted({p if p in POLICIES else "last" for p in present}) or ["last"]
    made = {"first": lambda: F.min_by(number, place), "min": lambda: F.min(number), "max": lambda: F.max(number), "sum": lambda: F.sum(number), "last": lambda: F.max_by(number, place)}
    values = [F.min_by(value, seq) if n == "block" else F.coalesce(made[n](), F.lit(float("nan"))) for n in found]
    if len(found) == 1:
        return values[0]
    code = F.when(policy.isNull(), F.lit(None).cast("int"))
    for i, n in enumerate(found):
        code = code.when(policy == n, i)
    which = F.max(code.otherwise(found.index("last") if "last" in found else -1))
    got = F.when(which == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        got = got.when(which == i, v)
    return got


def deduplicate(rows: DataFrame, policy: str | DuplicatePolicy, by: Sequence[str] = ("lk", "ts_ms"), seq: str = "seq") -> DataFrame:
    """One row for each series and timestamp, by one policy for all series. Under ``block`` the first value stays."""
    name = DuplicatePolicy.parse(policy).value
    value = F.col("value")
    if name in ("min", "max", "sum"):
        number = F.when(~F.isnan(value), value)
        got = F.coalesce({"min": F.min, "max": F.max, "sum": F.sum}[name](number), F.lit(float("nan")))
    elif name == "block":
        got = F.min_by(value, seq)
    else:
        pick = F.min_by if name == "first" else F.max_by
        number, place = F.when(~F.isnan(value), value), F.when(~F.isnan(value), F.col(seq))
        got = F.coalesce(pick(number, place), F.lit(float("nan")))
    return rows.groupBy(*by).agg(got.alias("value"))


def retained(samples: DataFrame, retention: Column | int, by: Sequence[str] = ("lk",)) -> DataFrame:
    """Samples no older than the newest one of their series less the retention; 0 or NULL keeps all. The newest
    timestamps come from a combined aggregate and are joined back, so a long series isn't gathered in one task."""
    keep = retention if isinstance(retention, Column) else F.lit(retention)
    newest = samples.groupBy(*by).agg(F.max("ts_ms").alias("_newest"))
    floor = F.when(F.coalesce(keep, F.lit(0)) > 0, F.greatest(F.col("_newest") - keep, F.lit(0))).otherwise(F.lit(-1))
    return samples.join(newest, list(by)).where(F.col("ts_ms") >= floor).drop("_newest")


def accepted(rows: DataFrame, by: str = "lk", interval: str = "dedupe_ms", seq: str = "seq") -> DataFrame:
    """Samples that keep the dedupe interval, in order of arrival: one is turned away if it comes less than
    ``interval`` after the last accepted one of its series (so every late sample too). Rows of a series stream
    through one task in order with one number of state; they aren't gathered."""
    at, ts, gap = rows.columns.index(by), rows.columns.index("ts_ms"), rows.columns.index(interval)
    ordered = rows.repartition(by).sortWithinPartitions(by, seq)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        series, last = None, None
        for b in batches:
            keep = []
            for s, t, d in zip(b.column(at).to_pylist(), b.column(ts).to_pylist(), b.column(gap).to_pylist(), strict=True):
                if s != series:
                    series, last = s, None
                ok = not d or d <= 0 or last is None or t - last >= d
                keep.append(ok)
                if ok:
                    last = t
            yield b.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, rows.schema)


def options(series: DataFrame, *more: str) -> DataFrame:
    """series_id, what ingest asks of a series, and more of its columns."""
    return series.select("series_id", *more, F.coalesce("dup_policy", F.lit("last")).alias("policy"), F.coalesce("retention_ms", F.lit(0)).alias("retention_ms"), F.coalesce("dedupe_ms", F.lit(0)).alias("dedupe_ms"), F.coalesce("sig_digits", F.lit(0)).alias("sig_digits"))


def rounded(value: Column, digits: Column) -> Column:
    out = value
    for d in range(1, 17):
        out = F.when(digits == d, round_to_significant_digits(value, d)).otherwise(out)
    return out


def merge(batch: DataFrame, there: DataFrame | None, policies: Iterable[str], digits: bool) -> DataFrame:
    """What a batch changes where nothing but the policy decides (no retention, no dedupe interval, no ``block``).
    batch: series_id, ts_ms, value, seq, policy, sig_digits of known series; there: samples before it. Returns series_id,
    ts_ms, value and whether the sample is new, at the timestamps of the batch only; one shuffle, of fixed-width rows."""
    value = rounded(F.col("value"), F.col("sig_digits")) if digits else F.col("value")
    rows = batch.select("series_id", "ts_ms", value.alias("value"), "seq", "policy", F.lit(1).alias("_fresh"))
    if there is not None:
        rows = rows.unionByName(there.select("series_id", "ts_ms", "value", F.lit(BEFORE_ALL).alias("seq"), F.lit(None).cast("string").alias("policy"), F.lit(0).alias("_fresh")))
    got = rows.groupBy("series_id", "ts_ms").agg(resolve(F.col("policy"), F.col("value"), F.col("seq"), policies).alias("value"), F.min("_fresh").alias("_new"), F.max("_fresh").alias("_fresh"))
    return got.where("_fresh = 1").select("series_id", "ts_ms", "value", (F.col("_new") == 1).alias("new"))


def append(series: DataFrame, samples: DataFrame, batch: DataFrame, last: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """batch: series_id, ts_ms, value, seq. Returns (samples after it, status of each row of the batch). samples may
    be only those of the days that the batch touches if ``last`` (series_id, last_ts) says where each series ends.

    Rows of unknown series, older than retention, within the dedupe interval, or duplicates under ``block`` don't get
    in and say so in ``status``; the others' values are rounded to the series' significant digits and merged by its
    policy. Samples already there count as arrived before."""
    policy = options(series)
    touched = batch.select("series_id").distinct()
    mine = samples.join(touched, "series_id", "left_semi")
    last = last if last is not None else mine.groupBy("series_id").agg(F.max("ts_ms").alias("last_ts"))
    newest = batch.groupBy("series_id").agg(F.max("ts_ms").alias("batch_ts")).join(last, "series_id", "left").select("series_id", F.greatest("batch_ts", "last_ts").alias("newest"), "last_ts")
    rows = batch.join(policy, "series_id", "left").join(newest, "series_id", "left")
    old = (F.col("retention_ms") > 0) & (F.col("ts_ms") < F.greatest(F.col("newest") - F.col("retention_ms"), F.lit(0)))
    rows = rows.withColumn("status", F.when(F.col("policy").isNull(), ERROR_UNKNOWN).when(old, ERROR_OLD).otherwise(OK))
    good = rows.where(F.col("status") == OK)
    # the last stored sample takes part in the dedupe check as the first arrival
    strict = good.where(F.col("dedupe_ms") > 0)
    seed = strict.select("series_id", "last_ts", "dedupe_ms").distinct().where(F.col("last_ts").isNotNull()).select("series_id", F.col("last_ts").alias("ts_ms"), F.lit(-1).cast("bigint").alias("seq"), "dedupe_ms")
    kept = accepted(strict.select("series_id", "ts_ms", F.col("seq").cast("bigint").alias("seq"), "dedupe_ms").unionByName(seed), "series_id").where("seq >= 0").select("series_id", "seq", F.lit(True).alias("_kept"))
    good = good.join(kept, ["series_id", "seq"], "left").withColumn("status", F.when((F.col("dedupe_ms") > 0) & F.col("_kept").isNull(), ERROR_EARLY).otherwise(F.col("status"))).drop("_kept")
    value = rounded(F.col("value"), F.col("sig_digits"))
    fresh = good.where(F.col("status") == OK).select("series_id", "ts_ms", value.alias("value"), F.col("seq").cast("bigint").alias("seq"), "policy")
    there = mine.join(policy.select("series_id", "policy"), "series_id").select("series_id", "ts_ms", "value", F.lit(-1).cast("bigint").alias("seq"), "policy")
    both = there.unionByName(fresh)
    merged = both.groupBy("series_id", "ts_ms").agg(resolve(F.col("policy"), F.col("value"), F.col("seq")).alias("value"), F.min("seq").alias("_first"))
    floors = newest.join(policy, "series_id").where("retention_ms > 0").select("series_id", F.greatest(F.col("newest") - F.col("retention_ms"), F.lit(0)).alias("_floor"))
    merged = merged.join(floors, "series_id", "left").where(F.col("_floor").isNull() | (F.col("ts_ms") >= F.col("_floor")))
    after = samples.join(touched, "series_id", "left_anti").select("series_id", "ts_ms", "value").unionByName(merged.select("series_id", "ts_ms", "value"))
    # under block all but the first arrival at a timestamp are turned away
    firsts = both.where("policy = 'block'").groupBy("series_id", "ts_ms").agg(F.min("seq").alias("_seq"))
    good = good.join(firsts, ["series_id", "ts_ms"], "left").withColumn("status", F.when((F.col("policy") == "block") & (F.col("status") == OK) & (F.col("seq") != F.col("_seq")), ERROR_DUPLICATE).otherwise(F.col("status")))
    status = rows.where(F.col("status") != OK).select("series_id", "ts_ms", "seq", "status").unionByName(good.select("series_id", "ts_ms", "seq", "status"))
    return after, status


def merge_sorted(newer: DataFrame, older: DataFrame, policy: str | DuplicatePolicy, floor: int | None = None, by: Sequence[str] = ("lk", "ts_ms")) -> DataFrame:
    """Two sets of samples as one: at a shared timestamp the policy decides, with ``older`` as the old value; what is
    older than ``floor`` is left out."""
    both = older.withColumn("seq", F.lit(0)).unionByName(newer.withColumn("seq", F.lit(1)))
    return deduplicate(both.where(F.col("ts_ms") >= floor) if floor is not None else both, policy, by)
