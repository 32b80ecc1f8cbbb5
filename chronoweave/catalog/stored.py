"""Queries over a stored folder: series are created, samples appended, deleted, copied and put together by the engine's
commands, and what is then in the folder is compared. Each query builds a folder of its own from the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.arguments import DuplicatePolicy
from ..model import NAME, label
from ..session import shared_folder
from ..sources import events_source, orders_source
from .base import DAY, FIRST, GRID, LAST, SAMPLES, STEP, T0, T1, add, shown, shown_value, sql_shown, sql_value

ROWS = f"FROM ({SAMPLES})"
#: The bounds of what is deleted.
A, B = FIRST + 5 * DAY, FIRST + 12 * DAY
POLICIES = tuple(p.value for p in DuplicatePolicy)


def engine(spark: SparkSession, slot_days: int = 1) -> Engine:
    return Engine(spark, shared_folder(spark, "series"), cache=False, lookback=2 * DAY, slot_days=slot_days)


def series_rows(keys: DataFrame, retention: Column | int = 0, dedupe: Column | int = 0, policy: Column | str = "last", digits: int = 0) -> DataFrame:
    """Rows of the table of series without ids, of (key, metric, labels)."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return keys.select(
        F.lit(0).alias("db"), "key", "metric", "labels", of(retention).cast("bigint").alias("retention_ms"), of(dedupe).cast("bigint").alias("dedupe_ms"), of(policy).alias("dup_policy"),
        F.lit(digits).alias("sig_digits"), F.lit(4096).alias("chunk_size"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, metric, user, ts_ms, value, seq of all events."""
    src = events_source(spark, sf_dir)
    return src.df.select(
        F.concat("event_type", F.lit(":"), "user_id").alias("key"), F.col("event_type").alias("metric"), F.col("user_id").alias("user"),
        src.ts_ms.alias("ts_ms"), src.value.alias("value"), src.ts_ms.alias("seq"),
    )


def event_keys(rows: DataFrame) -> DataFrame:
    """key, metric, labels of the series of events. Labels are made of what is left: maps among the rows would be sorted."""
    return rows.select("metric", "user").distinct().select(F.concat("metric", F.lit(":"), "user").alias("key"), "metric", F.create_map(F.lit("user"), F.col("user").cast("string")).alias("labels"))


def filled(spark: SparkSession, sf_dir: str, parts: int = 1, **options: object) -> Engine:
    """All events appended, in ``parts`` batches by user, each of which touches every day."""
    e, rows = engine(spark), events(spark, sf_dir)
    e.create_many(series_rows(event_keys(rows), **options))
    for k in range(parts):
        e.add_batch(rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).select("key", "ts_ms", "value", "seq"))
    return e


def everything(e: Engine) -> DataFrame:
    return e.store.source(0).scan([_any()], -(1 << 50), 1 << 50)


def _any():
    from ..plans.parser import parse_selector

    return parse_selector('{__name__!=""}')


def of_all(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, labels: tuple[str, ...] = (NAME, "user"), digits: int = 6) -> None:
    add(name, lambda s, d: shown(run(s, d), labels, digits), sql_shown(sql, labels, digits))


ALL = f"SELECT metric, usr, ts_ms, value {ROWS}"
of_all("store_append", lambda s, d: everything(filled(s, d)), ALL)
of_all("store_append_parts", lambda s, d: everything(filled(s, d, 3)), ALL)


def _spans(s: SparkSession, d: str) -> DataFrame:
    got = filled(s, d, 2).spans()
    return got.select(label(F.col("lk"), NAME).alias("metric"), label(F.col("lk"), "user").alias("usr"), "first_ts", "last_ts", "n")


add("store_spans", _spans, f"SELECT metric, usr, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(*) AS n {ROWS} GROUP BY ALL")


def _overwritten(s: SparkSession, d: str) -> DataFrame:
    """Every sample once more with another value: the policy ``last`` takes that one."""
    e = filled(s, d)
    e.add_batch(events(s, d).select("key", "ts_ms", (F.col("value") * 2).alias("value"), "seq"))
    return everything(e)


of_all("store_upsert", _overwritten, f"SELECT metric, usr, ts_ms, value * 2 AS value {ROWS}")
of_all(
    "store_retention", lambda s, d: everything(filled(s, d, retention=7 * DAY)),
    f"SELECT metric, usr, ts_ms, value {ROWS} QUALIFY ts_ms >= max(ts_ms) OVER (PARTITION BY metric, usr) - {7 * DAY}",
)


def _compacted(s: SparkSession, d: str) -> DataFrame:
    e = filled(s, d, 2)
    e._save(e.store.series().withColumn("retention_ms", F.lit(7 * DAY).cast("bigint")))
    e.compact()
    return everything(e)


of_all("store_compact", _compacted, f"SELECT metric, usr, ts_ms, value {ROWS} QUALIFY ts_ms >= max(ts_ms) OVER (PARTITION BY metric, usr) - {7 * DAY}")
of_all("store_significant_digits", lambda s, d: everything(filled(s, d, digits=2)), f"SELECT metric, usr, ts_ms, CASE WHEN value = 0 THEN 0 ELSE round(value * pow(10.0, 1 - floor(log10(abs(value))))) / pow(10.0, 1 - floor(log10(abs(value)))) END AS value {ROWS}")


def _changed(change: Callable[[Engine], object]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        e = filled(s, d, 2)
        change(e)
        return everything(e)

    return run


of_all("store_delete_range", _changed(lambda e: e.delete_range(["click"], A, B)), f"{ALL} WHERE NOT (metric = 'click' AND ts_ms BETWEEN {A} AND {B})")
of_all("store_delete_key_range", _changed(lambda e: e.delete_key_range("click:1", A, B)), f"{ALL} WHERE NOT (metric = 'click' AND usr = '1' AND ts_ms BETWEEN {A} AND {B})")
of_all("store_delete_series", _changed(lambda e: e.delete_series(["click", "view"])), f"{ALL} WHERE metric NOT IN ('click', 'view')")
of_all("store_delete_keys", _changed(lambda e: e.delete_keys("click:1", "view:2")), f"{ALL} WHERE NOT (metric = 'click' AND usr = '1') AND NOT (metric = 'view' AND usr = '2')")
of_all("store_flush", _changed(lambda e: e.flush()), f"{ALL} WHERE false")
add(
    "store_rename", lambda s, d: (lambda e: (e.rename_series("click:1", "taps"), e.series().select("key"))[1])(filled(s, d)),
    f"SELECT DISTINCT CASE WHEN metric = 'click' AND usr = '1' THEN 'taps' ELSE metric || ':' || usr END AS key {ROWS}",
)


def _copied(s: SparkSession, d: str) -> DataFrame:
    e = filled(s, d)
    e.copy_series("click:1", "copy")
    return e.range("copy", FIRST, LAST).select("ts_ms", shown_value(F.col("value")).alias("value"))


add("store_copy", _copied, f"SELECT ts_ms, {sql_value()} AS value {ROWS} WHERE metric = 'click' AND usr = '1'")


def _altered(s: SparkSession, d: str) -> DataFrame:
    from ..engine import SeriesOptions

    e = filled(s, d)
    e.alter_series("click:1", SeriesOptions(labels={"team": "a"}, retention_ms=DAY))
    return e.series().select("key", "retention_ms", F.coalesce(F.try_element_at("labels", F.lit("team")), F.lit("")).alias("team"))


add("store_alter", _altered, f"SELECT DISTINCT metric || ':' || usr AS key, CASE WHEN metric = 'click' AND usr = '1' THEN {DAY} ELSE 0 END AS retention_ms, CASE WHEN metric = 'click' AND usr = '1' THEN 'a' ELSE '' END AS team {ROWS}")


def _restored(s: SparkSession, d: str) -> DataFrame:
    e, at = filled(s, d, 2), shared_folder(s, "snapshot")
    e.snapshot(at)
    e.flush()
    e.restore(at)
    return everything(e)


of_all("store_snapshot", _restored, ALL)


def _policies(s: SparkSession, d: str) -> DataFrame:
    """Orders share timestamps; a series for each policy, and all orders in two batches by order of arrival."""
    e, src = engine(s, slot_days=366), orders_source(s, d)
    rows = src.df.select(F.explode(F.array(*map(F.lit, POLICIES))).alias("policy"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), src.ts_ms.alias("ts_ms"), src.value.alias("value"), F.col("o_orderkey").alias("seq"))
    rows = rows.withColumn("key", F.concat_ws(":", "policy", "status", "priority"))
    keys = rows.groupBy("key", "policy", "status", "priority").agg(F.count("*")).select("key", "policy", F.lit("order_value").alias("metric"), F.create_map(F.lit("policy"), F.col("policy"), F.lit("status"), F.col("status"), F.lit("priority"), F.col("priority")).alias("labels"))
    e.create_many(series_rows(keys, policy=F.element_at("labels", "policy")))
    middle = rows.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0] or 0
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        e.add_batch(rows.where(part).select("key", "ts_ms", "value", "seq"))
    return everything(e)


_ORDERS = "(SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value, o_orderkey AS seq FROM orders)"
_VALUE = {"block": "arg_min(value, seq)", "first": "arg_min(value, seq)", "last": "arg_max(value, seq)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)"}
add(
    "store_policies",
    lambda s, d: _policies(s, d).select(*[label(F.col("lk"), n).alias(n) for n in ("policy", "status", "priority")], "ts_ms", shown_value(F.col("value"), 4).alias("value")),
    " UNION ALL ".join(f"SELECT '{p}' AS policy, status, priority, ts_ms, {sql_value(_VALUE[p], 4)} AS value FROM {_ORDERS} GROUP BY ALL" for p in POLICIES),
)


def _statuses(s: SparkSession, d: str) -> DataFrame:
    """What MADD says of each item: the samples again under ``block``, and a key that isn't there."""
    e, rows = engine(s), events(s, d).where("metric = 'click'")
    e.create_many(series_rows(event_keys(rows), policy="block"))
    first = rows.select("key", "ts_ms", "value", "seq")
    e.add_batch(first)
    again = first.unionByName(first.withColumn("key", F.lit("nobody")))
    return e.add_batch(again).groupBy("status").agg(F.count("*").alias("n"))


def _status_sql() -> str:
    from ..operators.ingest import ERROR_DUPLICATE, ERROR_UNKNOWN

    n = f"(SELECT count(*) {ROWS} WHERE metric = 'click')"
    return f"SELECT '{ERROR_DUPLICATE}' AS status, {n} AS n UNION ALL SELECT '{ERROR_UNKNOWN}', {n}"


add("store_add_status", _statuses, _status_sql())

# ---- queries over the folder
_LAST = f"""WITH s AS (SELECT * FROM ({SAMPLES}) WHERE metric = 'click'), {GRID},
x AS (SELECT usr, g, arg_max(value, ts_ms) AS v FROM s JOIN grid ON ts_ms > g - {2 * DAY} AND ts_ms <= g GROUP BY ALL)"""
of_all("store_query_range", lambda s, d: filled(s, d).query_range("sum(click) by (user)", T0, T1, STEP), _LAST + " SELECT usr, g AS ts_ms, v AS value FROM x", ("user",))
of_all("store_query_rounding", lambda s, d: filled(s, d).query_range("sqrt(click)", T0, T1, STEP, rounding=1), _LAST + " SELECT usr, g AS ts_ms, round(sqrt(v), 1) AS value FROM x", ("user",), 4)
of_all("store_query", lambda s, d: filled(s, d).query("avg(click)", LAST), f"SELECT {LAST} AS ts_ms, avg(v) AS value FROM (SELECT usr, arg_max(value, ts_ms) AS v {ROWS} WHERE metric = 'click' AND ts_ms > {LAST - 2 * DAY} GROUP BY usr) HAVING count(*) > 0", ())
add(
    "store_range", lambda s, d: filled(s, d).range("click:1", FIRST, LAST).select("ts_ms", shown_value(F.col("value")).alias("value")),
    f"SELECT ts_ms, {sql_value()} AS value {ROWS} WHERE metric = 'click' AND usr = '1'",
)
