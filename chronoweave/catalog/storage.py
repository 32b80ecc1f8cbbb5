"""Queries for selectors, ranges, metadata, ingest and deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to_decimal_digits, round_to_significant_digits
from ..model import NAME, full_name, label
from ..operators import deletes, ingest, metadata
from ..operators.buckets import AGGREGATORS, Aggregation, range_query
from ..operators.results import matrix, vector
from ..operators.scan import last_sample
from ..operators.selectors import predicate
from ..plans.parser import parse_selector
from ..sources import events_source, orders_source
from .base import DAY, FIRST, LAST, SAMPLES, add, shown, shown_value, sql_shown, sql_value

HOUR = 3_600_000
A, B = FIRST, LAST
#: A part of it, where the bounds are what a query is about.
PART_A, PART_B = FIRST + 5 * DAY, FIRST + 12 * DAY
#: Order dates: 1 to 4 June 1995.
STAMPS = tuple(801_964_800_000 + k * DAY for k in range(4))
#: user as text, so that a value may be compared with none.
ROWS = f"FROM ({SAMPLES})"


def scanned(spark: SparkSession, sf_dir: str, *selectors: str, start: int = FIRST, end: int = LAST) -> DataFrame:
    return events_source(spark, sf_dir).scan([parse_selector(s) for s in selectors], start, end)


# orders of one status and priority share timestamps; they arrive by their key
def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = orders_source(spark, sf_dir)
    return src.df.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), src.ts_ms.alias("ts_ms"), src.value.alias("value"), F.col("o_orderkey").alias("seq"))


ORDERS = "(SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value, o_orderkey AS seq FROM orders)"
_BY = ("status", "priority", "ts_ms")


# ---- selectors: name -> (selectors, condition)
SELECTORS: dict[str, tuple[tuple[str, ...], str]] = {
    "eq": (("click",), "metric = 'click'"),
    "eq_two": (('click{user="7"}',), "metric = 'click' AND usr = '7'"),
    "ne": (('click{user!="7"}',), "metric = 'click' AND usr <> '7'"),
    "re": (('{__name__=~"cl.*|.*or"}',), "regexp_full_match(metric, 'cl.*|.*or')"),
    "nre": (('click{user!~"1.*"}',), "metric = 'click' AND NOT regexp_full_match(usr, '1.*')"),
    "re_literals": (('{__name__=~"click|view"}',), "metric IN ('click', 'view')"),
    "re_prefix": (('click{user=~"1.*"}',), "metric = 'click' AND usr LIKE '1%'"),
    "re_suffix": (('click{user=~".*7"}',), "metric = 'click' AND usr LIKE '%7'"),
    "re_class": (('click{user=~"[1-3][0-9]"}',), "metric = 'click' AND regexp_full_match(usr, '[1-3][0-9]')"),
    "not_empty": (('click{user!=""}',), "metric = 'click' AND usr <> ''"),
    "absent_label": (('click{team=""}',), "metric = 'click'"),
    "absent_label_ne": (('click{team!="a"}',), "metric = 'click'"),
    "match_none": (('click{team="a"}',), "false"),
    "match_all": (('{__name__=~".+"}',), "true"),
    "or": (('{__name__="click", user="1" or __name__="view", user="2"}',), "(metric = 'click' AND usr = '1') OR (metric = 'view' AND usr = '2')"),
    "several": (('click{user="1"}', 'view{user=~"2.*"}'), "(metric = 'click' AND usr = '1') OR (metric = 'view' AND usr LIKE '2%')"),
    "none_given": ((), "false"),
}
for _n, (_texts, _where) in SELECTORS.items():
    add(f"sel_{_n}", lambda s, d, t=_texts: shown(scanned(s, d, *t)), sql_shown(f"SELECT metric, usr, ts_ms, value {ROWS} WHERE {_where}"))


# ---- ranges
def ranged(name: str, sql: str, selector: str = "click", labels: tuple[str, ...] = ("user",), digits: int = 6, **options: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        start, end = options.get("start", A), options.get("end", B)
        rest = {k: v for k, v in options.items() if k not in ("start", "end")}
        # a retention is measured from the newest sample of all, so the scan isn't cut to the range then
        rows = scanned(spark, sf_dir, selector, start=FIRST if "retention_ms" in rest or "by_ts" in rest else start, end=LAST if "retention_ms" in rest or "by_ts" in rest else end)
        return shown(range_query(rows, start, end, scale=2, **rest), labels, digits)

    add(name, run, sql_shown(sql, labels, digits))


CLICKS = f"{ROWS} WHERE metric = 'click' AND ts_ms BETWEEN {A} AND {B}"
ranged("range_raw", f"SELECT usr, ts_ms, value {CLICKS}")
ranged("range_part", f"SELECT usr, ts_ms, value {ROWS} WHERE metric = 'click' AND ts_ms BETWEEN {PART_A} AND {PART_B}", start=PART_A, end=PART_B)
ranged("range_filter_value", f"SELECT usr, ts_ms, value {CLICKS} AND value BETWEEN 10 AND 50", by_value=(10, 50))
add(
    "range_filter_ts",  # order dates repeat, so fixed timestamps pick rows at every size
    lambda s, d: range_query(orders(s, d), FIRST, LAST, by=("status", "priority"), by_ts=STAMPS).select("status", "priority", "ts_ms", shown_value(F.col("value"), 4).alias("value")),
    f"SELECT status, priority, ts_ms, {sql_value('value', 4)} AS value FROM {ORDERS} WHERE ts_ms IN {STAMPS}",
)
ranged("range_count", f"SELECT usr, ts_ms, value {CLICKS} QUALIFY row_number() OVER (PARTITION BY usr ORDER BY ts_ms) <= 2", count=2)
ranged("range_retention", f"SELECT usr, ts_ms, value FROM (SELECT *, max(ts_ms) OVER (PARTITION BY usr) AS last {ROWS} WHERE metric = 'click') WHERE ts_ms BETWEEN {A} AND {LAST} AND ts_ms >= last - {7 * DAY}", retention_ms=7 * DAY)


def bucket(width: int, align: int = 0) -> str:
    """floorMod, and never below 0."""
    return f"greatest(ts_ms - (((ts_ms - {align}) % {width}) + {width}) % {width}, 0)"


#: Exact sums of hundredths, then the two-sum formula.
_C = "value::DECIMAL(18, 2)"
_M2 = f"greatest(sum({_C} * {_C})::DOUBLE - 2.0 * sum({_C})::DOUBLE * (sum({_C})::DOUBLE / count(*)) + (sum({_C})::DOUBLE / count(*)) * (sum({_C})::DOUBLE / count(*)) * count(*), 0.0)"
_OF_ALL = {
    "first": "arg_min(value, ts_ms)", "last": "arg_max(value, ts_ms)", "min": "min(value)", "max": "max(value)", "avg": f"sum({_C})::DOUBLE / count(*)", "sum": f"sum({_C})::DOUBLE", "count": "count(*)",
    "range": "max(value) - min(value)", "std.p": f"sqrt({_M2} / count(*))", "var.p": f"{_M2} / count(*)",
    "std.s": f"CASE WHEN count(*) = 1 THEN 0 ELSE sqrt({_M2} / nullif(count(*) - 1, 0)) END", "var.s": f"CASE WHEN count(*) = 1 THEN 0 ELSE {_M2} / nullif(count(*) - 1, 0) END",
}
for _f in AGGREGATORS:
    ranged(f"bucket_{_f.replace('.', '')}", f"SELECT usr, {bucket(2 * DAY)} AS ts_ms, {_OF_ALL[_f]} AS value {CLICKS} GROUP BY ALL", digits=4 if "." in _f else 6, aggregation=Aggregation(_f, 2 * DAY))
for _n, _align, _at in (("start", "start", A), ("minus", "-", A), ("end", "end", B), ("ts", 12_345, 12_345)):
    ranged(f"bucket_align_{_n}", f"SELECT usr, {bucket(36 * HOUR, _at)} AS ts_ms, {_OF_ALL['sum']} AS value {CLICKS} GROUP BY ALL", align=_align, aggregation=Aggregation("sum", 36 * HOUR))
for _n, _shift in (("mid", DAY), ("end", 2 * DAY)):
    ranged(f"bucket_label_{_n}", f"SELECT usr, {bucket(2 * DAY)} + {_shift} AS ts_ms, {_OF_ALL['max']} AS value {CLICKS} GROUP BY ALL", aggregation=Aggregation("max", 2 * DAY, label=_n))
ranged("bucket_clamped", f"SELECT usr, {bucket(40_000 * DAY, 3 * DAY)} AS ts_ms, count(*) AS value {CLICKS} GROUP BY ALL", align=3 * DAY, aggregation=Aggregation("count", 40_000 * DAY))


def _filled(f: str, empty: str, then: str = "") -> str:
    return f"""WITH b AS (SELECT usr, {bucket(DAY)} AS ts_ms, {_OF_ALL[f]} AS value {CLICKS} GROUP BY ALL),
    every AS (SELECT usr, unnest(range(lo, hi + 1, {DAY}))::BIGINT AS ts_ms FROM (SELECT usr, min(ts_ms) AS lo, max(ts_ms) AS hi FROM b GROUP BY usr))
    SELECT usr, ts_ms, coalesce(value, {empty}) AS value FROM every LEFT JOIN b USING (usr, ts_ms) {then}"""


for _f, _empty in (("sum", "0"), ("count", "0"), ("avg", "'nan'::DOUBLE"), ("first", "'nan'::DOUBLE")):
    ranged(f"bucket_empty_{_f}", _filled(_f, _empty), aggregation=Aggregation(_f, DAY, empty=True))
ranged("bucket_count_limit", _filled("sum", "0", "QUALIFY row_number() OVER (PARTITION BY usr ORDER BY ts_ms) <= 3"), count=3, aggregation=Aggregation("sum", DAY, empty=True))
ranged(
    "bucket_filtered", f"SELECT metric, usr, {bucket(DAY)} AS ts_ms, {_OF_ALL['avg']} AS value {ROWS} WHERE metric IN ('click', 'view') AND value BETWEEN 5 AND 100 AND ts_ms BETWEEN {A} AND {B} GROUP BY ALL",
    selector='{__name__=~"click|view"}', labels=(NAME, "user"), by_value=(5, 100), aggregation=Aggregation("avg", DAY),
)
add(
    "bucket_by_metric",
    lambda s, d: range_query(scanned(s, d, '{__name__!=""}').withColumn("metric", label(F.col("lk"), NAME)), FIRST, LAST, by=("metric",), scale=2, aggregation=Aggregation("avg", 6 * HOUR)).select("metric", "ts_ms", shown_value(F.col("value")).alias("value")),
    sql_shown(f"SELECT metric, {bucket(6 * HOUR)} AS ts_ms, {_OF_ALL['avg']} AS value {ROWS} GROUP BY ALL", (NAME,)),
)
add("last_point", lambda s, d: shown(last_sample(scanned(s, d, '{__name__!=""}'))), sql_shown(f"SELECT metric, usr, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value {ROWS} GROUP BY ALL"))

# ---- results
_NAME = "metric || '{user=\"' || usr || '\"}'"
add(
    "result_matrix",
    lambda s, d: matrix(scanned(s, d, "click", start=A, end=B)).select(F.col("metric")["user"].alias("usr"), F.size("values").cast("bigint").alias("n"), F.array_join(F.transform("values", lambda x: x["ts_ms"].cast("string")), " ").alias("at")),
    f"SELECT usr, count(*) AS n, string_agg(ts_ms::VARCHAR, ' ' ORDER BY ts_ms) AS at {CLICKS} GROUP BY usr",
)
add(
    "result_vector",
    lambda s, d: vector(scanned(s, d, "click")).select(F.col("metric")["user"].alias("usr"), "ts_ms", shown_value(F.col("value")).alias("value")),
    f"SELECT usr, max(ts_ms) AS ts_ms, {sql_value('arg_max(value, ts_ms)')} AS value {ROWS} WHERE metric = 'click' GROUP BY usr",
)
add("full_names", lambda s, d: events_source(s, d).series().select(full_name(F.col("lk")).alias("series")), f"SELECT DISTINCT {_NAME} AS series {ROWS}")


# ---- metadata
def series(spark: SparkSession, sf_dir: str, *selectors: str, start: int = A, end: int = B) -> DataFrame:
    return metadata.matching(events_source(spark, sf_dir).series(), [parse_selector(s) for s in selectors], start, end)


_S = f"(SELECT metric, usr, min(ts_ms) AS lo, max(ts_ms) AS hi {ROWS} GROUP BY ALL) WHERE hi >= {A} AND lo <= {B}"
CLICK_VIEW = '{__name__=~"click|view"}'
_CV = f"{_S} AND metric IN ('click', 'view')"
_PAIRS = f"(SELECT metric, usr, '__name__' AS name, metric AS value FROM {_S} UNION ALL SELECT metric, usr, 'user', usr FROM {_S})"
EVERY = '{__name__=~".+"}'
add("series_list", lambda s, d: metadata.series_list(series(s, d, CLICK_VIEW)).select("series"), f"SELECT {_NAME} AS series FROM {_CV}")
add("series_limit", lambda s, d: metadata.series_list(series(s, d, CLICK_VIEW), 5).select("series"), f"SELECT {_NAME} AS series FROM {_CV} ORDER BY series LIMIT 5")
add("cardinality", lambda s, d: metadata.cardinality(series(s, d, CLICK_VIEW)), f"SELECT count(*) AS cardinality FROM {_CV}")
add("label_names", lambda s, d: metadata.label_names(series(s, d, CLICK_VIEW)), f"SELECT DISTINCT name FROM {_PAIRS} WHERE value <> ''")
add("label_values", lambda s, d: metadata.label_values(series(s, d, "click"), "user"), f"SELECT DISTINCT usr AS value FROM {_S} AND metric = 'click'")
add("label_values_limit", lambda s, d: metadata.label_values(series(s, d, EVERY), NAME, 3), f"SELECT DISTINCT metric AS value FROM {_S} ORDER BY value LIMIT 3")
add("stats_totals", lambda s, d: metadata.totals(series(s, d, EVERY)), f"SELECT (SELECT count(*) FROM {_S}) AS series, count(DISTINCT name) AS label_names, count(DISTINCT name || '=' || value) AS label_pairs FROM {_PAIRS}")
add("stats_series_by_metric", lambda s, d: metadata.series_by_metric(series(s, d, EVERY)), f"SELECT metric, count(*) AS n FROM {_S} GROUP BY metric ORDER BY n DESC, metric LIMIT 10")
add("stats_values_by_label", lambda s, d: metadata.values_by_label(series(s, d, EVERY)), f"SELECT name, count(DISTINCT value) AS n FROM {_PAIRS} GROUP BY name")
add("stats_series_by_pair", lambda s, d: metadata.series_by_pair(series(s, d, EVERY), 20), f"SELECT name || '=' || value AS pair, count(*) AS n FROM {_PAIRS} GROUP BY ALL ORDER BY n DESC, pair LIMIT 20")
add("stats_bytes_by_label", lambda s, d: metadata.bytes_by_label(series(s, d, EVERY)), f"SELECT name, sum(strlen(value) * (1 + k))::BIGINT AS bytes FROM (SELECT name, value, count(*) AS k FROM {_PAIRS} GROUP BY ALL) GROUP BY name")
add(
    "series_info",
    lambda s, d: scanned(s, d, "click").groupBy("lk").agg(F.count("*").alias("total_samples"), F.min("ts_ms").alias("first_timestamp"), F.max("ts_ms").alias("last_timestamp")).select(full_name(F.col("lk")).alias("series"), "total_samples", "first_timestamp", "last_timestamp"),
    f"SELECT {_NAME} AS series, count(*) AS total_samples, min(ts_ms) AS first_timestamp, max(ts_ms) AS last_timestamp {ROWS} WHERE metric = 'click' GROUP BY ALL",
)


# ---- ingest
def _policy(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: ingest.deduplicate(orders(s, d), policy, _BY).select(*_BY, shown_value(F.col("value"), 4).alias("value"))


for _p, _e in (("block", "arg_min(value, seq)"), ("first", "arg_min(value, seq)"), ("last", "arg_max(value, seq)"), ("min", "min(value)"), ("max", "max(value)"), ("sum", "sum(value)")):
    add(f"dup_{_p}", _policy(_p), f"SELECT status, priority, ts_ms, {sql_value(_e, 4)} AS value FROM {ORDERS} GROUP BY ALL")
add(
    "merge_sorted",
    lambda s, d: ingest.merge_sorted(orders(s, d).where("seq % 2 = 0").groupBy(*_BY).agg(F.max("value").alias("value")), orders(s, d).where("seq % 2 = 1").groupBy(*_BY).agg(F.min("value").alias("value")), "last", None, _BY).select(*_BY, shown_value(F.col("value"), 4).alias("value")),
    f"SELECT status, priority, ts_ms, {sql_value('coalesce(max(value) FILTER (seq % 2 = 0), min(value) FILTER (seq % 2 = 1))', 4)} AS value FROM {ORDERS} GROUP BY ALL",
)
add(
    "retention",
    lambda s, d: shown(ingest.retained(scanned(s, d, '{__name__!=""}'), 7 * DAY)),
    sql_shown(f"SELECT * {ROWS} QUALIFY ts_ms >= max(ts_ms) OVER (PARTITION BY metric, usr) - {7 * DAY}"),
)
# the interval is measured from the last accepted sample, so SQL needs a recursion from one to the next
add(
    "dedupe_interval",
    lambda s, d: shown(ingest.accepted(scanned(s, d, "click").withColumn("dedupe_ms", F.lit(2 * DAY)).withColumn("seq", F.col("ts_ms")))),
    f"""WITH RECURSIVE s AS (SELECT metric, usr, ts_ms, value {ROWS} WHERE metric = 'click'),
    kept AS (SELECT metric, usr, min(ts_ms) AS ts_ms FROM s GROUP BY ALL
      UNION ALL SELECT metric, usr, ts_ms FROM (SELECT s.metric, s.usr, min(s.ts_ms) AS ts_ms FROM kept k JOIN s ON s.metric = k.metric AND s.usr = k.usr AND s.ts_ms - k.ts_ms >= {2 * DAY} GROUP BY s.metric, s.usr))
    SELECT metric, usr, ts_ms, {sql_value()} AS value FROM s SEMI JOIN kept USING (metric, usr, ts_ms)""",
)


def _rounded(f: Callable[[Column, int], Column], digits: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: orders(s, d).select("seq", shown_value(f(F.col("value"), digits), 6).alias("value"))


for _digits in (2, 4):
    add(f"significant_digits_{_digits}", _rounded(round_to_significant_digits, _digits), f"SELECT seq, {sql_value(f'CASE WHEN value = 0 THEN 0 ELSE round(value * pow(10.0, {_digits - 1} - floor(log10(abs(value))))) / pow(10.0, {_digits - 1} - floor(log10(abs(value)))) END')} AS value FROM {ORDERS}")
add("decimal_digits", _rounded(round_to_decimal_digits, 1), f"SELECT seq, {sql_value('round(value::DECIMAL(18, 2), 1)')} AS value FROM {ORDERS}")


# ---- deletes
def _matches(selector: str) -> Column:
    return predicate([parse_selector(selector)], lambda n: label(F.col("lk"), n))


_GONE = f"metric = 'click' AND ts_ms BETWEEN {PART_A} AND {PART_B}"
CLICKED = "click"
add("delete_range", lambda s, d: shown(deletes.delete_range(scanned(s, d, CLICK_VIEW), _matches(CLICKED), PART_A, PART_B)[0]), sql_shown(f"SELECT * {ROWS} WHERE metric IN ('click', 'view') AND NOT ({_GONE})"))
add("delete_range_count", lambda s, d: deletes.delete_range(scanned(s, d, CLICK_VIEW), _matches(CLICKED), PART_A, PART_B)[1].agg(F.count("*").alias("deleted")), f"SELECT count(*) AS deleted {ROWS} WHERE {_GONE}")
add("delete_series", lambda s, d: shown(deletes.delete_series(events_source(s, d).series(), scanned(s, d, CLICK_VIEW), _matches(CLICKED), "lk")[1]), sql_shown(f"SELECT * {ROWS} WHERE metric IN ('click', 'view') AND NOT (metric = 'click')"))
add("delete_series_count", lambda s, d: deletes.delete_series(events_source(s, d).series(), scanned(s, d, CLICK_VIEW), _matches(CLICKED), "lk")[2].agg(F.count("*").alias("deleted")), f"SELECT count(*) AS deleted FROM (SELECT DISTINCT metric, usr {ROWS} WHERE metric = 'click')")
