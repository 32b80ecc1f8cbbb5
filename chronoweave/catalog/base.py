"""What the registered queries share: the tables as series, the grid, how results are shown, and the SQL of the same.

Shown numbers are rounded after a shift of a third of a unit: sums of doubles depend on their order in the last bits,
and without the shift fractions such as x/8 would stand exactly where rounding goes one way or the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, label
from ..plans.planner import query_range
from ..sources import TableSource, events_source

Run = Callable[[SparkSession, str], DataFrame]
DAY = 86_400_000
#: The whole month of events, January 2024, and a point a day over all of it.
FIRST, LAST = 1_704_067_200_000, 1_706_745_599_999
T0, T1, STEP = FIRST, LAST + 1, DAY

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

SAMPLES = "SELECT event_type AS metric, user_id::VARCHAR AS usr, epoch_us(ts) // 1000 AS ts_ms, value FROM events"
GRID = f"grid AS (SELECT unnest(range({T0}, {T1} + 1, {STEP}))::BIGINT AS g)"


def add(name: str, run: Run, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is there twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def shown_value(v: Column, digits: int = 6) -> Column:
    return F.round(v + F.lit(0.33 * 10**-digits), digits)


def sql_value(v: str = "value", digits: int = 6) -> str:
    return f"round(({v})::DOUBLE + {0.33 * 10**-digits!r}, {digits})"


def column_of(name: str) -> str:
    """Labels as columns: the metric's name and user get names that no dialect reserves."""
    return {NAME: "metric", "user": "usr"}.get(name, name)


def shown(df: DataFrame, labels: Sequence[str] = (NAME, "user"), digits: int = 6) -> DataFrame:
    """(lk, ts_ms, value) with labels as columns; a missing one is empty."""
    return df.select(*[label(F.col("lk"), n).alias(column_of(n)) for n in labels], "ts_ms", shown_value(F.col("value"), digits).alias("value"))


def sql_shown(sql: str, labels: Sequence[str] = (NAME, "user"), digits: int = 6) -> str:
    """sql: columns of the labels, ts_ms, value; without NULL values."""
    cols = "".join(f"{column_of(n)}, " for n in labels)
    return f"SELECT {cols}ts_ms, {sql_value('value', digits)} AS value FROM ({sql}) WHERE value IS NOT NULL"


def promql(name: str, text: str, sql: str | None, labels: Sequence[str] = ("user",), digits: int = 6, start: int = T0, end: int = T1, step: int = STEP, lookback: int = 2 * DAY, source: Callable[[SparkSession, str], TableSource] = events_source) -> None:
    """A range query over events and the SQL of its rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(query_range(spark, source(spark, sf_dir), text, start, end, step, lookback), labels, digits)

    run.__doc__ = text
    add(name, run, sql_shown(sql, labels, digits) if sql is not None else None)


def windowed(where: str, days: float, body: str) -> str:
    """body: SQL over w(g, metric, usr, t, v, pt, pv, ok, inside, inc, dv, dt): every sample once for each point whose
    window of so many days holds it, next to its predecessor."""
    d = int(days * DAY)
    return f"""WITH s AS (SELECT * FROM ({SAMPLES}) WHERE {where}), {GRID},
p AS (SELECT *, lag(ts_ms) OVER u AS pt, lag(value) OVER u AS pv FROM s WINDOW u AS (PARTITION BY metric, usr ORDER BY ts_ms)),
w AS (SELECT g, metric, usr, ts_ms AS t, value AS v, pt, pv, coalesce(pt > g - {2 * d}, false) AS ok, coalesce(pt > g - {d}, false) AS inside,
  CASE WHEN value < pv THEN value ELSE value - pv END AS inc, value - pv AS dv, (ts_ms - pt) / 1000.0 AS dt
  FROM p JOIN grid ON ts_ms > g - {d} AND ts_ms <= g)
{body}"""


def last_values(where: str, days: float, body: str) -> str:
    """body: SQL over x(metric, usr, g, v): the newest sample of the last days at each point."""
    return windowed(where, days, f", x AS (SELECT metric, usr, g, arg_max(v, t) AS v FROM w GROUP BY ALL) {body}")
