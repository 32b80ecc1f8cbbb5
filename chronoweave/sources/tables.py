"""Tables read as time series: columns stand for labels, so selectors reach the scan as predicates on columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, labels_key
from ..operators.selectors import Selector, predicate


@dataclass
class TableSource:
    """labels: label name -> column (NAME among them). stored_ts: the timestamp column as it is stored, whose bounds
    Parquet can skip row groups by (a bound on a computed ts_ms can't be pushed down)."""

    df: DataFrame
    labels: dict[str, Column]
    ts_ms: Column
    value: Column
    stored_ts: str | None = None

    def scan(self, selectors: Sequence[Selector], start: int, end: int, keep: Sequence[str] | None = None) -> DataFrame:
        """(lk, ts_ms, value) of the selected series within [start, end]. keep: the only labels the plan needs; the
        label string is then built from the columns once all series identity is settled, so pass it only if the
        result is grouped by them at once."""
        df = self.df
        if self.stored_ts:
            at = lambda ms: F.lit(datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)).cast(df.schema[self.stored_ts].dataType)
            # the stored column may be finer than ms: what truncates to ``end`` lies before end + 1
            df = df.where((F.col(self.stored_ts) >= at(max(start, -62_000_000_000_000))) & (F.col(self.stored_ts) < at(min(end + 1, 253_402_300_799_000))))
        absent = F.lit("")
        df = df.where(predicate(selectors, lambda n: F.coalesce(self.labels[n].cast("string"), F.lit("")) if n in self.labels else absent, self.labels.get))
        labels = {n: c for n, c in self.labels.items() if keep is None or n in keep}
        return df.select(labels_key(labels).alias("lk"), self.ts_ms.alias("ts_ms"), self.value.cast("double").alias("value")).where(F.col("ts_ms").between(start, end))

    def series(self) -> DataFrame:
        """lk, first_ts, last_ts, n of each series."""
        rows = self.df.select(labels_key(self.labels).alias("lk"), self.ts_ms.alias("ts_ms"))
        return rows.groupBy("lk").agg(F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.count("*").alias("n"))


def ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def events_source(spark: SparkSession, path: str) -> TableSource:
    """events: the metric is the event type, label user is the user id."""
    df = spark.read.parquet(f"{path}/events.parquet")
    return TableSource(df, {NAME: F.col("event_type"), "user": F.col("user_id").cast("string")}, ms("ts"), F.col("value"), "ts")


def orders_source(spark: SparkSession, path: str) -> TableSource:
    """orders: metric order_value with labels status and priority. Several orders share a timestamp."""
    df = spark.read.parquet(f"{path}/orders.parquet")
    labels = {NAME: F.lit("order_value"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    return TableSource(df, labels, ms("o_orderdate"), F.col("o_totalprice"), "o_orderdate")
