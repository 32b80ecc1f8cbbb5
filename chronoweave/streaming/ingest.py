"""Ingest streams. A stream has series_id (or another key), ts_ms and value; ``at`` is ts_ms as a timestamp. Spark takes
what isn't after 1970-01-01T00:00Z for late."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import SeriesStore


def with_event_time(stream: DataFrame) -> DataFrame:
    return stream.withColumn("at", F.timestamp_millis("ts_ms"))


def sink(stream: DataFrame, store: SeriesStore, checkpoint: str, name: str = "ingest") -> DataStreamWriter:
    """A writer of series_id, ts_ms, value (and seq, if the order of arrival in a batch is known) into the store: each
    micro-batch is one append, by the rules of each series. The batch's number takes effect together with its samples, so
    after a restart a batch is taken once, whatever the policy."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
        store.append(rows, name, number)
        store.clear_staging()

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)


def without_duplicates(stream: DataFrame, late: str = "1 hour", key: str = "series_id") -> DataFrame:
    """One sample for each series and timestamp, the first that comes; state is kept for ``late`` and then dropped."""
    return with_event_time(stream).withWatermark("at", late).dropDuplicatesWithinWatermark([key, "ts_ms"])


def accepted_stream(stream: DataFrame, interval_ms: int, key: str = "series_id", idle: str = "1 day") -> DataFrame:
    """Samples that come no less than the interval after the last accepted one of their series: one number of state a
    series, which goes when the series has been silent for ``idle`` of event time. Rows of a micro-batch are taken in
    order of time."""
    kind = stream.schema[key].dataType.simpleString()
    idle_ms = interval_to_ms(idle)

    def run(keys: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat([f for f in frames if len(f)]).sort_values("ts_ms", kind="stable")
        keep = []
        for t in rows["ts_ms"]:
            ok = last is None or t - last >= interval_ms
            keep.append(ok)
            if ok:
                last = int(t)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last) + idle_ms)
        yield rows.loc[keep, [key, "ts_ms", "value"]]

    return (
        with_event_time(stream).withWatermark("at", idle).groupBy(key)
        .applyInPandasWithState(run, f"`{key}` {kind}, ts_ms bigint, value double", "last bigint", "append", "EventTimeTimeout")
    )


def interval_to_ms(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
