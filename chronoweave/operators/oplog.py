"""Query log, active queries and the cache of results. They belong to the driver's session, not to the data."""

from __future__ import annotations

import itertools
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arguments import human_duration

TOP_K, MAX_LIFETIME_MS = 20, 24 * 3_600_000
#: Runs remembered, and results kept.
KEPT_RUNS, KEPT_RESULTS = 20_000, 32
RUNS = "query string, range_ms bigint, at_ms bigint, seconds double"


@dataclass(frozen=True)
class Active:
    id: int
    query: str
    start: int
    end: int
    step: int
    since: float

    def row(self) -> dict:
        ms = (time.time() - self.since) * 1000
        return {"id": f"{self.id:016X}", "query": self.query, "start": self.start, "end": self.end, "step": self.step, "duration": human_duration(ms)}


class QueryLog:
    def __init__(self) -> None:
        self._runs: deque[tuple[str, int, int, float]] = deque(maxlen=KEPT_RUNS)
        self._active: dict[int, Active] = {}
        self._ids, self._lock = itertools.count(1), threading.Lock()

    @contextmanager
    def running(self, query: str, start: int, end: int, step: int) -> Iterator[None]:
        began = time.time()
        with self._lock:
            own = next(self._ids)
            self._active[own] = Active(own, query, start, end, step, began)
        try:
            yield
        finally:
            with self._lock:
                del self._active[own]
                self._runs.append((query, end - start, int(began * 1000), time.time() - began))

    def active(self) -> list[dict]:
        with self._lock:
            return [a.row() for a in self._active.values()]

    def record(self, query: str, range_ms: int, at_ms: int, seconds: float) -> None:
        with self._lock:
            self._runs.append((query, range_ms, at_ms, seconds))

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = list(self._runs)
        return spark.createDataFrame(rows, RUNS)

    def top(self, spark: SparkSession, k: int = TOP_K, max_lifetime_ms: int = MAX_LIFETIME_MS, now: int | None = None) -> dict[str, list[dict]]:
        """The k queries most often run, slowest on average, and slowest in sum, of the last max_lifetime_ms."""
        now = int(time.time() * 1000) if now is None else now
        per = self.frame(spark).where(F.col("at_ms") >= now - max_lifetime_ms).groupBy("query", "range_ms").agg(F.count("*").alias("count"), F.avg("seconds").alias("avg"), F.sum("seconds").alias("sum")).cache()
        show = {"topByCount": ("count", lambda r: {"count": r["count"]}), "topByAvgDuration": ("avg", lambda r: {"avgDurationSeconds": round(r["avg"], 3), "count": r["count"]}), "topBySumDuration": ("sum", lambda r: {"sumDurationSeconds": round(r["sum"], 3), "count": r["count"]})}
        try:
            return {n: [{"query": r["query"], "timeRangeSeconds": r["range_ms"] // 1000, **f(r)} for r in per.orderBy(F.desc(c), "query", "range_ms").limit(k).collect()] for n, (c, f) in show.items()}
        finally:
            per.unpersist()


class ResultCache:
    """Results kept by (query, start, end, step, version of the data); the one unused longest goes first."""

    def __init__(self, enabled: bool = True, size: int = KEPT_RESULTS):
        self.enabled, self.size = enabled, size
        self._kept: OrderedDict[tuple, DataFrame] = OrderedDict()

    def get(self, key: tuple, make) -> DataFrame:
        if not self.enabled:
            return make()
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        df = self._kept[key] = make().persist()
        if len(self._kept) > self.size:
            self._kept.popitem(last=False)[1].unpersist()
        return df

    def __len__(self) -> int:
        return len(self._kept)

    def reset(self) -> None:
        if not self.enabled:
            raise ValueError("the rollup result cache is disabled")
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
