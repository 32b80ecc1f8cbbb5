"""The engine over a stored folder: series by key, ingest, ranges, queries, metadata, deletes, maintenance.

Batches are the fast path (``add_batch``, streams); single commands are batches of one row."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.arguments import LATEST, LOOKBACK_MS, DuplicatePolicy, now_ms, parse_chunk_size, range_bounds
from .model import NAME, SERIES
from .operators import ingest, metadata
from .operators.buckets import range_query
from .operators.oplog import QueryLog, ResultCache
from .operators.scan import overlapping
from .operators.selectors import Selector
from .plans import planner
from .plans.parser import parse_selector
from .sources.store import SeriesStore, with_identity


class SeriesExists(ValueError):
    """The key, or a series with the same name and labels, is there already."""


class NoSuchSeries(KeyError):
    """No series has this key."""


@dataclass(frozen=True)
class SeriesOptions:
    """None: not given. A series without them keeps everything, and the last of several values at a timestamp."""

    metric: str | None = None
    labels: dict[str, str] = field(default_factory=dict)
    retention_ms: int | None = None
    dedupe_ms: int | None = None
    dup_policy: str | None = None
    sig_digits: int | None = None
    chunk_size: int | None = None

    def __post_init__(self) -> None:
        if self.sig_digits is not None and not 0 <= self.sig_digits <= 16:
            raise ValueError("significant digits must be from 0 to 16")
        if self.chunk_size is not None:
            parse_chunk_size(self.chunk_size)
        for name in ("retention_ms", "dedupe_ms"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")

    def row(self, db: int, key: str) -> tuple:
        """A row of the table of series, without its id. A label __name__ is the metric's name."""
        labels = {k: v for k, v in self.labels.items() if v != ""}
        metric = self.metric or labels.pop(NAME, "")
        labels.pop(NAME, None)
        policy = DuplicatePolicy.parse(self.dup_policy or "last").value
        return db, key, metric, labels, self.retention_ms or 0, self.dedupe_ms or 0, policy, self.sig_digits or 0, self.chunk_size or 4096


_ROW = ", ".join(c for c in SERIES.split(", ") if not c.startswith("series_id"))


def identified(rows: DataFrame) -> DataFrame:
    """Rows of the table of series with ids: a hash of database and labels, or of the key where there are neither
    name nor labels."""
    named = with_identity(rows)
    own = F.when(F.col("lk") == "", F.concat(F.lit("\0"), F.col("key"))).otherwise(F.col("lk"))
    return named.withColumn("series_id", F.xxhash64("db", own)).drop("lk")


class Engine:
    def __init__(self, spark: SparkSession, path: str, db: int = 0, clock: Callable[[], int] = now_ms, cache: bool = True, lookback: int = LOOKBACK_MS, slot_days: int = 1):
        self.spark, self.store, self.db, self.clock, self.lookback = spark, SeriesStore(spark, path, slot_days), db, clock, lookback
        self.log, self.cache, self._changes = QueryLog(), ResultCache(cache), 0

    # ---- series
    def series(self) -> DataFrame:
        return self.store.series().where(F.col("db") == self.db)

    def _row(self, key: str):
        got = self.series().where(F.col("key") == key).limit(1).collect()
        if not got:
            raise NoSuchSeries(key)
        return got[0]

    def exists(self, key: str) -> bool:
        return bool(self.series().where(F.col("key") == key).limit(1).count())

    def create_series(self, key: str, options: SeriesOptions | None = None) -> int:
        rows = self.spark.createDataFrame([(options or SeriesOptions()).row(self.db, key)], _ROW)
        if self.create_many(rows) != 1:
            raise SeriesExists(key)
        return self._row(key)["series_id"]

    def create_many(self, rows: DataFrame) -> int:
        """Rows of the table of series without ids. Those whose key or whose name and labels are there already, or
        come twice in ``rows``, are left out. Returns how many are new."""
        have = self.store.series()
        fresh = identified(rows.where(F.col("db") == self.db)).join(have.select("db", "key"), ["db", "key"], "left_anti").join(have.select("series_id"), "series_id", "left_anti")
        fresh = self.store.staged(fresh)
        n, keys, ids = fresh.agg(F.count("*"), F.count_distinct("key"), F.count_distinct("series_id")).first()
        if n > min(keys, ids):  # only then: whole rows, with their maps, are sorted for it
            fresh = self.store.staged(fresh.dropDuplicates(["key"]).dropDuplicates(["series_id"]))
            n = fresh.count()
        if n:
            self._save(have.unionByName(fresh))
        return n

    def _save(self, series: DataFrame) -> None:
        self.store.save_series(series)
        self._changes += 1

    def alter_series(self, key: str, options: SeriesOptions) -> None:
        """Given options take the place of the old ones; the dedupe interval does even if it isn't given. Labels are
        added, or replaced by name. The series keeps its id."""
        self._row(key)
        mine = (F.col("db") == self.db) & (F.col("key") == key)
        labels = {k: v for k, v in options.labels.items() if k != NAME}
        metric = options.metric or options.labels.get(NAME)
        new: dict[str, object] = {"retention_ms": options.retention_ms, "sig_digits": options.sig_digits, "chunk_size": options.chunk_size, "metric": metric, "dup_policy": DuplicatePolicy.parse(options.dup_policy).value if options.dup_policy else None}
        out = self.store.series().withColumn("dedupe_ms", F.when(mine, F.lit(options.dedupe_ms or 0).cast("bigint")).otherwise(F.col("dedupe_ms")))
        for name, value in new.items():
            if value is not None:
                out = out.withColumn(name, F.when(mine, F.lit(value).cast(out.schema[name].dataType)).otherwise(F.col(name)))
        if labels:
            added = F.create_map(*[F.lit(x) for k, v in labels.items() if v != "" for x in (k, v)]) if any(labels.values()) else F.create_map().cast("map<string,string>")
            kept = F.map_filter("labels", lambda k, v: ~k.isin(list(labels)))
            out = out.withColumn("labels", F.when(mine, F.map_concat(kept, added)).otherwise(F.col("labels")))
        self._save(out)

    def rename_series(self, key: str, new: str) -> None:
        self._row(key)
        if self.exists(new):
            raise SeriesExists(new)
        self._save(self.store.series().withColumn("key", F.when((F.col("db") == self.db) & (F.col("key") == key), new).otherwise(F.col("key"))))

    def copy_series(self, key: str, new: str, db: int | None = None) -> int:
        """A series of its own, with the same labels, options and samples. Its id is made from its key, since the
        labels' is taken."""
        row = self._row(key)
        to = self.db if db is None else db
        if self.store.series().where((F.col("db") == to) & (F.col("key") == new)).limit(1).count():
            raise SeriesExists(new)
        mine = self.store.series().where((F.col("db") == self.db) & (F.col("key") == key)).withColumn("key", F.lit(new)).withColumn("db", F.lit(to))
        copy = self.store.staged(mine.withColumn("series_id", F.xxhash64(F.lit("copy"), "db", "key")))
        self._save(self.store.series().unionByName(copy))
        new_id = copy.first()["series_id"]
        rows = self.store.samples().where(F.col("series_id") == row["series_id"]).select(F.lit(new_id).cast("bigint").alias("series_id"), "ts_ms", "value", F.col("ts_ms").alias("seq"))
        self.store.append(rows)
        return new_id

    def find(self, metric: str, labels: dict[str, str]) -> int | None:
        """The id of the series with this name and exactly these labels; several are an error."""
        wanted = with_identity(self.spark.createDataFrame([(metric, labels)], "metric string, labels map<string,string>")).select("lk")
        got = with_identity(self.series()).join(wanted, "lk").select("series_id").limit(2).collect()
        if len(got) > 1:
            raise ValueError("more than one series has these labels")
        return got[0][0] if got else None

    def flush(self) -> None:
        """Empty the database: its series and samples go."""
        self.delete_ids(self.series().select("series_id"))

    # ---- ingest
    def add(self, key: str, ts_ms: int, value: float, options: SeriesOptions | None = None) -> int:
        if not self.exists(key):
            self.create_series(key, options)
        elif options is not None:
            raise ValueError("options are only taken when a series is created")
        status = self.add_many([(key, ts_ms, value)])[0]
        if status != "ok":
            raise ValueError(status)
        return ts_ms

    def add_many(self, items: Sequence[tuple[str, int, float]]) -> list[str]:
        """One status for each (key, ts, value); an item that fails doesn't stop the others; keys aren't created."""
        rows = self.spark.createDataFrame([(k, int(t), float(v), i) for i, (k, t, v) in enumerate(items)], "key string, ts_ms bigint, value double, seq bigint")
        got = {r["seq"]: r["status"] for r in self.add_batch(rows).select("seq", "status").collect()}
        return [got[i] for i in range(len(items))]

    def add_batch(self, rows: DataFrame) -> DataFrame:
        """rows: key, ts_ms, value, seq. Returns series_id, ts_ms, seq, status of each row (stored)."""
        batch = rows.select("key", "ts_ms", "value", "seq").join(ingest.options(self.series(), "key"), "key", "left").drop("key")
        # an unknown key has no id; a hash no series has keeps such rows apart
        status = self.store.append(batch.withColumn("series_id", F.coalesce("series_id", F.xxhash64(F.lit("unknown"), "seq"))))
        self._changes += 1
        return status

    # ---- reads
    def get(self, key: str) -> tuple[int, float] | None:
        """(timestamp, value) of the newest sample."""
        row = self._row(key)
        last = self.store.spans().where(F.col("series_id") == row["series_id"]).agg(F.max("last_ts").alias("t"), F.max_by("last_value", "last_ts").alias("v")).first()
        return (last["t"], last["v"]) if last["t"] is not None else None

    def range(self, key: str, start: int, end: int, **options: object) -> DataFrame:
        """(ts_ms, value) in order; options as in operators.buckets.range_query."""
        row = self._row(key)
        rows = self.store.samples().where(F.col("series_id") == row["series_id"])
        by_ts = options.get("by_ts")
        if by_ts is None and not options.get("retention_ms"):
            rows = rows.where(F.col("day").between(start // self.store.slot_ms, end // self.store.slot_ms))
        got = range_query(rows.select("series_id", "ts_ms", "value"), start, end, by=("series_id",), **options)
        return got.select("ts_ms", "value").orderBy("ts_ms")

    def first_and_last(self, key: str) -> tuple[int, int]:
        """Bounds that ``-`` and ``+`` stand for."""
        row = self._row(key)
        r = self.store.spans().where(F.col("series_id") == row["series_id"]).agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("b")).first()
        return (r["a"], r["b"]) if r["a"] is not None else (0, LATEST)

    def query(self, text: str, time: int | None = None, rounding: int | None = None) -> DataFrame:
        """An instant query: (lk, ts_ms, value). Only results at a given time are kept: "now" never comes again."""
        at = self.clock() if time is None else time
        make = lambda: planner.query(self.spark, self.store.source(self.db), text, at, self.lookback, rounding)
        return make() if time is None else self.cache.get((self._changes, text, at, rounding), make)

    def query_range(self, text: str, start: int | None = None, end: int | None = None, step: int = LOOKBACK_MS, rounding: int | None = None) -> DataFrame:
        given = start is not None and end is not None
        start, end = range_bounds(start, end, self.clock())
        make = lambda: planner.query_range(self.spark, self.store.source(self.db), text, start, end, step, self.lookback, rounding)
        return self.cache.get((self._changes, text, start, end, step, rounding), make) if given else make()

    # ---- metadata
    def spans(self) -> DataFrame:
        return self.store.source(self.db).series()

    def matching(self, selectors: Sequence[str | Selector], start: int | None = None, end: int | None = None) -> DataFrame:
        """Matching series with a sample in [start, end] (without bounds: all). That no series matches at all is an
        error; that none has samples there isn't."""
        parsed = [s if isinstance(s, Selector) else parse_selector(s) for s in selectors]
        found = metadata.require(metadata.matching(self.spans(), parsed))
        if start is None and end is None:
            return found
        return overlapping(found, 0 if start is None else start, LATEST if end is None else end)

    def info(self, key: str) -> dict:
        row = self._row(key)
        mine = self.series().where(F.col("key") == key)
        got = metadata.series_info(mine, self.store.samples().where(F.col("series_id") == row["series_id"])).first()
        return got.asDict()

    def stats(self, limit: int = metadata.TOP) -> dict[str, object]:
        if limit < 1:
            raise ValueError("LIMIT must be greater than 0")
        s = self.spans()
        pairs = lambda df, a, b: [(r[a], r[b]) for r in df.collect()]  # noqa: E731  at most ``limit`` rows
        return {
            "totalSeries": s.count(),
            "seriesCountByMetricName": pairs(metadata.series_by_metric(s, limit), "metric", "n"),
            "labelValueCountByLabelName": pairs(metadata.values_by_label(s, limit), "name", "n"),
            "seriesCountByLabelPair": pairs(metadata.series_by_pair(s, limit), "pair", "n"),
            "memoryInBytesByLabelName": pairs(metadata.bytes_by_label(s, limit), "name", "bytes"),
        }

    # ---- deletes and maintenance
    def _ids(self, selectors: Iterable[str]) -> DataFrame:
        return self.store.source(self.db).selected([parse_selector(s) for s in selectors]).select("series_id")

    def delete_range(self, selectors: Iterable[str], start: int = 0, end: int = LATEST) -> int:
        if start > end:
            raise ValueError("start must not be after end")
        ids = metadata.require(self._ids(selectors))
        self._changes += 1
        return self.store.delete_range(ids, start, end)

    def delete_key_range(self, key: str, start: int, end: int) -> int:
        if start > end:
            raise ValueError("start must not be after end")
        row = self._row(key)
        self._changes += 1
        return self.store.delete_range(self.series().where(F.col("series_id") == row["series_id"]), start, end)

    def delete_series(self, selectors: Iterable[str]) -> int:
        return self.delete_ids(metadata.require(self._ids(selectors)))

    def delete_keys(self, *keys: str) -> int:
        return self.delete_ids(self.series().where(F.col("key").isin(list(keys))).select("series_id"))

    def delete_ids(self, ids: DataFrame) -> int:
        self._changes += 1
        return self.store.delete_series(ids)

    def key_event(self, kind: str, *keys: str) -> int:
        """What the host of the keys reports: ``del``, ``unlink``, ``expired`` and ``evicted`` keys lose their series and
        samples, ``rename`` gives (old key, new key), ``flush`` empties the database. Keys that aren't series are left
        alone. Returns how many series are concerned."""
        kind = kind.lower()
        if kind in ("del", "unlink", "expire", "expired", "evict", "evicted", "trimmed"):
            return self.delete_keys(*keys) if keys else 0
        if kind == "rename":
            old, new = keys
            if not self.exists(old):
                return 0
            if self.exists(new):  # the key it takes is overwritten
                self.delete_keys(new)
            self.rename_series(old, new)
            return 1
        if kind in ("flush", "flushdb"):
            n = self.series().count()
            self.flush()
            return n
        raise ValueError(f"unknown key event {kind!r}")

    def compact(self) -> None:
        self.store.compact()
        self._changes += 1

    def snapshot(self, path: str) -> None:
        """All databases' series and samples as a folder of the same kind."""
        SeriesStore(self.spark, path, self.store.slot_ms // 86_400_000).save(self.store.series(), self.store.samples(), self.store.spans())

    def restore(self, path: str) -> None:
        other = SeriesStore(self.spark, path)
        self.store.save(other.series(), other.samples(), other.spans() if other.slot_ms == self.store.slot_ms else None)
        self._changes += 1

    def in_db(self, db: int) -> Engine:
        """The same folder, another namespace."""
        other = copy.copy(self)
        other.db, other.cache = db, ResultCache(self.cache.enabled)
        return other
