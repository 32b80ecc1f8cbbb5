"""Stored series and samples as Parquet: samples by day, a small table of what each day holds of each series, and
versions of the table of series.

Files are never changed. Every change writes a new part (and perhaps a new table of series) and then one small manifest
that names what counts from now on: the version of the table of series, the parts of each day, and the last batch of
each stream. The manifest takes effect by one rename, so a writer that dies in between leaves the state before it, and
readers of the state before go on reading it.

A day has a base part and small ones from later appends, whose samples take the place of those before at the same series
and timestamp; they are put together on reading, and for good when a day has MOST_PARTS of them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, SAMPLES, SERIES, map_key
from ..operators import ingest
from ..operators.selectors import Selector, predicate

DAY_MS = 86_400_000
#: Selected series up to so many bytes of label strings are broadcast to the scan of samples; more go through a shuffle.
BROADCAST_BYTES = 16 << 20
#: Parts of a day that are read together; one more puts them together. Series of a batch that are named to the scan, and
#: that are broadcast to it; of more series all samples of the batch's days go into the merge.
MOST_PARTS, NAMED_SERIES, SENT_SERIES = 12, 200, 100_000
SPANS = "series_id bigint, n bigint, first_ts bigint, last_ts bigint, last_value double"
BATCH = SAMPLES + ", seq bigint"


def with_identity(series: DataFrame) -> DataFrame:
    """series and lk, its label string with the metric's name."""
    named = F.map_concat(F.map_filter("labels", lambda k, v: k != NAME), F.when(F.coalesce("metric", F.lit("")) != "", F.create_map(F.lit(NAME), F.col("metric"))).otherwise(F.create_map().cast("map<string,string>")))
    return series.withColumn("lk", map_key(named))


def label_of(name: str) -> Column:
    """A label of a row of the table of series, '' if there is none."""
    return F.coalesce(F.col("metric") if name == NAME else F.try_element_at("labels", F.lit(name)), F.lit(""))


def spans_of(samples: DataFrame, *by: str) -> DataFrame:
    return samples.groupBy("series_id", *by).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.max_by("value", "ts_ms").alias("last_value"))


def spans_after(spans: DataFrame, changed: DataFrame) -> DataFrame:
    """Spans of the days and series that ``changed`` (series_id, day, ts_ms, value, new) touches, after it; spans: those
    before. Unchanged samples aren't read."""
    names = ["series_id", "day", "n", "first_ts", "last_ts", "last_value"]
    one = changed.select("series_id", "day", F.col("new").cast("bigint").alias("n"), F.col("ts_ms").alias("first_ts"), F.col("ts_ms").alias("last_ts"), F.col("value").alias("last_value"), F.lit(True).alias("_fresh"))
    rows = spans.select(*names, F.lit(False).alias("_fresh")).unionByName(one)
    at = {new: F.when(F.col("_fresh") == new, F.col("last_ts")) for new in (False, True)}
    got = rows.groupBy("series_id", "day").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max(at[False]).alias("_old"), F.max(at[True]).alias("_new"),
        F.max_by("last_value", at[False]).alias("_was"), F.max_by("last_value", at[True]).alias("_is"),
    )
    newer = F.col("_old").isNull() | (F.col("_new") >= F.col("_old"))
    return got.where(F.col("_new").isNotNull()).withColumn("last_value", F.when(newer, F.col("_is")).otherwise(F.col("_was"))).select(names)


@dataclass
class StoreSource:
    """What the planner reads. spans_df: (series_id, n, first_ts, last_ts) of each series, or of parts of it; without
    it they are counted in the samples."""

    series_df: DataFrame
    samples_df: DataFrame
    db: int = 0
    spans_df: DataFrame | None = None
    slot_ms: int = DAY_MS

    def selected(self, selectors: Sequence[Selector]) -> DataFrame:
        return self.series_df.where(F.col("db") == self.db).where(predicate(selectors, label_of, lambda n: F.col("metric") if n == NAME else None))

    def scan(self, selectors: Sequence[Selector], start: int, end: int, keep: Sequence[str] | None = None) -> DataFrame:
        chosen = with_identity(self.selected(selectors)).select("series_id", "lk")
        samples = self.samples_df
        if "day" in samples.columns:
            samples = samples.where(F.col("day").between(start // self.slot_ms, end // self.slot_ms))
        samples = samples.where(F.col("ts_ms").between(start, end))
        if (chosen.agg(F.sum(F.octet_length("lk").cast("bigint") + 24)).first()[0] or 0) <= BROADCAST_BYTES:
            chosen = F.broadcast(chosen)
        return samples.join(chosen, "series_id").select("lk", "ts_ms", "value")

    def spans(self) -> DataFrame:
        parts = self.spans_df if self.spans_df is not None else spans_of(self.samples_df)
        return parts.groupBy("series_id").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max_by("last_value", "last_ts").alias("last_value"))

    def series(self) -> DataFrame:
        named = with_identity(self.series_df.where(F.col("db") == self.db))
        return named.join(self.spans(), "series_id", "left").select("lk", "first_ts", "last_ts", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


class SeriesStore:
    """A folder with ``manifest/N.json`` (the highest N counts), ``series/v=K``, and ``samples/part=P/day=D``, sorted by
    series and time so that a range reads few row groups, with counts and bounds in ``spans/part=P/day=D``. One writer at
    a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, slot_days: int = 1):
        """slot_days: what counts as a "day" of a new folder. Series that are sparse over many years take longer ones."""
        self.spark, self.path, self.slot_ms = spark, path.rstrip("/"), DAY_MS * slot_days
        if self.version() >= 0:
            self.slot_ms = self.manifest()["slot_ms"]
        else:
            self.save(spark.createDataFrame([], SERIES), spark.createDataFrame([], SAMPLES))

    # ---- files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, folder: str) -> None:
        fs, p = self._fs(f"{self.path}/{folder}")
        fs.delete(p, True)

    def day_of(self, ts: Column) -> Column:
        return F.floor(ts / self.slot_ms).cast("bigint")

    # ---- manifests
    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        """series: the version of its table; days: the parts of each day, oldest first; streams: their last batches."""
        version = self.version() if version is None else version
        if version < 0:
            return {"series": -1, "days": {}, "streams": {}, "slot_ms": self.slot_ms}
        fs, p = self._fs(f"{self.path}/manifest/{version}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, **changes: object) -> None:
        """A new manifest with these changes; what neither it nor the one before names is deleted."""
        versions = self._versions()
        before = self.manifest(versions[-1]) if versions else self.manifest(-1)
        after = {**before, **changes}
        n = max(versions, default=-1) + 1
        fs, made = self._fs(f"{self.path}/manifest/{uuid.uuid4().hex}.tmp")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        if not fs.rename(made, self._fs(f"{self.path}/manifest/{n}.json")[1]):
            raise OSError(f"manifest {n} couldn't be written: is there another writer?")
        for old in versions[:-1]:
            self._delete(f"manifest/{old}.json")
        named = {p for m in (before, after) for parts in m["days"].values() for p in parts}
        for folder in ("samples", "spans"):
            for name in self._names(folder):
                if name.startswith("part=") and name[5:] not in named:
                    self._delete(f"{folder}/{name}")
        for name in self._names("series"):
            if name.startswith("v=") and int(name[2:]) not in (before["series"], after["series"]):
                self._delete(f"series/{name}")

    def staged(self, df: DataFrame) -> DataFrame:
        """Written beside the tables and read again, so that it is worked out once."""
        at = f"{self.path}/staging/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear_staging(self) -> None:
        self._delete("staging")

    # ---- tables
    def series(self) -> DataFrame:
        return self.spark.read.schema(SERIES).parquet(f"{self.path}/series/v={self.manifest()['series']}")

    def _read(self, table: str, schema: str, by: tuple[str, ...], days: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table with their day; of rows with the same ``by`` on a day of several parts the newest."""
        live = {int(d): parts for d, parts in self.manifest()["days"].items()}
        if days is not None:
            live = {d: live[d] for d in days if d in live}
        full, base = f"{schema}, day bigint", f"{self.path}/{table}"
        at = lambda several: [f"{base}/part={p}/day={d}" for d, parts in sorted(live.items()) for p in parts if (len(parts) > 1) == several]
        read = lambda paths: self.spark.read.schema(f"{full}, part string").option("basePath", base).parquet(*paths)
        names = [c.split()[0] for c in full.split(", ")]
        out = read(at(False)).select(names) if at(False) else self.spark.createDataFrame([], full)
        if at(True):
            rest = [n for n in names if n not in (*by, "day")]
            order = F.substring("part", 1, 12).cast("bigint")  # names begin with the version that made them
            newest = read(at(True)).groupBy(*by, "day").agg(*[F.max_by(n, order).alias(n) for n in rest])  # numbers only: a hash aggregate
            out = out.unionByName(newest.select(names))
        return out

    def samples(self, days: Iterable[int] | None = None) -> DataFrame:
        return self._read("samples", SAMPLES, ("series_id", "ts_ms"), days)

    def spans(self, days: Iterable[int] | None = None) -> DataFrame:
        return self._read("spans", SPANS, ("series_id",), days)

    def source(self, db: int = 0) -> StoreSource:
        return StoreSource(self.series(), self.samples(), db, self.spans(), self.slot_ms)

    def _write_series(self, series: DataFrame) -> int:
        n = max([self.manifest()["series"], *(int(x[2:]) for x in self._names("series") if x.startswith("v="))]) + 1
        series.select(*[c.split()[0] for c in SERIES.split(", ")]).write.parquet(f"{self.path}/series/v={n}")
        return n

    def save_series(self, series: DataFrame) -> None:
        """A new version; the one before stays for those who read it."""
        self._commit(series=self._write_series(series))

    def save(self, series: DataFrame, samples: DataFrame, spans: DataFrame | None = None) -> None:
        """All of it: a snapshot. spans: those of the samples with their day, where they are known; samples are then
        written as they are read."""
        if spans is None:
            samples = self.staged(samples.select("series_id", "ts_ms", "value"))
            spans = spans_of(samples.withColumn("day", self.day_of(F.col("ts_ms"))), "day")
        part, days = self._write_part(samples, spans)
        self._commit(series=self._write_series(series), days={str(d): [part] for d in days}, streams={})

    def _write_part(self, samples: DataFrame, spans: DataFrame) -> tuple[str, list[int]]:
        """Stored samples (and spans with their day) as a new part. Names of parts sort in the order of writing."""
        part = f"{self.version() + 1:012d}-{uuid.uuid4().hex[:8]}"
        days = samples.select("series_id", "ts_ms", "value").withColumn("day", self.day_of(F.col("ts_ms")))
        # a range split, not a hash by day: a busy day is spread over several files
        ordered = days.repartitionByRange("day", "series_id", "ts_ms").sortWithinPartitions("day", "series_id", "ts_ms")
        for table, rows in (("samples", ordered), ("spans", spans)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{self.path}/{table}/part={part}")
        return part, sorted(int(n[4:]) for n in self._names(f"samples/part={part}") if n.startswith("day="))

    def _with_days(self, samples: DataFrame, days: Iterable[int], spans: DataFrame | None = None) -> dict[str, list[str]]:
        """The days of a manifest in which ``samples`` is all that these days hold; stored, unless their spans are known."""
        part, there = self._write_part(samples, spans_of(samples.withColumn("day", self.day_of(F.col("ts_ms"))), "day") if spans is None else spans)
        kept = {d: parts for d, parts in self.manifest()["days"].items() if int(d) not in set(days)}
        return {**kept, **{str(d): [part] for d in there}}

    def replace_days(self, samples: DataFrame, days: Iterable[int], **changes: object) -> None:
        """``samples`` is all that these days hold from now on."""
        days = list(days)
        self._commit(days=self._with_days(self.staged(samples.select("series_id", "ts_ms", "value")), days), **changes)

    def days_of(self, ids: DataFrame) -> list[int]:
        """The stored days with samples of these series. Parts needn't be put together for it."""
        at = [f"{self.path}/spans/part={p}/day={d}" for d, parts in self.manifest()["days"].items() for p in parts]
        rows = self.spark.read.schema("series_id bigint, day bigint").option("basePath", f"{self.path}/spans").parquet(*at) if at else None
        return [] if rows is None else sorted(r[0] for r in rows.join(ids, "series_id", "left_semi").select("day").distinct().collect())

    def of_days(self, days: Iterable[int]) -> DataFrame:
        return self.samples(sorted(days)).select("series_id", "ts_ms", "value")

    def days_between(self, start: int, end: int) -> list[int]:
        """The stored days that a range touches, from the manifest."""
        return sorted(d for d in map(int, self.manifest()["days"]) if start // self.slot_ms <= d <= end // self.slot_ms)

    # ---- changes
    def append(self, batch: DataFrame, stream: str | None = None, number: int = 0) -> DataFrame | None:
        """batch: series_id, ts_ms, value, seq (order of arrival). Returns the status of each row, stored. Of a stream a
        batch whose number was taken before isn't taken again (None): the number is in the manifest that takes it.

        Only what the batch changes is written: its samples as they are after it, and spans of its series."""
        streams = self.manifest()["streams"]
        if stream is not None and streams.get(stream, -1) >= number:
            return None
        if "policy" not in batch.columns:
            batch = batch.join(ingest.options(self.series()), "series_id", "left")
        known = F.when(F.col("policy").isNull(), ingest.ERROR_UNKNOWN).otherwise(ingest.OK)
        batch = self.staged(batch.select("series_id", "ts_ms", "value", F.col("seq").cast("bigint").alias("seq"), "policy", "retention_ms", "dedupe_ms", "sig_digits", known.alias("status")))
        has = batch.agg(
            F.collect_set(self.day_of(F.col("ts_ms"))).alias("days"), F.collect_set("policy").alias("policies"), F.approx_count_distinct("series_id").alias("series"),
            *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("retention_ms", "dedupe_ms", "sig_digits")],
        ).first()
        days, ids = sorted(has["days"]), batch.select("series_id").distinct()
        named = [r[0] for r in ids.limit(NAMED_SERIES + 1).collect()] if has["series"] <= 2 * NAMED_SERIES else None
        few = named is not None and len(named) <= NAMED_SERIES
        mine = lambda df: df.where(F.col("series_id").isin(named)) if few else df.join(ids, "series_id", "left_semi")
        after_streams = {**streams, stream: number} if stream is not None else streams
        if has["retention_ms"] > 0 or has["dedupe_ms"] > 0 or "block" in has["policies"]:
            there, last = self.of_days(days), mine(self.spans()).groupBy("series_id").agg(F.max("last_ts").alias("last_ts"))
            plain = batch.select("series_id", "ts_ms", "value", "seq")
            if has["retention_ms"] > 0:  # old samples of these days may go, too
                after, status = ingest.append(self.series(), there, plain, last)
                status = self.staged(status)
                self.replace_days(after, days, streams=after_streams)
                return status
            after, status = ingest.append(self.series(), mine(there), plain, last)
            status, after = self.staged(status), self.staged(after)
            changed = self.staged(after.join(batch.select("series_id", "ts_ms").distinct(), ["series_id", "ts_ms"], "left_semi"))
            spans = spans_of(after.withColumn("day", self.day_of(F.col("ts_ms"))), "day")
        else:
            status = batch.select("series_id", "ts_ms", "seq", "status")
            of = self.manifest()["days"]
            there = spans = None
            if any(str(d) in of for d in days):
                there, spans = self.of_days(days), self.spans(days)
                if few:
                    there, spans = mine(there), mine(spans)
                elif has["series"] <= SENT_SERIES:
                    there, spans = (x.join(F.broadcast(ids), "series_id", "left_semi") for x in (there, spans))
            good = batch.where(F.col("status") == ingest.OK)
            changed = self.staged(ingest.merge(good, there, has["policies"], has["sig_digits"] > 0).withColumn("day", self.day_of(F.col("ts_ms"))))
            spans = spans_of(changed, "day") if spans is None else spans_after(spans, changed)
        part, wrote = self._write_part(changed, spans)
        of = self.manifest()["days"]
        self._commit(days={**of, **{str(d): [*of.get(str(d), []), part] for d in wrote}}, streams=after_streams)
        full = [d for d in wrote if len(self.manifest()["days"][str(d)]) > MOST_PARTS]
        if full:
            self.replace_days(self.of_days(full), full)
        return status

    def delete_range(self, ids: DataFrame, start: int, end: int) -> int:
        """Samples of the series ``ids`` (series_id) in [start, end] go; the series stay. Returns how many went."""
        days = self.days_between(start, end)
        ids = self.staged(ids.select("series_id").distinct())
        rows = self.of_days(days)
        inside = F.col("ts_ms").between(start, end)
        gone = rows.where(inside).join(ids, "series_id", "left_semi").count()
        if gone:
            self.replace_days(rows.where(~inside).unionByName(rows.where(inside).join(ids, "series_id", "left_anti")), days)
        return gone

    def delete_series(self, ids: DataFrame) -> int:
        """Series and their samples go in one step."""
        ids = self.staged(ids.select("series_id").distinct())
        gone = self.series().join(ids, "series_id", "left_semi").count()
        if gone:
            days = self.days_of(ids)
            rest = [x.join(ids, "series_id", "left_anti") for x in (self.of_days(days), self.spans(days))]
            self._commit(series=self._write_series(self.series().join(ids, "series_id", "left_anti")), days=self._with_days(rest[0], days, rest[1]))
        return gone

    def compact(self, days: Iterable[int] | None = None) -> None:
        """Rewrite days into few sorted files, without samples older than their series' retention."""
        days = self.days_between(-(1 << 60), 1 << 60) if days is None else list(days)
        newest = self.spans().groupBy("series_id").agg(F.max("last_ts").alias("newest"))
        floors = self.series().where("retention_ms > 0").join(newest, "series_id").select("series_id", F.greatest(F.col("newest") - F.col("retention_ms"), F.lit(0)).alias("_floor"))
        rows = self.of_days(days).join(floors, "series_id", "left").where(F.col("_floor").isNull() | (F.col("ts_ms") >= F.col("_floor")))
        self.replace_days(rows, days)
        self.clear_staging()
