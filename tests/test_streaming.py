import pytest
from pyspark.sql import functions as F

from chronoweave.engine import Engine, SeriesOptions
from chronoweave.operators.ingest import accepted
from chronoweave.streaming import accepted_stream, sessions, sink, sliding, tumbling, without_duplicates

MINUTE = 60_000
SCHEMA = "series_id bigint, ts_ms bigint, value double"
#: Spark takes events at or before 1970-01-01 for late.
B = 86_400_000
ROWS = [(k, B + t, v) for k, t, v in [(1, 0, 1.0), (1, 30_000, 2.0), (1, 100_000, 3.0), (2, 10_000, 5.0), (1, 30_000, 9.0), (2, 400_000, 6.0)]]


@pytest.fixture()
def files(spark, tmp_path):
    """Two files, one a micro-batch each; the last sample moves the watermark on."""
    at = tmp_path / "in"
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(at))
    spark.createDataFrame([(3, 3 * B, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
    return str(at)


def stream(spark, files, per=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per).parquet(files)


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_tumbling_windows_match_the_batch(spark, files, tmp_path):
    got = drained(tumbling(stream(spark, files), "1 minute", ["sum", "count", "std.p"]), tmp_path, "tumbled")
    want = spark.createDataFrame(ROWS, SCHEMA).groupBy("series_id", (F.col("ts_ms") - F.col("ts_ms") % MINUTE).alias("start_ms")).agg(F.sum("value").alias("sum"), F.count("*").alias("count"))
    rows = lambda df: sorted((r["series_id"], r["start_ms"], r["sum"], r["count"]) for r in df.where("series_id < 3").collect())
    assert rows(got) == rows(want)


def test_sliding_and_sessions(spark, files, tmp_path):
    got = drained(sliding(stream(spark, files), "2 minutes", "1 minute", ["count"]), tmp_path, "slid").where("series_id = 2").orderBy("start_ms").collect()
    assert [(r["start_ms"] - B, r["count"]) for r in got] == [(-60_000, 1), (0, 1), (300_000, 1), (360_000, 1)]
    got = drained(sessions(stream(spark, files), "1 minute"), tmp_path, "sessions").where("series_id < 3").orderBy("series_id", "start_ms").collect()
    assert [(r["series_id"], r["start_ms"] - B, r["count"]) for r in got] == [(1, 0, 3), (1, 100_000, 1), (2, 10_000, 1), (2, 400_000, 1)]


def test_duplicates_and_dedupe_interval(spark, files, tmp_path):
    got = drained(without_duplicates(stream(spark, files)), tmp_path, "once")
    assert got.where("series_id = 1").count() == 3
    got = drained(accepted_stream(stream(spark, files), MINUTE), tmp_path, "accepted")
    batch = accepted(spark.createDataFrame(ROWS, SCHEMA).withColumn("dedupe_ms", F.lit(MINUTE)).withColumn("seq", F.col("ts_ms")), "series_id")
    rows = lambda df: sorted((r["series_id"], r["ts_ms"]) for r in df.where("series_id < 3").collect())
    assert rows(got) == rows(batch) == [(1, B), (1, B + 100_000), (2, B + 10_000), (2, B + 400_000)]


def test_sink_appends_once(spark, files, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    ids = {k: e.create_series(k, SeriesOptions(metric=k, dup_policy="sum")) for k in ("a", "b")}
    named = stream(spark, files, 10).where("series_id < 3").select(F.when(F.col("series_id") == 1, ids["a"]).otherwise(ids["b"]).alias("series_id"), "ts_ms", "value")
    for checkpoint in ("c1", "c1", "c2"):  # the last one starts anew, but its batch is known
        q = sink(named, e.store, str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r["ts_ms"], r["value"]) for r in e.range("a", 0, 10**9).collect()] == [(B, 1.0), (B + 30_000, 11.0), (B + 100_000, 3.0)]
    assert e.get("b") == (B + 400_000, 6.0)
