"""The stored folder: parts, manifests, writers that die, streams."""

import os

import pytest
from pyspark.sql import functions as F

from chronoweave.engine import Engine, SeriesOptions
from chronoweave.sources import store as st
from chronoweave.sources.store import SeriesStore

DAY = 86_400_000


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", cache=False)
    for k, policy in (("a", "last"), ("b", "sum")):
        e.create_series(k, SeriesOptions(metric=k, dup_policy=policy))
    e.add_many([(k, t * DAY // 4, float(t)) for k in "ab" for t in range(8)])
    return e


def held(e):
    ids = {r["series_id"]: r["key"] for r in e.series().collect()}
    return {(ids[r["series_id"]], r["ts_ms"]): r["value"] for r in e.store.samples().collect()}


def agree(e):
    """The counts say what the samples say."""
    want = {r["series_id"]: (r["n"], r["a"], r["b"]) for r in e.store.samples().groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).collect()}
    got = {r["series_id"]: (r["n"], r["first_ts"], r["last_ts"]) for r in e.store.source(0).spans().collect()}
    assert got == want


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_one_sample_rewrites_no_day(engine, tmp_path):
    before = files(f"{tmp_path}/s/samples")
    engine.add("a", DAY + 5, 99.0)
    after = files(f"{tmp_path}/s/samples")
    assert before.items() <= after.items()
    assert sum(os.path.getsize(f) for f in after.keys() - before.keys()) < 3000
    assert held(engine)["a", DAY + 5] == 99.0 and len(held(engine)) == 17
    agree(engine)


def test_later_parts_take_the_place_of_earlier_ones(engine):
    engine.add("a", DAY, 50.0)
    engine.add("b", DAY, 50.0)
    assert held(engine)["a", DAY] == 50.0 and held(engine)["b", DAY] == 54.0
    assert engine.get("a") == (7 * DAY // 4, 7.0)
    agree(engine)


def test_many_parts_are_put_together(engine, monkeypatch):
    monkeypatch.setattr(st, "MOST_PARTS", 3)
    for k in range(5):
        engine.add("a", DAY + 10 + k, float(k))
        assert max(map(len, engine.store.manifest()["days"].values())) <= 3
    assert len(held(engine)) == 21
    agree(engine)


@pytest.mark.parametrize("change", ["append", "delete_range", "delete_series"])
def test_a_writer_that_dies_changes_nothing(engine, monkeypatch, spark, change):
    before = held(engine)

    def die(self, *args, **kwargs):
        raise OSError("killed between the samples and the manifest")

    monkeypatch.setattr(SeriesStore, "_commit", die)
    with pytest.raises(OSError):
        {"append": lambda: engine.add("a", 3, 1.0), "delete_range": lambda: engine.delete_range(["a"], 0, DAY), "delete_series": lambda: engine.delete_series(["a"])}[change]()
    monkeypatch.undo()
    again = Engine(spark, engine.store.path, cache=False)
    assert held(again) == before and again.series().count() == 2
    agree(again)
    again.add("a", 3, 1.0)
    assert len(held(again)) == len(before) + 1


def test_a_second_writer_is_noticed(engine, monkeypatch):
    """Both see the same version; the manifest of the first stays."""
    old = engine.store._versions()
    engine.add("a", 1, 1.0)
    monkeypatch.setattr(SeriesStore, "_versions", lambda self: old)
    fs = engine.store._fs(engine.store.path)[0]
    monkeypatch.setattr(SeriesStore, "_fs", lambda self, path: (Refusing(fs), self.spark._jvm.org.apache.hadoop.fs.Path(path)))
    with pytest.raises(OSError):
        engine.store._commit()


class Refusing:
    """A file system whose rename doesn't overwrite, as on HDFS."""

    def __init__(self, fs):
        self.fs = fs

    def rename(self, a, b):
        return False if self.fs.exists(b) else self.fs.rename(a, b)

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_readers_go_on_reading(engine):
    rows = engine.store.samples()
    engine.delete_range(["a"], 0, 10 * DAY)
    assert rows.count() == 16 and len(held(engine)) == 8


def test_a_batch_of_a_stream_counts_once(engine, spark):
    ids = {r["key"]: r["series_id"] for r in engine.series().collect()}
    batch = spark.createDataFrame([(ids["b"], DAY, 1.0, 0)], "series_id bigint, ts_ms bigint, value double, seq bigint")
    assert engine.store.append(batch, "s", 0).count() == 1
    assert engine.store.append(batch, "s", 0) is None
    assert held(engine)["b", DAY] == 5.0
    engine.store.append(batch, "s", 1)
    engine.store.append(batch, "other", 0)
    assert held(engine)["b", DAY] == 7.0
    agree(engine)


def test_long_slots_and_times_before_1970(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", cache=False, slot_days=366)
    e.create_series("k", SeriesOptions(metric="m"))
    e.add_many([("k", t * 400 * DAY, float(t)) for t in (-1, 0, 1, 2)])
    assert Engine(spark, e.store.path).store.slot_ms == 366 * DAY
    assert [r["value"] for r in e.range("k", -(1 << 50), 1 << 50).collect()] == [-1.0, 0.0, 1.0, 2.0]
    assert e.delete_range(["m"], 0, 399 * DAY) == 1 and len(e.store.manifest()["days"]) == 3
    agree(e)


def test_key_events(engine):
    assert engine.key_event("expired", "nobody") == 0 and engine.key_event("evicted", "a") == 1
    assert {k for k, _ in held(engine)} == {"b"}
    assert engine.key_event("rename", "b", "c") == 1 and engine.exists("c") and engine.key_event("rename", "b", "d") == 0
    assert engine.key_event("flush") == 1 and not held(engine)
    with pytest.raises(ValueError):
        engine.key_event("painted", "c")


@pytest.fixture()
def staged(monkeypatch):
    """Grows by one whenever rows are written beside the tables."""
    calls, real = [], SeriesStore.staged
    monkeypatch.setattr(SeriesStore, "staged", lambda self, df: calls.append(1) or real(self, df))
    return calls


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_snapshot_takes_the_spans_over(engine, tmp_path, monkeypatch):
    """They aren't counted in the samples again (a new folder counts its empty table)."""
    engine.add("a", DAY, 50.0)
    before, counted, real = held(engine), [], st.spans_of
    monkeypatch.setattr(st, "spans_of", lambda samples, *by: counted.append(samples.count()) or real(samples, *by))
    engine.snapshot(f"file://{tmp_path}/t")
    engine.flush()
    assert not held(engine)
    engine.restore(f"file://{tmp_path}/t")
    assert held(engine) == before and engine.series().count() == 2 and not any(counted)
    agree(engine)


def test_overwriting_writes_the_batch_and_what_it_changes_only(spark, tmp_path, staged):
    e = Engine(spark, f"file://{tmp_path}/s", cache=False)
    want = {"first": 2.0, "last": 1.0, "min": 1.0, "max": 2.0, "sum": 3.0}
    for p in want:
        e.create_series(p, SeriesOptions(metric=p, dup_policy=p))
    e.add_many([(p, t, 2.0) for p in want for t in (10, 20)])
    del staged[:]
    assert e.add_many([*[(p, 20, 1.0) for p in want], *[(p, 20, float("nan")) for p in want], ("first", 5, 7.0), ("nobody", 5, 1.0)]) == ["ok"] * 11 + ["unknown series"]
    assert len(staged) == 2
    assert held(e) == {("first", 5): 7.0} | {(p, 10): 2.0 for p in want} | {(p, 20): v for p, v in want.items()}
    assert {p: e.get(p) for p in want} == {p: (20, v) for p, v in want.items()}
    agree(e)


def test_policies_are_hashed_not_sorted(spark):
    from chronoweave.operators.ingest import resolve

    rows = spark.createDataFrame([], "series_id bigint, ts_ms bigint, value double, seq bigint, policy string")
    made = rows.groupBy("series_id", "ts_ms").agg(resolve(F.col("policy"), F.col("value"), F.col("seq")))
    assert "HashAggregate" in plan(made) and "SortAggregate" not in plan(made)


def test_spans_of_several_parts_are_hashed_not_sorted(engine):
    engine.add("a", DAY, 50.0)
    spans = engine.store.spans()
    assert "HashAggregate" in plan(spans) and "SortAggregate" not in plan(spans)
    agree(engine)


def test_samples_of_several_parts_are_hashed_not_sorted(engine):
    for k in range(3):
        engine.add("b", DAY + k, 50.0)
    samples = engine.store.samples()
    assert "HashAggregate" in plan(samples) and "SortAggregate" not in plan(samples)
    assert held(engine)["b", DAY] == 54.0 and len(held(engine)) == 18


def test_a_copy_stages_its_series_and_samples_only(engine, staged):
    engine.copy_series("b", "c")
    assert len(staged) == 3  # its row, its samples, what they change
    assert {t: v for (k, t), v in held(engine).items() if k == "c"} == {t: v for (k, t), v in held(engine).items() if k == "b"}
    agree(engine)


def test_deleted_keys_stage_their_ids_only(engine, staged):
    engine.add("a", DAY, 50.0)
    before = held(engine)
    del staged[:]
    assert engine.delete_keys("b") == 1 and len(staged) == 1
    assert held(engine) == {at: v for at, v in before.items() if at[0] == "a"}
    agree(engine)
