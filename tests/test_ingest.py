import math

import pytest
from helpers import samples

from chronoweave.model import SAMPLES, SERIES
from chronoweave.operators import ingest
from chronoweave.operators.deletes import delete_range, delete_series, trim

NAN = float("nan")


@pytest.mark.parametrize("policy,value", [("block", 1), ("first", 1), ("last", 2), ("min", 1), ("max", 2), ("sum", 3)])
def test_duplicates(spark, policy, value):
    rows = spark.createDataFrame([("a", 0, 2.0, 5), ("a", 0, 1.0, 4), ("b", 10, NAN, 1), ("b", 10, 8.0, 2), ("c", 1, NAN, 1)], "lk string, ts_ms bigint, value double, seq bigint")
    got = {r["lk"]: r["value"] for r in ingest.deduplicate(rows, policy).collect()}
    assert got["a"] == value
    assert math.isnan(got["c"])
    assert math.isnan(got["b"]) if policy == "block" else got["b"] == 8


def test_retention(spark):
    rows = samples(spark, [({"k": "a"}, t, 1.0) for t in (0, 50, 100)] + [({"k": "b"}, 3, 1.0)])
    assert sorted(r["ts_ms"] for r in ingest.retained(rows, 50).collect()) == [3, 50, 100]
    assert ingest.retained(rows, 0).count() == 4


def test_dedupe_measures_from_the_last_accepted_sample(spark):
    rows = spark.createDataFrame([("a", t, 1.0, 10, i) for i, t in enumerate([0, 6, 9, 12, 21, 5, 40])] + [("b", 1, 1.0, 0, 0), ("b", 1, 1.0, 0, 1)], "lk string, ts_ms bigint, value double, dedupe_ms bigint, seq bigint")
    got = ingest.accepted(rows).collect()
    assert sorted(r["ts_ms"] for r in got if r["lk"] == "a") == [0, 12, 40]
    assert sum(r["lk"] == "b" for r in got) == 2


def test_merge(spark):
    older = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)], "lk string, ts_ms bigint, value double")
    newer = spark.createDataFrame([("a", 3, 30.0), ("a", 4, 4.0)], "lk string, ts_ms bigint, value double")
    got = lambda policy, floor=None: {r["ts_ms"]: r["value"] for r in ingest.merge_sorted(newer, older, policy, floor).collect()}
    assert got("last") == {1: 1, 2: 2, 3: 30, 4: 4} and got("first")[3] == 3 and got("sum")[3] == 33
    assert got("last", 3) == {3: 30, 4: 4}


@pytest.fixture(scope="module")
def stored(spark):
    series = [
        (0, 1, "plain", "m", {}, 0, 0, "last", 0, 4096), (0, 2, "block", "m", {}, 0, 0, "block", 0, 4096), (0, 3, "short", "m", {}, 100, 0, "last", 0, 4096),
        (0, 4, "slow", "m", {}, 0, 10, "last", 0, 4096), (0, 5, "digits", "m", {}, 0, 0, "sum", 2, 4096),
    ]
    return spark.createDataFrame(series, SERIES), spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0), (3, 500, 1.0), (4, 100, 1.0), (5, 10, 1.0), (9, 1, 1.0)], SAMPLES)


def test_append(spark, stored):
    batch = [
        (1, 10, 2.0), (1, 5, 3.0), (2, 10, 9.0), (2, 11, 9.0), (2, 11, 8.0), (3, 350, 1.0), (3, 600, 1.0), (4, 105, 1.0), (4, 110, 1.0), (4, 115, 1.0), (5, 10, 1234.0), (7, 1, 1.0),
    ]
    rows = spark.createDataFrame([(*b, i) for i, b in enumerate(batch)], "series_id bigint, ts_ms bigint, value double, seq bigint")
    after, status = ingest.append(*stored, rows)
    got = {(r["series_id"], r["ts_ms"]): r["value"] for r in after.collect()}
    assert got == {(1, 5): 3, (1, 10): 2, (2, 10): 1, (2, 11): 9, (3, 500): 1, (3, 600): 1, (4, 100): 1, (4, 110): 1, (5, 10): 1201, (9, 1): 1}
    said = {r["seq"]: r["status"] for r in status.collect()}
    assert len(said) == len(batch)
    assert {k: v for k, v in said.items() if v != "ok"} == {
        2: ingest.ERROR_DUPLICATE, 4: ingest.ERROR_DUPLICATE, 5: ingest.ERROR_OLD, 7: ingest.ERROR_EARLY, 9: ingest.ERROR_EARLY, 11: ingest.ERROR_UNKNOWN
    }


def test_empty_batch(spark, stored):
    none = spark.createDataFrame([], "series_id bigint, ts_ms bigint, value double, seq bigint")
    after, status = ingest.append(*stored, none)
    assert after.count() == 6 and status.count() == 0


def test_deletes(spark, stored):
    series, rows = stored
    left, gone = delete_range(rows, rows["series_id"] <= 2, 0, 10)
    assert (left.count(), gone.count()) == (4, 2)
    s, r, g = delete_series(series, rows, series["key"] == "plain")
    assert (s.count(), r.count(), g.count()) == (4, 5, 1)
    more = rows.unionByName(spark.createDataFrame([(3, 10, 1.0)], SAMPLES))
    assert trim(more, series).count() == 6
