import math
from statistics import pstdev, pvariance, stdev, variance

import pytest
from helpers import samples

from chronoweave.operators.buckets import AGGREGATORS, Aggregation, range_query
from chronoweave.operators.scan import filter_by_ts, filter_by_value, last_sample

NAN = float("nan")


@pytest.fixture(scope="module")
def two(spark):
    """Values at 0, 10, ..., 90 but for 40 to 60, and a second series with one sample."""
    rows = [({"__name__": "m", "k": "a"}, t, float(t % 7)) for t in (0, 10, 20, 30, 70, 80, 90)]
    return samples(spark, [*rows, ({"__name__": "m", "k": "b"}, 15, 5.0)]).cache()


def of(df, key="a"):
    return {r["ts_ms"]: r["value"] for r in df.collect() if f"k\x1f{key}" in r["lk"]}


@pytest.mark.parametrize("scale", [None, 2])
@pytest.mark.parametrize("name", AGGREGATORS)
def test_aggregators(two, name, scale):
    values = {0: [0 % 7, 10 % 7, 20 % 7], 30: [30 % 7], 60: [70 % 7, 80 % 7], 90: [90 % 7]}
    f = {
        "first": lambda v: v[0], "last": lambda v: v[-1], "min": min, "max": max, "avg": lambda v: sum(v) / len(v), "sum": sum, "count": len, "range": lambda v: max(v) - min(v),
        "std.p": pstdev, "var.p": pvariance, "std.s": lambda v: stdev(v) if len(v) > 1 else 0, "var.s": lambda v: variance(v) if len(v) > 1 else 0,
    }[name]
    got = of(range_query(two, 0, 100, aggregation=Aggregation(name.upper(), 30), scale=scale))
    assert got == pytest.approx({b: f(v) for b, v in values.items()})


@pytest.mark.parametrize("name,empty", [("sum", 0.0), ("count", 0.0), ("avg", NAN), ("std.s", NAN)])
def test_gaps_are_filled_between_buckets_only(two, name, empty):
    got = of(range_query(two, 0, 100, aggregation=Aggregation(name, 10, empty=True)))
    assert sorted(got) == list(range(0, 100, 10))
    assert all(math.isnan(got[t]) if math.isnan(empty) else got[t] == empty for t in (40, 50, 60))
    assert sorted(of(range_query(two, 0, 100, aggregation=Aggregation(name, 10, empty=True)), "b")) == [10]


def test_alignment_and_labels(two):
    assert sorted(of(range_query(two, 5, 95, align="start", aggregation=Aggregation("sum", 40)))) == [5, 45, 85]
    assert sorted(of(range_query(two, 5, 95, align="+", aggregation=Aggregation("sum", 40)))) == [0, 15, 55]  # the first is clamped
    assert sorted(of(range_query(two, 0, 95, aggregation=Aggregation("sum", 50, label="mid")))) == [25, 75]
    assert sorted(of(range_query(two, 0, 95, aggregation=Aggregation("sum", 50, label="end")))) == [50, 100]


def test_clamped_first_bucket_and_filling(spark):
    rows = samples(spark, [({"k": "a"}, t, 1.0) for t in (1, 45)])
    got = of(range_query(rows, 0, 100, align=5, aggregation=Aggregation("sum", 10, empty=True)))
    assert sorted(got) == [0, 5, 15, 25, 35, 45]


def test_filters_and_count(two):
    assert sorted(of(range_query(two, 10, 80))) == [10, 20, 30, 70, 80]  # both ends count
    assert sorted(of(range_query(two, 0, 100, by_value=(0, 2)))) == [0, 30, 70]
    assert sorted(of(range_query(two, 0, 0, by_ts=[30, 10, 10, 11]))) == [10, 30]
    assert sorted(of(range_query(two, 0, 100, count=2))) == [0, 10]
    assert sorted(of(range_query(two, 0, 100, count=5, aggregation=Aggregation("sum", 10, empty=True)))) == [0, 10, 20, 30, 40]
    assert sorted(of(range_query(two, 0, 100, retention_ms=20))) == [70, 80, 90]


def test_bad_arguments(two):
    for bad in (lambda: range_query(two, 5, 1), lambda: filter_by_value(two, 2, 1), lambda: filter_by_ts(two, range(26)), lambda: Aggregation("p99", 10), lambda: Aggregation("sum", 0), lambda: range_query(two, 0, 1, count=0)):
        with pytest.raises(ValueError):
            bad()


def test_nan(spark):
    rows = samples(spark, [({"k": "a"}, t, v) for t, v in ((0, NAN), (1, 3.0), (2, 1.0), (10, NAN))])
    for name, first in (("min", 1.0), ("max", 3.0)):
        got = of(range_query(rows, 0, 100, aggregation=Aggregation(name, 10)))
        assert got[0] == first and math.isnan(got[10])
    assert sorted(of(filter_by_value(rows, -1, float("inf")))) == [1, 2]


def test_no_rows(spark):
    none = samples(spark, [({"k": "a"}, 1, 1.0)]).where("false")
    assert range_query(none, 0, 10, aggregation=Aggregation("sum", 5, empty=True)).count() == 0
    assert last_sample(none).count() == 0


def test_last_sample(two):
    assert of(last_sample(two)) == {90: 6.0} and of(last_sample(two), "b") == {15: 5.0}
