"""Aggregators and functions that a user adds, and states that are merged."""

import pytest
from helpers import samples
from pyspark.sql import functions as F

from chronoweave.operators import buckets
from chronoweave.operators.buckets import AGGREGATORS, Aggregation, bucket_states, from_states, merge_states, range_query
from chronoweave.plans import planner, rollups
from chronoweave.sources import TableSource


@pytest.fixture(scope="module")
def rows(spark):
    return samples(spark, [({"__name__": "m", "k": k}, t, float((t * 7) % 11)) for k in "ab" for t in range(1, 60, 4)]).cache()


@pytest.fixture()
def source(rows):
    df = rows.select(F.lit("m").alias("name"), F.element_at(F.split("lk", "k\x1f"), -1).alias("k"), "ts_ms", "value")
    return TableSource(df, {"__name__": F.col("name"), "k": F.col("k")}, F.col("ts_ms"), F.col("value"))


def test_own_aggregator(rows):
    buckets.register_aggregator("spread2", lambda v, t: (F.max(v) - F.min(v)) * 2, empty=-1.0)
    got = range_query(rows, 0, 100, aggregation=Aggregation("spread2", 20))
    want = range_query(rows, 0, 100, aggregation=Aggregation("range", 20))
    assert sorted((r["lk"], r["ts_ms"], r["value"]) for r in got.collect()) == sorted((r["lk"], r["ts_ms"], 2 * r["value"]) for r in want.collect())
    with pytest.raises(ValueError):
        buckets.register_aggregator("sum", lambda v, t: F.sum(v))


def test_own_rollup_and_aggregate(spark, source):
    rollups.register_rollup("twice_max_over_time", lambda w: 2 * F.max(w.v))
    planner.register_aggregate("spread", lambda v: F.max(v) - F.min(v))
    ask = lambda text: sorted((r["lk"], r["ts_ms"], r["value"]) for r in planner.query_range(spark, source, text, 0, 60, 20).collect())
    assert ask("twice_max_over_time(m[20ms])") == ask("max_over_time(m[20ms]) * 2")
    assert ask("spread(m[20ms]) by (k)") == ask("max(m[20ms]) by (k) - min(m[20ms]) by (k)")
    for add, name in ((lambda n: rollups.register_rollup(n, lambda w: F.max(w.v)), "rate"), (lambda n: planner.register_aggregate(n, F.max), "sum")):
        with pytest.raises(ValueError):
            add(name)


@pytest.mark.parametrize("name", AGGREGATORS)
def test_states_of_parts_give_the_whole(rows, name):
    parts = [rows.where(F.pmod("ts_ms", F.lit(3)) == k) for k in range(3)]
    states = [bucket_states(p, 20) for p in parts]
    merged = merge_states(merge_states(states[0].unionByName(states[2])).unionByName(states[1]))
    got = {(r["lk"], r["ts_ms"]): r["value"] for r in from_states(merged, name).collect()}
    want = {(r["lk"], r["ts_ms"]): r["value"] for r in range_query(rows, 0, 100, aggregation=Aggregation(name, 20)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
