import math

import pytest
from helpers import points, source

from chronoweave.plans.parser import arithmetic
from chronoweave.plans.planner import PlanError, query, query_range

STEP = 10_000


def run(spark, src, text, start=0, end=60_000, step=STEP, lookback=15_000, **more):
    return points(query_range(spark, src, text, start, end, step, lookback, **more))


@pytest.fixture(scope="module")
def src(spark):
    a = [(t * 1000, v) for t, v in ((0, 1), (10, 3), (20, 6), (30, 2), (40, 4), (60, 9))]
    b = [(t * 1000, v) for t, v in ((0, 10), (30, 20), (55, 30))]
    return source(spark, [({"__name__": "m", "k": "a", "z": "1"}, a), ({"__name__": "m", "k": "b", "z": "1"}, b), ({"__name__": "n", "k": "a"}, [(20_000, 100)])])


def test_instant_lookback_excludes_its_start(spark, src):
    got = run(spark, src, 'm{k="b"}')
    assert {t: v for (_, t), v in got.items()} == {0: 10, 10_000: 10, 30_000: 20, 40_000: 20, 60_000: 30}


def test_counter_reset_and_the_step_into_the_window(spark, src):
    got = {t: v for (_, t), v in run(spark, src, 'increase(m{k="a"}[20s])').items()}
    # 20: 1->3->6; 30: ->6, reset to 2; 40: reset 2, ->4; 60: 4->9
    assert got[20_000] == 5 and got[30_000] == 5 and got[40_000] == 4 and got[60_000] == 5
    assert {t: v for (_, t), v in run(spark, src, 'resets(m{k="a"}[20s])').items()}[30_000] == 1


def test_single_sample_windows(spark, src):
    assert run(spark, src, 'increase_prometheus(m{k="b"}[10s])') == {}
    assert set(run(spark, src, 'stddev_over_time(m{k="b"}[10s])').values()) == {0}
    assert run(spark, src, 'deriv(m{k="b"}[10s])') == {}


def test_panes_give_the_same_as_the_fan_out(spark, src):
    for f in ("count", "sum", "avg", "min", "max", "range", "first", "last", "sum2"):
        by_panes = run(spark, src, f"{f}_over_time(m[40s])")
        fanned = run(spark, src, f"{f}_over_time(m[40001ms])")  # not a multiple of the step
        here = {k: v for k, v in by_panes.items() if k[1] < 40_000}
        assert here == {k: v for k, v in fanned.items() if k[1] < 40_000}, f


def test_folds_match_a_loop(spark, src):
    vals = {0: [1], 10_000: [1, 3], 20_000: [1, 3, 6], 30_000: [3, 6, 2], 40_000: [6, 2, 4], 50_000: [2, 4], 60_000: [4, 9]}

    def smooth(v, sf=0.4, tf=0.3):
        s, b = v[0], (v[1] - v[0] if len(v) > 1 else 0)
        for x in v[1:]:
            s, before = sf * x + (1 - sf) * (s + b), s
            b = tf * (s - before) + (1 - tf) * b
        return s

    for f in ("holt_winters", "double_exponential_smoothing"):
        got = {t: v for (_, t), v in run(spark, src, f'{f}(m{{k="a"}}[25s], 0.4, 0.3)').items()}
        assert got == pytest.approx({t: smooth(v) for t, v in vals.items()})
    grid, s, want = [1, 3, 6, 2, 4, 4, 9], None, {}
    for i, x in enumerate(grid):
        s = x if s is None else 0.5 * x + 0.5 * s
        want[i * STEP] = s
    assert {t: v for (_, t), v in run(spark, src, 'smooth_exponential(m{k="a"}, 0.5)').items()} == pytest.approx(want)


def test_matching_errors_and_sides(spark, src):
    assert run(spark, src, "m / ignoring (z) n")[("k=a", 20_000)] == 0.06
    with pytest.raises(Exception, match="several series match"):
        run(spark, src, "m / on (z) m")
    got = run(spark, src, "n / on (z) group_right m")
    assert got == {}
    assert ("__name__=m,k=a,z=1", 20_000) in run(spark, src, "m and on (k) n")
    assert ("__name__=m,k=a,z=1", 20_000) not in run(spark, src, "m unless on (k) n")


def test_missing_labels_are_empty(spark, src):
    assert {lk for lk, _ in run(spark, src, '{z=""}')} == {"__name__=n,k=a"}
    assert {lk for lk, _ in run(spark, src, '{__name__=~".+",z!="1"}')} == {"__name__=n,k=a"}


def test_ieee_division_and_nan(spark, src):
    inf = float("inf")
    assert set(run(spark, src, 'm{k="b"} / 0').values()) == {inf}
    assert all(math.isnan(v) for v in run(spark, src, 'm{k="b"} * 0 / 0').values())
    assert run(spark, src, '(m{k="b"} * 0 / 0) > 1') == {}
    assert set(run(spark, src, 'ln(m{k="b"} - m{k="b"})').values()) == {-inf}


def test_remainder_of_whole_multiples(spark):
    inf, nan = float("inf"), float("nan")
    cases = [(102.8, 0.4, 0), (3.95, 0.05, 0), (-31.92, 0.28, 0), (102.8, 0.25, 0.05), (-7.5, 2, -1.5), (7.5, -2, 1.5), (6, 3, 0), (0.1, 0.4, 0.1), (1, inf, 1), (1e17, 3, 1), (7, 0, nan), (inf, 2, nan)]
    rows = [({"__name__": n, "k": f"{i:02}"}, [(0, v)]) for i, c in enumerate(cases) for n, v in zip("mn", c, strict=False)]
    got = run(spark, source(spark, rows), "m % n", end=0)
    want = [c[2] for c in cases]
    assert [got[f"k={i:02}", 0] for i in range(len(cases))] == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert [arithmetic("%", a, b) for a, b, _ in cases] == pytest.approx(want, abs=1e-9, nan_ok=True)


def test_order_limits_and_random(spark, src):
    rows = query(spark, src, "sort_desc(m)", 0, 15_000).collect()
    assert [r["value"] for r in rows] == [10, 1]
    assert len({lk for lk, _ in run(spark, src, "limitk(1, m)")}) == 1
    got = run(spark, src, "rand(5)")
    assert len(got) == 7 and all(0 <= v < 1 for v in got.values())
    assert got == run(spark, src, "rand(5)")
    assert all(v >= 0 for v in run(spark, src, "rand_exponential(5)").values())


def test_buckets_limit_keeps_the_edges(spark):
    rows = [({"__name__": "h", "le": le}, [(0, v)]) for le, v in (("1", 1), ("2", 2), ("4", 50), ("8", 51), ("+Inf", 52))]
    got = run(spark, source(spark, rows), "buckets_limit(3, h)", end=0)
    assert {lk: v for (lk, _), v in got.items()} == {"le=1": 1, "le=4": 50, "le=+Inf": 52}


def test_histogram_quantile_of_gaps(spark):
    rows = [({"__name__": "h", "le": le}, [(0, v)]) for le, v in (("1", 0), ("2", 10), ("+Inf", 10))]
    s = source(spark, rows)
    assert run(spark, s, "histogram_quantile(0.5, h)", end=0) == {("", 0): 1.5}
    assert run(spark, s, "histogram_quantile(2, h)", end=0) == {("", 0): float("inf")}
    assert run(spark, s, "histogram_share(2, h)", end=0) == {("", 0): 1.0}


def test_rounding(spark, src):
    assert run(spark, src, 'm{k="b"} / 3', end=0, rounding=2) == {("k=b,z=1", 0): 3.33}


@pytest.mark.parametrize("bad", ["nosuch(m)", "topk(m, 2)", "quantile_over_time(m[1m])", 'label_set(m, x, "a")', "round(m, m)", '"text"'])
def test_plan_errors(spark, src, bad):
    with pytest.raises((PlanError, ValueError)):
        run(spark, src, bad)


def test_time_bounds_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronoweave.sources import events_source

    spark.range(1).select(F.lit(1).cast("bigint").alias("event_id"), F.lit("2024-01-05").cast("timestamp_ntz").alias("ts"), F.lit(7).cast("bigint").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    df = query_range(spark, events_source(spark, str(tmp_path)), "sum(rate(click[1d])) by (user)", 1_704_412_800_000, 1_704_499_200_000, 86_400_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(event_type,click)" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
