"""Registered queries against DuckDB at the smallest size; the driver compares them all at a larger one."""

import math
import os

import pytest

import __spark_entry__ as driver
from chronoweave import catalog

SF = "/root/testdata/sf0.001"
SOME = """sel_ne sel_or range_retention bucket_stds bucket_empty_avg bucket_align_end bucket_clamped series_list stats_series_by_pair dup_sum dedupe_interval delete_range significant_digits_2
q_roll_rate q_roll_predict_linear q_roll_rollup_candlestick q_roll_absent_over_time q_agg_quantiles q_agg_topk_rest q_agg_outliers_mad q_fn_interpolate q_fn_histogram_quantile q_label_replace q_op_group_left q_op_default
q_op_subquery q_op_with q_doc_error_share""".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    clean = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_modulo_of_whole_multiples(spark, duck, tmp_path):
    pairs = "(1, 102.8, 0.4), (2, 3.95, 0.05), (3, 4.8, 0.4), (4, 7.25, 2), (5, 0.3, 0.4), (6, 5, 0)"
    events = " UNION ALL ".join(f"SELECT TIMESTAMP '2024-01-03 10:00:00' AS ts, u::BIGINT AS user_id, '{m}' AS event_type, {v}::DOUBLE AS value, '{{}}' AS props, u::BIGINT AS event_id FROM p" for m, v in (("click", "a"), ("view", "b")))
    duck.execute(f"COPY (WITH p(u, a, b) AS (VALUES {pairs}) {events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["q_op_modulo"](spark, str(tmp_path)).toPandas()
    want = duck.execute(f"WITH events AS (FROM '{tmp_path}/events.parquet') {catalog.ORACLES['q_op_modulo']}").df()
    assert len(got) == 12 and rows(got) == rows(want)


def test_buckets_of_a_series_whose_newest_value_is_zero(spark, duck, tmp_path):
    samples = "(1, '10:00', 5), (1, '11:00', 0), (2, '10:00', 7), (3, '12:00', 0)"
    duck.execute(f"COPY (SELECT ('2024-01-03 ' || t)::TIMESTAMP AS ts, u::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value, '{{}}' AS props, u::BIGINT AS event_id FROM (VALUES {samples}) p(u, t, v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["q_fn_prometheus_buckets"](spark, str(tmp_path)).toPandas()
    want = duck.execute(f"WITH events AS (FROM '{tmp_path}/events.parquet') {catalog.ORACLES['q_fn_prometheus_buckets']}").df()
    assert len(got) == 6 and rows(got) == rows(want) and set(got[got["le"] == "+Inf"]["value"]) == {2.0}


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(catalog.QUERIES) <= set(driver.queries())
