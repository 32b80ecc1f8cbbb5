"""Queries for rollups: one for each function, over three days of purchases of each user."""

from __future__ import annotations

from ..model import NAME
from .base import DAY, GRID, SAMPLES, T0, T1, promql, windowed

D = 3
SEC = "(t - g) / 1000.0"
#: function -> (call, aggregate, digits)
FUNCTIONS: dict[str, tuple[str, str, int]] = {
    "count_over_time": ("{f}({m})", "count(*)", 6),
    "sum_over_time": ("{f}({m})", "sum(v)", 6),
    "sum2_over_time": ("{f}({m})", "sum(v * v)", 4),
    "avg_over_time": ("{f}({m})", "avg(v)", 6),
    "min_over_time": ("{f}({m})", "min(v)", 6),
    "max_over_time": ("{f}({m})", "max(v)", 6),
    "range_over_time": ("{f}({m})", "max(v) - min(v)", 6),
    "geomean_over_time": ("{f}({m})", "exp(avg(ln(v)))", 5),
    "stddev_over_time": ("{f}({m})", "sqrt(greatest(var_pop(v), 0))", 4),
    "stdvar_over_time": ("{f}({m})", "greatest(var_pop(v), 0)", 4),
    "median_over_time": ("{f}({m})", "quantile_cont(v, 0.5)", 6),
    "quantile_over_time": ("{f}(0.9, {m})", "quantile_cont(v, 0.9)", 6),
    "iqr_over_time": ("{f}({m})", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", 6),
    "mad_over_time": ("{f}({m})", "mad(v)", 6),
    "distinct_over_time": ("{f}({m})", "count(DISTINCT v)", 6),
    "present_over_time": ("{f}({m})", "1.0", 6),
    "first_over_time": ("{f}({m})", "arg_min(v, t)", 6),
    "last_over_time": ("{f}({m})", "arg_max(v, t)", 6),
    "default_rollup": ("{f}({m})", "arg_max(v, t)", 6),
    "tfirst_over_time": ("{f}({m})", "min(t) / 1000.0", 6),
    "tlast_over_time": ("{f}({m})", "max(t) / 1000.0", 6),
    "timestamp": ("{f}({m})", "max(t) / 1000.0", 6),
    "timestamp_with_name": ("{f}({m})", "max(t) / 1000.0", 6),
    "tmin_over_time": ("{f}({m})", "max({{'a': -v, 't': t}}).t / 1000.0", 6),
    "tmax_over_time": ("{f}({m})", "max({{'a': v, 't': t}}).t / 1000.0", 6),
    "lifetime": ("{f}({m})", "(max(t) - min(t)) / 1000.0", 6),
    "lag": ("{f}({m})", "(max(g) - max(t)) / 1000.0", 6),
    "stale_samples_over_time": ("{f}({m})", "0.0", 6),
    "delta_prometheus": ("{f}({m})", "CASE WHEN count(*) > 1 THEN arg_max(v, t) - arg_min(v, t) END", 6),
    "rate_over_sum": ("{f}({m})", f"sum(v) / {D * DAY / 1000!r}", 9),
    "deriv": ("{f}({m})", f"CASE WHEN count(*) > 1 THEN regr_slope(v, {SEC}) END", 5),
    "predict_linear": ("{f}({m}, 24 * 3600)", f"regr_intercept(v, {SEC}) + 86400 * regr_slope(v, {SEC})", 3),
    "zscore_over_time": ("{f}({m})", "CASE WHEN count(*) > 1 THEN (arg_max(v, t) - avg(v)) / sqrt(var_pop(v)) ELSE 'nan'::DOUBLE END", 5),
    "count_eq_over_time": ("{f}({m}, 7)", "count(*) FILTER (v = 7)", 6),
    "count_ne_over_time": ("{f}({m}, 7)", "count(*) FILTER (v <> 7)", 6),
    "count_gt_over_time": ("{f}({m}, 50)", "count(*) FILTER (v > 50)", 6),
    "count_le_over_time": ("{f}({m}, 50)", "count(*) FILTER (v <= 50)", 6),
    "share_eq_over_time": ("{f}({m}, 7)", "count(*) FILTER (v = 7) / count(*)", 6),
    "share_gt_over_time": ("{f}({m}, 50)", "count(*) FILTER (v > 50) / count(*)", 6),
    "share_le_over_time": ("{f}({m}, 50)", "count(*) FILTER (v <= 50) / count(*)", 6),
    "sum_eq_over_time": ("{f}({m}, 7)", "coalesce(sum(v) FILTER (v = 7), 0)", 6),
    "sum_gt_over_time": ("{f}({m}, 50)", "coalesce(sum(v) FILTER (v > 50), 0)", 6),
    "sum_le_over_time": ("{f}({m}, 50)", "coalesce(sum(v) FILTER (v <= 50), 0)", 6),
    "outlier_iqr_over_time": (
        "{f}({m})",
        "CASE WHEN arg_max(v, t) > quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))"
        " OR arg_max(v, t) < quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) THEN arg_max(v, t) END",
        6,
    ),
    "hoeffding_bound_lower": ("{f}(0.9, {m})", "avg(v) - (max(v) - min(v)) * sqrt(ln(1 / (1 - 0.9)) / (2 * count(*)))", 5),
    "hoeffding_bound_upper": ("{f}(0.9, {m})", "avg(v) + (max(v) - min(v)) * sqrt(ln(1 / (1 - 0.9)) / (2 * count(*)))", 5),
    # steps between samples
    "increase": ("{f}({m})", "sum(CASE WHEN ok THEN inc ELSE 0 END)", 6),
    "increase_pure": ("{f}({m})", "sum(CASE WHEN pt IS NULL THEN v WHEN ok THEN inc ELSE 0 END)", 6),
    "increase_prometheus": ("{f}({m})", "CASE WHEN count(*) > 1 THEN sum(CASE WHEN inside THEN inc ELSE 0 END) END", 6),
    "rate": ("{f}({m})", "CASE WHEN max(t) > min(CASE WHEN ok THEN pt ELSE t END) THEN sum(CASE WHEN ok THEN inc ELSE 0 END) / ((max(t) - min(CASE WHEN ok THEN pt ELSE t END)) / 1000.0) END", 9),
    "rate_prometheus": ("{f}({m})", f"CASE WHEN count(*) > 1 THEN sum(CASE WHEN inside THEN inc ELSE 0 END) / {D * DAY / 1000!r} END", 9),
    "irate": ("{f}({m})", "arg_max(CASE WHEN ok THEN inc / dt END, CASE WHEN ok THEN t END)", 7),
    "delta": ("{f}({m})", "arg_max(v, t) - arg_min(CASE WHEN ok THEN pv ELSE v END, t)", 6),
    "idelta": ("{f}({m})", "arg_max(CASE WHEN ok THEN dv END, CASE WHEN ok THEN t END)", 6),
    "ideriv": ("{f}({m})", "arg_max(CASE WHEN ok THEN dv / dt END, CASE WHEN ok THEN t END)", 7),
    "deriv_fast": ("{f}({m})", "CASE WHEN max(t) > min(CASE WHEN ok THEN pt ELSE t END) THEN (arg_max(v, t) - arg_min(CASE WHEN ok THEN pv ELSE v END, t)) / ((max(t) - min(CASE WHEN ok THEN pt ELSE t END)) / 1000.0) END", 9),
    "resets": ("{f}({m})", "count(*) FILTER (ok AND v < pv)", 6),
    "changes": ("{f}({m})", "count(*) FILTER (ok AND dv <> 0)", 6),
    "changes_prometheus": ("{f}({m})", "count(*) FILTER (inside AND dv <> 0)", 6),
    "increases_over_time": ("{f}({m})", "count(*) FILTER (ok AND v > pv)", 6),
    "decreases_over_time": ("{f}({m})", "count(*) FILTER (ok AND v < pv)", 6),
    "ascent_over_time": ("{f}({m})", "sum(CASE WHEN ok THEN greatest(dv, 0) ELSE 0 END)", 6),
    "descent_over_time": ("{f}({m})", "sum(CASE WHEN ok THEN greatest(-dv, 0) ELSE 0 END)", 6),
    "tlast_change_over_time": ("{f}({m})", "max(CASE WHEN ok AND dv <> 0 THEN t END) / 1000.0", 6),
    "integrate": ("{f}({m})", "sum(CASE WHEN ok THEN pv * dt ELSE 0 END)", 1),
    "scrape_interval": ("{f}({m})", "avg(CASE WHEN ok THEN dt END)", 4),
    "duration_over_time": ("{f}({m}, 90000)", "sum(CASE WHEN ok AND dt <= 90000 THEN dt ELSE 0 END)", 4),
}
WHERE = "metric = 'purchase'"

for _f, (_call, _agg, _digits) in FUNCTIONS.items():
    promql(
        f"q_roll_{_f}",
        _call.format(f=_f, m=f"purchase[{D}d]"),
        windowed(WHERE, D, f"SELECT usr, g AS ts_ms, {_agg.replace('{{', '{').replace('}}', '}')} AS value FROM w GROUP BY usr, g"),
        digits=_digits,
    )

promql(
    "q_roll_mode_over_time", f"mode_over_time(purchase[{D}d])",
    windowed(WHERE, D, "SELECT usr, g AS ts_ms, max({'n': n, 'v': -v}).v * -1 AS value FROM (SELECT usr, g, v, count(*) AS n FROM w GROUP BY ALL) GROUP BY usr, g"),
)
promql(
    "q_roll_absent_over_time", 'absent_over_time(purchase{user="1"}[1d])',
    windowed(WHERE + " AND usr = '1'", 1, "SELECT '1' AS usr, g AS ts_ms, 1.0 AS value FROM grid WHERE g NOT IN (SELECT g FROM w)"),
)
promql(
    "q_roll_count_values_over_time", 'count_values_over_time("val", floor(purchase)[3d:1d])',
    f"""WITH s AS (SELECT * FROM ({SAMPLES}) WHERE {WHERE}), sub AS (SELECT unnest(range({T0} - 2 * {DAY}, {T1} + 1, {DAY}))::BIGINT AS i), {GRID},
    x AS (SELECT usr, i, floor(arg_max(value, ts_ms)) AS v FROM s JOIN sub ON ts_ms > i - 2 * {DAY} AND ts_ms <= i GROUP BY ALL)
    SELECT usr, v::BIGINT::VARCHAR AS val, g AS ts_ms, count(*) AS value FROM x JOIN grid ON i > g - 3 * {DAY} AND i <= g GROUP BY ALL""",
    labels=("user", "val"),
)
promql(
    "q_roll_quantiles_over_time", f'quantiles_over_time("phi", 0.1, 0.5, 0.95, purchase[{D}d])',
    windowed(WHERE, D, "SELECT usr, phi, g AS ts_ms, value FROM (SELECT usr, g, unnest(['0.1', '0.5', '0.95']) AS phi, unnest(quantile_cont(v, [0.1, 0.5, 0.95])) AS value FROM w GROUP BY usr, g)"),
    labels=("user", "phi"),
)


def _several(items: list[tuple[str, str]]) -> str:
    return f"SELECT usr, rollup_ AS rollup, g AS ts_ms, value FROM (SELECT usr, g, unnest([{', '.join(repr(n) for n, _ in items)}]) AS rollup_, unnest([{', '.join(f'({e})::DOUBLE' for _, e in items)}]) AS value FROM w GROUP BY usr, g)"


def _spread(x: str) -> list[tuple[str, str]]:
    return [("min", f"min({x})"), ("max", f"max({x})"), ("avg", f"avg({x})")]


for _f, _items, _digits in (
    ("rollup", _spread("v"), 6),
    ("rollup_rate", _spread("CASE WHEN ok THEN inc / dt END"), 7),
    ("rollup_increase", _spread("CASE WHEN ok THEN inc END"), 6),
    ("rollup_delta", _spread("CASE WHEN ok THEN dv END"), 6),
    ("rollup_deriv", _spread("CASE WHEN ok THEN dv / dt END"), 7),
    ("rollup_scrape_interval", _spread("CASE WHEN ok THEN dt END"), 4),
    ("rollup_candlestick", [("open", "arg_min(v, t)"), ("high", "max(v)"), ("low", "min(v)"), ("close", "arg_max(v, t)")], 6),
):
    promql(f"q_roll_{_f}", f"{_f}(purchase[{D}d])", windowed(WHERE, D, _several(_items)), labels=("user", "rollup"), digits=_digits)
promql(
    "q_roll_aggr_over_time", f'aggr_over_time("min_over_time", "count_over_time", "increase", purchase[{D}d])',
    windowed(WHERE, D, _several([("min_over_time", "min(v)"), ("count_over_time", "count(*)"), ("increase", "sum(CASE WHEN ok THEN inc ELSE 0 END)")])),
    labels=("user", "rollup"),
)
#: The bucket of a value, 18 to a decade.
VMRANGE = "format('{:.3e}...{:.3e}', pow(10.0, floor(log10(v) * 18) / 18.0), pow(10.0, (floor(log10(v) * 18) + 1) / 18.0))"
promql(
    "q_roll_histogram_over_time", f"histogram_over_time(purchase[{D}d])",
    windowed(WHERE + " AND value > 0", D, f"SELECT usr, {VMRANGE} AS vmrange, g AS ts_ms, count(*) AS value FROM w GROUP BY ALL"),
    labels=("user", "vmrange"),
)
# double exponential smoothing is a fold over the values in order: level s, trend b
_FOLD = """SELECT usr, g AS ts_ms, list_reduce(list_transform(l[2:], lambda x: {'s': x, 'b': 0.0::DOUBLE}), lambda a, e: {'s': 0.4 * e.s + 0.6 * (a.s + a.b),
'b': 0.3 * (0.4 * e.s + 0.6 * (a.s + a.b) - a.s) + 0.7 * a.b}, {'s': l[1], 'b': coalesce(l[2], l[1]) - l[1]}).s AS value FROM (SELECT usr, g, list(v ORDER BY t) AS l FROM w GROUP BY usr, g)"""
for _f in ("holt_winters", "double_exponential_smoothing"):
    promql(f"q_roll_{_f}", f"{_f}(purchase[{D}d], 0.4, 0.3)", windowed(WHERE, D, _FOLD))
# windows that summarise several metrics keep their names apart
promql(
    "q_roll_many_metrics", '{__name__=~"click|view"}[2d]',
    windowed("metric IN ('click', 'view')", 2, "SELECT metric, usr, g AS ts_ms, arg_max(v, t) AS value FROM w GROUP BY ALL"),
    labels=(NAME, "user"),
)
# windows of many steps are made of panes
LONG = 7
for _f in ("count_over_time", "avg_over_time", "max_over_time", "increase", "rate", "delta", "deriv_fast", "resets", "changes", "increases_over_time", "ascent_over_time", "descent_over_time", "integrate", "scrape_interval"):
    _call, _agg, _digits = FUNCTIONS[_f]
    promql(f"q_roll_long_{_f}", _call.format(f=_f, m=f"purchase[{LONG}d]"), windowed(WHERE, LONG, f"SELECT usr, g AS ts_ms, {_agg} AS value FROM w GROUP BY usr, g"), digits=_digits)
