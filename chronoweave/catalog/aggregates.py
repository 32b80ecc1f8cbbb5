"""Queries for aggregates over series: the newest sample of the last two days of each user for three kinds of event."""

from __future__ import annotations

from ..model import NAME
from .base import last_values, promql
from .rollups import VMRANGE

WHERE = "metric IN ('click', 'view', 'error')"
X = 'last_over_time({__name__=~"click|view|error"}[2d])'


def q(name: str, text: str, sql: str, labels: tuple[str, ...] = (NAME,), digits: int = 6) -> None:
    promql(f"q_agg_{name}", text, last_values(WHERE, 2, sql), labels, digits)


#: aggregate -> (call, expression, digits); grouped by the metric's name.
SIMPLE = {
    "sum": ("{f}({x})", "sum(v)", 6), "avg": ("{f}({x})", "avg(v)", 6), "min": ("{f}({x})", "min(v)", 6), "max": ("{f}({x})", "max(v)", 6), "count": ("{f}({x})", "count(*)", 6),
    "group": ("{f}({x})", "1.0", 6), "any": ("{f}({x})", "arg_min(v, usr)", 6), "sum2": ("{f}({x})", "sum(v * v)", 4), "geomean": ("{f}({x})", "exp(avg(ln(v)))", 5),
    "stddev": ("{f}({x})", "sqrt(var_pop(v))", 4), "stdvar": ("{f}({x})", "var_pop(v)", 4), "median": ("{f}({x})", "quantile_cont(v, 0.5)", 6),
    "quantile": ("{f}(0.9, {x})", "quantile_cont(v, 0.9)", 6), "distinct": ("{f}({x})", "count(DISTINCT v)", 6), "mad": ("{f}({x})", "mad(v)", 6),
}
for _f, (_call, _e, _digits) in SIMPLE.items():
    q(_f, _call.format(f=_f, x=X) + " by (__name__)", f"SELECT metric, g AS ts_ms, {_e} AS value FROM x GROUP BY ALL", digits=_digits)
q("mode", f"mode(floor({X})) by (__name__)", "SELECT metric, g AS ts_ms, -max({'n': n, 'v': -v}).v AS value FROM (SELECT metric, g, floor(v) AS v, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL")
q("by_prefix", f"sum by (user) ({X})", "SELECT usr, g AS ts_ms, sum(v) AS value FROM x GROUP BY ALL", ("user",))
q("without", f"max({X}) without (user)", "SELECT '' AS metric, g AS ts_ms, max(v) AS value FROM x GROUP BY ALL")
q("all", f"sum({X})", "SELECT g AS ts_ms, sum(v) AS value FROM x GROUP BY ALL", ())
q("limit", f"sum({X}) by (user) limit 3", "SELECT usr, g AS ts_ms, sum(v) AS value FROM x WHERE usr IN (SELECT DISTINCT usr FROM x ORDER BY usr LIMIT 3) GROUP BY ALL", ("user",))
q("several_arguments", "sum(last_over_time(click[2d]), last_over_time(view[2d])) by (user)", "SELECT usr, g AS ts_ms, sum(v) AS value FROM x WHERE metric <> 'error' GROUP BY ALL", ("user",))
q("quantiles", f'quantiles("phi", 0.25, 0.75, {X}) by (__name__)', "SELECT metric, phi, g AS ts_ms, value FROM (SELECT metric, g, unnest(['0.25', '0.75']) AS phi, unnest(quantile_cont(v, [0.25, 0.75])) AS value FROM x GROUP BY metric, g)", (NAME, "phi"))
q("count_values", f'count_values("val", floor({X})) by (__name__)', "SELECT metric, floor(v)::BIGINT::VARCHAR AS val, g AS ts_ms, count(*) AS value FROM x GROUP BY ALL", (NAME, "val"))
q("histogram", f"histogram({X}) by (__name__)", f"SELECT metric, {VMRANGE} AS vmrange, g AS ts_ms, count(*) AS value FROM x WHERE v > 0 GROUP BY ALL", (NAME, "vmrange"))
for _f, _way in (("topk", "DESC"), ("bottomk", "ASC")):
    q(_f, f"{_f}(3, {X}) by (__name__)", f"SELECT metric, usr, g AS ts_ms, v AS value FROM x QUALIFY row_number() OVER (PARTITION BY metric, g ORDER BY v {_way}, usr) <= 3", (NAME, "user"))
    for _s, _e in (("min", "min(v)"), ("max", "max(v)"), ("avg", "avg(v)"), ("last", "arg_max(v, g)"), ("median", "quantile_cont(v, 0.5)")):
        q(
            f"{_f}_{_s}", f"{_f}_{_s}(2, {X}) by (__name__)",
            f", r AS (SELECT metric, usr FROM x GROUP BY metric, usr QUALIFY row_number() OVER (PARTITION BY metric ORDER BY {_e} {_way}, usr) <= 2) SELECT metric, usr, g AS ts_ms, v AS value FROM x JOIN r USING (metric, usr)",
            (NAME, "user"),
        )
q(
    "topk_rest", f'topk_max(2, {X}, "user=others") by (__name__)',
    """, r AS (SELECT metric, usr FROM x GROUP BY metric, usr QUALIFY row_number() OVER (PARTITION BY metric ORDER BY max(v) DESC, usr) <= 2)
    SELECT metric, usr, g AS ts_ms, v AS value FROM x JOIN r USING (metric, usr)
    UNION ALL SELECT metric, 'others', g, sum(v) FROM x ANTI JOIN r USING (metric, usr) GROUP BY metric, g""",
    (NAME, "user"),
)
q("share", "share(last_over_time(click[2d]))", "SELECT usr, g AS ts_ms, v / sum(v) OVER (PARTITION BY g) AS value FROM x WHERE metric = 'click'", ("user",))
q("zscore", "zscore(last_over_time(click[2d]))", "SELECT usr, g AS ts_ms, (v - avg(v) OVER (PARTITION BY g)) / sqrt(var_pop(v) OVER (PARTITION BY g)) AS value FROM x WHERE metric = 'click'", ("user",), 5)
q(
    "outliers_iqr", f"outliers_iqr({X}) by (__name__)",
    """, b AS (SELECT metric, g, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x GROUP BY ALL)
    SELECT metric, usr, g AS ts_ms, v AS value FROM x JOIN b USING (metric, g) WHERE v > b + 1.5 * (b - a) OR v < a - 1.5 * (b - a)""",
    (NAME, "user"),
)
_AWAY = ", m AS (SELECT metric, g, quantile_cont(v, 0.5) AS med FROM x GROUP BY ALL), y AS (SELECT metric, usr, g, v, abs(v - med) AS away FROM x JOIN m USING (metric, g))"
q(
    "outliers_mad", f"outliers_mad(6, {X}) by (__name__)",
    _AWAY + """, d AS (SELECT metric, g, quantile_cont(away, 0.5) AS mad FROM y GROUP BY ALL), far AS (SELECT DISTINCT metric, usr FROM y JOIN d USING (metric, g) WHERE away > 6 * mad)
    SELECT metric, usr, g AS ts_ms, v AS value FROM x SEMI JOIN far USING (metric, usr)""",
    (NAME, "user"),
)
q(
    "outliersk", f"outliersk(2, {X}) by (__name__)",
    _AWAY + """, r AS (SELECT metric, usr FROM y GROUP BY metric, usr QUALIFY row_number() OVER (PARTITION BY metric ORDER BY sum(away * away) DESC, usr) <= 2)
    SELECT metric, usr, g AS ts_ms, v AS value FROM x SEMI JOIN r USING (metric, usr)""",
    (NAME, "user"),
)
# the series that stay are those of least MD5 of their labels as text
q(
    "limitk", f"limitk(2, {X}) by (__name__)",
    """, r AS (SELECT metric, usr FROM x GROUP BY metric, usr QUALIFY row_number() OVER (PARTITION BY metric ORDER BY md5('__name__' || chr(31) || metric || chr(30) || 'user' || chr(31) || usr)) <= 2)
    SELECT metric, usr, g AS ts_ms, v AS value FROM x SEMI JOIN r USING (metric, usr)""",
    (NAME, "user"),
)
