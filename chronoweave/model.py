"""Data model: series (dimension), samples (facts), and label strings.

A label set is one string: sorted ``name<US>value`` pairs joined by ``<RS>``. Unlike a map it can be a key of joins
and hash aggregates. A label with an empty value is the same as no label. The metric's name is label ``__name__``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
PAIR, ITEM = "\x1f", "\x1e"

SERIES = (
    "db int, series_id bigint, key string, metric string, labels map<string,string>, retention_ms bigint, "
    "dedupe_ms bigint, dup_policy string, sig_digits int, chunk_size int"
)
SAMPLES = "series_id bigint, ts_ms bigint, value double"


def text_of(value: Column | str | None) -> Column:
    return F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit("")).cast("string")


def labels_key(pairs: dict[str, Column | str]) -> Column:
    """The label string of named columns; empty and NULL values are left out."""
    parts = []
    for name in sorted(pairs):
        v = text_of(pairs[name])
        parts.append(F.when(v != "", F.concat(F.lit(name + PAIR), v)))
    return F.concat_ws(ITEM, *parts) if parts else F.lit("")


def map_key(labels: Column) -> Column:
    """The label string of a map column."""
    entries = F.filter(F.array_sort(F.map_entries(labels)), lambda e: e["value"] != "")
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(PAIR), e["value"])), ITEM)


def key_map(lk: Column) -> Column:
    """The map of a label string."""
    return F.when(lk == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(lk, F.lit(ITEM), F.lit(PAIR)))


def label(lk: Column, name: str) -> Column:
    """One label's value, '' if there is none."""
    return F.coalesce(F.try_element_at(key_map(lk), F.lit(name)), F.lit(""))


def keep_labels(lk: Column, names: list[str]) -> Column:
    return labels_key({n: label(lk, n) for n in names}) if names else F.lit("")


def drop_labels(lk: Column, names: list[str]) -> Column:
    if not names:
        return lk
    gone = F.lit(False)
    return F.array_join(F.filter(F.split(lk, ITEM), lambda x: ~_any_prefix(x, names, gone)), ITEM)


def _any_prefix(x: Column, names: list[str], out: Column) -> Column:
    for n in names:
        out = out | F.startswith(x, F.lit(n + PAIR))
    return out


def set_labels(lk: Column, values: dict[str, Column | str]) -> Column:
    """Labels put in or replaced; an empty value takes the label away."""
    rest = drop_labels(lk, list(values))
    added = labels_key(values)
    return F.array_join(F.array_sort(F.array_remove(F.split(F.concat_ws(ITEM, rest, added), ITEM), "")), ITEM)


def full_name(lk: Column) -> Column:
    """``name{k="v",...}`` with quotes, backslashes and line ends of values escaped."""
    esc = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    rest = F.array_remove(F.split(drop_labels(lk, [NAME]), ITEM), "")
    shown = F.array_join(F.transform(rest, lambda x: F.concat(F.substring_index(x, PAIR, 1), F.lit('="'), esc(F.substring_index(x, PAIR, -1)), F.lit('"'))), ",")
    return F.concat(label(lk, NAME), F.when(F.size(rest) > 0, F.concat(F.lit("{"), shown, F.lit("}"))).otherwise(F.lit("")))


def series_id(lk: Column) -> Column:
    """A stable id: a hash of the label string."""
    return F.xxhash64(lk)
