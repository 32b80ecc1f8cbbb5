"""Label functions: each makes a new label string from the old one (and from the value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NAME, drop_labels, keep_labels, label, set_labels
from ..operators.selectors import check_regex, java_regex, regex_test


def replacement(text: str) -> str:
    """``$1`` and ``${1}`` mean the same to Java without the braces."""
    import re

    return re.sub(r"\$\{(\w+)\}", r"$\1", text.replace("\\", "\\\\"))


def label_replace(lk: Column, dst: str, repl: str, src: str, pattern: str) -> Column:
    check_regex(pattern)
    v = label(lk, src)
    whole = f"^(?:{java_regex(pattern)})$"
    return F.when(v.rlike(whole), set_labels(lk, {dst: F.regexp_replace(v, whole, replacement(repl))})).otherwise(lk)


def label_transform(lk: Column, name: str, pattern: str, repl: str) -> Column:
    check_regex(pattern)
    return set_labels(lk, {name: F.regexp_replace(label(lk, name), java_regex(pattern), replacement(repl))})


def label_map(lk: Column, name: str, *pairs: str) -> Column:
    v, out = label(lk, name), label(lk, name)
    for old, new in zip(pairs[::2], pairs[1::2], strict=True):
        out = F.when(v == old, new).otherwise(out)
    return set_labels(lk, {name: out})


def pairwise(lk: Column, *pairs: str, move: bool = False) -> Column:
    for src, dst in zip(pairs[::2], pairs[1::2], strict=True):
        moved = set_labels(drop_labels(lk, [src]) if move else lk, {dst: label(lk, src)})
        lk = F.when(label(lk, src) != "", moved).otherwise(lk)
    return lk


def changed(f: Callable[[Column], Column]) -> Callable[..., Column]:
    def run(lk: Column, *names: str) -> Column:
        return set_labels(lk, {n: f(label(lk, n)) for n in names})

    return run


def graphite_group(lk: Column, *places: float) -> Column:
    parts = F.split(label(lk, NAME), r"\.")
    return set_labels(lk, {NAME: F.array_join(F.array(*[F.coalesce(F.get(parts, F.lit(int(p))), F.lit("")) for p in places]), ".")})


#: name -> new label string from the old one and the call's texts (numbers for the last).
REWRITE: dict[str, Callable[..., Column]] = {
    "label_set": lambda lk, *p: set_labels(lk, dict(zip(p[::2], p[1::2], strict=True))),
    "label_del": lambda lk, *n: drop_labels(lk, list(n)),
    "label_keep": lambda lk, *n: keep_labels(lk, list(n)),
    "label_copy": lambda lk, *p: pairwise(lk, *p),
    "label_move": lambda lk, *p: pairwise(lk, *p, move=True),
    "label_join": lambda lk, dst, sep, *src: set_labels(lk, {dst: F.concat_ws(sep, *[label(lk, s) for s in src])}),
    "label_replace": label_replace,
    "label_transform": label_transform,
    "label_map": label_map,
    "label_lowercase": changed(F.lower),
    "label_uppercase": changed(F.upper),
    "label_graphite_group": graphite_group,
    "alias": lambda lk, name: set_labels(lk, {NAME: name}),
}
#: name -> which series stay.
FILTER: dict[str, Callable[..., Column]] = {
    "label_match": lambda lk, n, p: regex_test(label(lk, n), p),
    "label_mismatch": lambda lk, n, p: ~regex_test(label(lk, n), p),
    "labels_equal": lambda lk, a, *rest: F.array_size(F.array_distinct(F.array(*[label(lk, n) for n in (a, *rest)]))) == 1,
}
