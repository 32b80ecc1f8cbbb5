"""Series selectors as column predicates.

A selector is an OR of groups, each an AND of matchers. A missing label is the same as an empty one, and regexes are
anchored. Simple regexes become equality, prefix or suffix tests, which scans can push down and skip row groups by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NAME

_PLAIN = r"[^\\^$.|?*+()\[\]{}]"


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str

    def __post_init__(self) -> None:
        if self.op not in ("=", "!=", "=~", "!~"):
            raise ValueError(f"unknown matcher operator {self.op!r}")
        if self.op in ("=~", "!~"):
            check_regex(self.value)

    def __str__(self) -> str:
        return f'{self.name}{self.op}"{self.value}"'


@dataclass(frozen=True)
class Selector:
    """groups: any of these may hold; in a group all matchers must."""

    groups: tuple[tuple[Matcher, ...], ...] = field(default_factory=tuple)

    @property
    def metric(self) -> str | None:
        """The one metric name that all groups ask for, if there is one."""
        names = {next((m.value for m in g if m.name == NAME and m.op == "="), None) for g in self.groups}
        return names.pop() if len(names) == 1 else None


def check_regex(pattern: str) -> None:
    """Regexes have neither look-around nor back-references."""
    if re.search(r"\(\?<?[=!]", pattern) or re.search(r"(?<!\\)\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references aren't part of the regex dialect: {pattern!r}")


def java_regex(pattern: str) -> str:
    """Named groups as Java writes them."""
    return re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9_]*)>", lambda m: "(?<" + m[1].replace("_", "") + ">", pattern)


def regex_test(c: Column, pattern: str) -> Column:
    """Whole-string match, by the cheapest test that says the same."""
    p = pattern[1:] if pattern.startswith("^") else pattern
    p = p[:-1] if p.endswith("$") and not p.endswith("\\$") else p
    if p == "":
        return c == ""
    if p in (".*",):
        return F.lit(True)
    if p in (".+",):
        return c != ""
    if re.fullmatch(f"{_PLAIN}+", p):
        return c == p
    if re.fullmatch(rf"{_PLAIN}+(\|{_PLAIN}+)*", p):
        return c.isin(p.split("|"))
    if m := re.fullmatch(rf"({_PLAIN}+)\.\*", p):
        return F.startswith(c, F.lit(m[1]))
    if m := re.fullmatch(rf"\.\*({_PLAIN}+)", p):
        return F.endswith(c, F.lit(m[1]))
    if m := re.fullmatch(rf"\.\*({_PLAIN}+)\.\*", p):
        return F.contains(c, F.lit(m[1]))
    return c.rlike(f"^(?:{java_regex(p)})$")


def match(m: Matcher, value: Column) -> Column:
    """value: the label as a non-null string column."""
    test = value == m.value if m.op in ("=", "!=") else regex_test(value, m.value)
    return ~test if m.op in ("!=", "!~") else test


def takes_empty(m: Matcher) -> bool:
    """Whether a series without the label passes."""
    if m.op in ("=", "!="):
        return (m.value == "") == (m.op == "=")
    return bool(re.fullmatch(m.value, "")) == (m.op == "=~")


def predicate(selectors: Sequence[Selector], label: Callable[[str], Column], stored: Callable[[str], Column | None] = lambda n: None) -> Column:
    """Series that any of the selectors picks; none if there is no selector. label: a label's value, '' if there is
    none. stored: the column that holds it, with NULL for none; matchers that a missing label fails are tests on
    it, so that they reach the scan's own filters."""

    def test(m: Matcher) -> Column:
        raw = stored(m.name) if m.op in ("=", "=~") and not takes_empty(m) else None
        return match(m, label(m.name) if raw is None else raw)

    groups = [reduce(lambda a, b: a & b, [test(m) for m in g], F.lit(True)) for s in selectors for g in s.groups]
    return reduce(lambda a, b: a | b, groups) if groups else F.lit(False)


def match_all(label: Column) -> Column:
    return label != ""


def match_none() -> Column:
    return F.lit(False)
