"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.selectors import Selector


class Node:
    pass


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Duration(Node):
    text: str  # resolved by the planner: it may be relative to the step


@dataclass(frozen=True)
class Series(Node):
    """selector[window] offset o @ at; without a window an instant selector."""

    selector: Selector
    window: str | None = None
    offset: str | None = None
    at: Node | None = None


@dataclass(frozen=True)
class Subquery(Node):
    """expr[window:step] offset o @ at; without a window the expression is only moved."""

    expr: Node
    window: str | None
    step: str | None = None
    offset: str | None = None
    at: Node | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    keep_names: bool = False


@dataclass(frozen=True)
class Aggregate(Node):
    name: str
    args: tuple[Node, ...]
    grouping: str | None = None  # by, without
    labels: tuple[str, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Unary(Node):
    expr: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    as_bool: bool = False
    matching: str | None = None  # on, ignoring
    labels: tuple[str, ...] = ()
    side: str | None = None  # group_left, group_right
    copied: tuple[str, ...] = field(default=())
    keep_names: bool = False
