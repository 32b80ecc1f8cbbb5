"""Lexer and parser of the query language (PromQL with the MetricsQL additions)."""

from __future__ import annotations

import ast as _python
import re
from dataclasses import replace

from ..functions.arguments import parse_number_with_unit
from ..model import NAME
from ..operators.selectors import Matcher, Selector
from .ast import Aggregate, Binary, Call, Duration, Node, Number, Series, Subquery, Text, Unary

AGGREGATES = frozenset(
    "sum avg min max count group any sum2 geomean stddev stdvar median quantile quantiles mode distinct count_values topk bottomk "
    "topk_min topk_max topk_avg topk_last topk_median bottomk_min bottomk_max bottomk_avg bottomk_last bottomk_median limitk share zscore mad "
    "outliers_iqr outliers_mad outliersk histogram".split()
)
#: Aggregates that a user adds (see planner.register_aggregate).
OWN_AGGREGATES: set[str] = set()
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<duration>\d+(?:\.\d+)?(?:ms|[smhdwyi])(?:\d+(?:\.\d+)?(?:ms|[smhdwyi]))*(?![A-Za-z0-9_.]))
    |(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:[KkMGT]i?B?(?![A-Za-z0-9_]))?)
    |(?P<name>(?:[A-Za-z_]|:(?=[A-Za-z_]))(?:[A-Za-z0-9_:.]|\\.)*)
    |(?P<op>=~|!~|==|!=|>=|<=|[-+*/%^<>=(){}\[\],@:])""",
    re.X | re.S,
)
#: Binding strength; ^ binds to the right.
_LEVEL = {"default": 0, "if": 0, "ifnot": 0, "or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 7}
_COMPARISON = frozenset(["==", "!=", "<", ">", "<=", ">="])
_UNARY = 6


class ParseError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


def unquote(s: str) -> str:
    if s[0] == "`":
        return s[1:-1]
    try:
        return _python.literal_eval(s.replace("\n", "\\n"))
    except (SyntaxError, ValueError) as e:
        raise ParseError(f"bad string {s}") from e


def number(s: str) -> float:
    return float(int(s, 16)) if s.lower().startswith("0x") else parse_number_with_unit(s)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0
        self.templates: list[dict[str, tuple[tuple[str, ...], Node]]] = []

    # tokens
    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def value(self) -> str:
        return self.tokens[self.at][1]

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.tokens[self.at]
        if value is not None and (v.lower() if k == "name" else v) != value or kind is not None and k != kind:
            raise ParseError(f"expected {value or kind}, got {v or 'the end'!r}")
        self.at += 1
        return v

    def seen(self, *values: str) -> bool:
        return self.kind in ("op", "name") and (self.value.lower() if self.kind == "name" else self.value) in values

    def maybe(self, *values: str) -> bool:
        if self.seen(*values):
            self.at += 1
            return True
        return False

    # grammar
    def parse(self) -> Node:
        out = self.expression()
        if self.kind != "end":
            raise ParseError(f"unexpected {self.value!r}")
        return out

    def expression(self, least: int = 0) -> Node:
        left = self.unary()
        while True:
            op = self.value.lower() if self.kind == "name" else self.value
            if self.kind not in ("op", "name") or op not in _LEVEL or _LEVEL[op] < least:
                return left
            self.at += 1
            as_bool = self.maybe("bool")
            if as_bool and op not in _COMPARISON:
                raise ParseError("bool only goes with comparisons")
            matching, labels, side, copied = None, (), None, ()
            if self.seen("on", "ignoring"):
                matching = self.take().lower()
                labels = self.names()
            if self.seen("group_left", "group_right"):
                side = self.take().lower()
                copied = self.names() if self.seen("(") else ()
                if op in ("and", "or", "unless"):
                    raise ParseError(f"no grouping with {op}")
            right = self.expression(_LEVEL[op] + (op != "^"))
            left = Binary(op, left, right, as_bool, matching, labels, side, copied, self.maybe("keep_metric_names"))

    def unary(self) -> Node:
        if self.maybe("+"):
            return self.expression(_UNARY)
        if self.maybe("-"):
            inner = self.expression(_UNARY)
            return Number(-inner.value) if isinstance(inner, Number) else Unary(inner)
        return self.postfix(self.primary())

    def postfix(self, node: Node) -> Node:
        while True:
            if self.maybe("["):
                window, step, sub = None, None, False
                if not self.seen(":"):
                    window = self.duration()
                if self.kind == "op" and self.value == ":" or self.kind == "name" and self.value.startswith(":"):
                    sub = True
                    if self.kind == "name":
                        raise ParseError(f"bad step {self.value!r}")
                    self.at += 1
                    if not self.seen("]"):
                        step = self.duration()
                self.take("]")
                if isinstance(node, Series) and node.window is None and node.offset is None and not sub:
                    node = replace(node, window=window)
                else:
                    node = Subquery(node, window, step)
            elif self.maybe("offset"):
                sign = "-" if self.maybe("-") else ""
                node = self.moved(node, offset=sign + self.duration())
            elif self.maybe("@"):
                node = self.moved(node, at=self.postfix_free())
            else:
                return node

    def postfix_free(self) -> Node:
        return self.primary()

    def moved(self, node: Node, **what: object) -> Node:
        return replace(node, **what) if isinstance(node, (Series, Subquery)) else Subquery(node, None, **what)

    def duration(self) -> str:
        if self.kind in ("duration", "number"):
            v = self.value
            self.at += 1
            return v if self.tokens[self.at - 1][0] == "duration" else str(round(number(v) * 1000))
        raise ParseError(f"expected a duration, got {self.value!r}")

    def names(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while not self.maybe(")"):
            out.append(self.take() if self.kind == "name" else unquote(self.take(kind="text")))
            if not self.seen(")"):
                self.take(",")
        return tuple(out)

    def arguments(self) -> tuple[Node, ...]:
        self.take("(")
        out = []
        while not self.maybe(")"):
            out.append(self.expression())
            if not self.seen(")"):
                self.take(",")
        return tuple(out)

    def primary(self) -> Node:
        kind, v = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Number(number(v))
        if kind == "duration":
            self.at += 1
            return Duration(v)
        if kind == "text":
            self.at += 1
            return Text(unquote(v))
        if self.maybe("("):
            items = [self.expression()]
            while self.maybe(","):
                items.append(self.expression())
            self.take(")")
            return items[0] if len(items) == 1 else Call("union", tuple(items))
        if kind == "op" and v == "{":
            return Series(self.selector(None))
        if kind != "name":
            raise ParseError(f"unexpected {v or 'end of the query'!r}")
        low, following = v.lower(), self.tokens[self.at + 1]
        if low in ("inf", "nan") and following[1] not in ("(", "{"):
            self.at += 1
            return Number(float(low))
        if low == "with" and following[1] == "(":
            return self.with_templates()
        template = next((t[v] for t in reversed(self.templates) if v in t), None)
        if template is not None:
            return self.expand(v, template)
        if (low in AGGREGATES or low in OWN_AGGREGATES) and (following[1] == "(" or following[1].lower() in ("by", "without")):
            return self.aggregate()
        self.at += 1
        if self.seen("("):
            call = Call(low, self.arguments())
            return replace(call, keep_names=True) if self.maybe("keep_metric_names") else call
        return Series(self.selector(re.sub(r"\\(.)", r"\1", v)))

    def aggregate(self) -> Node:
        name = self.take().lower()
        grouping, labels, limit = None, (), None
        if self.seen("by", "without"):
            grouping, labels = self.take().lower(), self.names()
        args = self.arguments()
        if grouping is None and self.seen("by", "without"):
            grouping, labels = self.take().lower(), self.names()
        if self.maybe("limit"):
            limit = int(number(self.take(kind="number")))
        return Aggregate(name, args, grouping, labels, limit)

    def selector(self, metric: str | None) -> Selector:
        base = (Matcher(NAME, "=", metric),) if metric else ()
        groups: list[tuple[Matcher, ...]] = []
        if self.maybe("{"):
            group: list[Matcher] = []
            while not self.maybe("}"):
                if self.maybe("or"):
                    groups.append((*base, *group))
                    group = []
                    continue
                if self.kind == "text":  # {"metric", ...}
                    group.append(Matcher(NAME, "=", unquote(self.take())))
                else:
                    name = self.take(kind="name")
                    op = self.take(kind="op")
                    if op not in ("=", "!=", "=~", "!~"):
                        raise ParseError(f"unknown matcher operator {op!r}")
                    group.append(Matcher(name, op, unquote(self.take(kind="text"))))
                if not self.seen("}", "or"):
                    self.take(",")
            groups.append((*base, *group))
        else:
            groups.append(base)
        if not any(groups):
            raise ParseError("an empty selector picks nothing")
        return Selector(tuple(groups))

    # WITH (name = expr, f(a, b) = expr) expr
    def with_templates(self) -> Node:
        self.take()
        self.take("(")
        scope: dict[str, tuple[tuple[str, ...], Node]] = {}
        self.templates.append(scope)
        while not self.maybe(")"):
            name = self.take(kind="name")
            params = self.names() if self.seen("(") else ()
            self.take("=")
            for p in params:  # a parameter stands for itself until the call
                scope[p] = ((), Series(Selector(((Matcher(NAME, "=", "\0" + p),),))))
            body = self.expression()
            for p in params:
                del scope[p]
            scope[name] = (params, body)
            if not self.seen(")"):
                self.take(",")
        out = self.expression()
        self.templates.pop()
        return out

    def expand(self, name: str, template: tuple[tuple[str, ...], Node]) -> Node:
        self.at += 1
        params, body = template
        if self.seen("{") and isinstance(body, Series):  # more matchers on a named selector
            more = self.selector(None)
            return replace(body, selector=Selector(tuple((*a, *b) for a in body.selector.groups for b in more.groups)))
        args = self.arguments() if params else ()
        if len(args) != len(params):
            raise ParseError(f"{name} takes {len(params)} arguments")
        return substitute(body, dict(zip(params, args, strict=True)))


def substitute(node: object, values: dict[str, Node]) -> object:
    if isinstance(node, Series):
        g = node.selector.groups
        if len(g) == 1 and len(g[0]) == 1 and g[0][0].value.startswith("\0"):
            got = values.get(g[0][0].value[1:])
            if got is None:
                return node
            return replace(got, window=node.window) if node.window and isinstance(got, Series) else got
        return node
    if isinstance(node, tuple):
        return tuple(substitute(x, values) for x in node)
    if isinstance(node, Node) and hasattr(node, "__dataclass_fields__"):
        return replace(node, **{k: substitute(getattr(node, k), values) for k in node.__dataclass_fields__ if isinstance(getattr(node, k), (Node, tuple))})
    return node


def parse(text: str) -> Node:
    return fold(Parser(text).parse())


def parse_selector(text: str) -> Selector:
    p = Parser(text)
    node = p.primary()
    if p.kind != "end" or not isinstance(node, Series):
        raise ParseError(f"not a series selector: {text!r}")
    return node.selector


def fold(node: object) -> object:
    """Constant folding of arithmetic on numbers."""
    if isinstance(node, tuple):
        return tuple(fold(x) for x in node)
    if not isinstance(node, Node):
        return node
    node = replace(node, **{k: fold(getattr(node, k)) for k in node.__dataclass_fields__ if isinstance(getattr(node, k), (Node, tuple))})
    if isinstance(node, Binary) and isinstance(node.left, Number) and isinstance(node.right, Number) and node.op in "+-*/%^":
        return Number(arithmetic(node.op, node.left.value, node.right.value))
    if isinstance(node, Unary) and isinstance(node.expr, Number):
        return Number(-node.expr.value)
    return node


def arithmetic(op: str, a: float, b: float) -> float:
    inf, nan = float("inf"), float("nan")
    try:
        if op == "/":
            return a / b if b else nan if not a or a != a else inf if a > 0 else -inf
        if op == "%":
            if not b or b != b:
                return nan
            whole = 1 <= abs(a / b) < 2**53 and (a / b).is_integer()  # as functions.numeric.remainder
            return a * 0.0 if whole else __import__("math").fmod(a, b)
        if op == "^":
            return __import__("math").pow(a, b)
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    except (OverflowError, ValueError):
        return nan if op != "^" or a < 0 else inf
