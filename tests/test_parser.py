import pytest

from chronoweave.operators.selectors import Matcher
from chronoweave.plans.ast import Aggregate, Binary, Call, Duration, Number, Series, Subquery, Unary
from chronoweave.plans.parser import ParseError, parse, parse_selector


def test_selector_groups_and_quotes():
    s = parse_selector("""m{a="b",c!='d',e=~"f|g" or h!~`i\\d`}""")
    assert s.groups == (
        (Matcher("__name__", "=", "m"), Matcher("a", "=", "b"), Matcher("c", "!=", "d"), Matcher("e", "=~", "f|g")),
        (Matcher("__name__", "=", "m"), Matcher("h", "!~", "i\\d")),
    )
    assert parse_selector('{__name__="x"}').metric == "x"


def test_precedence():
    n = parse("a + b * c ^ d ^ e > bool 2 and f or g")
    assert isinstance(n, Binary) and n.op == "or" and n.left.op == "and"
    compare = n.left.left
    assert compare.op == ">" and compare.as_bool and compare.left.op == "+"
    power = compare.left.right.right
    assert power.op == "^" and power.right.op == "^"
    assert parse("-2 ^ 2") == Number(-4.0)
    assert isinstance(parse("-a ^ 2"), Unary)


def test_constants_are_folded():
    assert parse("24 * 3600 + (14.4 * 0.2)") == Number(24 * 3600 + 14.4 * 0.2)
    assert parse("1 / 0") == Number(float("inf"))


def test_windows_offsets_and_subqueries():
    n = parse("rate(m[5m] offset 1h @ 100)").args[0]
    assert isinstance(n, Series) and (n.window, n.offset, n.at) == ("5m", "1h", Number(100.0))
    n = parse("max_over_time(rate(m[1m])[1h:5m] offset -2m)").args[0]
    assert isinstance(n, Subquery) and (n.window, n.step, n.offset) == ("1h", "5m", "-2m")
    assert parse("1h30m") == Duration("1h30m")


def test_aggregates_in_both_spellings():
    a, b = parse("sum by (x, y) (m)"), parse("sum(m) by (x, y)")
    assert a == b and isinstance(a, Aggregate) and a.labels == ("x", "y")
    assert parse("topk(3, m) without (x) limit 2").limit == 2


def test_matching_modifiers():
    n = parse("a / on (x) group_left (y) b keep_metric_names")
    assert (n.matching, n.labels, n.side, n.copied, n.keep_names) == ("on", ("x",), "group_left", ("y",), True)


def test_templates():
    assert parse('WITH (f(q) = q * 2, s = m{a="b"}) f(s{c="d"})') == parse('m{a="b",c="d"} * 2')


def test_names_with_colons_and_comments():
    n = parse("job:requests:rate5m # a rule\n + 1")
    assert n.left.selector.metric == "job:requests:rate5m"
    assert isinstance(parse("pi()"), Call)


@pytest.mark.parametrize("bad", ["", "m{", "sum(", "m[5x]", "{}", "a and on (x) group_left b", "1 +", "m{a>1}", 'm{a=~"(?=x)"}', "a == bool", "f(a b)", '"open'])
def test_errors(bad):
    with pytest.raises(ValueError):
        parse(bad)
    assert issubclass(ParseError, ValueError)
