import itertools
import re

import pytest
from helpers import source
from pyspark.sql import functions as F

from chronoweave.model import drop_labels, full_name, keep_labels, key_map, label, labels_key, map_key, set_labels
from chronoweave.operators.selectors import Matcher, Selector, predicate, regex_test
from chronoweave.plans.parser import parse_selector

SERIES = [
    {"__name__": "latency", "region": "us-east-1", "env": "qa"}, {"__name__": "latency", "region": "us-east-2", "env": "dev"},
    {"__name__": "latency", "env": "prod"}, {"__name__": "errors", "region": "us-east-1"}, {"__name__": "errors"},
]


@pytest.fixture(scope="module")
def src(spark):
    return source(spark, [(s, [(1, 1.0)]) for s in SERIES])


def picked(src, *texts):
    return sorted(r["lk"] for r in src.scan([parse_selector(t) for t in texts], 0, 10).collect())


def by_hand(f):
    return sorted("\x1e".join(f"{k}\x1f{v}" for k, v in sorted(s.items())) for s in SERIES if f(s))


@pytest.mark.parametrize("op,value", list(itertools.product(["=", "!=", "=~", "!~"], ["", "us-east-1", "us-.*", ".*", ".+", ".*1", "us-east-1|us-east-2", "(us|eu)-east-[12]", ".*east.*", "us-east-1|"])))
def test_each_matcher_with_missing_labels(src, op, value):
    def f(s):
        v = s.get("region", "")
        got = v == value if op in ("=", "!=") else re.fullmatch(value, v) is not None
        return got == (op in ("=", "=~"))

    assert picked(src, f'{{region{op}"{value}"}}' if value or op != "=" else '{region=""}') == by_hand(f)


def test_or_groups_several_and_none(spark, src):
    assert picked(src, '{env="qa" or __name__="errors"}') == by_hand(lambda s: s.get("env") == "qa" or s["__name__"] == "errors")
    assert picked(src, 'latency{env="qa"}', "errors") == by_hand(lambda s: s.get("env") == "qa" or s["__name__"] == "errors")
    assert picked(src) == []
    assert picked(src, 'latency{env="qa",region="us-east-2"}') == []


def test_named_groups_and_lookaround(spark):
    df = spark.createDataFrame([("ab",)], "v string")
    assert df.where(regex_test(F.col("v"), "(?P<first_one>a)b")).count() == 1
    for bad in ("(?=a)b", "(?<!a)b", r"(a)\1"):
        with pytest.raises(ValueError):
            Matcher("x", "=~", bad)
    with pytest.raises(ValueError):
        Matcher("x", "<", "1")


def test_metric_of_a_selector():
    assert parse_selector("m{a='b'}").metric == "m"
    assert Selector(((Matcher("__name__", "=~", "m.*"),),)).metric is None


def test_label_strings(spark):
    df = spark.createDataFrame([("m", 'a"b\\c\n', None), (None, "", "x")], "n string, a string, b string").select(labels_key({"__name__": F.col("n"), "a": F.col("a"), "b": F.col("b")}).alias("lk"))
    names = [r[0] for r in df.select(full_name(F.col("lk"))).collect()]
    assert names == ['m{a="a\\"b\\\\c\\n"}', '{b="x"}']
    lk = F.col("lk")
    same = df.select(map_key(key_map(lk)) == lk, label(lk, "nosuch") == "", keep_labels(lk, []) == "", set_labels(drop_labels(lk, ["a"]), {"a": label(lk, "a")}) == lk).collect()
    assert all(all(r) for r in same)


def test_predicates_are_never_null(spark):
    df = spark.createDataFrame([(None,)], "k string")
    for op in ("=", "!=", "=~", "!~"):
        p = predicate([Selector(((Matcher("k", op, "v"),),))], lambda n: F.coalesce(F.col(n), F.lit("")))
        assert df.select(p).first()[0] is not None
