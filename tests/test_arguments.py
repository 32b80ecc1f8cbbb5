import math

import pytest

from chronoweave.functions.arguments import DuplicatePolicy, human_duration, ordered, parse_chunk_size, parse_duration, parse_integer, parse_number_with_unit, parse_timestamp, range_bounds


def test_timestamps():
    assert parse_timestamp("1548149181") == 1548149181
    assert parse_timestamp("-", first=5) == 5 and parse_timestamp("+", last=9) == 9 and parse_timestamp("*", now=7) == 7
    assert parse_timestamp("2024-01-05T00:00:00Z") == 1_704_412_800_000
    assert parse_timestamp("2024-01-05T01:00:00+01:00") == 1_704_412_800_000
    for bad in ("-5", "tomorrow", ""):
        with pytest.raises(ValueError):
            parse_timestamp(bad)


def test_durations():
    assert parse_duration("1h30m") == 5_400_000 and parse_duration("1500") == 1500 and parse_duration("1.5s") == 1500 and parse_duration("-2d") == -172_800_000
    assert parse_duration("2i", step_ms=60_000) == 120_000
    for bad in ("5x", "h", "1h2", "2i"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_numbers():
    assert parse_number_with_unit("1.5Ki") == 1536 and parse_number_with_unit("2kb") == 2000 and parse_integer("4k") == 4000
    for bad in ("x", "1.5", "3q"):
        with pytest.raises(ValueError):
            parse_integer(bad)


def test_chunk_size():
    assert parse_chunk_size("4096") == 4096
    for bad in (46, 49, 1_048_578):
        with pytest.raises(ValueError):
            parse_chunk_size(bad)


@pytest.mark.parametrize("text,value", [("block", "block"), ("KEEP_LAST", "last"), ("keepfirst", "first"), ("first", "first"), ("Min", "min"), ("max", "max"), ("sum", "sum"), (16, "sum"), (0, "block")])
def test_policies(text, value):
    assert DuplicatePolicy.parse(text).value == value


def test_unknown_policy():
    with pytest.raises(ValueError):
        DuplicatePolicy.parse("median")


@pytest.mark.parametrize("policy,value", [("first", 1), ("last", 2), ("min", 1), ("max", 2), ("sum", 3)])
def test_resolution(policy, value):
    p = DuplicatePolicy.parse(policy)
    assert p.resolve(1.0, 2.0) == value
    assert p.resolve(10.0, math.nan) == 10 and p.resolve(math.nan, 8.0) == 8
    with pytest.raises(ValueError):
        DuplicatePolicy.BLOCK.resolve(1.0, 2.0)


def test_bounds():
    assert range_bounds(None, None, now=1_000_000) == (700_000, 1_000_000)
    assert ordered(5, 3) == (3, 5)
    with pytest.raises(ValueError):
        range_bounds(5, 3)


def test_human_durations():
    assert [human_duration(x) for x in (12, 1500, 62_000, 3_720_000)] == ["12ms", "1.5s", "1m2s", "1h2m"]
