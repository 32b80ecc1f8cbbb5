import pytest

from chronoweave.commands import CommandError, Commands
from chronoweave.engine import Engine, NoSuchSeries, SeriesExists, SeriesOptions
from chronoweave.operators.metadata import NoSeries
from chronoweave.operators.oplog import QueryLog

NOW = 1_704_412_800_000


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), clock=lambda: NOW)
    c = Commands(e)
    for area, region in (("3", "east"), ("3", "west"), ("4", "east")):
        c.run("CREATE-SERIES", f"temperature:{area}:{region}", "RETENTION", "30d", "METRIC_NAME", "temperature", "LABELS", "area_id", area, "region", region)
    assert c.run("MADD", *[x for k in ("temperature:3:east", "temperature:3:west", "temperature:4:east") for i in range(4) for x in (k, NOW - i * 60_000, i + len(k))]) == [NOW - i * 60_000 for _ in range(3) for i in range(4)]
    return e


@pytest.fixture(scope="module")
def run(engine):
    return Commands(engine).run


def test_create_rejects_keys_and_labels_that_are_there(engine, run):
    with pytest.raises(SeriesExists):
        run("X.create", "temperature:3:east")
    with pytest.raises(SeriesExists):
        run("CREATE-SERIES", "other", "LABELS", "area_id", "3", "region", "east", "__name__", "temperature")
    for bad in (("SIGNIFICANT_DIGITS", "17"), ("CHUNK_SIZE", "47"), ("LABELS", "a"), ("NOSUCH", "1"), ("RETENTION", "soon"), ("DUPLICATE_POLICY", "median")):
        with pytest.raises(ValueError):
            run("CREATE-SERIES", "bad", *bad)


def test_get_range_and_words(run):
    key = "temperature:3:east"
    assert run("GET", key) == [NOW, float(len(key))]
    every = run("RANGE", key, "-", "+")
    assert [t for t, _ in every] == [NOW - i * 60_000 for i in (3, 2, 1, 0)]
    assert run("RANGE", key, "-", "*", "COUNT", 2) == every[:2]
    assert run("RANGE", key, "-", "+", "FILTER_BY_VALUE", 19, 20) == [x for x in every if 19 <= x[1] <= 20]
    assert run("RANGE", key, "-", "+", "FILTER_BY_TS", NOW, NOW - 60_000, "COUNT", 1) == [(NOW - 60_000, 19.0)]
    assert run("RANGE", key, "-", "+", "AGGREGATION", "max", "2m", "BUCKETTIMESTAMP", "end", "ALIGN", "start") == [(NOW - 60_000, 21.0), (NOW + 60_000, 19.0)]
    for bad in (("NOSUCH",), ("EMPTY",), ("AGGREGATION", "p99", "1m"), ("FILTER_BY_VALUE", 2, 1)):
        with pytest.raises(ValueError):
            run("RANGE", key, "-", "+", *bad)
    with pytest.raises(NoSuchSeries):
        run("GET", "nosuch")


def test_queries_and_their_log(engine, run):
    got = run("QUERY", "avg(temperature) by (area_id)", "TIME", NOW)
    assert got["data"]["resultType"] == "vector"
    assert [(r["metric"], r["value"]) for r in got["data"]["result"]] == [({"area_id": "3"}, [NOW, "18"]), ({"area_id": "4"}, [NOW, "18"])]
    got = run("QUERY-RANGE", "sum(temperature)", "START", NOW - 60_000, "END", NOW, "STEP", 60)
    assert got["data"]["result"] == [{"metric": {}, "values": [[NOW - 60_000, "57"], [NOW, "54"]]}]
    assert run("QUERY", "temperature / 7", "TIME", NOW, "ROUNDING", 2)["data"]["result"][0]["value"][1] == "2.57"
    top = run("TOP-QUERIES", "TOP_K", 1)
    assert len(top["topByCount"]) == 1 and top["topByCount"][0]["count"] == 1
    assert run("ACTIVE-QUERIES")["data"]["result"] == []
    assert len(engine.cache) >= 3 and run("RESET-ROLLUP-CACHE") == "OK" and len(engine.cache) == 0
    with pytest.raises(ValueError):
        run("QUERY-RANGE", "temperature", "START", NOW, "END", NOW - 1)


def test_metadata(run):
    sel = 'temperature{area_id="3"}'
    assert run("SERIES", "MATCH", sel)["data"] == [{"__name__": "temperature", "area_id": "3", "region": r} for r in ("east", "west")]
    assert run("SERIES", "MATCH", sel, "temperature{area_id='4'}", "LIMIT", 1)["data"][0]["area_id"] == "3"
    assert run("CARDINALITY", "START", NOW - 60_000, "END", NOW, "MATCH", "temperature") == 3
    assert run("CARDINALITY", "MATCH", "temperature", "START", 0, "END", 1) == 0
    with pytest.raises(NoSeries):
        run("CARDINALITY", "MATCH", "nosuch")
    with pytest.raises(NoSeries):
        run("DELETE-RANGE", "nosuch")
    with pytest.raises(ValueError):
        run("SERIES", "MATCH", "temperature", "START", NOW + 1)
    assert run("LABELS", "MATCH", sel)["data"] == ["__name__", "area_id", "region"]
    assert run("LABEL-VALUES", "region")["data"] == ["east", "west"]
    assert run("LABEL_VALUES", "region", "MATCH", 'temperature{area_id="4"}')["data"] == ["east"]
    stats = run("STATS")
    assert stats["totalSeries"] == 3 and stats["seriesCountByMetricName"] == [("temperature", 3)]
    assert stats["labelValueCountByLabelName"] == [("area_id", 2), ("region", 2), ("__name__", 1)]
    assert stats["seriesCountByLabelPair"][:2] == [("__name__=temperature", 3), ("area_id=3", 2)]
    assert dict(stats["memoryInBytesByLabelName"])["region"] == 4 * 3 + 4 * 2
    with pytest.raises(ValueError):
        run("STATS", 0)


def test_alter_info_and_add(spark, tmp_path):
    e = Engine(spark, str(tmp_path), clock=lambda: NOW)
    run = Commands(e).run
    assert run("ADD", "k", NOW, "1234.5", "SIGNIFICANT_DIGITS", 2, "DUPLICATE_POLICY", "block", "DEDUPE_INTERVAL", "10s", "LABELS", "__name__", "m", "a", "1") == NOW
    assert run("GET", "k") == [NOW, 1200.0]
    with pytest.raises(ValueError, match="options"):
        run("ADD", "k", NOW, 1, "RETENTION", 5)
    assert run("MADD", "k", NOW + 5000, 1, "k", NOW + 20_000, 2, "none", 1, 1, "k", "x", 1) == ["ERR within dedupe interval", NOW + 20_000, "ERR unknown series", "ERR invalid timestamp: 'x'"]
    run("ALTER-SERIES", "k", "DUPLICATE_POLICY", "max", "LABELS", "a", "2", "b", "3")
    info = run("SERIES-INFO", "k", "DEBUG")
    assert info["labels"] == {"a": "2", "b": "3"} and info["metricName"] == "m" and info["dedupeInterval"] == 0 and info["duplicatePolicy"] == "max" and info["totalSamples"] == 2 and info["significantDigits"] == 2
    assert run("ADD", "k", NOW, "5000") == NOW and run("RANGE", "k", NOW, NOW) == [(NOW, 5000.0)]
    assert e.find("m", {"a": "2", "b": "3"}) is not None and e.find("m", {"a": "2"}) is None
    assert run("RENAME", "k", "k2") == "OK" and e.exists("k2") and not e.exists("k")
    assert run("COPY", "k2", "k3") == 1 and run("RANGE", "k3", "-", "+") == run("RANGE", "k2", "-", "+")
    other = e.in_db(1)
    assert other.create_series("k2", SeriesOptions(metric="m", labels={"a": "2", "b": "3"})) and other.get("k2") is None
    e.snapshot(str(tmp_path / "copy"))
    assert run("DELETE-KEY-RANGE", "k2", "-", NOW) == 1 and run("RANGE", "k2", "-", "+") == [(NOW + 20_000, 2.0)]
    assert run("DELETE-RANGE", "m", "START", NOW + 20_000, "END", NOW + 20_000) == 2 and run("GET", "k2") == []  # the copy has the same labels
    e.restore(str(tmp_path / "copy"))
    assert len(run("RANGE", "k2", "-", "+")) == 2
    assert run("DELETE-SERIES", "m{a='2'}") >= 1 and not e.exists("k2")
    assert run("FLUSHDB") == "OK" and e.series().count() == 0 and other.exists("k2")


def test_retention_and_compaction(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    day = 86_400_000
    e.create_series("k", SeriesOptions(metric="m", retention_ms=2 * day))
    assert e.add_many([("k", t * day, float(t)) for t in (1, 2, 3)]) == ["ok"] * 3
    assert e.add_many([("k", 5 * day, 5.0), ("k", 2 * day, 1.0)]) == ["ok", "older than retention"]
    e.compact()
    assert [r["ts_ms"] // day for r in e.range("k", 0, 9 * day).collect()] == [3, 5]
    assert e.store.days_between(0, 9 * day) == [3, 5]


def test_unknown_commands_and_missing_arguments(run):
    for bad in (("NOSUCH",), ("GET",), ("SERIES",), ("MADD", "a", "1"), ("DELETE-SERIES",), ("QUERY", "m", "WHEN", 1), ("RANGE", "temperature:3:east", "-")):
        with pytest.raises(CommandError):
            run(*bad)


def test_log_tops(spark):
    log = QueryLog()
    for q, s, n in (("a", 0.1, 5), ("b", 2.0, 1), ("c", 0.5, 3)):
        for _ in range(n):
            log.record(q, 1000, NOW, s)
    log.record("old", 1000, NOW - 10**9, 99.0)
    top = log.top(spark, 2, 1000, NOW)
    assert [x["query"] for x in top["topByCount"]] == ["a", "c"]
    assert [x["query"] for x in top["topByAvgDuration"]] == ["b", "c"]
    assert [x["query"] for x in top["topBySumDuration"]] == ["b", "c"]
    with log.running("q", 0, 10, 5):
        assert log.active()[0]["query"] == "q"
    assert log.active() == []
