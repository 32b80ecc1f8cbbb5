"""Commands as text: ``Commands(engine).run("RANGE", "key", "-", "+", "AGGREGATION", "avg", "1h")``.

Names and options are case-insensitive; a prefix up to a dot is ignored. Replies are plain Python values in the shape
of the HTTP API. Unknown or repeated options are errors."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass


from .engine import Engine, SeriesOptions
from .functions.arguments import LATEST, LOOKBACK_MS, human_duration, parse_chunk_size, parse_duration, parse_integer, parse_number_with_unit, parse_timestamp, range_bounds
from .operators import metadata
from .operators.buckets import Aggregation
from .operators.oplog import MAX_LIFETIME_MS, TOP_K
from .operators.results import array_success, matrix_json, success, vector_json
from .operators.scan import overlapping

#: Spellings that mean the same command.
ALIASES = {"CREATE": "CREATE-SERIES", "ALTER": "ALTER-SERIES", "LABELS": "LABEL-NAMES", "DELETE-KEY-RANGE": "DELETE-KEY_RANGE", "LABEL_VALUES": "LABEL-VALUES", "INFO": "SERIES-INFO"}


class CommandError(ValueError):
    pass


class Arguments:
    def __init__(self, items: list[str]):
        self.items, self.at = items, 0

    def __bool__(self) -> bool:
        return self.at < len(self.items)

    def next(self, what: str = "an argument") -> str:
        if not self:
            raise CommandError(f"{what} is missing")
        self.at += 1
        return self.items[self.at - 1]

    def peek(self) -> str:
        return self.items[self.at].upper() if self else ""

    def rest(self) -> list[str]:
        out, self.at = self.items[self.at :], len(self.items)
        return out

    def until(self, words: frozenset[str]) -> list[str]:
        out = []
        while self and self.peek() not in words:
            out.append(self.next())
        return out

    def done(self) -> None:
        if self:
            raise CommandError(f"unexpected argument {self.items[self.at]!r}")


@dataclass
class Matching:
    selectors: list[str]
    start: int | None = None
    end: int | None = None
    limit: int | None = None


#: Words that end a list of selectors.
_BOUNDS = frozenset(["START", "END", "LIMIT", "MATCH"])
_RANGE_WORDS = frozenset(["ALIGN", "FILTER_BY_VALUE", "FILTER_BY_TS", "AGGREGATION", "COUNT", "EMPTY", "BUCKETTIMESTAMP"])


class Commands:
    def __init__(self, engine: Engine):
        self.engine = engine

    def line(self, text: str) -> object:
        """A command as one line with shell-like quotes."""
        return self.run(*shlex.split(text))

    def run(self, name: str, *args: str | int | float) -> object:
        name = name.rsplit(".", 1)[-1].upper()
        name = ALIASES.get(name, name)
        handler: Callable[[Arguments], object] | None = getattr(self, "c_" + name.lower().replace("-", "_"), None)
        if handler is None:
            raise CommandError(f"unknown command {name!r}")
        return handler(Arguments([str(a) for a in args]))

    # ---- arguments
    def _time(self, text: str, first: int = 0, last: int = LATEST) -> int:
        return parse_timestamp(text, first, last, self.engine.clock())

    def _options(self, a: Arguments) -> SeriesOptions:
        got: dict[str, object] = {}
        readers = {
            "RETENTION": ("retention_ms", parse_duration), "DEDUPE_INTERVAL": ("dedupe_ms", parse_duration), "DUPLICATE_POLICY": ("dup_policy", str), "METRIC_NAME": ("metric", str),
            "SIGNIFICANT_DIGITS": ("sig_digits", parse_integer), "CHUNK_SIZE": ("chunk_size", parse_chunk_size),
        }
        while a:
            word = a.next().upper()
            if word == "LABELS":  # the rest of the line
                rest = a.rest()
                if not rest or len(rest) % 2:
                    raise CommandError("LABELS takes pairs of a name and a value")
                got["labels"] = dict(zip(rest[::2], rest[1::2], strict=True))
            elif word in ("ENCODING", "COMPRESSION"):  # a matter of Parquet
                if a.next(word).upper() not in ("COMPRESSED", "UNCOMPRESSED", "GORILLA", "PCO"):
                    raise CommandError("unknown encoding")
            elif word in readers:
                name, read = readers[word]
                if name in got:
                    raise CommandError(f"{word} is given twice")
                got[name] = read(a.next(word))
            else:
                raise CommandError(f"unknown option {word!r}")
        return SeriesOptions(**got)

    def _matching(self, a: Arguments) -> Matching:
        out = Matching([])
        while a:
            word = a.peek()
            if word in _BOUNDS:
                a.next()
            if word == "START":
                out.start = self._time(a.next("START"))
            elif word == "END":
                out.end = self._time(a.next("END"))
            elif word == "LIMIT":
                out.limit = parse_integer(a.next("LIMIT"))
                if out.limit < 1:
                    raise CommandError("LIMIT must be positive")
            else:  # MATCH selectors, or selectors without the word
                more = a.until(_BOUNDS)
                if not more:
                    raise CommandError("a selector is missing")
                out.selectors += more
        out.start, out.end = range_bounds(out.start, out.end, self.engine.clock())  # the last five minutes unless given
        return out

    def _matched(self, m: Matching):
        if not m.selectors:
            raise CommandError("at least one selector is needed")
        return self.engine.matching(m.selectors, m.start, m.end)

    # ---- series and samples
    def c_create_series(self, a: Arguments) -> str:
        self.engine.create_series(a.next("the key"), self._options(a))
        return "OK"

    def c_alter_series(self, a: Arguments) -> str:
        self.engine.alter_series(a.next("the key"), self._options(a))
        return "OK"

    def c_add(self, a: Arguments) -> int:
        key, ts, value = a.next("the key"), self._time(a.next("the timestamp")), parse_number_with_unit(a.next("the value"))
        return self.engine.add(key, ts, value, self._options(a) if a else None)

    def c_madd(self, a: Arguments) -> list[int | str]:
        items = a.rest()
        if not items or len(items) % 3:
            raise CommandError("MADD takes triples of key, timestamp and value")
        out: list[int | str] = [""] * (len(items) // 3)
        good: list[tuple[int, str, int, float]] = []
        for i in range(len(out)):
            key, ts, value = items[3 * i : 3 * i + 3]
            try:
                good.append((i, key, self._time(ts), parse_number_with_unit(value)))
            except ValueError as e:
                out[i] = f"ERR {e}"
        for (i, _, ts, _), status in zip(good, self.engine.add_many([g[1:] for g in good]) if good else [], strict=True):
            out[i] = ts if status == "ok" else f"ERR {status}"
        return out

    def c_get(self, a: Arguments) -> list:
        got = self.engine.get(a.next("the key"))
        a.done()
        return list(got) if got else []

    def c_series_info(self, a: Arguments) -> dict:
        key = a.next("the key")
        debug = a.next().upper() if a else ""
        if debug not in ("", "DEBUG"):
            raise CommandError(f"unknown option {debug!r}")
        a.done()
        info = self.engine.info(key)
        return {
            "totalSamples": info["total_samples"], "memoryUsage": info["memory_usage"], "firstTimestamp": info["first_timestamp"], "lastTimestamp": info["last_timestamp"], "retentionTime": info["retention_ms"],
            "chunkCount": info["chunk_count"], "chunkSize": info["chunk_size"], "duplicatePolicy": info["dup_policy"], "dedupeInterval": info["dedupe_ms"], "significantDigits": info["sig_digits"],
            "metricName": info["metric"], "labels": info["labels"], **({"keySelfName": info["key"], "chunks": None} if debug else {}),
        }

    def c_range(self, a: Arguments) -> list[tuple[int, float]]:
        key = a.next("the key")
        first, last = self.engine.first_and_last(key)
        start, end = self._time(a.next("the start"), first, last), self._time(a.next("the end"), first, last)
        o: dict[str, object] = {}
        aggregate: dict[str, object] = {}
        while a:
            word = a.next().upper()
            if word == "ALIGN":
                at = a.next("ALIGN")
                o["align"] = at.lower() if at.lower() in ("start", "-", "end", "+") else self._time(at)
            elif word == "FILTER_BY_VALUE":
                o["by_value"] = (parse_number_with_unit(a.next("the least value")), parse_number_with_unit(a.next("the greatest value")))
            elif word == "FILTER_BY_TS":
                o["by_ts"] = [self._time(t, first, last) for t in a.until(_RANGE_WORDS)]
            elif word == "AGGREGATION":
                aggregate["function"], aggregate["width"] = a.next("the aggregator"), parse_duration(a.next("the bucket's width"))
            elif word == "EMPTY":
                aggregate["empty"] = True
            elif word == "BUCKETTIMESTAMP":
                aggregate["label"] = a.next("BUCKETTIMESTAMP").lower()
            elif word == "COUNT":
                o["count"] = parse_integer(a.next("COUNT"))
            else:
                raise CommandError(f"unknown option {word!r}")
        if aggregate:
            if "function" not in aggregate:
                raise CommandError("EMPTY and BUCKETTIMESTAMP go with AGGREGATION")
            o["aggregation"] = Aggregation(**aggregate)
        return [(r["ts_ms"], r["value"]) for r in self.engine.range(key, start, end, **o).toLocalIterator()]

    # ---- queries
    def _query(self, a: Arguments, words: tuple[str, ...]) -> dict[str, str]:
        got: dict[str, str] = {}
        while a:
            word = a.next().upper()
            if word not in words or word in got:
                raise CommandError(f"unexpected option {word!r}")
            got[word] = a.next(word)
        return got

    def _step(self, text: str | None) -> int:
        """A duration, or seconds as a plain number."""
        if text is None:
            return LOOKBACK_MS
        try:
            return round(float(text) * 1000)
        except ValueError:
            return parse_duration(text)

    def c_query(self, a: Arguments) -> dict:
        import json

        text = a.next("the query")
        o = self._query(a, ("TIME", "ROUNDING", "TIMEOUT"))
        at = self._time(o["TIME"]) if "TIME" in o else self.engine.clock()
        with self.engine.log.running(text, at, at, 0):
            return json.loads(vector_json(self.engine.query(text, at, parse_integer(o["ROUNDING"]) if "ROUNDING" in o else None)))

    def c_query_range(self, a: Arguments) -> dict:
        import json

        text = a.next("the query")
        o = self._query(a, ("START", "END", "STEP", "ROUNDING", "TIMEOUT"))
        now = self.engine.clock()
        end = self._time(o["END"]) if "END" in o else now
        start = self._time(o["START"]) if "START" in o else now - LOOKBACK_MS
        step = self._step(o.get("STEP"))
        with self.engine.log.running(text, start, end, step):
            return json.loads(matrix_json(self.engine.query_range(text, start, end, step, parse_integer(o["ROUNDING"]) if "ROUNDING" in o else None)))

    # ---- metadata
    def c_series(self, a: Arguments) -> dict:
        m = self._matching(a)
        return array_success(dict(sorted(r["labels"].items())) for r in metadata.series_list(self._matched(m), m.limit).orderBy("series").toLocalIterator())

    def c_cardinality(self, a: Arguments) -> int:
        return metadata.cardinality(self._matched(self._matching(a))).first()[0]

    def c_label_names(self, a: Arguments) -> dict:
        m = self._matching(a)
        got = self._matched(m) if m.selectors else overlapping(self.engine.spans(), m.start, m.end)
        return array_success(r[0] for r in metadata.label_names(got, m.limit).orderBy("name").collect())

    def c_label_values(self, a: Arguments) -> dict:
        name = a.next("the label")
        m = self._matching(a)
        got = self._matched(m) if m.selectors else overlapping(self.engine.spans(), m.start, m.end)
        return array_success(r[0] for r in metadata.label_values(got, name, m.limit).orderBy("value").toLocalIterator())

    def c_stats(self, a: Arguments) -> dict:
        limit = parse_integer(a.next()) if a else metadata.TOP
        a.done()
        return self.engine.stats(limit)

    def c_top_queries(self, a: Arguments) -> dict:
        o = self._query(a, ("TOP_K", "MAX_LIFETIME"))
        k = parse_integer(o["TOP_K"]) if "TOP_K" in o else TOP_K
        life = parse_duration(o["MAX_LIFETIME"]) if "MAX_LIFETIME" in o else MAX_LIFETIME_MS
        return {"topK": k, "maxLifetime": human_duration(life), **self.engine.log.top(self.engine.spark, k, life)}

    def c_active_queries(self, a: Arguments) -> dict:
        a.done()
        return success("active", self.engine.log.active())

    def c_reset_rollup_cache(self, a: Arguments) -> str:
        a.done()
        self.engine.cache.reset()
        return "OK"

    # ---- deletes
    def c_delete_range(self, a: Arguments) -> int:
        m = self._matching(a)
        if not m.selectors:
            raise CommandError("at least one selector is needed")
        return self.engine.delete_range(m.selectors, m.start, m.end)

    def c_delete_key_range(self, a: Arguments) -> int:
        key = a.next("the key")
        first, last = self.engine.first_and_last(key)
        start, end = self._time(a.next("the start"), first, last), self._time(a.next("the end"), first, last)
        a.done()
        return self.engine.delete_key_range(key, start, end)

    def c_delete_series(self, a: Arguments) -> int:
        m = self._matching(a)
        if not m.selectors:
            raise CommandError("at least one selector is needed")
        return self.engine.delete_series(m.selectors)

    def c_del(self, a: Arguments) -> int:
        return self.engine.delete_keys(*a.rest())

    def c_rename(self, a: Arguments) -> str:
        self.engine.rename_series(a.next("the key"), a.next("the new key"))
        a.done()
        return "OK"

    def c_copy(self, a: Arguments) -> int:
        self.engine.copy_series(a.next("the key"), a.next("the new key"))
        a.done()
        return 1

    def c_flushdb(self, a: Arguments) -> str:
        a.done()
        self.engine.flush()
        return "OK"


__all__ = ["Arguments", "CommandError", "Commands"]
