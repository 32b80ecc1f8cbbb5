"""Grammar of command arguments: timestamps, durations, numbers with units, chunk sizes, policies."""

from __future__ import annotations

import enum
import re
import time
from datetime import datetime, timezone

#: The last millisecond value taken for a timestamp: the end of the year 9999.
LATEST = 253_402_300_799_000
LOOKBACK_MS = 5 * 60_000
_UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 7 * 86_400_000, "y": 365 * 86_400_000}
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ms|s|m|h|d|w|y|i)", re.I)
_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*([a-z]*)", re.I)
_SIZES = {"": 1, "k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def parse_timestamp(text: str | int, first: int = 0, last: int = LATEST, now: int | None = None) -> int:
    """Milliseconds: ``-`` is ``first``, ``+`` is ``last``, ``*`` is now; whole numbers are ms; else RFC 3339."""
    if isinstance(text, int) and not isinstance(text, bool):
        got = text
    elif text in ("-", "+", "*"):
        return {"-": first, "+": last, "*": now_ms() if now is None else now}[text]
    elif re.fullmatch(r"[+-]?\d+", text):
        got = int(text)
    else:
        try:
            at = datetime.fromisoformat(text)
        except ValueError as e:
            raise ValueError(f"invalid timestamp: {text!r}") from e
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        got = round(at.timestamp() * 1000)
    if got < 0:
        raise ValueError("a timestamp must not be negative")
    return got


def parse_duration(text: str | int | float, step_ms: int | None = None) -> int:
    """Milliseconds: a whole number is ms; else parts such as ``1h30m``; ``i`` is the query's step."""
    if isinstance(text, (int, float)):
        return int(text)
    s = text.strip()
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    sign, s = (-1, s[1:]) if s.startswith("-") else (1, s)
    parts = _DURATION.findall(s)
    if not parts or "".join(a + b for a, b in parts) != s:
        raise ValueError(f"invalid duration: {text!r}")
    total = 0.0
    for a, unit in parts:
        if unit.lower() == "i":
            if step_ms is None:
                raise ValueError("a step-relative duration outside a range query")
            total += float(a) * step_ms
        else:
            total += float(a) * _UNIT_MS[unit.lower()]
    return sign * round(total)


def parse_number_with_unit(text: str | int | float) -> float:
    if isinstance(text, (int, float)):
        return float(text)
    m = _NUMBER.fullmatch(text.strip())
    unit = m[2].lower() if m else ""
    unit = unit[:-1] if unit.endswith("b") else unit
    if not m or unit not in _SIZES:
        raise ValueError(f"invalid number: {text!r}")
    return float(m[1]) * _SIZES[unit]


def parse_integer(text: str | int) -> int:
    got = parse_number_with_unit(text)
    if got != int(got):
        raise ValueError(f"not a whole number: {text!r}")
    return int(got)


def parse_chunk_size(text: str | int) -> int:
    got = parse_integer(text)
    if not 48 <= got <= 1_048_576 or got % 2:
        raise ValueError("chunk size must be an even number from 48 to 1048576")
    return got


def range_bounds(start: int | None, end: int | None, now: int | None = None) -> tuple[int, int]:
    """Defaults of metadata and range queries: five minutes back to now; reversed bounds are an error."""
    now = now_ms() if now is None else now
    end = now if end is None else end
    start = now - LOOKBACK_MS if start is None else start
    if start > end:
        raise ValueError("start must not be after end")
    return start, end


def ordered(start: int, end: int) -> tuple[int, int]:
    return (start, end) if start <= end else (end, start)


def human_duration(ms: float) -> str:
    """Two parts at most: 1h2m, 3m4s, 1.5s, 12ms."""
    if ms < 1000:
        return f"{ms:.3g}ms"
    if ms < 60_000:
        return f"{ms / 1000:.3g}s"
    units = [("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000)]
    out, left = [], int(ms)
    for name, size in units:
        if left >= size and len(out) < 2:
            out.append(f"{left // size}{name}")
            left %= size
    return "".join(out)


class DuplicatePolicy(enum.Enum):
    """What a second value at the same timestamp does."""

    BLOCK, FIRST, LAST, MIN, MAX, SUM = "block", "first", "last", "min", "max", "sum"

    @property
    def code(self) -> int:
        return {"block": 0, "first": 1, "last": 2, "min": 4, "max": 8, "sum": 16}[self.value]

    @classmethod
    def parse(cls, text: str | int | DuplicatePolicy) -> DuplicatePolicy:
        if isinstance(text, cls):
            return text
        for p in cls:
            if text == p.code or isinstance(text, str) and text.lower().replace("_", "").removeprefix("keep") == p.value:
                return p
        raise ValueError(f"invalid duplicate policy: {text!r}")

    def resolve(self, old: float, new: float) -> float:
        """One pair, on the driver; frames use operators.ingest.resolve."""
        if self is DuplicatePolicy.BLOCK:
            raise ValueError("a sample exists at this timestamp")
        if old != old or new != new:
            return new if old != old else old
        return {"first": old, "last": new, "min": min(old, new), "max": max(old, new), "sum": old + new}[self.value]
