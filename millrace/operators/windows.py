"""Retention windows and their validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from typing import Any

#: Reasons for which a record leaves a window.
EVICTED, REPLACED, COMPLETED, MATCHED_ONCE = "evicted", "replaced", "completed", "distinct_match"
INTERVAL, TIME, PREDICATE = "expired_interval", "expired_time", "expired_predicate"
SUPPRESSED, CLOCK_SKEW = "distinct_schema", "expired_clock_skew"

#: Clock of interval windows that state none; None takes the time of the record that arrives.
_default_current: Callable[[], float] | None = None


def set_default_current(clock: Callable[[], float] | None) -> None:
    """A clock for interval windows, read once when a query is compiled; None for the records' own times."""
    global _default_current
    _default_current = clock


def seconds(n: float) -> float:
    """An offset for timestamps, which are counted in microseconds."""
    return n * 1_000_000.0


@dataclass(frozen=True)
class Count:
    """At most `count` records of a side, over all keys."""

    count: int

    def __post_init__(self):
        if not isinstance(self.count, int) or self.count < 1:
            raise ValueError("a count window needs a positive integer")

    def describe(self) -> dict:
        return {"mode": "count", "count": self.count}


@dataclass(frozen=True)
class Interval:
    """Records whose time is at most `offset` behind the clock; a record without a time never expires in a join.

    The clock is the time of the record that arrives, or `current` (a number, or a function that
    is called once, when the query is compiled).
    """

    offset: float
    field: str | None = None
    reason: str = INTERVAL
    current: Callable[[], float] | float | None = dataclass_field(default=None, compare=False)

    def __post_init__(self):
        if not isinstance(self.offset, (int, float)) or self.offset < 0:
            raise ValueError("an interval needs a number of zero or more")
        clock = self.current if self.current is not None else _default_current
        now = clock() if callable(clock) else clock
        if now is not None and not isinstance(now, (int, float)):
            raise ValueError("the clock of an interval gives a number")
        object.__setattr__(self, "now", None if now is None else float(now))

    def describe(self) -> dict:
        return {"mode": "interval", "time": self.offset, "field": self.field or "source_time"}


@dataclass(frozen=True)
class Predicate:
    """A cached record stays while the predicate over its own fields holds; it must not depend on time."""

    keep: Callable | Any = dataclass_field(compare=False)
    reason: str = PREDICATE

    def describe(self) -> dict:
        return {"mode": "predicate"}


@dataclass(frozen=True)
class PerSide:
    left: Count | Interval | Predicate | None
    right: Count | Interval | Predicate | None

    def describe(self) -> dict:
        return {"mode": "per_side", "left": self.left and self.left.describe(), "right": self.right and self.right.describe()}


Window = Count | Interval | Predicate | PerSide | None


def window(spec: Window | dict) -> Window:
    """A window from a dictionary: count or max_items; time or offset with field; ttl; left and right."""
    if spec is None or isinstance(spec, (Count, Interval, Predicate, PerSide)):
        return spec
    known = {"mode", "count", "max_items", "time", "offset", "ttl", "field", "predicate", "left", "right", "reason", "current_fn"}
    if strange := set(spec) - known:
        raise ValueError(f"unknown window keys: {sorted(strange)}")
    if "left" in spec or "right" in spec:
        return PerSide(window(spec.get("left")), window(spec.get("right")))
    if "predicate" in spec:
        return Predicate(spec["predicate"], spec.get("reason", PREDICATE))
    if "ttl" in spec or spec.get("mode") == "time":
        return Interval(spec.get("ttl", 60), spec.get("field", "time"), spec.get("reason", TIME), spec.get("current_fn"))
    if "time" in spec or "offset" in spec:
        return Interval(spec.get("time", spec.get("offset")), spec.get("field"), spec.get("reason", INTERVAL), spec.get("current_fn"))
    return Count(spec.get("count", spec.get("max_items", 1000)))


def sides(spec: Window) -> tuple[Window, Window]:
    return (spec.left, spec.right) if isinstance(spec, PerSide) else (spec, spec)
