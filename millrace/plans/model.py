"""The immutable plan behind a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from millrace.operators import windows as W
from millrace.plans.aggregates import Aggregates
from millrace.sources.schema import SchemaFrame


@dataclass(frozen=True)
class Key:
    field: str | Callable
    buffer: int | None = None
    one_shot: bool = False


def keys(spec: dict) -> dict[str, Key]:
    """Join keys by schema: a field, a function of the row proxy (which gives a column), or a dictionary with field, buffer_size (or per_key_buffer_size) and one_shot."""
    out = {}
    for schema, k in spec.items():
        if isinstance(k, str) or callable(k):
            k = {"field": k}
        if not isinstance(k, dict) or not (isinstance(k.get("field"), str) or callable(k.get("field"))):
            raise ValueError(f"the key of {schema} is a field name or a dictionary with a field")
        if strange := set(k) - {"field", "buffer_size", "per_key_buffer_size", "one_shot"}:
            raise ValueError(f"unknown key options of {schema}: {sorted(strange)}")
        buffer = k.get("buffer_size", k.get("per_key_buffer_size"))
        out[schema] = Key(k["field"], None if buffer is None else max(1, int(buffer)), bool(k.get("one_shot", False)))
    return out


@dataclass(frozen=True)
class JoinStep:
    kind: str
    source: Any
    using: dict[str, Key] | None = None
    window: W.Window = None
    window_set: bool = False


@dataclass(frozen=True)
class DistinctStep:
    schema: str
    by: Any
    window: W.Window
    after: int


@dataclass(frozen=True)
class Plan:
    source: SchemaFrame | Any
    joins: tuple[JoinStep, ...] = ()
    distincts: tuple[DistinctStep, ...] = ()
    default_window: W.Window = None
    default_set: bool = False
    where: Any = None
    selection: dict[str, str] | None = None
    group_key: Any = None
    group_name: str | None = None
    enrich: bool = False
    group_window: W.Window = None
    group_window_set: bool = False
    aggregates: Aggregates = field(default_factory=Aggregates)
    having: Any = None
    final_where: tuple = ()
    taps: tuple[tuple[str, dict], ...] = ()
    gc: str = "strict"
    order: str = "time"
    hook: Callable[[str, int, DataFrame], None] | None = None
