"""What a sliding group computes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

KINDS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Agg:
    """An aggregate over a dotted path; with `distinct`, over the first row of each distinct key in the window."""

    path: str
    alias: str | None = None
    distinct: Callable | Any = field(default=None, compare=False)

    def name(self, kind: str) -> str:
        if self.alias:
            return self.alias if "." not in self.alias else self.alias.replace(".", "__")
        schema, _, leaf = self.path.rpartition(".")
        return f"{schema.replace('.', '__')}__{kind}_{leaf}" if schema else f"{kind}_{leaf}"


def _all(specs) -> tuple[Agg, ...]:
    out = []
    for s in specs or ():
        if isinstance(s, str):
            s = Agg(s)
        elif isinstance(s, dict):
            s = Agg(**s)
        if not isinstance(s, Agg):
            raise ValueError(f"an aggregate is a path, a dictionary or Agg, not {s!r}")
        out.append(s)
    return tuple(out)


@dataclass(frozen=True)
class Aggregates:
    row_count: bool = True
    count: tuple = ()
    sum: tuple = ()
    avg: tuple = ()
    min: tuple = ()
    max: tuple = ()

    def __post_init__(self):
        for kind in KINDS:
            given = getattr(self, kind)
            if isinstance(given, (bool, str)):
                raise ValueError(f"{kind} takes a list of paths")
            object.__setattr__(self, kind, _all(given))

    def each(self):
        for kind in KINDS:
            for a in getattr(self, kind):
                yield kind, a
