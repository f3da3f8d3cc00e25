"""Field access: a row proxy whose attributes are columns, a dotted getter, and small scalar helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Path:
    """`row.orders.total` is the column `orders.total`; a field of a missing schema is null."""

    def __init__(self, *parts: str):
        self._parts = parts

    def __getattr__(self, name: str) -> Path:
        if name.startswith("__"):
            raise AttributeError(name)
        return Path(*self._parts, name)

    def __getitem__(self, name: str) -> Path:
        return Path(*self._parts, *name.split("."))

    @property
    def column(self) -> Column:
        return F.col(".".join(f"`{p}`" for p in self._parts))

    def is_null(self) -> Column:
        return self.column.isNull()

    def is_not_null(self) -> Column:
        return self.column.isNotNull()

    def __eq__(self, other):
        return self.column == column(other)

    def __ne__(self, other):
        return self.column != column(other)

    def __lt__(self, other):
        return self.column < column(other)

    def __le__(self, other):
        return self.column <= column(other)

    def __gt__(self, other):
        return self.column > column(other)

    def __ge__(self, other):
        return self.column >= column(other)

    def __add__(self, other):
        return self.column + column(other)

    def __sub__(self, other):
        return self.column - column(other)

    def __mul__(self, other):
        return self.column * column(other)

    def __mod__(self, other):
        return self.column % column(other)

    __hash__ = None


row = Path()


def column(value) -> Column:
    """A column from a path, a column, or a literal."""
    if isinstance(value, Path):
        return value.column
    return value if isinstance(value, Column) else F.lit(value)


def expression(spec: Callable | Path | Column | str) -> Column:
    """A column from a function of the row proxy, a path, a column, or SQL text."""
    if isinstance(spec, Path):
        return spec.column
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str):
        return F.expr(spec)
    if callable(spec):
        return column(spec(row))
    raise TypeError(f"expected a column, path, SQL text or function of the row, not {type(spec).__name__}")


def get(path: str) -> Column:
    """Safe dotted getter: null where any part is missing."""
    return Path(*path.split(".")).column


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def clamp01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)
