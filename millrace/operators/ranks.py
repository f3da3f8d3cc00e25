"""Positions in a total order without a single-partition window.

Rows are dealt into ranges of the order (bounds from an approximate percentile, as many as the
rows need); running values are computed within a range and shifted by what the ranges before hold,
a table of one row per range (and key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

#: Rows of a range, and ranges at least and at most.
RANGE_ROWS, FEWEST, MOST = 250_000, 8, 4096


def number(df: DataFrame) -> Column:
    """The arrival number of a row: `_at`, or its first element where rows were joined."""
    return F.col("_at")[0] if df.schema["_at"].dataType.typeName() == "array" else F.col("_at")


def bounds(df: DataFrame, order: str, ranges: int | None = None) -> list:
    """Values of `order` that part the rows into ranges of about the same size; unless `ranges` is given, more rows have more of them."""

    def parted(ranges: int) -> str:
        return f"percentile_approx(`{order}`, array({', '.join(f'{i / ranges!r}D' for i in range(1, ranges))}), 100000)"

    if ranges is not None and ranges < 2:
        return []
    shape = df.selectExpr("count(*) AS n", f"{parted(ranges or 64)} AS b").first()
    found = shape["b"] or []
    if ranges is not None:
        return sorted(set(found))
    ranges = min(MOST, max(FEWEST, -(-shape["n"] // RANGE_ROWS)))
    if ranges > 64:
        return sorted(set(df.selectExpr(f"{parted(ranges)} AS b").first()["b"]))
    return sorted({found[i * 64 // ranges - 1] for i in range(1, ranges)} if found else ())


def ranged(df: DataFrame, order: Column, cuts: list) -> DataFrame:
    """Adds `_range`, the number of cuts below `order`; any cuts give right results, even ones equal work.

    A whole number is computed once a row and searched for: in a tree of conditions, as for other
    kinds, the optimizer would put the arrays that it comes from into every node.
    """

    def at(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order > F.lit(cuts[middle]), at(middle + 1, high)).otherwise(at(low, middle))

    if not cuts or not all(isinstance(c, int) for c in cuts):
        return df.withColumn("_range", at(0, len(cuts)))
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    # i where the i-th cut is the value itself, -i - 1 where it lies before the i-th: of 2 i + 1, either sign
    found = InternalFunction.array_binary_search(table, order.cast("long"))
    return df.withColumn("_range", F.coalesce(F.shiftright(F.abs(found * 2 + 1), 1), F.lit(0)))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Running totals of `sums` in the order, this row included, over everything or for each key; needs `_range`."""
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = df.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    # without keys this table has a row for each range
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    out = df.withColumns({f"_w_{n}": F.sum(c).over(within) for n, c in sums.items()})
    out = out.join(F.broadcast(base) if not keys else base, [*keys, "_range"])
    return out.select(*df.columns, *((F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def previous(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The value of the row before in the order; needs `_range`."""
    within = Window.partitionBy("_range").orderBy(*order)
    last = df.groupBy("_range").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    base = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    first = F.row_number().over(within) == 1
    out = df.withColumns({"_lag": F.lag(value).over(within), "_first": first}).join(F.broadcast(base), "_range")
    return out.select(*df.columns, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col("_lag")).alias(name))
