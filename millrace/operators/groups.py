"""Sliding groups: every row of a key is emitted with the aggregates of the window that it ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.paths import expression, get
from millrace.operators import windows as W
from millrace.operators.joins import packet
from millrace.plans.aggregates import Aggregates


def _over(window, key: str):
    """Frames that together hold the rows of the window in order: one for counts, two for times.

    A time window holds rows of earlier times within the offset, and of rows with the same time
    those that came before; RANGE alone would take later peers too.
    """
    by = Window.partitionBy(key)
    if window is None:
        return [by.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)]
    if isinstance(window, W.Count):
        return [by.orderBy("_at").rowsBetween(-(window.count - 1), 0)]
    peers = Window.partitionBy(key, "_now").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    if window.offset < 1:
        return [peers]
    return [by.orderBy("_now").rangeBetween(-int(window.offset), -1), peers]


def _fold(kind: str, value: Column, frames) -> Column:
    if kind == "count":
        return sum((F.count(value).over(w) for w in frames), F.lit(0)).cast("long")
    parts = {"sum": F.sum, "min": F.min, "max": F.max}
    if kind in parts:
        each = [parts[kind](value).over(w) for w in frames]
        if len(each) == 1:
            return each[0]
        a, b = each
        if kind == "sum":
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        return F.least(a, b) if kind == "min" else F.greatest(a, b)
    return _fold("sum", value, frames) / F.nullif(_fold("count", value, frames), F.lit(0))


def _fold_distinct(kind: str, value: Column, key: Column, frames) -> Column:
    """Folds the first value of every distinct key of the window."""
    pair = F.when(key.isNotNull(), F.struct(key.alias("k"), value.alias("v")))
    rows = [F.collect_list(pair).over(w) for w in frames]
    rows = rows[0] if len(rows) == 1 else F.concat(*rows)
    keys = F.transform(rows, lambda r: r.k)
    first = F.filter(rows, lambda r, i: F.array_position(keys, r.k) == i + 1)
    values = F.filter(F.transform(first, lambda r: r.v), lambda v: v.isNotNull())
    if kind == "count":
        return F.size(values).cast("long")
    empty = F.size(values) == 0
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    made = {"sum": total, "avg": total / F.size(values), "min": F.array_min(values), "max": F.array_max(values)}[kind]
    return F.when(~empty, made)


def numeric(df: DataFrame, path: str) -> Column:
    """A value as a number; null where it is none."""
    kind = df.select(get(path).alias("v")).schema["v"].dataType.simpleString()
    return get(path).try_cast("double") if kind == "string" else get(path)


def group(
    df: DataFrame, names: tuple[str, ...], key: Column, window: W.Window, aggregates: Aggregates, name: str | None, enrich: bool
) -> tuple[DataFrame, Callable[[], DataFrame], str]:
    """Aggregate or enriched rows, what gives the expired group members, and the group's name. `df` has `_at` and `_t`.

    Aggregate rows have `_group_key`, `_group_name`, `_count_all`, the aggregates by flat name,
    `<schema>__count_id` by default, and `window_start`/`window_end` for time windows; enriched
    rows keep the schemas too. Rows with a null key are left out. Times are whole numbers
    (timestamps in microseconds).
    """
    name = name or (f"_groupBy:{names[0]}" if names else "_groupBy")
    keyed = df.withColumns({"_group_key": key, "_now": F.col("_t").cast("long")}).filter(F.col("_group_key").isNotNull())
    frames = _over(window, "_group_key")
    cols: dict[str, Column] = {"_count_all": _fold("count", F.lit(1), frames) if aggregates.row_count else F.lit(0).cast("long")}
    if aggregates.row_count and not aggregates.count:
        for n in names:
            cols[f"{n}__count_id"] = _fold("count", F.col(f"`{n}`.rx_meta.id"), frames)
    per_schema: dict[str, list[str]] = {}
    for kind, agg in aggregates.each():
        value = get(agg.path) if kind in ("count", "min", "max") else numeric(df, agg.path)
        if agg.distinct is not None:
            cols[agg.name(kind)] = _fold_distinct(kind, value, expression(agg.distinct), frames)
        else:
            cols[agg.name(kind)] = _fold(kind, value, frames)
        if kind == "count" and "." in agg.path:
            per_schema.setdefault(agg.path.split(".")[0], []).append(agg.name(kind))
    if isinstance(window, W.Interval):
        cols["window_start"] = _fold("min", F.col("_t"), frames)
        cols["window_end"] = _fold("max", F.col("_t"), frames)
    made = keyed.withColumns(cols).withColumn("_group_name", F.lit(name))
    for schema, counted in per_schema.items():
        made = made.withColumn(f"_count_{schema}", sum((F.col(c) for c in counted), F.lit(0)))
        cols[f"_count_{schema}"] = F.col(f"_count_{schema}")
    keep = [f"`{n}`" for n in names] if enrich else []
    out = made.select(*keep, "_group_key", "_group_name", *cols, "_at", F.col("_t"))
    if enrich:
        out = out.withColumn(name, F.struct(F.col("_group_key").alias("key"), *cols))
    return out, lambda: _expired(keyed, names, window), name


def totals(df: DataFrame, names: tuple[str, ...], key: Column, aggregates: Aggregates, name: str | None) -> DataFrame | None:
    """The last state of groups that keep everything: an aggregate that is combined before the shuffle. None if it holds folds over distinct values."""
    cols = {"_rows": F.count("*")}
    if aggregates.row_count and not aggregates.count:
        cols |= {f"{n}__count_id": F.count(F.col(f"`{n}`.rx_meta.id")) for n in names}
    made = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    per_schema: dict[str, list[str]] = {}
    for kind, agg in aggregates.each():
        if agg.distinct is not None:
            return None
        cols[agg.name(kind)] = made[kind](get(agg.path) if kind in ("count", "min", "max") else numeric(df, agg.path))
        if kind == "count" and "." in agg.path:
            per_schema.setdefault(agg.path.split(".")[0], []).append(agg.name(kind))
    out = df.withColumn("_group_key", key).filter(F.col("_group_key").isNotNull()).groupBy("_group_key").agg(*(c.alias(n) for n, c in cols.items()))
    sums = {f"_count_{schema}": sum((F.col(f"`{c}`") for c in counted), F.lit(0)) for schema, counted in per_schema.items()}
    every = F.col("_rows") if aggregates.row_count else F.lit(0).cast("long")
    head = [F.col("_group_key"), F.lit(name or (f"_groupBy:{names[0]}" if names else "_groupBy")).alias("_group_name"), every.alias("_count_all")]
    return out.select(*head, *(F.col(f"`{c}`") for c in cols if c != "_rows"), *(c.alias(n) for n, c in sums.items()))


def _expired(keyed: DataFrame, names: tuple[str, ...], window: W.Window) -> DataFrame:
    """A row leaves when its key's later rows push it out, else at the end of the input."""
    reason = F.lit("completed")
    if isinstance(window, W.Count):
        after = F.count("*").over(Window.partitionBy("_group_key").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1))
        reason = F.when(after >= window.count, "evicted").otherwise(reason)
    elif isinstance(window, W.Interval):
        last = F.max("_now").over(Window.partitionBy("_group_key"))
        reason = F.when(last - F.col("_now") > F.lit(window.offset), "expired").otherwise(reason)
    rows = keyed.withColumn("_reason", reason)
    first = names[0]
    return rows.select(*packet(0, first, F.col("_group_key"), F.col("_reason"), F.lit(None).cast("boolean"), F.col(f"`{first}`"), "group"))


def nested(df: DataFrame, aggregates: Aggregates, names: tuple[str, ...], window: W.Window = None) -> DataFrame:
    """Aggregate rows in nested form: `<schema>.<path>._sum.<leaf>` and so on, `_count.<schema>`, `window.start/end`.

    An alias with dots is a path of its own; one without stands beside the leaf it renames.
    """
    tree: dict = {}

    def put(path: list[str], column: Column) -> None:
        at = tree
        for p in path[:-1]:
            at = at.setdefault(p, {})
        at[path[-1]] = column

    counted: dict[str, list[Column]] = {}
    for kind, agg in aggregates.each():
        value = F.col(agg.name(kind))
        *parents, leaf = agg.path.split(".")
        if agg.alias and "." in agg.alias:
            put(agg.alias.split("."), value)
        elif agg.alias:
            put([*parents, agg.alias], value)
        else:
            put([*parents, f"_{kind}", leaf], value)
        if kind == "count" and parents:
            counted.setdefault(parents[0], []).append(value)
    if aggregates.row_count and not aggregates.count:
        for n in names:
            put([n, "_count", "id"], F.col(f"{n}__count_id"))
            counted[n] = [F.col(f"{n}__count_id")]
    for n, parts in counted.items():
        put(["_count", n], sum(parts[1:], parts[0]))
    if isinstance(window, W.Interval):
        put(["window", "start"], F.col("window_start"))
        put(["window", "end"], F.col("window_end"))

    def built(node) -> Column:
        return node if isinstance(node, Column) else F.struct(*(built(v).alias(k) for k, v in node.items()))

    return df.select("_group_key", "_group_name", "_count_all", *(built(v).alias(k) for k, v in tree.items()))
