"""A Query over streaming sources as one Structured Streaming plan.

Event time is the records' source_time; every source gets a watermark. What a window holds is
state: a join keeps a record until the watermark has passed its interval, a distinct or a group
over an interval drops a key by an event-time timeout, and a count window holds so many rows of
a key. Within a micro-batch records are taken in the order of their times.

What has no bounded or ordered state in a stream is refused with a ValueError: count, predicate
and per-key windows of joins, one-shot records, fixed clocks and windows over other fields than
source_time. Unmatched rows of outer and anti joins come out once the watermark has passed them,
records later than the watermark are dropped, and a record without a time matches nothing. A
distinct without a window remembers every key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.paths import column, expression, get, row
from millrace.operators import windows as W
from millrace.operators.groups import numeric
from millrace.sources.schema import ARRIVAL, META, SchemaFrame, rename

_HOW = {"inner": "inner", "left": "left", "anti_left": "left", "right": "right", "anti_right": "right", "outer": "full", "anti_outer": "full"}


def _time(schema: str) -> str:
    return f"_ts_{schema}"


def _offset(w: W.Window, what: str) -> float:
    if not isinstance(w, W.Interval) or w.now is not None or w.field not in (None, "source_time"):
        raise ValueError(f"in a stream {what} needs an interval window over source_time")
    return float(w.offset)


def _micros(n: float) -> Column:
    return F.expr(f"INTERVAL {int(n)} MICROSECONDS")


def _watched(frame: SchemaFrame, delay: str) -> SchemaFrame:
    if len(frame.names) != 1:
        raise ValueError("a source of a stream has one schema; join within one query")
    name = frame.names[0]
    when = F.timestamp_micros(F.col(f"`{name}`.{META}.source_time").cast("long"))
    return SchemaFrame(frame.df.drop(ARRIVAL).withColumn(_time(name), when).withWatermark(_time(name), delay), frame.names)


def _key(schema: str, field) -> Column:
    return F.col(f"`{schema}`.`{field}`") if isinstance(field, str) else column(field(row[schema]))


def _join(left: SchemaFrame, right: SchemaFrame, step, window: W.Window) -> SchemaFrame:
    using = step.using or {}
    ends = [[s for s in side.names if s in using] for side in (left, right)]
    if any(len(some) != 1 for some in ends):
        raise ValueError("in a stream using() names one schema of either side")
    if any(k.buffer is not None or k.one_shot for k in using.values()):
        raise ValueError("per-key buffers and one-shot records are not part of a streamed query; see one_shot_join")
    (a,), (b,) = ends
    wl, wr = W.sides(window)
    held_left, held_right = _offset(wl, "a join"), _offset(wr, "a join")
    l = left.df.filter(F.col(f"`{a}`").isNotNull()).withColumn("_kl", _key(a, using[a].field)).filter("_kl is not null")
    r = right.df.filter(F.col(f"`{b}`").isNotNull()).withColumn("_kr", _key(b, using[b].field)).filter("_kr is not null")
    at, other = F.col(f"`{_time(a)}`"), F.col(f"`{_time(b)}`")
    on = (F.col("_kl") == F.col("_kr")) & (other >= at - _micros(held_right)) & (other <= at + _micros(held_left))
    joined = l.join(r, on, _HOW[step.kind])
    lone = {"anti_left": F.col("_kr").isNull(), "anti_right": F.col("_kl").isNull(), "anti_outer": F.col("_kr").isNull() | F.col("_kl").isNull()}
    if step.kind in lone:
        joined = joined.filter(lone[step.kind])
    return SchemaFrame(joined.drop("_kl", "_kr"), (*left.names, *right.names))


def _distinct(frame: SchemaFrame, step) -> SchemaFrame:
    if step.schema not in frame.names:
        raise ValueError(f"distinct on unknown schema {step.schema}")
    key = get(f"{step.schema}.{step.by}") if isinstance(step.by, str) else expression(step.by(row[step.schema]) if callable(step.by) else step.by)
    there = F.col(f"`{step.schema}`").isNotNull()
    df = frame.df.withColumn("_k", key).filter(there & F.col("_k").isNotNull())
    if step.window is None:
        out = df.dropDuplicates(["_k"]).drop("_k")
    else:
        offset, time = _offset(step.window, "a distinct"), _time(step.schema)

        def run(group, parts, held: GroupState):
            if held.hasTimedOut:
                held.remove()
                return
            since = held.get[0] if held.exists else None
            for pdf in [pd.concat(list(parts)).sort_values(time, kind="stable")]:
                passed = []
                for now in pdf[time].astype("int64") // 1000 if str(pdf[time].dtype).startswith("datetime64[ns") else pdf[time].astype("datetime64[us]").astype("int64"):
                    passed.append(since is None or now < since or now - since > offset)
                    since = int(now) if passed[-1] else since
                held.update((since,))
                held.setTimeoutTimestamp(max(int((since + offset) // 1000) + 1, held.getCurrentWatermarkMs() + 1))
                yield pdf[passed].drop(columns="_k")

        kept = T.StructType([f for f in df.schema.fields if f.name != "_k"])
        out = df.groupBy("_k").applyInPandasWithState(run, kept, "since long", "append", GroupStateTimeout.EventTimeTimeout)
    if len(frame.names) > 1:
        out = out.unionByName(frame.df.filter(~there))
    return SchemaFrame(out, frame.names)


def _folded(kind: str, values: list) -> float | None:
    some = [v for v in values if v == v]
    if kind == "count":
        return len(some)
    if not some:
        return None
    return {"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[kind](some)


def _group(frame: SchemaFrame, plan, time: str) -> DataFrame:
    """`kind` (row or expired), `_group_key`, `_group_name`, `_count_all`, the aggregates, and the time of the row, or of the one that left, as `_ts`."""
    w, aggs = plan.group_window, plan.aggregates
    if w is None and not plan.group_window_set:
        w = W.Interval(0)
    offset = None if isinstance(w, W.Count) else _offset(w, "a group")
    name = plan.group_name or (f"_groupBy:{frame.names[0]}" if frame.names else "_groupBy")
    each: list[tuple[str, str, Column]] = []
    if aggs.row_count and not aggs.count:
        each += [(f"{n}__count_id", "count", F.when(F.col(f"`{n}`.{META}.id").isNotNull(), F.lit(1.0))) for n in frame.names]
    for kind, agg in aggs.each():
        if agg.distinct is not None:
            raise ValueError("aggregates over distinct values are not part of a streamed query")
        value = F.when(get(agg.path).isNotNull(), F.lit(1.0)) if kind == "count" else numeric(frame.df, agg.path).cast("double")
        each.append((agg.name(kind), kind, value))
    df = frame.df.select(expression(plan.group_key).alias("_group_key"), F.col(f"`{time}`").alias("_ts"), F.array(*(v for _, _, v in each)).cast("array<double>").alias("_v"))
    df = df.filter("_group_key is not null and _ts is not null")
    kinds = [T.StructField(n, T.LongType() if k == "count" else T.DoubleType()) for n, k, _ in each]
    out = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("_group_key", df.schema["_group_key"].dataType), T.StructField("_group_name", T.StringType()),
        T.StructField("_count_all", T.LongType()), *kinds, T.StructField("_ts", T.TimestampType()),
    ])
    row_count, most = aggs.row_count, w.count if offset is None else None

    def run(group, parts, held: GroupState):
        at, vs = (list(x) for x in held.get) if held.exists else ([], [])
        vs, rows = [list(v) for v in vs], []
        left = lambda t: ("expired", group[0], name, None, *(None for _ in each), pd.Timestamp(t, unit="us"))
        if held.hasTimedOut:
            held.remove()
            rows = [left(t) for t in at]
        else:
            pdf = pd.concat(list(parts)).sort_values("_ts", kind="stable")
            for now, own in zip(pdf["_ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["_v"], strict=True):
                at.append(now)
                vs.append([float("nan") if v is None else float(v) for v in own])
                while (most is not None and len(at) > most) or (offset is not None and now - at[0] > offset):
                    rows.append(left(at.pop(0)))
                    vs.pop(0)
                cols = [_folded(kind, [v[i] for v in vs]) for i, (_, kind, _) in enumerate(each)]
                rows.append(("row", group[0], name, len(at) if row_count else 0, *cols, pd.Timestamp(now, unit="us")))
            held.update((at, vs))
            if offset is not None:
                held.setTimeoutTimestamp(max(int((max(at) + offset) // 1000) + 1, held.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame(rows, columns=out.names)
        whole = [f.name for f in out.fields if isinstance(f.dataType, T.LongType) and f.name != "_group_key"]
        yield made.astype({n: "Int64" for n in whole})

    # the aggregates' columns are closures over plan expressions only in `df`; workers need names and kinds
    each = [(n, k, None) for n, k, _ in each]
    timeout = GroupStateTimeout.NoTimeout if offset is None else GroupStateTimeout.EventTimeTimeout
    return df.groupBy("_group_key").applyInPandasWithState(run, out, "at array<long>, v array<array<double>>", "append", timeout)


def compile_stream(query, delay: str = "0 seconds") -> DataFrame:
    """The streaming DataFrame of a query: a struct column for each schema, or a group's rows (see `_group`); for append mode."""
    from millrace.query import dropping

    p = query.plan
    if p.enrich:
        raise ValueError("enriched groups are not part of a streamed query")
    frame = _watched(p.source, delay)
    for i, step in enumerate((None, *p.joins)):
        if step is not None:
            frame = _join(frame, _watched(step.source, delay), step, query._window(step))
        for d in p.distincts:
            if d.after == i:
                frame = _distinct(frame, d)
    if p.where is not None:
        frame = SchemaFrame(dropping(frame.df, p.where), frame.names)
    root = _time(frame.names[0])
    if p.selection is not None:
        if missing := set(p.selection) - set(frame.names):
            raise ValueError(f"unknown schemas {sorted(missing)}")
        root = _time(next(iter(p.selection)))
        frame = rename(frame, p.selection)
    if p.group_key is None:
        df = frame.df.select(*(F.col(f"`{n}`") for n in frame.names))
    else:
        df = _group(frame, p, root)
        if p.having is not None:
            df = df.filter((F.col("kind") == "expired") | expression(p.having))
    for condition in p.final_where:
        df = dropping(df, condition)
    return df
