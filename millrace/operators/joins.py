"""Equi-joins with retention windows, replayed in arrival order.

Two records match if they have the same key and the earlier is still held when the later
arrives. Count, interval, predicate and per-key bounds, one at a time, have closed forms: a
condition on ranks or times that goes into an ordinary join, so that Catalyst picks the strategy
and adaptive execution splits skewed keys. So has a join of one-shot records on both sides without
any other bound: only one side of a key ever waits, so that the n-th record goes with the n-th.
Bounds that act on one another (several at once, or other one-shot records) run through the
sequential engine.

Rows with a null key take no part, not even as unmatched rows.

Arrivals. A source's rows have an arrival number, `_at`. In a join it becomes the array (number,
source), and a joined row has its later record's array followed by the earlier one's. So joined
rows have arrivals of their own, whose order is that in which a replay would emit them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.operators.ranks import number, previous, ranged, running
from millrace.operators.sequential import replay_join

KINDS = {
    "inner": (True, False, False),
    "left": (True, True, False),
    "right": (True, False, True),
    "outer": (True, True, True),
    "anti_left": (False, True, False),
    "anti_right": (False, False, True),
    "anti_outer": (False, True, True),
}
EXPIRED = "origin string, step int, schema string, key string, reason string, matched boolean, id string, source_time double, payload string"


@dataclass(frozen=True)
class Side:
    """One input of a join: rows with `_k` (key), `_at` (arrival) and `_t` (time); `payload` is the schema it is keyed on."""

    df: DataFrame
    schema: str
    window: W.Window = None
    buffer: int | None = None
    one_shot: bool = False
    source: int | None = None

    def arrival(self) -> Column:
        """`_at` as an array; of a source that is itself a query's result its own arrays follow the number."""
        if self.source is None:
            return F.col("_at")
        first = F.array(number(self.df).cast("long"), F.lit(self.source).cast("long"))
        return F.concat(first, "_at") if self.df.schema["_at"].dataType.typeName() == "array" else first

    def bounds(self) -> int:
        return (self.window is not None) + (self.buffer is not None) + 2 * self.one_shot


def _hold(side: Side, before: str, later: str, gc: str) -> Column:
    """The record of the side whose columns begin with `before` is still held when the other arrives."""
    out = F.lit(True)
    w = side.window
    if isinstance(w, W.Interval):
        clock = F.lit(w.now) if w.now is not None else F.col(f"{later}_prev" if gc == "lazy" else f"{later}_t")
        out = F.coalesce(clock - F.col(f"{before}_t") <= w.offset, F.lit(True))
    elif isinstance(w, W.Count):
        out = F.col(f"{later}_other") - F.col(f"{before}_rank") < w.count
    elif isinstance(w, W.Predicate):
        out = F.coalesce(F.col(f"{before}_keep"), F.lit(False))
    if side.buffer is not None:
        out = out & (F.col(f"{later}_kother") - F.col(f"{before}_krank") < side.buffer)
    return out


def _annotated(left: Side, right: Side, gc: str, order: str, cuts: list) -> tuple[DataFrame, DataFrame]:
    """Both sides with what their windows look at, `_l_` and `_r_` before the names."""
    parts = []
    for n, s in ((0, left), (1, right)):
        cols = [c for c in s.df.columns if not c.startswith("_")]
        keep = F.lit(True)
        if isinstance(s.window, W.Predicate):
            from millrace.functions.paths import column, expression, row

            keep = column(s.window.keep(row[s.schema])) if callable(s.window.keep) else expression(s.window.keep)
        parts.append(s.df.select(F.lit(n).alias("_side"), "_k", s.arrival().alias("_at"), "_t", keep.alias("_keep"), F.struct(*cols).alias(f"_p{n}")))
    kind0, kind1 = parts[0].schema["_p0"].dataType, parts[1].schema["_p1"].dataType
    both = parts[0].withColumn("_p1", F.lit(None).cast(kind1)).unionByName(parts[1].withColumn("_p0", F.lit(None).cast(kind0)))
    both = both.withColumn("_no", F.col("_at")[0])
    sequence = ["_no", "_at"] if order == "time" else ["_side", "_no", "_at"]
    counts = {"_nl": F.when(F.col("_side") == 0, 1).otherwise(0), "_nr": F.when(F.col("_side") == 1, 1).otherwise(0)}
    windows = (left.window, right.window)
    if any(isinstance(w, W.Count) for w in windows) or any(b is not None for b in (left.buffer, right.buffer)) or gc == "lazy":
        if order == "time":
            both = ranged(both, F.col("_no"), cuts)
        else:
            both = both.withColumn("_range", F.col("_side"))
        if any(isinstance(w, W.Count) for w in windows):
            both = running(both, sequence, counts)
        if left.buffer is not None or right.buffer is not None:
            both = running(both, sequence, {f"_k{n[1:]}": c for n, c in counts.items()}, ("_k",))
        if gc == "lazy" and any(isinstance(w, W.Interval) for w in windows):
            both = previous(both, sequence, "_t", "_prev")
    out = []
    for n, p in ((0, "_l"), (1, "_r")):
        some = both.filter(F.col("_side") == n)
        own, other = ("l", "r") if n == 0 else ("r", "l")
        cols = [F.col("_k").alias(f"{p}_k"), F.col("_at").alias(f"{p}_at"), F.col("_t").alias(f"{p}_t"), F.col("_keep").alias(f"{p}_keep"), F.col(f"_p{n}").alias(f"{p}_p")]
        for have, a, b in (("_nl", f"_n{own}", "_rank"), ("_nl", f"_n{other}", "_other"), ("_knl", f"_kn{own}", "_krank"), ("_knl", f"_kn{other}", "_kother")):
            if have in both.columns:
                cols.append(F.col(a).alias(f"{p}{b}"))
        if "_prev" in both.columns:
            cols.append(F.col("_prev").alias(f"{p}_prev"))
        out.append(some.select(*cols))
    return out[0], out[1]


def _unpack(df: DataFrame, left: list[str], right: list[str], order: str) -> DataFrame:
    later = F.col("_r_at") > F.col("_l_at") if order == "time" else F.lit(True)
    both = F.when(later, F.concat("_r_at", "_l_at")).otherwise(F.concat("_l_at", "_r_at"))
    return df.select(
        *(F.col(f"_l_p.`{c}`").alias(c) for c in left), *(F.col(f"_r_p.`{c}`").alias(c) for c in right),
        F.coalesce(both, "_l_at", "_r_at").alias("_at"),
    )


def join(left: Side, right: Side, kind: str, gc: str = "strict", order: str = "time", cuts: list | None = None) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Joined rows (schema columns of both sides, `_at`) and what gives the expired records, for one of KINDS.

    `cuts` part the arrival order into ranges for windows that look at it (see ranks.bounds).
    """
    cuts = cuts or []
    kind = kind.lower()
    if kind not in KINDS:
        raise ValueError(f"unknown join type {kind!r}; one of {sorted(KINDS)}")
    left, right = (replace(s, df=s.df.filter(F.col("_k").isNotNull())) for s in (left, right))
    matches, lone_left, lone_right = KINDS[kind]
    names = [[c for c in s.df.columns if not c.startswith("_")] for s in (left, right)]
    once = left.one_shot and right.one_shot and left.bounds() == right.bounds() == 2
    if once and left.df.schema["_k"].dataType != right.df.schema["_k"].dataType:
        left, right = (replace(s, df=s.df.withColumn("_k", F.col("_k").cast("string"))) for s in (left, right))
    if max(left.bounds(), right.bounds()) > 1 and not once:
        pairs, expired = replay_join(left, right, gc, order, cuts)
        l, r = _annotated(*(replace(s, window=None, buffer=None, one_shot=False) for s in (left, right)), "strict", order, cuts)
        same = pairs.join(l, pairs["l_at"] == l["_l_at"]).join(r, pairs["r_at"] == r["_r_at"]).drop("l_at", "r_at")
        out = [same] if matches else []
        if lone_left:
            out.append(l.join(pairs, pairs["l_at"] == l["_l_at"], "left_anti"))
        if lone_right:
            out.append(r.join(pairs, pairs["r_at"] == r["_r_at"], "left_anti"))
        whole = out[0]
        for x in out[1:]:
            whole = whole.unionByName(x, allowMissingColumns=True)
        return _fill(whole, l, r, names, order), expired
    l, r = _annotated(left, right, gc, order, cuts)
    first = F.col("_l_at") <= F.col("_r_at") if order == "time" else F.lit(True)
    on = F.col("_l_k") == F.col("_r_k")
    if once:
        l, r = (df.withColumn(f"{p}_nth", F.row_number().over(Window.partitionBy(f"{p}_k").orderBy(f"{p}_at"))) for p, df in (("_l", l), ("_r", r)))
        on = on & (F.col("_l_nth") == F.col("_r_nth"))
    elif left.bounds() or right.bounds():
        on = on & F.when(first, _hold(left, "_l", "_r", gc)).otherwise(_hold(right, "_r", "_l", gc))
    if kind in ("inner", "left", "right", "outer"):
        joined = l.join(r, on, {"outer": "full"}.get(kind, kind))
        rows = _unpack(joined, *names, order)
    else:
        rows = None
        if lone_left:
            rows = l.join(r, on, "left_anti")
        if lone_right:
            some = r.join(l, on, "left_anti")
            rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
        rows = _fill(rows, l, r, names, order)
    return rows, lambda: _expired(left, right, l, r, on)


def _fill(rows: DataFrame, l: DataFrame, r: DataFrame, names, order: str) -> DataFrame:
    for side in (l, r):
        for f in side.schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return _unpack(rows, *names, order)


def packet(step: int, schema: str, key: Column, reason: Column, matched: Column, record: Column, origin: str = "join") -> list[Column]:
    return [
        F.lit(origin).alias("origin"),
        F.lit(step).alias("step"),
        F.lit(schema).alias("schema"),
        key.cast("string").alias("key"),
        reason.alias("reason"),
        matched.alias("matched"),
        record["rx_meta"]["id"].alias("id"),
        record["rx_meta"]["source_time"].alias("source_time"),
        F.to_json(record).alias("payload"),
    ]


def _expired(left: Side, right: Side, l: DataFrame, r: DataFrame, on: Column) -> DataFrame:
    """Every held record leaves once; at the end of the input as completed."""
    out = None
    tops = l.agg(F.max("_l_t").alias("a"), F.count("*").alias("nl")).join(F.broadcast(r.agg(F.max("_r_t").alias("b"), F.count("*").alias("nr"))))
    tops = tops.select(F.greatest("a", "b").alias("_tmax"), "nl", "nr")
    for p, side, df, other in (("_l", left, l, r), ("_r", right, r, l)):
        if side.one_shot:
            q = "_r" if p == "_l" else "_l"
            held = df.join(other.select(f"{q}_k", f"{q}_nth"), on, "left")
            hit = F.col(f"{q}_nth").isNotNull()
            rows = held.select(*packet(0, side.schema, F.col(f"{p}_k"), F.when(hit, W.MATCHED_ONCE).otherwise(W.COMPLETED), hit, F.col(f"{p}_p.`{side.schema}`")))
            out = rows if out is None else out.unionByName(rows)
            continue
        n = F.col("nl") if p == "_l" else F.col("nr")
        reason = F.lit(W.COMPLETED)
        held = df.join(F.broadcast(tops))
        w = side.window
        if isinstance(w, W.Interval):
            last = F.col("_tmax") if w.now is None else F.lit(w.now)
            reason = F.when(last - F.col(f"{p}_t") > w.offset, w.reason).otherwise(reason)
        elif isinstance(w, W.Count):
            reason = F.when(n - F.col(f"{p}_rank") >= w.count, W.EVICTED).otherwise(reason)
        elif isinstance(w, W.Predicate):
            reason = F.when(~F.coalesce(F.col(f"{p}_keep"), F.lit(False)), w.reason).otherwise(reason)
        if side.buffer is not None:
            last = df.groupBy(f"{p}_k").agg(F.max(f"{p}_krank").alias("_klast")).withColumnRenamed(f"{p}_k", "_kk")
            held = held.join(last, F.col(f"{p}_k") == F.col("_kk"))
            reason = F.when(F.col("_klast") - F.col(f"{p}_krank") >= side.buffer, W.REPLACED).otherwise(reason)
        hit = df.join(other, on, "left_semi").select(F.col(f"{p}_at").alias("_hit")).distinct()
        held = held.join(hit, F.col(f"{p}_at") == F.col("_hit"), "left")
        rows = held.select(*packet(0, side.schema, F.col(f"{p}_k"), reason, F.col("_hit").isNotNull(), F.col(f"{p}_p.`{side.schema}`")))
        out = rows if out is None else out.unionByName(rows)
    return out


def interval_pairs(left: DataFrame, right: DataFrame, key: str, time: str, offset: float) -> DataFrame:
    """Pairs with the same key and times at most `offset` apart, for keys with very many rows.

    Times are dealt into cells of the width `offset`; a pair lies in the same cell or in
    neighbouring ones, so the join key is (key, cell) and no key is compared as a whole.
    Both frames need different column names but for `key` and `time`.
    """
    width = max(offset, 1)
    cell = F.floor(F.col(time) / width)
    l = left.withColumnsRenamed({key: "_lk", time: "_lt"}).withColumn("_c", F.floor(F.col("_lt") / width))
    r = right.withColumn("_c0", cell).withColumn("_c", F.explode(F.array(*(F.col("_c0") + i for i in (-1, 0, 1))))).drop("_c0")
    r = r.withColumnsRenamed({key: "_rk", time: "_rt"})
    on = (l["_lk"] == r["_rk"]) & (l["_c"] == r["_c"]) & (F.abs(F.col("_lt") - F.col("_rt")) <= offset)
    return l.join(r, on).drop("_c")
