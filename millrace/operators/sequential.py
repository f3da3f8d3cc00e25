"""Operators whose state depends on every record before: replayed in order by a Python worker.

A join whose bounds act by key only is replayed key by key. A count window counts records of all
keys, so that a join or distinct with one (besides another bound) is one sequence; only keys,
times and arrival numbers travel to that task, never the payload, and its state is the window.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import windows as W


class _Held:
    __slots__ = ("at", "key", "keep", "matched", "side", "t")

    def __init__(self, side, key, at, t, keep):
        self.side, self.key, self.at, self.t, self.keep, self.matched = side, key, at, t, keep, False


class JoinReplay:
    """One pass over arrivals (side, key, at, t, previous time, keep), with the state of both sides."""

    def __init__(self, windows, buffers, shots, lazy: bool):
        self.windows, self.buffers, self.shots, self.lazy = windows, buffers, shots, lazy
        self.by_key: tuple[dict, dict] = ({}, {})
        # what is held, as far as a window looks at it; a record goes from here when it leaves, for whatever reason
        self.in_order: tuple[OrderedDict, OrderedDict] = (OrderedDict(), OrderedDict())
        self.pairs: list[tuple] = []
        self.out: list[tuple] = []

    def _leave(self, x: _Held, reason: str) -> None:
        self.in_order[x.side].pop(x, None)
        own = self.by_key[x.side][x.key]
        # nearly always the first or the last; a search would cost the length of the queue
        if own[0] is x:
            own.popleft()
        elif own[-1] is x:
            own.pop()
        else:
            own.remove(x)
        if not own:
            del self.by_key[x.side][x.key]
        self.out.append((x.side, x.at, reason, x.matched))

    def _sweep(self, now) -> None:
        for side in (0, 1):
            w, line = self.windows[side], self.in_order[side]
            if not line:
                continue
            if isinstance(w, W.Count):
                while len(line) > w.count:
                    self._leave(next(iter(line)), W.EVICTED)
            elif isinstance(w, W.Interval) and (now if w.now is None else w.now) is not None:
                clock = now if w.now is None else w.now
                # times do not fall in arrival order; a record without a time stays and is not in the line
                while line and clock - (x := next(iter(line))).t > w.offset:
                    self._leave(x, w.reason)
            elif isinstance(w, W.Predicate) and not (x := next(reversed(line))).keep:
                self._leave(x, w.reason)

    def arrive(self, side, key, at, t, previous, keep) -> None:
        if not self.lazy:
            self._sweep(t)
        own = self.by_key[side].setdefault(key, deque())
        limit = self.buffers[side]
        while limit is not None and len(own) >= max(1, limit):
            self._leave(own[0], W.REPLACED)
            own = self.by_key[side].setdefault(key, deque())
        x = _Held(side, key, at, t, keep)
        own.append(x)
        w = self.windows[side]
        if w is not None and not (t is None and isinstance(w, W.Interval)):
            self.in_order[side][x] = None
        partners = self.by_key[1 - side].get(key, ())
        met = []
        for y in partners:
            if self.lazy and previous is not None and self._late(y, previous):
                continue
            x.matched = y.matched = True
            self.pairs.append((at, y.at) if side == 0 else (y.at, at))
            met.append(y)
            if self.shots[side]:
                break
        if self.shots[1 - side]:
            for y in met:
                self._leave(y, W.MATCHED_ONCE)
        if self.shots[side] and met:
            self._leave(x, W.MATCHED_ONCE)
        self._sweep(t)

    def _late(self, y: _Held, now) -> bool:
        w = self.windows[y.side]
        return isinstance(w, W.Interval) and y.t is not None and (now if w.now is None else w.now) - y.t > w.offset

    def finish(self) -> None:
        for some in self.by_key:
            for own in some.values():
                self.out += [(x.side, x.at, W.COMPLETED, x.matched) for x in own]
            some.clear()


#: Rows that a replay gathers, over as many runs as it takes, before it hands on a frame.
HANDED = 20_000


def _replayed(batches, make):
    """Rows of a frame sorted by run, in order, through an engine for each run; state does not outlive a run."""
    engine, run = None, None
    pairs: list[tuple] = []
    out: list[tuple] = []

    def drained() -> pd.DataFrame:
        rows = [(0, a, b, None, None, None) for a, b in pairs]
        rows += [(1, at if side == 0 else None, at if side == 1 else None, side, reason, matched) for side, at, reason, matched in out]
        pairs.clear()
        out.clear()
        made = pd.DataFrame(rows, columns=["what", "l_at", "r_at", "side", "reason", "matched"])
        return made.astype({"what": "int32", "side": "Int32", "matched": "boolean"})

    number = lambda v: None if v is None or v != v else float(v)
    for pdf in batches:
        for side, key, at, t, keep, previous, own in zip(*(pdf[c].tolist() for c in ("side", "key", "at", "t", "keep", "prev", "run")), strict=True):
            if engine is None or own != run:
                if engine is not None:
                    engine.finish()
                engine, run = make(), own
                # most runs are short: a frame for each would cost more than the replay
                engine.pairs, engine.out = pairs, out
            engine.arrive(side, key, at.tolist(), number(t), number(previous), keep)
            if len(pairs) + len(out) >= HANDED:
                yield drained()
    if engine is not None:
        engine.finish()
    if pairs or out:
        yield drained()


def replay_join(left, right, gc: str, order: str, cuts: list) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(l_at, r_at) of the matches, and what gives the expired records.

    Partitions are sorted by run (key, or nothing where a count window counts all keys) and arrival
    and streamed, so that a worker holds the records in the windows only.
    """
    from millrace.functions.paths import column, expression, row
    from millrace.operators.joins import packet
    from millrace.operators.ranks import previous, ranged

    parts = []
    for n, s in ((0, left), (1, right)):
        keep = F.lit(True)
        if isinstance(s.window, W.Predicate):
            keep = column(s.window.keep(row[s.schema])) if callable(s.window.keep) else expression(s.window.keep)
        parts.append(s.df.select(F.lit(n).alias("side"), F.col("_k").cast("string").alias("key"), s.arrival().alias("at"), F.col("_t").alias("t"), F.coalesce(keep, F.lit(False)).alias("keep")))
    both = parts[0].unionAll(parts[1])
    sequence = ["at"] if order == "time" else ["side", "at"]
    windows, buffers, shots = (left.window, right.window), (left.buffer, right.buffer), (left.one_shot, right.one_shot)
    if gc == "lazy":
        both = previous(ranged(both, F.col("at")[0], cuts) if order == "time" else both.withColumn("_range", F.col("side")), sequence, "t", "prev").drop("_range")
    else:
        both = both.withColumn("prev", F.lit(None).cast("double"))
    whole = any(isinstance(w, W.Count) for w in windows)
    bare = tuple(W.Predicate(None, w.reason) if isinstance(w, W.Predicate) else w for w in windows)
    both = both.withColumn("run", F.lit("") if whole else F.col("key"))
    both = (both.repartition(1) if whole else both.repartition("run")).sortWithinPartitions("run", *sequence)

    def make() -> JoinReplay:
        return JoinReplay(bare, buffers, shots, gc == "lazy")

    kinds = "what int, l_at array<long>, r_at array<long>, side int, reason string, matched boolean"
    made = both.mapInPandas(lambda batches: _replayed(batches, make), kinds)
    pairs = made.filter("what = 0").select("l_at", "r_at")

    def expired() -> DataFrame:
        out = None
        for n, s, at in ((0, left, "l_at"), (1, right, "r_at")):
            gone = made.filter(f"what = 1 and side = {n}").select(F.col(at).alias("_gone"), "reason", "matched")
            rows = s.df.withColumn("_own", s.arrival()).join(gone, F.col("_own") == F.col("_gone"))
            rows = rows.select(*packet(0, s.schema, F.col("_k"), F.col("reason"), F.col("matched"), F.col(f"`{s.schema}`")))
            out = rows if out is None else out.unionByName(rows)
        return out

    return pairs, expired


def distinct_replay(df: DataFrame, window) -> DataFrame:
    """(at, passed, reason, t): records with key, at, t in order; a passed key is remembered while the window holds it.

    A row with `passed` for every record, and one without it for every record that was remembered,
    when it is forgotten; its reason is null if it was still remembered at the end.

    An interval is kept key by key: partitions are sorted by key and arrival and streamed, with
    one remembered record. A count window is one sequence over all keys.
    """
    narrow = df.select(F.col("_k").cast("string").alias("key"), F.col("_at").alias("at"), F.col("_t").alias("t"))
    names = ["at", "passed", "reason", "t"]
    schema = f"at {df.schema['_at'].dataType.simpleString()}, passed boolean, reason string, t double"
    framed = lambda rows: pd.DataFrame(rows, columns=names).astype({"passed": "boolean", "t": "Float64"})
    plain = lambda at: at if isinstance(at, (int, float)) or not hasattr(at, "tolist") else at.tolist()
    if isinstance(window, W.Interval):

        def forgotten(t, now) -> str | None:
            """Why a remembered record of time `t` is forgotten at `now`: one without a time, or from the future, at once."""
            if t is None or (now is not None and now - t > window.offset):
                return window.reason
            return W.CLOCK_SKEW if now is not None and now < t else None

        def by_key(batches):
            held = None
            for pdf in batches:
                rows = []
                for k, at, t in zip(pdf["key"], pdf["at"], pdf["t"], strict=True):
                    at, t = plain(at), None if t is None or t != t else float(t)
                    now = t if window.now is None else window.now
                    if held is not None and held[0] != k:
                        rows.append((held[1], None, None, held[2]))
                        held = None
                    why = None if held is None else forgotten(held[2], now)
                    if why:
                        rows.append((held[1], None, why, held[2]))
                        held = None
                    rows.append((at, held is None, None if held is None else W.SUPPRESSED, t))
                    held = held or (k, at, t)
                yield framed(rows)
            if held is not None:
                yield framed([(held[1], None, None, held[2])])

        return narrow.repartition("key").sortWithinPartitions("key", "at").mapInPandas(by_key, schema)

    def in_one(batches):
        known: OrderedDict = OrderedDict()
        for pdf in batches:
            rows = []
            for k, at in zip(pdf["key"], pdf["at"], strict=True):
                passed, at = k not in known, plain(at)
                rows.append((at, passed, None if passed else W.SUPPRESSED, None))
                if passed:
                    known[k] = at
                    if len(known) > window.count:
                        rows.append((known.popitem(last=False)[1], None, W.EVICTED, None))
            yield framed(rows)
        yield framed([(at, None, None, None) for at in known.values()])

    return narrow.repartition(1).sortWithinPartitions("at").mapInPandas(in_one, schema)
