"""Plans and steps that must not grow faster than the input."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace import Count, Interval, Query, frame_from_rows
from millrace.operators.ranks import ranged
from millrace.operators.sequential import JoinReplay, _replayed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_shots(spark, kind="inner"):
    """Keys a and b on both sides, c on the left and d on the right only; the times alternate."""
    rows = lambda *x: [{"id": i, "k": k, "at": at} for i, k, at in x]
    left = frame_from_rows(spark, "left", rows((1, "a", 0), (2, "a", 1), (3, "b", 2), (4, "a", 9), (5, "c", 3)), order_by="at")
    right = frame_from_rows(spark, "right", rows((1, "a", 4), (2, "b", 5), (3, "b", 6), (4, "a", 7), (5, "d", 8)), order_by="at")
    key = {"field": "k", "one_shot": True}
    return Query.from_(left)._join(kind, right).using(left=key, right=dict(key))


def test_one_shot_on_both_sides_is_an_ordinary_join(spark):
    made = one_shots(spark, "outer").df.selectExpr("left.id AS a", "right.id AS b")
    assert "MapInPandas" not in plan(made)
    assert sorted(map(tuple, made.collect()), key=str) == sorted([(1, 1), (2, 4), (3, 2), (4, None), (5, None), (None, 3), (None, 5)], key=str)


def test_what_one_shot_joins_held_is_told_without_a_replay(spark):
    gone = one_shots(spark).expired()
    assert "MapInPandas" not in plan(gone)
    met, left = ("distinct_match", True), ("completed", False)
    expected = {("left", i, *(met if i < 4 else left)) for i in range(1, 6)} | {("right", i, *(left if i in (3, 5) else met)) for i in range(1, 6)}
    assert {(r.schema, int(r.id), r.reason, r.matched) for r in gone.collect()} == expected and gone.count() == 10


def test_a_replay_gathers_short_runs_and_forgets_what_left():
    runs = 3000
    rows = [(side, str(k), np.array([2 * k + side]), 0.0, True, None, str(k)) for k in range(runs) for side in (0, 1)]
    batch = pd.DataFrame(rows, columns=["side", "key", "at", "t", "keep", "prev", "run"])
    engines = []

    def make():
        engines.append(JoinReplay((Interval(5), Interval(5)), (None, None), (True, True), False))
        return engines[-1]

    frames = list(_replayed(iter([batch]), make))
    assert len(frames) == 1 and sum((f["what"] == 0).sum() for f in frames) == runs and sum((f["what"] == 1).sum() for f in frames) == 2 * runs
    assert not any(e.in_order[0] or e.in_order[1] or e.by_key[0] or e.by_key[1] for e in engines)


def test_a_replay_does_not_walk_the_whole_queue():
    """A long queue of one side, then as many partners: each finds the first and takes it from the front."""
    engine, n = JoinReplay((Count(10**6), Count(10**6)), (None, None), (True, True), False), 100_000
    began = time.process_time()
    for i in range(2 * n):
        engine.arrive(int(i >= n), "k", [i], None, None, True)
    assert engine.pairs == [([i], [n + i]) for i in range(n)]
    assert time.process_time() - began < 10


def test_ranges_compute_the_order_once(spark):
    cuts = [-5, 0, 3, 3 * 10**15]
    df = spark.createDataFrame([(v,) for v in (-6, -5, -4, 0, 1, 3, 4, 3 * 10**15, 10**18, None)], "v long")
    made = ranged(df.select("v", F.array("v", F.lit(7)).alias("a")), F.col("a")[0], cuts)
    assert {(r.v, r._range) for r in made.collect()} == {(v, 0 if v is None else sum(c < v for c in cuts)) for (v,) in df.collect()}
    assert ranged(df, F.col("v"), []).filter("_range <> 0").count() == 0
    assert [r._range for r in ranged(spark.createDataFrame([(0.5,), (2.5,)], "v double"), F.col("v"), [0.5, 2.0]).sort("v").collect()] == [0, 2]
    assert plan(ranged(df.select(F.array(F.col("v") * 11).alias("a")), F.col("a")[0], list(range(500))).select("_range")).count("* 11") <= 2


def test_count_windows_keep_no_whole_records_of_a_plain_join(spark):
    """Only what has ranks itself is kept for its readers; the rest is read anew, by the columns that are wanted."""
    a, b, c = (frame_from_rows(spark, n, [{"id": i, "text": "x"} for i in range(5)], order_by="id") for n in "abc")
    q = Query.from_(a).inner_join(b).using(a="id", b="id").inner_join(c).using(b="id", c="id").join_window(count=3)
    made = q.flat("a.id", "c.id")
    assert "InMemory" not in plan(made) and made.count() == 5
    d = frame_from_rows(spark, "d", [{"id": i} for i in range(5)], order_by="id")
    more = q.inner_join(d).using(c="id", d="id").join_window(count=3).flat("a.id", "d.id")
    assert "InMemory" in plan(more) and more.count() == 5
