"""Zones, timelines, streams; the sequential engine against closed forms on random traces."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import Interval, Query, wrap
from millrace.sources import replay, zones
from millrace.sources.zones import Zone
from millrace.streaming import compile as S


def test_continuous_zone():
    z = Zone("s", 10, 2, shape="continuous")
    assert zones.ids(z) == [8, 9, 10, 11, 12] and set(zones.weights(z).values()) == {1.0}


def test_zone_coverage_rate_and_order():
    events, summary = zones.generate([Zone("s", 50, 10, shape="continuous", coverage=0.5, mode="monotonic", rate_shape="linear_in")], 20.0)
    ticks = [e["tick"] for e in events]
    assert ticks == sorted(ticks) and ticks[-1] == pytest.approx(20.0)
    assert len({e["id"] for e in events}) == 11 and summary["mapping_hint"] == "linear"
    again, _ = zones.generate([Zone("s", 50, 10, shape="continuous", coverage=0.5, mode="monotonic", rate_shape="linear_in")], 20.0)
    assert events == again


@pytest.mark.parametrize("shape", ["flatField", "bell", "linear_in", "linear_out", "circle4"])
def test_zone_shapes(shape, spark):
    events, summary = zones.generate([Zone("s", 55, 5, shape=shape)], 10.0)
    assert events and summary["total"] == len(events)
    assert zones.frame(spark, events).count() == len(events)


def test_unknown_zone_shape():
    with pytest.raises(ValueError, match="unknown shape"):
        zones.ids(Zone("s", 1, 1, shape="star"))


def test_timeline():
    got = []
    t = replay.Timeline([{"tick": 2, "schema": "a"}, {"tick": 1, "schema": "b"}], {"*": got.append}, speed=2)
    assert t.advance(0.5) == 1 and not t.finished
    t.drain()
    assert [e["tick"] for e in got] == [1, 2] and t.finished


def trace(spark, seed, n=60):
    draw = random.Random(seed)
    rows, now = [], 0
    for i in range(n):
        now += draw.choice([0, 1, 2, 5])
        rows.append((i, draw.randrange(5), float(now), draw.choice(["l", "r"])))
    df = spark.createDataFrame(rows, "id long, k long, source_time double, side string")
    return rows, [wrap(n, df.filter(F.col("side") == n[0]).drop("side"), id_field="id", order_by="id") for n in ("left", "right")]


def model(rows, offset, lazy):
    """Pairs of a join with an interval window, record by record."""
    held, out = [], set()
    for i, k, t, side in rows:
        if not lazy:
            held = [x for x in held if t - x[2] <= offset]
        out |= {(i, x[0]) if side == "l" else (x[0], i) for x in held if x[1] == k and x[3] != side}
        held.append((i, k, t, side))
        held = [x for x in held if t - x[2] <= offset]
    return out


@pytest.mark.parametrize("gc", ["strict", "lazy"])
def test_interval_closed_form_against_a_model(spark, gc):
    for seed in (1, 2):
        rows, (left, right) = trace(spark, seed)
        q = Query.from_(left).inner_join(right).using(left="k", right="k").join_window(Interval(6)).replaying(gc=gc)
        made = {(r.a, r.b) for r in q.df.select(F.col("left.id").alias("a"), F.col("right.id").alias("b")).collect()}
        assert made == model(rows, 6, gc == "lazy")
        keyed = {"field": "k", "buffer_size": 1000}
        again = Query.from_(left).inner_join(right).using(left=keyed, right=dict(keyed)).join_window(Interval(6)).replaying(gc=gc)
        assert {(r.a, r.b) for r in again.df.select(F.col("left.id").alias("a"), F.col("right.id").alias("b")).collect()} == made


def test_count_closed_form_against_the_sequential_engine(spark):
    _, (left, right) = trace(spark, 3)
    closed = Query.from_(left).outer_join(right).using(left="k", right="k").join_window(count=4)
    keyed = {"field": "k", "buffer_size": 1000}
    replayed = Query.from_(left).outer_join(right).using(left=keyed, right=dict(keyed)).join_window(count=4)
    show = lambda q: sorted(map(str, q.df.select(F.col("left.id").alias("a"), F.col("right.id").alias("b")).collect()))
    assert show(closed) == show(replayed)
    left_at = lambda q: sorted((r.schema, r.id, r.reason, r.matched) for r in q.expired().collect())
    assert left_at(closed) == left_at(replayed)


@pytest.fixture
def events(spark, tmp_path):
    df = spark.range(60).select(
        F.col("id"), (F.col("id") % 3).alias("user"), (F.col("id") % 2 == 0).alias("view"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value")
    )
    replay.write_replay(df, "id", str(tmp_path / "in"))
    return df, replay.stream(spark, str(tmp_path / "in"), df.schema)


def test_stream_interval_join_equals_batch(spark, events, tmp_path):
    df, stream = events
    side = lambda d, view, p: d.filter(F.col("view") == view).select(F.col("id").alias(f"{p}_id"), F.col("user").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
    left, right = (S.timed(side(stream, v, p), f"{p}_ts", "10 minutes") for v, p in ((True, "v"), (False, "b")))
    made = S.drained(spark, S.interval_join(left, right, "v_user", "b_user", "v_ts", "b_ts", 600), str(tmp_path / "j"))
    a, b = side(df, True, "v"), side(df, False, "b")
    expected = a.join(b, (F.col("v_user") == F.col("b_user")) & (F.abs(F.unix_seconds("v_ts") - F.unix_seconds("b_ts")) <= 600))
    assert sorted((r.v_id, r.b_id) for r in made.collect()) == sorted((r.v_id, r.b_id) for r in expected.collect())


def test_stream_distinct(spark, events, tmp_path):
    _, stream = events
    made = S.drained(spark, S.distinct(S.timed(stream, "ts", "1 hour"), "user"), str(tmp_path / "d"))
    assert sorted(r.id for r in made.collect()) == [0, 1, 2]


def test_stream_sliding_group(spark, events, tmp_path):
    _, stream = events
    made = S.drained(spark, S.sliding_group(stream, "user", "ts", "value", count=2), str(tmp_path / "g")).collect()
    rows = [r for r in made if r.kind == "row"]
    assert len(rows) == 60 and max(r.n for r in rows) == 2 and sum(r.kind == "expired" for r in made) == 54
    assert max(r.total for r in rows) == 59 + 56


def test_stream_one_shot(spark, events, tmp_path):
    _, stream = events
    left, right = stream.filter("view"), stream.filter("not view")
    made = S.drained(spark, S.one_shot_join(left, right, "user", "ts", "id"), str(tmp_path / "o")).collect()
    assert len({r.left_id for r in made}) == len(made) == 30


def test_stream_split(spark, events, tmp_path):
    _, stream = events
    seen = {"row": 0, "expired": 0}
    run = S.split(
        S.sliding_group(stream, "user", "ts", "value", seconds=600), str(tmp_path / "s"),
        lambda b, n: seen.__setitem__("row", seen["row"] + b.count()), lambda b, n: seen.__setitem__("expired", seen["expired"] + b.count()),
    )
    run.awaitTermination()
    assert seen["row"] == 60 and 0 < seen["expired"] < 60
