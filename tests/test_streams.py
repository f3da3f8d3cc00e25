"""Queries over streams give what the same queries give over tables."""

import pytest
from pyspark.sql import functions as F

from millrace import Count, Interval, Query, get, row, seconds, wrap
from millrace.streaming import compile as S

HOUR = seconds(3600)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clicks and buys of 7 users over some hours, in time order, in several files."""
    path = str(tmp_path_factory.mktemp("stream"))
    df = spark.range(240).select(
        "id", (F.col("id") * 5 % 7).alias("user"), F.when(F.col("id") % 3 == 0, "buy").otherwise("click").alias("kind"),
        (F.col("id") * 1.5).alias("value"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 613).alias("ts"),
    )
    for k in range(4):
        df.filter((F.col("id") >= 60 * k) & (F.col("id") < 60 * (k + 1))).coalesce(1).write.mode("append").parquet(path)
    return path


def source(spark, folder, kind, label, streaming, key="user"):
    df = spark.read.parquet(folder)
    if streaming:
        df = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    df = df.withColumn("key", F.when(~(F.col("id") % 11).isin(0, 7, 10), F.col(key)))
    return wrap(label, df.filter(F.col("kind") == kind) if kind else df, id_field="id", time_field="ts", order_by="id")


def both(spark, folder, tmp_path, make):
    """The query's result over the table, and over the stream."""
    batch = make(lambda kind, label: source(spark, folder, kind, label, False))
    streamed = S.drained(spark, make(lambda kind, label: source(spark, folder, kind, label, True)).stream("0 seconds"), str(tmp_path / "s"))
    return batch, streamed


def pairs(df, a, b):
    return sorted(((r.a, r.b) for r in df.select(get(f"{a}.id").alias("a"), get(f"{b}.id").alias("b")).collect()), key=str)


@pytest.mark.parametrize("kind", ["inner", "left", "right", "outer", "anti_left", "anti_right", "anti_outer"])
def test_joins(spark, folder, tmp_path, kind):
    def make(of):
        return Query.from_(of("click", "clicks"))._join(kind, of("buy", "buys")).using(clicks="key", buys="key").join_window(time=1.3 * HOUR)

    batch, streamed = both(spark, folder, tmp_path, make)
    want, got = pairs(batch.df, "clicks", "buys"), pairs(streamed, "clicks", "buys")
    late = [p for p in want if p not in got]
    # what has no partner comes out when the watermark has passed it
    assert set(got) <= set(want) and len(got) == len(set(got)) and all(None in p and max(x for x in p if x is not None) > 215 for p in late)
    assert got and (kind != "inner" or not late)


def test_chain_with_where_and_selection(spark, folder, tmp_path):
    def make(of):
        q = Query.from_(of("click", "clicks")).inner_join(of("buy", "buys")).using(clicks="key", buys="key").join_window(time=1.3 * HOUR)
        q = q.inner_join(of(None, "others")).using(buys="key", others="user").join_window(time=1.5 * HOUR)
        return q.where(lambda r: r.clicks.value > 30).select_schemas(clicks="seen", others="others").final_where(row.others.id > 25)

    batch, streamed = both(spark, folder, tmp_path, make)
    assert pairs(streamed, "seen", "others") == pairs(batch.df, "seen", "others") != []


@pytest.mark.parametrize("window", [None, Interval(2 * HOUR)])
def test_distinct(spark, folder, tmp_path, window):
    batch, streamed = both(spark, folder, tmp_path, lambda of: Query.from_(of(None, "e")).distinct("e", "key", window))
    ids = lambda df: sorted(r.id for r in df.select(get("e.id").alias("id")).collect())
    assert ids(streamed) == ids(batch.df) != []


@pytest.mark.parametrize("window", [Count(4), Interval(3 * HOUR)])
def test_groups(spark, folder, tmp_path, window):
    def make(of):
        q = Query.from_(of(None, "e")).group_by("users", row.e.key).group_window(window)
        return q.aggregates(sum=["e.value"], avg=["e.value"], min=["e.value"], max=["e.value"], count=["e.key"]).having(F.col("_count_all") > 1)

    batch, streamed = both(spark, folder, tmp_path, make)
    names = ["_group_key", "_count_all", "e__sum_value", "e__avg_value", "e__min_value", "e__max_value", "e__count_key"]
    rows = lambda df: sorted(tuple(round(float(x), 6) for x in r) for r in df.select(names).collect())
    assert rows(streamed.filter("kind = 'row'")) == rows(batch.df) != []
    assert streamed.filter("kind = 'expired'").count() > 0


def test_streams_refuse_what_they_cannot_hold(spark, folder):
    clicks, buys = (source(spark, folder, k, f"{k}s", True) for k in ("click", "buy"))
    q = Query.from_(clicks).inner_join(buys)
    for bad in (q.using(clicks="key", buys="key"), q.using(clicks="key", buys="key").join_window(count=5), q.using(clicks={"field": "key", "one_shot": True}, buys="key").join_window(time=1.3 * HOUR)):
        with pytest.raises(ValueError, match="stream"):
            bad.stream()
