"""The operators over Structured Streaming: native stream joins and deduplication, and stateful sliding groups.

Inputs are streaming DataFrames with a timestamp column. Native operators follow the watermark:
an unmatched row is emitted, and a remembered key forgotten, when the watermark has passed it,
and a record later than the watermark is dropped (the replay would still match it once).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("inner", "left", "right", "outer", "anti_left", "anti_right", "anti_outer")


def timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    """`df` with its time as TIMESTAMP and a watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, seconds: float, kind: str = "inner") -> DataFrame:
    """Rows of both sides with the same key and times at most `seconds` apart; the column names of the sides differ.

    Anti joins are outer joins that keep the rows without a partner, since Structured Streaming
    has no left anti join; rows with a null key take no part in any kind.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown join type {kind!r}")
    left, right = left.filter(F.col(left_key).isNotNull()), right.filter(F.col(right_key).isNotNull())
    gap = F.expr(f"INTERVAL {int(seconds * 1_000_000)} MICROSECONDS")
    lt, rt = F.col(left_time), F.col(right_time)
    on = (F.col(left_key) == F.col(right_key)) & (rt >= lt - gap) & (rt <= lt + gap)
    how = {"inner": "inner", "left": "left", "anti_left": "left", "right": "right", "anti_right": "right"}.get(kind, "full")
    joined = left.join(right, on, how)
    alone = {"anti_left": F.col(right_key).isNull(), "anti_right": F.col(left_key).isNull(), "anti_outer": F.col(left_key).isNull() | F.col(right_key).isNull()}
    return joined.filter(alone[kind]) if kind in alone else joined


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key until the watermark has passed it by its delay."""
    return df.dropna(subset=list(keys)).dropDuplicatesWithinWatermark(list(keys))


class _Rows:
    """Rows of a micro-batch for one key, in order."""

    def __init__(self, parts: Iterator[pd.DataFrame], order: str):
        self.pdf = pd.concat(list(parts)).sort_values(order, kind="stable")


def sliding_group(df: DataFrame, key: str, order: str, value: str, count: int | None = None, seconds: float | None = None) -> DataFrame:
    """A row for every row that arrives: key, order, and rows, sum, min and max of `value` over its window; and what left it.

    `kind` is "row" or "expired"; expired rows have the order of the member that left. The state
    of a key is the members of its window.
    """
    if (count is None) == (seconds is None):
        raise ValueError("give count or seconds")
    order_type, key_type = df.schema[order].dataType, df.schema[key].dataType
    out = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField(key, key_type), T.StructField(order, order_type), T.StructField("n", T.LongType()),
        T.StructField("total", T.DoubleType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType()),
    ])
    state = T.StructType([T.StructField("at", T.ArrayType(order_type)), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(group, parts, held: GroupState):
        at, vs = (list(x) for x in held.get) if held.exists else ([], [])
        rows = []
        for now, v in _Rows(parts, order).pdf[[order, value]].itertuples(index=False):
            at.append(now)
            vs.append(float(v))
            while (count is not None and len(at) > count) or (seconds is not None and (pd.Timestamp(now) - pd.Timestamp(at[0])).total_seconds() > seconds):
                rows.append(("expired", group[0], at.pop(0), None, None, None, None))
                vs.pop(0)
            rows.append(("row", group[0], now, len(vs), sum(vs), min(vs), max(vs)))
        held.update((at, vs))
        yield pd.DataFrame(rows, columns=out.names)

    keyed = df.filter(F.col(key).isNotNull()).select(key, order, F.col(value).cast("double").alias(value))
    return keyed.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def one_shot_join(left: DataFrame, right: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """Pairs of ids with the same key; a record matches once, the earliest partner that is left. Both have `key`, `order`, `ident`.

    `kind` is "match", with both ids. The state of a key is its records without a partner.
    """
    some = lambda df, side: df.filter(F.col(key).isNotNull()).select(key, order, F.col(ident).cast("string").alias("id"), F.lit(side).alias("side"))
    out = f"kind string, {key} {left.schema[key].dataType.simpleString()}, left_id string, right_id string"

    def run(group, parts, held: GroupState):
        waiting = [list(x) for x in held.get] if held.exists else [[], []]
        rows = []
        for ident_, side in _Rows(parts, order).pdf[["id", "side"]].itertuples(index=False):
            if waiting[1 - side]:
                other = waiting[1 - side].pop(0)
                rows.append(("match", group[0], *((ident_, other) if side == 0 else (other, ident_))))
            else:
                waiting[side].append(ident_)
        held.update((waiting[0], waiting[1]))
        yield pd.DataFrame(rows, columns=["kind", key, "left_id", "right_id"])

    both = some(left, 0).unionAll(some(right, 1))
    return both.groupBy(key).applyInPandasWithState(run, out, "l array<string>, r array<string>", "append", GroupStateTimeout.NoTimeout)


def subscribe(df: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Runs the stream into a callback by micro-batch."""
    writer = df.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def split(df: DataFrame, checkpoint: str, results: Callable[[DataFrame, int], None], expired: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """One stream with `kind`, two outputs: results, and rows of kind "expired"; the state exists once."""

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        results(batch.filter("kind <> 'expired'"), number)
        expired(batch.filter("kind = 'expired'"), number)
        batch.unpersist()

    return subscribe(df, both, checkpoint)


def drained(spark: SparkSession, df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, as Parquet under `folder`."""
    run = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
