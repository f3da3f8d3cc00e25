"""Distinct by key: the first record of a key passes, until its window forgets it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.operators.joins import packet
from millrace.operators.sequential import distinct_replay


def distinct(df: DataFrame, schema: str, window: W.Window) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Rows that pass, and what gives the records that were suppressed, or remembered and then forgotten. `df` has `_k`, `_at`, `_t`.

    Rows without the schema pass; rows whose key is null are dropped. Without a window the first
    arrival of every key is an aggregate that is combined before the shuffle. Reasons:
    distinct_schema for what is suppressed; for what was remembered evicted, expired_interval
    (or the window's own), expired_clock_skew (its time was ahead of the clock), or completed.
    """
    plain = [c for c in df.columns if c not in ("_k", "_t")]
    other = df.filter(F.col(f"`{schema}`").isNull()).select(*plain)
    keyed = df.filter(F.col(f"`{schema}`").isNotNull() & F.col("_k").isNotNull())
    record = F.col(f"`{schema}`")
    left = lambda rows, reason: rows.select(*packet(0, schema, F.col("_k"), reason, F.lit(None).cast("boolean"), record, "distinct"))
    if window is None:
        first = keyed.groupBy(F.col("_k").alias("_fk")).agg(F.min("_at").alias("_first"))
        told = keyed.join(first, F.col("_k") == F.col("_fk")).withColumn("_passed", F.col("_at") == F.col("_first"))
        return told.filter("_passed").select(*plain).unionByName(other), lambda: left(told, F.when(F.col("_passed"), W.COMPLETED).otherwise(W.SUPPRESSED))
    told = keyed.join(distinct_replay(keyed, window).withColumnRenamed("t", "_held"), F.col("_at") == F.col("at"))
    passed = told.filter("passed").select(*plain).unionByName(other)

    def expired() -> DataFrame:
        reason = F.coalesce("reason", F.lit(W.COMPLETED))
        gone = told.filter("passed is null or not passed")
        if isinstance(window, W.Interval):
            last = F.lit(window.now) if window.now is not None else F.col("_last")
            late = F.col("passed").isNull() & F.col("reason").isNull() & F.coalesce(last - F.col("_held") > window.offset, F.lit(True))
            reason = F.when(late, window.reason).otherwise(reason)
            if window.now is None:
                gone = gone.join(F.broadcast(keyed.agg(F.max("_t").alias("_last"))))
        return left(gone, reason)

    return passed, expired
