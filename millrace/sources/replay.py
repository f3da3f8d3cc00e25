"""Replay of recorded events: by ticks in the driver, or as a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Timeline:
    """Hands events (dictionaries with `tick` and `schema`) to handlers by schema as its clock moves."""

    def __init__(self, events: Iterable[dict], handlers: dict[str, Callable] | None = None, speed: float = 1.0, start: float = 0.0):
        if speed <= 0:
            raise ValueError("speed is above zero")
        self.events = sorted(events, key=lambda e: e["tick"])
        self.handlers, self.speed, self.tick, self._next = handlers or {}, speed, start, 0

    def run_until(self, tick: float) -> int:
        """Emits everything due; returns how many events."""
        self.tick, done = max(self.tick, tick), 0
        while self._next < len(self.events) and self.events[self._next]["tick"] <= self.tick:
            event = self.events[self._next]
            self._next += 1
            done += 1
            handler = self.handlers.get(event.get("schema"), self.handlers.get("*"))
            if handler:
                handler(event)
        return done

    def advance(self, dt: float) -> int:
        return self.run_until(self.tick + dt * self.speed)

    def drain(self) -> int:
        return self.run_until(self.events[-1]["tick"]) if self.events else 0

    @property
    def finished(self) -> bool:
        return self._next >= len(self.events)


def write_replay(df: DataFrame, order: str, folder: str, files: int = 4) -> None:
    """Writes the rows as files that a stream reads in order: one range after another, as streams go by the files' age."""
    from millrace.operators.ranks import bounds, ranged

    dealt = ranged(df, F.col(order), bounds(df, order, files))
    for n in range(files):
        dealt.filter(F.col("_range") == n).drop("_range").coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(folder)


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """A stream of the Parquet files under `path`."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def throttled(df: DataFrame, order: str, per_tick: int) -> DataFrame:
    """The tick in which each row is drained, `per_tick` rows at a time."""
    from millrace.operators.ranks import bounds, ranged, running

    placed = running(ranged(df, F.col(order), bounds(df, order)), [order], {"_place": F.lit(1)})
    return placed.withColumn("tick", F.floor((F.col("_place") - 1) / per_tick).cast("long")).drop("_place", "_range")
