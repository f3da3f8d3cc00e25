"""What happened in a query, as frames: a normalised event log, its counts, projection and grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.query import Query
from millrace.sources.schema import META


def projection(query: Query) -> dict:
    """The field that names the domain (the left key of the first join), and the field of every schema joined on it."""
    steps = query.plan.joins
    if not steps or not steps[0].using:
        return {"domain": None, "fields": {}}
    first = steps[0].using
    left = next(s for s in query.plan.source.names if s in first)
    fields = {s: k.field for s, k in first.items() if isinstance(k.field, str)}
    for step in steps[1:]:
        using = step.using or {}
        if any(fields.get(s) == k.field for s, k in using.items()):
            fields.update({s: k.field for s, k in using.items() if s not in fields})
    return {"domain": f"{left}.{first[left].field}" if left in fields else None, "fields": fields}


def event_log(query: Query) -> DataFrame:
    """kind (source, match, unmatched, final, expire), layer, schema, id, reason. The last join has layer 1."""
    steps = len(query.plan.joins)
    parts = []

    def records(df: DataFrame, kind: str, layer: int, names) -> None:
        for n in names:
            some = df.filter(F.col(f"`{n}`").isNotNull())
            parts.append(some.select(F.lit(kind).alias("kind"), F.lit(layer).alias("layer"), F.lit(n).alias("schema"), F.col(f"`{n}`.{META}.id").alias("id"), F.lit(None).cast("string").alias("reason")))

    for i, source in enumerate([query.plan.source, *(j.source for j in query.plan.joins)]):
        records(source.df, "source", max(1, steps - max(0, i - 1)), source.names)
    joined: list = []
    watched = Query(query.plan).with_visualization_hook(lambda kind, step, df: joined.append((kind, step, df)))
    frame = watched.frame
    for kind, step, df in joined:
        if kind == "joined":
            names = [c for c in df.columns if not c.startswith("_")]
            sides = [[n for n in names if n in source] for source in (set(names) - set(query.plan.joins[step - 1].source.names), set(query.plan.joins[step - 1].source.names))]
            both = F.lit(True)
            for side in sides:
                any_ = F.lit(False)
                for n in side:
                    any_ = any_ | F.col(f"`{n}`").isNotNull()
                both = both & any_
            records(df.filter(both), "match", steps - step + 2, names)
            records(df.filter(~both), "unmatched", steps - step + 2, names)
    records(frame.df, "final", 1, frame.names)
    gone = query.expired().select(F.lit("expire").alias("kind"), (F.lit(steps) - F.col("step") + 1).alias("layer"), "schema", "id", "reason")
    out = gone
    for p in parts:
        out = out.unionByName(p)
    return out


def counts(log: DataFrame) -> DataFrame:
    """Events by kind, layer, schema and reason."""
    return log.groupBy("kind", "layer", "schema", "reason").agg(F.count("*").alias("events"))


def cells(df: DataFrame, id_col: str, columns: int, rows: int | None = None, start: int = 0) -> DataFrame:
    """Ids on a grid of `columns` by `rows` from `start`: cell_x, cell_y and how many; ids outside are left out.

    Without `rows` the grid has as many rows as the ids need, so only ids before `start` are left out.
    """
    at = F.col(id_col) - start
    inside = df.filter(at >= 0 if rows is None else (at >= 0) & (at < columns * rows))
    return inside.groupBy((at % columns).cast("long").alias("cell_x"), F.floor(at / columns).cast("long").alias("cell_y")).agg(F.count("*").alias("n"))


def zoom(active: int) -> tuple[int, int]:
    """The grid for so many active ids."""
    return (10, 10) if active <= 100 else (100, 100)


def history(log: DataFrame, key: str, order: str, keep: int = 10) -> DataFrame:
    """The last `keep` events of each key."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return log.withColumn("_rank", rank).filter(F.col("_rank") <= keep).drop("_rank")


def decayed(df: DataFrame, cell: list[str], value: str, time: str, now: float, ttl: float) -> DataFrame:
    """Mean of `value` by cell, each event weighted by what is left of its time to live."""
    weight = F.greatest(F.lit(0.0), 1 - (F.lit(now) - F.col(time)) / ttl)
    return df.withColumn("_w", weight).groupBy(*cell).agg((F.sum(F.col(value) * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("blended"))
