"""The query builder: immutable, fluent, compiled to DataFrames when its result is asked for."""

from __future__ import annotations

import json
import weakref
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.paths import Path, column, expression, get, row
from millrace.operators import joins as J
from millrace.operators import windows as W
from millrace.operators.distinct import distinct
from millrace.operators.groups import group, nested, totals
from millrace.operators.ranks import bounds
from millrace.operators.ranks import number as arrival_number
from millrace.plans.aggregates import Aggregates
from millrace.plans.model import DistinctStep, JoinStep, Plan, keys
from millrace.sources.schema import ARRIVAL, META, SchemaFrame, as_number, rename, wrap

#: Window of joins that state none, for all queries; None keeps everything, as SQL does.
_default_window: W.Window = None


def set_default_join_window(spec) -> None:
    global _default_window
    _default_window = W.window(spec)


def _source(given, label: str | None = None, **options) -> SchemaFrame | Query:
    """A tagged frame from a tagged frame, a query, or a DataFrame with `label` and wrap() options."""
    reset, expired = options.pop("reset_time", None), None
    if isinstance(given, DataFrame):
        if not label:
            raise ValueError("a DataFrame source needs a label")
        if reset is not None:
            given = given.withColumn(options.setdefault("time_field", "source_time"), F.lit(reset) if not hasattr(reset, "cast") else reset)
        return wrap(label, given, **options)
    if isinstance(given, Query):
        expired = given.expired
        given = given.reingest(label, **{k: v for k, v in options.items() if k in ("id_field", "id_selector")})
    elif not isinstance(given, SchemaFrame):
        raise TypeError(f"expected a DataFrame, SchemaFrame or Query, not {type(given).__name__}")
    if label and len(given.names) == 1 and given.names[0] != label:
        given = rename(given, {given.names[0]: label})
    if reset is not None:
        now = (F.lit(reset) if not hasattr(reset, "cast") else reset).cast("double")
        for n in given.names:
            given = SchemaFrame(given.df.withColumn(n, F.col(f"`{n}`").withField(f"{META}.source_time", now)), given.names)
    return given if expired is None else replace(given, expired=expired)


def dropping(df: DataFrame, condition) -> DataFrame:
    """The rows for which the condition holds. Where it fails (a cast, a division by zero, an index out of bounds) the row is dropped, as for null."""
    conf = df.sparkSession.conf
    strict = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        return df.filter(expression(condition))
    finally:
        conf.set("spark.sql.ansi.enabled", strict)


def _unpersist(frames: list[DataFrame]) -> None:
    for df in frames:
        df.unpersist()


class Query:
    def __init__(self, plan: Plan):
        self.plan = plan
        self._held: list[DataFrame] = []

    def release(self) -> None:
        """Frees what the query keeps on the executors; it is computed again if the result is asked for again."""
        _unpersist(self._held)

    # sources

    @staticmethod
    def from_(source, label: str | None = None, **options) -> Query:
        return Query(Plan(_source(source, label, **options)))

    select_from = from_

    def _with(self, **changes) -> Query:
        return Query(replace(self.plan, **changes))

    # joins

    def _join(self, kind: str, source, label: str | None = None, **options) -> Query:
        if kind not in J.KINDS:
            raise ValueError(f"unknown join type {kind!r}")
        return self._with(joins=(*self.plan.joins, JoinStep(kind, _source(source, label, **options))))

    def inner_join(self, source, label=None, **options) -> Query:
        return self._join("inner", source, label, **options)

    def left_join(self, source, label=None, **options) -> Query:
        return self._join("left", source, label, **options)

    def right_join(self, source, label=None, **options) -> Query:
        return self._join("right", source, label, **options)

    def outer_join(self, source, label=None, **options) -> Query:
        return self._join("outer", source, label, **options)

    def anti_left_join(self, source, label=None, **options) -> Query:
        return self._join("anti_left", source, label, **options)

    def anti_right_join(self, source, label=None, **options) -> Query:
        return self._join("anti_right", source, label, **options)

    def anti_outer_join(self, source, label=None, **options) -> Query:
        return self._join("anti_outer", source, label, **options)

    def _last(self, **changes) -> Query:
        if not self.plan.joins:
            raise ValueError("there is no join to refine")
        return self._with(joins=(*self.plan.joins[:-1], replace(self.plan.joins[-1], **changes)))

    def using(self, mapping: dict | None = None, **more) -> Query:
        """The key of each schema that takes part: at least one of either side."""
        return self._last(using=keys({**(mapping or {}), **more}))

    def join_window(self, spec=None, **parts) -> Query:
        return self._last(window=W.window(spec if spec is not None else parts or None), window_set=True)

    def with_default_join_window(self, spec=None, **parts) -> Query:
        return self._with(default_window=W.window(spec if spec is not None else parts or None), default_set=True)

    def replaying(self, gc: str = "strict", order: str = "time") -> Query:
        """gc: "strict" or "lazy" (a stale record still matches until the sweep after the next arrival);
        order: "time" (by arrival) or "left_then_right"."""
        if gc not in ("strict", "lazy") or order not in ("time", "left_then_right"):
            raise ValueError("gc is strict or lazy, order is time or left_then_right")
        return self._with(gc=gc, order=order)

    # the rest of the clauses

    def distinct(self, schema: str, by, window=None) -> Query:
        """`by`: a dotted path below the schema, or a function of its row proxy."""
        if not schema or by is None:
            raise ValueError("distinct needs a schema and what it is distinct by")
        step = DistinctStep(schema, by, W.window(window), len(self.plan.joins))
        return self._with(distincts=(*self.plan.distincts, step))

    def where(self, predicate) -> Query:
        if self.plan.where is not None:
            raise ValueError("where may be given once; combine the conditions")
        return self._with(where=predicate)

    def select_schemas(self, *names: str, **renamed: str) -> Query:
        flat = [n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])]
        pairs: dict[str, str] = {}
        for n in flat:
            pairs.update(n if isinstance(n, dict) else {n: n})
        return self._with(selection=pairs | renamed)

    def group_by(self, *args) -> Query:
        return self._grouped(args, False)

    def group_by_enrich(self, *args) -> Query:
        return self._grouped(args, True)

    def _grouped(self, args, enrich: bool) -> Query:
        name, key = args if len(args) == 2 else (None, args[0])
        return self._with(group_key=key, group_name=name, enrich=enrich)

    def group_window(self, spec=None, **parts) -> Query:
        return self._with(group_window=W.window(spec if spec is not None else parts or None), group_window_set=True)

    def aggregates(self, spec: Aggregates | None = None, **parts) -> Query:
        return self._with(aggregates=spec or Aggregates(**parts))

    def having(self, predicate) -> Query:
        if self.plan.group_key is None:
            raise ValueError("having needs group_by first")
        return self._with(having=predicate)

    def final_where(self, predicate) -> Query:
        return self._with(final_where=(*self.plan.final_where, predicate))

    def final_tap(self, name: str | None, **metrics) -> Query:
        """Metrics of the rows that come out, read from `observations[name]` after an action; None clears."""
        return self._with(taps=() if name is None else (*self.plan.taps, (name, metrics)))

    def with_visualization_hook(self, hook: Callable | None) -> Query:
        """hook(kind, step, frame) sees the frames of every join: left, right, joined, expired."""
        return self._with(hook=hook)

    # plan

    def primary_schemas(self) -> list[str]:
        out: set[str] = set()
        for s in (self.plan.source, *(j.source for j in self.plan.joins)):
            out.update(s.names)
        return sorted(out)

    def _window(self, step: JoinStep) -> W.Window:
        return step.window if step.window_set else self.plan.default_window if self.plan.default_set else _default_window

    def describe(self) -> dict:
        p = self.plan
        show = lambda w: w.describe() if w is not None else {"mode": "unbounded"}
        text = lambda x: ".".join(x._parts) if isinstance(x, Path) else x if isinstance(x, str) else "expression"
        out = {
            "from": list(p.source.names),
            "joins": [
                {
                    "type": j.kind,
                    "source": list(j.source.names),
                    "key": {s: {"field": k.field if isinstance(k.field, str) else "expression", "buffer_size": k.buffer, "one_shot": k.one_shot} for s, k in sorted((j.using or {}).items())},
                    "window": show(self._window(j)),
                }
                for j in p.joins
            ],
            "gc": {"mode": p.gc, "order": p.order},
            "distinct": [{"schema": d.schema, "by": text(d.by), "window": show(d.window), "after_join": d.after} for d in p.distincts],
            "where": p.where is not None,
            "select": p.selection,
            "having": p.having is not None,
            "final_where": len(p.final_where),
            "group": None,
        }
        if p.group_key is not None:
            out["group"] = {
                "name": p.group_name,
                "view": "enriched" if p.enrich else "aggregate",
                "window": show(p.group_window),
                "row_count": p.aggregates.row_count,
                "aggregates": [{"kind": k, "path": a.path, "alias": a.alias} for k, a in p.aggregates.each()],
            }
        return out

    def describe_as_string(self) -> str:
        return json.dumps(self.describe(), indent=2, sort_keys=True)

    # compilation

    @cached_property
    def _cuts(self) -> list:
        """Ranges of the arrival order, taken from the sources so that no join is computed for them."""
        every = None
        for s in (self.plan.source, *(j.source for j in self.plan.joins)):
            at = s.df.select(arrival_number(s.df).alias(ARRIVAL))
            every = at if every is None else every.unionAll(at)
        return bounds(every, ARRIVAL)

    def _looks_at_order(self, step: JoinStep) -> bool:
        buffers = any(k.buffer is not None for k in step.using.values())
        return buffers or self.plan.gc == "lazy" or any(isinstance(w, W.Count) for w in W.sides(self._window(step)))

    def _dear(self, number: int) -> bool:
        """What comes before the join of this number has ranks or a replay, so that it should not be computed for each of its readers."""
        before = self.plan.joins[: number - 1]
        shots = any(k.one_shot for j in before for k in j.using.values())
        return shots or any(map(self._looks_at_order, before)) or any(d.window is not None for d in self.plan.distincts if d.after < number)

    def _time(self, frame: SchemaFrame, schema: str, w: W.Window):
        if isinstance(w, W.Interval) and w.field and w.field in frame.df.schema[schema].dataType.names:
            return as_number(frame.df, F.col(f"`{schema}`.`{w.field}`"))
        return F.col(f"`{schema}`.{META}.source_time")

    def _run_join(self, left: SchemaFrame, step: JoinStep, number: int, gone: list) -> SchemaFrame:
        right: SchemaFrame = step.source
        if not step.using:
            raise ValueError("every join needs using()")
        lefts, rights = [s for s in left.names if s in step.using], [s for s in right.names if s in step.using]
        if not lefts or not rights:
            raise ValueError("using() must name a schema of either side")
        if clash := set(left.names) & set(right.names):
            raise ValueError(f"schemas on both sides of a join: {sorted(clash)}")
        if self._looks_at_order(step) and self._dear(number):
            # totals by range and the ranks of both sides read it; otherwise every join of a chain would triple the work.
            # What is cheap is read anew, as then only the columns that are wanted are: the cache would hold whole records
            left = SchemaFrame(left.df.persist(), left.names)
            self._held.append(left.df)
        wl, wr = W.sides(self._window(step))
        buffers = [max((step.using[s].buffer for s in some if step.using[s].buffer), default=None) for some in (lefts, rights)]
        out = None
        for a in lefts:
            for b in rights:
                made = []
                # the left side of a later join brings the arrivals of the joins before it
                for frame, s, w, size, source in ((left, a, wl, buffers[0], 0 if number == 1 else None), (right, b, wr, buffers[1], number)):
                    k = step.using[s]
                    some = frame.df.filter(F.col(f"`{s}`").isNotNull())
                    own = F.col(f"`{s}`.`{k.field}`") if isinstance(k.field, str) else column(k.field(row[s]))
                    some = some.withColumns({"_k": own, "_t": self._time(frame, s, w)})
                    made.append(J.Side(some, s, w, size, k.one_shot, source))
                kind = step.kind
                cuts = self._cuts if self.plan.order == "time" and self._looks_at_order(step) else []
                rows, expired = J.join(*made, kind, self.plan.gc, self.plan.order, cuts)
                if self.plan.hook:
                    for name, df in (("left", made[0].df), ("right", made[1].df), ("joined", rows), ("expired", expired())):
                        self.plan.hook(name, number, df)
                gone.append((expired, number))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        names = (*left.names, *right.names)
        return SchemaFrame(out.select(*(f"`{n}`" for n in names), ARRIVAL), names)

    def _run_distinct(self, frame: SchemaFrame, number: int, gone: list) -> SchemaFrame:
        for d in self.plan.distincts:
            if d.after == number:
                if d.schema not in frame.names:
                    raise ValueError(f"distinct on unknown schema {d.schema}")
                key = get(f"{d.schema}.{d.by}") if isinstance(d.by, str) else expression(d.by(row[d.schema]) if callable(d.by) else d.by)
                df = frame.df.withColumns({"_k": key, "_t": self._time(frame, d.schema, d.window)})
                rows, expired = distinct(df, d.schema, d.window)
                gone.append((expired, number))
                frame = SchemaFrame(rows.select(*(f"`{n}`" for n in frame.names), ARRIVAL), frame.names)
        return frame

    @cached_property
    def _built(self):
        p, gone = self.plan, []
        frame = self._run_distinct(p.source, 0, gone)
        for i, step in enumerate(p.joins, 1):
            frame = self._run_distinct(self._run_join(frame, step, i, gone), i, gone)
        if p.where is not None:
            frame = SchemaFrame(dropping(frame.df, p.where), frame.names)
        if p.selection is not None:
            if missing := set(p.selection) - set(frame.names):
                raise ValueError(f"unknown schemas {sorted(missing)}")
            frame = rename(frame, p.selection)
        df, names, group_name = frame.df, frame.names, None
        if p.group_key is not None:
            self._ungrouped = (df, names)
            root = names[0]
            when = F.col(f"`{root}`.{META}.source_time")
            w = p.group_window
            if isinstance(w, W.Interval) and w.field:
                when = as_number(df, get(w.field if "." in w.field else f"{root}.{w.field}"))
            elif w is None and p.group_window_set is False:
                w = W.Interval(0)
            df, expired, group_name = group(df.withColumn("_t", when), names, expression(p.group_key), w, p.aggregates, p.group_name, p.enrich)
            gone.append((expired, len(p.joins) + 1))
            names = names if p.enrich else ()
            if p.having is not None:
                df = dropping(df, p.having)
        for condition in p.final_where:
            df = dropping(df, condition)
        observations = {}
        for name, metrics in p.taps:
            observations[name] = Observation(name)
            df = df.observe(observations[name], *((c.alias(n)) for n, c in metrics.items()))
        return SchemaFrame(df, names), gone, observations, group_name

    @property
    def frame(self) -> SchemaFrame:
        return self._built[0]

    @property
    def df(self) -> DataFrame:
        """The result; structs by schema, or the aggregate columns of a group."""
        return self._freeing(self.frame.df.drop(ARRIVAL, "_t"))

    def _freeing(self, df: DataFrame) -> DataFrame:
        """What the query keeps on the executors goes when its result does; what is asked for later is computed again."""
        if self._held:
            weakref.finalize(df, _unpersist, list(self._held)).atexit = False
        return df

    @property
    def observations(self) -> dict[str, Observation]:
        return self._built[2]

    def flat(self, *fields: str) -> DataFrame:
        return self._freeing(self.frame.flat(*fields))

    def expired(self) -> DataFrame:
        """Every record that left a window, why, and whether it had matched. Of join records the selected schemas only.

        What left the windows of queries that are sources here comes along as it is.
        """
        out = None
        for made, number in self._built[1]:
            part = made().withColumn("step", F.lit(number))
            out = part if out is None else out.unionByName(part)
        sources = [s for s in (self.plan.source, *(j.source for j in self.plan.joins)) if s.expired is not None]
        if out is None and not sources:
            return self.frame.df.sparkSession.createDataFrame([], J.EXPIRED)
        if self.plan.selection is not None and out is not None:
            pairs = F.create_map(*(F.lit(x) for kv in self.plan.selection.items() for x in kv))
            kept = out.filter((F.col("origin") != "join") | F.col("schema").isin(list(self.plan.selection)))
            out = kept.withColumn("schema", F.coalesce(F.try_element_at(pairs, F.col("schema")), F.col("schema")))
        for s in sources:
            out = s.expired() if out is None else out.unionByName(s.expired())
        return out

    def latest(self) -> DataFrame:
        """The last emission of each group. Of groups without a window that is a plain aggregate."""
        p = self.plan
        if p.group_key is None:
            raise ValueError("latest needs group_by")
        if p.group_window is None and p.group_window_set and not (p.enrich or p.final_where or p.taps) and p.having is None:
            _ = self._built
            made = totals(*self._ungrouped, expression(p.group_key), p.aggregates, p.group_name)
            if made is not None:
                return made
        df = self.frame.df
        cols = [c for c in df.columns if c not in (ARRIVAL, "_t", "_group_key")]
        last = df.groupBy("_group_key").agg(F.max_by(F.struct(*(f"`{c}`" for c in cols)), ARRIVAL).alias("_s"))
        return last.select("_group_key", *(F.col(f"_s.`{c}`").alias(c) for c in cols))

    def nested(self) -> DataFrame:
        """Aggregate rows as nested structs, by schema, kind and leaf."""
        if self.plan.group_key is None or self.plan.enrich:
            raise ValueError("nested needs group_by")
        w = self.plan.group_window if self.plan.group_window_set else W.Interval(0)
        names = tuple(self.plan.selection.values()) if self.plan.selection else tuple(n for s in (self.plan.source, *(j.source for j in self.plan.joins)) for n in s.names)
        return nested(self.frame.df, self.plan.aggregates, names, w)

    def reingest(self, label: str | None = None, id_field: str | None = None, id_selector=None) -> SchemaFrame:
        """This query's result as a source. Aggregate rows become records whose id falls back to the group key."""
        built, _, _, group_name = self._built
        if self.plan.group_key is None or self.plan.enrich:
            if self.plan.enrich:
                built = SchemaFrame(built.df.select(*(f"`{n}`" for n in built.names), ARRIVAL), built.names)
            return built
        df = built.df
        ident = expression(id_selector) if id_selector is not None else F.col(f"`{id_field}`") if id_field else F.lit(None)
        ident = F.coalesce(ident.cast("string"), F.col("_group_key").cast("string"))
        payload = [c for c in df.columns if c not in (ARRIVAL, "_t")]
        flat = df.select(*(f"`{c}`" for c in payload), F.col("_t").alias("source_time"), ident.alias("_gid"), ARRIVAL)
        return wrap(label or group_name, flat, id_field="_gid", time_field="source_time")

    # sinks

    def stream(self, delay: str = "0 seconds") -> DataFrame:
        """The query over streaming sources as one streaming DataFrame; `delay` is how late records may be. See millrace.streaming.plan."""
        from millrace.streaming.plan import compile_stream

        return compile_stream(self, delay)

    def subscribe(self, on_next: Callable, on_completed: Callable | None = None) -> None:
        """Calls on_next with every row, a partition at a time."""
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            on_next(r)
        if on_completed:
            on_completed()

    def into(self, bucket: list) -> Query:
        """Appends every row to a list; for results that fit there."""
        self.subscribe(bucket.append)
        return self

    def rows(self) -> Iterator:
        return self.df.toLocalIterator()
