"""Schema-tagged frames: one struct column per schema, and the order in which rows arrived."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.paths import expression

ARRIVAL = "_at"
META = "rx_meta"


@dataclass(frozen=True)
class SchemaFrame:
    """`df` has a struct column for each of `names`, which holds the payload and `rx_meta`, and `_at`."""

    df: DataFrame
    names: tuple[str, ...]
    #: Gives what left the windows of the query that the frame comes from.
    expired: Callable[[], DataFrame] | None = None

    def flat(self, *fields: str) -> DataFrame:
        """Columns `<schema>_<field>`; by default every payload field of every schema."""
        out = []
        for name in self.names:
            for f in self.df.schema[name].dataType.names:
                if f != META and (not fields or f"{name}.{f}" in fields):
                    out.append(F.col(f"`{name}`.`{f}`").alias(f"{name}_{f}"))
        return self.df.select(*out)


def as_number(df: DataFrame, value: Column) -> Column:
    """A time as a number: timestamps in microseconds, numbers as they are, anything else null."""
    kind = df.select(value.alias("_v")).schema["_v"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    return F.lit(None).cast("double")


def arrival(df: DataFrame, order_by) -> Column:
    """The arrival order as a whole number."""
    if order_by is None:
        return F.monotonically_increasing_id()
    at = F.col(order_by) if isinstance(order_by, str) else expression(order_by)
    kind = df.select(at.alias("_v")).schema["_v"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(at.cast("timestamp"))
    return at.cast("long")


def wrap(
    name: str,
    df: DataFrame,
    id_field: str | None = None,
    id_selector=None,
    time_field: str | None = None,
    time_selector=None,
    schema_version: int | None = None,
    order_by=None,
    id_label: str | None = None,
) -> SchemaFrame:
    """Tags the rows of `df` with the schema `name`; rows without an id are dropped.

    An `rx_meta` that the rows bring along must have the same label and version; its id and time win.
    `order_by` gives the arrival order and should be unique: rows that tie count as one arrival.
    """
    if not isinstance(name, str) or not name:
        raise ValueError("a schema needs a name")
    if (id_field is None) == (id_selector is None) and META not in df.columns:
        raise ValueError("give id_field or id_selector")
    if time_field is not None and time_selector is not None:
        raise ValueError("give time_field or time_selector, not both")
    if schema_version is not None and (not isinstance(schema_version, int) or schema_version < 1):
        raise ValueError("schema_version is a positive integer")
    ident = F.col(f"`{id_field}`") if id_field else expression(id_selector) if id_selector is not None else F.lit(None)
    if time_selector is not None:
        time = as_number(df, expression(time_selector))
    else:
        time_field = time_field or ("source_time" if "source_time" in df.columns else None)
        time = as_number(df, F.col(f"`{time_field}`")) if time_field else F.lit(None).cast("double")
    version = F.lit(schema_version).cast("int")
    label = F.lit(name)
    payload = [c for c in df.columns if c != META]
    ident = ident.cast("string")
    if META in df.columns:
        old = {f: F.col(f"{META}.{f}") for f in df.schema[META].dataType.names}
        if "schema" in old:
            clash = old["schema"] != name
            label = F.when(clash, F.raise_error(F.concat(F.lit(f"schema {name} holds a record labelled "), old["schema"])).cast("string")).otherwise(label)
        if "schema_version" in old and schema_version is not None:
            clash = old["schema_version"] != schema_version
            version = F.when(clash, F.raise_error(F.lit("schema versions differ")).cast("int")).otherwise(version)
        elif "schema_version" in old:
            version = old["schema_version"].cast("int")
        ident = F.coalesce(old["id"].cast("string"), ident) if "id" in old else ident
        time = F.coalesce(old["source_time"].cast("double"), time) if "source_time" in old else time
    meta = F.struct(
        label.alias("schema"),
        ident.alias("id"),
        F.lit(id_label or id_field or ("custom" if id_selector is not None else None)).cast("string").alias("id_field"),
        version.alias("schema_version"),
        time.alias("source_time"),
        F.lit(None).cast("string").alias("join_key"),
        F.lit("record").alias("shape"),
    )
    tagged = df if ARRIVAL in df.columns and order_by is None else df.withColumn(ARRIVAL, arrival(df, order_by))
    payload = [c for c in payload if c != ARRIVAL]
    out = tagged.filter(ident.isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in payload), meta.alias(META)).alias(name), ARRIVAL)
    return SchemaFrame(out, (name,))


def frame_from_rows(spark: SparkSession, name: str, rows: Iterable[dict], id_field: str = "id", schema=None, **options) -> SchemaFrame:
    """A tagged frame from dictionaries, in their order."""
    rows = list(rows)
    if schema is None:
        fields: dict[str, None] = {}
        for r in rows:
            fields.update(dict.fromkeys(r))
        data = [{f: r.get(f) for f in fields} | {ARRIVAL: i} for i, r in enumerate(rows)]
        df = spark.createDataFrame(data)
    else:
        kind = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        names = kind.names
        df = spark.createDataFrame([(*(r.get(f) for f in names), i) for i, r in enumerate(rows)], T.StructType([*kind.fields, T.StructField(ARRIVAL, T.LongType())]))
    return wrap(name, df, id_field=id_field, **options)


def assert_record_has_meta(frame: SchemaFrame) -> None:
    """Checks at plan time that every schema of the frame carries the metadata that joins need."""
    for name in frame.names:
        kind = frame.df.schema[name].dataType
        if not isinstance(kind, T.StructType) or META not in kind.names:
            raise ValueError(f"{name} has no {META}")
        missing = {"schema", "id", "source_time"} - set(kind[META].dataType.names)
        if missing:
            raise ValueError(f"{META} of {name} lacks {sorted(missing)}")


def rename(frame: SchemaFrame, mapping: dict[str, str]) -> SchemaFrame:
    """Keeps and renames whole schemas; the label in `rx_meta` follows."""
    cols = [
        F.when(F.col(f"`{a}`").isNotNull(), F.col(f"`{a}`").withField(f"{META}.schema", F.lit(b))).alias(b) if a != b else F.col(f"`{a}`")
        for a, b in mapping.items()
    ]
    rest = [c for c in frame.df.columns if c not in frame.names]
    return SchemaFrame(frame.df.select(*cols, *rest), tuple(mapping.values()))


def chain(frame: SchemaFrame, mappings: list[dict]) -> DataFrame:
    """Records of one or several schemas as flat rows with `schema` and the metadata of their source.

    Each mapping: `schema`, optional `rename_to` and `map` (function of the row proxy that gives
    {field: column}); rows that lack the schema are left out.
    """
    out = None
    for m in mappings:
        name = m["schema"]
        if name not in frame.names:
            raise ValueError(f"unknown schema {name}")
        some = frame.df.filter(F.col(f"`{name}`").isNotNull())
        if m.get("map"):
            from millrace.functions.paths import column, row

            fields = [column(c).alias(f) for f, c in m["map"](row[name]).items()]
        else:
            fields = [F.col(f"`{name}`.`{f}`").alias(f) for f in frame.df.schema[name].dataType.names if f != META]
        meta = F.col(f"`{name}`.{META}").withField("schema", F.lit(m.get("rename_to", name)))
        part = some.select(F.lit(m.get("rename_to", name)).alias("schema"), *fields, meta.alias(META), ARRIVAL)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
