"""Windowed joins, filters, distinct and sliding groups over schema-tagged event frames."""

from millrace.functions.paths import get, row
from millrace.operators.windows import Count, Interval, Predicate, PerSide, seconds, set_default_current
from millrace.plans.aggregates import Agg, Aggregates
from millrace.query import Query
from millrace.sources.schema import SchemaFrame, frame_from_rows, wrap

__all__ = ["Agg", "Aggregates", "Count", "Interval", "PerSide", "Predicate", "Query", "SchemaFrame", "frame_from_rows", "get", "row", "seconds", "set_default_current", "wrap"]
