"""Scenarios of joins, filters, distinct and groups, on rows small enough to read."""

import pytest
from pyspark.sql import functions as F

from millrace import Agg, Count, Interval, PerSide, Predicate, Query, frame_from_rows, get, row, wrap
from millrace.plans.event_log import projection
from millrace.sources.schema import assert_record_has_meta, chain


def frame(spark, name, rows, schema=None, **options):
    return frame_from_rows(spark, name, rows, schema=schema, **options)


def ids(spark, name, *values):
    return frame(spark, name, [{"id": v} for v in values], "id long")


def pairs(q, a="left", b="right"):
    made = q.df.select(get(f"{a}.id").alias("a"), get(f"{b}.id").alias("b")).collect()
    return sorted(((r.a, r.b) for r in made), key=lambda p: tuple((x is None, x or 0) for x in p))


def gone(q, schema=None):
    rows = q.expired().collect()
    return sorted((r.schema, int(r.id), r.reason, r.matched) for r in rows if schema in (None, r.schema))


def join(spark, kind, left, right, **window):
    q = Query.from_(ids(spark, "left", *left))._join(kind, ids(spark, "right", *right)).using(left="id", right="id")
    q = q.replaying(order="left_then_right")
    return q.join_window(**window) if window else q


@pytest.mark.parametrize(
    ("kind", "expected"),
    [
        ("inner", [(2, 2)]),
        ("left", [(1, None), (2, 2)]),
        ("right", [(2, 2), (None, 3)]),
        ("outer", [(1, None), (2, 2), (None, 3)]),
        ("anti_left", [(1, None)]),
        ("anti_right", [(None, 3)]),
        ("anti_outer", [(1, None), (None, 3)]),
    ],
)
def test_join_types(spark, kind, expected):
    q = join(spark, kind, [1, 2], [2, 3])
    assert sorted(pairs(q), key=str) == sorted(expected, key=str)
    assert {x[1:3] for x in gone(q)} == {(1, "completed"), (2, "completed"), (3, "completed")}


def test_unknown_join_type(spark):
    with pytest.raises(ValueError, match="unknown join type"):
        Query.from_(ids(spark, "left", 1))._join("semi", ids(spark, "right", 1))


def test_count_window_of_one(spark):
    q = join(spark, "inner", [1, 2, 3], [1, 2, 3], count=1)
    assert pairs(q) == [(3, 3)]
    assert [x[1:] for x in gone(q, "left")] == [(1, "evicted", False), (2, "evicted", False), (3, "completed", True)]


def test_left_join_with_count_of_one(spark):
    orders = frame(spark, "orders", [{"id": 400, "customer": 10}, {"id": 401, "customer": 11}], "id long, customer long")
    q = Query.from_(orders).left_join(ids(spark, "customers", 11)).using(orders="customer", customers="id").join_window(count=1).replaying(order="left_then_right")
    assert pairs(q, "orders", "customers") == [(400, None), (401, 11)]


def test_null_keys_take_no_part(spark):
    left = frame(spark, "left", [{"id": 1, "k": None}, {"id": 2, "k": 5}], "id long, k long")
    q = Query.from_(left).outer_join(ids(spark, "right", 7)).using(left="k", right="id")
    assert pairs(q) == [(2, None), (None, 7)]


def timed(spark, name, *rows):
    return frame(spark, name, [{"id": i, "source_time": float(t), "at": int(t * 10 + 5 * (name == "right"))} for i, t in rows], "id long, source_time double, at long", order_by="at")


def test_interval_join_and_expiry(spark):
    q = Query.from_(timed(spark, "left", (1, 0), (99, 2))).inner_join(timed(spark, "right", (1, 0), (99, 2))).using(left="id", right="id").join_window(time=1)
    assert pairs(q) == [(1, 1), (99, 99)]
    assert gone(q) == [("left", 1, "expired_interval", True), ("left", 99, "completed", True), ("right", 1, "expired_interval", True), ("right", 99, "completed", True)]


def test_lazy_sweep_lets_a_stale_record_match_once(spark):
    left, right = timed(spark, "left", (1, 0)), timed(spark, "right", (1, 5))
    strict = Query.from_(left).inner_join(right).using(left="id", right="id").join_window(time=1)
    assert pairs(strict) == []
    assert pairs(strict.replaying(gc="lazy")) == [(1, 1)]


def test_per_side_windows(spark):
    q = Query.from_(timed(spark, "left", (1, 0), (2, 9))).inner_join(timed(spark, "right", (1, 4), (2, 3))).using(left="id", right="id")
    assert pairs(q.join_window(PerSide(Interval(5), Interval(1)))) == [(1, 1)]


def test_predicate_window(spark):
    left = frame(spark, "left", [{"id": 1, "keep": False}, {"id": 2, "keep": True}], "id long, keep boolean")
    right = frame(spark, "right", [{"id": 1}, {"id": 2}], "id long")
    q = Query.from_(left).outer_join(right).using(left="id", right="id").join_window(PerSide(Predicate(lambda r: r.keep), None)).replaying(order="left_then_right")
    assert sorted(pairs(q), key=str) == sorted([(1, None), (2, 2), (None, 1)], key=str)
    assert ("left", 1, "expired_predicate", False) in gone(q)


def test_per_key_buffer(spark):
    left = frame(spark, "left", [{"id": 1, "n": 0}], "id long, n long")
    right = frame(spark, "right", [{"id": 1, "n": n} for n in (1, 2, 3)], "id long, n long")
    q = Query.from_(left).inner_join(right).using(left={"field": "id", "buffer_size": 1}, right={"field": "id", "buffer_size": 2}).replaying(order="left_then_right")
    assert q.df.count() == 3
    assert sorted(r for _, _, r, _ in gone(q, "right")) == ["completed", "completed", "replaced"]


def test_one_shot_matches_once(spark):
    left = frame(spark, "left", [{"id": 1, "at": 0}, {"id": 1, "at": 3}], "id long, at long", order_by="at")
    right = frame(spark, "right", [{"id": 1, "at": 1}, {"id": 1, "at": 2}], "id long, at long", order_by="at")
    key = {"field": "id", "one_shot": True}
    q = Query.from_(left).inner_join(right).using(left=key, right=dict(key))
    assert q.df.select("left.at", F.col("right.at").alias("b")).collect() == [(0, 1), (3, 2)] or q.df.count() == 2
    assert [r for _, _, r, _ in gone(q)] == ["distinct_match"] * 4


def test_composite_key(spark):
    rows = lambda *x: [{"part": p, "local": n, "id": f"{p}:{n}"} for p, n in x]
    left = frame(spark, "left", rows(("alpha", 1), ("beta", 1)), "part string, local long, id string")
    right = frame(spark, "right", rows(("alpha", 1), ("beta", 2), ("beta", 1)), "part string, local long, id string")
    assert pairs(Query.from_(left).inner_join(right).using(left="id", right="id")) == [("alpha:1", "alpha:1"), ("beta:1", "beta:1")]


def shop(spark):
    customers = frame(spark, "customers", [{"id": 1, "status": "active"}, {"id": 2, "status": "off"}], "id long, status string")
    orders = frame(spark, "orders", [{"id": 101, "customer": 1, "amount": 5.0}, {"id": 102, "customer": 1, "amount": 20.0}, {"id": 103, "customer": 2, "amount": 50.0}], "id long, customer long, amount double")
    refunds = frame(spark, "refunds", [{"id": 201, "order": 101}], "id long, order long")
    return customers, orders, refunds


def test_where_sees_the_joined_row(spark):
    customers, orders, _ = shop(spark)
    q = Query.from_(customers).left_join(orders).using(customers="id", orders="customer")
    q = q.where(lambda r: (r.customers.status == "active") & (r.orders.amount > 10))
    assert pairs(q, "customers", "orders") == [(1, 102)]
    with pytest.raises(ValueError, match="once"):
        q.where("true")


def test_stacked_left_joins_drop_rows_without_the_keyed_schema(spark):
    customers, orders, refunds = shop(spark)
    extra = frame(spark, "customers", [{"id": 1}, {"id": 9}], "id long")
    q = Query.from_(extra).left_join(orders).using(customers="id", orders="customer").left_join(refunds).using(orders="id", refunds="order")
    assert pairs(q, "orders", "refunds") == [(101, 201), (102, None)]


def test_join_on_two_left_schemas_is_a_union(spark):
    customers, orders, _ = shop(spark)
    tags = frame(spark, "tags", [{"id": 1}, {"id": 101}], "id long")
    q = Query.from_(customers).inner_join(orders).using(customers="id", orders="customer").inner_join(tags).using(customers="id", orders="id", tags="id")
    assert sorted(r.t for r in q.df.select(F.col("tags.id").alias("t")).collect()) == [1, 1, 101]


def test_select_rename_and_final_where(spark):
    q = Query.from_(ids(spark, "a", 1, 2, 3)).select_schemas(a="x").final_where(row.x.id > 1).final_where(lambda r: r.x.id != 3)
    assert [r.i for r in q.df.select(get("x.id").alias("i")).collect()] == [2]
    assert q.df.select("x.rx_meta.schema").first()[0] == "x"


def test_distinct_first_and_expired(spark):
    rows = [{"id": 1, "t": 1}, {"id": 1, "t": 2}, {"id": 2, "t": 3}]
    q = Query.from_(frame(spark, "s", rows, "id long, t long", order_by="t")).distinct("s", "id")
    assert sorted(r[0] for r in q.df.select("s.t").collect()) == [1, 3]
    assert sorted(r.reason for r in q.expired().collect()) == ["completed", "completed", "distinct_schema"]


def test_distinct_interval_readmits(spark):
    rows = [{"id": 1, "source_time": 0.0, "at": 0}, {"id": 1, "source_time": 5.0, "at": 1}, {"id": 1, "source_time": 10.0, "at": 2}]
    q = Query.from_(frame(spark, "s", rows, "id long, source_time double, at long", order_by="at")).distinct("s", "id", Interval(5))
    assert sorted(r[0] for r in q.df.select("s.at").collect()) == [0, 2]


def test_distinct_count_forgets_the_oldest_key(spark):
    rows = [{"id": i, "at": n} for n, i in enumerate([1, 1, 2, 1])]
    q = Query.from_(frame(spark, "s", rows, "id long, at long", order_by="at")).distinct("s", "id", Count(1))
    assert sorted(r[0] for r in q.df.select("s.at").collect()) == [0, 2, 3]


def test_distinct_passes_other_schemas_and_drops_null_keys(spark):
    left = frame(spark, "left", [{"id": 1, "place": "x"}, {"id": 2, "place": None}], "id long, place string")
    q = Query.from_(left).outer_join(ids(spark, "right", 9)).using(left="id", right="id").distinct("left", "place")
    assert sorted(pairs(q), key=str) == sorted([(1, None), (None, 9)], key=str)


def values(spark, *vs, key="k1"):
    rows = [{"id": i, "key": key, "value": float(v), "at": i} for i, v in enumerate(vs)]
    return frame(spark, "s", rows, "id long, key string, value double, at long", order_by="at")


def test_group_count_window(spark):
    q = Query.from_(values(spark, 10, 20, 30)).group_by(row.s.key).group_window(count=2).aggregates(sum=["s.value"], avg=["s.value"])
    last = q.frame.df.orderBy(F.col("_at").desc()).first()
    assert (last["_count_all"], last["s__sum_value"], last["s__avg_value"]) == (2, 50.0, 25.0)
    assert sorted(r.reason for r in q.expired().collect()) == ["completed", "completed", "evicted"]
    assert q.having(F.col("_count_all") >= 2).df.count() == 2


def test_group_enriched(spark):
    q = Query.from_(values(spark, 10, 20, 30)).group_by_enrich(row.s.key).group_window(count=2).aggregates(sum=["s.value"])
    last = q.frame.df.orderBy(F.col("_at").desc()).first()
    assert (last["s"]["value"], last["s__sum_value"], last["_groupBy:s"]["_count_all"]) == (30.0, 50.0, 2)


def test_group_time_window_counts_earlier_peers_only(spark):
    rows = [{"id": i, "key": "k", "source_time": t, "at": i} for i, t in enumerate([0.0, 3.0, 3.0, 9.0])]
    q = Query.from_(frame(spark, "s", rows, "id long, key string, source_time double, at long", order_by="at")).group_by(row.s.key).group_window(time=5)
    made = [(r["_count_all"], r["window_start"], r["window_end"]) for r in q.frame.df.orderBy("_at").collect()]
    assert made == [(1, 0.0, 0.0), (2, 0.0, 3.0), (3, 0.0, 3.0), (1, 9.0, 9.0)]
    assert sorted(r.reason for r in q.expired().collect()) == ["completed", "expired", "expired", "expired"]


def test_group_default_window_keeps_only_the_present(spark):
    rows = [{"id": i, "source_time": float(i)} for i in range(3)]
    q = Query.from_(frame(spark, "s", rows, "id long, source_time double")).group_by(F.lit(1))
    assert [r["_count_all"] for r in q.df.collect()] == [1, 1, 1]


def test_group_distinct_fn_and_aliases(spark):
    rows = [{"id": 1, "name": "lion", "value": 10.0, "at": 0}, {"id": 2, "name": "lion", "value": 30.0, "at": 1}, {"id": 3, "name": "gazelle", "value": 50.0, "at": 2}]
    q = Query.from_(frame(spark, "s", rows, "id long, name string, value double, at long", order_by="at")).group_by(F.lit("g")).group_window(count=10)
    q = q.aggregates(count=[Agg("s.id", "kinds", row.s.name)], avg=[Agg("s.value", "mean", row.s.name)])
    last = q.frame.df.orderBy(F.col("_at").desc()).first()
    assert (last["kinds"], last["mean"]) == (2, 30.0)


def test_group_without_row_count(spark):
    q = Query.from_(values(spark, 1, 2)).group_by(row.s.key).group_window(count=5).aggregates(row_count=False, count=["s.id"])
    last = q.frame.df.orderBy(F.col("_at").desc()).first()
    assert (last["_count_all"], last["s__count_id"]) == (0, 2)


def test_aggregates_are_validated():
    from millrace import Aggregates

    with pytest.raises(ValueError, match="list of paths"):
        Aggregates(count=True)


def test_having_needs_a_group(spark):
    with pytest.raises(ValueError, match="group_by"):
        Query.from_(ids(spark, "s", 1)).having("true")


def test_group_null_key_is_skipped(spark):
    rows = [{"id": 1, "key": None}, {"id": 2, "key": "a"}]
    assert Query.from_(frame(spark, "s", rows, "id long, key string")).group_by(row.s.key).group_window(count=2).df.count() == 1


def test_reingest_of_a_group(spark):
    groups = Query.from_(values(spark, 1, 2, key="g1")).group_by("groups", row.s.key).group_window(count=2)
    q = Query.from_(groups, "groups", reset_time=123.0)
    meta = q.df.select("groups.rx_meta.*").distinct().collect()
    assert [(m["id"], m["source_time"]) for m in meta] == [("g1", 123.0)]


def test_subquery_as_join_side(spark):
    customers, orders, _ = shop(spark)
    big = Query.from_(orders).where(row.orders.amount > 10)
    assert pairs(Query.from_(customers).inner_join(big).using(customers="id", orders="customer"), "customers", "orders") == [(1, 102), (2, 103)]


def test_wrap_drops_rows_without_id_and_checks_options(spark):
    df = spark.createDataFrame([("a", None), ("b", "present")], "payload string, uuid string")
    assert wrap("events", df, id_field="uuid").df.count() == 1
    assert_record_has_meta(wrap("events", df, id_field="uuid"))
    with pytest.raises(ValueError, match="id_field or id_selector"):
        wrap("events", df)
    with pytest.raises(ValueError, match="positive integer"):
        wrap("events", df, id_field="uuid", schema_version=0)


def test_wrap_refuses_a_foreign_label(spark):
    df = ids(spark, "a", 1).df.select("a.*")
    with pytest.raises(Exception, match="labelled a"):
        wrap("b", df).df.collect()
    assert wrap("a", df).df.count() == 1


def test_relabelled_source(spark):
    assert Query.from_(ids(spark, "a", 1), "b").primary_schemas() == ["b"]


def test_chain_fans_out(spark):
    customers, orders, _ = shop(spark)
    q = Query.from_(customers).left_join(orders).using(customers="id", orders="customer")
    made = chain(q.frame, [{"schema": "customers"}, {"schema": "orders", "rename_to": "sales", "map": lambda r: {"id": r.id}}])
    assert sorted((r.schema, r.id) for r in made.collect()) == [("customers", 1), ("customers", 1), ("customers", 2), ("sales", 101), ("sales", 102), ("sales", 103)]


def test_describe_and_immutability(spark):
    customers, orders, _ = shop(spark)
    base = Query.from_(customers)
    q = base.left_join(orders).using(customers="id", orders={"field": "customer", "buffer_size": 0}).join_window(count=5)
    assert base.describe()["joins"] == []
    step = q.describe()["joins"][0]
    assert step["window"] == {"mode": "count", "count": 5} and step["key"]["orders"]["buffer_size"] == 1
    assert '"type": "left"' in q.describe_as_string()


def test_using_must_cover_both_sides(spark):
    customers, orders, _ = shop(spark)
    with pytest.raises(ValueError, match="either side"):
        Query.from_(customers).left_join(orders).using(customers="id").df  # noqa: B018


def test_projection(spark):
    customers, orders, refunds = shop(spark)
    q = Query.from_(customers).left_join(orders).using(customers="id", orders="customer").left_join(refunds).using(orders="id", refunds="order")
    assert projection(q) == {"domain": "customers.id", "fields": {"customers": "id", "orders": "customer"}}


def test_default_join_window_precedence(spark):
    from millrace import query as Q

    Q.set_default_join_window({"count": 7})
    try:
        q = join(spark, "inner", [1], [1])
        assert q.describe()["joins"][0]["window"]["count"] == 7
        assert q.with_default_join_window(count=3).describe()["joins"][0]["window"]["count"] == 3
        assert q.with_default_join_window(count=3).join_window(count=2).describe()["joins"][0]["window"]["count"] == 2
    finally:
        Q.set_default_join_window(None)


def test_final_tap_and_sinks(spark):
    bucket = []
    q = Query.from_(ids(spark, "s", 1, 2)).final_tap("seen", rows=F.count(F.lit(1)))
    q.into(bucket)
    assert len(bucket) == 2
    q.df.collect()
    assert q.observations["seen"].get["rows"] == 2


def test_nested_aggregate_rows(spark):
    q = Query.from_(values(spark, 10, 20)).group_by(row.s.key).group_window(count=2)
    made = q.aggregates(sum=["s.value"], max=[Agg("s.value", "top")], min=[Agg("s.value", "stats.low")]).nested()
    last = made.orderBy(F.col("_count_all").desc()).first()
    assert (last["s"]["_sum"]["value"], last["s"]["top"], last["stats"]["low"]) == (30.0, 20.0, 10.0)
    assert (last["s"]["_count"]["id"], last["_count"]["s"]) == (2, 2)


def test_colours():
    from millrace.functions.colors import hsv_to_rgb, rainbow

    assert hsv_to_rgb(0, 1, 1) == (1.0, 0.0, 0.0)
    hues = rainbow(6, reserved=[0.0], gap=0.05)
    assert len(set(hues)) == 6 and all(min(abs(h), 1 - abs(h)) >= 0.05 for h in hues)


def test_clamp(spark):
    from millrace.functions.paths import clamp, clamp01

    r = spark.range(1).select(clamp(F.lit(7.0), 1, 5).alias("a"), clamp01(F.lit(-1.0)).alias("b")).first()
    assert (r.a, r.b) == (5.0, 0.0)


def test_cells_without_rows_follow_the_largest_id(spark):
    from millrace.plans.event_log import cells

    ids = spark.range(1, 15001).withColumnRenamed("id", "k")
    made = cells(ids, "k", 100, start=1)
    assert made.agg(F.sum("n"), F.max("cell_y")).first()[:] == (15000, 149)
    assert cells(ids, "k", 100, 100, 1).agg(F.sum("n")).first()[0] == 10000
