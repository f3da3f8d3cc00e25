"""Named queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.paths import get, row
from millrace.operators import joins as J
from millrace.operators.windows import Count, Interval, PerSide, Predicate, seconds
from millrace.plans import event_log
from millrace.plans.aggregates import Agg
from millrace.query import Query
from millrace.sources import ingest
from millrace.sources.schema import chain, wrap

HOUR = seconds(3600)
DAY = 24 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark, d):
    return wrap("customers", table(spark, d, "customer"), id_field="c_custkey", order_by="c_custkey")


def orders(spark, d):
    return wrap("orders", table(spark, d, "orders"), id_field="o_orderkey", time_field="o_orderdate", order_by="o_orderkey")


def partly(spark, d):
    """Customers and orders by keys of which some are null and some have no partner on the other side."""
    c = table(spark, d, "customer").withColumn("c_key", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey")))
    o = table(spark, d, "orders").withColumn("o_key", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") + 100))
    return wrap("customers", c, id_field="c_custkey", order_by="c_custkey"), wrap("orders", o, id_field="o_orderkey", time_field="o_orderdate", order_by="o_orderkey")


def _partly(spark, d, kind):
    c, o = partly(spark, d)
    return Query.from_(c)._join(kind, o).using(customers="c_key", orders="o_key")


def items(spark, d):
    df = table(spark, d, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber")
    return wrap("items", df, id_selector=key, order_by=F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def events(spark, d, label="events", kind=None):
    df = table(spark, d, "events")
    return wrap(label, df.filter(F.col("event_type") == kind) if kind else df, id_field="event_id", time_field="ts", order_by="event_id")


def two(spark, d, kind):
    return _partly(spark, d, kind).flat("customers.c_custkey", "customers.c_name", "orders.o_orderkey", "orders.o_totalprice")


_TWO = "SELECT c_custkey AS customers_c_custkey, c_name AS customers_c_name, o_orderkey AS orders_o_orderkey, o_totalprice AS orders_o_totalprice FROM "
_C = "(SELECT *, c_custkey AS c_key FROM customer WHERE c_mktsegment <> 'MACHINERY') c"
_O = "(SELECT *, o_custkey + 100 AS o_key FROM orders WHERE o_orderpriority <> '5-LOW') o"
_ON = "ON c_key = o_key"
for _name, _kind, _sql in (
    ("inner_join", "inner", f"{_TWO}{_C} JOIN {_O} {_ON}"),
    ("left_join", "left", f"{_TWO}{_C} LEFT JOIN {_O} {_ON}"),
    ("right_join", "right", f"{_TWO}{_C} RIGHT JOIN {_O} {_ON}"),
    ("outer_join", "outer", f"{_TWO}{_C} FULL JOIN {_O} {_ON}"),
    ("anti_left", "anti_left", f"{_TWO}{_C} LEFT JOIN {_O} {_ON} WHERE o_orderkey IS NULL"),
    ("anti_right", "anti_right", f"{_TWO}{_C} RIGHT JOIN {_O} {_ON} WHERE c_custkey IS NULL"),
    ("anti_outer", "anti_outer", f"{_TWO}{_C} FULL JOIN {_O} {_ON} WHERE o_orderkey IS NULL OR c_custkey IS NULL"),
):
    query(_sql, _name)(lambda spark, d, kind=_kind: two(spark, d, kind))


@query(f"{_TWO}{_C} JOIN {_O} {_ON}")
def quickstart(spark, d):
    q = _partly(spark, d, "left")
    return q.where(lambda r: r.orders.o_orderkey.is_not_null()).flat("customers.c_custkey", "customers.c_name", "orders.o_orderkey", "orders.o_totalprice")


@query("SELECT c_custkey AS customers_c_custkey, o_orderkey AS orders_o_orderkey, l_linenumber AS items_l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def chained_inner(spark, d):
    q = Query.from_(customers(spark, d)).inner_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    q = q.inner_join(items(spark, d)).using(orders="o_orderkey", items="l_orderkey")
    return q.flat("customers.c_custkey", "orders.o_orderkey", "items.l_linenumber")


@query("SELECT c_custkey AS customers_c_custkey, o_orderkey AS orders_o_orderkey, l_linenumber AS items_l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey")
def stacked_left(spark, d):
    """A row without the schema that the next join is keyed on takes no part in it."""
    some = items(spark, d)
    some = type(some)(some.df.filter(F.col("items.l_quantity") > 45), some.names)
    q = Query.from_(customers(spark, d)).left_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    return q.left_join(some).using(orders="o_orderkey", items="l_orderkey").flat("customers.c_custkey", "orders.o_orderkey", "items.l_linenumber")


@query("""SELECT c_custkey AS customers_c_custkey, n AS totals__count_all, s AS totals_spent FROM (
  SELECT o_custkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING)
) JOIN customer ON c_custkey = o_custkey WHERE n >= 3""")
def subquery_join(spark, d):
    totals = Query.from_(orders(spark, d)).group_by("totals", row.orders.o_custkey).group_window(count=3)
    totals = totals.aggregates(sum=[Agg("orders.o_totalprice", alias="spent")]).having(F.col("_count_all") >= 3)
    q = Query.from_(customers(spark, d)).inner_join(totals).using(customers="c_custkey", totals="_group_key")
    return q.flat("customers.c_custkey", "totals._count_all", "totals.spent").withColumn("totals_spent", F.round("totals_spent", 2))


def _interval(spark, d, kind, gc):
    q = Query.from_(events(spark, d, "views", "view"))._join(kind, events(spark, d, "buys", "purchase"))
    return q.using(views="user_id", buys="user_id").join_window(time=6 * HOUR).replaying(gc=gc)


_V = "(SELECT * FROM events WHERE event_type = 'view') v"
_B = "(SELECT * FROM events WHERE event_type = 'purchase') b"


@query(f"SELECT v.event_id AS views_event_id, b.event_id AS buys_event_id FROM {_V} JOIN {_B} ON v.user_id = b.user_id AND abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 21600000000")
def interval_join_strict(spark, d):
    return _interval(spark, d, "inner", "strict").flat("views.event_id", "buys.event_id")


@query("""WITH m AS (SELECT *, lag(ts) OVER (ORDER BY event_id) AS p FROM events WHERE event_type IN ('view', 'purchase'))
SELECT CASE WHEN x.event_type = 'view' THEN x.event_id ELSE y.event_id END AS views_event_id,
       CASE WHEN x.event_type = 'view' THEN y.event_id ELSE x.event_id END AS buys_event_id
FROM m x JOIN m y ON x.user_id = y.user_id AND x.event_type <> y.event_type AND y.event_id < x.event_id AND epoch_us(x.p) - epoch_us(y.ts) <= 21600000000""")
def interval_join_lazy(spark, d):
    return _interval(spark, d, "inner", "lazy").flat("views.event_id", "buys.event_id")


@query(f"SELECT v.event_id AS views_event_id FROM {_V} WHERE NOT EXISTS (SELECT 1 FROM {_B} WHERE v.user_id = b.user_id AND abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 21600000000)")
def interval_left_unmatched(spark, d):
    return _interval(spark, d, "anti_left", "strict").flat("views.event_id")


@query(f"""WITH t AS (SELECT max(epoch_us(ts)) AS m FROM events WHERE event_type IN ('view', 'purchase')),
x AS (SELECT 'views' AS schema, v.event_id, epoch_us(v.ts) AS t0, EXISTS (SELECT 1 FROM {_B} WHERE v.user_id = b.user_id AND abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 21600000000) AS matched FROM {_V}
 UNION ALL SELECT 'buys', b.event_id, epoch_us(b.ts), EXISTS (SELECT 1 FROM {_V} WHERE v.user_id = b.user_id AND abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 21600000000) FROM {_B})
SELECT schema, CAST(event_id AS VARCHAR) AS id, matched, CASE WHEN m - t0 > 21600000000 THEN 'expired_interval' ELSE 'completed' END AS reason FROM x, t""")
def interval_expired(spark, d):
    return _interval(spark, d, "left", "strict").expired().select("schema", "id", "matched", "reason")


@query(f"SELECT v.event_id AS views_event_id, b.event_id AS buys_event_id FROM {_V} JOIN {_B} ON v.user_id = b.user_id AND abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 21600000000")
def interval_join_cells(spark, d):
    """The same pairs by cells of time, for keys with very many rows."""
    ev = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = ev.filter("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("views_event_id"))
    right = ev.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("buys_event_id"))
    return J.interval_pairs(left, right, "user_id", "at", 6 * HOUR).select("views_event_id", "buys_event_id")


def _counted(spark, d, kind="inner"):
    q = Query.from_(events(spark, d, "clicks", "click"))._join(kind, events(spark, d, "buys", "purchase"))
    return q.using(clicks="user_id", buys="user_id").join_window(count=100)


_COUNTS = """WITH m AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS nc,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS nb FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (ORDER BY event_id)),
c AS (SELECT * FROM m WHERE event_type = 'click'), b AS (SELECT * FROM m WHERE event_type = 'purchase'),
p AS (SELECT c.event_id AS ce, b.event_id AS be FROM c JOIN b ON c.user_id = b.user_id
  AND CASE WHEN c.event_id < b.event_id THEN b.nc - c.nc < 100 ELSE c.nb - b.nb < 100 END)
"""


@query(_COUNTS + "SELECT ce AS clicks_event_id, be AS buys_event_id FROM p")
def count_window_join(spark, d):
    return _counted(spark, d).flat("clicks.event_id", "buys.event_id")


@query(_COUNTS + """SELECT 'clicks' AS schema, CAST(event_id AS VARCHAR) AS id, event_id IN (SELECT ce FROM p) AS matched,
  CASE WHEN (SELECT max(nc) FROM c) - nc >= 100 THEN 'evicted' ELSE 'completed' END AS reason FROM c
UNION ALL SELECT 'buys', CAST(event_id AS VARCHAR), event_id IN (SELECT be FROM p), CASE WHEN (SELECT max(nb) FROM b) - nb >= 100 THEN 'evicted' ELSE 'completed' END FROM b""")
def count_window_expired(spark, d):
    return _counted(spark, d).expired().select("schema", "id", "matched", "reason")


@query(_COUNTS + "SELECT event_id AS clicks_event_id FROM c WHERE event_id NOT IN (SELECT ce FROM p)")
def count_window_unmatched(spark, d):
    return _counted(spark, d, "anti_left").flat("clicks.event_id")


def _buffered(spark, d, **keys):
    q = Query.from_(events(spark, d, "clicks", "click")).inner_join(events(spark, d, "buys", "purchase"))
    own = lambda: {"field": "user_id", **keys}
    return q.using(clicks=own(), buys=own())


_BUFFER = """WITH m AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS nc,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS nb FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""


@query(_BUFFER + """SELECT c.event_id AS clicks_event_id, b.event_id AS buys_event_id FROM m c JOIN m b ON c.user_id = b.user_id AND c.event_type = 'click' AND b.event_type = 'purchase'
  AND CASE WHEN c.event_id < b.event_id THEN b.nc - c.nc < 3 ELSE c.nb - b.nb < 3 END""")
def per_key_buffer_join(spark, d):
    return _buffered(spark, d, buffer_size=3).flat("clicks.event_id", "buys.event_id")


@query(_BUFFER + """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'buys' END AS schema,
  CASE WHEN CASE WHEN event_type = 'click' THEN max(nc) OVER (PARTITION BY user_id) - nc ELSE max(nb) OVER (PARTITION BY user_id) - nb END >= 3 THEN 'replaced' ELSE 'completed' END AS reason FROM m""")
def per_key_buffer_expired(spark, d):
    return _buffered(spark, d, buffer_size=3).expired().select("schema", "id", "reason")


#: Folds the arrivals in order: `l` and `r` hold what is in the windows, `p` the pairs.
_HOLD = """list_reduce(list_prepend({'side': -1, 'k': 0, 'id': 0, 'l': [], 'r': [], 'p': []}, evs), lambda a, x: {
  'side': 0, 'k': 0, 'id': 0,
  'l': CASE WHEN x.side = 0 THEN list_append(list_filter(a.l, lambda h: NOT (h.k = x.k AND len(list_filter(a.l, lambda g: g.k = x.k AND g.id > h.id)) >= 1)), {'k': x.k, 'id': x.id})[-50:] ELSE a.l END,
  'r': CASE WHEN x.side = 1 THEN list_append(list_filter(a.r, lambda h: NOT (h.k = x.k AND len(list_filter(a.r, lambda g: g.k = x.k AND g.id > h.id)) >= 1)), {'k': x.k, 'id': x.id})[-50:] ELSE a.r END,
  'p': list_concat(a.p, CASE WHEN x.side = 0 THEN list_transform(list_filter(a.r, lambda h: h.k = x.k), lambda h: {'c': x.id, 'b': h.id})
                             ELSE list_transform(list_filter(a.l, lambda h: h.k = x.k), lambda h: {'c': h.id, 'b': x.id}) END)})"""


@query(f"""WITH e AS (SELECT list({{'side': CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, 'k': user_id, 'id': event_id, 'l': CAST([] AS STRUCT(k BIGINT, id BIGINT)[]),
    'r': CAST([] AS STRUCT(k BIGINT, id BIGINT)[]), 'p': CAST([] AS STRUCT(c BIGINT, b BIGINT)[])}} ORDER BY event_id) AS evs FROM events WHERE event_type IN ('click', 'purchase'))
SELECT u.c AS clicks_event_id, u.b AS buys_event_id FROM (SELECT unnest({_HOLD}.p) AS u FROM e)""")
def count_plus_buffer(spark, d):
    return _buffered(spark, d, buffer_size=2).join_window(count=50).flat("clicks.event_id", "buys.event_id")


@query("""WITH m AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'purchase'))
SELECT c.event_id AS clicks_event_id, b.event_id AS buys_event_id FROM m c JOIN m b ON c.user_id = b.user_id AND c.n = b.n AND c.event_type = 'click' AND b.event_type = 'purchase'""")
def one_shot_join(spark, d):
    """The i-th click of a user goes with the i-th purchase, as either side matches its earliest record that is left."""
    return _buffered(spark, d, one_shot=True).flat("clicks.event_id", "buys.event_id")


@query("""WITH m AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'purchase'))
SELECT CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'buys' END AS schema, CAST(event_id AS VARCHAR) AS id, o.user_id IS NOT NULL AS matched,
  CASE WHEN o.user_id IS NOT NULL THEN 'distinct_match' ELSE 'completed' END AS reason
FROM m LEFT JOIN (SELECT user_id, n FROM m GROUP BY user_id, n HAVING count(*) = 2) o USING (user_id, n)""")
def one_shot_matched_expired(spark, d):
    return _buffered(spark, d, one_shot=True).expired().select("schema", "id", "matched", "reason")


@query()
def one_shot_expired(spark, d):
    return _buffered(spark, d, one_shot=True).join_window(time=DAY).expired().select("schema", "id", "matched", "reason")


@query("""SELECT c.event_id AS clicks_event_id, b.event_id AS buys_event_id FROM events c JOIN events b ON c.user_id = b.user_id AND c.event_type = 'click' AND b.event_type = 'purchase'
  AND CASE WHEN c.event_id < b.event_id THEN c.value > 50 ELSE b.value > 50 END""")
def predicate_window_join(spark, d):
    keep = Predicate(lambda r: r.value > 50)
    return _buffered(spark, d).join_window(keep).flat("clicks.event_id", "buys.event_id")


@query("""SELECT c.event_id AS clicks_event_id, b.event_id AS buys_event_id FROM events c JOIN events b ON c.user_id = b.user_id AND c.event_type = 'click' AND b.event_type = 'purchase'
  AND CASE WHEN c.event_id < b.event_id THEN epoch_us(b.ts) - epoch_us(c.ts) <= 86400000000 ELSE epoch_us(c.ts) - epoch_us(b.ts) <= 3600000000 END""")
def per_side_window_join(spark, d):
    return _buffered(spark, d).join_window(PerSide(Interval(DAY), Interval(HOUR))).flat("clicks.event_id", "buys.event_id")


@query("SELECT c_custkey AS customers_c_custkey, o_orderkey AS orders_o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000")
def where_row_view(spark, d):
    q = Query.from_(customers(spark, d)).left_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    return q.where(lambda r: (r.customers.c_mktsegment == "BUILDING") & (r.orders.o_totalprice > 1000)).flat("customers.c_custkey", "orders.o_orderkey")


@query(f"SELECT c_custkey AS customers_c_custkey FROM {_C} LEFT JOIN {_O} {_ON} WHERE o_orderkey IS NULL AND c_acctbal > 0 AND c_custkey <> 3")
def final_where(spark, d):
    q = _partly(spark, d, "left").where(row.orders.o_orderkey.is_null()).final_where(row.customers.c_acctbal > 0).final_where(lambda r: r.customers.c_custkey != 3)
    return q.flat("customers.c_custkey")


@query("SELECT o_orderkey AS bought_o_orderkey, 'bought' AS label FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey > 10")
def select_rename(spark, d):
    q = Query.from_(customers(spark, d)).inner_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    q = q.select_schemas(orders="bought").final_where(row.bought.o_orderkey > 10)
    return q.df.select(get("bought.o_orderkey").alias("bought_o_orderkey"), get("bought.rx_meta.schema").alias("label"))


@query("""SELECT 'customers' AS schema, CAST(c_custkey AS BIGINT) AS k FROM customer JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'sales', CAST(o_orderkey AS BIGINT) FROM customer JOIN orders ON c_custkey = o_custkey""")
def chain_fanout(spark, d):
    q = Query.from_(customers(spark, d)).inner_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    made = chain(q.frame, [{"schema": "customers", "map": lambda r: {"k": r.c_custkey}}, {"schema": "orders", "rename_to": "sales", "map": lambda r: {"k": r.o_orderkey}}])
    return made.select("schema", F.col("k").cast("long").alias("k"))


@query("SELECT min(event_id) AS events_event_id FROM events GROUP BY user_id, event_type")
def distinct_first(spark, d):
    key = lambda e: F.concat_ws(":", e.user_id.column, e.event_type.column)
    return Query.from_(events(spark, d)).distinct("events", key).flat("events.event_id")


_GREEDY = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL SELECT g.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = g.user_id AND e.t - g.t > 86400000000) FROM g WHERE g.t IS NOT NULL)
"""


@query(_GREEDY + "SELECT e.event_id AS events_event_id FROM g JOIN e ON e.user_id = g.user_id AND e.t = g.t")
def distinct_time_window(spark, d):
    return Query.from_(events(spark, d)).distinct("events", "user_id", Interval(DAY)).flat("events.event_id")


@query(_GREEDY + """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS key, CASE WHEN NOT EXISTS (SELECT 1 FROM g WHERE e.user_id = g.user_id AND e.t = g.t) THEN 'distinct_schema'
  WHEN (SELECT max(t) FROM e) - t > 86400000000 THEN 'expired_interval' ELSE 'completed' END AS reason FROM e""")
def distinct_time_expired(spark, d):
    return Query.from_(events(spark, d)).distinct("events", "user_id", Interval(DAY)).expired().select("id", "key", "reason")


#: Folds the events in order: `known` holds the last keys that passed, `out` their events, `gone` the events whose keys were pushed out.
_KNOWN = """WITH e AS (SELECT list({'k': user_id, 'id': event_id, 'known': CAST([] AS STRUCT(k BIGINT, id BIGINT)[]), 'gone': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])} ORDER BY event_id) AS evs FROM events),
f AS (SELECT list_reduce(list_prepend({'k': 0, 'id': 0, 'known': [], 'gone': [], 'out': []}, evs), lambda a, x: {'k': 0, 'id': 0,
  'known': CASE WHEN len(list_filter(a.known, lambda h: h.k = x.k)) > 0 THEN a.known ELSE list_append(a.known, {'k': x.k, 'id': x.id})[-20:] END,
  'gone': CASE WHEN len(a.known) = 20 AND len(list_filter(a.known, lambda h: h.k = x.k)) = 0 THEN list_append(a.gone, a.known[1].id) ELSE a.gone END,
  'out': CASE WHEN len(list_filter(a.known, lambda h: h.k = x.k)) > 0 THEN a.out ELSE list_append(a.out, x.id) END}) AS s FROM e)
"""


@query(_KNOWN + """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id NOT IN (SELECT unnest(s.out) FROM f) THEN 'distinct_schema'
  WHEN event_id IN (SELECT unnest(s.gone) FROM f) THEN 'evicted' ELSE 'completed' END AS reason FROM events""")
def distinct_count_expired(spark, d):
    return Query.from_(events(spark, d)).distinct("events", "user_id", Count(20)).expired().select("id", "reason")


@query(_KNOWN + "SELECT unnest(s.out) AS events_event_id FROM f")
def distinct_count_window(spark, d):
    return Query.from_(events(spark, d)).distinct("events", "user_id", Count(20)).flat("events.event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN n > 1 THEN 'distinct_schema' ELSE 'completed' END AS reason FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def distinct_duplicates_expired(spark, d):
    return Query.from_(events(spark, d)).distinct("events", "user_id").expired().select("id", "reason")


@query("SELECT c_custkey AS customers_c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def distinct_after_join(spark, d):
    q = Query.from_(customers(spark, d)).inner_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    return Query.from_(q.select_schemas("customers")).distinct("customers", "c_custkey").flat("customers.c_custkey")


#: Customers with their orders, in the order (a, b, e) in which a replay emits them: by the later record, then by the earlier one.
_JOINED = """j AS (SELECT c_custkey, o_orderkey, greatest(c_custkey, o_orderkey) AS a, CASE WHEN o_orderkey >= c_custkey THEN 1 ELSE 0 END AS b, least(c_custkey, o_orderkey) AS e
  FROM customer JOIN orders ON c_custkey = o_custkey)"""


def _joined(spark, d):
    return Query.from_(customers(spark, d)).inner_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")


@query(f"WITH {_JOINED} SELECT c_custkey AS customers_c_custkey, o_orderkey AS orders_o_orderkey FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY a, b, e) = 1")
def distinct_after_fanout(spark, d):
    return _joined(spark, d).distinct("customers", "c_custkey").flat("customers.c_custkey", "orders.o_orderkey")


@query(f"""WITH {_JOINED}, m AS (SELECT 0 AS side, o_orderkey AS k, 0 AS line, a, b, e FROM j UNION ALL SELECT 1, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber, 2, 0 FROM lineitem),
w AS (SELECT *, row_number() OVER (ORDER BY a, b, e) AS n, sum(1 - side) OVER o AS nl, sum(side) OVER o AS nr FROM m WINDOW o AS (ORDER BY a, b, e ROWS UNBOUNDED PRECEDING))
SELECT l.k AS orders_o_orderkey, r.line AS items_l_linenumber FROM w l JOIN w r ON l.k = r.k AND l.side = 0 AND r.side = 1
  AND CASE WHEN l.n < r.n THEN r.nl - l.nl < 2000 ELSE l.nr - r.nr < 2000 END""")
def count_window_after_fanout(spark, d):
    q = _joined(spark, d).inner_join(items(spark, d)).using(orders="o_orderkey", items="l_orderkey").join_window(count=2000)
    return q.flat("orders.o_orderkey", "items.l_linenumber")


#: The joined rows and the orders once more, numbered for each customer; `nl` and `nr` count either side.
_AGAIN = f"""WITH {_JOINED}, m AS (SELECT 0 AS side, c_custkey AS k, o_orderkey AS id, a, b, e FROM j UNION ALL SELECT 1, o_custkey, o_orderkey, o_orderkey, 2, 0 FROM orders),
w AS (SELECT *, row_number() OVER o AS n, sum(1 - side) OVER o AS nl, sum(side) OVER o AS nr FROM m WINDOW o AS (PARTITION BY k ORDER BY a, b, e ROWS UNBOUNDED PRECEDING))
SELECT l.id AS orders_o_orderkey, r.id AS again_o_orderkey FROM w l JOIN w r ON l.k = r.k AND l.side = 0 AND r.side = 1 AND """


def _again(spark, d, **keys):
    again = wrap("again", table(spark, d, "orders"), id_field="o_orderkey", order_by="o_orderkey")
    q = _joined(spark, d).inner_join(again).using(customers={"field": "c_custkey", **keys}, again={"field": "o_custkey", **keys})
    return q.flat("orders.o_orderkey", "again.o_orderkey")


@query(_AGAIN + "CASE WHEN l.n < r.n THEN r.nl - l.nl < 2 ELSE l.nr - r.nr < 2 END")
def buffer_after_fanout(spark, d):
    return _again(spark, d, buffer_size=2)


@query(_AGAIN + "l.nl = r.nr")
def one_shot_after_fanout(spark, d):
    return _again(spark, d, one_shot=True)


@query("SELECT c_custkey AS customers_c_custkey, o_orderkey AS orders_o_orderkey FROM customer JOIN orders ON c_custkey % 50 = o_custkey % 70 AND c_nationkey = o_orderkey % 25")
def selector_key_join(spark, d):
    """Keys that are functions of the record, here of two fields each."""
    both = lambda a, b: F.concat_ws(":", a, b)
    q = Query.from_(customers(spark, d)).inner_join(orders(spark, d))
    q = q.using(customers=lambda c: both(c.c_custkey.column % 50, c.c_nationkey.column), orders=lambda o: both(o.o_custkey.column % 70, o.o_orderkey.column % 25))
    return q.flat("customers.c_custkey", "orders.o_orderkey")


@query("""SELECT 'group' AS origin, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 3 THEN 'evicted' ELSE 'completed' END AS reason FROM orders
UNION ALL SELECT 'join', CAST(c_custkey AS VARCHAR), 'completed' FROM customer
UNION ALL SELECT 'join', CAST(o_custkey AS VARCHAR), 'completed' FROM orders""")
def subquery_expired(spark, d):
    """What left the windows of a query that is a source comes along."""
    totals = Query.from_(orders(spark, d)).group_by("totals", row.orders.o_custkey).group_window(count=3)
    q = Query.from_(customers(spark, d)).inner_join(totals).using(customers="c_custkey", totals="_group_key")
    return q.expired().select("origin", "id", "reason")


@query("SELECT event_id AS events_event_id FROM events WHERE event_id % 7 <> 0 AND 1000.0 / (event_id % 7) > 300")
def where_error_drops_row(spark, d):
    """A predicate that fails for a record (here it divides by zero) drops it."""
    return Query.from_(events(spark, d)).where(lambda r: F.lit(1000) / (r.events.event_id.column % 7) > 300).flat("events.event_id")


@query(f"SELECT v.event_id AS views_event_id, b.event_id AS buys_event_id FROM {_V} JOIN {_B} ON v.user_id = b.user_id AND CASE WHEN v.event_id < b.event_id THEN epoch_us(v.ts) ELSE epoch_us(b.ts) END >= 1705312800000000 - 86400000000")
def fixed_clock_join(spark, d):
    """An interval window whose clock stands still: a record is held if it is within a day of it."""
    q = Query.from_(events(spark, d, "views", "view")).inner_join(events(spark, d, "buys", "purchase")).using(views="user_id", buys="user_id")
    return q.join_window(Interval(DAY, current=1705312800000000)).flat("views.event_id", "buys.event_id")


def _grouped(spark, d, enrich=False):
    q = Query.from_(events(spark, d))
    return q.group_by_enrich("users", row.events.user_id) if enrich else q.group_by("users", row.events.user_id)


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 7 if "avg" in c else 4) for c in cols})


_AGGS = dict(sum=["events.value"], avg=["events.value"], min=["events.value"], max=["events.value"])
_COLS = ("events__sum_value", "events__avg_value", "events__min_value", "events__max_value")
_SQL_AGGS = "round(sum(value) OVER w, 4) AS events__sum_value, round(avg(value) OVER w, 7) AS events__avg_value, round(min(value) OVER w, 4) AS events__min_value, round(max(value) OVER w, 4) AS events__max_value"
_ROWS5 = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)"
_DAY = "WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"


@query(f"SELECT user_id AS _group_key, count(*) OVER w AS _count_all, count(event_id) OVER w AS events__count_id, {_SQL_AGGS} FROM events {_ROWS5}")
def group_count_window(spark, d):
    q = _grouped(spark, d).group_window(count=5).aggregates(**_AGGS)
    return _rounded(q.df.select("_group_key", "_count_all", "events__count_id", *_COLS), *_COLS)


@query(f"SELECT user_id AS _group_key, count(*) OVER w AS _count_all, {_SQL_AGGS} FROM events {_DAY}")
def group_time_window(spark, d):
    q = _grouped(spark, d).group_window(time=DAY).aggregates(**_AGGS)
    return _rounded(q.df.select("_group_key", "_count_all", *_COLS), *_COLS)


@query(f"SELECT event_id AS events_event_id, user_id AS _group_key, count(*) OVER w AS _count_all, round(sum(value) OVER w, 4) AS events__sum_value FROM events {_ROWS5}")
def group_enriched(spark, d):
    q = _grouped(spark, d, True).group_window(count=5).aggregates(sum=["events.value"])
    return _rounded(q.df.select(get("events.event_id").alias("events_event_id"), "_group_key", F.col("users._count_all"), "events__sum_value"), "events__sum_value")


@query(f"SELECT * FROM (SELECT user_id AS _group_key, count(*) OVER w AS _count_all, round(sum(value) OVER w, 4) AS events__sum_value FROM events {_ROWS5}) WHERE _count_all >= 3 AND events__sum_value > 300")
def group_having(spark, d):
    q = _grouped(spark, d).group_window(count=5).aggregates(sum=["events.value"])
    q = q.having((F.col("_count_all") >= 3) & (F.round("events__sum_value", 4) > 300))
    return _rounded(q.df.select("_group_key", "_count_all", "events__sum_value"), "events__sum_value")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
p AS (SELECT a.user_id, a.event_id, b.event_type, b.value, row_number() OVER (PARTITION BY a.event_id, b.event_type ORDER BY b.event_id) AS k
      FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 9 AND a.i)
SELECT user_id AS _group_key, count(*) AS kinds, round(sum(value), 4) AS first_sum, round(avg(value), 7) AS first_avg FROM p WHERE k = 1 GROUP BY user_id, event_id""")
def group_distinct_fn(spark, d):
    each = row.events.event_type
    q = _grouped(spark, d).group_window(count=10)
    q = q.aggregates(count=[Agg("events.event_id", "kinds", each)], sum=[Agg("events.value", "first_sum", each)], avg=[Agg("events.value", "first_avg", each)])
    return _rounded(q.df.select("_group_key", "kinds", "first_sum", "first_avg"), "first_sum", "first_avg")


@query(f"SELECT user_id AS _group_key, round(sum(value) OVER w, 4) AS spent, count(value) OVER w AS stats__n FROM events {_ROWS5}")
def group_alias(spark, d):
    q = _grouped(spark, d).group_window(count=5).aggregates(count=[Agg("events.value", "stats.n")], sum=[Agg("events.value", "spent")])
    return _rounded(q.df.select("_group_key", "spent", "stats__n"), "spent")


@query(f"SELECT user_id AS _group_key, CAST(min(epoch_us(ts)) OVER w AS DOUBLE) AS window_start, CAST(max(epoch_us(ts)) OVER w AS DOUBLE) AS window_end FROM events {_DAY}")
def group_window_bounds(spark, d):
    return _grouped(spark, d).group_window(time=DAY).df.select("_group_key", "window_start", "window_end")


@query("SELECT user_id AS _group_key, count(*) AS _count_all, round(sum(value), 3) AS events__sum_value FROM events GROUP BY user_id")
def group_latest_state(spark, d):
    made = _grouped(spark, d).group_window(None).aggregates(sum=["events.value"]).latest()
    return made.select("_group_key", "_count_all", F.round("events__sum_value", 3).alias("events__sum_value"))


@query("""SELECT c_custkey AS _group_key, count(*) OVER w AS _count_all, count(c_custkey) OVER w AS customers__count_id, count(o_orderkey) OVER w AS orders__count_id
FROM customer LEFT JOIN orders ON c_custkey = o_custkey WINDOW w AS (PARTITION BY c_custkey)""")
def group_default_counts(spark, d):
    q = Query.from_(customers(spark, d)).left_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    made = q.group_by(row.customers.c_custkey).group_window(None).latest()
    each = q.flat("customers.c_custkey").select(F.col("customers_c_custkey").alias("_group_key"))
    return made.select("_group_key", "_count_all", "customers__count_id", "orders__count_id").join(each, "_group_key")


@query("SELECT user_id AS _group_key, CAST(0 AS BIGINT) AS _count_all, count(value) OVER w AS events__count_value, count(value) OVER w AS _count_events FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 1 PRECEDING)")
def group_no_row_count(spark, d):
    q = _grouped(spark, d).group_window(count=2).aggregates(row_count=False, count=["events.value"])
    return q.df.select("_group_key", "_count_all", "events__count_value", "_count_events")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN n > 5 THEN 'evicted' ELSE 'completed' END AS reason
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)""")
def group_expired(spark, d):
    return _grouped(spark, d).group_window(count=5).expired().select("id", "reason")


@query("SELECT o_custkey AS totals__group_key, count(*) OVER w AS totals__count_all FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 4 PRECEDING) QUALIFY count(*) OVER w = 5")
def rewrap_group_filter(spark, d):
    totals = Query.from_(orders(spark, d)).group_by("totals", row.orders.o_custkey).group_window(count=5)
    return Query.from_(totals, "totals", reset_time=123.0).where(F.col("totals._count_all") == 5).flat("totals._group_key", "totals._count_all")


@query("SELECT event_id AS events_event_id, CAST(event_id AS VARCHAR) AS id, CAST(epoch_us(ts) AS DOUBLE) AS t FROM events WHERE event_type <> 'error'")
def wrap_drop_null_id(spark, d):
    ident = F.when(F.col("event_type") != "error", F.col("event_id"))
    made = wrap("events", table(spark, d, "events"), id_selector=ident, time_field="ts", order_by="event_id")
    return made.df.select(get("events.event_id").alias("events_event_id"), get("events.rx_meta.id").alias("id"), get("events.rx_meta.source_time").alias("t"))


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, max(event_id) AS last_seen FROM events GROUP BY user_id")
def ingest_dedup_set(spark, d):
    return ingest.dedup_set(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS place FROM events GROUP BY user_id")
def ingest_latest_by_key(spark, d):
    return ingest.latest_by_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_PRIORITY = "CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END"


@query(f"SELECT *, row_number() OVER (ORDER BY priority DESC, event_id) AS turn FROM (SELECT event_id, {_PRIORITY} AS priority FROM events ORDER BY priority DESC, event_id DESC LIMIT 500)")
def ingest_queue_lanes(spark, d):
    return ingest.queue_lanes(table(spark, d, "events").select("event_id", F.expr(_PRIORITY).alias("priority")), "priority", "event_id", 500)


@query("""SELECT event_type, event_id, priority, row_number() OVER (ORDER BY priority DESC, ceil(n / 2.0), event_type, n) AS turn FROM (
  SELECT event_type, event_id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS priority, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
ORDER BY turn LIMIT 3000""")
def ingest_rr_schedule(spark, d):
    df = table(spark, d, "events").select("event_type", "event_id", F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("priority"))
    return ingest.round_robin(df, "event_type", "priority", "event_id", 2, 3000)


@query(f"""WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM {_C} JOIN {_O} {_ON}) AS m,
  (SELECT count(*) FROM {_C}) AS ck, (SELECT count(*) FROM {_O}) AS ok, (SELECT count(*) FROM {_C} WHERE c_key NOT IN (SELECT o_key FROM {_O})) AS u)
SELECT * FROM (SELECT 'source' AS kind, 1 AS layer, 'customers' AS schema, NULL AS reason, c AS events FROM n UNION ALL SELECT 'source', 1, 'orders', NULL, o FROM n
UNION ALL SELECT 'match', 2, 'customers', NULL, m FROM n UNION ALL SELECT 'match', 2, 'orders', NULL, m FROM n UNION ALL SELECT 'unmatched', 2, 'customers', NULL, u FROM n
UNION ALL SELECT 'final', 1, 'customers', NULL, m + u FROM n UNION ALL SELECT 'final', 1, 'orders', NULL, m FROM n
UNION ALL SELECT 'expire', 1, 'customers', 'completed', ck FROM n UNION ALL SELECT 'expire', 1, 'orders', 'completed', ok FROM n) WHERE events > 0""")
def event_log_counts(spark, d):
    return event_log.counts(event_log.event_log(_partly(spark, d, "left")))


@query("SELECT (c_custkey - 1) % 100 AS cell_x, (c_custkey - 1) // 100 AS cell_y, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey >= 1 GROUP BY 1, 2")
def projection_cells(spark, d):
    q = Query.from_(customers(spark, d)).inner_join(orders(spark, d)).using(customers="c_custkey", orders="o_custkey")
    schema, name = event_log.projection(q)["domain"].split(".")
    return event_log.cells(q.flat(f"{schema}.{name}"), f"{schema}_{name}", 100, start=1)


@query("SELECT event_id AS events_event_id FROM events WHERE event_id % 2 = 0")
def bench_lean(spark, d):
    return Query.from_(events(spark, d)).where(lambda r: r.events.event_id % 2 == 0).flat("events.event_id")


def _parts(spark, d, names):
    return [wrap(n, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), id_field="o_orderkey", order_by="o_orderkey") for n in names]


def _self_join(spark, d, names):
    first, *rest = _parts(spark, d, names)
    q = Query.from_(first)
    for other in rest:
        q = q.inner_join(other).using({names[0]: "o_orderkey", other.names[0]: "o_orderkey"}).join_window(count=2000)
    return q.flat(*(f"{n}.o_orderkey" for n in names))


@query("SELECT o_orderkey AS a_o_orderkey, o_orderkey AS b_o_orderkey, o_orderkey AS c_o_orderkey FROM orders")
def bench_join2(spark, d):
    return _self_join(spark, d, ["a", "b", "c"])


@query("SELECT o_orderkey AS a_o_orderkey, o_orderkey AS b_o_orderkey, o_orderkey AS c_o_orderkey, o_orderkey AS d_o_orderkey FROM orders")
def bench_join3(spark, d):
    return _self_join(spark, d, ["a", "b", "c", "d"])


@query("SELECT event_id AS events_event_id, count(*) OVER w AS _count_all, round(sum(value) OVER w, 4) AS events__sum_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 49 PRECEDING)")
def bench_group(spark, d):
    q = _grouped(spark, d, True).group_window(count=50).aggregates(sum=["events.value"])
    return _rounded(q.df.select(get("events.event_id").alias("events_event_id"), F.col("users._count_all"), "events__sum_value"), "events__sum_value")


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 2000")
def bench_ingest(spark, d):
    df = table(spark, d, "events").select("event_id", "value", F.lit(1).alias("priority"))
    return ingest.queue_lanes(df, "priority", "event_id", 2000).select("event_id", "value")
