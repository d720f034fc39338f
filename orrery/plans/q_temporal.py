"""Queries: grids, bins, quarters, calendars, date functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import order as O
from orrery.operators import temporal as T
from orrery.plans.bridge import FACTS, ORIGIN, events, facts
from orrery.registry import query
from orrery.sources.tables import table

BINS = 360
_BIN = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 7200000000.0) AS BIGINT)"
_GRID = f"""
users AS (SELECT DISTINCT user_id FROM events),
grid AS (SELECT user_id, bin FROM users, range({BINS}) b(bin))"""


def _binned(spark, d):
    return events(spark, d).withColumn("bin", T.bin_index(F.col("ts"), ORIGIN, 7200)).where(F.col("bin").between(0, BINS - 1))


@query(
    "event_grid_binary",
    f"""WITH {_GRID}, cells AS (SELECT DISTINCT {_BIN} AS bin, user_id FROM events)
SELECT CAST(g.bin AS BIGINT) AS bin, g.user_id, CAST(c.bin IS NOT NULL AS INT) AS present
FROM grid g LEFT JOIN cells c ON g.bin = c.bin AND g.user_id = c.user_id""",
)
def event_grid_binary(spark, d):
    """Dense 0/1 occupancy, 2-hour bins by user."""
    e = _binned(spark, d)
    cells = e.select("bin", "user_id").distinct().withColumn("present", F.lit(1))
    return T.dense_grid(cells, e, BINS, "bin", "user_id", {"present": 0})


@query(
    "flow_grid_dense",
    f"""WITH {_GRID}, trips AS (
  SELECT user_id, {_BIN} AS bin, lead(user_id) OVER w AS next_user, lead({_BIN}) OVER w AS next_bin
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
flows AS (SELECT bin, user_id, 0 AS i, 1 AS o FROM trips WHERE next_user IS NOT NULL
  UNION ALL SELECT next_bin, next_user, 1, 0 FROM trips WHERE next_user IS NOT NULL),
cells AS (SELECT bin, user_id, sum(i) AS i, sum(o) AS o FROM flows GROUP BY 1, 2)
SELECT CAST(g.bin AS BIGINT) AS bin, g.user_id, CAST(coalesce(i, 0) AS BIGINT) AS inflow, CAST(coalesce(o, 0) AS BIGINT) AS outflow
FROM grid g LEFT JOIN cells c ON g.bin = c.bin AND g.user_id = c.user_id""",
)
def flow_grid_dense(spark, d):
    """In and out flows of trips (an event and the next of its type) on the dense grid.

    Windows are a type's days, not the type: a day's last event is followed by the first of the next day that has one, of
    which there is one row per type and day.
    """
    e = _binned(spark, d).withColumn("day", F.to_date("ts"))
    w = W.partitionBy("event_type", "day").orderBy("ts", "event_id")
    firsts = e.groupBy("event_type", "day").agg(F.min(F.struct("ts", "event_id", "user_id", "bin")).alias("first"))
    later = firsts.select("event_type", "day", F.lead("first").over(W.partitionBy("event_type").orderBy("day")).alias("later"))
    t = e.select("event_type", "day", "bin", "user_id", F.lead(F.struct("user_id", "bin")).over(w).alias("next"))
    t = t.join(later, ["event_type", "day"]).withColumn("next", F.coalesce("next", F.col("later").dropFields("ts", "event_id")))
    t = t.select("bin", "user_id", F.col("next.user_id").alias("nu"), F.col("next.bin").alias("nb")).where("nu is not null")
    out = t.select("bin", "user_id", F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = t.select(F.col("nb").alias("bin"), F.col("nu").alias("user_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    cells = out.unionByName(into).groupBy("bin", "user_id").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"))
    return T.dense_grid(cells, e, BINS, "bin", "user_id", {"inflow": 0, "outflow": 0})


@query(
    "daily_counts",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def daily_counts(spark, d):
    """Counts per day and type."""
    return events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "dense_index_of_ids",
    "SELECT DISTINCT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx FROM events",
)
def dense_index_of_ids(spark, d):
    """Sorted unique ids numbered from 0."""
    return O.dense_index(table(spark, d, "events").select("user_id").distinct(), "user_id")


@query(
    "interval_quarters",
    f"""WITH {FACTS}, quarters AS (
  SELECT CAST(q AS DATE) AS q_start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q_end
  FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 3 MONTH) r(q)),
j AS (SELECT relation, q_start, greatest(start_date, q_start) AS s, least(end_date, q_end) AS e
  FROM facts JOIN quarters ON start_date <= q_end AND end_date >= q_start)
SELECT relation, year(q_start) || 'Q' || quarter(q_start) AS quarter, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS days
FROM j GROUP BY 1, 2""",
)
def interval_quarters(spark, d):
    """Facts meet the quarters they touch by an exploded key, then are clamped to them."""
    q = T.expand_quarters(facts(spark, d).select("relation", "start_date", "end_date"), "start_date", "end_date")
    s, e = T.clamp(F.col("start_date"), F.col("end_date"), F.col("q_start"), F.col("q_end"))
    return q.groupBy("relation", "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.datediff(e, s) + 1).cast("long")).alias("days")
    )


@query(
    "timeline_bounds",
    "SELECT min(t) AS first_day, max(t) AS last_day FROM (SELECT CAST(o_orderdate AS DATE) t FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT CAST(ts AS DATE) FROM events)",
)
def timeline_bounds(spark, d):
    """Bounds over several tables."""
    days = [
        table(spark, d, n).agg(F.min(F.to_date(c)).alias("lo"), F.max(F.to_date(c)).alias("hi"))
        for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    ]
    return days[0].unionByName(days[1]).unionByName(days[2]).agg(F.min("lo").alias("first_day"), F.max("hi").alias("last_day"))


@query(
    "interval_points",
    f"""WITH {FACTS}, p AS (
  SELECT relation, unnest(list_distinct([start_date, start_date + CAST(floor((end_date - start_date) / 2) AS INT), end_date])) AS point FROM facts)
SELECT relation, point, count(*) AS n FROM p GROUP BY 1, 2""",
)
def interval_points(spark, d):
    """Start, middle and end of each fact as time points."""
    return T.expand_points(facts(spark, d), "start_date", "end_date", "start-mid-end").groupBy("relation", "point").agg(F.count(F.lit(1)).alias("n"))


@query(
    "calendar_records",
    """WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events)
SELECT user_id, year(day) * 12 + month(day) - 1 AS month_ordinal, count(DISTINCT day) AS days,
       CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day
FROM e GROUP BY 1, 2""",
)
def calendar_records(spark, d):
    """Period ordinals with the range they cover."""
    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"))
    return e.groupBy("user_id", (F.year("day") * 12 + F.month("day") - 1).cast("long").alias("month_ordinal")).agg(
        F.countDistinct("day").alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day")
    )


@query(
    "wildcard_dates",
    """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '####-##-##' WHEN 1 THEN strftime(o_orderdate, '%Y') || '-##-##'
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-##' WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders)
SELECT k, text, CASE WHEN text LIKE '####%' OR text LIKE '%-13-%' THEN -1
  WHEN text LIKE '%-##-##' THEN CAST(left(text, 4) AS INT) * 12 ELSE CAST(left(text, 4) AS INT) * 12 + CAST(substr(text, 6, 2) AS INT) - 1 END AS month_no FROM t""",
)
def wildcard_dates(spark, d):
    """ordinals of dates with unknown parts."""
    o = table(spark, d, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, "####-##-##")
        .when(F.col("o_orderkey") % 5 == 1, F.concat(f("yyyy"), F.lit("-##-##")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(f("yyyy-MM"), F.lit("-##")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(f("yyyy"), F.lit("-13-01")))
        .otherwise(f("yyyy-MM-dd"))
    )
    o = o.select(F.col("o_orderkey").alias("k"), text.alias("text"))
    return o.select("k", "text", T.wildcard_month(F.col("text")).alias("month_no"))


@query(
    "interval_completion",
    """WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS s,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) - 10 ELSE CAST(o_orderdate AS DATE) + 20 END AS e FROM orders)
SELECT k, coalesce(s, DATE '0001-01-01') AS start_date,
  CASE WHEN coalesce(e, DATE '3000-12-31') < coalesce(s, DATE '0001-01-01') THEN s ELSE coalesce(e, DATE '3000-12-31') END AS end_date FROM t""",
)
def interval_completion(spark, d):
    """open and reversed intervals."""
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    s = F.when(k % 3 != 0, day)
    e = F.when(k % 4 == 1, F.date_sub(day, 10)).when(k % 4 > 1, F.date_add(day, 20))
    a, b = T.completed(s, e)
    return table(spark, d, "orders").select(k.alias("k"), a.alias("start_date"), b.alias("end_date"))


@query(
    "time_features",
    """SELECT event_id, list_transform(range(7), lambda i: CAST(isodow(ts) - 1 = i AS INT)) AS weekday_flags,
  (epoch_us(ts) // 1000000 % 86400) / 86400.0::DOUBLE AS day_share, CAST(hour(ts) + 24 * (isodow(ts) - 1) + 1 AS INT) AS code,
  CAST(isodow(ts) > 5 AS INT) AS weekend, CAST(hour(ts) + CASE WHEN isodow(ts) > 5 THEN 24 ELSE 0 END AS INT) AS slot48 FROM events""",
)
def time_features(spark, d):
    """Calendar features of time stamps."""
    ts = F.col("ts")
    weekend = F.weekday(ts) > 4
    return events(spark, d).select(
        "event_id",
        T.weekday_one_hot(ts).alias("weekday_flags"),
        T.day_fraction(ts).alias("day_share"),
        T.check_in_code(ts).alias("code"),
        weekend.cast("int").alias("weekend"),
        (F.hour(ts) + F.when(weekend, 24).otherwise(0)).alias("slot48"),
    )


@query(
    "parsed_times",
    """SELECT event_id, date_trunc('minute', ts) AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  round(date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) / 60.0, 6) AS hours FROM events""",
)
def parsed_times(spark, d):
    """Several text formats back to one time, ISO-8601 out, hours since the origin."""
    ts = F.col("ts")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy/M/d H:mm"))
        .when(F.col("event_id") % 3 == 1, F.date_format(ts, "MM/dd/yyyy hh:mm:00 a"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:00'Z'"))
    )
    parsed = T.parsed_time(text, ("yyyy/M/d H:mm", "MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    hours = (F.unix_seconds("parsed") - F.unix_seconds(F.lit(ORIGIN).cast("timestamp"))) / 3600
    return (
        events(spark, d)
        .select("event_id", parsed.alias("parsed"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
        .select("event_id", F.col("parsed").cast("timestamp_ntz").alias("parsed"), "iso", F.round(hours, 6).alias("hours"))
    )


@query(
    "digit_tokens",
    "SELECT o_orderkey AS k, list_concat(list_transform(range(1, 9), lambda i: CAST(substr(strftime(o_orderdate, '%Y%m%d'), i, 1) AS INT)), [-1, -1]) AS tokens FROM orders",
)
def digit_tokens(spark, d):
    """date digits padded to ten tokens."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), T.digit_tokens(F.date_format("o_orderdate", "yyyy-MM-dd"), 10).alias("tokens")
    )


@query(
    "nearest_period",
    """WITH axis AS (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) AS ord FROM orders),
want AS (SELECT DISTINCT year(l_shipdate) * 4 + quarter(l_shipdate) AS target FROM lineitem)
SELECT target, (SELECT arg_min(ord, abs(ord - target) * 100000 + ord) FROM axis) AS aligned FROM want""",
)
def nearest_period(spark, d):
    """The nearest snapshot of a small time axis, ties to the earliest."""
    q = lambda c: F.year(c) * 4 + F.quarter(c)
    axis = table(spark, d, "orders").select(q("o_orderdate").cast("long").alias("ord")).distinct()
    want = table(spark, d, "lineitem").select(q("l_shipdate").cast("long").alias("target")).distinct()
    axis = axis.agg(F.array_sort(F.collect_set("ord")).alias("axis"))
    near = lambda a: F.array_min(
        F.transform(a, lambda o: F.struct(F.abs(o - F.col("target")).alias("gap"), o.alias("ord")))
    )["ord"]
    return want.join(F.broadcast(axis)).select("target", near(F.col("axis")).alias("aligned"))
