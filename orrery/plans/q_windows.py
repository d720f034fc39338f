"""Queries: sequences, samples, sessions, scalers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import order as O
from orrery.operators import sequences as Q
from orrery.plans.bridge import events
from orrery.registry import query
from orrery.sources.tables import table

_DAILY = "daily AS (SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS t, count(*) AS v FROM events GROUP BY 1, 2)"


def daily(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, d, "events").groupBy("user_id", day.alias("t")).agg(F.count(F.lit(1)).alias("v"))


@query(
    "sliding_samples",
    f"""WITH {_DAILY}, s AS (SELECT user_id, t, list(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x, list(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS y FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT * FROM s WHERE len(x) = 3 AND len(y) = 2""",
)
def sliding_samples(spark, d):
    """Three steps in, two steps out."""
    return Q.samples(daily(spark, d), "user_id", "t", "v", 3, 2)


@query(
    "offset_samples",
    f"""WITH {_DAILY} SELECT a.user_id, a.t, a.v, b.v AS close, c.v AS period FROM daily a JOIN daily b ON a.user_id = b.user_id AND b.t = a.t - 1 JOIN daily c ON a.user_id = c.user_id AND c.t = a.t - 7""",
)
def offset_samples(spark, d):
    """Closeness and period by equi-joins on shifted time; incomplete samples go."""
    a = daily(spark, d)
    shifted = lambda k, n: a.select("user_id", (F.col("t") + k).alias("t"), F.col("v").alias(n))
    return a.join(shifted(1, "close"), ["user_id", "t"]).join(shifted(7, "period"), ["user_id", "t"])


@query(
    "gap_sessions",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def gap_sessions(spark, d):
    """Sessions end at gaps of six hours; short ones are dropped."""
    s = Q.sessions(events(spark, d), "user_id", "ts", "event_id", 6 * 3600)
    g = s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.where("n >= 2").select("user_id", "session", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query(
    "capped_sessions",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 5 AS part FROM r)
SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY run, part) AS session, n FROM (SELECT user_id, run, part, count(*) AS n FROM p GROUP BY 1, 2, 3)""",
)
def capped_sessions(spark, d):
    """W5 with a cap on length."""
    return Q.capped_sessions(events(spark, d), "user_id", "ts", "event_id", 6 * 3600, 5).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query(
    "same_date_sessions",
    "SELECT user_id, CAST(ts AS DATE) AS day, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS INT) AS session, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)",
)
def same_date_sessions(spark, d):
    """One session per date."""
    g = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("session", F.row_number().over(W.partitionBy("user_id").orderBy("day")))


@query(
    "sequence_chunks",
    """SELECT event_id, user_id, (rn - 1) // 8 AS chunk, (rn - 1) % 7 AS slot, CAST(rv = 1 AS BOOLEAN) AS first_visit FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rv FROM events)""",
)
def sequence_chunks(spark, d):
    """Fixed chunks, positions in a cycle, first visits."""
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rv = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return events(spark, d).select(
        "event_id", "user_id", F.floor(rn / 8).alias("chunk"), (rn % 7).cast("long").alias("slot"), (rv == 1).alias("first_visit")
    )


@query(
    "user_prefix_split",
    """SELECT user_id, count(*) FILTER (WHERE rn <= ceil(n * 0.7)) AS train, count(*) FILTER (WHERE rn > ceil(n * 0.7)) AS test, max(event_id) FILTER (WHERE rn = n) AS held_out FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1""",
)
def user_prefix_split(spark, d):
    """The first part of each user's events, and the last one held out."""
    e = events(spark, d).select(
        "user_id",
        "event_id",
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"),
        F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("n"),
    )
    first = F.col("rn") <= F.ceil(F.col("n") * 0.7)
    return e.groupBy("user_id").agg(
        F.count_if(first).alias("train"), F.count_if(~first).alias("test"), F.max(F.when(F.col("rn") == F.col("n"), F.col("event_id"))).alias("held_out")
    )


@query(
    "scalers",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-22')
SELECT event_id, round((value - m) / sd, 4) AS z, round((value - lo) / (hi - lo), 4) AS unit, round(2 * (value - lo) / (hi - lo) - 1, 4) AS both_sides, round(ln(greatest(value, 0) + 0.999), 4) AS logged FROM events, s""",
)
def scalers(spark, d):
    """Scaler statistics of the training span, applied to all rows."""
    e = events(spark, d)
    fit = e.where(F.col("ts") < "2024-01-22").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    v, unit = F.col("value"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return e.join(F.broadcast(fit)).select(
        "event_id",
        F.round((v - F.col("m")) / F.col("sd"), 4).alias("z"),
        F.round(unit, 4).alias("unit"),
        F.round(2 * (v - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1, 4).alias("both_sides"),
        F.round(F.log(F.greatest(v, F.lit(0.0)) + 0.999), 4).alias("logged"),
    )


@query(
    "seasonal_profile",
    f"WITH {_DAILY} SELECT user_id, t % 7 AS phase, round(avg(v), 4) AS mean FROM daily GROUP BY 1, 2",
)
def seasonal_profile(spark, d):
    """Mean by phase of the week."""
    return daily(spark, d).groupBy("user_id", (F.col("t") % 7).cast("long").alias("phase")).agg(F.round(F.avg("v"), 4).alias("mean"))


@query(
    "padded_sequences",
    """WITH l AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS a FROM events GROUP BY 1)
SELECT user_id, list_resize(CASE WHEN len(a) > 6 THEN a[len(a) - 5:] ELSE a END, 6, -1) AS padded FROM l""",
)
def padded_sequences(spark, d):
    """the last six of a sequence, padded on the right."""
    e = events(spark, d)
    a = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s")).select("user_id", F.col("s.event_id").alias("a"))
    return a.select("user_id", Q.padded(F.col("a"), 6, -1).alias("padded"))


@query(
    "step_gaps",
    """WITH s AS (SELECT user_id, date_diff('second', lag(ts) OVER w, ts) AS gap, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(gap) AS n, CAST(sum(gap) AS BIGINT) AS total_gap, round(sum(power(abs(dv), 3)), 2) AS roughness, round(stddev_pop(dv), 4) AS sd FROM s GROUP BY 1""",
)
def step_gaps(spark, d):
    """Consecutive gaps, their sum and the cubed roughness."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ts = F.date_trunc("second", F.col("ts"))
    e = events(spark, d)
    s = e.select("user_id", (F.unix_seconds(ts) - F.unix_seconds(F.lag(ts).over(w))).alias("gap"), (F.col("value") - F.lag("value").over(w)).alias("dv"))
    return s.groupBy("user_id").agg(
        F.count("gap").alias("n"), F.sum("gap").alias("total_gap"), F.round(F.sum(F.pow(F.abs("dv"), 3)), 2).alias("roughness"), F.round(F.stddev_pop("dv"), 4).alias("sd")
    )


@query(
    "location_set_jaccard",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, list(DISTINCT user_id) AS u FROM events GROUP BY 1)
SELECT a.day, round(len(list_intersect(a.u, b.u)) / CAST(len(list_distinct(list_concat(a.u, b.u))) AS DOUBLE), 6) AS jaccard FROM s a JOIN s b ON b.day = a.day - 1""",
)
def location_set_jaccard(spark, d):
    """Similarity of the sets of consecutive days."""
    s = events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.collect_set("user_id").alias("u"))
    b = s.select(F.date_add("day", 1).alias("day"), F.col("u").alias("w"))
    return s.join(b, "day").select("day", F.round(F.size(F.array_intersect("u", "w")) / F.size(F.array_union("u", "w")), 6).alias("jaccard"))


@query(
    "value_histogram",
    "SELECT CAST(least(9, floor(value / 10)) AS INT) AS bin, count(*) AS n, min(floor(value / 10)) * 10 AS edge FROM events GROUP BY 1",
)
def value_histogram(spark, d):
    """Counts between edges, the last bin open."""
    b = F.floor(F.col("value") / 10)
    return table(spark, d, "events").groupBy(F.least(F.lit(9), b).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.min(b) * 10).cast("double").alias("edge"))


@query(
    "chronological_split",
    """WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT CASE WHEN pos < round_even(n * 0.7, 0) THEN 'train' WHEN pos < round_even(n * 0.7, 0) + round_even(n * 0.1, 0) THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(o_orderdate) AS first_ts FROM r GROUP BY 1""",
)
def chronological_split(spark, d):
    """Train, valid and test in time order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return O.chronological_split(o, ["o_orderdate", "o_orderkey"], 0.7, 0.1).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_ts"))
