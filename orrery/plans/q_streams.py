"""Queries: streaming twins, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import order as O
from orrery.plans.bridge import events
from orrery.registry import query
from orrery.sources import readers, sinks
from orrery.sources.tables import auto, many, table
from orrery.streaming import flows


@query("stream_binned_counts", "SELECT time_bucket(INTERVAL 2 HOUR, ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_binned_counts(spark, d):
    """Tumbling windows over the event stream equal the batch bins."""
    s = flows.collected(flows.binned_counts(flows.event_stream(spark, d)))
    return s.select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@query(
    "stream_gap_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY user_id, session""",
)
def stream_gap_sessions(spark, d):
    """Session windows over the event stream."""
    s = flows.collected(flows.gap_sessions(flows.event_stream(spark, d)))
    return s.select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n")


@query(
    "row_counts",
    "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events",
)
def row_counts(spark, d):
    """Rows of several data sets."""
    parts = [auto(spark, f"{d}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n") for n in ("customer", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("multi_file_union", "SELECT r_name AS name, 2 * count(*) AS n FROM region GROUP BY 1")
def multi_file_union(spark, d):
    """S3: one scan over several files."""
    return many(spark, f"{d}/region.parquet", f"{d}/region.parquet").groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dyna_rows",
    """WITH g AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS flow FROM events GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY user_id, day) - 1 AS dyna_id, 'state' AS type, strftime(day, '%Y-%m-%dT00:00:00Z') AS time, user_id AS entity_id, flow FROM g""",
)
def dyna_rows(spark, d):
    """Rows of an atomic dynamics file."""
    g = events(spark, d).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("flow"))
    return sinks.dyna_rows(g, "day", "user_id", ["flow"])


@query(
    "grid_completeness",
    "SELECT count(DISTINCT CAST(ts AS DATE)) AS times, count(DISTINCT user_id) AS entities, count(DISTINCT (CAST(ts AS DATE), user_id)) AS cells, count(DISTINCT CAST(ts AS DATE)) * count(DISTINCT user_id) = count(DISTINCT (CAST(ts AS DATE), user_id)) AS complete FROM events",
)
def grid_completeness(spark, d):
    """Whether a long table is a full grid."""
    g = events(spark, d).select(F.to_date("ts").alias("day"), "user_id").distinct()
    return readers.complete_grid(g, "day", "user_id")


@query(
    "geojson_features",
    """SELECT c_nationkey, '{"type":"Feature","properties":{"c_acctbal":' || round(avg(c_acctbal), 4) || '},"geometry":{"type":"Point","coordinates":[' || c_nationkey * 1.0::DOUBLE || ',' || c_nationkey * 2.0::DOUBLE || ']}}' AS feature FROM customer GROUP BY c_nationkey""",
)
def geojson_features(spark, d):
    """GeoJSON features with mean values."""
    c = table(spark, d, "customer").select("c_nationkey", (F.col("c_nationkey") * 1.0).alias("x"), (F.col("c_nationkey") * 2.0).alias("y"), "c_acctbal")
    return sinks.geojson_features(c, "c_nationkey", "x", "y", ["c_acctbal"])


@query("props_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_values(spark, d):
    """JSON parsed by schema."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("snake_names", r"SELECT DISTINCT event_type, lower(regexp_replace(upper(left(event_type, 1)) || substr(event_type, 2) || 'Name', '([a-z])([A-Z])', '\1_\2', 'g')) AS name FROM events")
def snake_names(spark, d):
    """camel case to snake case."""
    camel = F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"), F.lit("Name"))
    return table(spark, d, "events").select("event_type", F.lower(F.regexp_replace(camel, "([a-z])([A-Z])", "$1_$2")).alias("name")).distinct()


@query("quarter_names", "SELECT o_orderkey AS k, year(o_orderdate) || 'Q' || quarter(o_orderdate) || '_FZ_' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS label FROM orders")
def quarter_names(spark, d):
    """padded labels with their quarter."""
    from orrery.operators.temporal import quarter_label

    k = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(quarter_label(F.col("o_orderdate")), F.lit("_FZ_"), k).alias("label"))


@query("ordered_ids", "SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation")
def ordered_ids(spark, d):
    """Ids in code point order."""
    return O.global_rank(table(spark, d, "nation").select(F.col("n_name").alias("name")), ["name"], "id")
