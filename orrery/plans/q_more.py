"""Queries: zone transitions, overlays, lookups, encodings, clusters, route matching."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import order as O
from orrery.operators import spatial as S
from orrery.operators.sequences import common_route
from orrery.plans.bridge import events, xy, xy_sql
from orrery.plans.q_ranking import _VEC, label_means, vectors
from orrery.plans.q_spatial import _ZONES, zones
from orrery.registry import query
from orrery.sources import sinks
from orrery.sources.shared import shared_dir
from orrery.sources.tables import table


@query(
    "zone_transitions",
    """WITH m AS (SELECT c_custkey AS block, t, c_custkey * (t + 3) % 7 AS zone, CAST(1 + c_custkey % 9 AS BIGINT) AS area FROM customer, range(3) r(t)),
z AS (SELECT t, zone, sum(area) AS total FROM m GROUP BY 1, 2),
o AS (SELECT a.t, a.zone AS prev, b.zone AS curr, sum(a.area) AS shared FROM m a JOIN m b ON a.block = b.block AND b.t = a.t + 1 GROUP BY 1, 2, 3),
k AS (SELECT o.*, p.total AS pt, c.total AS ct FROM o JOIN z p ON p.t = o.t AND p.zone = o.prev JOIN z c ON c.t = o.t + 1 AND c.zone = o.curr WHERE shared >= 0.15 * p.total OR shared >= 0.15 * c.total)
SELECT CAST(t AS INT) AS t, prev, curr, CAST(shared AS BIGINT) AS shared, CASE WHEN count(*) OVER (PARTITION BY t, prev) > 1 THEN 'merge' WHEN count(*) OVER (PARTITION BY t, curr) > 1 THEN 'split' ELSE 'continue' END AS label FROM k""",
)
def zone_transitions(spark, d):
    """Zones are unions of blocks, so overlaps are joins on blocks; literal labels."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("block"), (F.lit(1) + F.col("c_custkey") % 9).cast("long").alias("area"))
    m = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t")).withColumn("zone", F.col("block") * (F.col("t") + 3) % 7)
    z = m.groupBy("t", "zone").agg(F.sum("area").alias("total"))
    b = m.select("block", (F.col("t") - 1).alias("t"), F.col("zone").alias("curr"))
    o = m.join(b, ["block", "t"]).groupBy("t", F.col("zone").alias("prev"), "curr").agg(F.sum("area").alias("shared"))
    o = o.join(z.select("t", F.col("zone").alias("prev"), F.col("total").alias("pt")), ["t", "prev"])
    o = o.join(z.select((F.col("t") - 1).alias("t"), F.col("zone").alias("curr"), F.col("total").alias("ct")), ["t", "curr"])
    o = o.where((F.col("shared") >= 0.15 * F.col("pt")) | (F.col("shared") >= 0.15 * F.col("ct")))
    n = lambda k: F.count(F.lit(1)).over(W.partitionBy("t", k))
    label = F.when(n("prev") > 1, "merge").when(n("curr") > 1, "split").otherwise("continue")
    return o.select("t", "prev", "curr", "shared", label.alias("label"))


@query(
    "longest_overlap",
    f"""WITH {_ZONES}, l AS (SELECT s_suppkey AS k, {xy_sql('s_suppkey')} FROM supplier),
c AS (SELECT k, gid, least(x + 0.2, x0 + 0.25) - greatest(x, x0) AS len FROM l JOIN zones ON y > y0 AND y < y0 + 0.25 AND x < x0 + 0.25 AND x + 0.2 > x0)
SELECT k, round(max(len), 6) AS length, arg_min(gid, -round(len, 6) * 1000 + gid * 0.0000001) AS gid FROM c GROUP BY 1""",
)
def longest_overlap(spark, d):
    """Lines clipped to boxes over shared cells; the zone with the longest piece, the lower id of equals."""
    x, y = F.col("x"), F.col("y")
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), *xy("s_suppkey"))
    cells = lines.select("*", S.cell(y, 0.25).alias("cy"), F.explode(F.sequence(S.cell(x, 0.25), S.cell(x + 0.2, 0.25))).alias("cx"))
    z = zones(spark).select("gid", F.array_min(F.col("ring.x")).alias("x0"), F.array_min(F.col("ring.y")).alias("y0"))
    z = z.select("*", S.cell(F.col("x0") + 0.01, 0.25).alias("cx"), S.cell(F.col("y0") + 0.01, 0.25).alias("cy"))
    length = F.least(x + 0.2, F.col("x0") + 0.25) - F.greatest(x, F.col("x0"))
    hit = cells.join(z, ["cx", "cy"]).where((y > F.col("y0")) & (length > 0)).select("k", "gid", F.round(length, 6).alias("length"))
    best = F.max(F.struct("length", (-F.col("gid")).alias("g")))
    return hit.groupBy("k").agg(best.alias("b")).select("k", "b.length", (-F.col("b.g")).alias("gid"))


@query(
    "endpoint_regions",
    "SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN n_nationkey END, CASE WHEN o_custkey % 2 = 0 THEN n_regionkey END, -1) AS place, CASE WHEN o_orderkey % 4 <> 0 THEN 'direct' WHEN o_custkey % 2 = 0 THEN 'mapped' ELSE 'missing' END AS source FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def endpoint_regions(spark, d):
    """A first lookup, a fallback, a label of where the value came from."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    first, second = F.when(F.col("o_orderkey") % 4 != 0, F.col("n_nationkey")), F.when(F.col("o_custkey") % 2 == 0, F.col("n_regionkey"))
    return j.select(
        F.col("o_orderkey").alias("k"),
        F.coalesce(first, second, F.lit(-1)).alias("place"),
        F.when(first.isNotNull(), "direct").when(second.isNotNull(), "mapped").otherwise("missing").alias("source"),
    )


@query(
    "external_series",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), x AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM s)
SELECT e.event_id, x.n, x.before FROM events e LEFT JOIN x ON CAST(e.ts AS DATE) = x.day""",
)
def external_series(spark, d):
    """An external daily series and its value of the day before, joined on time."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    s = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = s.select(F.date_add("day", 1).alias("day"), F.col("n").alias("before"))
    return e.select("event_id", "day").join(s, "day", "left").join(before, "day", "left").select("event_id", "n", "before")


@query(
    "static_and_dynamic",
    """WITH m AS (SELECT o_custkey AS k, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT c_custkey AS k, CAST(r.m AS INT) AS month_no, c_nationkey AS place, coalesce(m.n, 0) AS n FROM customer CROSS JOIN range(1, 13) r(m) LEFT JOIN m ON m.k = c_custkey AND m.m = r.m""",
)
def static_and_dynamic(spark, d):
    """Static columns at every step, dynamic counts filled with zero."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("place"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_no"))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("month_no")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, ["k", "month_no"], "left").select("k", "month_no", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "equal_mass_bins",
    """WITH RECURSIVE y AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS t, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY t) AS rn FROM y),
r AS (SELECT rn, t, n AS acc, 0 AS bin FROM o WHERE rn = 1 UNION ALL
  SELECT o.rn, o.t, CASE WHEN r.acc >= 3000 THEN o.n ELSE r.acc + o.n END, CASE WHEN r.acc >= 3000 THEN bin + 1 ELSE bin END FROM r JOIN o ON o.rn = r.rn + 1)
SELECT CAST(t AS INT) AS t, bin FROM r""",
)
def equal_mass_bins(spark, d):
    """Bins of at least 3000 facts along a short time axis, by a sequential fold."""
    t = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")
    axis = table(spark, d, "lineitem").groupBy(t).agg(F.count(F.lit(1)).alias("n"))
    axis = axis.agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("bin"), F.array().cast("array<struct<t:int,bin:int>>").alias("out"))

    def step(s, x):
        full = s["acc"] >= 3000
        b = F.when(full, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(
            F.when(full, x["n"]).otherwise(s["acc"] + x["n"]).alias("acc"),
            b.alias("bin"),
            F.concat(s["out"], F.array(F.struct(x["t"].alias("t"), b.alias("bin")))).alias("out"),
        )

    return axis.select(F.explode(F.aggregate("a", start, step, lambda s: s["out"])).alias("o")).select("o.t", "o.bin")


@query(
    "cluster_adjacency",
    "SELECT a.n_regionkey AS a, b.n_regionkey AS b, CAST(sum(abs(a.n_nationkey - b.n_nationkey)) AS BIGINT) AS weight FROM nation a JOIN nation b ON a.n_nationkey % 5 = b.n_nationkey % 5 GROUP BY 1, 2",
)
def cluster_adjacency(spark, d):
    """Edge weights summed between clusters."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 5).alias("m"))
    b = n.select(F.col("k").alias("j"), F.col("a").alias("b"), "m")
    return n.join(b, "m").groupBy("a", "b").agg(F.sum(F.abs(F.col("k") - F.col("j"))).cast("long").alias("weight"))


@query(
    "interval_mean_rank",
    """WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY n DESC, user_id) AS rank FROM s),
f AS (SELECT event_type, user_id, min(day) AS lo, min(day) + 10 AS hi FROM s GROUP BY 1, 2)
SELECT f.event_type, f.user_id, round(avg(rank), 4) AS mean_rank FROM f JOIN r ON r.event_type = f.event_type AND r.user_id = f.user_id AND r.day BETWEEN lo AND hi GROUP BY 1, 2""",
)
def interval_mean_rank(spark, d):
    """Ranks averaged over the days of a fact's interval, exploded to an equi-key."""
    s = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("event_type", "day").orderBy(F.desc("n"), "user_id")))
    f = s.groupBy("event_type", "user_id").agg(F.min("day").alias("lo"))
    f = f.select("event_type", "user_id", F.explode(F.sequence(F.col("lo"), F.date_add("lo", 10))).alias("day"))
    return f.join(r, ["event_type", "user_id", "day"]).groupBy("event_type", "user_id").agg(F.round(F.avg("rank"), 4).alias("mean_rank"))


@query(
    "dictionary_union",
    "SELECT n_nationkey AS k, coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey), (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey)) AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)",
)
def dictionary_union(spark, d):
    """U4, U8: dictionaries merged, the later one wins."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name")).withColumn("place", F.lit(1))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name")).withColumn("place", F.lit(2))
    return a.unionByName(b).groupBy("k").agg(F.max_by("name", "place").alias("name"))


@query(
    "junction_edges",
    "SELECT node, count(DISTINCT edge) AS edges FROM (SELECT 'p' || l_partkey AS node, l_orderkey AS edge FROM lineitem UNION ALL SELECT 's' || l_suppkey, l_orderkey FROM lineitem) GROUP BY 1",
)
def junction_edges(spark, d):
    """Both end points of every edge."""
    ends = F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    e = table(spark, d, "lineitem").select(F.explode(ends).alias("node"), F.col("l_orderkey").alias("edge"))
    return e.groupBy("node").agg(F.countDistinct("edge").alias("edges"))


@query(
    "encoded_columns",
    "WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey AS k, CAST(c_mktsegment = 'BUILDING' AS INT) AS building, CAST(c_mktsegment = 'MACHINERY' AS INT) AS machinery, round((c_acctbal - lo) / (hi - lo), 5) AS balance, round(c_acctbal / 0.5) * 0.5 AS snapped FROM customer, s",
)
def encoded_columns(spark, d):
    """dummy columns, min-max scaling, snapping to a grid."""
    c = table(spark, d, "customer")
    s = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    is_ = lambda v: (F.col("c_mktsegment") == v).cast("int")
    return c.join(F.broadcast(s)).select(
        F.col("c_custkey").alias("k"),
        is_("BUILDING").alias("building"),
        is_("MACHINERY").alias("machinery"),
        F.round((F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), 5).alias("balance"),
        S.snapped(F.col("c_acctbal"), 0.5).alias("snapped"),
    )


@query(
    "sequence_pairs",
    """WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT a.user_id, a.rn AS i, b.rn AS j, CAST(abs(date_diff('second', a.ts, b.ts)) AS BIGINT) AS gap FROM s a JOIN s b ON a.user_id = b.user_id""",
)
def sequence_pairs(spark, d):
    """pairwise gaps of all events of a user."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    s = events(spark, d).select("user_id", F.unix_seconds(F.date_trunc("second", "ts")).alias("s"), n.cast("long").alias("i"))
    b = s.select("user_id", F.col("s").alias("z"), F.col("i").alias("j"))
    return s.join(b, "user_id").select("user_id", "i", "j", F.abs(F.col("s") - F.col("z")).alias("gap"))


@query(
    "nearest_earlier",
    """WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click')
SELECT a.event_id, (SELECT b.event_id FROM e b WHERE b.user_id = a.user_id AND b.ts < a.ts ORDER BY round(abs(b.value - a.value), 6), b.event_id LIMIT 1) AS like_it FROM e a""",
)
def nearest_earlier(spark, d):
    """the earlier event of the user whose value is nearest."""
    e = events(spark, d).where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    b = e.select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("t2"), F.col("value").alias("v2"))
    hit = e.join(b, "user_id").where("t2 < ts")
    best = F.min(F.struct(F.round(F.abs(F.col("v2") - F.col("value")), 6).alias("gap"), "other"))
    best = hit.groupBy("event_id").agg(best.alias("b"))
    return e.select("event_id").join(best, "event_id", "left").select("event_id", F.col("b.other").alias("like_it"))


@query(
    "temporal_scores",
    f"""WITH {_VEC}, t AS (SELECT label - 1 AS label, r AS w FROM rel)
SELECT v.vec_id, round(list_sum(list_transform(list_zip(e, r, w), lambda z: z[1] * z[2] * z[3] + z[1] * z[2] * z[1] + z[2] * z[1] * z[3] + z[1] * z[3] * z[1])), 3) + 0.0 AS score FROM v JOIN rel USING (label) JOIN t USING (label)""",
)
def temporal_scores(spark, d):
    """K5: sums of three-way products over subject, relation, object and time."""
    v = vectors(spark, d)
    m = label_means(v)
    t = m.select((F.col("label") - 1).alias("label"), F.col("r").alias("w"))
    three = lambda a, b, c: V.dot(V.hadamard(F.col(a), F.col(b)), F.col(c))
    s = three("e", "r", "w") + three("e", "r", "e") + three("r", "e", "w") + three("e", "w", "e")
    return v.join(m, "label").join(t, "label").select("vec_id", (F.round(s, 3) + F.lit(0.0)).alias("score"))


@query(
    "axis_order",
    f"WITH c AS (SELECT c_custkey AS k, CASE WHEN median(-c_acctbal) OVER () < 0 THEN -c_acctbal ELSE c_acctbal END AS lon, CASE WHEN median(-c_acctbal) OVER () < 0 THEN c_acctbal ELSE -c_acctbal END AS lat FROM customer) SELECT * FROM c",
)
def axis_order(spark, d):
    """Swap two columns by the sign of one's median; a scalar aggregate, then an expression."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("a"), F.col("c_acctbal").alias("b"))
    m = c.agg(F.median("a").alias("m"))
    swap = F.col("m") < 0
    return c.join(F.broadcast(m)).select("k", F.when(swap, F.col("a")).otherwise(F.col("b")).alias("lon"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("lat"))


@query("csv_round_trip", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3")
def csv_round_trip(spark, d):
    """Written as partitioned CSV, read back with a schema and pruned columns."""
    path = f"{shared_dir(spark)}/nation-{uuid.uuid4().hex}.csv"
    sinks.write_safely(table(spark, d, "nation"), path, "csv", ("n_regionkey",))
    df = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("header", True).csv(path)
    return df.where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("customer_clusters")
def customer_clusters(spark, d):
    """K-means on standardised columns; labels depend on the seed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", *xy("c_custkey"))
    steps = [
        VectorAssembler(inputCols=["c_acctbal", "x", "y"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="v", withMean=True),
        KMeans(featuresCol="v", predictionCol="cluster", k=5, seed=7, maxIter=10),
    ]
    return Pipeline(stages=steps).fit(c).transform(c).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("reduced_vectors")
def reduced_vectors(spark, d):
    """Principal components; signs are arbitrary, so lengths are returned."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, d).select("vec_id", array_to_vector("e").alias("v"))
    out = PCA(k=3, inputCol="v", outputCol="p").fit(v).transform(v)
    return out.select("vec_id", F.round(V.norm(vector_to_array("p")), 4).alias("length"))


@query(
    "route_mismatch",
    """WITH RECURSIVE l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_shipdate, l_partkey) AS a, list(l_partkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY 1),
r AS (SELECT k, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS best FROM l
  UNION ALL SELECT k, a, b, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [j])),
    lambda acc, e: list_append(acc, CASE WHEN a[i + 1] = b[e[1]] THEN best[e[1]] + 1 ELSE greatest(best[e[1] + 1], acc[len(acc)]) END)) FROM r WHERE i < len(a))
SELECT k, CAST(best[len(b) + 1] AS INT) AS common, (len(a) + len(b) - 2 * best[len(b) + 1]) / CAST(len(a) AS DOUBLE) AS mismatch FROM r WHERE i = len(a)""",
)
def route_mismatch(spark, d):
    """Route mismatch by the longest common subsequence of two routes per order; sequential, so grouped pandas."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey"))).alias("a"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("b")
    )
    li = li.select("l_orderkey", F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b"))

    def grade(parts):
        for g in parts:
            rows = []
            for k, a, b in zip(g["l_orderkey"], g["a"], g["b"], strict=True):
                same = len(common_route(np.asarray(a), np.asarray(b)))
                rows.append((k, same, (len(a) + len(b) - 2 * same) / len(a)))
            yield pd.DataFrame(rows, columns=["k", "common", "mismatch"])

    return li.mapInPandas(grade, "k long, common int, mismatch double")


@query("ordered_batches", "SELECT doc_id, n_chars FROM documents")
def ordered_batches(spark, d):
    """T5: lengths ordered inside range partitions, for batching."""
    e = table(spark, d, "documents").select("doc_id", "n_chars")
    return e.repartitionByRange("n_chars").sortWithinPartitions("n_chars")


@query(
    "table_of_relations",
    "SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT l_returnflag || l_linestatus AS relation FROM lineitem)",
)
def table_of_relations(spark, d):
    """The relation dictionary."""
    r = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("relation")).distinct()
    return O.global_rank(r, ["relation"], "id")
