"""Queries: road networks, routes, walks, blocks, graphs from data, clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import order as O
from orrery.operators import sequences as Q
from orrery.plans.bridge import events
from orrery.plans.q_ranking import vectors
from orrery.plans.q_spatial import _supplier_edges
from orrery.registry import query
from orrery.sources.tables import table

_WAYS = "edges AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7 + 3) % 100 AS b FROM supplier)"


@query(
    "road_network",
    """WITH RECURSIVE rel AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 3) % 100 AS b FROM supplier WHERE (s_suppkey * 7 + 3) % 100 IN (SELECT s_suppkey FROM supplier)),
eq AS (SELECT 2 * a + 1 AS x, 2 * b AS y FROM rel UNION SELECT 2 * b, 2 * a + 1 FROM rel),
ends AS (SELECT 2 * s_suppkey AS p FROM supplier UNION SELECT 2 * s_suppkey + 1 FROM supplier),
r AS (SELECT p, p AS root FROM ends UNION SELECT eq.y, r.root FROM r JOIN eq ON r.p = eq.x),
c AS (SELECT p, min(root) AS root FROM r GROUP BY 1), n AS (SELECT p, dense_rank() OVER (ORDER BY root) - 1 AS node FROM c)
SELECT s_suppkey AS edge, f.node AS from_node, t.node AS to_node FROM supplier JOIN n f ON f.p = 2 * s_suppkey JOIN n t ON t.p = 2 * s_suppkey + 1""",
)
def road_network(spark, d):
    """Nodes of a road network from which edge follows which."""
    return G.road_nodes(table(spark, d, "supplier").select(F.col("s_suppkey").alias("edge")), _supplier_edges(spark, d))


@query(
    "repaired_routes",
    """WITH s AS (SELECT o_custkey AS key, (o_orderkey * 5) % 12 AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
p AS (SELECT *, lag(node) OVER (PARTITION BY key ORDER BY place) AS before FROM s)
SELECT key, flatten(list(CASE WHEN before IS NULL THEN [node] ELSE list_transform(range(1, (node - before + 12) % 12 + 1), lambda i: (before + i) % 12) END ORDER BY place)) AS nodes FROM p GROUP BY 1""",
)
def repaired_routes(spark, d):
    """Gaps between matched nodes filled by the cheapest way: around a ring, as its shortcuts cost too much."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), place.alias("place"), ((F.col("o_orderkey") * 5) % 12).alias("node"))
    ring = spark.range(12).select(F.col("id").alias("a"), ((F.col("id") + 1) % 12).alias("b"), F.lit(1.0).alias("cost"))
    short = spark.range(12).select(F.col("id").alias("a"), ((F.col("id") * 5 + 3) % 12).alias("b"), F.lit(50.0).alias("cost"))
    return G.repaired(s, ring.unionByName(short), 12)


@query(
    "edge_samples",
    f"""WITH {_WAYS}, w AS (SELECT a, b, (a + b) % 5 + 1 AS weight FROM edges), l AS (SELECT a, b, coalesce(sum(weight) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(weight) OVER (ORDER BY a, b) AS high FROM w),
t AS (SELECT sum(weight) AS total FROM w), n AS (SELECT o_orderkey AS draw, CAST('0x' || substr(md5('edge|' || o_orderkey), 1, 8) AS BIGINT) % total AS pos FROM orders, t)
SELECT draw, a, b FROM n JOIN l ON pos >= low AND pos < high""",
)
def edge_samples(spark, d):
    """Edges drawn in proportion to their weights, one for every order."""
    e = _supplier_edges(spark, d).withColumn("weight", (F.col("a") + F.col("b")) % 5 + 1)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("edge"), F.col("o_orderkey"))), 1, 8), 16, 10).cast("long")
    return G.sampled_edges(e, table(spark, d, "orders").select(F.col("o_orderkey").alias("draw"), h.alias("h")))


def _walk_step(k: int) -> str:
    """SQL: the walk's k-th step."""
    h = f"CAST('0x' || substr(md5(concat_ws('|', 'walk', start, '{k}')), 1, 8) AS BIGINT)"
    return f"""o{k} AS (SELECT h.start, h.node, e.b, e.weight * CASE WHEN h.before IS NULL THEN 4 WHEN e.b = h.before THEN 1 WHEN p.b IS NOT NULL THEN 4 ELSE 8 END AS w
  FROM h{k - 1} h JOIN e ON e.a = h.node LEFT JOIN e p ON p.a = h.before AND p.b = e.b),
c{k} AS (SELECT *, sum(w) OVER (PARTITION BY start ORDER BY b) AS high, sum(w) OVER (PARTITION BY start) AS total FROM o{k}),
h{k} AS (SELECT start, node AS before, b AS node FROM c{k} WHERE {h} % total >= high - w AND {h} % total < high)"""


@query(
    "biased_walks",
    f"""WITH {_WAYS}, e AS (SELECT a, b, (a + b) % 5 + 1 AS weight FROM (SELECT a, b FROM edges UNION SELECT b, a FROM edges)),
h0 AS (SELECT DISTINCT a AS start, NULL::BIGINT AS before, a AS node FROM e), {_walk_step(1)}, {_walk_step(2)}, {_walk_step(3)}, {_walk_step(4)}
SELECT start, 0 AS step, node FROM h0 UNION ALL SELECT start, 1, node FROM h1 UNION ALL SELECT start, 2, node FROM h2 UNION ALL SELECT start, 3, node FROM h3 UNION ALL SELECT start, 4, node FROM h4""",
)
def biased_walks(spark, d):
    """Walks that return with weight 1/4 and leave the neighbourhood with weight 2."""
    e = G.both_ways(_supplier_edges(spark, d)).withColumn("weight", (F.col("a") + F.col("b")) % 5 + 1)
    return G.biased_walks(e, e.select(F.col("a").alias("node")).distinct(), 4, 1, 4, 8)


@query(
    "polygonised_blocks",
    """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS c, n_nationkey // 5 AS r FROM nation), p AS (SELECT k, c, r, c + (k * 7 % 5) * 0.05 AS x, r + (k * 3 % 7) * 0.04 AS y FROM n),
q AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3, e.x AS x4, e.y AS y4 FROM p a JOIN p b ON b.c = a.c + 1 AND b.r = a.r JOIN p c ON c.c = a.c + 1 AND c.r = a.r + 1 JOIN p e ON e.c = a.c AND e.r = a.r + 1),
m AS (SELECT abs((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2 AS area,
  sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)) + sqrt(power(x2 - x3, 2) + power(y2 - y3, 2)) + sqrt(power(x3 - x4, 2) + power(y3 - y4, 2)) + sqrt(power(x4 - x1, 2) + power(y4 - y1, 2)) AS perimeter FROM q)
SELECT 4 AS sides, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(4 * pi() * area / power(perimeter, 2), 6) AS compactness FROM m WHERE area BETWEEN 0.8 AND 1.3""",
)
def polygonised_blocks(spark, d):
    """Blocks between crooked streets, of a least and a largest area."""
    k = F.col("n_nationkey").cast("long")
    c, r = k % 5, F.floor(k / 5)
    p = table(spark, d, "nation").select(k.alias("k"), c.alias("c"), r.alias("r"), (c + (k * 7 % 5) * 0.05).alias("x"), (r + (k * 3 % 7) * 0.04).alias("y"))
    a, b = p.alias("a"), p.alias("b")
    right = (F.col("b.c") == F.col("a.c") + 1) & (F.col("b.r") == F.col("a.r"))
    up = (F.col("b.c") == F.col("a.c")) & (F.col("b.r") == F.col("a.r") + 1)
    cols = [F.col("a.k").alias("a"), F.col("b.k").alias("b"), *[F.col(f"{s}.{v}").alias(f"{s}{v}") for s in "ab" for v in "xy"]]
    roads = a.join(b, right).select(*cols).unionByName(a.join(b, up).select(*cols))
    f = G.faces(roads).where(F.col("area").between(0.8, 1.3))
    return f.select(F.col("sides").cast("int").alias("sides"), *[F.round(x, 6).alias(x) for x in ("area", "perimeter", "compactness")])


@query(
    "numbered_zones",
    f"""WITH RECURSIVE {_WAYS}, ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), nodes AS (SELECT a AS node FROM ways),
r AS (SELECT node, node AS root FROM nodes UNION SELECT w.b, r.root FROM r JOIN ways w ON r.node = w.a), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT node, dense_rank() OVER (ORDER BY root) AS zone FROM c""",
)
def numbered_zones(spark, d):
    """Components numbered from 1 in the order in which a scan by node would find them."""
    e = _supplier_edges(spark, d)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return O.dense_index(G.components(e, nodes), "component", "at").select("node", (F.col("at") + 1).alias("zone"))


@query(
    "node_masks",
    """WITH r AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY md5('mask|' || s_suppkey)) - 1 AS pos, count(*) OVER () AS n FROM supplier)
SELECT node, pos < round_even(n * 0.6, 0) AS train, pos >= round_even(n * 0.6, 0) AND pos < round_even(n * 0.6, 0) + round_even(n * 0.2, 0) AS valid, pos >= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) AS test FROM r""",
)
def node_masks(spark, d):
    """Every node in one of three masks, by a fixed shuffle."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    parts = O.chronological_split(s, [F.md5(F.concat_ws("|", F.lit("mask"), F.col("node")))], 0.6, 0.2)
    return parts.select("node", *[(F.col("part") == p).alias(p) for p in ("train", "valid", "test")])


@query(
    "singular_graph",
    """WITH f AS (SELECT CAST(ts AS DATE) AS t, user_id % 12 AS k, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), n AS (SELECT DISTINCT k FROM f), t AS (SELECT DISTINCT t FROM f),
x AS (SELECT t.t, n.k, coalesce(v, 0) AS v FROM t CROSS JOIN n LEFT JOIN f ON f.t = t.t AND f.k = n.k),
d AS (SELECT a.k AS i, b.k AS j, sqrt(sum(power(a.v - b.v, 2))) AS d FROM x a JOIN x b ON a.t = b.t GROUP BY 1, 2)
SELECT i, j, round(exp(-d / power(stddev_pop(d) OVER (), 2)), 5) AS weight FROM d""",
)
def singular_graph(spark, d):
    """A graph of nodes from singular directions of their readings; all of them, so that distances are those of the
    readings themselves."""
    g = events(spark, d).groupBy(F.to_date("ts").alias("time"), (F.col("user_id") % 12).alias("node")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return G.singular_graph(g, 12).select("i", "j", F.round("weight", 5).alias("weight"))


@query("spectral_clusters", "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS cluster FROM nation")
def spectral_clusters(spark, d):
    """Communities of a weighted adjacency: nations that are close to those of their region and far from others."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("r"))
    a = n.select(F.col("k").alias("i"), F.col("r").alias("p"))
    b = n.select(F.col("k").alias("j"), F.col("r").alias("q"))
    near = F.when(F.col("p") == F.col("q"), 1.0 + ((F.col("i") + F.col("j")) % 3) / 10.0).otherwise(0.02)
    edges = a.crossJoin(b).where("i <= j").select("i", "j", near.alias("value"))  # the matrix of a fixed dimension
    return G.spectral_clusters(edges, 5)


@query("time_series_clusters")
def time_series_clusters(spark, d):
    """users' hourly profiles clustered by shape; a cluster's series may be shifted against each other."""
    hours = [F.count_if(F.hour("ts") == h).cast("double") for h in range(24)]
    p = events(spark, d).groupBy("user_id").agg(F.array(*hours).alias("x"))
    return Q.shape_clusters(p, "user_id", "x", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("segment_kinds")
def segment_kinds(spark, d):
    """Vectors of road segments in sqrt(n / 2) kinds by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, d).select("vec_id", array_to_vector("e").alias("v"))
    k = max(2, int(math.sqrt(v.count() / 2)))
    return KMeans(featuresCol="v", predictionCol="kind", k=k, seed=7, maxIter=10).fit(v).transform(v).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("route_grades")
def route_grades(spark, d):
    """Per order how far a matched route strays from the true one: the length of what either has alone over the
    true length, and the shares of the common part in edges and in length. Sequential, so batches of arrays in Python."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey"))).alias("a"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("b")
    )
    li = li.select("l_orderkey", F.col("a.l_partkey").alias("truth"), F.col("b.l_partkey").alias("found"))

    def grade(parts):
        for g in parts:
            rows = []
            for k, truth, found in zip(g["l_orderkey"], g["truth"], g["found"], strict=True):
                size = lambda xs: float(sum(int(x) % 10 + 1 for x in xs))
                same = Q.common_route(np.asarray(truth), np.asarray(found))
                whole, common = size(truth), size(same)
                rows.append((k, (whole + size(found) - 2 * common) / whole, len(same) / len(truth), common / whole))
            yield pd.DataFrame(rows, columns=["k", "rmf", "an", "al"])

    return li.mapInPandas(grade, "k long, rmf double, an double, al double")
