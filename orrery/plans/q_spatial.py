"""Queries: geometry, spatial joins and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import spatial as S
from orrery.plans.bridge import xy, xy_sql
from orrery.registry import query
from orrery.sources import readers
from orrery.sources.tables import table

STEP = 0.25
_ZONES = f"""zones AS (SELECT i * 4 + j AS gid, i * {STEP} AS x0, j * {STEP} AS y0 FROM range(4) a(i), range(4) b(j))"""
_CUSTOMERS = f"customers AS (SELECT c_custkey AS pid, c_acctbal AS w, {xy_sql('c_custkey')} FROM customer)"
_SUPPLIERS = f"suppliers AS (SELECT s_suppkey AS qid, {xy_sql('s_suppkey')} FROM supplier)"
_D = "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))"


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("w"), *xy("c_custkey"))


def suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), *xy("s_suppkey"))


def zones(spark):
    """16 square zones as closed rings, gid = 4 i + j."""
    x0, y0 = F.floor(F.col("id") / 4) * STEP, (F.col("id") % 4) * STEP
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(x0, y0), p(x0 + STEP, y0), p(x0 + STEP, y0 + STEP), p(x0, y0 + STEP), p(x0, y0))
    return spark.range(16).select(F.col("id").alias("gid"), ring.alias("ring"))


@query(
    "point_in_polygon",
    f"WITH {_CUSTOMERS}, {_ZONES} SELECT gid, count(*) AS n, round(sum(w), 4) AS total FROM customers, zones WHERE x > x0 AND x < x0 + {STEP} AND y > y0 AND y < y0 + {STEP} GROUP BY 1",
)
def point_in_polygon(spark, d):
    """Points in rings by grid cell and ray casting, first polygon kept."""
    c = customers(spark, d)
    inside = c.where((F.col("x") % STEP != 0) & (F.col("y") % STEP != 0))
    hits = S.polygon_join(inside, zones(spark), STEP / 2)
    return hits.join(c.select("pid", "w"), "pid").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"))


@query(
    "ring_measures",
    f"WITH {_ZONES} SELECT gid, round({STEP} * {STEP}, 6) AS area, round(4 * {STEP}, 6) AS perimeter, round(pi() / 4, 6) AS compact, round(x0 + {STEP} / 2, 6) AS cx, round(y0 + {STEP} / 2, 6) AS cy FROM zones",
)
def ring_measures(spark, d):
    """area, perimeter, compactness and centroid."""
    r = F.col("ring")
    z = zones(spark).withColumn("c", S.ring_centroid(r))
    return z.select(
        "gid",
        F.round(S.ring_area(r), 6).alias("area"),
        F.round(S.line_length(r), 6).alias("perimeter"),
        F.round(S.compactness(r), 6).alias("compact"),
        F.round("c.x", 6).alias("cx"),
        F.round("c.y", 6).alias("cy"),
    )


@query(
    "zone_adjacency",
    f"WITH {_ZONES} SELECT a.gid AS a, b.gid AS b FROM zones a JOIN zones b ON a.gid < b.gid AND abs(a.x0 - b.x0) <= {STEP} AND abs(a.y0 - b.y0) <= {STEP}",
)
def zone_adjacency(spark, d):
    """Rings that touch in a vertex, by an equi-join on snapped vertices."""
    v = zones(spark).select("gid", F.explode("ring").alias("p")).select("gid", S.snapped(F.col("p.x"), 0.01).alias("x"), S.snapped(F.col("p.y"), 0.01).alias("y")).distinct()
    a, b = v.select(F.col("gid").alias("a"), "x", "y"), v.select(F.col("gid").alias("b"), "x", "y")
    return a.join(b, ["x", "y"]).where("a < b").select("a", "b").distinct()


@query(
    "nearest_supplier",
    f"""WITH {_CUSTOMERS}, {_SUPPLIERS}, p AS (SELECT a.pid, b.qid, {_D} AS dist, rank() OVER (PARTITION BY a.pid ORDER BY {_D}) AS r FROM customers a, suppliers b)
SELECT pid, qid, round(dist, 6) AS distance FROM p WHERE r = 1""",
)
def nearest_supplier(spark, d):
    """Nearest neighbour, ties kept, over growing cells."""
    return S.nearest_join(customers(spark, d), suppliers(spark, d), 0.05).select("pid", "qid", F.round("distance", 6).alias("distance"))


@query(
    "nearest_within",
    f"""WITH {_CUSTOMERS}, {_SUPPLIERS}, p AS (SELECT a.pid, b.qid, {_D} AS dist FROM customers a JOIN suppliers b ON {_D} <= 0.03)
SELECT pid, arg_min(qid, dist) AS qid, round(min(dist), 2) AS distance, 'nearest' AS method FROM p GROUP BY 1""",
)
def nearest_within(spark, d):
    """One match within a tolerance, with its method and rounded distance."""
    p = S.radius_join(customers(spark, d), suppliers(spark, d), 0.03)
    best = p.groupBy("pid").agg(F.min(F.struct("distance", "qid")).alias("b"))
    return best.select("pid", "b.qid", F.round("b.distance", 2).alias("distance"), F.lit("nearest").alias("method"))


@query(
    "kernel_density",
    f"""WITH {_CUSTOMERS}, {_SUPPLIERS}
SELECT b.qid AS pid, round(sum(exp(-0.5 * power({_D} / 0.04, 2))), 4) AS density, count(*) AS near FROM suppliers b JOIN customers a ON {_D} <= 0.1 GROUP BY 1""",
)
def kernel_density(spark, d):
    """Gaussian kernel sums within a radius."""
    left = suppliers(spark, d).withColumnRenamed("qid", "pid")
    pairs = S.radius_join(left, customers(spark, d).withColumnRenamed("pid", "qid"), 0.1)
    return S.kernel_sum(pairs, F.lit(1.0), 0.04).select("pid", F.round("density", 4).alias("density"), "near")


@query(
    "k_nearest_suppliers",
    f"""WITH {_SUPPLIERS}, p AS (SELECT a.qid AS pid, b.qid, {_D} AS dist, row_number() OVER (PARTITION BY a.qid ORDER BY {_D}, b.qid) AS place
  FROM suppliers a JOIN suppliers b ON a.qid <> b.qid AND {_D} <= 0.2) SELECT pid, qid, CAST(place AS INT) AS place FROM p WHERE place <= 3""",
)
def k_nearest_suppliers(spark, d):
    """Three nearest others within a radius."""
    s = suppliers(spark, d)
    return S.k_nearest(s.withColumnRenamed("qid", "pid"), s, 3, 0.2).select("pid", "qid", "place")


@query(
    "nation_distances",
    f"""WITH n AS (SELECT n_nationkey AS k, {xy_sql('n_nationkey')} FROM nation)
SELECT a.k AS a, b.k AS b, round({_D}, 6) AS cost, round(exp(-power({_D} / 0.3, 2)), 4) AS weight FROM n a, n b""",
)
def nation_distances(spark, d):
    """All pairs of a small table with itself, and Gaussian weights. Nations are a dimension of fixed size."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), *xy("n_nationkey"))
    b = n.select(F.col("k").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dist = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))
    return n.crossJoin(F.broadcast(b)).select(
        F.col("k").alias("a"), "b", F.round(dist, 6).alias("cost"), F.round(F.exp(-F.pow(dist / 0.3, 2)), 4).alias("weight")
    )


_LONLAT = "c_custkey % 360 - 180.0::DOUBLE AS lon1, c_custkey % 170 - 85.0::DOUBLE AS lat1, (c_custkey * 7) % 360 - 180.0::DOUBLE AS lon2, (c_custkey * 11) % 170 - 85.0::DOUBLE AS lat2"


@query(
    "sphere_distances",
    f"""WITH p AS (SELECT c_custkey AS k, {_LONLAT} FROM customer)
SELECT k, round(2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2)))), 3) AS km,
  round(6371.0 * sqrt(power((radians(lon2) - radians(lon1)) * cos((radians(lat1) + radians(lat2)) / 2), 2) + power(radians(lat2) - radians(lat1), 2)), 3) AS flat_km FROM p""",
)
def sphere_distances(spark, d):
    """haversine and equirectangular distances."""
    k = F.col("c_custkey")
    p = [(k % 360 - 180.0), (k % 170 - 85.0), (k * 7 % 360 - 180.0), (k * 11 % 170 - 85.0)]
    return table(spark, d, "customer").select(
        k.alias("k"), F.round(S.haversine_km(*p), 3).alias("km"), F.round(S.equirectangular_km(*p), 3).alias("flat_km")
    )


@query(
    "quadkeys",
    """WITH p AS (SELECT c_custkey AS k, c_custkey % 360 - 180.0 AS lon, sin(radians(least(85.05112878, greatest(-85.05112878, c_custkey % 170 - 85.0)))) AS s FROM customer),
t AS (SELECT k, CAST(least(255, greatest(0, floor((lon + 180) / 360 * 256))) AS INT) AS x, CAST(least(255, greatest(0, floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 256))) AS INT) AS y FROM p)
SELECT k, array_to_string(list_transform(range(7, -1, -1), lambda i: CAST(((x >> CAST(i AS INT)) & 1) + 2 * ((y >> CAST(i AS INT)) & 1) AS VARCHAR)), '') AS quadkey FROM t""",
)
def quadkeys(spark, d):
    """quadkeys of level 8."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), S.quadkey(k % 360 - 180.0, k % 170 - 85.0, 8).alias("quadkey"))


@query(
    "wkt_lines",
    "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 3 END AS points, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(2 * (c_custkey % 10) + 1 AS DOUBLE) END AS length FROM customer",
)
def wkt_lines(spark, d):
    """WKT lines parsed, bad ones null, their lengths."""
    k = (F.col("c_custkey") % 10).cast("string")
    wkt = F.when(F.col("c_custkey") % 7 == 0, F.lit("LINESTRING (0 0, x 1)")).otherwise(
        F.concat(F.lit("LINESTRING (0 0, "), k, F.lit(" 0, "), k, F.lit(" "), (F.col("c_custkey") % 10 + 1).cast("string"), F.lit(")"))
    )
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), readers.wkt_points(wkt).alias("line"))
    return t.select("k", F.when(F.col("line").isNotNull(), F.size("line")).alias("points"), F.when(F.col("line").isNotNull(), S.line_length(F.col("line"))).alias("length"))


_EDGES = "edges AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7 + 3) % 100 AS b FROM supplier)"


def _supplier_edges(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7 + 3) % 100).alias("b")).distinct()


_TWO = f"{_EDGES}, ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)"


@query(
    "connected_components",
    f"""WITH RECURSIVE {_TWO}, nodes AS (SELECT a AS node FROM ways UNION SELECT s_suppkey FROM supplier),
r AS (SELECT node, node AS root FROM nodes UNION SELECT w.b, r.root FROM r JOIN ways w ON r.node = w.a)
SELECT node, min(root) AS component FROM r GROUP BY 1""",
)
def connected_components(spark, d):
    """Components named by their smallest node."""
    e = _supplier_edges(spark, d)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).union(table(spark, d, "supplier").select("s_suppkey")).distinct()
    return G.components(e, nodes)


@query(
    "k_hop_distances",
    f"""WITH RECURSIVE {_TWO}, r AS (SELECT a AS source, a AS node, 0 AS hops FROM (SELECT DISTINCT a FROM ways)
  UNION SELECT r.source, w.b, r.hops + 1 FROM r JOIN ways w ON r.node = w.a WHERE r.hops < 3)
SELECT source, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1, 2""",
)
def k_hop_distances(spark, d):
    """Breadth first search to three hops from every node."""
    e = _supplier_edges(spark, d)
    s = G.both_ways(e).select(F.col("a").alias("node")).distinct()
    return G.hops(e, s, 3)


@query(
    "shortest_paths",
    f"""WITH RECURSIVE {_EDGES}, r AS (SELECT a AS source, a AS node, 0.0::DOUBLE AS cost, 0 AS k FROM (SELECT a FROM edges UNION SELECT b FROM edges)
  UNION SELECT r.source, e.b, r.cost + (e.a + e.b) % 7 + 1, r.k + 1 FROM r JOIN edges e ON r.node = e.a WHERE r.k < 511)
SELECT source, node, min(cost) AS cost FROM r GROUP BY 1, 2""",
)
def shortest_paths(spark, d):
    """Cheapest paths between all pairs of nodes, relaxed until nothing changes (511 edges at most)."""
    e = _supplier_edges(spark, d).withColumn("cost", ((F.col("a") + F.col("b")) % 7 + 1).cast("double"))
    s = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return G.shortest_paths(e, s, 511)


@query(
    "grid_neighbours",
    "WITH g AS (SELECT i * 6 + j AS id, i, j FROM range(5) a(i), range(6) b(j)) SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1",
)
def grid_neighbours(spark, d):
    """Eight neighbours of the cells of a 5 x 6 grid."""
    return G.grid_neighbours(5, 6, spark)


@query("weighted_walks")
def weighted_walks(spark, d):
    """Weighted walks drawn by hash."""
    e = _supplier_edges(spark, d)
    both = G.both_ways(e).withColumn("weight", ((F.col("a") + F.col("b")) % 5 + 1).cast("double"))
    return G.walks(both, both.select(F.col("a").alias("node")).distinct(), 4)
