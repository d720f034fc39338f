"""Queries: files written by the sinks and read back by the loaders."""

from __future__ import annotations

import sqlite3
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from orrery.operators import order as O
from orrery.operators import spatial as S
from orrery.plans.bridge import events
from orrery.registry import query
from orrery.sources import layers, readers, sinks
from orrery.sources.shared import shared_dir
from orrery.sources.tables import table


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(spark, df, name: str, schema: str):
    """Written with a header and read back with a schema."""
    path = _path(spark, name)
    df.write.option("header", True).csv(path)
    return spark.read.schema(schema).option("header", True).csv(path)


_FACT_ROWS = "SELECT 'customer::' || c_custkey AS head, 'CIN' AS relation, 'nation::' || c_nationkey AS tail FROM customer"


@query("triples_by_header", f"WITH t AS ({_FACT_ROWS}) SELECT kind, head, relation, tail FROM t, (VALUES ('named'), ('tabs')) k(kind)")
def triples_by_header(spark, d):
    """Triples from CSV by header name, in another order, and from lines split by tabs."""
    c = table(spark, d, "customer")
    t = c.select(F.concat(F.lit("customer::"), "c_custkey").alias("head"), F.lit("CIN").alias("relation"), F.concat(F.lit("nation::"), "c_nationkey").alias("tail"))
    named, tabs = _path(spark, "triples"), _path(spark, "triples")
    t.select("tail", "head", "relation").write.option("header", True).csv(named)
    t.select(F.concat_ws("\t", "head", "relation", "tail")).write.text(tabs)
    read = lambda path, kind: readers.triples(spark, path).select(F.lit(kind).alias("kind"), "head", "relation", "tail")
    return read(named, "named").unionByName(read(tabs, "tabs"))


@query("mapped_order", "SELECT n_name AS name, n_nationkey AS place, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 3 + 1 END AS id FROM nation")
def mapped_order(spark, d):
    """A dictionary whose columns stand the other way round, behind a byte order mark; a list in its own order
    gets the mapped ids, blank where there is none."""
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("k"))
    path = _path(spark, "mapping")
    known = n.where("k % 4 <> 0").select((F.col("k") * 3 + 1).alias("﻿entity_id"), F.col("n_name").alias("Entity"))
    known.write.option("header", True).csv(path)
    ids = readers.mapping(spark, path, ("entity",), ("entity_id",))
    listed = n.select(F.col("n_name").alias("name"), F.col("k").alias("place"))
    return listed.join(ids, "name", "left").select("name", "place", "id")


@query(
    "dyna_table",
    """WITH g AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS flow FROM events GROUP BY 1, 2)
SELECT dense_rank() OVER (ORDER BY day) - 1 AS step, dense_rank() OVER (ORDER BY user_id) - 1 AS node, flow FROM g""",
)
def dyna_table(spark, d):
    """A dynamics file written and read into indices of time and entity."""
    g = events(spark, d).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("flow"))
    rows = sinks.dyna_rows(g, "day", "user_id", ["flow"])
    return readers.dyna(_csv(spark, rows, "dyna", "dyna_id long, type string, time string, entity_id long, flow long"), ["flow"])


@query(
    "grid_table",
    """WITH g AS (SELECT CAST(ts AS DATE) AS day, user_id // 15 AS row_id, user_id % 15 AS column_id, count(*) AS flow FROM events GROUP BY 1, 2, 3)
SELECT dense_rank() OVER (ORDER BY day) - 1 AS step, row_id, column_id, row_id * 15 + column_id AS node, flow FROM g""",
)
def grid_table(spark, d):
    """A grid file read by time, row and column."""
    u = F.col("user_id")
    g = events(spark, d).groupBy(F.to_date("ts").cast("string").alias("time"), F.floor(u / 15).alias("row_id"), (u % 15).alias("column_id"))
    rows = g.agg(F.count(F.lit(1)).alias("flow"))
    return readers.grid(_csv(spark, rows, "grid", "time string, row_id long, column_id long, flow long"), ["flow"], 15)


_OD = """od AS (SELECT strftime(o_orderdate, '%Y-%m') AS time, o_custkey % 25 AS o, o_orderkey % 25 AS d, count(*) AS flow FROM orders GROUP BY 1, 2, 3)"""


def _od(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("time"), (F.col("o_custkey") % 25).alias("o"), (F.col("o_orderkey") % 25).alias("d"))
    return g.agg(F.count(F.lit(1)).alias("flow"))


@query(
    "od_table",
    f"""WITH {_OD}, ids AS (SELECT o AS id FROM od UNION SELECT d FROM od), i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM ids)
SELECT dense_rank() OVER (ORDER BY time) - 1 AS step, a.at AS origin, b.at AS destination, flow FROM od JOIN i a ON a.id = o JOIN i b ON b.id = d""",
)
def od_table(spark, d):
    """Flows between origins and destinations, keyed by one index."""
    rows = _od(spark, d).select("time", F.col("o").alias("origin_id"), F.col("d").alias("destination_id"), "flow")
    return readers.origin_destination(_csv(spark, rows, "od", "time string, origin_id long, destination_id long, flow long"), ["flow"])


@query("gridod_table", f"WITH {_OD} SELECT dense_rank() OVER (ORDER BY time) - 1 AS step, o AS origin, d AS destination, flow FROM od")
def gridod_table(spark, d):
    """Flows between cells of a grid, keyed by rows and columns."""
    side = lambda c, n: [F.floor(F.col(c) / 5).alias(f"{n}_row_id"), (F.col(c) % 5).alias(f"{n}_column_id")]
    rows = _od(spark, d).select("time", *side("o", "origin"), *side("d", "destination"), "flow")
    schema = "time string, origin_row_id long, origin_column_id long, destination_row_id long, destination_column_id long, flow long"
    return readers.grid_origin_destination(_csv(spark, rows, "gridod", schema), ["flow"], 5)


@query(
    "trajectory_points",
    """SELECT user_id, CAST(ts AS DATE) AS day, list(s ORDER BY t, event_id) AS seconds, list(event_id ORDER BY t, event_id) AS events FROM (
  SELECT user_id, ts, event_id, epoch(date_trunc('second', ts)) AS t, CAST((epoch(date_trunc('second', ts)) - min(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id, CAST(ts AS DATE))) % 86400 AS BIGINT) AS s FROM events) GROUP BY 1, 2""",
)
def trajectory_points(spark, d):
    """Points of each user's day in order, with the seconds since the first."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    t = readers.trajectories(e, ["user_id", "day"], "ts", ["event_id"])
    return t.select("user_id", "day", F.col("points.seconds").alias("seconds"), F.col("points.event_id").alias("events"))


@query(
    "table_formats",
    "SELECT kind, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, max(n_name) AS last_name FROM nation, (VALUES ('csv'), ('tsv'), ('json'), ('parquet')) f(kind) GROUP BY 1",
)
def table_formats(spark, d):
    """One table in four formats, swapped into place, read back."""
    n, schema, out = table(spark, d, "nation"), "n_nationkey int, n_name string, n_regionkey int", None
    for kind in ("csv", "tsv", "json", "parquet"):
        path = f"{_path(spark, 'nation')}.{kind}"
        if kind == "tsv":
            n.write.option("header", True).option("sep", "\t").csv(path)
            back = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
        else:
            path = sinks.write_table(n, path.removesuffix(f".{kind}"), (kind, "csv") if kind != "csv" else ("csv",))
            back = spark.read.schema(schema).option("header", True).format(kind).load(path)
        row = back.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("keys"), F.max("n_name").alias("last_name"))
        row = row.select("kind", "n", "keys", "last_name")
        out = row if out is None else out.unionByName(row)
    return out


@query("appended_chunks", "SELECT c_mktsegment AS segment, count(*) AS n, 3 AS chunks FROM customer GROUP BY 1")
def appended_chunks(spark, d):
    """A table processed and appended in three chunks, every file with its header; one row out for each row in."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    path = _path(spark, "chunks")
    n = sinks.append_chunks((c.where(F.pmod(F.xxhash64("c_custkey"), F.lit(3)) == i) for i in range(3)), path)
    back = spark.read.schema("c_custkey long, c_mktsegment string").option("header", True).csv(path)
    return back.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.lit(n).alias("chunks"))


@query(
    "metric_files",
    """WITH p AS (SELECT o_orderkey % 4 AS horizon, o_totalprice / 1000.0 AS y, o_totalprice / 1000.0 * (0.9 + (o_orderkey % 7) * 0.03) AS f FROM orders),
m AS (SELECT horizon, round(avg(abs(f - y)), 4) AS mae, round(sqrt(avg(power(f - y, 2))), 4) AS rmse FROM p GROUP BY 1)
SELECT kind, horizon, mae, rmse FROM m, (VALUES ('csv'), ('json')) k(kind)""",
)
def metric_files(spark, d):
    """Metrics per horizon saved as CSV and JSON and read back."""
    y = F.col("o_totalprice") / 1000.0
    gap = y * (0.9 + (F.col("o_orderkey") % 7) * 0.03) - y
    m = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 4).alias("horizon"))
    m = m.agg(F.round(F.avg(F.abs(gap)), 4).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 4).alias("rmse"))
    out = None
    for kind in ("csv", "json"):
        path = sinks.write_metrics(m, _path(spark, "metrics"), kind)
        back = spark.read.schema("horizon long, mae double, rmse double").option("header", True).format(kind).load(path)
        back = back.select(F.lit(kind).alias("kind"), "horizon", "mae", "rmse")
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "geo_and_rel_files",
    """SELECT 'geo' AS file, n_nationkey AS id, 'Point' AS type, '[' || n_nationkey || ',' || n_regionkey || ']' AS value FROM nation
UNION ALL SELECT 'rel', row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey) - 1, 'geo', a.n_nationkey || '>' || b.n_nationkey || '=' || abs(a.n_nationkey - b.n_nationkey) FROM nation a, nation b""",
)
def geo_and_rel_files(spark, d):
    """Nodes and the full relation between them as atomic files."""
    n = table(spark, d, "nation")
    geo = sinks.geo_rows(n, "n_nationkey", "n_nationkey", "n_regionkey")
    a = n.select(F.col("n_nationkey").alias("a"))
    pairs = a.crossJoin(n.select(F.col("n_nationkey").alias("b"))).withColumn("cost", F.abs(F.col("a") - F.col("b")))  # the relation of a fixed dimension
    rel = sinks.rel_rows(pairs, "a", "b", "cost")
    geo = _csv(spark, geo, "geo", "geo_id long, type string, coordinates string").select(F.lit("geo").alias("file"), F.col("geo_id").alias("id"), "type", F.col("coordinates").alias("value"))
    rel = _csv(spark, rel, "rel", "rel_id long, type string, origin_id long, destination_id long, cost long")
    value = F.concat("origin_id", F.lit(">"), "destination_id", F.lit("="), "cost")
    return geo.unionByName(rel.select(F.lit("rel").alias("file"), F.col("rel_id").alias("id"), "type", value.alias("value")))


@query(
    "geojson_shapes",
    """WITH t AS (SELECT user_id, list('[' || (event_id % 100) || ',' || (event_id % 77) || ']' ORDER BY ts, event_id) AS p, count(*) AS n FROM events GROUP BY 1)
SELECT 'trajectory' AS kind, user_id AS id, '{"type":"Feature","properties":{"n":' || n || '},"geometry":{"type":"LineString","coordinates":[' || array_to_string(p, ',') || ']}}' AS feature FROM t
UNION ALL SELECT 'grid', n_nationkey, '{"type":"Feature","properties":{"n":' || n_regionkey || '},"geometry":{"type":"Polygon","coordinates":[[' || '[' || c || ',' || r || '],[' || (c + 1) || ',' || r || '],[' || (c + 1) || ',' || (r + 1) || '],[' || c || ',' || (r + 1) || '],[' || c || ',' || r || ']]]}}'
  FROM (SELECT n_nationkey, n_regionkey, n_nationkey % 5 AS c, n_nationkey // 5 AS r FROM nation)""",
)
def geojson_shapes(spark, d):
    """Trajectories as lines and grid cells as polygons in GeoJSON."""
    e = events(spark, d)
    p = F.struct("ts", "event_id", F.array(F.col("event_id") % 100, F.col("event_id") % 77).alias("at"))
    t = e.groupBy("user_id").agg(F.array_sort(F.collect_list(p)).alias("p"), F.count(F.lit(1)).alias("n"))
    t = t.select(F.lit("trajectory").alias("kind"), F.col("user_id").alias("id"), sinks.feature(["n"], "LineString", F.col("p.at")).alias("feature"))
    k = F.col("n_nationkey").cast("long")
    c, r = k % 5, F.floor(k / 5)
    ring = F.array(*[F.array(c + i, r + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    g = table(spark, d, "nation").select(k.alias("id"), F.col("n_regionkey").alias("n"), F.array(ring).alias("ring"))
    return t.unionByName(g.select(F.lit("grid").alias("kind"), "id", sinks.feature(["n"], "Polygon", F.col("ring")).alias("feature")))


@query(
    "layer_scan",
    """SELECT 'nations' AS layer, n_nationkey AS fid, n_name AS name, round(-88.0 + n_nationkey / 50.0, 6) AS lon, round(41.0 + n_regionkey / 10.0, 6) AS lat, n_nationkey % 2 = 0 AS moved FROM nation""",
)
def layer_scan(spark, d):
    """Points of a GeoPackage layer; those in degrees are projected and brought back, others stay as they are."""

    def package(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            base = sqlite3.connect(":memory:")
            base.execute("CREATE TABLE gpkg_contents (table_name TEXT, srs_id INTEGER)")
            base.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
            base.execute("CREATE TABLE nations (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
            base.execute("INSERT INTO gpkg_contents VALUES ('nations', 4326)")
            base.execute("INSERT INTO gpkg_geometry_columns VALUES ('nations', 'geom')")
            for k, name, x, y in rows.itertuples(index=False):
                geometry = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, x, y)
                base.execute("INSERT INTO nations VALUES (?, ?, ?)", (int(k), geometry, name))
            base.commit()
            yield pd.DataFrame({"path": ["nations.gpkg"], "content": [base.serialize()]})
            base.close()

    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    n = table(spark, d, "nation").select(k, "n_name", (-88.0 + k / 50.0).alias("x"), (41.0 + region / 10.0).alias("y")).coalesce(1)  # 25 rows, one file
    found = layers.read_packages(n.mapInPandas(package, "path string, content binary"), "nations")
    at = readers.wkt_points(F.col("wkt"))
    odd = F.col("fid") % 2
    there = layers.projected(at, F.when(odd == 0, F.col("srs")).otherwise(26916), 4326, lambda x, y: S.transverse_mercator(x, y, -87.0))
    found = found.select("layer", "fid", "properties", at.alias("at"), there.alias("there"))
    back = S.inverse_mercator(F.get("there", 0)["x"], F.get("there", 0)["y"], -87.0)
    moved = F.get("there", 0)["x"] > 1000
    pick = lambda i, c: F.round(F.when(moved, back[i]).otherwise(F.get("at", 0)[c]), 6)
    return found.select("layer", "fid", F.get_json_object("properties", "$.name").alias("name"), pick(0, "x").alias("lon"), pick(1, "y").alias("lat"), moved.alias("moved"))


_TAGS = "(VALUES ('food', 'SMALL'), ('food', 'LARGE'), ('shop', 'LARGE'), ('shop', 'MEDIUM'), ('work', 'PROMO'), ('work', 'SMALL'), ('home', 'ECONOMY')) t(category, tag)"


@query(
    "tag_categories",
    f"SELECT coalesce(category, 'other') AS category, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM part LEFT JOIN {_TAGS} ON tag = split_part(p_type, ' ', 1) GROUP BY 1",
)
def tag_categories(spark, d):
    """A dictionary in which a tag may stand in several lists: a row for each of its categories."""
    pairs = [("food", ["SMALL", "LARGE"]), ("shop", ["LARGE", "MEDIUM"]), ("work", ["PROMO", "SMALL"]), ("home", ["ECONOMY"])]
    words = spark.createDataFrame(pairs, "category string, tags array<string>").select("category", F.explode("tags").alias("tag"))
    p = table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("tag"))
    j = p.join(F.broadcast(words), "tag", "left")
    return j.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("parts"))


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def first_rows(spark, d):
    """The first rows in a fixed order, for looking at: a top-k, no sort of the whole table."""
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query(
    "quarter_layers",
    "SELECT quarter(o_orderdate) AS q, year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1996 AND quarter(o_orderdate) IN (2, 3) GROUP BY 1, 2",
)
def quarter_layers(spark, d):
    """Layers by quarter as partitions, of which a range is read."""
    path = _path(spark, "quarters")
    o = table(spark, d, "orders").select("o_totalprice", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    o.repartition("y", "q").write.partitionBy("y", "q").parquet(path)
    back = spark.read.parquet(path).where("y = 1996 and q between 2 and 3")
    return back.groupBy(F.col("q").cast("long").alias("q"), F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_REL = "rel AS (SELECT s_suppkey AS rel_id, s_suppkey % 25 AS o, (s_suppkey * 7 + 3) % 25 AS d, CAST(s_suppkey % 11 + 1 AS DOUBLE) AS cost FROM supplier)"


@query(
    "adjacency_matrix",
    f"""WITH {_REL}, ways AS (SELECT rel_id, o, d, cost FROM rel UNION ALL SELECT rel_id, d, o, cost FROM rel), last AS (SELECT o, d, max(rel_id * 100 + cost) % 100 AS cost FROM ways GROUP BY 1, 2)
SELECT a.n_nationkey AS i, b.n_nationkey AS j, coalesce(cost, -1) AS cost, CAST(cost IS NOT NULL AS INT) AS link FROM nation a CROSS JOIN nation b LEFT JOIN last ON o = a.n_nationkey AND d = b.n_nationkey""",
)
def adjacency_matrix(spark, d):
    """A dense matrix of costs from a relation file, both ways, the last of repeated edges kept."""
    k = F.col("s_suppkey")
    rel = table(spark, d, "supplier").select(k.alias("rel_id"), (k % 25).alias("origin_id"), ((k * 7 + 3) % 25).alias("destination_id"), (k % 11 + 1).cast("double").alias("cost"))
    nodes = O.dense_index(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), "id", "node")
    return readers.adjacency(rel, nodes, -1.0, both=True)


@query(
    "matrix_edges",
    f"WITH {_REL}, last AS (SELECT DISTINCT o, d FROM rel) SELECT row_number() OVER (ORDER BY o, d) - 1 AS edge, o AS i, d AS j FROM last",
)
def matrix_edges(spark, d):
    """The list of edges in a matrix of zeros and ones, in row order."""
    k = F.col("s_suppkey")
    rel = table(spark, d, "supplier").select(k.alias("rel_id"), (k % 25).alias("origin_id"), ((k * 7 + 3) % 25).alias("destination_id"), F.lit(1.0).alias("cost"))
    nodes = O.dense_index(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), "id", "node")
    matrix = readers.adjacency(rel, nodes, 0.0).select("i", "j", F.col("cost").alias("w"))
    return O.global_rank(matrix.where("w = 1").select("i", "j"), ["i", "j"], "edge").select("edge", "i", "j")
