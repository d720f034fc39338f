"""Operators on small fixtures against brute force, round trips and broken input."""

import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, polygons, ranking, sequences, spatial
from orrery.sources import layers, readers, shared, sinks


def points(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, x double, y double")


# --- nearest neighbours ------------------------------------------------------


def test_nearest_join_sets_unusable_points_aside_and_ends(spark):
    rng = random.Random(1)
    left = [(i, rng.random(), rng.random()) for i in range(60)] + [(100, None, 0.5), (101, 0.2, float("nan")), (102, float("inf"), 0.0), (103, 900.0, -4000.0)]
    right = [(i, rng.random() ** 3, rng.random() ** 3) for i in range(80)] + [(200, None, None), (201, 0.25, 0.25), (202, 0.25, 0.25)]
    left.append((104, 0.25, 0.25))
    got = {}
    for r in spatial.nearest_join(points(spark, left, "pid"), points(spark, right, "qid"), 0.02).collect():
        got.setdefault(r.pid, []).append(r.qid)
    usable = [r for r in right if r[1] is not None]
    for k, x, y in left:
        if x is None or not math.isfinite(x) or not math.isfinite(y):
            assert k not in got
            continue
        gaps = {q: math.sqrt((x - a) ** 2 + (y - b) ** 2) for q, a, b in usable}
        assert sorted(got[k]) == sorted(q for q, g in gaps.items() if g == min(gaps.values())), k
    assert spatial.nearest_join(points(spark, left, "pid"), points(spark, right, "qid").where("false"), 0.02).count() == 0
    assert spatial.nearest_join(points(spark, left, "pid").where("false"), points(spark, right, "qid"), 0.02).count() == 0


# --- polygons ----------------------------------------------------------------

RING = "id long, ring array<struct<x: double, y: double>>"


def closed(*corners):
    return [(float(x), float(y)) for x, y in (*corners, corners[0])]


def grid_area(one, two, n=400):
    """Shared area by counting fine cells."""

    def inside(x, y, ring):
        hit = np.zeros(x.shape, bool)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            cross = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit ^= cross & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return hit

    at = (np.arange(n) + 0.5) / n * 10
    x, y = np.meshgrid(at, at)
    return (inside(x, y, one) & inside(x, y, two)).mean() * 100


def test_overlap_of_rings_of_any_shape(spark):
    rings = [
        closed((1, 1), (9, 2), (8, 8), (5, 3), (2, 9)),  # concave
        closed((2, 2), (2, 7), (7, 7), (7, 2)),  # the other way round
        closed((0, 0), (10, 0), (5, 9.5)),
        closed((2, 2), (7, 2), (7, 4), (4, 4), (4, 7), (2, 7)),  # shares edges with the second
        closed((9.2, 9.2), (9.9, 9.2), (9.9, 9.9)),
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], RING)
    pairs = df.crossJoin(df.select(F.col("id").alias("other"), F.col("ring").alias("two")))
    got = pairs.select("id", "other", polygons.overlap_area(F.col("ring"), F.col("two")).alias("a"), polygons.rings_meet(F.col("ring"), F.col("two")).alias("m"))
    for r in got.collect():
        want = grid_area(rings[r.id], rings[r.other])
        assert abs(r.a - want) < 0.15, (r.id, r.other, r.a, want)
        if want > 0.2:
            assert r.m
        if 4 in (r.id, r.other) and r.id != r.other:
            assert not r.m and r.a == 0


def test_lines_in_and_on_rings(spark):
    ring = closed((0, 0), (4, 0), (4, 4), (2, 2), (0, 4))
    lines = {0: [(-1, 1), (5, 1)], 1: [(0, 3), (4, 3)], 2: [(0, 0), (4, 0)], 3: [(5, 5), (6, 6)], 4: [(1, 1), (2, 1)], 5: [(4, 0), (9, 0)], 6: [(-1, -1), (0, 0), (2, 2), (2, 9)]}
    want = {0: 4.0, 1: 2.0, 2: 4.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 2 * math.sqrt(2)}
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in v]) for i, v in lines.items()], RING)
    area = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    got = {r.id: (r.n, r.m) for r in df.select("id", polygons.length_in_ring(F.col("ring"), area).alias("n"), polygons.line_meets_ring(F.col("ring"), area).alias("m")).collect()}
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert {k for k, v in got.items() if not v[1]} == {3}


# --- layers ------------------------------------------------------------------


def test_packages_and_shapefiles(spark, tmp_path):
    base = sqlite3.connect(":memory:")
    base.executescript(
        "CREATE TABLE gpkg_contents (table_name TEXT, srs_id INTEGER); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT);"
        "CREATE TABLE a (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT); CREATE TABLE b (fid INTEGER PRIMARY KEY, g BLOB);"
        "INSERT INTO gpkg_contents VALUES ('a', 4326), ('b', 2263); INSERT INTO gpkg_geometry_columns VALUES ('a', 'geom'), ('b', 'g')"
    )
    head = b"GP\0\1" + struct.pack("<i", 4326)
    square = struct.pack("<BII", 1, 3, 1) + struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    enveloped = b"GP\0\3" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + struct.pack("<BI2d", 1, 1, 2.5, 3)
    base.execute("INSERT INTO a VALUES (1, ?, 'x')", (head + square,))
    base.execute("INSERT INTO a VALUES (2, ?, NULL)", (enveloped,))
    base.execute("INSERT INTO a VALUES (3, NULL, 'none')")
    base.execute("INSERT INTO b VALUES (7, ?)", (head + struct.pack(">BII", 0, 2, 2) + struct.pack(">4d", 0, 1, 2, 3),))
    base.commit()
    (tmp_path / "f.gpkg").write_bytes(base.serialize())
    got = {(r.layer, r.fid): (r.wkt, r.properties, r.srs) for r in layers.read_packages(layers.files(spark, f"file://{tmp_path}/f.gpkg")).collect()}
    assert got == {
        ("a", 1): ("POLYGON ((0 0, 1 0, 1 1, 0 0))", '{"fid": 1, "name": "x"}', 4326),
        ("a", 2): ("POINT (2.5 3)", '{"fid": 2, "name": null}', 4326),
        ("a", 3): (None, '{"fid": 3, "name": "none"}', 4326),
        ("b", 7): ("LINESTRING (0 1, 2 3)", '{"fid": 7}', 2263),
    }
    assert layers.read_packages(layers.files(spark, f"file://{tmp_path}/f.gpkg"), "b").count() == 1
    body = struct.pack("<i2d", 1, 4.0, 5.5)
    line = struct.pack("<i4d3i", 3, 0, 0, 1, 1, 1, 2, 0) + struct.pack("<4d", 0, 0, 1, 1)
    shp = b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate((body, line)))
    (tmp_path / "s.shp").write_bytes(shp)
    field = b"NAME\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14 + b"N\0\0\0\0\0\0\0\0\0\0N" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    dbf = struct.pack("<4BIHH", 3, 0, 0, 0, 2, 32 + 64 + 1, 10) + b"\0" * 20 + field + b"\r" + b" one    12" + b" two      "
    (tmp_path / "s.dbf").write_bytes(dbf)
    got = [(r.fid, r.wkt, r.properties) for r in layers.read_shapefiles(layers.files(spark, f"file://{tmp_path}/s.shp", f"file://{tmp_path}/s.dbf")).orderBy("fid").collect()]
    assert got == [(0, "POINT (4 5.5)", '{"N": 12, "NAME": "one"}'), (1, "LINESTRING (0 0, 1 1)", '{"N": null, "NAME": "two"}')]


# --- files -------------------------------------------------------------------


def test_triples_by_name_and_by_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿tail,note,head,relation\nt1,n,head,r1\nt2,n,h2,r2\n")
    (tmp_path / "b.tsv").write_text("h1\tr1\tt1\nshort\trow\nhead\trelation2\ttail2\n")
    (tmp_path / "c.csv").write_text("h1, r1,t1,extra\n")
    read = lambda n: sorted(tuple(r) for r in readers.triples(spark, f"file://{tmp_path}/{n}").collect())
    assert read("a.csv") == [("h2", "r2", "t2"), ("head", "r1", "t1")]
    assert read("b.tsv") == [("h1", "r1", "t1"), ("head", "relation2", "tail2")]
    assert read("c.csv") == [("h1", "r1", "t1")]


def test_a_failed_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t.parquet"
    sinks.write_safely(spark.range(3), path)
    sinks.write_safely(spark.read.parquet(path).unionByName(spark.range(5)), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 8
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    with pytest.raises(Exception):
        sinks.write_safely(spark.range(2).select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert spark.read.parquet(path).count() == 8


def test_table_falls_back_to_the_next_format(spark, tmp_path):
    df = spark.range(3).withColumn("more", F.lit("x"))  # text files hold one column
    path = sinks.write_table(df, f"file://{tmp_path}/t", ("text", "csv"))
    assert path.endswith(".csv") and spark.read.option("header", True).csv(path).count() == 3


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


# --- graphs ------------------------------------------------------------------


def test_faces_with_dead_ends_and_several_parts(spark):
    at = {0: (0, 0), 1: (2, 0), 2: (2, 2), 3: (0, 2), 4: (4, 0), 5: (4, 2), 6: (5, 5), 7: (1, 1), 8: (10, 10), 9: (11, 10), 10: (10, 11)}
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5), (5, 2), (5, 6), (2, 7), (8, 9), (9, 10), (10, 8)]
    rows = [(a, b, *map(float, at[a]), *map(float, at[b])) for a, b in edges]
    df = spark.createDataFrame(rows, "a long, b long, ax double, ay double, bx double, by double")
    got = sorted((round(r.area, 6), r.sides) for r in graph.faces(df).collect())
    assert got == [(0.5, 3), (4.0, 4), (4.0, 6)]  # a dead end inside is walked back and forth


def test_routes_against_all_paths(spark):
    rng = random.Random(2)
    edges = [(a, b, float(rng.randint(1, 4))) for a in range(7) for b in range(7) if a != b and rng.random() < 0.4]
    pairs = [(a, b) for a in range(7) for b in range(7) if a != b]
    got = {(r.source, r.target): (r.cost, tuple(r.path)) for r in graph.routes(spark.createDataFrame(edges, "a long, b long, cost double"), spark.createDataFrame(pairs, "source long, target long"), 20).collect()}
    cost = {(a, b): c for a, b, c in edges}

    def ways(at, target, seen, total, path):
        if at == target:
            yield total, path
            return
        for (a, b), c in cost.items():
            if a == at and b not in seen:
                yield from ways(b, target, seen | {b}, total + c, (*path, b))

    want = {(a, b): min(found) for a, b in pairs if (found := list(ways(a, b, {a}, 0.0, ())))}
    assert got == want


def test_sampled_edges_fall_where_weights_say(spark):
    edges = spark.createDataFrame([(i, i + 1, 1 + i % 7) for i in range(50)], "a long, b long, weight long")
    total = sum(1 + i % 7 for i in range(50))
    draws = spark.range(total).select(F.col("id").alias("draw"), F.col("id").alias("h"))
    got = {r.a: r["count"] for r in graph.sampled_edges(edges, draws).groupBy("a").count().collect()}
    assert got == {i: 1 + i % 7 for i in range(50)}
    assert graph.sampled_edges(edges.where("false"), draws).count() == 0


def test_singular_graph_of_few_directions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 6))
    rows = [(t, n, float(x[t, n])) for t in range(20) for n in range(6)]
    got = {(r.i, r.j): r.weight for r in graph.singular_graph(spark.createDataFrame(rows, "time long, node long, value double"), 3).collect()}
    _, s, v = np.linalg.svd(x)
    w = (np.diag(s[:3]) @ v[:3]).T
    d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))
    want = np.exp(-d / d.std() ** 2)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(6) for j in range(6))


# --- sequences ---------------------------------------------------------------


def test_shapes_are_found_whatever_their_shift(spark):
    rng = np.random.default_rng(4)
    m, rows = 24, []
    for i in range(60):
        base = np.zeros(m)
        if i % 2:
            base[8:11] = 5  # a bump
        else:
            base[6:9], base[13:16] = 4, 4  # two bumps
        rows.append((i, (np.roll(base, rng.integers(-3, 4)) * (1 + i % 3) + rng.normal(size=m) * 0.1).tolist()))
    df = spark.createDataFrame(rows, "k long, x array<double>")
    got = {r.k: r.cluster for r in sequences.shape_clusters(df, "k", "x", 2, seed=1).collect()}
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and len({got[i] for i in range(1, 60, 2)}) == 1 and got[0] != got[1]
    assert sequences.shape_clusters(df.where("false"), "k", "x", 2).count() == 0


def test_common_route_is_longest():
    rng = random.Random(5)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        same = sequences.common_route(np.array(a), np.array(b))
        assert len(same) == brute(a, b)
        for route in (a, b):
            at = iter(route)
            assert all(x in at for x in same)


# --- matrices ----------------------------------------------------------------


def test_principal_axes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5)) @ np.diag([5, 3, 2, 0.5, 0.1])
    mean, axes = ranking.principal_axes(spark.createDataFrame([(r.tolist(),) for r in x], "e array<double>"), "e", 3)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0))
    for k in range(3):
        assert abs(abs(axes[k] @ vectors[:, -1 - k]) - 1) < 1e-9 and axes[k][np.abs(axes[k]).argmax()] > 0


def test_counts_above_a_goal_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    asked = [(i, rng.randint(0, 50), rng.randint(0, 30)) for i in range(40)]
    df = spark.createDataFrame(asked, "k long, own long, goal long")
    c = spark.range(31).select(F.col("id").alias("t"))
    got = {r.k: r.above for r in ranking.counted_above(df, ["k"], "goal", c, "t", lambda q, t: (q["k"] * 7 + t * 3) % 31, F.col("own")).collect()}
    assert got == {k: sum((k * 7 + t * 3) % 31 >= goal and t != own for t in range(31)) for k, own, goal in asked}
