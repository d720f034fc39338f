"""Micro-fixtures for geometry, graphs, sequences, dates, readers and plan shapes."""

import math

from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions import vectors as V
from orrery.operators import graph, order, ranking, sequences, spatial, temporal
from orrery.sources import readers, sinks, tables

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
NOTCH = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]


def rings(spark):
    return spark.createDataFrame([(0, SQUARE), (1, NOTCH)], "gid long, ring array<struct<x:double,y:double>>")


def test_ring_measures(spark):
    r = F.col("ring")
    rows = rings(spark).select(spatial.ring_area(r), spatial.line_length(r), spatial.ring_centroid(r)).collect()
    assert rows[0][0] == 4 and rows[0][1] == 8 and tuple(rows[0][2]) == (1.0, 1.0)
    assert math.isclose(rows[1][0], 10.0)


def test_point_in_concave_ring(spark):
    pts = spark.createDataFrame([(1, 2.1, 2.0), (2, 0.5, 1.9), (3, 3.5, 2.0), (4, 9.0, 9.0)], "pid long, x double, y double")
    found = {(r.pid, r.gid) for r in spatial.polygon_join(pts, rings(spark), 1.0, "all").collect()}
    assert found == {(2, 0), (2, 1), (3, 1)}
    first = {(r.pid, r.gid) for r in spatial.polygon_join(pts, rings(spark), 1.0).collect()}
    assert (2, 0) in first and (2, 1) not in first


def test_nearest_keeps_ties(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "pid long, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (8, -1.0, 0.0), (9, 0.0, 3.0)], "qid long, x double, y double")
    got = {(r.pid, r.qid) for r in spatial.nearest_join(a, b, 0.5).collect()}
    assert {(1, 7), (1, 8)} <= got and len([g for g in got if g[0] == 2]) == 1
    assert spatial.nearest_join(a, b, 0.5, ties=False).count() == 2


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (7, 5)], "a long, b long")
    n = spark.createDataFrame([(i,) for i in range(1, 9)], "node long")
    c = {r.node: r.component for r in graph.components(e, n).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}
    h = {(r.source, r.node): r.hops for r in graph.hops(e, n.where("node = 1"), 1).collect()}
    assert h == {(1, 1): 0, (1, 2): 1}
    w = e.withColumn("cost", F.col("b").cast("double"))
    p = {r.node: r.cost for r in graph.shortest_paths(w, n.where("node = 1"), 5).collect()}
    assert p == {1: 0.0, 2: 2.0, 3: 5.0}


def test_intervals(spark):
    df = spark.sql("select date'2020-02-10' s, date'2020-07-01' e union all select date'2020-03-31', null union all select null, date'2020-01-01'")
    q = [r.quarter for r in temporal.expand_quarters(df, "s", "e").orderBy("s", "q_start").collect()]
    assert q == ["2020Q1", "2020Q2", "2020Q3", "2020Q1"]


def test_wildcard_dates(spark):
    df = spark.createDataFrame([("####-##-##",), ("2014-##-##",), ("2014-13-01",), ("STATIC",), ("",), (None,), ("2014-05-##",)], "t string")
    assert [r[0] for r in df.select(temporal.wildcard_month(F.col("t"))).collect()] == [-1, 24168, -1, -1, -1, -1, 24172]


def test_sessions(spark):
    rows = [(1, t, i) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 09:00:00"])]
    df = spark.createDataFrame(rows, "u long, t string, i long").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.session for r in sequences.sessions(df, "u", "t", "i", 3600).orderBy("i").collect()] == [1, 1, 1, 2]
    assert [r.session for r in sequences.capped_sessions(df, "u", "t", "i", 3600, 2).orderBy("i").collect()] == [1, 1, 2, 3]


def test_global_rank_and_split(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r.n for r in order.global_rank(df, ["k"], "n").orderBy("k").collect()] == list(range(1000))
    n = {r.part: r["count"] for r in order.chronological_split(df, ["k"], 0.7, 0.1).groupBy("part").count().collect()}
    assert n == {"train": 700, "valid": 100, "test": 200}


def test_filtered_rank_counts_ties(spark):
    s = spark.createDataFrame([(1, t, v, 2) for t, v in ((1, 0.9), (2, 0.5), (3, 0.5), (4, 0.7), (5, 0.1))], "h long, t long, s double, target long")
    known = spark.createDataFrame([(1, 4)], "h long, t long")
    assert ranking.filtered_rank(s, ["h"], "t", "s", "target", known).first().rank == 3


def test_vectors(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.0, 0.0], [0.0, 0.1, 0.3, 0.0])], "a array<double>, b array<double>")
    x, y = V.exp_map_zero(F.col("a"), 1.0), V.exp_map_zero(F.col("b"), 1.0)
    d1, d2, zero, dot = df.select(V.hyperbolic_distance(x, y, 1.0), V.hyperbolic_distance(y, x, 1.0), V.hyperbolic_distance(x, x, 1.0), V.dot(F.col("a"), F.col("b"))).first()
    assert math.isclose(d1, d2) and zero < 1e-6 and math.isclose(dot, 0.02)


def test_interval_metrics(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in M.interval_scores(F.lit(1), F.lit(4), F.lit(3), F.lit(6)).items()]).first()
    assert math.isclose(row.iou, 2 / 6) and row.precision == 0.5 and row.recall == 0.5


def test_readers_and_sinks(spark, tmp_path):
    w = spark.createDataFrame([("LINESTRING (0 0, 3 4)",), ("POINT(1 2)",), ("LINESTRING (0 0, x 4)",), ("",), (None,)], "w string")
    assert [None if r[0] is None else len(r[0]) for r in w.select(readers.wkt_points(F.col("w"))).collect()] == [2, 1, None, None, None]
    (tmp_path / "t.csv").write_text("head,relation,tail\n1,2,3\n4, 5,6\n")
    (tmp_path / "t.tsv").write_text("1\t2\t3\n4 5 6\nbad\n")
    for name in ("t.csv", "t.tsv"):
        assert {tuple(r) for r in readers.triples(spark, str(tmp_path / name)).collect()} == {("1", "2", "3"), ("4", "5", "6")}
    (tmp_path / "m.csv").write_text("﻿Entity_ID,Name\n1,a\n2, b\n1,a\n")
    assert {tuple(r) for r in readers.mapping(spark, str(tmp_path / "m.csv"), ("name",), ("entity_id", "id")).collect()} == {("a", 1), ("b", 2)}
    path = str(tmp_path / "out.parquet")
    sinks.write_safely(spark.range(3), path)
    sinks.write_safely(spark.read.parquet(path).where("id > 0"), path)
    assert tables.auto(spark, str(tmp_path / "out")).count() == 2


def test_plans_have_no_nested_loop_over_facts(spark):
    from orrery import registry
    from orrery.plans import catalog  # noqa: F401

    for name in ("interval_quarters", "kernel_density", "relation_pair_lags", "offset_samples"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_projection(spark):
    row = spark.range(1).select(*spatial.transverse_mercator(F.lit(-87.0), F.lit(0.0), -87.0), *spatial.transverse_mercator(F.lit(-87.6298), F.lit(41.8781), -87.0)).first()
    assert row[0] == 500000 and row[1] == 0
    assert abs(row[2] - 447726) < 30 and abs(row[3] - 4636393) < 300
