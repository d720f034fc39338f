"""Overlays in blocks against the expressions of ``polygons`` on odd shapes, and their SQL beyond one block."""

import pytest
from pyspark.sql import functions as F

from orrery import registry
from orrery.operators import overlays as O
from orrery.operators import polygons as P
from orrery.plans import catalog  # noqa: F401

U = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]  # hollow on one side
RINGS = {1: U, 2: [(1.2, 1.5), (1.8, 1.5), (1.5, 2.5), (1.2, 1.5)], 3: [(3.0, 1.0), (4.0, 1.0), (4.0, 2.0), (3.0, 2.0), (3.0, 1.0)], 4: [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)], 5: [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]}
LINES = {1: [(-1.0, 2.0), (5.0, 2.0)], 2: [(0.0, 0.0), (3.0, 0.0)], 3: [(1.5, 2.9), (1.5, 1.2)], 4: [(-1.0, -1.0), (4.0, 4.0)], 5: [(0.5, 0.5), (2.5, 0.5), (2.5, 2.5)], 6: [(3.0, 3.0), (3.0, 4.0)], 7: [(9.0, 9.0), (9.5, 9.5)], 8: [(0.5, 0.5), (0.5, 0.5)]}


def shapes(spark, rows, key, name):
    return spark.createDataFrame(list(rows.items()), f"{key} long, {name} array<struct<x:double,y:double>>")


@pytest.mark.parametrize("block", [4096, 2])
def test_blocks_follow_the_rules_of_polygons(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    lines, rings = shapes(spark, LINES, "line", "path"), shapes(spark, RINGS, "gid", "ring")
    every = lines.crossJoin(rings).select("line", "gid", P.length_in_ring(F.col("path"), F.col("ring")).alias("n"), P.line_meets_ring(F.col("path"), F.col("ring")).alias("m")).collect()
    args = (lines, "line", "path", rings, "gid", "ring", 0.7)

    def pairs(left, right, found):
        for i, j, v in found:
            yield {"line": left[i], "gid": right[j], "v": v.astype(float)}

    schema = "line long, gid long, v double"
    got = {(r.line, r.gid): r.v for r in O.met(*args, O.lengths_in_rings, pairs, schema).collect()}
    for r in every:
        assert abs(got.get((r.line, r.gid), 0.0) - r.n) < 1e-9, r
    got = [tuple(r) for r in O.met(*args, O.lines_meet_rings, pairs, schema).where("v > 0").select("line", "gid").collect()]
    assert sorted(got) == sorted((r.line, r.gid) for r in every if r.m)
    two = rings.select(F.col("gid").alias("b"), F.col("ring").alias("two"))
    want = rings.crossJoin(two).where("gid <> b").where(P.rings_meet(F.col("ring"), F.col("two"))).select("gid", "b").collect()
    got = O.met(rings, "gid", "ring", two, "b", "two", 0.7, O.rings_meet, O.both_ways, "a long, b long", ordered=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["meeting_rings", "meeting_lines", "best_covering_ring", "overlay_lengths"])
def test_no_pair_of_shapes_is_shuffled(spark, name):
    text = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "diamond" not in text.split("MapInArrow")[0]
