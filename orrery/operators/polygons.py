"""Overlays of rings and lines of any shape (J6, J15 to J19, A11). Rings are closed array<struct<x,y>> without self-crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import let, total
from orrery.operators.spatial import _edges, cell, in_ring

#: Room for rounding where points meet a border.
EPS = 1e-12


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _side(a: Column, b: Column, p: Column) -> Column:
    """On which side of the line a-b the point p lies: -1, 0 (on it) or 1."""
    k = _cross(b["x"] - a["x"], b["y"] - a["y"], p["x"] - a["x"], p["y"] - a["y"])
    return F.when(F.abs(k) <= EPS, F.lit(0)).otherwise(F.signum(k).cast("int"))


def _within_box(a: Column, b: Column, p: Column) -> Column:
    return p["x"].between(F.least(a["x"], b["x"]) - EPS, F.greatest(a["x"], b["x"]) + EPS) & p["y"].between(
        F.least(a["y"], b["y"]) - EPS, F.greatest(a["y"], b["y"]) + EPS
    )


def segments_meet(e: Column, f: Column) -> Column:
    """Whether two segments (a, b) share a point, ends included."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    p, q, r, s = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    apart = (p * q < 0) & (r * s < 0)
    touch = ((p == 0) & _within_box(a, b, c)) | ((q == 0) & _within_box(a, b, d)) | ((r == 0) & _within_box(c, d, a)) | ((s == 0) & _within_box(c, d, b))
    return apart | touch


def on_border(x: Column, y: Column, ring: Column) -> Column:
    p = F.struct(x.alias("x"), y.alias("y"))
    return F.exists(_edges(ring), lambda e: (_side(e["a"], e["b"], p) == 0) & _within_box(e["a"], e["b"], p))


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether a line shares a point with an area, its border included."""
    start = F.get(line, 0)
    crossing = F.exists(_edges(line), lambda e: F.exists(_edges(ring), lambda f: segments_meet(e, f)))
    return crossing | in_ring(start["x"], start["y"], ring)


def rings_meet(one: Column, two: Column) -> Column:
    """Whether two areas share a point: borders that meet, or one inside the other."""
    return line_meets_ring(one, two) | in_ring(F.get(two, 0)["x"], F.get(two, 0)["y"], one)


def _pieces(e: Column, ring: Column) -> Column:
    """A segment cut where it meets a ring's edges: its pieces (a, b)."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]

    def at(f: Column) -> Column:
        fx, fy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
        k = _cross(dx, dy, fx, fy)
        gx, gy = f["a"]["x"] - e["a"]["x"], f["a"]["y"] - e["a"]["y"]
        t, u = _cross(gx, gy, fx, fy) / k, _cross(gx, gy, dx, dy) / k
        return F.when((F.abs(k) > EPS) & t.between(0, 1) & u.between(-EPS, 1 + EPS), t)

    ends = lambda f: F.when(  # noqa: E731  corners on the segment cut it where edges run along it
        (_side(e["a"], e["b"], f["a"]) == 0) & (dx * dx + dy * dy > 0),
        ((f["a"]["x"] - e["a"]["x"]) * dx + (f["a"]["y"] - e["a"]["y"]) * dy) / (dx * dx + dy * dy),
    )
    cuts = F.array_compact(F.concat(F.transform(_edges(ring), at), F.transform(_edges(ring), ends)))
    inner = F.filter(cuts, lambda t: (t > 0) & (t < 1))
    times = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    point = lambda t: F.struct((e["a"]["x"] + t * dx).alias("x"), (e["a"]["y"] + t * dy).alias("y"))
    return let(
        times,
        lambda ts: F.transform(
            F.sequence(F.lit(0), F.size(ts) - 2), lambda i: F.struct(point(F.get(ts, i)).alias("a"), point(F.get(ts, i + 1)).alias("b"))
        ),
    )


def _middle(e: Column) -> tuple[Column, Column]:
    return (e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2


def length_in_ring(line: Column, ring: Column) -> Column:
    """Length of the part of a line that lies in an area, its border included."""
    kept = lambda s: F.filter(s, lambda p: in_ring(*_middle(p), ring) | on_border(*_middle(p), ring))
    long = lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])
    return total(F.transform(_edges(line), lambda e: total(F.transform(kept(_pieces(e, ring)), long))))


def _turned(ring: Column) -> Column:
    """The ring counter-clockwise."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + _cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.when(twice < 0, F.reverse(ring)).otherwise(ring)


def overlap_area(one: Column, two: Column) -> Column:
    """Area that two rings share (J16, J18): by Green's theorem along its border, which consists of the parts of either
    border inside the other ring, and of those that both have in the same direction, once."""

    def along(a: Column, b: Column, shared: bool) -> Column:
        def inside(p: Column) -> Column:
            x, y = _middle(p)
            same = F.exists(
                _edges(b),
                lambda f: (_side(f["a"], f["b"], F.struct(x.alias("x"), y.alias("y"))) == 0)
                & _within_box(f["a"], f["b"], F.struct(x.alias("x"), y.alias("y")))
                & ((f["b"]["x"] - f["a"]["x"]) * (p["b"]["x"] - p["a"]["x"]) + (f["b"]["y"] - f["a"]["y"]) * (p["b"]["y"] - p["a"]["y"]) > 0),
            )
            return (in_ring(x, y, b) & ~on_border(x, y, b)) | (same if shared else F.lit(False))

        swept = lambda p: _cross(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])
        return total(F.transform(_edges(a), lambda e: total(F.transform(F.filter(_pieces(e, b), inside), swept))))

    both = F.struct(_turned(one).alias("a"), _turned(two).alias("b"))
    return let(both, lambda s: (along(s["a"], s["b"], True) + along(s["b"], s["a"], False)) / 2)


def shape_cells(df: DataFrame, shape: str, size: float) -> DataFrame:
    """Rows repeated for the grid cells that the bounding box of ``shape`` touches (cx, cy)."""
    xs, ys = F.transform(shape, lambda p: p["x"]), F.transform(shape, lambda p: p["y"])
    span = lambda v: F.sequence(cell(F.array_min(v) - EPS, size), cell(F.array_max(v) + EPS, size))
    return df.select("*", F.explode(span(xs)).alias("cx")).select("*", F.explode(span(ys)).alias("cy"))


def overlay_pairs(left: DataFrame, a: str, one: str, right: DataFrame, b: str, two: str, size: float) -> DataFrame:
    """Pairs of shapes (columns ``one`` and ``two``, ids ``a`` and ``b``) whose bounding boxes share a grid cell, each once.

    Ids meet in cells and shapes are joined back to the pairs, so no shape is repeated for its cells.
    """
    met = shape_cells(left, one, size).select(a, "cx", "cy").join(shape_cells(right, two, size).select(b, "cx", "cy"), ["cx", "cy"])
    return met.select(a, b).distinct().join(left, a).join(right, b)


def dissolved_border(parts: DataFrame, group: str, ring: str, grid: float) -> DataFrame:
    """Edges (group, ax, ay, bx, by) of the union of each group's rings (A11): those whose reverse no other part has.

    Parts may touch along whole edges but not overlap; corners are snapped to ``grid``.
    """
    e = parts.select(group, F.explode(_edges(_turned(F.col(ring)))).alias("e"))
    snap = lambda v: F.round(v / grid).cast("long")
    e = e.select(group, *[snap(F.col(f"e.{p}.{c}")).alias(f"{p}{c}") for p in "ab" for c in "xy"])
    back = e.select(group, F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return e.join(back, [group, "ax", "ay", "bx", "by"], "left_anti")
