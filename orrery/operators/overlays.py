"""Lines and rings of any shape met in blocks of one grid cell, as arrays.

The rules are those of ``polygons``; only what a pair of blocks yields leaves its task, never a shape with its pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.polygons import EPS, shape_cells

#: Shapes of one cell in a block, and pairs computed at once.
BLOCK = 4096
AT_ONCE = 1 << 15


def _blocks(df: DataFrame, key: str, shape: str, size: float, p: str) -> DataFrame:
    """Per grid cell the shapes that touch it, in blocks of about ``BLOCK``: ids, numbers of points, coordinates end to end."""
    cells = shape_cells(df.select(key, shape), shape, size)
    parts = cells.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_n"))
    dealt = cells.join(parts, ["cx", "cy"]).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_n")))
    s = dealt.groupBy("cx", "cy", "_part").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(shape).alias("p"))).alias("_s"))
    points = F.flatten("_s.p")
    return s.select(
        "cx", "cy", F.col("_s.k").alias(f"{p}_key"), F.transform("_s.p", lambda v: F.size(v)).alias(f"{p}_n"), points["x"].alias(f"{p}_x"), points["y"].alias(f"{p}_y")
    )


class _Shapes:
    """Shapes of one number of points: keys, coordinates (shape, point), bounding boxes."""

    def __init__(self, key, x, y):
        self.key, self.x, self.y = key, x, y
        self.x0, self.x1, self.y0, self.y1 = x.min(1) - EPS, x.max(1) + EPS, y.min(1) - EPS, y.max(1) + EPS


def _shapes(batch: pa.RecordBatch, row: int, p: str) -> Iterator[_Shapes]:
    key, n, x, y = (batch.column(f"{p}_{c}")[row].values.to_numpy(zero_copy_only=False) for c in ("key", "n", "x", "y"))
    at = np.concatenate([[0], np.cumsum(n)])
    for m in np.unique(n).tolist():
        some = np.flatnonzero(n == m)
        index = at[some][:, None] + np.arange(m)
        yield _Shapes(key[some], x[index], y[index])


def _side(ax, ay, bx, by, px, py):
    k = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return np.where(np.abs(k) <= EPS, 0.0, np.sign(k))


def _in_box(ax, ay, bx, by, px, py):
    return (px >= np.minimum(ax, bx) - EPS) & (px <= np.maximum(ax, bx) + EPS) & (py >= np.minimum(ay, by) - EPS) & (py <= np.maximum(ay, by) + EPS)


def in_rings(px, py, x, y):
    """Ray casting of one point for each ring (rows of x and y)."""
    odd = np.zeros(len(px), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(x.shape[1] - 1):
            ax, ay, bx, by = x[:, i], y[:, i], x[:, i + 1], y[:, i + 1]
            odd ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return odd


def on_borders(px, py, x, y):
    on = np.zeros(len(px), bool)
    for i in range(x.shape[1] - 1):
        e = x[:, i], y[:, i], x[:, i + 1], y[:, i + 1]
        on |= (_side(*e, px, py) == 0) & _in_box(*e, px, py)
    return on


def lines_meet_rings(lx, ly, rx, ry):
    """``polygons.line_meets_ring`` of line and ring of each row."""
    met = in_rings(lx[:, 0], ly[:, 0], rx, ry)
    for i in range(lx.shape[1] - 1):
        rest = np.flatnonzero(~met)
        sides = [_side(*(v[rest, k] for k in (i, i + 1) for v in (lx, ly)), rx[rest, j], ry[rest, j]) for j in range(rx.shape[1])]
        low, high = np.minimum.reduce(sides), np.maximum.reduce(sides)
        near = np.flatnonzero((low <= 0) & (high >= 0))  # else all corners lie on one side of the edge
        rest = rest[near]
        e = lx[rest, i], ly[rest, i], lx[rest, i + 1], ly[rest, i + 1]
        found = np.zeros(len(rest), bool)
        for j in range(rx.shape[1] - 1):
            f = rx[rest, j], ry[rest, j], rx[rest, j + 1], ry[rest, j + 1]
            p, q, r, s = sides[j][near], sides[j + 1][near], _side(*f, *e[:2]), _side(*f, *e[2:])
            found |= (p * q < 0) & (r * s < 0)
            for hit, edge, point in ((p, e, f[:2]), (q, e, f[2:]), (r, f, e[:2]), (s, f, e[2:])):
                k = np.flatnonzero(hit == 0)
                if len(k):
                    found[k] |= _in_box(*[c[k] for c in edge], *[c[k] for c in point])
        met[rest] |= found
    return met


def rings_meet(ax, ay, bx, by):
    """``polygons.rings_meet`` of two rings of each row."""
    met = in_rings(bx[:, 0], by[:, 0], ax, ay)
    rest = np.flatnonzero(~met)
    met[rest] = lines_meet_rings(ax[rest], ay[rest], bx[rest], by[rest])
    return met


def _inside(px, py, rx, ry):
    held = in_rings(px, py, rx, ry)
    rest = np.flatnonzero(~held)
    held[rest] = on_borders(px[rest], py[rest], rx[rest], ry[rest])
    return held


def lengths_in_rings(lx, ly, rx, ry):
    """``polygons.length_in_ring`` of line and ring of each row."""
    out = np.zeros(len(lx))
    m = rx.shape[1] - 1
    for i in range(lx.shape[1] - 1):
        ax, ay = lx[:, i], ly[:, i]
        dx, dy = lx[:, i + 1] - ax, ly[:, i + 1] - ay
        long = dx * dx + dy * dy
        cuts = np.full((len(lx), 2 * m), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(m):
                fx, fy = rx[:, j + 1] - rx[:, j], ry[:, j + 1] - ry[:, j]
                gx, gy = rx[:, j] - ax, ry[:, j] - ay
                k = dx * fy - dy * fx
                t, u = (gx * fy - gy * fx) / k, (gx * dy - gy * dx) / k
                cuts[:, j] = np.where((np.abs(k) > EPS) & (t > 0) & (t < 1) & (u >= -EPS) & (u <= 1 + EPS), t, np.nan)
                c = np.flatnonzero((np.abs(dx * gy - dy * gx) <= EPS) & (long > 0))
                t = (gx[c] * dx[c] + gy[c] * dy[c]) / long[c]
                cuts[c, m + j] = np.where((t > 0) & (t < 1), t, np.nan)
        crossed = ~np.isnan(cuts).all(1)
        whole = np.flatnonzero(~crossed)
        held = whole[_inside(ax[whole] + dx[whole] / 2, ay[whole] + dy[whole] / 2, rx[whole], ry[whole])]
        out[held] += np.sqrt(long[held])
        some = np.flatnonzero(crossed)
        if not len(some):
            continue
        times = np.sort(cuts[some], axis=1)  # what is missing comes last
        most = int((~np.isnan(times)).sum(1).max())
        before = np.zeros(len(some))
        for j in range(most + 1):
            after = np.where(np.isnan(times[:, j]), 1.0, times[:, j]) if j < most else np.ones(len(some))
            k = np.flatnonzero(after > before)
            s = some[k]
            mid = (before[k] + after[k]) / 2
            held = _inside(ax[s] + mid * dx[s], ay[s] + mid * dy[s], rx[s], ry[s])
            out[s[held]] += (after[k] - before[k])[held] * np.sqrt(long[s[held]])
            before = np.maximum(before, after)
    return out


def met(left: DataFrame, a: str, one: str, right: DataFrame, b: str, two: str, size: float, measure: Callable, fold: Callable, schema: str, ordered: bool = False) -> DataFrame:
    """What ``fold`` makes of the pairs of shapes (ids ``a`` and ``b``, shapes ``one`` and ``two``) of a pair of blocks.

    ``measure`` takes x, y of the left and of the right shapes of each pair; ``fold`` takes left ids, right ids and an
    iterator of (places left, places right, measures), all pairs of a left shape at once, and gives columns. A pair
    counts only in the cell that holds the lower left corner of what its bounding boxes share, so it counts once. With
    ``ordered`` only pairs with the smaller id on the left count.
    """
    cells = _blocks(left, a, one, size, "l").join(_blocks(right, b, two, size, "r"), ["cx", "cy"])
    cells = cells.repartition(F.xxhash64("cx", "cy", F.col("l_key")[0], F.col("r_key")[0]))

    def pairs(cell: tuple[int, int], l: _Shapes, r: _Shapes) -> Iterator[tuple[np.ndarray, ...]]:  # noqa: E741
        rows = max(1, AT_ONCE // len(r.key))
        for at in range(0, len(l.key), rows):
            k = slice(at, at + rows)
            x, y = np.maximum(l.x0[k, None], r.x0), np.maximum(l.y0[k, None], r.y0)
            fit = (x <= np.minimum(l.x1[k, None], r.x1)) & (y <= np.minimum(l.y1[k, None], r.y1))
            fit &= (np.floor(x / size) == cell[0]) & (np.floor(y / size) == cell[1])
            if ordered:
                fit &= l.key[k, None] < r.key
            i, j = np.nonzero(fit)
            if len(i):
                i = i + at
                yield i, j, measure(l.x[i], l.y[i], r.x[j], r.y[j])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = batch.column("cx")[row].as_py(), batch.column("cy")[row].as_py()
                rights = list(_shapes(batch, row, "r"))
                for l in _shapes(batch, row, "l"):  # noqa: E741
                    for r in rights:
                        for columns in fold(l.key, r.key, pairs(cell, l, r)):
                            if len(next(iter(columns.values()))):
                                yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in columns.items()})

    return cells.mapInArrow(work, schema)


def longest_parts(left: np.ndarray, right: np.ndarray, found: Iterator) -> Iterator[dict]:
    """Of each left id the most of the measures (6 places), the smallest right id that has it, how many are above 0."""
    for i, j, v in found:
        v = np.round(v, 6)
        i, j, v = i[v > 0], j[v > 0], v[v > 0]
        order = np.lexsort((right[j], -v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
        yield {"line": left[i[first]], "gid": right[j[first]], "length": v[first], "rings": np.diff(np.append(first, len(i)))}


def sums_by_kind(kinds: int) -> Callable:
    """Of each right id and each left id modulo ``kinds`` the sum of the measures above 0."""

    def fold(left: np.ndarray, right: np.ndarray, found: Iterator) -> Iterator[dict]:
        n, total = np.zeros(len(right) * kinds, np.int64), np.zeros(len(right) * kinds)
        for i, j, v in found:
            at = j * kinds + left[i] % kinds
            n += np.bincount(at, v > 0, len(n)).astype(np.int64)
            total += np.bincount(at, v, len(n))
        k = np.flatnonzero(n)
        yield {"gid": right[k // kinds], "kind": k % kinds, "length": total[k]}

    return fold


def counts_and_least(left: np.ndarray, right: np.ndarray, found: Iterator) -> Iterator[dict]:
    """Of each right id how many left ids meet it, and the smallest."""
    n, least = np.zeros(len(right), np.int64), np.full(len(right), np.iinfo(np.int64).max)
    for i, j, v in found:
        n += np.bincount(j[v], minlength=len(n))
        np.minimum.at(least, j[v], left[i[v]])
    k = np.flatnonzero(n)
    yield {"gid": right[k], "n": n[k], "line": least[k]}


def both_ways(left: np.ndarray, right: np.ndarray, found: Iterator) -> Iterator[dict]:
    """Ids that meet, in both directions."""
    for i, j, v in found:
        a, b = left[i[v]], right[j[v]]
        yield {"a": np.concatenate([a, b]), "b": np.concatenate([b, a])}
