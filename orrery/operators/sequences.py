"""Sequences: samples, sessions, padding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def samples(df: DataFrame, key: str, time: str, value: str, steps_in: int, steps_out: int) -> DataFrame:
    """Windows of ``steps_in`` values with the ``steps_out`` that follow; incomplete ones are dropped."""
    w = W.partitionBy(key).orderBy(time)
    x = F.collect_list(value).over(w.rowsBetween(1 - steps_in, 0))
    y = F.collect_list(value).over(w.rowsBetween(1, steps_out))
    out = df.select(key, time, x.alias("x"), y.alias("y"))
    return out.where((F.size("x") == steps_in) & (F.size("y") == steps_out))


def split_samples(df: DataFrame, key: str, time: str, value: str, steps_in: int, steps_out: int, train: float) -> DataFrame:
    """Samples by the other generator (W2): one fewer per key than there are windows, the train part's size cut off."""
    w = W.partitionBy(key).orderBy(time)
    n, i = F.count(F.lit(1)).over(W.partitionBy(key)) - (steps_in + steps_out), F.row_number().over(w) - 1
    x = F.collect_list(value).over(w.rowsBetween(0, steps_in - 1))
    y = F.collect_list(value).over(w.rowsBetween(steps_in, steps_in + steps_out - 1))
    out = df.select(key, i.cast("long").alias("i"), x.alias("x"), y.alias("y"), n.alias("n")).where("i < n")
    return out.withColumn("part", F.when(F.col("i") < F.floor(F.col("n") * train), "train").otherwise("test")).drop("n")


def offset_samples(df: DataFrame, key: str, time: str, value: str, offsets: dict[str, list[int]]) -> DataFrame:
    """Rows with the values that lie the given offsets earlier, a list per name, smallest offset first.

    One equi-join on shifted time for all offsets; a row that lacks any value is dropped.
    """
    flat = [(n, k) for n, ks in offsets.items() for k in ks]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("off")) for n, k in flat])
    asked = df.select(key, time, value, F.explode(listed).alias("o")).withColumn("_at", F.col(time) - F.col("o.off"))
    there = df.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(value).alias("_v"))
    met = asked.join(there, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_t")))
    found = met.groupBy(key, time, value).agg(F.array_sort(F.collect_list(F.struct("o.name", "o.off", "_v"))).alias("s")).where(F.size("s") == len(flat))
    pick = lambda n: F.transform(F.filter("s", lambda x: x["name"] == n), lambda x: x["_v"]).alias(n)
    return found.select(key, time, value, *[pick(n) for n in offsets])


def segment_samples(df: DataFrame, key: str, time: str, value: str, length: int, groups: list[list[int]]) -> DataFrame:
    """(key, time, x, y): y the ``length`` values from each time on, x the segments of that length that begin the given
    offsets earlier, group by group, largest offset first; incomplete samples are dropped (W4)."""
    starts = [(g, -k) for g, ks in enumerate(groups) for k in sorted(ks, reverse=True)] + [(len(groups), 0)]
    cells = [(g, k, j) for g, k in starts for j in range(length)]
    listed = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(k).alias("k"), F.lit(j).alias("j")) for g, k, j in cells])
    asked = df.select(key, time, F.explode(listed).alias("c")).withColumn("_at", F.col(time) + F.col("c.k") + F.col("c.j"))
    there = df.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.col(value).alias("_v"))
    met = asked.join(there, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_t")))
    found = met.groupBy(key, time).agg(F.array_sort(F.collect_list(F.struct("c.g", "c.k", "c.j", "_v"))).alias("s")).where(F.size("s") == len(cells))
    part = lambda last: F.transform(F.filter("s", lambda x: (x["g"] == len(groups)) == F.lit(last)), lambda x: x["_v"])
    return found.select(key, time, part(False).alias("x"), part(True).alias("y"))


def sessions(df: DataFrame, key: str, time: str, tie: str, gap_seconds: int) -> DataFrame:
    """Adds ``session``, counted from 1: a new one begins where the gap is ``gap_seconds`` or more."""
    w = W.partitionBy(key).orderBy(time, tie)
    gap = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w))
    fresh = F.when(gap < gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_f")


def capped_sessions(df: DataFrame, key: str, time: str, tie: str, gap_seconds: int, most: int) -> DataFrame:
    """Sessions that also end after ``most`` rows.

    A session ends at a long gap or when it is full, so inside a run between long gaps every ``most``-th row begins one:
    that needs no sequential code.
    """
    runs = sessions(df.select(key, time, tie), key, time, tie, gap_seconds).withColumnRenamed("session", "run")
    n = F.row_number().over(W.partitionBy(key, "run").orderBy(time, tie)) - 1
    part = runs.withColumn("part", F.floor(n / most))
    order = F.dense_rank().over(W.partitionBy(key).orderBy("run", "part"))
    return part.select(key, time, tie, order.cast("long").alias("session"))


def padded(a: Column, n: int, fill: int) -> Column:
    """The last n of an array, filled up on the right."""
    kept = F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)
    return F.concat(kept, F.array_repeat(F.lit(fill).cast("long"), F.lit(n) - F.size(kept)))


def greedy_interval(scores: DataFrame, key: str, time: str, score: str, share: float) -> DataFrame:
    """Interval grown from the best time of each fact to the better neighbour until it holds ``share`` of the mass."""

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        t, p = g[time].to_numpy(), g[score].to_numpy(dtype=float)
        i = j = int(p.argmax())
        mass, whole = p[i], p.sum()
        while mass < share * whole and (i > 0 or j + 1 < len(p)):
            left = p[i - 1] if i > 0 else float("-inf")
            right = p[j + 1] if j + 1 < len(p) else float("-inf")
            if left >= right:
                i -= 1
                mass += left
            else:
                j += 1
                mass += right
        return pd.DataFrame({key: [g[key].iloc[0]], "begin": [t[i]], "finish": [t[j]], "mass": [mass / whole if whole else 0.0]})

    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    return scores.groupBy(key).applyInPandas(grow, f"{key} {kinds[key]}, begin {kinds[time]}, finish {kinds[time]}, mass double")


def warped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dynamic time warping distances of the columns of ``x`` and ``y``, all columns at once."""
    row = [np.zeros(x.shape[1])] + [np.full(x.shape[1], np.inf)] * len(y)
    for a in x:
        new = [np.full(x.shape[1], np.inf)]
        for j, b in enumerate(y):
            new.append(np.abs(a - b) + np.minimum(np.minimum(row[j], row[j + 1]), new[j]))
        row = new
    return row[-1]


#: Distances to a tile's columns are kept as tables for so many values of a profile at most.
VALUES = 32
#: Above this share of pairs that the bounds leave open, a tile is compared as a whole.
OPEN = 1 / 64


def warped_rows(x: np.ndarray, y: np.ndarray, first):
    """(k, j, distances of column k of ``x`` to the columns of ``y`` from j on), j at most ``first[k]``; whole numbers from 0.

    No cell of the table exceeds a side's length times the largest value, so the narrowest type that holds that is exact.
    The distances are overwritten by the next ones.
    """
    most = max(len(x), len(y)) * max(int(x.max()), int(y.max()))
    kind = np.min_scalar_type(most)
    x, y = x.astype(kind), np.ascontiguousarray(y, dtype=kind)
    values, start = np.unique(x), None
    for k in range(x.shape[1]):
        j = int(first[k]) // 512 * 512
        if j != start:  # views are made anew only every 512 columns
            start, z = j, y[:, j:]
            best, low = np.empty_like(z), np.empty_like(z)
            cells, lows = list(best), list(low)
            gap = lambda v, z=z: np.maximum(z, v) - np.minimum(z, v)
            gaps = {v: list(gap(v)) for v in values} if len(values) <= VALUES else None
        for i, v in enumerate(x[:, k]):
            c = gaps[v] if gaps else gap(v)
            if i == 0:
                cells[0][:] = c[0]
                for left, cell, more in zip(cells[:-1], cells[1:], c[1:], strict=True):
                    np.add(left, more, out=cell)
                continue
            np.minimum(best[1:], best[:-1], out=low[1:])
            np.add(best[0], c[0], out=best[0])
            for least, left, cell, more in zip(lows[1:], cells[:-1], cells[1:], c[1:], strict=True):
                np.minimum(least, left, out=least)
                np.add(least, more, out=cell)
        yield k, j, cells[-1]


def warped_below(x: np.ndarray, y: np.ndarray, first, most: float):
    """(k, columns, distances) of the pairs of ``warped_rows`` from ``first`` on whose distance is ``most`` or less.

    Series longer than one value meet at both ends, and either's largest and smallest value meets some value of the other:
    those bounds rule out most pairs, and only the others are compared.
    """
    kind = np.int32 if max(x.max(), y.max()) < 1 << 30 else np.int64
    (x0, x1, xh, xl), (y0, y1, yh, yl) = [(a[0], a[-1], a.max(0), a.min(0)) for a in (x.astype(kind), y.astype(kind))]
    left, n = [], 0
    for k in range(x.shape[1]):
        f = first[k]
        j = f + np.flatnonzero(np.abs(y0[f:] - x0[k]) + np.abs(y1[f:] - x1[k]) <= most)
        j = j[(np.abs(yh[j] - xh[k]) <= most) & (np.abs(yl[j] - xl[k]) <= most)]
        n += len(j)
        if n > OPEN * x.shape[1] * y.shape[1]:
            break
        left.append(j)
    else:
        k, j = np.repeat(np.arange(len(left)), [len(v) for v in left]), np.concatenate(left) if left else np.zeros(0, int)
        for s in range(0, len(k), 65536):
            a, b = k[s : s + 65536], j[s : s + 65536]
            d = warped(x[:, a].astype(float), y[:, b].astype(float))
            yield a[d <= most], b[d <= most], d[d <= most]
        return
    for k, j, d in warped_rows(x, y, first):
        found = int(first[k]) + np.flatnonzero(d[int(first[k]) - j :] <= most)
        yield np.full(len(found), k), found, d[found - j].astype(float)


def common_route(a: np.ndarray, b: np.ndarray) -> list:
    """A longest common subsequence of two routes (M22). The table is filled by anti-diagonals, each at once."""
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        j = k - i
        best[i + 1, j + 1] = np.where(a[i] == b[j], best[i, j] + 1, np.maximum(best[i, j + 1], best[i + 1, j]))
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def shape_distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 - the largest normalised cross-correlation of every row with every centre over all shifts, and that shift."""
    m = x.shape[1]
    size = 1 << (2 * m - 1).bit_length()
    f, g = np.fft.rfft(x, size), np.fft.rfft(centres, size)
    c = np.fft.irfft(f[:, None, :] * np.conj(g)[None, :, :], size)
    c = np.concatenate([c[..., -(m - 1) :], c[..., :m]], axis=2)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None, :]
    c = c / np.maximum(norm, 1e-300)[..., None]
    return 1 - c.max(axis=2), c.argmax(axis=2) - (m - 1)


def shape_clusters(df: DataFrame, key: str, series: str, k: int, rounds: int = 10, seed: int = 7) -> DataFrame:
    """(key, cluster, distance): series of equal length clustered by shape after scaling to mean 0 and deviation 1.

    Each round a task assigns its series to the nearest centre and adds up the products of the shifted ones: m x m numbers
    for each cluster, whose first eigenvector, centred, is the new centre. The driver holds k centres and k such matrices.
    """
    scaled = df.select(key, F.transform(series, lambda v: v.cast("double")).alias("x")).where(F.size("x") > 1)
    first = scaled.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k).collect()
    if not first:
        return df.limit(0).select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    m = len(first[0].x)
    flat = lambda x: (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, keepdims=True), 1e-12)
    centres = flat(np.array([r.x for r in first]))
    for _ in range(rounds):
        now = centres

        def summed(parts, now=now):
            total = np.zeros((len(now), m, m))
            for part in parts:
                if not len(part):
                    continue
                x = flat(np.stack(part["x"].to_numpy()))
                gap, shift = shape_distances(x, now)
                own = gap.argmin(axis=1)
                for c in range(len(now)):
                    rows = np.flatnonzero(own == c)
                    moved = np.zeros((len(rows), m))
                    for r, (i, s) in enumerate(zip(rows, shift[rows, c], strict=True)):
                        s = int(s)
                        if s >= 0:
                            moved[r, : m - s] = x[i, s:]
                        else:
                            moved[r, -s:] = x[i, : m + s]
                    total[c] += moved.T @ moved
            yield pd.DataFrame({"c": range(len(now)), "m": [t.ravel().tolist() for t in total]})

        parts = scaled.select("x").mapInPandas(summed, "c int, m array<double>")
        long = parts.select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))
        total = np.zeros((len(now), m * m))
        for r in long.collect():
            total[r.c, r.i] = r.v
        q = np.eye(m) - 1.0 / m
        new = []
        for c in range(len(now)):
            product = q @ total[c].reshape(m, m) @ q
            if not product.any():
                new.append(now[c])
                continue
            v = np.linalg.eigh(product)[1][:, -1]
            new.append(v if v @ now[c] >= 0 else -v)
        new = flat(np.array(new))
        if np.allclose(new, now, atol=1e-9):
            break
        centres = new

    def assign(parts):
        for part in parts:
            if len(part):
                gap = shape_distances(flat(np.stack(part["x"].to_numpy())), centres)[0]
                yield pd.DataFrame({key: part[key], "cluster": gap.argmin(axis=1), "distance": gap.min(axis=1)})

    return scaled.mapInPandas(assign, f"{key} {df.schema[key].dataType.simpleString()}, cluster int, distance double")
