"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import stored
from orrery.llm.components import connected_components

THRESHOLD = 0.98
#: Rows of a tile; the task that compares two tiles holds both.
TILE = 1024
#: Quantisation steps on either side of zero.
STEPS = 127
#: Room for rounding in double precision, on top of the bounds.
SLACK = 1e-9
#: Room for rounding in the angles of tiles.
SLACK_ANGLE = 1e-6
#: Vectors that tiles are formed around; they reach the driver and every task.
PIVOTS = 64
#: Labels and cells are broadcast up to so many rows, otherwise joined by sort and merge.
BROADCAST_ROWS = 1_000_000
#: Pairs recomputed at once.
AT_ONCE = 1 << 16

PARTIAL = "a long, b long, times long"
OPEN = ["a", "b", "times", "pair", "same", "left", "right"]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes q of the unit vectors u of rows x, their scales s, error norms |u - s q| and norms |s q|."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / STEPS
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(u - near, axis=1), np.linalg.norm(near, axis=1)


@dataclass(frozen=True)
class Tile:
    """Quantised rows of one label and width: codes, scales, error norms and norms, as ``quantise`` gives them."""

    ids: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    norm: np.ndarray

    def packed(self) -> dict:
        return {
            "ids": self.ids.astype("<i8").tobytes(),
            "n": self.n.astype("<i8").tobytes(),
            "codes": self.codes.tobytes(),
            "bounds": np.stack([self.scale, self.error, self.norm]).astype("<f8").tobytes(),
        }

    @staticmethod
    def unpacked(ids: bytes, n: bytes, codes: bytes, bounds: bytes) -> Tile:
        ids = np.frombuffer(ids, "<i8")
        return Tile(
            ids, np.frombuffer(n, "<i8"), np.frombuffer(codes, np.int8).reshape(len(ids), -1), *np.frombuffer(bounds, "<f8").reshape(3, -1)
        )


def tile_pairs(x: Tile, y: Tile, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of x and y that may link, and whether they surely do.

    With u = s q + e, |u.v - s t q.r| <= |s q| |f| + |e| |t r| + |e| |f|: a pair whose quantised product is below the
    threshold by more than that cannot link, one that is above it by more surely does. The products of codes are whole
    numbers small enough to be exact in single precision.
    """
    wide = np.float32 if x.codes.shape[1] * STEPS * STEPS < 1 << 24 else np.float64
    product = (x.codes.astype(wide) @ y.codes.astype(wide).T).astype(np.float64) * x.scale[:, None] * y.scale[None, :]
    bound = x.norm[:, None] * y.error[None, :] + x.error[:, None] * (y.norm + y.error)[None, :] + SLACK
    i, j = np.nonzero(product + bound >= threshold)
    return i, j, product[i, j] - bound[i, j] >= threshold


def exact_links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows have a cosine of at least the threshold in double precision."""
    hit = np.empty(len(x), dtype=bool)
    for lo in range(0, len(x), AT_ONCE):
        a, b = x[lo : lo + AT_ONCE], y[lo : lo + AT_ONCE]
        cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        hit[lo : lo + AT_ONCE] = cosine >= threshold
    return hit


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest index of its group) that connect what the links i-j connect, at most n - 1."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new[root]
    node = np.nonzero(root != np.arange(n))[0]
    return node, root[node]


def _found(ids: np.ndarray, jds: np.ndarray, n: np.ndarray, k: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> pa.RecordBatch:
    """What links i-j of rows ids and jds (n and k vectors each) say: counts as (a, null, times), and a spanning forest of
    them as (a, b, 0). Rows of one tile (``same``) are compared with themselves, both ways."""
    left, right = np.zeros(len(ids), np.int64), np.zeros(len(jds), np.int64)
    np.add.at(left, i, k[j])
    if not same:
        np.add.at(right, j, n[i])
    names = ids if same else np.concatenate([ids, jds])
    counts = left if same else np.concatenate([left, right])
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    node, root = _forest(len(names), place[i], place[j if same else j + len(ids)])
    some = np.flatnonzero(counts)
    a = np.concatenate([names[some], names[order][node]])
    b = np.concatenate([np.zeros(len(some), np.int64), names[order][root]])
    times = np.concatenate([counts[some], np.zeros(len(node), np.int64)])
    return pa.RecordBatch.from_pydict(
        {"a": pa.array(a), "b": pa.array(b, mask=np.arange(len(b)) < len(some)), "times": pa.array(times)}
    )


def _small(df: DataFrame, label: str) -> DataFrame:
    """A table of counts, marked for broadcast if it is short."""
    df = stored(df, label)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _tiles(classes: DataFrame, tile: int, threshold: float) -> DataFrame:
    """Classes (label, v, node, n) as quantised tiles: label, width, t, packed rows, centre and radius.

    Every unit vector goes to the nearest of a few pivots, the first ceil(classes / tile) of ``PIVOTS`` for its label, so
    that neighbours meet in a tile; what one pivot gets is cut into tiles of about ``tile`` rows.
    """
    some = classes.select("v", F.xxhash64("node", "label").alias("h")).orderBy("h", "v").limit(PIVOTS).collect()
    pivots = [np.array(r.v) / np.linalg.norm(r.v) for r in some]
    by_width = {w: np.stack([p for p in pivots if len(p) == w]) for w in {len(p) for p in pivots}}
    shared = classes.sparkSession.sparkContext.broadcast(by_width)
    sizes = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("cells"))
    kind = classes.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells").to_numpy(zero_copy_only=False)
            cell = np.zeros(len(cells), np.int32)
            width = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                pivots = shared.value.get(int(w))
                rows = np.flatnonzero((width == w) & (cells > 1))
                if pivots is None or not len(rows):
                    continue
                x = batch.column("v").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
                near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
                near[np.arange(len(pivots))[None, :] >= cells[rows][:, None]] = -2.0
                cell[rows] = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell)], names=[*batch.schema.names[:-1], "cell"])

    dealt = classes.join(_small(sizes, "vector-labels"), "label").select("label", "v", "node", "n", "cells")
    dealt = stored(dealt.mapInArrow(assign, f"label {kind}, v array<double>, node long, n long, cell int"), "vector-cells")
    cut = dealt.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("cuts"))
    dealt = dealt.join(_small(cut, "vector-cuts"), ["label", "cell"]).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, part in group.sort_values("node").groupby(group["v"].map(len)):
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            centre = unit.sum(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-6 else unit[0]
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            rows = Tile(part["node"].to_numpy(np.int64), part["n"].to_numpy(np.int64), *quantise(x)).packed()
            first = part.iloc[0]
            out.append({"label": first["label"], "width": int(w), "t": (int(first["cell"]) << 32) + int(first["cut"]), **rows, "centre": centre.tolist(), "radius": radius})
        return pd.DataFrame(out)

    return dealt.groupBy("label", "cell", "cut").applyInPandas(
        pack, f"label {kind}, width int, t long, ids binary, n binary, codes binary, bounds binary, centre array<double>, radius double"
    )


def _certain(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles: links that the bounds decide, and for the others the packed pairs of rows that may link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = [c[row].as_py() for c in batch.columns]
                pair, same = at[0], at[1]
                x, y = Tile.unpacked(*at[2:6]), Tile.unpacked(*at[6:10])
                i, j, sure = tile_pairs(x, y, threshold)
                if same:
                    i, j, sure = (c[i != j] for c in (i, j, sure))
                if sure.any():
                    found = _found(x.ids, y.ids, x.n, y.n, i[sure], j[sure], same)
                    n = found.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [*found.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=OPEN
                    )
                maybe = ~sure
                if maybe.any():
                    one = np.array([pair], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(one), pa.array([same]),
                            pa.array([x.ids[i[maybe]].astype("<i8").tobytes()], pa.binary()),
                            pa.array([y.ids[j[maybe]].astype("<i8").tobytes()], pa.binary()),
                        ],
                        names=OPEN,
                    )

    return pairs.mapInArrow(work, "a long, b long, times long, pair long, same boolean, left binary, right binary")


def _recomputed(open_: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The open pairs again, from the full vectors of the rows in them alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, left, right in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.unique(np.concatenate([np.frombuffer(left, "<i8"), np.frombuffer(right, "<i8")]))
                yield pa.RecordBatch.from_pydict({"pair": pa.array(np.full(len(ids), pair)), "id": pa.array(ids)})

    wanted = open_.select("pair", "left", "right").mapInArrow(rows, "pair long, id long")
    none = F.lit(None)
    vectors = wanted.join(classes.select(F.col("node").alias("id"), "v", "n"), "id").select(
        "pair", F.lit(1).alias("role"), "id", "v", "n", none.cast("boolean").alias("same"), none.cast("binary").alias("left"), none.cast("binary").alias("right")
    )
    asked = open_.select(
        "pair", F.lit(0).alias("role"), none.cast("long").alias("id"), none.cast("array<double>").alias("v"), none.cast("long").alias("n"), "same", "left", "right"
    )
    met = vectors.unionByName(asked).repartition("pair").sortWithinPartitions("pair", "role")

    def check(asked: tuple, ids: list[int], v: list[np.ndarray], n: list[int]) -> pa.RecordBatch:
        same, left, right = asked
        order = np.argsort(ids)
        ids, n = np.array(ids, np.int64)[order], np.array(n, np.int64)[order]
        x = np.stack(v)[order]
        i, j = (np.searchsorted(ids, np.frombuffer(c, "<i8")) for c in (left, right))
        hit = exact_links(x[i], x[j], threshold)
        i, j = i[hit], j[hit]
        if not same:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        return _found(ids, ids, n, n, i, j, True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, ids, v, n = None, None, [], [], []
        for batch in batches:
            for row in range(batch.num_rows):
                pair = batch.column(0)[row].as_py()
                if pair != now:
                    if ids:
                        yield check(asked, ids, v, n)
                    now, ids, v, n = pair, [], [], []
                if batch.column(1)[row].as_py() == 0:
                    asked = tuple(batch.column(k)[row].as_py() for k in (5, 6, 7))
                else:
                    ids.append(batch.column(2)[row].as_py())
                    v.append(batch.column(3)[row].values.to_numpy())
                    n.append(batch.column(4)[row].as_py())
        if ids:
            yield check(asked, ids, v, n)

    return met.mapInArrow(work, PARTIAL)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Links and components of all vectors (vec_id, embedding, label) with equal labels.

    Vectors with the same label and the same numbers are one class; copies link with each other and share the links of
    their class, and are never paired. Each label's classes are dealt to tiles of about ``tile`` rows by their nearest
    pivot and quantised once. Every two tiles of a label whose centres are not too far apart for any link meet in one task
    as int8 codes with their bounds; full vectors are fetched only for rows of pairs that the bounds leave open. A task
    returns counts and a spanning forest of its links, not the links: at most a few rows per vector and pair of tiles,
    however large a group of copies is.

    Defined cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components, links
    with nothing (n_links 0, a component of its own); vectors of different lengths link with nothing; rows that repeat an
    id are vectors of their own, and a component is named by the smallest id in it; null ids are their own component (null); an empty table gives no rows; other
    columns are ignored. Classes are named by 64 bits. Memory: two tiles and
    the matrix of their products.

    Returns vec_id, n_links, component_id, kept.
    """
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    usable = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.coalesce(F.size("v"), F.lit(0)) > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", numbers.alias("v"))
    rows = rows.withColumn("good", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = stored(rows.withColumn("node", F.when(F.col("good"), F.xxhash64("label", "v"))), "vectors")
    classes = rows.where("good").groupBy("node", "label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "vector-classes")
    tiles = stored(_tiles(classes, tile, threshold), "vector-tiles")
    index = tiles.select("label", "width", "t", "centre", "radius")
    near = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near)))
    reach = F.col("a.radius") + F.col("b.radius") + float(np.arccos(threshold)) + SLACK_ANGLE
    meeting = index.alias("a").join(
        index.alias("b"),
        (F.col("a.label") == F.col("b.label")) & (F.col("a.width") == F.col("b.width")) & (F.col("a.t") <= F.col("b.t")) & (angle <= reach),
    )
    meeting = meeting.select(
        F.col("a.label").alias("label"), F.col("a.width").alias("width"), F.col("a.t").alias("t"), F.col("b.t").alias("u"), (F.col("a.t") == F.col("b.t")).alias("same")
    )
    meeting = stored(meeting.withColumn("pair", F.monotonically_increasing_id()), "vector-meeting")
    packed = ["ids", "n", "codes", "bounds"]
    left = tiles.select("label", "width", "t", *packed)
    right = tiles.select("label", "width", F.col("t").alias("u"), *[F.col(c).alias(f"{c}_u") for c in packed])
    pairs = meeting.join(left, ["label", "width", "t"]).join(right, ["label", "width", "u"])
    pairs = pairs.select("pair", "same", *packed, *[f"{c}_u" for c in packed]).repartition("pair")
    decided = stored(_certain(pairs, threshold), "vector-decided")
    open_ = decided.where("pair is not null").select("pair", "same", "left", "right")
    found = decided.where("pair is null").select("a", "b", "times").unionByName(_recomputed(open_, classes, threshold))
    found = stored(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("links"))
    groups = stored(connected_components(found.where("b is not null").select("a", "b"), "vector-components"), "vector-groups")
    linked = classes.select("node", "rep").join(groups, "node")
    linked = linked.join(linked.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "least")
    of = (
        classes.join(counts, "node", "left")
        .join(linked, "node", "left")
        .select(
            "node",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("least", "rep").alias("component_id"),
        )
    )
    return rows.select("vec_id", "node").join(of, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
