"""Planar geometry and spatial joins (J5 to J24, A3, F18 to F24). Points are x, y; rings and lines are array<struct<x,y>>."""

from __future__ import annotations

from math import cos, log, pi, radians, sin, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.shared import cut

EARTH_KM = 6371.0


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points of a line or closed ring."""
    return F.transform(
        F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b"))
    )


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, at least 0."""
    twice = F.aggregate(
        _edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    )
    return F.abs(twice) / 2


def line_length(line: Column) -> Column:
    return F.aggregate(
        _edges(line),
        F.lit(0.0),
        lambda s, e: s + F.sqrt(F.pow(e["a"]["x"] - e["b"]["x"], 2) + F.pow(e["a"]["y"] - e["b"]["y"], 2)),
    )


def compactness(ring: Column) -> Column:
    """4 pi A / P^2."""
    return F.lit(4.0) * F.pi() * ring_area(ring) / F.pow(line_length(ring), 2)


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid as struct<x,y>."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    sums = F.aggregate(
        _edges(ring),
        F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, e: F.struct(
            (s["k"] + cross(e)).alias("k"),
            (s["x"] + (e["a"]["x"] + e["b"]["x"]) * cross(e)).alias("x"),
            (s["y"] + (e["a"]["y"] + e["b"]["y"]) * cross(e)).alias("y"),
        ),
    )
    return F.transform(
        F.array(sums), lambda s: F.struct((s["x"] / (3 * s["k"])).alias("x"), (s["y"] / (3 * s["k"])).alias("y"))
    )[0]


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point lies inside a closed ring (points on an edge may go either way)."""
    hits = F.filter(
        _edges(ring),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(hits) % 2 == 1


def point_segment_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance of a point to a line."""

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        n = dx * dx + dy * dy
        t = F.when(n == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / n))
        )
        return F.sqrt(F.pow(x - e["a"]["x"] - t * dx, 2) + F.pow(y - e["a"]["y"] - t * dy, 2))

    return F.array_min(F.transform(_edges(line), one))


def polygon_join(points: DataFrame, polygons: DataFrame, size: float, how: str = "first") -> DataFrame:
    """Points (pid, x, y) in polygons (gid, ring): an equi-join on grid cells, then ray casting.

    ``how`` "first" keeps the polygon with the smallest gid, "all" every one.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(cell(F.array_min(v), size), cell(F.array_max(v), size))
    cells = polygons.select("gid", "ring", F.explode(span(xs)).alias("cx"), F.col("ring").alias("_r")).drop("_r")
    ys = F.transform("ring", lambda p: p["y"])
    cells = cells.select("gid", "ring", "cx", F.explode(span(ys)).alias("cy"))
    hits = (
        points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
        .join(cells, ["cx", "cy"])
        .where(in_ring(F.col("x"), F.col("y"), F.col("ring")))
        .select("pid", "x", "y", "gid")
    )
    if how == "all":
        return hits
    return hits.groupBy("pid", "x", "y").agg(F.min("gid").alias("gid"))


def _near_cells(df: DataFrame, size: float, rings: int = 1) -> DataFrame:
    """Rows repeated for their own and the neighbouring cells."""
    around = F.sequence(F.lit(-rings), F.lit(rings))
    out = df.withColumns({"_cx": cell(F.col("x"), size), "_cy": cell(F.col("y"), size)})
    out = out.select("*", F.explode(around).alias("_dx")).select("*", F.explode(around).alias("_dy"))
    return out.withColumns({"cx": F.col("_cx") + F.col("_dx"), "cy": F.col("_cy") + F.col("_dy")}).drop("_cx", "_cy", "_dx", "_dy")


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (pid, qid, distance) within ``radius``: cells as wide as the radius, nine of them looked up."""
    a = left.select("pid", F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    b = _near_cells(right.select("qid", "x", "y"), radius)
    d = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
    return a.join(b, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select("pid", "qid", "distance")


#: Fine cells along one side of a cell in which neighbours are looked for.
FINE = 8


def nearest_join(left: DataFrame, right: DataFrame, start: float, ties: bool = True) -> DataFrame:
    """(pid, qid, distance): the nearest right point (qid, x, y) of each left point (pid, x, y).

    Two steps in a cell and its neighbours. One point of each fine cell gives an upper bound of the distance; then only
    the points of fine cells that can hold one as near are compared. Where no bound is within reach, cells grow by 4 and
    only unanswered points go on, until they have passed the right side's extent.

    Points without two finite coordinates have no neighbour and are none; an empty right side gives no rows.
    """
    usable = lambda df: df.where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    )
    rest, right = usable(left.select("pid", "x", "y")), cut(usable(right.select("qid", "x", "y")))
    found, size = None, start
    while not right.isEmpty():
        rest = cut(rest)
        if rest.isEmpty():
            break
        fine = size / FINE
        placed = right.withColumns({"fx": cell(F.col("x"), fine), "fy": cell(F.col("y"), fine)})
        cells = placed.groupBy("fx", "fy").agg(F.min(F.struct("x", "y")).alias("one"))
        around = F.sequence(F.lit(-1), F.lit(1))
        near = cells.select("*", F.explode(around).alias("dx")).select("*", F.explode(around).alias("dy"))
        near = near.select("fx", "fy", "one", (F.floor(F.col("fx") / FINE) + F.col("dx")).alias("cx"), (F.floor(F.col("fy") / FINE) + F.col("dy")).alias("cy"))
        mine = rest.withColumns({"cx": F.floor(cell(F.col("x"), fine) / FINE), "cy": F.floor(cell(F.col("y"), fine) / FINE)})
        apart = lambda v, f: F.greatest(F.lit(0.0), f * fine - v, v - (f + 1) * fine)
        met = mine.join(near, ["cx", "cy"]).select(
            "pid",
            "x",
            "y",
            "fx",
            "fy",
            F.hypot(F.col("x") - F.col("one.x"), F.col("y") - F.col("one.y")).alias("reach"),
            F.hypot(apart(F.col("x"), F.col("fx")), apart(F.col("y"), F.col("fy"))).alias("least"),
        )
        bound = met.groupBy("pid").agg(F.min("reach").alias("bound")).where(F.col("bound") <= size)
        chosen = met.join(bound, "pid").where(F.col("least") <= F.col("bound") * (1 + 1e-12)).select("pid", F.col("x").alias("ax"), F.col("y").alias("ay"), "fx", "fy")
        d = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
        hits = chosen.join(placed, ["fx", "fy"]).select("pid", "qid", d.alias("distance"))
        least = hits.groupBy("pid").agg(F.min("distance").alias("least"))
        best = cut(hits.join(least, "pid").where("distance = least").drop("least"))
        found = best if found is None else found.unionByName(best)
        rest = rest.join(bound.select("pid"), "pid", "left_anti")
        size *= 4
    if found is None:
        return right.limit(0).select(F.lit(None).cast(left.schema["pid"].dataType).alias("pid"), "qid", F.col("x").alias("distance"))
    return found if ties else found.groupBy("pid").agg(F.min(F.struct("distance", "qid")).alias("b")).select(
        "pid", "b.qid", "b.distance"
    )


def within_or_nearest(left: DataFrame, right: DataFrame, tolerance: float, start: float) -> DataFrame:
    """Pairs (pid, qid, distance, method) within a tolerance; only if the whole table has none, nearest ones."""
    hits = cut(radius_join(left, right, tolerance))
    if hits.isEmpty():
        return nearest_join(left, right, start).withColumn("method", F.lit("nearest"))
    return hits.withColumn("method", F.lit("within"))


def k_nearest(left: DataFrame, right: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest right points within ``radius``, the point itself left out."""
    w = W.partitionBy("pid").orderBy("distance", "qid")
    return (
        radius_join(left, right, radius)
        .where("pid <> qid")
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= k)
    )


def kernel_sum(pairs: DataFrame, weight: Column, bandwidth: float) -> DataFrame:
    """Gaussian kernel sum per pid (A3)."""
    k = weight * F.exp(F.lit(-0.5) * F.pow(F.col("distance") / bandwidth, 2))
    return pairs.groupBy("pid").agg(F.sum(k).alias("density"), F.count(F.lit(1)).alias("near"))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def equirectangular_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x = (F.radians(lon2) - F.radians(lon1)) * F.cos((F.radians(lat1) + F.radians(lat2)) / 2)
    return EARTH_KM * F.sqrt(x * x + F.pow(F.radians(lat2) - F.radians(lat1), 2))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d = F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def tile(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    """Web-mercator tile of a point."""
    n = float(1 << level)
    clipped = F.least(F.lit(85.05112878), F.greatest(F.lit(-85.05112878), lat))
    s = F.sin(F.radians(clipped))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * n)
    top = F.lit(int(n) - 1)
    inside = lambda v: F.least(top, F.greatest(F.lit(0), v)).cast("int")
    return inside(x), inside(y)


def quadkey(lon: Column, lat: Column, level: int) -> Column:
    x, y = tile(lon, lat, level)
    bit = lambda v, i: F.shiftright(v, i - 1).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(x, i) + 2 * bit(y, i)).cast("string") for i in range(level, 0, -1)])


def snapped(v: Column, grid: float) -> Column:
    return F.round(v / grid) * grid


def transverse_mercator(lon: Column, lat: Column, meridian: float, scale: float = 0.9996) -> tuple[Column, Column]:
    """UTM easting and northing in metres on GRS80, by the published series (Snyder 1987, 8-9 to 8-15)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    p = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, c = F.pow(F.tan(p), 2), ep * F.pow(F.cos(p), 2)
    w = F.cos(p) * F.radians(lon - meridian)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p)
        - (35 * e2**3 / 3072) * F.sin(6 * p)
    )
    x = scale * n * (w + (1 - t + c) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(w, 5) / 120) + 500000
    y = scale * (
        m
        + n
        * F.tan(p)
        * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(w, 6) / 720)
    )
    return x, y


def inverse_mercator(x: Column, y: Column, meridian: float, scale: float = 0.9996) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres on GRS80 (Snyder 1987, 8-17 to 8-25)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    ep, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    mu = y / scale / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    c, t = ep * F.pow(F.cos(p), 2), F.pow(F.tan(p), 2)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    r = a * (1 - e2) / F.pow(1 - e2 * F.pow(F.sin(p), 2), 1.5)
    w = (x - 500000) / (n * scale)
    lat = p - n * F.tan(p) / r * (
        w * w / 2
        - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(w, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * F.pow(w, 6) / 720
    )
    lon = (w - (1 + 2 * t + c) * F.pow(w, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * F.pow(w, 5) / 120) / F.cos(p)
    return F.degrees(lon) + meridian, F.degrees(lat)


def lambert_conformal(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in US survey feet of the New York Long Island zone (2263), two standard parallels on GRS80
    (Snyder 1987, 15-1 to 15-10)."""
    # Fixed values of the zone: origin, central meridian, standard parallels, false easting in metres.
    lat0, lon0, one, two, east = 40 + 10 / 60, -74.0, 40 + 40 / 60, 41 + 2 / 60, 300000.0
    a, f, foot = 6378137.0, 1 / 298.257222101, 1200 / 3937
    e = (f * (2 - f)) ** 0.5

    def size(p: float) -> float:
        return cos(p) / (1 - (e * sin(p)) ** 2) ** 0.5

    def turn(p: float) -> float:
        return tan(pi / 4 - p / 2) / ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2)

    p0, p1, p2 = radians(lat0), radians(one), radians(two)
    n = (log(size(p1)) - log(size(p2))) / (log(turn(p1)) - log(turn(p2)))
    k = size(p1) / (n * turn(p1) ** n)
    p = F.radians(lat)
    t = F.tan(pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    rho, rho0 = a * k * F.pow(t, F.lit(n)), a * k * turn(p0) ** n
    theta = n * F.radians(lon - lon0)
    return (rho * F.sin(theta) + east) / foot, (rho0 - rho * F.cos(theta)) / foot


def cosine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the sphere by the law of cosines."""
    p, q = F.radians(lat1), F.radians(lat2)
    c = F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(F.radians(lon2) - F.radians(lon1))
    return EARTH_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def destination(lon: Column, lat: Column, angle: Column, km: Column) -> tuple[Column, Column]:
    """Where a way of so many kilometres in a direction (degrees from north) ends."""
    p, b, s = F.radians(lat), F.radians(angle), km / EARTH_KM
    q = F.asin(F.sin(p) * F.cos(s) + F.cos(p) * F.sin(s) * F.cos(b))
    d = F.atan2(F.sin(b) * F.sin(s) * F.cos(p), F.cos(s) - F.sin(p) * F.sin(q))
    return lon + F.degrees(d), F.degrees(q)
