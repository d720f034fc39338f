"""Text readers of graph and grid files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def wkt_points(wkt: Column) -> Column:
    """Points of a WKT POINT, LINESTRING or one-ring POLYGON as array<struct<x,y>>; null if it is none of these."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:POINT|LINESTRING|POLYGON)\s*Z?\s*\(+([^()]+)\)+\s*$", 1)
    pairs = F.transform(
        F.split(body, ","),
        lambda p: F.struct(
            F.try_element_at(F.regexp_extract_all(p, F.lit(f"({_NUMBER})"), F.lit(1)), F.lit(1)).cast("double").alias("x"),
            F.try_element_at(F.regexp_extract_all(p, F.lit(f"({_NUMBER})"), F.lit(1)), F.lit(2)).cast("double").alias("y"),
        ),
    )
    return F.when((body != "") & ~F.exists(pairs, lambda p: p["x"].isNull() | p["y"].isNull()), pairs)


def triples(spark: SparkSession, path: str, names: tuple[str, ...] = ("head", "relation", "tail")) -> DataFrame:
    """Triples from a file: CSV by header name, in any order, if its first line holds all ``names``; else lines of three
    or more parts separated by commas, or by tabs or blanks. Lines with fewer parts are dropped."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    header = [c.strip().strip('"').lower() for c in first[0][0].replace("\ufeff", "").split(",")] if first else []
    if all(n in header for n in names):
        df = spark.read.option("header", True).csv(path)
        actual = {c.replace("\ufeff", "").strip().lower(): c for c in df.columns}
        return df.select(*[F.trim(F.col(f"`{actual[n]}`")).alias(n) for n in names])
    lines = lines.where(F.trim("value") != "")
    parts = F.when(F.contains("value", F.lit(",")), F.split("value", r"\s*,\s*")).otherwise(F.split(F.trim("value"), r"\s+"))
    found = lines.select(parts.alias("p")).where(F.size("p") >= len(names))
    return found.select(*[F.trim(F.get("p", i)).alias(n) for i, n in enumerate(names)])


def mapping(spark: SparkSession, path: str, name: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """A two-column dictionary whose columns may stand in any order under any of the given names; a BOM is ignored."""
    df = spark.read.option("header", True).csv(path)
    clean = {c.replace("﻿", "").strip().lower(): c for c in df.columns}
    pick = lambda options: next(clean[o] for o in options if o in clean)
    return df.select(F.trim(F.col(f"`{pick(name)}`")).alias("name"), F.col(f"`{pick(key)}`").cast("long").alias("id")).distinct()


def geo_nodes(df: DataFrame, order: str = "geo_id") -> DataFrame:
    """Atomic .geo rows with their node index by ``order``; coordinates parsed as JSON, never evaluated."""
    from orrery.operators.order import dense_index

    return dense_index(df, order, "node").withColumn("point", F.from_json("coordinates", "array<double>"))


def complete_grid(df: DataFrame, time: str, entity: str) -> DataFrame:
    """One row (times, entities, cells, complete): whether a long table holds every entity at every time."""
    return df.agg(
        F.countDistinct(time).alias("times"), F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("cells")
    ).withColumn("complete", F.col("times") * F.col("entities") == F.col("cells"))


def dyna(df: DataFrame, features: list[str], entity: str = "entity_id") -> DataFrame:
    """Atomic .dyna rows as (step, node, features): both indices from 0 in order of time and id."""
    return _indexed(df, {"node": entity}, features)


def grid(df: DataFrame, features: list[str], columns: int) -> DataFrame:
    """Atomic .grid rows as (step, row_id, column_id, node, features), node = row * columns + column."""
    placed = _indexed(df, {}, ["row_id", "column_id", *features])
    return placed.withColumn("node", F.col("row_id") * columns + F.col("column_id"))


def origin_destination(df: DataFrame, features: list[str]) -> DataFrame:
    """Atomic .od rows as (step, origin, destination, features): origins and destinations share one index."""
    from orrery.operators.order import dense_index

    ids = df.select(F.col("origin_id").alias("id")).union(df.select("destination_id")).distinct()
    index = dense_index(ids, "id", "at")
    o = index.select(F.col("id").alias("origin_id"), F.col("at").alias("origin"))
    e = index.select(F.col("id").alias("destination_id"), F.col("at").alias("destination"))
    return _indexed(df, {}, ["origin_id", "destination_id", *features]).join(o, "origin_id").join(e, "destination_id").drop("origin_id", "destination_id")


def grid_origin_destination(df: DataFrame, features: list[str], columns: int) -> DataFrame:
    """Atomic .gridod rows as (step, origin, destination, features), cells numbered row by row."""
    places = ["origin_row_id", "origin_column_id", "destination_row_id", "destination_column_id"]
    at = _indexed(df, {}, [*places, *features])
    cell = lambda side: F.col(f"{side}_row_id") * columns + F.col(f"{side}_column_id")
    return at.select("step", cell("origin").alias("origin"), cell("destination").alias("destination"), *features)


def _indexed(df: DataFrame, ids: dict[str, str], keep: list[str]) -> DataFrame:
    from orrery.operators.order import dense_index

    out = dense_index(df, "time", "step")
    for name, column in ids.items():
        out = dense_index(out, column, name)
    return out.select("step", *ids, *keep)


def trajectories(df: DataFrame, keys: list[str], time: str, point: list[str]) -> DataFrame:
    """One row per trajectory: its points in order of time, each with the seconds since the first, modulo a day."""
    stamp = F.unix_seconds(F.date_trunc("second", F.col(time))).alias("t")
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(stamp, *point))).alias("s"))
    since = lambda p: F.struct(((p["t"] - F.get("s", 0)["t"]) % 86400).alias("seconds"), *[p[c].alias(c) for c in point])
    return g.select(*keys, F.transform("s", since).alias("points"))


def adjacency(edges: DataFrame, nodes: DataFrame, missing: float = float("inf"), both: bool = False) -> DataFrame:
    """Dense (i, j, cost, link) over node indices from atomic .rel rows (rel_id, origin_id, destination_id, cost) and
    ``nodes`` (id, node): the last of repeated edges wins, absent ones cost ``missing`` (A28)."""
    rows = edges.select("rel_id", "origin_id", "destination_id", "cost")
    if both:
        rows = rows.unionByName(rows.select("rel_id", F.col("origin_id").alias("destination_id"), F.col("destination_id").alias("origin_id"), "cost"))
    last = rows.groupBy("origin_id", "destination_id").agg(F.max(F.struct("rel_id", "cost"))["cost"].alias("cost"))
    i = nodes.select(F.col("id").alias("origin_id"), F.col("node").alias("i"))
    j = nodes.select(F.col("id").alias("destination_id"), F.col("node").alias("j"))
    known = last.join(i, "origin_id").join(j, "destination_id").select("i", "j", "cost")
    every = i.select("i").crossJoin(j.select("j"))  # the matrix itself
    full = every.join(known, ["i", "j"], "left")
    return full.select("i", "j", F.coalesce("cost", F.lit(missing)).alias("cost"), F.col("cost").isNotNull().cast("int").alias("link"))
