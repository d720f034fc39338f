"""Layers of shapefiles and GeoPackages, read from the bytes of their files."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, layer string, fid long, wkt string, properties string, srs int"


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of whole files, from any store that Spark reads."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def _number(v: float) -> str:
    return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def _points(raw: bytes, at: int, n: int, order: str, width: int = 16) -> str:
    flat = [struct.unpack_from(f"{order}2d", raw, at + width * i) for i in range(n)]
    return ", ".join(f"{_number(x)} {_number(y)}" for x, y in flat)


def wkb_text(raw: bytes) -> str | None:
    """WKT of a WKB point, line or polygon, with or without z; None for other kinds."""
    order = "<" if raw[0] else ">"
    kind = struct.unpack_from(f"{order}I", raw, 1)[0]
    width = 24 if kind // 1000 == 1 or kind & 0x80000000 else 16
    kind = kind & 0xFFFF if kind & 0x80000000 else kind % 1000
    if kind == 1:
        return f"POINT ({_points(raw, 5, 1, order)})"
    n = struct.unpack_from(f"{order}I", raw, 5)[0]
    if kind == 2:
        return f"LINESTRING ({_points(raw, 9, n, order, width)})"
    if kind != 3:
        return None
    rings, at = [], 9
    for _ in range(n):
        k = struct.unpack_from(f"{order}I", raw, at)[0]
        rings.append(f"({_points(raw, at + 4, k, order, width)})")
        at += 4 + k * width
    return f"POLYGON ({', '.join(rings)})"


#: Bytes of the envelope in a GeoPackage geometry's head, by its code.
_ENVELOPE = (0, 32, 48, 48, 64)


def _package_rows(path: str, content: bytes, layer: str | None) -> Iterator[tuple]:
    base = sqlite3.connect(":memory:")
    try:
        base.deserialize(content)
        wanted = "SELECT c.table_name, g.column_name, c.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) ORDER BY 1"
        for name, geometry, srs in base.execute(wanted).fetchall():
            if layer is not None and name != layer:
                continue
            found = base.execute(f'SELECT rowid AS _fid, * FROM "{name}"')
            names = [c[0] for c in found.description]
            for row in found:
                cells = dict(zip(names, row, strict=True))
                raw, fid = cells.pop(geometry), cells.pop("_fid")
                wkt = wkb_text(raw[8 + _ENVELOPE[raw[3] >> 1 & 7] :]) if raw else None
                kept = {k: v for k, v in cells.items() if not isinstance(v, bytes)}
                yield path, name, fid, wkt, json.dumps(kept, sort_keys=True), srs
    finally:
        base.close()


def read_packages(contents: DataFrame, layer: str | None = None) -> DataFrame:
    """Features of GeoPackages (path, content), of all layers or one: path, layer, fid, wkt, properties (JSON), srs.

    A file is one task's work; its layers are read from memory, nothing is written. Empty geometries have a null wkt.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(list(_package_rows(path, content, layer)), columns=["path", "layer", "fid", "wkt", "properties", "srs"])

    return contents.select("path", "content").mapInPandas(read, ROWS)


def _shapes(raw: bytes) -> Iterator[str | None]:
    at = 100
    while at + 8 <= len(raw):
        size = struct.unpack_from(">i", raw, at + 4)[0] * 2
        kind = struct.unpack_from("<i", raw, at + 8)[0] % 10
        if kind == 1:
            yield f"POINT ({_points(raw, at + 12, 1, '<')})"
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<2i", raw, at + 44)
            first = [*struct.unpack_from(f"<{parts}i", raw, at + 52), points]
            base = at + 52 + 4 * parts
            runs = [f"({_points(raw, base + 16 * a, b - a, '<')})" for a, b in zip(first, first[1:], strict=False)]
            yield f"POLYGON ({', '.join(runs)})" if kind == 5 else f"LINESTRING {runs[0]}" if parts == 1 else f"MULTILINESTRING ({', '.join(runs)})"
        else:
            yield None
        at += 8 + size


def _records(raw: bytes) -> Iterator[dict]:
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16]))
        at += 32
    for i in range(n):
        at, out = head + i * size + 1, {}
        for name, kind, width in fields:
            text = raw[at : at + width].decode("utf-8", "replace").strip(" \0")
            out[name] = (float(text) if "." in text else int(text)) if kind in "NF" and text not in ("", "*" * width) else text or None
            at += width
        yield out


def read_shapefiles(contents: DataFrame) -> DataFrame:
    """Features of shapefiles: (path, content) of their .shp and .dbf files, met by the path before the ending.

    Returns path, layer (null), fid from 0, wkt, properties (JSON), srs (null: the .prj is for the caller to name).
    """
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    kind = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    made = contents.select(stem.alias("stem"), kind.alias("kind"), "content")
    pick = lambda k: made.where(F.col("kind") == k).select("stem", F.col("content").alias(k))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, shp, dbf in zip(part["stem"], part["shp"], part["dbf"], strict=True):
                rows = [{}] * len(list(_shapes(shp))) if dbf is None else list(_records(dbf))
                out = [(path, None, i, wkt, json.dumps(row, sort_keys=True), None) for i, (wkt, row) in enumerate(zip(_shapes(shp), rows, strict=True))]
                yield pd.DataFrame(out, columns=["path", "layer", "fid", "wkt", "properties", "srs"])

    return pick("shp").join(pick("dbf"), "stem", "left").mapInPandas(read, ROWS)


def projected(points: Column, srs: Column, default: int, to) -> Column:
    """Points (array<struct<x,y>>) in the target system: ``to`` (x, y -> x, y) is applied to those in degrees, srs 4326;
    an unset srs counts as ``default``."""
    moved = F.transform(points, lambda p: F.struct(*[c.alias(n) for c, n in zip(to(p["x"], p["y"]), "xy", strict=True)]))
    return F.when(F.coalesce(srs, F.lit(default)) == 4326, moved).otherwise(points)
