"""Writers (S15 to S19, M10): partitioned output replaced as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_safely(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Write beside ``path``, then swap by two renames; ``df`` may read ``path`` itself.

    The old table is renamed, not deleted, until the new one stands in its place: a crash before that leaves it whole, at
    ``path`` or beside it under ``.old-``, and a failed swap puts it back.
    """
    spark = df.sparkSession
    mark, stem = uuid.uuid4().hex, path.rstrip("/")
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(f"{stem}.new-{mark}")
    here, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (stem, f"{stem}.new-{mark}", f"{stem}.old-{mark}"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(here)
    if had and not fs.rename(here, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, here):
        if had:
            fs.rename(old, here)
        raise OSError(f"cannot put the new table at {path}")
    if had:
        fs.delete(old, True)


def write_table(df: DataFrame, stem: str, formats: tuple[str, ...] = ("parquet", "csv")) -> str:
    """Write ``stem.parquet``, or in the next format if that one cannot hold the columns; returns the path."""
    for i, fmt in enumerate(formats):
        path = f"{stem}.{fmt}"
        try:
            write_safely(df, path, fmt)
            return path
        except AnalysisException:
            if i + 1 == len(formats):
                raise
    raise ValueError("no format given")


def append_chunks(chunks: Iterable[DataFrame], path: str) -> int:
    """Append tables to one CSV folder, every file of it with the header once (S19, X7); returns the number of chunks."""
    n = 0
    for n, chunk in enumerate(chunks, 1):  # noqa: B007
        chunk.write.mode("append").option("header", True).csv(path)
    return n


def dyna_rows(df: DataFrame, time: str, entity: str, features: list[str]) -> DataFrame:
    """Rows of a .dyna file: running id by entity and time, ISO-8601 times."""
    from orrery.operators.order import dense_rank_rows

    numbered = dense_rank_rows(df, [entity, time], "dyna_id")
    stamp = F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return numbered.select(
        "dyna_id", F.lit("state").alias("type"), stamp.alias("time"), F.col(entity).alias("entity_id"), *features
    )


def geojson_features(df: DataFrame, entity: str, x: str, y: str, values: list[str]) -> DataFrame:
    """One GeoJSON feature per entity with the mean of each value."""
    grouped = df.groupBy(entity, x, y).agg(*[F.round(F.avg(v), 4).alias(v) for v in values])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(v) for v in values]).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"),
    )
    return grouped.select(entity, F.to_json(feature).alias("feature"))


def write_metrics(metrics: DataFrame, stem: str, fmt: str = "csv") -> str:
    """Metrics, a row per horizon, as one small file in the given format (M10); returns the path."""
    path = f"{stem}.{fmt}"
    write_safely(metrics.coalesce(1), path, fmt)
    return path


def geo_rows(df: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Rows of a .geo file: id, type and coordinates as JSON."""
    return df.select(F.col(entity).alias("geo_id"), F.lit("Point").alias("type"), F.to_json(F.array(x, y)).alias("coordinates"))


def rel_rows(df: DataFrame, origin: str, destination: str, cost: str) -> DataFrame:
    """Rows of a .rel file: a running id by origin and destination."""
    from orrery.operators.order import dense_rank_rows

    numbered = dense_rank_rows(df, [origin, destination], "rel_id")
    return numbered.select("rel_id", F.lit("geo").alias("type"), F.col(origin).alias("origin_id"), F.col(destination).alias("destination_id"), cost)


def feature(properties: list[str], kind: str, coordinates: Column) -> Column:
    """A GeoJSON feature with the given geometry."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*properties).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
    )
