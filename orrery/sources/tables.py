"""Table loading: Parquet first, else CSV, and multi-file unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of its own file system, so any store will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def auto(spark: SparkSession, stem: str, schema: StructType | str | None = None) -> DataFrame:
    """``stem.parquet`` if it is there, else ``stem.csv`` with a header."""
    if exists(spark, f"{stem}.parquet"):
        return spark.read.parquet(f"{stem}.parquet")
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(f"{stem}.csv")


def many(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of several Parquet files with one schema, as one scan."""
    return spark.read.parquet(*paths)
