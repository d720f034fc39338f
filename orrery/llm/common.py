"""What the training-data operators share: stored intermediate tables and distributed prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orrery.sources.shared import shared_dir

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

#: Local files without checksum files beside them (pages have their own, see ``stored``): where Hadoop's native library is
#: missing it forks ``chmod`` again and again for each file, and until a fork has started it counts as a second executor.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows that a file of a small table holds at least, unless that leaves cores idle.
FILE_ROWS = 50_000

_stored: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _stored.append((spark, path))
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, existing folder in the shared one."""
    path = new_path(spark, label)
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and no executor is needed for it.

    With ``rows``, about how many there are at most, a small table goes into few files, two for each core at least.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.options(**PLAIN_FILES).parquet(path)
    return spark.read.option("parquet.page.verify-checksum.enabled", "true").schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _stored:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already; nothing depends on this
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give what a finished task has freed back to the system: its Python worker lives on, idle beside other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        return


def private(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``df`` does not have, whatever the case: the given ones behind as many underscores as that takes."""
    taken, head = {c.lower() for c in df.columns}, "_"
    while any(head + n.lower() in taken for n in names):
        head += "_"
    return tuple(head + n for n in names)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    flat = F.btrim(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Rows in a global order with exclusive running sums and a gapless rank from 0, without one task that sees all rows.

    The rows are range-partitioned by ``order`` (end it with a unique column, so that a hot value is split),
    each partition's totals are summed, and the totals of the partitions before are added to the running sums
    inside each partition. Only one row per partition meets in a single task. Adds ``rank`` and ``before_<name>``.
    """
    values = {f"_v_{n}": c for n, c in sums.items()}
    names = df.columns
    with_keys = df.select("*", *[c.alias(n) for n, c in values.items()])
    dealt = stored(
        with_keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label
    )
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t{v}") for v in values])
    up_to = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t{v}").over(up_to), F.lit(0)).alias(f"_o{v}") for v in values],
    )
    inside = W.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = dealt.select(
        "*",
        (F.row_number().over(inside) - 1).cast("long").alias("_r"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b{v}") for v in values],
    ).join(F.broadcast(offsets), "_part")
    return out.select(
        *names,
        (F.col("_r") + F.col("_o_n")).cast("long").alias("rank"),
        *[(F.col(f"_b_v_{n}") + F.col(f"_o_v_{n}")).alias(f"before_{n}") for n in sums],
    )
