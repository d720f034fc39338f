"""Orders, indices, splits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.shared import cut


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """A gapless rank from 0 in a global order, without a window over the whole table.

    Rows are dealt by hash of nothing but ranges: each range's count is summed and the ranges before it are added. The
    table is materialised once so that both passes see the same ranges.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)
    up_to = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(up_to), F.lit(0)).alias("_b"))
    inside = W.partitionBy("_range").orderBy(*order)
    return (
        dealt.withColumn("_n", F.row_number().over(inside) - 1)
        .join(F.broadcast(before), "_range")
        .withColumn(name, (F.col("_n") + F.col("_b")).cast("long"))
        .drop("_range", "_n", "_b")
    )


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Sorted distinct keys numbered from 0, joined back."""
    keys = global_rank(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)
    return df.join(keys, key, "left")


def dense_rank_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 by ``keys``."""
    return global_rank(df, keys, name)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def chronological_split(df: DataFrame, order: Sequence[Column | str], train: float, valid: float) -> DataFrame:
    """train, valid, test in order; sizes round half to even, the rest is test."""
    ranked = global_rank(df, order, "_at")
    n = ranked.count()
    a, b = round(n * train), round(n * valid)
    part = F.when(F.col("_at") < a, "train").when(F.col("_at") < a + b, "valid").otherwise("test")
    return ranked.withColumn("part", part).drop("_at")


def hash_order(*columns: str) -> Column:
    """A fixed shuffle: md5 of the key, alike in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
