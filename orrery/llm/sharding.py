"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import prefix_sums, stored

#: Groups of equal texts are broadcast up to so many rows, otherwise joined by sort and merge, where the engine may split
#: a hot one.
BROADCAST_ROWS = 1_000_000
#: A cut may move by this part of a shard's share so as not to part a group of equal texts.
SNAP = 0.05


def _joined(rows: DataFrame, groups: DataFrame, same: list[str], label: str) -> DataFrame:
    groups = stored(groups, label)
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups) if few else groups, same, "left")


def shard_by_bytes(docs: DataFrame, shards: int = 16, snap: float = SNAP) -> DataFrame:
    """Give each document a shard 0..shards-1 and a gapless slot in it.

    The documents stand in one global order: groups of equal texts by their bytes, largest first, then by md5 of the text and
    doc_id. Range partitions are summed, the totals of the partitions before give every row its byte offset, and the line
    is cut at equal byte targets; a row belongs where its middle lies. A group that a cut would part goes whole to one
    side if the cut need move by no more than ``snap`` of a share; otherwise its rows are cut like any others, so that
    one huge group cannot unbalance the shards. Largest first, most cuts fall between small groups.

    Defined cases: a null text counts as no bytes (size 1, the checksum of no bytes); rows that repeat are documents of
    their own; an empty table gives no rows; ids may be null and other columns are ignored. Memory: a
    row's text; only sizes, checksums and hashes travel.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot, group_key, group_rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.md5(F.encode(text, "UTF-8")).alias("group_key"),
        ),
        "shard-sizes",
    )
    several = (
        base.groupBy("group_key", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("group_rows"), F.sum("size").alias("group_bytes"))
        .where("group_rows > 1")
    )
    same = ["group_key", "size", "text_crc32"]
    rows = _joined(base, several, same, "shard-groups").withColumns(
        {
            "group_rows": F.coalesce("group_rows", F.lit(1)),
            "group_bytes": F.coalesce("group_bytes", F.col("size")),
        }
    )
    order = [F.col("group_bytes").desc(), *map(F.col, same), F.col("doc_id")]
    line = stored(prefix_sums(rows, order, {"bytes": F.col("size")}, "shard-line"), "shard-order")
    total = line.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = max(total, 1) / shards
    firsts = line.where("group_rows > 1").groupBy(*same).agg(F.min("before_bytes").alias("group_start"))
    line = _joined(line, firsts, same, "shard-firsts").withColumn("group_start", F.coalesce("group_start", "before_bytes"))

    at = lambda place: F.least(F.floor(place / share), F.lit(shards - 1)).cast("int")
    low, high = at(F.col("group_start")), at(F.col("group_start") + F.col("group_bytes") - 1)
    cut = high * F.lit(share)
    shard = (
        F.when(low == high, low)
        .when((high == low + 1) & (cut - F.col("group_start") <= snap * share), high)
        .when((high == low + 1) & (F.col("group_start") + F.col("group_bytes") - cut <= snap * share), low)
        .otherwise(at(F.col("before_bytes") + F.col("size") / 2))
    )
    line = stored(line.withColumn("shard", shard), "shard-cut")
    starts = line.groupBy("shard").agg(F.min("rank").alias("_start"))
    return line.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("_start")).alias("slot"), "group_key", "group_rows"
    )
