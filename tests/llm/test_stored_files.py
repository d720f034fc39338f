"""Intermediate tables: small ones lie in few files, local ones without checksum files, and broken pages are noticed."""

import os

import pytest

from orrery.llm import common
from orrery.llm.components import connected_components


def _files(table):
    return [f.removeprefix("file:").replace("///", "/") for f in table.inputFiles()]


def test_small_tables_lie_in_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    table = common.stored(spark.range(0, 5000, 1, 6 * cores), "few", rows=5000)
    assert 1 <= len(_files(table)) <= 2 * cores and table.count() == 5000
    many = common.stored(spark.range(0, 5000, 1, 6 * cores), "many", rows=common.FILE_ROWS * 5 * cores)
    assert len(_files(many)) == 5 * cores and many.count() == 5000


def test_stored_tables_have_no_checksum_files_but_checked_pages(spark):
    table = common.stored(spark.range(0, 5000, 1, 1).selectExpr("id", "cast(xxhash64(id) as string) as text"), "plain")
    (path,) = _files(table)
    assert not [f for f in os.listdir(os.path.dirname(path)) if f.endswith(".crc")]
    with open(path, "r+b") as f:
        f.seek(os.path.getsize(path) // 2)
        was = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([was[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        table.selectExpr("sum(length(text))", "count(distinct text)").collect()


def test_rounds_of_stars_are_written_to_few_files(spark, monkeypatch):
    cores, counts = spark.sparkContext.defaultParallelism, []
    from orrery.llm import components

    def stored(df, label, rows=None):
        table = common.stored(df, label, rows)
        counts.append((rows, len(_files(table)), table.count()))
        return table

    monkeypatch.setattr(components, "stored", stored)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 5 * cores)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.range(0, 999).selectExpr("id as a", "id + 1 as b")
        assert {r.component for r in connected_components(links).collect()} == {0}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(counts) > 2
    assert all(files <= 2 * cores and n <= rows for rows, files, n in counts[1:])
