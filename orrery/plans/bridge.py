"""How the driver's tables stand in for urban data; each view has its SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.tables import table

ORIGIN = "2024-01-01 00:00:00"


def xy(key: str) -> list:
    k = F.col(key)
    return [((k * 7919 % 10007) / 10007.0).alias("x"), ((k * 104729 % 10009) / 10009.0).alias("y")]


def xy_sql(key: str) -> str:
    return f"({key} * 7919 % 10007) / 10007.0::DOUBLE AS x, ({key} * 104729 % 10009) / 10009.0::DOUBLE AS y"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def facts(spark: SparkSession, d: str, distinct: bool = False) -> DataFrame:
    """Temporal facts: who bought what, from order to shipping date, whichever comes first; with ``distinct`` each once,
    found by the keys before they become names."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("s"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    if distinct:
        j = j.select("o_custkey", "l_returnflag", "l_linestatus", "l_partkey", F.least("o", "s").alias("o"), F.greatest("o", "s").alias("s")).distinct()
    return j.select(
        F.concat_ws("::", F.lit("customer"), F.col("o_custkey").cast("string")).alias("head"),
        F.concat("l_returnflag", "l_linestatus").alias("relation"),
        F.concat_ws("::", F.lit("part"), F.col("l_partkey").cast("string")).alias("tail"),
        F.least("o", "s").alias("start_date"),
        F.greatest("o", "s").alias("end_date"),
    )


FACTS = """facts AS (
  SELECT 'customer::' || o_custkey AS head, l_returnflag || l_linestatus AS relation, 'part::' || l_partkey AS tail,
         least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS start_date,
         greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS end_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
