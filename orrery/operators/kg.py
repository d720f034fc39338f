"""Knowledge graph construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.order import global_rank
from orrery.sources.tables import table

FACT = ("head", "relation", "tail", "start_date", "end_date")


def entity(kind: str, raw: Column | str) -> Column:
    return F.concat_ws("::", F.lit(kind), F.col(raw).cast("string") if isinstance(raw, str) else raw.cast("string"))


def emit(df: DataFrame, head: Column, relation: str, tail: Column) -> DataFrame:
    """Timeless facts of one relation."""
    return df.select(
        head.alias("head"),
        F.lit(relation).alias("relation"),
        tail.alias("tail"),
        F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
    )


def static_facts(spark: SparkSession, d: str) -> DataFrame:
    """Containment facts of customers, suppliers and nations."""
    parts = [
        emit(table(spark, d, "customer"), entity("customer", "c_custkey"), "CIN", entity("nation", "c_nationkey")),
        emit(table(spark, d, "supplier"), entity("supplier", "s_suppkey"), "SIN", entity("nation", "s_nationkey")),
        emit(table(spark, d, "nation"), entity("nation", "n_nationkey"), "NIR", entity("region", "n_regionkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def union_facts(*parts: DataFrame) -> DataFrame:
    """All facts once."""
    return reduce(DataFrame.unionByName, [p.select(*FACT) for p in parts]).dropDuplicates(list(FACT))


def encoded(quads: DataFrame) -> DataFrame:
    """Facts with ids from 0 in code point order of entities and of relations."""
    names = quads.select(F.col("head").alias("name")).union(quads.select("tail")).distinct()
    ids = global_rank(names, ["name"], "id")
    relations = global_rank(quads.select(F.col("relation").alias("r")).distinct(), ["r"], "relation_id")
    h = ids.select(F.col("name").alias("head"), F.col("id").alias("head_id"))
    t = ids.select(F.col("name").alias("tail"), F.col("id").alias("tail_id"))
    out = quads.join(relations, F.col("relation") == F.col("r")).join(h, "head").join(t, "tail")
    return out.select("head_id", "relation_id", "tail_id", "start_date", "end_date")


def incident(quads: DataFrame) -> DataFrame:
    """Facts seen from both of their entities: (e, relation, other), distinct."""
    there = quads.select(F.col("head").alias("e"), "relation", F.col("tail").alias("other"))
    back = quads.select(F.col("tail").alias("e"), F.concat("relation", F.lit("_r")).alias("relation"), F.col("head").alias("other"))
    return there.unionByName(back).distinct()


def resolved(asked: DataFrame, keep: list[str], spellings: list[Column], names: DataFrame) -> DataFrame:
    """The id (names: name, id) of the first spelling that has one, as ``resolved``."""
    tries = F.array(*[F.struct(F.lit(i).alias("place"), s.alias("name")) for i, s in enumerate(spellings)])
    rows = asked.select(*keep, F.explode(tries).alias("t")).select(*keep, "t.place", "t.name")
    hit = rows.join(names, "name", "left")
    best = F.min(F.when(F.col("id").isNotNull(), F.struct("place", "id")))
    return hit.groupBy(*keep).agg(best.alias("b")).select(*keep, F.col("b.id").alias("resolved"))
