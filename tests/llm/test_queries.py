"""Registered queries against their SQL, and the pipeline's stages against each other, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import jaccard, quality, queries, secrets
from orrery.llm.common import table

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert got == sorted((tuple(r[columns.index(c)] for c in names) for r in found.fetchall()), key=repr)


def test_pipeline_stages(spark):
    docs = table(spark, DATA, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], DATA).persist()
        assert out.columns == docs.columns
        steps.append(out)
    kept = {r.doc_id for r in quality.judge_documents(docs, table(spark, DATA, "labels")).where("kept").collect()}
    assert {r.doc_id for r in steps[1].collect()} == kept
    groups = jaccard.similar_documents(steps[1]).where("doc_id = component_id")
    assert {r.doc_id for r in steps[2].collect()} == {r.doc_id for r in groups.collect()}
    assert steps[3].count() == steps[2].count()
    assert secrets.find_secrets(steps[3]).where(F.size("_spans") > 0).count() == 0
    assert steps[4].select("doc_id").distinct().count() <= steps[3].count()
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[4], DATA)
    tokens = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tokens.where("n > 2048").count() == 0
    assert packed.where("start = 0").count() == steps[4].count()
