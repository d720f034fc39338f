"""Values that equal comparison does not tell apart, against the SQL on small tables."""

import duckdb
import pytest

from orrery import registry
from orrery.plans import catalog  # noqa: F401


def both(spark, folder, name):
    """Rows of the query and of its SQL, printed, so that -0.0 is not 0.0."""
    got = sorted(repr(r.asDict()) for r in registry.QUERIES[name](spark, str(folder)).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    return got, sorted(repr(dict(zip(names, r, strict=True))) for r in found.fetchall())


@pytest.mark.parametrize("name", ["label_mean_vectors", "fused_embeddings"])
def test_small_negatives_keep_their_sign(spark, tmp_path, name):
    rows = [(1, 0, [-1e-5, 0.5]), (2, 0, [-2e-5, -0.25]), (3, 1, [-1e-5, 1e-5]), (4, 1, [-0.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = both(spark, tmp_path, name)
    assert got == want
    assert any("-0.0," in r for r in want)
