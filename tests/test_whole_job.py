"""Queries against brute force over all rows: nothing is left out by an id, a prefix or a bound."""

import duckdb
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery import registry
from orrery.operators import ranking
from orrery.plans import catalog  # noqa: F401
from orrery.plans.q_ranking import label_means, vectors

DATA = "/root/testdata/sf0.001"


def run(spark, name, folder=DATA):
    return registry.QUERIES[name](spark, folder)


def facts(spark, folder=DATA):
    """Ids, vectors, labels and each head's relation as the queries see them."""
    v = vectors(spark, folder)
    means = {r.label: np.array(r.r) for r in label_means(v).collect()}
    rows = sorted(v.collect(), key=lambda r: r.vec_id)
    return [r.vec_id for r in rows], np.array([r.e for r in rows]), np.array([r.label for r in rows]), np.array([means[r.label] for r in rows])


def test_every_head_is_ranked_against_every_vector(spark):
    ids, e, label, rel = facts(spark)
    n, got = len(ids), {r.h: r["rank"] for r in run(spark, "filtered_ranks").collect()}
    want = {}
    for i, h in enumerate(ids):
        target = ((h * 7 + 10) % n // 5 * 5 + h % 5) % n
        s = np.round(-np.sqrt(((e[i] + rel[i] - e) ** 2).sum(1)), 6)
        rival = (label != label[i]) & (np.arange(n) != target)
        want[h] = 1 + int((rival & (s >= s[target])).sum())
    assert got == want


def test_blocks_do_not_change_ranks(spark):
    rng = np.random.default_rng(3)
    e = np.round(rng.normal(size=(30, 4)), 1)
    e[10:20] = e[3]
    tails = spark.createDataFrame([(i, e[i].tolist(), i % 3) for i in range(30)], "t long, t_e array<double>, own int")
    goal = lambda i: round(-float(np.sqrt(((e[i] - e[(i + 7) % 30]) ** 2).sum())), 6)
    heads = spark.createDataFrame([(i, e[i].tolist(), i % 3, (i + 7) % 30, goal(i)) for i in range(30)], "h long, q array<double>, label int, target long, goal double")
    want = {}
    for i in range(30):
        s = np.round(-np.sqrt(((e[i] - e) ** 2).sum(1)), 6)
        want[i] = 1 + sum(s[j] >= goal(i) for j in range(30) if j % 3 != i % 3 and j != (i + 7) % 30)
    for block in (4, 1024):
        assert {r.h: r["rank"] for r in ranking.block_ranks(heads, tails, block=block).collect()} == want


def test_scores_of_all_pairs(spark):
    ids, e, _, rel = facts(spark)
    df = run(spark, "fact_scores")
    assert df.count() == len(ids) ** 2
    sample = spark.createDataFrame([(h, t) for h in (1, 8, 13) for t in (0, 8, 499)], "h long, t long")
    v = pd.Series(range(len(ids)), index=ids)
    rows = sample.toPandas()
    pairs = spark.createDataFrame(
        [(h, t, e[v[h]].tolist(), rel[v[h]].tolist(), e[v[t]].tolist()) for h, t in zip(rows.h.tolist(), rows.t.tolist(), strict=True)],
        "h long, t long, h_e array<double>, r array<double>, t_e array<double>",
    )
    s = {**ranking.scores(F.col("h_e"), F.col("r"), F.col("t_e")), "score": ranking.hyperbolic_score(F.col("h_e"), F.col("r"), F.col("t_e"))}
    want = {(r.h, r.t): r for r in pairs.select("h", "t", *[c.alias(n) for n, c in s.items()]).collect()}
    ball = run(spark, "hyperbolic_scores")
    assert ball.count() == len(ids) ** 2
    for r in df.join(ball, ["h", "t"]).join(sample, ["h", "t"]).collect():
        for n in s:
            assert r[n] == pytest.approx(want[r.h, r.t][n], abs=6e-5), n


def test_untyped_suppliers_are_candidates_of_every_customer(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, None)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 0), (5, 1), (10, 1), (20, 3), (30, None), (12, 5)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.k: r.candidates for r in run(spark, "type_constrained_candidates", str(tmp_path)).collect()}
    assert got == {1: 4, 2: 4, 3: 3, 4: 6}


def test_profiles_of_all_users_are_compared(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet")
    p = {u: np.bincount(g.dt.hour, minlength=24) for u, g in e.groupby("user_id").ts}
    users = sorted(p)
    d = np.zeros((len(users), len(users)))
    for i, u in enumerate(users):
        for j, v in enumerate(users):
            cost = np.full((25, 25), np.inf)
            cost[0, 0] = 0
            for a in range(24):
                for b in range(24):
                    cost[a + 1, b + 1] = abs(int(p[u][a]) - int(p[v][b])) + min(cost[a, b], cost[a, b + 1], cost[a + 1, b])
            d[i, j] = cost[24, 24]
    like = np.exp(-d / d.std())
    want = {(u, v): like[i, j] for i, u in enumerate(users) for j, v in enumerate(users) if u <= v and like[i, j] > 0.83}
    got = {(r.a, r.b): r.similarity for r in run(spark, "profile_graph").collect()}
    assert got == pytest.approx(want)


def test_profile_threshold_keeps_pairs_of_any_residue(spark, tmp_path):
    at = lambda u, h: (u, f"2024-01-01 {h:02d}:00:00")
    rows = [at(u, h) for u in (1, 2, 13) for h in (1, 2, 3)] + [at(4, 9)] * 30
    spark.createDataFrame(rows, "user_id long, ts string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.a, r.b) for r in run(spark, "profile_graph", str(tmp_path)).collect()}
    assert got == {(1, 2), (1, 13), (2, 13), (1, 1), (2, 2), (4, 4), (13, 13)}


def test_vectors_are_read_to_their_end(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x = np.array(e.embedding.tolist(), dtype=float)
    mean = {k: x[(e.label == k).to_numpy()].mean(0) for k in set(e.label)}
    for r in run(spark, "label_mean_vectors").collect():
        assert r.mean == pytest.approx(mean[r.label], abs=6e-5)
    want = {k: ((v - mean[c]) ** 2).mean() for k, v, c in zip(e.vec_id, x, e.label, strict=True)}
    assert {r.vec_id: r.mse for r in run(spark, "anchor_losses").collect()} == pytest.approx(want, abs=6e-5)
    assert {(len(r.fused), r.width) for r in run(spark, "fused_embeddings").collect()} == {(64, 128)}
    three = {k: (v * mean[c] * mean[c + 1] * 2 + v * mean[c] * v + v * mean[c + 1] * v).sum() for k, v, c in zip(e.vec_id, x, e.label, strict=True) if c + 1 in mean}
    assert {r.vec_id: r.score for r in run(spark, "temporal_scores").collect()} == pytest.approx(three, abs=6e-4)
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
    lengths = dict(zip(e.vec_id, np.linalg.norm(x @ axes.T, axis=1), strict=True))
    assert {r.vec_id: r.length for r in run(spark, "reduced_vectors").collect()} == pytest.approx(lengths, abs=6e-5)


def test_paths_between_all_nodes(spark, tmp_path):
    chain = [1]
    while len(chain) < 12:
        chain.append((chain[-1] * 7 + 3) % 100)
    keys = sorted({3, 6, 9, 12, 45, 87, *chain})
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    edges = {k: (k * 7 + 3) % 100 for k in keys}
    nodes = set(keys) | set(edges.values())
    cheap = {}
    for s in nodes:
        at, total = s, 0.0
        while (s, at) not in cheap:
            cheap[s, at] = total
            if at not in edges:
                break
            total += (at + edges[at]) % 7 + 1
            at = edges[at]
    got = {(r.source, r.node): r.cost for r in run(spark, "shortest_paths", str(tmp_path)).collect()}
    assert got == cheap
    near = {n: {n} for n in nodes}
    for a, b in edges.items():
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in nodes:
        reached = {s}
        want[s, s] = 0
        for k in (1, 2, 3):
            fresh = {m for n in reached for m in near[n]} - reached
            want.update({(s, n): k for n in fresh})
            reached |= fresh
    assert {(r.source, r.node): r.hops for r in run(spark, "k_hop_distances", str(tmp_path)).collect()} == want


def test_sequences_take_every_event(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    last = {u: (g.event_id.tolist()[-6:] + [-1] * 6)[:6] for u, g in e.groupby("user_id")}
    assert {r.user_id: r.padded for r in run(spark, "padded_sequences").collect()} == last
    seconds = {u: g.ts.dt.floor("s").astype("datetime64[s]").astype("int64").tolist() for u, g in e.groupby("user_id")}
    want = {(u, i, j): abs(a - b) for u, s in seconds.items() for i, a in enumerate(s, 1) for j, b in enumerate(s, 1)}
    assert {(r.user_id, r.i, r.j): r.gap for r in run(spark, "sequence_pairs").collect()} == want


def test_nearest_period_knows_every_order(spark, tmp_path):
    day = lambda s: pd.Timestamp(s).to_pydatetime()
    spark.createDataFrame([(1, day("2020-02-01")), (7, day("1995-02-01"))], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(day("2020-05-01"),)], "l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in run(spark, "nearest_period", str(tmp_path)).collect()] == [(2020 * 4 + 2, 2020 * 4 + 1)]


def test_no_query_claims_an_open_row():
    readme = (Path(__file__).resolve().parent.parent / "README.md").read_text()
    # rows that are open in part may be claimed for the part that is there
    listed = set(re.findall(r"\b[A-Z]\d+\b(?! in part)", readme.split("Open: ")[1].split("Quirks follow")[0]))
    assert "Open: K6 in part" in readme
    claims = {n: set(re.findall(r"\b[A-Z]\d+\b", (f.__doc__ or "").split(": ")[0])) & listed for n, f in registry.QUERIES.items()}
    assert not {n: c for n, c in claims.items() if c}
