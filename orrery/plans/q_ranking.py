"""Queries: scores, ranks, interval prediction, metrics, fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions import vectors as V
from orrery.operators import ranking as R
from orrery.operators import sequences as Q
from orrery.plans.bridge import FACTS, events, facts
from orrery.registry import query
from orrery.sources.tables import table

_VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2),
rel AS (SELECT label, list(x ORDER BY i) AS r FROM m GROUP BY 1)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("e"))


def label_means(v):
    """Mean vector per label: exploded by dimension, so partial sums leave every task."""
    long = v.select("label", F.posexplode("e").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("label", F.col("s.x").alias("r"))


@query(
    "label_mean_vectors",
    f"""WITH {_VEC} SELECT label, list_transform(r, lambda x: round(x, 4)) AS mean, (SELECT round(ln(1 + count(*)), 6) FROM v WHERE v.label = rel.label) AS log_count FROM rel""",
)
def label_mean_vectors(spark, d):
    """Mean vectors with log1p counts."""
    v = vectors(spark, d)
    n = v.groupBy("label").agg(F.round(F.log1p(F.count(F.lit(1))), 6).alias("log_count"))
    return label_means(v).join(n, "label").select("label", F.transform("r", lambda x: V.rounded(x, 4)).alias("mean"), "log_count")


_CAND = "SELECT a.vec_id AS h, a.label, a.e AS h_e, rel.r, b.vec_id AS t, b.e AS t_e, len(b.e) // 2 AS half FROM v a JOIN rel ON a.label = rel.label CROSS JOIN v b"


def _heads(spark, d):
    """Every vector as a head, with its relation (the mean of its label)."""
    v = vectors(spark, d)
    return v.select(F.col("vec_id").alias("h"), "label", F.col("e").alias("h_e")).join(label_means(v), "label")


#: Labels up to which the vectors of all are broadcast.
FEW_LABELS = 10_000


def _stored(spark, d):
    """Heads with their relation, and tails, with vectors as they are stored."""
    e = table(spark, d, "embeddings")
    means = label_means(vectors(spark, d))
    few = e.agg(F.count_distinct("label")).first()[0] <= FEW_LABELS
    heads = e.select(F.col("vec_id").alias("h"), "label", F.col("embedding").alias("h_e")).join(F.broadcast(means) if few else means, "label")
    return heads, e.select(F.col("vec_id").alias("t"), F.col("embedding").alias("t_e"))


def _tails(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("t"), F.col("e").alias("t_e"), F.col("label").alias("own"))


@query(
    "fact_scores",
    f"""WITH {_VEC}, c AS ({_CAND})
SELECT h, t, round(-sqrt(list_sum(list_transform(list_zip(h_e, r, t_e), lambda z: power(z[1] + z[2] - z[3], 2)))), 4) + 0.0 AS transe,
  round(list_sum(list_transform(list_zip(h_e, r, t_e), lambda z: z[1] * z[2] * z[3])), 4) + 0.0 AS distmult,
  round(list_sum(list_transform(range(1, half + 1), lambda i: (h_e[i] * r[i] - h_e[i + half] * r[i + half]) * t_e[i] + (h_e[i] * r[i + half] + h_e[i + half] * r[i]) * t_e[i + half])), 4) + 0.0 AS complex,
  round(-list_sum(list_transform(range(0, half), lambda i: power((r[2*i+1] * h_e[2*i+1] - r[2*i+2] * h_e[2*i+2]) / sqrt(r[2*i+1] * r[2*i+1] + r[2*i+2] * r[2*i+2]) - t_e[2*i+1], 2) + power((r[2*i+2] * h_e[2*i+1] + r[2*i+1] * h_e[2*i+2]) / sqrt(r[2*i+1] * r[2*i+1] + r[2*i+2] * r[2*i+2]) - t_e[2*i+2], 2))), 4) + 0.0 AS rote
FROM c""",
)
def fact_scores(spark, d):
    """Translation, product, complex and rotation scores of every head against every vector."""
    scorers = {
        "transe": lambda q, t: -np.sqrt(R.distances(q, t)),
        "distmult": lambda q, t: q @ t.T,
        "complex": lambda q, t: q @ t[:, : q.shape[1]].T,
        "rote": lambda q, t: -R.distances(q, t[:, : q.shape[1]]),
    }
    return R.block_scores(*_stored(spark, d), R.queries, scorers, 4)


_TO_BALL = "list_transform({0}, lambda u: u * tanh(sqrt(list_dot_product({0}, {0}))) / sqrt(list_dot_product({0}, {0})))"


@query(
    "hyperbolic_scores",
    f"""WITH {_VEC}, b AS (SELECT vec_id, {_TO_BALL.format("e")} AS x, {_TO_BALL.format("r")} AS y FROM v JOIN rel USING (label)),
s AS (SELECT *, list_dot_product(x, x) AS xx, list_dot_product(y, y) AS yy, list_dot_product(x, y) AS xy FROM b),
q AS (SELECT vec_id AS h, list_transform(list_zip(x, y), lambda z: ((1 + 2 * xy + yy) * z[1] + (1 - xx) * z[2]) / greatest(1 + 2 * xy + xx * yy, 1e-15)) AS q FROM s),
n AS (SELECT h, q, list_dot_product(q, q) AS qq FROM q), d AS (SELECT h, vec_id AS t, greatest(qq + xx - 2 * list_dot_product(q, x), 0) AS up, greatest(1 - 2 * list_dot_product(q, x) + qq * xx, 1e-15) AS under FROM n CROSS JOIN s)
SELECT h, t, round(-power(2 * atanh(least(sqrt(up / under), 1 - 1e-5)), 2), 4) + 0.0 AS score FROM d""",
)
def hyperbolic_scores(spark, d):
    """scores on the Poincare ball of every head against every vector."""
    queried = lambda h, r: {"score": R.ball_sums(R.on_ball(h), R.on_ball(r))}
    return R.block_scores(*_stored(spark, d), queried, {"score": R.ball_scores}, 4, placed=R.on_ball)


_SCORED = """scored AS (SELECT h, label, t, round(-sqrt(list_sum(list_transform(list_zip(h_e, r, t_e), lambda z: power(z[1] + z[2] - z[3], 2)))), 6) AS s, (h * 7 + 10) % (SELECT count(*) FROM v) // 5 * 5 + h % 5 AS target FROM c)"""


@query(
    "filtered_ranks",
    f"""WITH {_VEC}, c AS ({_CAND}), {_SCORED},
known AS (SELECT s.h, s.t FROM scored s JOIN v ON v.vec_id = s.t AND v.label = s.label),
ok AS (SELECT s.* FROM scored s WHERE t = target OR NOT EXISTS (SELECT 1 FROM known k WHERE k.h = s.h AND k.t = s.t)),
goal AS (SELECT h, s AS g FROM scored WHERE t = target)
SELECT goal.h, CAST(1 + count(*) FILTER (WHERE ok.t <> ok.target AND ok.s >= g) AS BIGINT) AS rank FROM goal JOIN ok ON ok.h = goal.h GROUP BY 1""",
)
def filtered_ranks(spark, d):
    """Pessimistic rank of every head among all vectors without known facts."""
    n = table(spark, d, "embeddings").count()
    target = (F.floor((F.col("h") * 7 + 10) % n / 5) * 5 + F.col("h") % 5) % n
    tails = _tails(spark, d)
    heads = _heads(spark, d).withColumn("target", target)
    goal = heads.join(tails, F.col("target") == F.col("t"))
    s = R.scores(F.col("h_e"), F.col("r"), F.col("t_e"))["transe"]
    goal = goal.select("h", "label", "target", V.plus(F.col("h_e"), F.col("r")).alias("q"), F.round(s, 6).alias("goal"))
    return R.block_ranks(goal, tails)


@query(
    "rank_metrics",
    """WITH r AS (SELECT user_id, rank() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2))
SELECT event_type, round(avg(rank), 4) AS mr, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INT)), 6) AS hits1, round(avg(CAST(rank <= 3 AS INT)), 6) AS hits3, round(avg(CAST(rank <= 10 AS INT)), 6) AS hits10,
  round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg10 FROM r GROUP BY 1""",
)
def rank_metrics(spark, d):
    """Rank metrics of users by type."""
    from pyspark.sql import Window as W

    g = table(spark, d, "events").groupBy("event_type", "user_id").count()
    r = g.withColumn("rank", F.rank().over(W.partitionBy("event_type").orderBy(F.desc("count"), "user_id")))
    places = {"mr": 4}
    dcg = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    return r.groupBy("event_type").agg(
        *[F.round(c, places.get(n, 6)).alias(n) for n, c in M.ranks(F.col("rank")).items()], F.round(dcg, 6).alias("dcg10")
    )


@query(
    "top_k_per_group",
    "SELECT event_type, user_id, CAST(place AS INT) AS place FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY sum(value) DESC, user_id) AS place FROM events GROUP BY 1, 2) WHERE place <= 5",
)
def top_k_per_group(spark, d):
    """Five best per group."""
    from orrery.operators.order import top_k

    g = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("s"))
    return top_k(g, ["event_type"], [F.desc("s"), F.col("user_id")], 5).select("event_type", "user_id", "place")


@query(
    "interval_scores",
    f"""WITH {FACTS}, p AS (SELECT relation, start_date - DATE '1990-01-01' AS c, end_date - DATE '1990-01-01' AS d, start_date - DATE '1990-01-01' + 5 AS a, end_date - DATE '1990-01-01' + 9 AS b FROM facts),
q AS (SELECT relation, greatest(least(b, d) - greatest(a, c) + 1, 0) AS i, b - a + 1 AS la, d - c + 1 AS lc, greatest(b, d) - least(a, c) + 1 AS hull FROM p)
SELECT relation, round(avg(i / (la + lc - i)), 4) AS iou, round(avg(greatest(i, 1) / hull), 4) AS ae_iou, round(avg(i / (la + lc - i) - (hull - (la + lc - i)) / hull), 4) AS giou, round(avg(i / la), 4) AS precision, round(avg(i / lc), 4) AS recall
FROM q GROUP BY 1""",
)
def interval_scores(spark, d):
    """Predicted intervals (shifted facts) graded against the true ones."""
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date"))
    f = facts(spark, d).select("relation", day("start_date").alias("c"), day("end_date").alias("d"))
    s = M.interval_scores(F.col("c") + 5, F.col("d") + 9, F.col("c"), F.col("d"))
    return f.groupBy("relation").agg(*[F.round(F.avg(c), 4).alias(n) for n, c in s.items()])


_PROB = "prob AS (SELECT event_type AS k, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS t, CAST(count(*) AS DOUBLE) AS p FROM events GROUP BY 1, 2)"


def _mass(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return events(spark, d).groupBy(F.col("event_type").alias("k"), day.alias("t")).agg(F.count(F.lit(1)).cast("double").alias("p"))


@query(
    "duration_windows",
    f"""WITH {_PROB}, j AS (SELECT a.k, a.t AS begin, a.t + s AS finish, round((SELECT sum(p) FROM prob b WHERE b.k = a.k AND b.t BETWEEN a.t AND a.t + s) / (s + 1), 6) AS mass
  FROM prob a, range(4) r(s) WHERE EXISTS (SELECT 1 FROM prob z WHERE z.k = a.k AND z.t = a.t + s))
SELECT k, begin, CAST(finish AS INT) AS finish, mass, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mass DESC, begin, finish) AS place FROM j) WHERE place <= 3""",
)
def duration_windows(spark, d):
    """Best windows of up to four days."""
    return R.duration_windows(_mass(spark, d), "k", "t", "p", 4, 3)


@query(
    "start_end_sweep",
    f"""WITH {_PROB}, j AS (SELECT a.k, a.t AS begin, b.t AS finish, round(a.p + b.p, 6) AS total FROM prob a JOIN prob b ON a.k = b.k AND a.t <= b.t)
SELECT k, begin, finish, total, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY total DESC, begin, finish) AS place FROM j) WHERE place <= 3""",
)
def start_end_sweep(spark, d):
    """Best pairs of start and end."""
    p = _mass(spark, d)
    return R.start_end_sweep(p, "k", "t", "p", "p", 3)


@query(
    "greedy_intervals",
    f"""WITH RECURSIVE {_PROB}, s AS (SELECT k, t, p, row_number() OVER (PARTITION BY k ORDER BY t) AS x FROM prob), tot AS (SELECT k, sum(p) AS whole FROM prob GROUP BY 1),
r AS (SELECT k, x AS i, x AS j, p AS mass, 0 AS step FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, x) AS rn FROM s) WHERE rn = 1
  UNION ALL SELECT r.k, CASE WHEN coalesce(l.p, -1) >= coalesce(u.p, -1) THEN i - 1 ELSE i END, CASE WHEN coalesce(l.p, -1) >= coalesce(u.p, -1) THEN j ELSE j + 1 END, mass + CASE WHEN coalesce(l.p, -1) >= coalesce(u.p, -1) THEN l.p ELSE u.p END, step + 1
  FROM r JOIN tot ON tot.k = r.k LEFT JOIN s l ON l.k = r.k AND l.x = i - 1 LEFT JOIN s u ON u.k = r.k AND u.x = j + 1 WHERE mass < 0.4 * whole AND (l.p IS NOT NULL OR u.p IS NOT NULL)),
z AS (SELECT k, arg_max(i, step) AS i, arg_max(j, step) AS j, max(mass) AS mass FROM r GROUP BY 1)
SELECT z.k, a.t AS begin, b.t AS finish, round(mass / whole, 6) AS mass FROM z JOIN tot USING (k) JOIN s a ON a.k = z.k AND a.x = i JOIN s b ON b.k = z.k AND b.x = j""",
)
def greedy_intervals(spark, d):
    """Intervals grown from the peak; sequential, so grouped pandas over one fact's short axis."""
    return Q.greedy_interval(_mass(spark, d), "k", "t", "p", 0.4).withColumn("mass", F.round("mass", 6))


_PRED = "p AS (SELECT o_orderpriority AS g, o_totalprice / 1000.0 AS y, o_totalprice / 1000.0 * (0.9 + (o_orderkey % 7) * 0.03) AS f FROM orders)"


def _pred(spark, d):
    y = F.col("o_totalprice") / 1000.0
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), y.alias("y"), (y * (0.9 + (F.col("o_orderkey") % 7) * 0.03)).alias("f"))


@query(
    "regression_metrics",
    f"""WITH {_PRED} SELECT g, round(avg(abs(f - y)), 3) AS mae, round(avg(power(f - y, 2)), 3) AS mse, round(sqrt(avg(power(f - y, 2))), 3) AS rmse, round(avg(abs((f - y) / y)), 4) AS mape,
  round(avg(2 * abs(f - y) / (abs(f) + abs(y))), 4) AS smape, round(1 - sum(power(f - y, 2)) / (var_pop(y) * count(y)), 4) AS r2, round(1 - var_pop(f - y) / var_pop(y), 4) AS evar FROM p GROUP BY 1""",
)
def regression_metrics(spark, d):
    """M1, M2, M9: masked regression metrics per group."""
    m = M.regression(F.col("f"), F.col("y"), F.col("y") != 0)
    places = {"mae": 3, "mse": 3, "rmse": 3}
    return _pred(spark, d).groupBy("g").agg(*[F.round(m[n], places.get(n, 4)).alias(n) for n in ("mae", "mse", "rmse", "mape", "smape", "r2", "evar")])


@query(
    "loss_values",
    f"""WITH {_PRED} SELECT g, round(avg(abs(y - f) + ln(1 + exp(-2 * abs(y - f))) - ln(2)), 4) AS log_cosh, round(avg(CASE WHEN abs(y - f) <= 1 THEN power(y - f, 2) / 2 ELSE abs(y - f) - 0.5 END), 4) AS huber,
  round(avg(greatest(0.25 * (y - f), -0.75 * (y - f))), 4) AS quantile FROM p GROUP BY 1""",
)
def loss_values(spark, d):
    """M4: losses as averages."""
    return _pred(spark, d).groupBy("g").agg(*[F.round(c, 4).alias(n) for n, c in M.losses(F.col("f"), F.col("y")).items()])


@query(
    "classification_metrics",
    f"""WITH {_PRED}, c AS (SELECT g, count(*) FILTER (WHERE f >= 100 AND y >= 95) AS tp, count(*) FILTER (WHERE f >= 100 AND y < 95) AS fp, count(*) FILTER (WHERE f < 100 AND y >= 95) AS fn, count(*) FILTER (WHERE f < 100 AND y < 95) AS tn FROM p GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS micro_f1, round((CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END) / 2, 6) AS macro_f1 FROM c""",
)
def classification_metrics(spark, d):
    """M3: confusion counts and F1 at thresholds."""
    m = M.f1(F.col("f") >= 100, F.col("y") >= 95)
    return _pred(spark, d).groupBy("g").agg(*[(F.round(c, 6) if n.endswith("f1") else c).alias(n) for n, c in m.items()])


@query(
    "softmax_candidates",
    """WITH s AS (SELECT event_type, user_id, avg(value) / 100 AS x FROM events GROUP BY 1, 2)
SELECT event_type, user_id, round(exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w), 6) AS p FROM s WINDOW w AS (PARTITION BY event_type)""",
)
def softmax_candidates(spark, d):
    """softmax over a group's candidates: two aggregates joined back, no window over a hot group."""
    s = table(spark, d, "events").groupBy("event_type", "user_id").agg((F.avg("value") / 100).alias("x"))
    m = s.groupBy("event_type").agg(F.max("x").alias("m"))
    z = s.join(m, "event_type").groupBy("event_type", "m").agg(F.sum(F.exp(F.col("x") - F.col("m"))).alias("z"))
    return s.join(z, "event_type").select("event_type", "user_id", F.round(F.exp(F.col("x") - F.col("m")) / F.col("z"), 6).alias("p"))


@query(
    "fused_embeddings",
    f"""WITH {_VEC} SELECT vec_id, CASE WHEN label % 2 = 0 THEN list_transform(list_zip(e, r), lambda z: round(0.7 * z[1] + 0.3 * z[2], 4)) ELSE list_transform(e, lambda x: round(x, 4)) END AS fused, len(e) + len(r) AS width
FROM v JOIN rel USING (label)""",
)
def fused_embeddings(spark, d):
    """Weighted sum where a mask allows it, else the static vector; width of the concatenation."""
    v = vectors(spark, d)
    j = v.join(label_means(v), "label")
    mixed = F.zip_with("e", "r", lambda x, y: V.let(0.7 * x + 0.3 * y, lambda z: V.rounded(z, 4)))
    alone = F.transform("e", lambda x: V.rounded(x, 4))
    return j.select(
        "vec_id", F.when(F.col("label") % 2 == 0, mixed).otherwise(alone).alias("fused"), (F.size("e") + F.size("r")).cast("long").alias("width")
    )


@query(
    "type_constrained_candidates",
    """SELECT c.c_custkey AS k, count(*) AS candidates FROM customer c JOIN supplier s ON s.s_suppkey % 10 = 0 OR s.s_nationkey = c.c_nationkey OR c.c_nationkey IS NULL GROUP BY 1""",
)
def type_constrained_candidates(spark, d):
    """Candidates of the right type; untyped ones (every tenth) always pass, and a customer without nation takes all.

    Counts per nation, and the untyped suppliers of the other nations from one aggregate: no pair is made.
    """
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    untyped = F.count_if(F.col("s_suppkey") % 10 == 0)
    n = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("own"), untyped.alias("untyped"))
    every = n.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in ("own", "untyped")])
    j = c.join(n, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(F.broadcast(every))
    found = F.coalesce(F.col("own") - F.col("untyped"), F.lit(0)) + F.col("all_untyped")
    return j.select("k", F.when(F.col("c_nationkey").isNull(), F.col("all_own")).otherwise(found).alias("candidates")).where("candidates > 0")


@query(
    "relation_thresholds",
    f"""WITH {FACTS}, t AS (SELECT relation, CAST(end_date - start_date AS DOUBLE) AS x FROM facts) SELECT relation, round(avg(x), 3) AS mean, round(median(x), 3) AS middle, round(avg(avg(x)) OVER (), 3) AS fallback FROM t GROUP BY 1""",
)
def relation_thresholds(spark, d):
    """Mean and median durations per relation, the mean of the means as fallback."""
    g = facts(spark, d).groupBy("relation").agg(
        F.avg(F.datediff("end_date", "start_date")).alias("m"), F.median(F.datediff("end_date", "start_date")).alias("q")
    )
    all_ = g.agg(F.round(F.avg("m"), 3).alias("fallback"))
    return g.join(F.broadcast(all_)).select("relation", F.round("m", 3).alias("mean"), F.round("q", 3).alias("middle"), "fallback")
