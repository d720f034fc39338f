"""Queries: scores of facts, negative samples, losses, embedding initialisation and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import metrics as M
from orrery.functions import vectors as V
from orrery.operators import ranking as R
from orrery.plans.bridge import FACTS, facts
from orrery.plans.q_ranking import _VEC, label_means, vectors
from orrery.registry import query
from orrery.sources.tables import table

# Every vector is a head, its label's mean the relation (rotation, scaling, context), the mean backwards its translation,
# and the vector seven places on the tail.
_FACTS = f"""{_VEC}, q AS (SELECT a.vec_id, a.label, a.e AS h, rel.r AS r, list_reverse(rel.r) AS s, b.e AS t, len(a.e) AS n
  FROM v a JOIN rel ON a.label = rel.label JOIN v b ON b.vec_id = (a.vec_id + 7) % (SELECT count(*) FROM v)),
turned AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i % 2 = 1
      THEN (r[i] * h[i] - r[i + 1] * h[i + 1]) / sqrt(r[i] * r[i] + r[i + 1] * r[i + 1])
      ELSE (r[i] * h[i - 1] + r[i - 1] * h[i]) / sqrt(r[i] * r[i] + r[i - 1] * r[i - 1]) END) AS rot,
    list_transform(range(1, n + 1), lambda i: CASE WHEN i % 2 = 1
      THEN (r[i] * h[i] + r[i + 1] * h[i + 1]) / sqrt(r[i] * r[i] + r[i + 1] * r[i + 1])
      ELSE (r[i] * h[i - 1] - r[i - 1] * h[i]) / sqrt(r[i] * r[i] + r[i - 1] * r[i - 1]) END) AS ref FROM q),
weighed AS (SELECT *, list_dot_product(r, ref) / sqrt(n) AS wf, list_dot_product(r, rot) / sqrt(n) AS wt FROM turned),
att AS (SELECT *, list_transform(list_zip(ref, rot), lambda z: (exp(wf - greatest(wf, wt)) * z[1] + exp(wt - greatest(wf, wt)) * z[2]) / (exp(wf - greatest(wf, wt)) + exp(wt - greatest(wf, wt)))) AS mixed FROM weighed)"""


def _gap(x: str) -> str:
    """SQL: minus the squared distance of x + s to t."""
    return f"round(-list_sum(list_transform(list_zip({x}, s, t), lambda z: power(z[1] + z[2] - z[3], 2))), 4) + 0.0"


def scored_facts(spark, d):
    """(vec_id, label, h, r, s, t): one fact per vector, see above."""
    v = vectors(spark, d)
    n = v.agg(F.count(F.lit(1)).alias("n"))
    tail = v.select(F.col("vec_id").alias("tail"), F.col("e").alias("t"))
    j = v.join(F.broadcast(n)).withColumn("tail", (F.col("vec_id") + 7) % F.col("n")).join(label_means(v), "label").join(tail, "tail")
    return j.select("vec_id", "label", F.col("e").alias("h"), "r", F.reverse("r").alias("s"), "t")


@query(
    "euclidean_scores",
    f"""WITH {_FACTS} SELECT vec_id, round(list_dot_product(list_transform(list_zip(h, r), lambda z: z[1] * z[2]), t), 4) + 0.0 AS cp,
  {_gap("list_transform(list_zip(h, r), lambda z: z[1] * z[2])")} AS mur, {_gap("rot")} AS rot, {_gap("ref")} AS ref, {_gap("mixed")} AS att FROM att""",
)
def euclidean_scores(spark, d):
    """Canonical, scaled, rotated, reflected and attended heads, translated, against their tails."""
    f = scored_facts(spark, d)
    h, r, s, t = (F.col(c) for c in "hrst")
    away = lambda x: F.round(-V.squared_distance(V.plus(x, s), t), 4) + F.lit(0.0)
    mixed = V.attended([V.givens_reflection(r, h), V.givens(r, h)], r)
    return f.select(
        "vec_id",
        (F.round(V.dot(V.hadamard(h, r), t), 4) + F.lit(0.0)).alias("cp"),
        away(V.hadamard(h, r)).alias("mur"),
        away(V.givens(r, h)).alias("rot"),
        away(V.givens_reflection(r, h)).alias("ref"),
        away(mixed).alias("att"),
    )


@query(
    "complex_scores",
    f"""WITH {_FACTS}, c AS (SELECT *, list_transform(range(1, n // 2 + 1), lambda i: sqrt(r[i] * r[i] + r[i + n // 2] * r[i + n // 2])) AS size FROM q)
SELECT vec_id, round(list_sum(list_transform(range(1, n // 2 + 1), lambda i: (h[i] * r[i] - h[i + n // 2] * r[i + n // 2]) * t[i] + (h[i] * r[i + n // 2] + h[i + n // 2] * r[i]) * t[i + n // 2])), 4) + 0.0 AS complex,
  round(list_sum(list_transform(range(1, n // 2 + 1), lambda i: ((h[i] * r[i] - h[i + n // 2] * r[i + n // 2]) * t[i] + (h[i] * r[i + n // 2] + h[i + n // 2] * r[i]) * t[i + n // 2]) / size[i])), 4) + 0.0 AS rotate FROM c""",
)
def complex_scores(spark, d):
    """K2: complex products with relations as they are and with relations of modulus one."""
    h, r, t = (F.col(c) for c in "hrt")
    return scored_facts(spark, d).select(
        "vec_id",
        (F.round(V.hermitian(h, r, t), 4) + F.lit(0.0)).alias("complex"),
        (F.round(V.hermitian(h, V.unit_phases(r), t), 4) + F.lit(0.0)).alias("rotate"),
    )


@query(
    "temporal_complex_scores",
    f"""WITH {_FACTS}, a AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i <= n // 2 THEN r[i] * s[i] - r[i + n // 2] * s[i + n // 2] ELSE r[i - n // 2] * s[i] + r[i] * s[i - n // 2] END) AS rt FROM q),
b AS (SELECT *, list_transform(list_zip(rt, r), lambda z: z[1] + z[2]) AS pair FROM a),
c AS (SELECT vec_id, t, list_transform(range(1, n + 1), lambda i: CASE WHEN i <= n // 2 THEN h[i] * rt[i] - h[i + n // 2] * rt[i + n // 2] ELSE h[i - n // 2] * rt[i] + h[i] * rt[i - n // 2] END) AS x,
  list_transform(range(1, n + 1), lambda i: CASE WHEN i <= n // 2 THEN h[i] * pair[i] - h[i + n // 2] * pair[i + n // 2] ELSE h[i - n // 2] * pair[i] + h[i] * pair[i - n // 2] END) AS y FROM b)
SELECT vec_id, round(list_dot_product(x, t), 4) + 0.0 AS timed, round(list_dot_product(y, t), 4) + 0.0 AS mixed FROM c""",
)
def temporal_complex_scores(spark, d):
    """K4: complex scores whose relation is turned by the time, alone or beside the timeless relation."""
    h, r, s, t = (F.col(c) for c in "hrst")
    f = scored_facts(spark, d).select("vec_id", "h", "r", "t", V.complex_product(r, s).alias("rt"))
    both = V.plus(F.col("rt"), F.col("r"))
    score = lambda rel: F.round(V.hermitian(h, rel, t), 4) + F.lit(0.0)
    return f.select("vec_id", "h", "t", "rt", both.alias("both")).select("vec_id", score(F.col("rt")).alias("timed"), score(F.col("both")).alias("mixed"))


# The ball's operations as SQL over a row's lists x and y (curvature 1): maps to it and Moebius sums.
def _exp(x: str) -> str:
    return f"list_transform({x}, lambda u: u * tanh(sqrt(list_dot_product({x}, {x}))) / sqrt(list_dot_product({x}, {x})))"


def _sum(x: str, y: str) -> str:
    xx, yy, xy = f"list_dot_product({x}, {x})", f"list_dot_product({y}, {y})", f"list_dot_product({x}, {y})"
    return f"list_transform(list_zip({x}, {y}), lambda z: ((1 + 2 * {xy} + {yy}) * z[1] + (1 - {xx}) * z[2]) / greatest(1 + 2 * {xy} + {xx} * {yy}, 1e-15))"


def _pull(x: str) -> str:
    n = f"sqrt(list_dot_product({x}, {x}))"
    return f"CASE WHEN {n} > 1 - 1e-5 THEN list_transform({x}, lambda u: u / {n} * (1 - 1e-5)) ELSE {x} END"


def _turn(r: str, x: str) -> str:
    return (
        f"list_transform(range(1, n + 1), lambda i: CASE WHEN i % 2 = 1 THEN ({r}[i] * {x}[i] - {r}[i + 1] * {x}[i + 1]) / sqrt({r}[i] * {r}[i] + {r}[i + 1] * {r}[i + 1]) "
        f"ELSE ({r}[i] * {x}[i - 1] + {r}[i - 1] * {x}[i]) / sqrt({r}[i] * {r}[i] + {r}[i - 1] * {r}[i - 1]) END)"
    )


_SMALL = """list_transform({0}, lambda u: u / 4)"""
_BALL = f"""{_FACTS}, b0 AS (SELECT vec_id, n, r, ref, rot, mixed, {_SMALL.format("h")} AS h, {_SMALL.format("r")} AS p, {_SMALL.format("s")} AS s, {_SMALL.format("t")} AS t,
    {_SMALL.format("ref")} AS ref4, {_SMALL.format("mixed")} AS mixed4 FROM att),
b1 AS (SELECT vec_id, n, r, {_exp("h")} AS h, {_exp("p")} AS p, {_exp("s")} AS s, {_exp("t")} AS t, {_exp("ref4")} AS ref, {_exp("mixed4")} AS mixed, list_transform(rot, lambda u: u / 4) AS rot FROM b0),
b2 AS (SELECT *, {_sum("h", "p")} AS hp, {_sum("ref", "p")} AS refp, {_sum("mixed", "p")} AS attp FROM b1),
b3 AS (SELECT *, {_pull("hp")} AS hpp, {_pull("refp")} AS q_ref, {_pull("attp")} AS q_att FROM b2),
b4 AS (SELECT *, {_turn("r", "hpp")} AS turned FROM b3),
b5 AS (SELECT *, {_sum("turned", "s")} AS q_rot, list_dot_product(r, turned) / sqrt(n) AS w1, list_dot_product(r, rot) / sqrt(n) AS w2 FROM b4),
b6 AS (SELECT *, list_transform(list_zip(turned, rot), lambda z: (2 * exp(w1 - greatest(w1, w2)) * z[1] + exp(w2 - greatest(w1, w2)) * z[2]) / (2 * exp(w1 - greatest(w1, w2)) + exp(w2 - greatest(w1, w2)))) AS three FROM b5),
b7 AS (SELECT *, {_exp("three")} AS inside FROM b6), b8 AS (SELECT *, {_sum("inside", "p")} AS sum3 FROM b7), b9 AS (SELECT *, {_pull("sum3")} AS q_gie FROM b8),
b10 AS (SELECT *, list_transform(q_rot, lambda u: -u) AS m1, list_transform(q_ref, lambda u: -u) AS m2, list_transform(q_att, lambda u: -u) AS m3, list_transform(q_gie, lambda u: -u) AS m4 FROM b9),
b11 AS (SELECT vec_id, {_sum("m1", "t")} AS d1, {_sum("m2", "t")} AS d2, {_sum("m3", "t")} AS d3, {_sum("m4", "t")} AS d4 FROM b10)"""


def _away(x: str) -> str:
    return f"round(-power(2 * atanh(least(sqrt(list_dot_product({x}, {x})), 1 - 1e-5)), 2), 4) + 0.0"


@query("ball_scores", f"WITH {_BALL} SELECT vec_id, {_away('d1')} AS rot, {_away('d2')} AS ref, {_away('d3')} AS att, {_away('d4')} AS gie FROM b11")
def ball_scores(spark, d):
    """Rotated, reflected, attended and mixed heads on the Poincare ball, minus squared distances to the tails.

    Vectors are scaled by a quarter first, so that distances keep digits; both curvatures of the mixed score are one.
    """
    f = scored_facts(spark, d)
    quarter = lambda c: F.transform(c, lambda u: u / 4)
    r = F.col("r")
    f = f.select(
        "vec_id",
        "r",
        *[V.exp_map_zero(quarter(F.col(c)), 1.0).alias(n) for c, n in (("h", "x"), ("r", "p"), ("s", "y"), ("t", "z"))],
        V.exp_map_zero(quarter(V.givens_reflection(r, F.col("h"))), 1.0).alias("ref"),
        V.exp_map_zero(quarter(V.attended([V.givens_reflection(r, F.col("h")), V.givens(r, F.col("h"))], r)), 1.0).alias("mixed"),
        quarter(V.givens(r, F.col("h"))).alias("rot"),
    )
    met = lambda x, y: V.projected(V.mobius_add(F.col(x), F.col(y), 1.0), 1.0)
    f = f.select("vec_id", "r", "p", "y", "z", "rot", V.givens(r, met("x", "p")).alias("turned"), met("ref", "p").alias("q_ref"), met("mixed", "p").alias("q_att"))
    f = f.select("*", V.mobius_add(F.col("turned"), F.col("y"), 1.0).alias("q_rot"), V.attended([F.col("turned"), F.col("turned"), F.col("rot")], r).alias("three"))
    f = f.withColumn("inside", V.exp_map_zero(F.col("three"), 1.0))
    f = f.select("vec_id", "z", "q_rot", "q_ref", "q_att", met("inside", "p").alias("q_gie"))
    away = lambda q: V.let(V.hyperbolic_distance(F.col(q), F.col("z"), 1.0), lambda x: -x * x)
    return f.select("vec_id", *[(F.round(away(f"q_{n}"), 4) + F.lit(0.0)).alias(n) for n in ("rot", "ref", "att", "gie")])


@query(
    "plane_scores",
    f"""WITH {_FACTS}, w AS (SELECT *, list_dot_product(h, s) / list_dot_product(s, s) AS kh, list_dot_product(r, s) / list_dot_product(s, s) AS kr, list_dot_product(t, s) / list_dot_product(s, s) AS kt FROM q)
SELECT vec_id, round(-list_sum(list_transform(list_zip(h, r, t, s), lambda z: abs(z[1] - kh * z[4] + z[2] - kr * z[4] - z[3] + kt * z[4]))), 4) + 0.0 AS hyte,
  round(-list_sum(list_transform(list_zip(h, r, t), lambda z: abs(z[1] + z[2] - z[3]))), 4) + 0.0 AS transe FROM w""",
)
def plane_scores(spark, d):
    """K6: translations of vectors projected off a time's normal, and plain ones, by absolute differences."""
    h, r, s, t = (F.col(c) for c in "hrst")
    apart = lambda a, b, c: F.round(-V.total(F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda z: F.abs(z["a"] + z["b"] - z["c"]))), 4) + F.lit(0.0)
    f = scored_facts(spark, d).select("vec_id", "h", "r", "t", *[V.off_plane(x, s).alias(f"{n}_p") for x, n in ((h, "h"), (r, "r"), (t, "t"))])
    return f.select("vec_id", apart(F.col("h_p"), F.col("r_p"), F.col("t_p")).alias("hyte"), apart(h, r, t).alias("transe"))


@query(
    "pair_gadgets",
    f"""WITH {_VEC}, {FACTS}, t AS (SELECT DISTINCT head, relation, start_date AS day FROM facts),
p AS (SELECT a.head, a.relation AS r1, a.day, b.relation AS r2, a.day - b.day AS lag FROM t a JOIN t b ON a.head = b.head AND a.relation < b.relation),
s AS (SELECT r1, r2, avg(lag) AS m, greatest(var_pop(lag), 0.01) AS v, count(*) AS n FROM p GROUP BY 1, 2),
best AS (SELECT head, r1 AS relation, day, max(CASE WHEN n >= 20 THEN exp(-power(lag - m, 2) / (2 * v)) - 0.5 * exp(-abs(lag - m) / sqrt(v)) END) AS pair FROM p JOIN s USING (r1, r2) GROUP BY 1, 2, 3),
g AS (SELECT *, day - lag(day) OVER (PARTITION BY head, relation ORDER BY day) AS gap FROM t),
c AS (SELECT relation, avg(gap) AS m, greatest(var_pop(gap), 0.01) AS v FROM g GROUP BY 1)
SELECT g.relation, count(*) AS facts, count(gap) AS recurrent, round(avg(coalesce(pair, 0)), 4) AS pair, round(avg(coalesce(exp(-power(gap - m, 2) / (2 * v)), 0)), 4) AS recurring,
  round(avg(coalesce(pair, 0) + coalesce(exp(-power(gap - m, 2) / (2 * v)), 0)), 4) AS total
FROM g JOIN c ON c.relation = g.relation LEFT JOIN best b ON b.head = g.head AND b.relation = g.relation AND b.day = g.day GROUP BY 1""",
)
def pair_gadgets(spark, d):
    """K5, K7: what relations that usually precede or recur add to a fact's score: densities of lags, masked by support."""
    from pyspark.sql import Window as W

    t = facts(spark, d).select("head", "relation", F.col("start_date").alias("day")).distinct()
    b = t.select("head", F.col("relation").alias("r2"), F.col("day").alias("day2"))
    p = t.join(b, "head").where("relation < r2").select("head", F.col("relation").alias("r1"), "day", "r2", F.datediff("day", "day2").alias("lag"))
    s = p.groupBy("r1", "r2").agg(F.avg("lag").alias("m"), F.greatest(F.var_pop("lag"), F.lit(0.01)).alias("v"), F.count(F.lit(1)).alias("n"))
    away = F.col("lag") - F.col("m")
    pair = F.exp(-away * away / (2 * F.col("v"))) - 0.5 * F.exp(-F.abs(away) / F.sqrt("v"))
    best = p.join(F.broadcast(s), ["r1", "r2"]).groupBy("head", F.col("r1").alias("relation"), "day").agg(F.max(F.when(F.col("n") >= 20, pair)).alias("pair"))
    g = t.withColumn("gap", F.datediff("day", F.lag("day").over(W.partitionBy("head", "relation").orderBy("day"))))
    c = g.groupBy("relation").agg(F.avg("gap").alias("m"), F.greatest(F.var_pop("gap"), F.lit(0.01)).alias("v"))
    j = g.join(F.broadcast(c), "relation").join(best, ["head", "relation", "day"], "left")
    j = j.select(
        "relation", "gap", F.coalesce("pair", F.lit(0.0)).alias("pair"), F.coalesce(F.exp(-F.pow(F.col("gap") - F.col("m"), 2) / (2 * F.col("v"))), F.lit(0.0)).alias("again")
    )
    mean = lambda x: F.round(F.avg(x), 4)
    return j.groupBy("relation").agg(
        F.count(F.lit(1)).alias("facts"),
        F.count("gap").alias("recurrent"),
        mean(F.col("pair")).alias("pair"),
        mean(F.col("again")).alias("recurring"),
        mean(F.col("pair") + F.col("again")).alias("total"),
    )


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', '{0}', k, i)), 1, 8) AS BIGINT) % {1}"


@query(
    "negative_samples",
    f"""WITH n AS (SELECT (SELECT count(*) FROM part) AS tails, (SELECT count(*) FROM customer) AS heads),
base AS (SELECT o_orderkey AS k, o_custkey AS head, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS last_day FROM orders)
SELECT k, i, CASE WHEN i % 2 = 0 THEN head ELSE {_DRAW.format("head", "heads")} END AS head, {_DRAW.format("tail", "tails")} AS tail,
  {_DRAW.format("time", "96")} AS time_id, first_day + CAST({_DRAW.format("shift", "(last_day - first_day + 1)")} AS INT) AS day
FROM base, n, range(4) r(i)""",
)
def negative_samples(spark, d):
    """K9: per fact four corrupted ones (tails, every other one heads too), a drawn time and a day drawn inside its
    interval; draws are hashes of seed, key and turn, so they are the same in every run and every engine."""
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    base = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("h"), day.alias("first_day"), (F.col("o_orderkey") % 30 + 1).alias("days"))
    sizes = table(spark, d, "part").agg(F.count(F.lit(1)).alias("tails")).crossJoin(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("heads")))
    rows = base.crossJoin(F.broadcast(sizes)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("i"))
    draw = lambda seed, most: R.drawn(seed, ["k", "i"], most)
    return rows.select(
        "k",
        "i",
        F.when(F.col("i") % 2 == 0, F.col("h")).otherwise(draw("head", F.col("heads"))).alias("head"),
        draw("tail", F.col("tails")).alias("tail"),
        draw("time", F.lit(96)).alias("time_id"),
        F.date_add("first_day", draw("shift", F.col("days")).cast("int")).alias("day"),
    )


_PAIRS = "p AS (SELECT o_orderpriority AS g, ln(o_totalprice) / 4 - 2 AS pos, sin(o_orderkey) AS neg1, cos(o_orderkey) AS neg2 FROM orders)"


@query(
    "embedding_losses",
    f"""WITH {_PAIRS} SELECT g,
  round(-(avg(-ln(1 + exp(-pos))) + avg(-ln(1 + exp(neg1))) + avg(-ln(1 + exp(neg2)))) / 3, 4) AS bce,
  round(-avg(pos - ln(exp(pos) + exp(neg1) + exp(neg2))), 4) AS cross_entropy, round(-avg(pos - ln(exp(neg1) + exp(neg2))), 4) AS softmax,
  round(avg(ln(1 + exp(-pos)) + ln(1 + exp(neg1)) + ln(1 + exp(neg2))) / 3, 4) AS logistic,
  round(avg(pos + greatest(0, 5 - neg1) + greatest(0, 5 - neg2)) / 3, 4) AS hinge,
  round(avg(greatest(0, pos - neg1 + 10) + greatest(0, pos - neg2 + 10)), 4) AS margin FROM p GROUP BY 1""",
)
def embedding_losses(spark, d):
    """Losses of a positive score against two negative ones."""
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.log("o_totalprice") / 4 - 2).alias("pos"), F.sin(k).alias("neg1"), F.cos(k).alias("neg2"))
    m = M.pair_losses(F.col("pos"), [F.col("neg1"), F.col("neg2")])
    return p.groupBy("g").agg(*[F.round(c, 4).alias(n) for n, c in m.items()])


@query(
    "regularizers",
    f"""WITH {_FACTS}, f AS (SELECT label, n // 2 AS half, h, r FROM q),
sizes AS (SELECT label, list_transform(range(1, half + 1), lambda i: sqrt(h[i] * h[i] + h[i + half] * h[i + half])) AS a, list_transform(range(1, half + 1), lambda i: sqrt(r[i] * r[i] + r[i + half] * r[i + half])) AS b FROM f)
SELECT label, round(0.1 * avg(list_sum(list_transform(a, lambda x: x * x)) + list_sum(list_transform(b, lambda x: x * x))), 4) AS f2,
  round(0.1 * avg(list_sum(list_transform(a, lambda x: x * x * x)) + list_sum(list_transform(b, lambda x: x * x * x))), 4) AS n3 FROM sizes GROUP BY 1""",
)
def regularizers(spark, d):
    """Squared and cubed moduli of complex factors."""
    f = scored_facts(spark, d).select("label", V.moduli(F.col("h")).alias("a"), V.moduli(F.col("r")).alias("b"))
    power = lambda k: V.total(F.transform("a", lambda x: F.pow(x, k))) + V.total(F.transform("b", lambda x: F.pow(x, k)))
    return f.groupBy("label").agg(F.round(0.1 * F.avg(power(2)), 4).alias("f2"), F.round(0.1 * F.avg(power(3)), 4).alias("n3"))


@query(
    "initial_vectors",
    f"""WITH {_VEC}, a AS (SELECT vec_id * 2 AS id, e FROM v WHERE vec_id % 3 = 0), t AS (SELECT label, r FROM rel WHERE label < 5)
SELECT v.vec_id, CASE WHEN m.e IS NOT NULL THEN 'aligned' WHEN w.e IS NOT NULL THEN 'context' WHEN t.r IS NOT NULL THEN 'type' ELSE 'drawn' END AS kind,
  list_transform(coalesce(m.e, w.e, t.r, list_transform(range(1, len(v.e) + 1), lambda i: (CAST('0x' || substr(md5(concat_ws('|', 'init', v.vec_id, i - 1)), 1, 8) AS BIGINT) % 9973) / 9973.0 - 0.5)), lambda x: round(x, 4) + 0.0) AS init
FROM v LEFT JOIN a m ON m.id = v.vec_id LEFT JOIN v w ON w.vec_id = v.vec_id + 1 AND v.vec_id % 5 = 0 LEFT JOIN t ON t.label = v.label""",
)
def initial_vectors(spark, d):
    """A temporal entity's first vector: the aligned static one, else that of its context, else its type's, else drawn."""
    v = vectors(spark, d)
    aligned = v.where("vec_id % 3 = 0").select((F.col("vec_id") * 2).alias("vec_id"), F.col("e").alias("m"))
    context = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("w")).where("vec_id % 5 = 0")
    kind = label_means(v).where("label < 5").withColumnRenamed("r", "t")
    j = v.join(aligned, "vec_id", "left").join(context, "vec_id", "left").join(kind, "label", "left")
    draw = lambda i: R.drawn("init", ["vec_id", i], F.lit(9973)) / 9973.0 - 0.5
    drawn = F.transform(F.sequence(F.lit(0), F.size("e") - 1), draw)
    tried = F.coalesce("m", "w", "t", drawn)
    name = F.when(F.col("m").isNotNull(), "aligned").when(F.col("w").isNotNull(), "context").when(F.col("t").isNotNull(), "type").otherwise("drawn")
    return j.select("vec_id", name.alias("kind"), F.transform(tried, lambda x: F.round(x, 4) + F.lit(0.0)).alias("init"))


@query(
    "region_time_features",
    f"""WITH {_VEC}, g AS (SELECT vec_id, e FROM v WHERE label = 0), t AS (SELECT label, r FROM rel WHERE label > 6)
SELECT vec_id, label, list_transform(list_zip(e, r), lambda z: round(z[1] * z[2], 4) + 0.0) AS hadamard, list_transform(list_zip(e, r), lambda z: round(z[1] + z[2], 4) + 0.0) AS added, len(e) + len(r) AS width,
  round(list_sum(list_transform(range(1, len(e) // 2 + 1), lambda i: e[i] * r[i] - e[i + len(e) // 2] * r[i + len(e) // 2])), 4) + 0.0 AS real_part FROM g CROSS JOIN t""",
)
def region_time_features(spark, d):
    """Every region with every time: products, sums, width of the concatenation and the complex product's real part."""
    v = vectors(spark, d)
    g = v.where("label = 0").select("vec_id", "e")
    t = label_means(v).where("label > 6")  # the times: a few rows
    half = (F.size("e") / 2).cast("int")
    short = lambda c: F.transform(c, lambda x: F.round(x, 4) + F.lit(0.0))
    j = g.crossJoin(F.broadcast(t))
    return j.select(
        "vec_id",
        "label",
        short(V.hadamard(F.col("e"), F.col("r"))).alias("hadamard"),
        short(V.plus(F.col("e"), F.col("r"))).alias("added"),
        F.size(F.concat("e", "r")).cast("long").alias("width"),
        (F.round(V.total(F.slice(V.complex_product(F.col("e"), F.col("r")), F.lit(1), half)), 4) + F.lit(0.0)).alias("real_part"),
    )


@query(
    "exported_vectors",
    """WITH ids AS (SELECT c_custkey AS local, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3 END AS global FROM customer), w AS (SELECT max(len(embedding)) AS n FROM embeddings)
SELECT local, v.vec_id IS NOT NULL AS found, CASE WHEN v.vec_id IS NULL THEN list_resize([]::DOUBLE[], n, 0.0) ELSE list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4) + 0.0) END AS e
FROM ids CROSS JOIN w LEFT JOIN embeddings v ON v.vec_id = ids.global""",
)
def exported_vectors(spark, d):
    """Vectors selected by a table of local and global ids, zeros where there is none."""
    k = F.col("c_custkey")
    ids = table(spark, d, "customer").select(k.alias("local"), F.when(k % 2 == 0, k * 3).alias("vec_id"))
    v = vectors(spark, d).drop("label")
    width = v.agg(F.max(F.size("e")).alias("n"))
    j = ids.join(v, "vec_id", "left").crossJoin(F.broadcast(width))
    return j.select(
        "local", F.col("e").isNotNull().alias("found"), F.coalesce(F.transform("e", lambda x: F.round(x, 4) + F.lit(0.0)), F.array_repeat(F.lit(0.0), F.col("n"))).alias("e")
    )


@query(
    "gated_vectors",
    f"""WITH {_VEC}, g AS (SELECT label, 1 / (1 + exp(-label / 3.0)) AS gate FROM rel)
SELECT vec_id, list_transform(list_zip(e, r), lambda z: round(gate * z[1] + (1 - gate) * z[2], 4) + 0.0) AS summed,
  round(list_sum(list_transform(e, lambda x: gate * x)) - list_sum(list_transform(r, lambda x: (1 - gate) * x)), 4) + 0.0 AS parted FROM v JOIN rel USING (label) JOIN g USING (label)""",
)
def gated_vectors(spark, d):
    """Static and temporal vectors under a gate table, summed, and scaled halves of a concatenation."""
    v = vectors(spark, d)
    m = label_means(v).withColumn("gate", 1 / (1 + F.exp(-F.col("label") / 3.0)))
    j = v.join(m, "label")
    gate = F.col("gate")
    both = F.concat(V.scaled(F.col("e"), gate), V.scaled(F.col("r"), gate - 1))
    return j.select(
        "vec_id", F.zip_with("e", "r", lambda x, y: F.round(gate * x + (1 - gate) * y, 4) + F.lit(0.0)).alias("summed"), (F.round(V.total(both), 4) + F.lit(0.0)).alias("parted")
    )
