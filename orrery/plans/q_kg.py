"""Queries: knowledge graph construction, cleaning and statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import kg as K
from orrery.operators import order as O
from orrery.plans.bridge import FACTS, facts
from orrery.registry import query
from orrery.sources.shared import cut
from orrery.sources.tables import table

_STATIC = """static AS (
  SELECT 'customer::' || c_custkey AS head, 'CIN' AS relation, 'nation::' || c_nationkey AS tail FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'SIN', 'nation::' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation::' || n_nationkey, 'NIR', 'region::' || n_regionkey FROM nation)"""
_QUADS = f"""{FACTS}, {_STATIC}, quads AS (
  SELECT DISTINCT head, relation, tail, start_date, end_date FROM facts
  UNION SELECT head, relation, tail, NULL, NULL FROM static)"""


def quads(spark, d):
    """Facts of all emitters, each once: no two emitters share a relation, so each one's own duplicates are all there are."""
    return facts(spark, d, distinct=True).unionByName(K.union_facts(K.static_facts(spark, d)))


@query(
    "kg_statistics",
    f"""WITH {_QUADS}
SELECT relation, count(*) AS facts, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails,
  count(*) FILTER (WHERE start_date IS NULL) AS timeless, count(*) FILTER (WHERE start_date IS NOT NULL) AS temporal
FROM quads GROUP BY 1""",
)
def kg_statistics(spark, d):
    """Facts of all emitters, deduplicated, counted per relation."""
    q = cut(quads(spark, d).select("relation", "head", "tail", F.col("start_date").isNull().cast("long").alias("timeless")))
    heads = q.groupBy("relation", "head").agg(F.count(F.lit(1)).alias("n"), F.sum("timeless").alias("timeless"))
    heads = heads.groupBy("relation").agg(F.sum("n").alias("facts"), F.count(F.lit(1)).alias("heads"), F.sum("timeless").alias("timeless"))
    tails = q.select("relation", "tail").distinct().groupBy("relation").agg(F.count(F.lit(1)).alias("tails"))
    return heads.join(tails, "relation").select(
        "relation", "facts", "heads", "tails", "timeless", (F.col("facts") - F.col("timeless")).alias("temporal")
    )


@query(
    "kg_encoded",
    f"""WITH {_QUADS}, e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT head AS entity FROM quads UNION SELECT tail FROM quads)),
r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM quads))
SELECT h.id AS head_id, r.id AS relation_id, t.id AS tail_id, start_date, end_date
FROM quads q JOIN e h ON q.head = h.entity JOIN e t ON q.tail = t.entity JOIN r ON q.relation = r.relation""",
)
def kg_encoded(spark, d):
    """Dictionaries in code point order, three joins."""
    return K.encoded(cut(quads(spark, d)))


@query(
    "kg_split",
    f"""WITH {_QUADS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', head, relation, tail, CAST(start_date AS VARCHAR), CAST(end_date AS VARCHAR))), head, relation, tail) - 1 AS pos, count(*) OVER () AS n FROM quads)
SELECT CASE WHEN pos < round_even(n * 0.8, 0) THEN 'train' WHEN pos < round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'valid' ELSE 'test' END AS part,
  relation, count(*) AS n FROM ranked GROUP BY 1, 2""",
)
def kg_split(spark, d):
    """A fixed shuffle cut at 80 and 90 per cent."""
    q = quads(spark, d)
    key = O.hash_order("head", "relation", "tail", "start_date", "end_date")
    parts = O.chronological_split(q, [key, F.col("head"), F.col("relation"), F.col("tail")], 0.8, 0.1)
    return parts.groupBy("part", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kg_filters",
    f"""WITH {_QUADS}, twice AS (SELECT head, relation, tail FROM quads UNION SELECT tail, relation || '_r', head FROM quads)
SELECT head, relation, tail, row_number() OVER (PARTITION BY head, relation ORDER BY tail) - 1 AS place FROM twice""",
)
def kg_filters(spark, d):
    """Sorted answer sets of every (head, relation), reverse facts included.

    A row per answer with its place in the set: a nation's customers are no list that one task could hold. Places come
    from one global order, minus the place of the set's first row.
    """
    q = quads(spark, d).select("head", "relation", "tail")
    back = q.select(F.col("tail").alias("head"), F.concat("relation", F.lit("_r")).alias("relation"), F.col("head").alias("tail"))
    ranked = O.global_rank(q.unionByName(back).distinct(), ["head", "relation", "tail"], "rank")
    first = ranked.groupBy("head", "relation").agg(F.min("rank").alias("first"))
    return ranked.join(first, ["head", "relation"]).select("head", "relation", "tail", (F.col("rank") - F.col("first")).alias("place"))


@query(
    "relation_pair_lags",
    f"""WITH {FACTS}, t AS (SELECT DISTINCT head, relation, start_date AS day FROM facts)
SELECT a.relation AS r1, b.relation AS r2, count(*) AS n, round(avg(a.day - b.day), 3) AS mean,
  CASE WHEN count(*) >= 50 THEN round(greatest(var_pop(a.day - b.day), 0.01), 2) ELSE -1000 END AS var,
  round(quantile_cont(CAST(a.day - b.day AS DOUBLE), 0.1), 3) AS lo, round(quantile_cont(CAST(a.day - b.day AS DOUBLE), 0.9), 3) AS hi
FROM t a JOIN t b ON a.head = b.head AND (a.relation <> b.relation OR a.day <> b.day) GROUP BY 1, 2""",
)
def relation_pair_lags(spark, d):
    """Differences of days of two relations at one entity."""
    t = facts(spark, d).select("head", "relation", F.col("start_date").alias("day")).distinct()
    a, b = t.alias("a"), t.alias("b")
    lag = F.datediff("a.day", "b.day")
    j = a.join(b, (F.col("a.head") == F.col("b.head")) & ((F.col("a.relation") != F.col("b.relation")) | (F.col("a.day") != F.col("b.day"))))
    j = j.groupBy(F.col("a.relation").alias("r1"), F.col("b.relation").alias("r2"), lag.alias("lag")).agg(F.count(F.lit(1)).alias("k"))
    x, k = F.col("lag").cast("double"), F.col("k")  # lags are whole days, so a few thousand counts hold all pairs
    total = F.sum("k")
    mean = F.sum(x * k) / total
    return j.groupBy("r1", "r2").agg(
        total.alias("n"),
        F.round(mean, 3).alias("mean"),
        F.when(total >= 50, F.round(F.greatest(F.sum(x * x * k) / total - mean * mean, F.lit(0.01)), 2)).otherwise(-1000.0).alias("var"),
        F.round(F.percentile(x, 0.1, k), 3).alias("lo"),
        F.round(F.percentile(x, 0.9, k), 3).alias("hi"),
    )


@query(
    "recurrence_lags",
    f"""WITH {FACTS}, t AS (SELECT DISTINCT head, relation, start_date AS day FROM facts),
l AS (SELECT relation, day - lag(day) OVER (PARTITION BY head, relation ORDER BY day) AS gap FROM t)
SELECT relation, count(gap) AS n, round(avg(gap), 3) AS mean, round(var_pop(gap), 2) AS var FROM l GROUP BY 1""",
)
def recurrence_lags(spark, d):
    """Gaps between recurrences of a relation at an entity."""
    t = facts(spark, d).select("head", "relation", F.col("start_date").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("head", "relation").orderBy("day")))
    return t.select("relation", gap.alias("gap")).groupBy("relation").agg(
        F.count("gap").alias("n"), F.round(F.avg("gap"), 3).alias("mean"), F.round(F.var_pop("gap"), 2).alias("var")
    )


@query(
    "neighbour_facts",
    f"""WITH {_QUADS}, inc AS (SELECT head AS e, relation, tail AS other FROM quads UNION SELECT tail, relation || '_r', head FROM quads)
SELECT e, count(*) AS n, min(relation || '>' || other) AS first_fact FROM inc WHERE NOT (relation = 'CIN' AND other = 'nation::0') GROUP BY 1""",
)
def neighbour_facts(spark, d):
    """Incident facts of every entity without the one that is asked about."""
    inc = K.incident(quads(spark, d))
    asked = inc.where("relation = 'CIN' and other = 'nation::0'")
    left = inc.join(asked, ["e", "relation", "other"], "left_anti")
    return left.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(">", "relation", "other")).alias("first_fact"))


@query(
    "entity_parts",
    f"""WITH {_QUADS}, e AS (SELECT head AS entity FROM quads UNION SELECT tail FROM quads)
SELECT entity, split_part(entity, '::', 1) AS kind, try_cast(split_part(entity, '::', 2) AS BIGINT) AS raw_id FROM e""",
)
def entity_parts(spark, d):
    """Kind and raw id of an entity's name."""
    q = quads(spark, d)
    e = q.select(F.col("head").alias("entity")).union(q.select("tail")).distinct()
    return e.select("entity", F.split_part("entity", F.lit("::"), F.lit(1)).alias("kind"), F.split_part("entity", F.lit("::"), F.lit(2)).try_cast("long").alias("raw_id"))


@query(
    "candidate_keys",
    """WITH asked AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) WHEN n_nationkey % 3 = 1 THEN ' ' || n_name ELSE 'x' || n_name END AS spelling FROM nation)
SELECT k, spelling, (SELECT n_nationkey FROM nation WHERE lower(n_name) = lower(trim(spelling))) AS resolved FROM asked""",
)
def candidate_keys(spark, d):
    """Several spellings in order, the first hit wins."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    asked = n.select(
        k.alias("k"),
        F.when(k % 3 == 0, F.lower("n_name")).when(k % 3 == 1, F.concat(F.lit(" "), "n_name")).otherwise(F.concat(F.lit("x"), "n_name")).alias("spelling"),
    )
    names = n.select(F.lower("n_name").alias("name"), k.alias("id"))
    s = F.col("spelling")
    return K.resolved(asked, ["k", "spelling"], [s, F.lower(s), F.lower(F.trim(s))], names)


@query(
    "distinct_lists",
    """SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS priorities, count(DISTINCT o_orderpriority) AS n,
  CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS only_status FROM orders GROUP BY 1""",
)
def distinct_lists(spark, d):
    """Sorted distinct lists, their size, the single value or null."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"),
        F.countDistinct("o_orderpriority").alias("n"),
        F.when(F.countDistinct("o_orderstatus") == 1, F.min("o_orderstatus")).alias("only_status"),
    )


@query(
    "recoded_categories",
    """SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'industry' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE 'other' END AS class,
  count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1""",
)
def recoded_categories(spark, d):
    """Categories grouped by a small dictionary."""
    pairs = [("AUTOMOBILE", "industry"), ("MACHINERY", "industry"), ("HOUSEHOLD", "home"), ("FURNITURE", "home")]
    words = spark.createDataFrame(pairs, "c_mktsegment string, class string")
    c = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    return (
        c.join(F.broadcast(words), "c_mktsegment", "left")
        .groupBy(F.coalesce("class", F.lit("other")).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))
    )


@query(
    "cleaned_rows",
    """SELECT c_custkey AS k, regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '_', 'g') AS clean, coalesce(CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) END, 'row_' || (row_number() OVER (ORDER BY c_custkey) - 1)) AS id
FROM customer WHERE c_nationkey NOT IN (1, 3) AND c_nationkey <= 20 AND c_acctbal BETWEEN -500 AND 9000""",
)
def cleaned_rows(spark, d):
    """Exclusions, ranges, normalised names, row keys where the key is missing."""
    c = table(spark, d, "customer").where(~F.col("c_nationkey").isin(1, 3) & (F.col("c_nationkey") <= 20) & F.col("c_acctbal").between(-500, 9000))
    c = O.global_rank(c.select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], "row")
    own = F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string"))
    return c.select(
        F.col("c_custkey").alias("k"),
        F.regexp_replace(F.lower(F.trim("c_name")), "[^a-z0-9]+", "_").alias("clean"),
        F.coalesce(own, F.concat(F.lit("row_"), F.col("row").cast("string"))).alias("id"),
    )


@query(
    "match_report",
    """SELECT count(*) AS total, count(o_custkey) AS matched, count(*) - count(o_custkey) AS unmatched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""",
)
def match_report(spark, d):
    """Matched and unmatched keys."""
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey")).distinct()
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("o_custkey").alias("matched"), F.count_if(F.col("o_custkey").isNull()).alias("unmatched")
    )


@query(
    "min_support",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 60) AND regexp_matches(event_type, 'c.?k|view')",
)
def min_support(spark, d):
    """Users with enough events, types by pattern."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    often = e.groupBy("user_id").count().where("count >= 60").select("user_id")
    return e.where(F.col("event_type").rlike("c.?k|view")).join(often, "user_id", "left_semi").select("event_id", "user_id")


@query(
    "first_per_key",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def first_per_key(spark, d):
    """The first row of a key; a partial minimum instead of a window."""
    o = table(spark, d, "orders")
    one = F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("one")
    return o.groupBy("o_custkey").agg(one).select("o_custkey", "one.o_orderkey", "one.o_totalprice")


@query(
    "pivot_counts",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS total FROM events GROUP BY 1""",
)
def pivot_counts(spark, d):
    """A2, A5: a pivot over known values and sums across its columns."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1)))
    p = p.na.fill(0)
    return p.withColumn("total", F.col("click") + F.col("view") + F.col("purchase"))


@query(
    "dominant_column",
    """WITH s AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS b, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS c FROM events GROUP BY 1)
SELECT user_id, CASE WHEN greatest(a, b, c) <= 0 THEN 'low_activity' WHEN a >= b AND a >= c THEN 'click' WHEN b >= c THEN 'view' ELSE 'purchase' END AS label FROM s""",
)
def dominant_column(spark, d):
    """A10: the column with the largest value, the earlier of equals, low activity if none is above zero."""
    v = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0))
    names = ("click", "view", "purchase")
    s = table(spark, d, "events").groupBy("user_id").agg(*[v(n).alias(n) for n in names])
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("v"), F.lit(-i).alias("p"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
    return s.select("user_id", F.when(best["v"] <= 0, "low_activity").otherwise(best["n"]).alias("label"))


@query(
    "grouping_sets",
    "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def grouping_sets(spark, d):
    """Rollup over a star join."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))
