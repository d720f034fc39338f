"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import SPACE_CLASS, prefix_sums, stored, word_count

#: Weights dealt to the sources in the order of their names, again and again.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """Targets in words per source, and the total budget.

    ``sizes`` has one row (source, source_size) per source. Sources in code point order, null last, weigh
    ``weights`` in turn and share the sum of all sizes; a target stops at ``epochs`` times its source's size and the
    excess is shared again by weight. With sources in the order of cap over weight, a source is capped if its share of
    what the capped sources before it leave is at least its cap, so one pass of prefix sums gives the fixed point.
    """
    ranked = prefix_sums(sizes, [F.col("source").asc_nulls_last()], {}, "mix-sources")
    deal = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.get(deal, (F.col("rank") % len(weights)).cast("int")).cast("long"))
    ranked = stored(
        ranked.withColumnRenamed("rank", "source_rank").withColumn("cap", F.col("source_size") * epochs), "mix-weights"
    )
    total, weight = ranked.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    ratio = F.col("cap").cast("double") / F.col("weight")
    filled = prefix_sums(
        ranked, [ratio, F.col("source_rank")], {"cap": F.col("cap"), "weight": F.col("weight")}, "mix-fill"
    )
    left = F.lit(total).cast("double") - F.col("before_cap")
    filled = filled.withColumn(
        "capped",
        F.col("cap").cast("double") * (F.lit(weight).cast("double") - F.col("before_weight"))
        <= F.col("weight").cast("double") * left,
    )
    filled = stored(filled.drop("rank", "before_cap", "before_weight"), "mix-capped")
    used, shared = filled.agg(
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)),
    ).first()
    level = (total - used) / shared if shared else 0.0
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return filled.withColumn("target", target), int(total)


def _mix(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: str) -> DataFrame:
    """Per row doc_id, source, text_hash, size, source_size, target, copies (whole ones) and part (words of one more)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("place"), F.xxhash64("text").alias("text_hash"))
    base = stored(base, "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets, total = source_targets(sizes, weights, epochs)
    targets = stored(targets.select("source", "source_rank", "source_size", "target"), "mix-targets")

    order = [F.col("source").asc_nulls_last(), F.col("place"), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    laid = prefix_sums(base, order, {"size": F.col("size")}, "mix-shuffle")
    starts = prefix_sums(targets, [F.col("source_rank")], {"source": F.col("source_size")}, "mix-starts").drop("rank")
    laid = stored(
        laid.withColumnRenamed("source", "_source")
        .join(starts, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("before", F.col("before_size") - F.col("before_source"))
        .select("doc_id", "source", "text_hash", "size", "source_size", "target", F.col("rank").alias("at"), "before"),
        "mix-laid",
    )

    served = F.col("epoch") * F.col("source_size") + F.col("before")
    due = F.round("target").cast("long") - F.col("served")
    copies = (
        laid.where((F.col("size") > 0) & (F.col("target") > 0))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
        .withColumn("served", served)
        .where(due > 0)
        .select("at", "epoch", "size", F.least("size", due).alias("due"), ((F.col("served") + F.col("size")).cast("double") / F.col("target")).alias("finish"))
    )
    queue = prefix_sums(copies, [F.col("finish"), F.col("at"), F.col("epoch")], {"q": F.col("due")}, "mix-queue")
    words = F.least("due", F.greatest(F.lit(0), F.lit(total) - F.col("before_q")))
    taken = queue.groupBy(F.col("at").alias("_at")).agg(
        F.count_if(words == F.col("size")).alias("copies"), F.sum(F.when(words < F.col("size"), words)).alias("part")
    )
    zero = F.lit(0).cast("long")
    return laid.join(taken, F.col("at") == F.col("_at"), "left").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("copies", zero).alias("copies"), F.coalesce("part", zero).alias("part")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` needs doc_id, source and text; other columns are ignored. Inside its source every document has a place
    in a shuffle (md5 of seed and id). A copy's virtual finish time is the words of its source up to and with it,
    over all epochs, divided by the source's target. All copies are range-sorted by that time and taken while the
    running total stays within the budget, the sum of all sizes. When the budget ends, at virtual time 1, one copy of
    each source is under way: the queue has served it as many words as its source's target (rounded) has left for it,
    so that a source comes near its target however long its documents are.

    Defined cases: a null text has size 0; null sources form one source, the last; a null id takes its place by the
    id's empty string; rows that repeat are documents of their own; texts of size 0 are never taken (``copies`` 0,
    ``taken`` 0); an empty table gives no rows. Memory: a row's text and its words; texts are never shuffled here.

    Returns doc_id, source, size, source_size, target, copies (whole ones), part (words of one more), taken. Reruns give
    the same rows.
    """
    taken = F.col("copies") * F.col("size") + F.col("part")
    return _mix(docs, weights, epochs, seed).drop("text_hash").withColumn("taken", taken)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{SPACE_CLASS}]+|[^{SPACE_CLASS}]+"), F.lit(0))
    lead = F.rlike(text, F.lit(f"\\A[{SPACE_CLASS}]")).cast("int")
    return F.array_join(F.slice(pieces, 1, (2 * n - 1 + lead).cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    A copy that is taken in part holds the text up to its last word taken; there is one for each source at most. Rows
    that share an id, source and text share the copies of their group, as evenly as whole copies can be shared.
    """
    kinds = (
        _mix(docs, weights, epochs, seed)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum("copies").alias("copies"), F.max("part").alias("part"), F.count(F.lit(1)).alias("rows"))
        .where("copies > 0 or part > 0")
    )
    picks = stored(kinds.toDF("i", "s", "h", "copies", "part", "rows"), "mix-picks")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("text").alias("hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("i")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("h"))
    dealt = packed.join(picks, same).drop("hash")
    if not picks.where("rows > 1").isEmpty():
        # Rows that repeat are ranked without gathering a group: globally, minus the rank of the group's first row.
        group = [F.col("i"), F.col("s"), F.col("h")]
        several = dealt.where("rows > 1").withColumn("n", F.monotonically_increasing_id())
        ranked = stored(prefix_sums(several, [*group, F.col("n")], {}, "mix-repeated"), "mix-ranked")
        first = ranked.groupBy(*group).agg(F.min("rank").alias("first")).toDF("gi", "gs", "gh", "first")
        met = F.col("i").eqNullSafe(F.col("gi")) & F.col("s").eqNullSafe(F.col("gs")) & (F.col("h") == F.col("gh"))
        several = ranked.join(first, met).withColumn("place", F.col("rank") - F.col("first")).drop("n", "rank", "gi", "gs", "gh", "first")
        dealt = dealt.where("rows = 1").withColumn("place", F.lit(0).cast("long")).unionByName(several)
    else:
        dealt = dealt.withColumn("place", F.lit(0).cast("long"))
    extra = F.col("copies") % F.col("rows")
    whole = (F.floor(F.col("copies") / F.col("rows")) + (F.col("place") < extra).cast("int")).cast("int")
    cut = (F.col("place") == extra) & (F.col("part") > 0)
    times = F.when(cut, F.sequence(F.lit(0), whole)).when(whole > 0, F.sequence(F.lit(1), whole))
    taken = dealt.withColumn("copy", F.explode(times))
    text = F.when(F.col("copy") > 0, F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("part")))
    return taken.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
