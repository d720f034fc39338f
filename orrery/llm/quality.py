"""Learned decision lists over text statistics (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import SPACE, private, stored

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window that may repeat.
WINDOW = 5
#: At most so many labelled documents are learnt from, those with the smallest hashes of their ids.
LABELLED = 20_000
#: Share of a rule's documents in the pruning set that must be labelled bad.
PRECISION = 0.95
#: Labelled documents in the growing set, bad ones, that a rule must cover.
SUPPORT = 3
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Quantiles of each class that serve as thresholds.
QUANTILES = [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _sorted_windows(keys: Column) -> Column:
    return F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(pairs: Column) -> Column:
    """Words in windows whose key occurs more than once, from all windows as (h, i) in order."""
    width = F.lit(WINDOW)

    def at(pair: Column, k: Column) -> Column:
        h = pair["h"]
        same = F.coalesce(h == F.get(pairs, k - 1)["h"], F.lit(False)) | F.coalesce(h == F.get(pairs, k + 1)["h"], F.lit(False))
        return F.when(same, pair["i"])

    return _let(
        F.sort_array(F.array_compact(F.transform(pairs, at))),
        lambda q: F.aggregate(
            F.transform(q, lambda x, k: F.least(width, F.coalesce(F.get(q, k + 1) - x, width))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )


def _collide(pairs: Column, ws: Column) -> Column:
    """Whether two neighbours of equal hash are windows of different words."""

    def differ(pair: Column, k: Column) -> Column:
        i, j = pair["i"], F.get(pairs, k + 1)["i"]
        same = F.lit(True)
        for n in range(WINDOW):
            same = same & (F.get(ws, i + n) == F.get(ws, j + n))
        return F.when(F.coalesce(pair["h"] == F.get(pairs, k + 1)["h"], F.lit(False)), ~same).otherwise(False)

    return F.exists(F.transform(pairs, differ), lambda x: x)


def _repeated_words(ws: Column) -> Column:
    """Words of ``ws`` in windows found twice or more: by hashes whose words are compared, and should two windows ever
    share a hash by chance, by the windows themselves."""
    starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    whole = F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, WINDOW), " "))

    def counted(h: Column) -> Column:
        some = _let(
            _sorted_windows(h), lambda pairs: F.when(_collide(pairs, ws), _let(_sorted_windows(whole), _covered)).otherwise(_covered(pairs))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    return _let(hashes, counted)


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts over a whole text (null: empty), each a long.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an earlier line),
    n_repeat_words (words in windows of five that occur again in the text), n_upper, n_marks (exclamation marks),
    n_lines (lines with a word).
    """
    text = F.coalesce(text, F.lit(""))
    flat = F.btrim(F.translate(text, SPACE, " " * len(SPACE)))
    words = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def per_words(ws: Column) -> Column:
        n = F.size(ws)
        return F.struct(
            n.cast("long").alias("n"),
            F.when(n > WINDOW, _repeated_words(ws)).otherwise(F.lit(0)).cast("long").alias("again"),
        )

    per_line = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")
        ),
    )
    return {
        "_words": _let(words, per_words),
        "_lines": per_line,
        "word_chars": F.char_length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS),
        "n_upper": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": _count(text, "!"),
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")


def with_statistics(docs: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """``columns`` of ``docs`` and the statistics of its text, their names after ``prefix``."""
    own = text_statistics(F.col("text"))
    names = dict(zip(own, private(docs, *own), strict=True))
    made = docs.select(*[docs[c] for c in columns], *[c.alias(names[n]) for n, c in own.items()])
    of = {
        "n_words": F.col(names["_words"])["n"],
        "n_repeat_words": F.col(names["_words"])["again"],
        "n_lines": F.col(names["_lines"])["n"],
        "n_dup_lines": F.col(names["_lines"])["again"],
    }
    return made.select(*columns, *[(of[n] if n in of else F.col(names[n])).alias(prefix + n) for n in STATISTICS])


def features(prefix: str = "") -> dict[str, Column]:
    """The numbers that rules put thresholds on."""
    c = {n: F.col(prefix + n).cast("double") for n in STATISTICS}
    words, lines, chars = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "n_lines", "word_chars"))
    return {
        "symbols_per_word": c["n_symbols"] / words,
        "repeated_words": c["n_repeat_words"] / words,
        "repeated_lines": c["n_dup_lines"] / lines,
        "upper_share": c["n_upper"] / chars,
        "marks_per_word": c["n_marks"] / words,
        "word_length": c["word_chars"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        f = of[self.feature]
        return f > F.lit(self.threshold) if self.above else f < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL gain of narrowing p0 bad and n0 good documents to p and n."""
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(
    labelled: DataFrame,
    precision: float = PRECISION,
    support: int = SUPPORT,
    max_rules: int = MAX_RULES,
    max_conditions: int = MAX_CONDITIONS,
) -> list[Rule]:
    """Sequential covering on ``labelled`` (doc_id, bad 0/1 and the statistics).

    Two thirds of the documents, by hash of their ids, grow rules: of all thresholds (quantiles of either class) the one
    with the largest FOIL gain is added, moved half-way to the nearest bad document, until no good document is covered. The last third prunes each rule to the prefix
    with the best (bad - good) / (bad + good), and it is kept only if enough of what it covers there is bad. What a kept
    rule covers is set aside and the next one is grown. Every count is one grouped aggregation; the driver sees at most
    features x thresholds sums.
    """
    names = list(features())
    rows = stored(
        labelled.select(
            "bad",
            (F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) < 2).alias("grow"),
            *[c.alias(n) for n, c in features().items()],
        ),
        "rules-labelled",
    )
    edges = rows.groupBy("bad").agg(*[F.percentile_approx(n, QUANTILES, 10_000).alias(n) for n in names]).collect()
    cuts = {n: sorted({float(x) for r in edges for x in r[n]}) for n in names}
    columns = {n: F.col(n) for n in names}

    def sums(where: Column) -> dict[tuple[str, float, bool], tuple[int, int]]:
        """Bad and good documents beyond each threshold, on both sides."""
        value = F.col("f.v")
        listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])
        bound = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[F.lit(t) for t in cuts[n]]))])
        t = F.explode(F.element_at(bound, F.col("f.name")))
        found = (
            rows.where(where & F.col("grow"))
            .select("bad", F.explode(listed).alias("f"))
            .select("bad", "f", t.alias("t"))
            .groupBy(F.col("f.name").alias("name"), "t")
            .agg(
                *[
                    F.sum(F.when(side & (F.col("bad") == b), 1).otherwise(0)).alias(f"{s}{b}")
                    for s, side in (("a", value > F.col("t")), ("b", value < F.col("t")))
                    for b in (1, 0)
                ]
            )
            .collect()
        )
        return {(r["name"], r["t"], s == "a"): (r[f"{s}1"], r[f"{s}0"]) for r in found for s in "ab"}

    def margin(where: Column, c: Condition) -> Condition:
        """The condition with its threshold half-way to the nearest bad document that it covers."""
        ends = F.min(c.feature) if c.above else F.max(c.feature)
        near = rows.where(where & F.col("grow") & (F.col("bad") == 1) & c.column(columns)).agg(ends).first()[0]
        return Condition(c.feature, c.above, (c.threshold + near) / 2)

    rules: list[Rule] = []
    free = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        p0, n0 = (
            rows.where(free & F.col("grow"))
            .agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)))
            .first()
        )
        if p0 < support:
            break
        while n0 and len(rule) < max_conditions:
            found = sums(free & _all(rule, columns))
            best = max(
                found, key=lambda k: (_gain(*found[k], p0, n0), k[0], k[2], -k[1] if k[2] else k[1]), default=None
            )
            if best is None or found[best][0] < support or _gain(*found[best], p0, n0) <= 0:
                break
            rule += (margin(free & _all(rule, columns), Condition(best[0], best[2], best[1])),)
            p0, n0 = found[best]
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        counts = (
            rows.where(free & ~F.col("grow"))
            .agg(
                *[
                    F.coalesce(F.sum(F.when(_all(r, columns) & (F.col("bad") == b), 1)), F.lit(0))
                    for r in shorter
                    for b in (1, 0)
                ]
            )
            .first()
        )
        pn = [(counts[2 * k], counts[2 * k + 1]) for k in range(len(shorter))]
        k = max(range(len(shorter)), key=lambda k: ((pn[k][0] - pn[k][1]) / max(1, sum(pn[k])), -k))
        bad, good = pn[k]
        if bad == 0 or bad < precision * (bad + good):
            break
        rules.append(shorter[k])
        free = free & ~_all(shorter[k], columns)
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[Rule]:
    """Rules from at most ``limit`` labelled documents; a document is bad if any label says quality 0."""
    known = labels.where("doc_id is not null and quality is not null")
    place = F.xxhash64(F.lit("label"), "doc_id")
    # of many labels only about twice as many as needed are sorted: those with hashes below a bound
    share = min(1.0, 2 * limit / max(1, known.select("doc_id").distinct().count()))
    low = F.shiftrightunsigned(place, 11) <= int(share * (1 << 53))
    chosen = (
        known.where(low)
        .groupBy("doc_id")
        .agg(F.max(1 - F.col("quality").cast("int")).alias("bad"))
        .orderBy(place, "doc_id")
        .limit(limit)
        .select(F.col("doc_id").alias("_id"), "bad")
    )
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    return learn_rules(with_statistics(some, ["doc_id", "bad"]))


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True for documents to keep: one ordered conditional over the statistics."""
    of = features(prefix)
    out = None
    for rule in rules:
        out = F.when(_all(rule, of), False) if out is None else out.when(_all(rule, of), False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    words, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 10) | (100 * again > 20 * words)


def judge_documents(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """Statistics and verdict of every document.

    Defined cases: a null text is empty (all counts 0, base_failed); labels with null parts are ignored and without
    any label no rule is learnt, so only the base rule rejects; repeated rows are judged alike; an empty table gives no
    rows; other columns are ignored. Of conditions with equal gain the one with the later feature name, then the wider
    threshold, is taken. Memory: a row's text, its words and a hash for each of them.

    Returns doc_id, the statistics, base_failed and kept.
    """
    rules = learn_from(docs, labels, limit)
    return with_statistics(docs, ["doc_id"]).select(
        "*", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rule and the decision list keep."""
    rules = learn_from(docs, labels, limit)
    mark = private(docs, *STATISTICS)[0].removesuffix(STATISTICS[0])
    judged = with_statistics(docs, docs.columns, mark)
    return judged.where(~base_failed(mark) & verdict(rules, mark)).select(*docs.columns)
