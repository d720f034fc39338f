"""Secret scans through a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import private, stored

#: Candidates of the index are broadcast up to so many rows, otherwise joined by sort and merge.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what finds it, and which matches count.

    ``pattern`` is matched leftmost and without overlap; matches whose ``group`` has fewer than ``least`` characters
    are dropped afterwards.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in word)


_KEYWORD = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

#: The base rules, in the order in which their kinds are listed. Where a kind is a run of one character class after a
#: fixed start, its least length stands in the pattern: the leftmost match takes the whole run, and if that is too short,
#: so is all that starts later in it. An assignment too short still hides what it spans, so its length is checked after.
BASE = (
    Rule("assign", rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds: key blocks, signed web tokens and tokens with a vendor's prefix.
MORE = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("prefixed", r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_)[A-Za-z0-9-]+", 0, 24),
)
RULES = BASE + MORE


# --- Boolean trigram queries -------------------------------------------------

#: An AND of ORs of ANDs would be the general form; a disjunction of trigram sets is enough, () meaning "anything".
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: A query with more alternatives than this is weakened to "anything", which is always right.
MAX_ALTERNATIVES = 64


@dataclass
class _Part:
    """What is known of the strings that part of a pattern matches.

    ``exact``: all of them, lower-cased, if few and short; else None. ``query``: trigrams that each of them holds.
    """

    exact: frozenset[str] | None
    query: Query


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(q: frozenset[frozenset[str]]) -> Query:
    """Without alternatives that another one implies."""
    out = frozenset(a for a in q if not any(b < a for b in q))
    return out if len(out) <= MAX_ALTERNATIVES else ANY


def _query_of(p: _Part) -> Query:
    return p.query if p.exact is None else _least(frozenset(_trigrams(s) for s in p.exact))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        exact = frozenset().union(*[p.exact for p in parts])
        if len(exact) <= MAX_ALTERNATIVES:
            return _Part(exact, ANY)
    return _Part(None, _least(frozenset().union(*[_query_of(p) for p in parts])))


def _join(parts: list[_Part]) -> _Part:
    """Concatenation: neighbouring exact sets are multiplied, so trigrams across them count."""
    runs: list[_Part] = []
    for p in parts:
        last = runs[-1] if runs else None
        if last and last.exact is not None and p.exact is not None and len(last.exact) * len(p.exact) <= MAX_ALTERNATIVES:
            runs[-1] = _Part(frozenset(a + b for a in last.exact for b in p.exact), ANY)
        else:
            runs.append(p)
    if len(runs) == 1:
        return runs[0]
    query: Query = ANY
    for p in runs:
        query = _least(frozenset(a | b for a in query for b in _query_of(p)))
    return _Part(None, query)


def trigram_query(pattern: str) -> Query:
    """A disjunction of sets of lower-case trigrams: every text that ``pattern`` matches holds all trigrams of one set.

    {()} says that nothing is mandatory. Case is folded for the index alone; the pattern decides in the end.
    """
    import re._constants as k
    import re._parser as parser

    def walk(items) -> _Part:
        return _join([one(op, arg) for op, arg in items]) if len(items) else _Part(frozenset([""]), ANY)

    def one(op, arg) -> _Part:
        if op is k.LITERAL:
            return _Part(frozenset([chr(arg).lower()]), ANY)
        if op is k.IN:
            chars: set[str] = set()
            for o, a in arg:
                if o is k.LITERAL:
                    chars.add(chr(a).lower())
                elif o is k.RANGE and a[1] - a[0] < 4:
                    chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return _Part(None, ANY)
            return _Part(frozenset(chars), ANY) if len(chars) <= 4 else _Part(None, ANY)
        if op is k.SUBPATTERN:
            return walk(arg[3])
        if op is k.BRANCH:
            return _either([walk(b) for b in arg[1]])
        if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner = walk(body)
            if (low, high) == (0, 1) and inner.exact is not None:
                return _Part(inner.exact | {""}, ANY)
            if low == 0:
                return _Part(None, ANY)
            return inner if low == high == 1 else _Part(None, _query_of(inner))
        if op is k.AT:
            return _Part(frozenset([""]), ANY)
        return _Part(None, ANY)

    return _query_of(walk(parser.parse(pattern)))


def index_postings(docs: DataFrame, key: str, trigrams: list[str]) -> DataFrame:
    """The inverted index of the trigrams that the rules ask about: one row (trigram, key) per document that holds it.

    Folding to lower case is ASCII only, as the rules' letters are.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = docs.select(key, F.translate(F.coalesce("text", F.lit("")), upper, lower).alias("_t"))
    held = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select(key, F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents whose postings satisfy a rule's query: one row per document with the kinds it may hold.

    Every alternative is an intersection of postings: a document is in it if it is found under each of its trigrams.
    """
    spark = postings.sparkSession
    asked = [
        (rule.kind, f"{rule.kind}:{i}", t, len(alternative))
        for rule in rules
        for i, alternative in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
        for t in alternative
    ]
    wanted = spark.createDataFrame(asked or [("", "", "", 0)], "kind string, clause string, trigram string, n int")
    return (
        postings.join(F.broadcast(wanted), "trigram")
        .groupBy(key, "kind", "clause", "n")
        .agg(F.count(F.lit(1)).alias("found"))
        .where("found >= n")
        .groupBy(key)
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """All matches as structs (start, place, finish): what lies between matches has the lengths of the split's pieces."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.arrays_zip(found.alias("m"), value.alias("v")),
        between,
        lambda x, gap: F.struct(
            F.char_length(gap).alias("gap"),
            F.char_length(x["m"]).alias("n"),
            (F.char_length(x["v"]) >= rule.least).alias("good"),
        ),
    )
    lengths = F.filter(lengths, lambda x: x["n"].isNotNull())
    none = F.array().cast("array<struct<start:int,place:int,finish:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), (begin + x["n"]).alias("finish"))
        return F.struct(
            (begin + x["n"]).alias("at"),
            F.when(x["good"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"),
        )

    return F.when(~F.rlike(text, pattern), none).otherwise(F.aggregate(lengths, start, step, lambda a: a["out"]))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, columns: list[str] | None = None, name: str = "_spans"
) -> DataFrame:
    """Spans of secrets in every whole text: ``columns`` (all by default) and ``_spans`` (or ``name``).

    ``_spans`` is an array of (start, place, finish) by start, then by the place of the kind in ``rules``; positions are
    code points, the end is exclusive. Rules with mandatory trigrams are verified on the candidates of the index; the
    others scan every text. Needs doc_id and text.

    Defined cases: a null text is empty; rows that share an id share their candidate kinds, which adds candidates and
    loses none; rows with a null id are scanned for every kind; an empty table gives no rows. Memory: a row's text and its
    matches.
    """
    columns = docs.columns if columns is None else columns
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if frozenset() not in queries[r.kind])
    trigrams = sorted({t for r in indexed for a in queries[r.kind] for t in a})
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs
    key, may = private(docs, "key", "kinds")
    kinds = F.col(may)
    if indexed:
        own = docs.where("doc_id is not null").select("doc_id", "text")
        found = candidates(index_postings(own, "doc_id", trigrams), "doc_id", indexed).toDF(key, may)
        found = stored(found, "secret-candidates")
        few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        made = docs.join(F.broadcast(found) if few else found, docs["doc_id"] == F.col(key), "left")
    none = F.array().cast("array<struct<start:int,place:int,finish:int>>")
    each = [
        F.when(
            docs["doc_id"].isNull() | F.coalesce(F.array_contains(kinds, r.kind), F.lit(False)), _spans(text, r, i)
        ).otherwise(none)
        if r in indexed
        else _spans(text, r, i)
        for i, r in enumerate(rules)
    ]
    return made.select(*[docs[c] for c in columns], F.sort_array(F.concat(*each)).alias(name))


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["finish"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every maximal run of characters that some span covers replaced by ``mask``."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(False).alias("open"))

    def step(a: Column, s: Column) -> Column:
        apart = (s["start"] > a["at"]) | ~a["open"]
        return F.struct(
            F.greatest(a["at"], s["finish"]).alias("at"),
            F.when(apart, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)))
            .otherwise(a["out"])
            .alias("out"),
            F.lit(True).alias("open"),
        )

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, 2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in its texts masked; rows, other columns and texts without secrets stay (null included)."""
    (spans,) = private(docs, "spans")
    found = find_secrets(docs, rules, name=spans)
    masked = F.when(F.size(spans) == 0, F.col("text")).otherwise(redacted(F.col("text"), F.col(spans)))
    return found.select(*[masked.alias("text") if c == "text" else F.col(c) for c in docs.columns])
