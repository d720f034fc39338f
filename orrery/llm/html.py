"""Main text of web pages: the maximum-scoring run of words and tags, with weights learnt from labelled pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages with an article element that weights are learnt from, at most: those with the smallest hashes of their ids.
LABELLED = 400
#: Kinds of places (sets of features) that reach the driver, the commonest first.
PLACES = 20_000
#: Features with a weight of their own, those on most pages first.
FEATURES = 2_000
#: Weight of all labelled words on either side, against priors of variance one.
MASS = 100.0
#: Log odds at which a word counts fully for or against.
SURE = 4.0
#: The most that one tag between two blocks costs, in words.
TAG_COST = 1.0

# Element names and words of class, id or role attributes.
#: Their content is no text.
MUTE = frozenset("script style noscript template svg math iframe object canvas audio video select textarea head title".split())
#: Their content is read as raw text up to the end tag.
RAW = frozenset("script style noscript template iframe textarea title svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that are expected to stand beside an article, before any page is seen.
ASIDE = frozenset("nav footer aside form menu dialog button fieldset header".split())
#: Words of class, id or role that are expected to mark what stands beside it.
BESIDE = frozenset(
    "ad ads advert advertisement advertising adverts adsense banner sponsor sponsored promo promotion sidebar side widget "
    "menu menubar nav navbar navigation navigations breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus respond reply replies discussion share sharing social related recommended recommendations pagination "
    "pager complementary contentinfo search disclaimer paywall".split()
)
#: Words that say nothing on their own: a name counts as one of those above only if it consists of both kinds.
PLAIN = frozenset(
    "site page main top bottom left right center inner outer box block area container wrapper wrap section list item items "
    "group row col column content text body bar panel link links button form icon icons js wp global primary secondary "
    "reader user post article thread area title head header heading layout region the and for of by more also see".split()
)
#: Elements that only hold others: their weights stay near zero.
HOLDERS = frozenset("html body div section span center table tbody tr td".split())
#: What is expected of a feature's log odds before any page is seen.
EXPECT_BESIDE = -14.0
EXPECT_INSIDE = 8.0
EXPECT_WORD = 1.0

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<bang>[!?][^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>"
    r"(?:[\s/=]++|[^\s>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")

Place = frozenset[str]


@dataclass
class Block:
    """Text between block borders: its parts as (words, place), whether an article or main element holds it, and the tags
    since the block before."""

    text: str
    parts: list[tuple[int, Place]]
    in_article: bool
    in_main: bool
    tags: list[str] = field(default_factory=list)


def _own_features(name: str, attrs: str, in_article: bool) -> tuple[list[str], bool]:
    """Features of an element, and whether it is hidden: t: its name, c: its classes, ids and roles, k: the words in them
    that are expected beside an article."""
    if name in ("html", "body", "article", "main"):
        return [], False
    out = [] if name == "header" and in_article else ["t:" + name]
    hidden = False
    if attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id", "role"):
                for token in value.split():
                    out.append("c:" + _DIGITS.sub("0", token)[:64])
                    parts = set(_PARTS.findall(token))
                    if parts <= BESIDE | PLAIN:
                        out += ["k:" + p for p in sorted(parts & BESIDE)]
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    return out, hidden


def page_blocks(page: str) -> list[Block]:
    """The blocks of a whole page in order: a linear pass over its tags. Only content that is no text is left out."""
    blocks: list[Block] = []
    text: list[str] = []
    parts: list[tuple[str, Place]] = []
    tags: list[str] = []
    root: Place = frozenset()
    stack: list[tuple[str, Place, bool]] = []
    mute = articles = mains = 0
    at, n = 0, len(page)

    def say(piece: str) -> None:
        text.append(piece)
        parts.append((piece, stack[-1][1] if stack else root))

    def close_block() -> None:
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if whole:
                counted = [(len(x.split()), place) for x, place in parts]
                counted = [p for p in counted if p[0]] or [(1, parts[0][1])]
                blocks.append(Block(whole, counted, articles > 0, mains > 0, tags.copy()))
                tags.clear()
            parts.clear()

    def pop() -> None:
        nonlocal mute, articles, mains
        name, _, was = stack.pop()
        mute -= was
        articles -= name == "article"
        mains -= name == "main"

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if not mute:
                say(page[at:])
            break
        if m.start() > at and not mute:
            say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCK:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("table", "article", "main", "body") and name not in ("html", "body", "article", "main", "table"):
                    break
            if not mute:
                tags.append("/" + name)
            continue
        if name in BLOCK:
            close_block()
            if stack and stack[-1][0] == "p":
                pop()
        if name == "br" and not mute:
            say(" ")
        if not mute:
            tags.append(name)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or (m["attrs"].endswith("/") and name not in BLOCK):
            continue
        own, hidden = _own_features(name, m["attrs"], articles > 0)
        above = stack[-1][1] if stack else root
        out = hidden or name in MUTE
        if out and not mute:
            close_block()
        stack.append((name, above if above.issuperset(own) else above.union(own), out))
        mute += out
        articles += name == "article"
        mains += name == "main"
    close_block()
    return blocks


def _marked(blocks: list[Block]) -> list[bool] | None:
    """Per block whether it lies in what the page marks as its article, else as its main part; None if it marks nothing."""
    for inside in ([b.in_article for b in blocks], [b.in_main for b in blocks]):
        if any(inside):
            return inside
    return None


@dataclass(frozen=True)
class Weights:
    """Log odds that a word is content: ``word`` plus those of the features of its place and of lying in or outside of
    what a page marks; and what each tag between two blocks costs."""

    word: float = EXPECT_WORD
    features: dict[str, float] = field(default_factory=dict)
    inside: float = EXPECT_INSIDE
    outside: float = -EXPECT_INSIDE
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, feature: str) -> float:
        return self.features.get(feature, expected(feature))

    def zero(self) -> Weights:
        """No weight at all, also none expected."""
        return _Zero()


@dataclass(frozen=True)
class _Zero(Weights):
    word: float = 0.0
    inside: float = 0.0
    outside: float = 0.0

    def of(self, feature: str) -> float:
        return 0.0


def expected(feature: str) -> float:
    """A feature's log odds before any page is seen."""
    kind, _, name = feature.partition(":")
    return EXPECT_BESIDE if kind == "k" or (kind == "t" and name in ASIDE) else 0.0


def page_places(page: str) -> list[tuple[str, bool, int]]:
    """Labelled words of a page with an article: (place as text, inside, words), and tags as ("<name", inside, times).

    Words of an article that stand in parts expected beside it are no examples of either side.
    """
    blocks = page_blocks(page)
    if not any(b.in_article for b in blocks):
        return []
    out: dict[tuple[str, bool], int] = {}
    for b in blocks:
        for words, place in b.parts:
            if b.in_article and any(expected(f) for f in place):
                continue
            key = (" ".join(sorted(place)), b.in_article)
            out[key] = out.get(key, 0) + words
        for t in b.tags:
            key = ("<" + t, b.in_article)
            out[key] = out.get(key, 0) + 1
    return [(place, inside, words) for (place, inside), words in out.items()]


def learn_weights(places: Iterable[tuple[str, bool, int, int]]) -> Weights:
    """Weights from labelled words (place, inside, words, pages): logistic regression with a normal prior around
    ``expected``.

    Every word is seen three times: as its page marks it, without the mark, and without the features that are expected to
    tell, so that the others learn what they can; a word's own weight hardly moves. A tag costs its log odds of standing outside, from 0 to ``TAG_COST``.
    """
    rows = sorted(places)
    words = [r for r in rows if not r[0].startswith("<")]
    pages: dict[str, int] = {}
    for place, _, _, k in words:
        for f in place.split():
            pages[f] = pages.get(f, 0) + k
    names = sorted(pages, key=lambda f: (-pages[f], f))[:FEATURES]
    column = {f: i + 3 for i, f in enumerate(names)}
    mean = np.array([EXPECT_WORD, EXPECT_INSIDE, -EXPECT_INSIDE, *map(expected, names)])
    holder = [f.startswith("t:") and f[2:] in HOLDERS for f in names]
    precision = np.array([25.0, 1.0, 1.0, *np.where(holder, 25.0, 1.0)])
    x, y, mass = [], [], []
    for place, inside, k, _ in words:
        own = [column[f] for f in place.split() if f in column]
        plain = [column[f] for f in place.split() if f in column and not expected(f)]
        for some in ([0, 1 if inside else 2, *own], [0, *own], [0, *plain] if plain else None):
            if some is None:
                continue
            row = np.zeros(len(mean))
            row[some] = 1.0
            x.append(row)
            y.append(float(inside))
            mass.append(float(k))
    theta = mean.copy()
    if x:
        x, y, mass = np.array(x), np.array(y), np.array(mass)
        for side in (0.0, 1.0):
            total = mass[y == side].sum()
            mass[y == side] *= MASS / total if total else 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            slope = x.T @ (mass * (y - p)) - precision * (theta - mean)
            curve = (x.T * (mass * p * (1 - p))) @ x + np.diag(precision)
            step = np.linalg.solve(curve, slope)
            theta = theta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
    tags: dict[str, list[float]] = {}
    for place, inside, k, _ in rows:
        if place.startswith("<"):
            tags.setdefault(place[1:], [0.5, 0.5])[inside] += k
    outside, inner = (sum(c[i] for c in tags.values()) or 1.0 for i in (0, 1))
    cost = {t: float(np.clip(np.log((c[0] / outside) / (c[1] / inner)), 0.0, TAG_COST)) for t, c in tags.items()}
    return Weights(float(theta[0]), dict(zip(names, theta[3:].tolist(), strict=True)), float(theta[1]), float(theta[2]), cost)


def scored(blocks: list[Block], weights: Weights, known: dict[Place, float] | None = None) -> tuple[list[float], list[float]]:
    """Per block what its words score, and what the tags between the block before and it cost.

    A word scores its log odds over ``SURE``, from -1 to 1. Inside what a page marks as its article, blocks that score
    below zero are parts of another kind that the article encloses: they and tags there cost nothing, and are left out.
    """
    inside = _marked(blocks)
    known = {} if known is None else known
    gains, costs = [], []
    for i, b in enumerate(blocks):
        mark = 0.0 if inside is None else weights.inside if inside[i] else weights.outside
        gain = 0.0
        for words, place in b.parts:
            w = known.get(place)
            if w is None:
                w = known[place] = weights.word + sum(map(weights.of, place))
            gain += words * max(-1.0, min(1.0, (w + mark) / SURE))
        within = inside is not None and i > 0 and inside[i] and inside[i - 1]
        gains.append(gain)
        costs.append(0.0 if within or i == 0 else sum(weights.tags.get(t, 0.0) for t in b.tags))
    return gains, costs


def best_region(gains: list[float], costs: list[float], free: list[bool]) -> tuple[int, int]:
    """The contiguous region first..end of the largest sum of gains minus the costs between its blocks, in one scan.

    Losses of blocks that are ``free`` do not count. Of equal regions the one that ends last, of those the longest; an
    empty one if none is above zero.
    """
    best, best_sum, start, total = (0, 0), 0.0, 0, 0.0
    for i, (gain, cost) in enumerate(zip(gains, costs, strict=True)):
        gain = max(0.0, gain) if free[i] else gain
        if i == 0 or total - cost < 0:
            start, total = i, gain
        else:
            total += gain - cost
        if total > 0 and total >= best_sum:
            best, best_sum = (start, i + 1), total
    return best


def main_text(page: str, weights: Weights, known: dict[Place, float] | None = None) -> str:
    """The blocks of the best-scoring contiguous region that score above zero themselves, joined by line feeds."""
    blocks = page_blocks(page)
    gains, costs = scored(blocks, weights, known)
    first, end = best_region(gains, costs, _marked(blocks) or [False] * len(blocks))
    return "\n".join(b.text for b, gain in zip(blocks[first:end], gains[first:end], strict=True) if gain > 0)


def labelled_places(pages: DataFrame, limit: int = LABELLED) -> list[tuple[str, bool, int, int]]:
    """What ``learn_weights`` takes, from at most ``limit`` pages with an article (page_id, html).

    Pages are read where they lie; the driver gets counts of at most ``PLACES`` kinds of places.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("text_hash"), "html")
    marked = own.where(F.lower("html").contains("<article") & F.col("page_id").isNotNull())
    order = [F.xxhash64(F.lit("weights"), "page_id"), F.col("page_id"), F.col("text_hash")]
    chosen = marked.select("page_id", "text_hash").distinct().orderBy(*order).limit(limit)
    chosen = chosen.toDF("chosen_id", "chosen_hash")
    same = (F.col("page_id") == F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash"))
    sample = marked.join(F.broadcast(chosen), same, "left_semi").select("page_id", "html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for p in page_places(h.as_py())]
            if rows:
                page, place, inside, words = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"page": pa.array(page, pa.int64()), "place": pa.array(place), "inside": pa.array(inside), "words": pa.array(words, pa.int64())}
                )

    places = sample.mapInArrow(count, "page long, place string, inside boolean, words long")
    each = places.groupBy("page", "place", "inside").agg(F.max("words").alias("words"))  # a repeated row counts once
    total = each.groupBy("place", "inside").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("pages"))
    return [tuple(r) for r in total.orderBy(F.desc("pages"), F.desc("words"), "place", "inside").limit(PLACES).collect()]


def extract_pages(pages: DataFrame, limit: int = LABELLED) -> DataFrame:
    """Main text of every page (page_id, url, html), with weights learnt from at most ``limit`` pages with an article.

    Words score by the elements that hold them, tags between blocks cost, and one linear scan finds the contiguous region
    with the largest sum; blocks in it that score below zero are left out.

    Defined cases: a null or empty html, or one without words, gives an empty text; broken and cut-off markup is read as
    far as it goes, an unclosed quote ends with its tag; without labelled pages the expected weights serve; repeated rows
    are read alike; null ids and urls stay null; an empty table gives no rows; other columns are ignored. Memory: a task
    holds one page and its blocks.

    Returns page_id, url, text.
    """
    weights = learn_weights(labelled_places(pages, limit))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[Place, float] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [main_text(h, weights, known) if h else "" for h in part.column(2).to_pylist()]
                if len(known) > 100_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        extract, "page_id long, url string, text string"
    )
