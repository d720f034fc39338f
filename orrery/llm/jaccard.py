"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import private, stored, trim
from orrery.llm.components import connected_components
from orrery.llm.hashing import mix, shingle_set

#: Links need 100 * shared >= PERCENT * union.
PERCENT = 80
WIDTH = 5
#: Counters of shingles in a task; those that stand out name the hot shingles.
COUNTERS = 1 << 20
#: A shingle is hot, and takes no part in the counting of shingles, from so many rows or 2**-22 of all.
HOT = 1 << 16
#: Shingles counted together, and buckets of them at most (more would leave too few of a batch in a bucket).
BUCKET = 1 << 18
BUCKETS = 1 << 20
#: Shingles that a task holds before it deals them to buckets, and texts (a place among them is two bytes).
HELD = 1 << 20
PLACES = 1 << 16
#: A prefix grows by this part of itself, and by a part as large again for every factor of 16 in its estimated cost.
GROWTH = 0.25
#: A list of ids is broadcast up to so many rows, otherwise joined by sort and merge.
BROADCAST_ROWS = 1_000_000
#: Leaders that a class is verified against before pairs are made.
LEADERS = 2
#: Classes compared with one leader in one task.
CHUNK = 100
#: Classes of one token compared with each other in one task; longer lists are cut, and every two cuts meet once.
TILE = 4096
#: Pairs of sketches compared at once.
AT_ONCE = 1 << 15


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _least_shared(n):
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-PERCENT * n // 100)


def _name(s: np.ndarray) -> int:
    """The name of the class of sets equal to s: 64 bits of two sums of hashes."""
    with np.errstate(over="ignore"):
        one, two = (mix(s, k).sum(dtype=np.uint64, keepdims=True) for k in (1, 2))
        return int(_signed(mix(one ^ mix(two, len(s) & 0xFFFF), 3))[0])


def _shapes(docs: DataFrame) -> DataFrame:
    """Per row the size of its shingle set and the name of its class (null without words); per task the counters that stand out."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            ns, names = [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), WIDTH)
                ns.append(len(s))
                names.append(_name(s) if len(s) else None)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            n = len(ns)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "text_hash": batch.column(1),
                    "n": pa.array(ns, pa.int64()),
                    "class": pa.array(names, pa.int64()),
                    "counter": pa.nulls(n, pa.int32()),
                    "times": pa.nulls(n, pa.int64()),
                }
            )
        mean = counts.mean()
        high = np.flatnonzero(counts > mean + 6 * mean**0.5 + 4)
        n = len(high)
        yield pa.RecordBatch.from_pydict(
            {c: pa.nulls(n, pa.int64()) for c in ("doc_id", "text_hash", "n", "class")}
            | {"counter": pa.array(high.astype(np.int32)), "times": pa.array(counts[high])}
        )
        trim()

    return docs.mapInArrow(shapes, "doc_id long, text_hash long, n long, class long, counter int, times long")


def _blobs(texts: DataFrame, hot: np.ndarray, buckets: int, width: int) -> DataFrame:
    """The shingles of all texts, cut to ``width`` bytes and dealt to buckets by value, a batch of texts at a time.

    Per batch and bucket one row with the shingles in order and the places of their texts in the batch; per batch one row
    that says which texts these are (class, size, number of hot shingles).
    """
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    step = -(-(1 << 8 * width) // buckets)

    def deal(ids: list[int], ns: list[int], hots: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(held)
        place = np.repeat(np.arange(len(ids)), [len(x) for x in held]).astype("<u2")
        order = np.argsort(v, kind="stable")
        v, place = v[order], place[order]
        key = (v // np.uint64(step)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(v)]]) if len(v) else np.zeros(1, int)
        low = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        name = np.array(ids, np.int64)
        with np.errstate(over="ignore"):
            batch = int(mix(name.view(np.uint64).sum(dtype=np.uint64, keepdims=True), len(ids)).view(np.int64)[0])
        about = np.stack([name, np.array(ns, np.int64), np.array(hots, np.int64)]).astype("<i8").tobytes()
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([batch % buckets, *key[edges[:-1]].tolist()], pa.int32()),
                "batch": pa.array([batch] * (len(spans) + 1), pa.int64()),
                "texts": pa.array([about, *[None] * len(spans)], pa.binary()),
                "shingles": pa.array([None, *[low[a:b].tobytes() for a, b in spans]], pa.binary()),
                "places": pa.array([None, *[place[a:b].tobytes() for a, b in spans]], pa.binary()),
            }
        )

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        ids, ns, hots, held, size = [], [], [], [], 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), WIDTH)
                if not len(s):
                    continue
                light = s[~np.isin(s & np.uint64(COUNTERS - 1), at)] if len(at) else s
                ids.append(_name(s))
                ns.append(len(s))
                hots.append(len(s) - len(light))
                held.append(light & np.uint64((1 << 8 * width) - 1))
                size += len(light)
                if size >= HELD or len(ids) == PLACES:
                    yield deal(ids, ns, hots, held)
                    ids, ns, hots, held, size = [], [], [], [], 0
        if ids:
            yield deal(ids, ns, hots, held)
        held = []
        trim()

    return texts.mapInArrow(blobs, "bucket int, batch long, texts binary, shingles binary, places binary")


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _counted(blobs: DataFrame, width: int) -> DataFrame:
    """Of each blob the shingles that stand in two texts or more, with a code of their number (8 for each factor of 2)."""

    def count(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        values = [_unpacked(r[1], width) for r in rows]
        v = np.concatenate(values)
        order = np.argsort(v, kind="stable")
        s = v[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times = np.diff(np.concatenate([first, [len(s)]]))
        df = np.empty(len(v), np.int64)
        df[order] = np.repeat(times, times)
        code = np.minimum(254, 8 * np.log2(df)).astype(np.uint8)
        out, at = [], 0
        for (batch, raw, places), x in zip(rows, values, strict=True):
            some = df[at : at + len(x)] > 1
            if some.any():
                low = np.frombuffer(raw, np.uint8).reshape(-1, width)[some].tobytes()
                out.append((batch, None, low, np.frombuffer(places, "<u2")[some].tobytes(), code[at : at + len(x)][some].tobytes()))
            at += len(x)
        return made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), *[pa.binary()] * 4)
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        names = ["batch", "texts", "shingles", "places", "codes"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for part in batches:
            through = []
            for i in range(part.num_rows):
                bucket, batch = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                if part.column(2)[i].is_valid:
                    through.append((batch, part.column(2)[i].as_py(), None, None, None))
                    continue
                if bucket != now and rows:
                    yield count(rows)
                    rows = []
                now = bucket
                rows.append((batch, part.column(3)[i].as_py(), part.column(4)[i].as_py()))
            if through:
                yield made(through)
        if rows:
            yield count(rows)
        rows = []
        trim()

    dealt = blobs.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "batch long, texts binary, shingles binary, places binary, codes binary")


def _candidates(counted: DataFrame, width: int) -> DataFrame:
    """The texts that share enough shingles with others to link at all: (class, shared shingles, their codes)."""

    def gather(about: bytes, rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        name, n, hot = np.frombuffer(about, "<i8").reshape(3, -1)
        place = np.concatenate([np.frombuffer(r[1], "<u2") for r in rows] or [np.zeros(0, "<u2")]).astype(np.int64)
        v = np.concatenate([_unpacked(r[0], width) for r in rows] or [np.zeros(0, "<u8")])
        code = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows] or [np.zeros(0, np.uint8)])
        shared = np.bincount(place, minlength=len(n))
        chosen = np.flatnonzero(shared + hot >= _least_shared(n))
        order = np.lexsort((v, place))
        place, v, code = place[order], v[order], code[order]
        at = np.concatenate([[0], np.cumsum(shared)])
        return pa.RecordBatch.from_pydict(
            {
                "class": pa.array(name[chosen]),
                "shared": pa.array([v[at[i] : at[i + 1]].tobytes() for i in chosen], pa.binary()),
                "codes": pa.array([code[at[i] : at[i + 1]].tobytes() for i in chosen], pa.binary()),
            }
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, about, rows = None, None, []
        for part in batches:
            for i in range(part.num_rows):
                batch = part.column(0)[i].as_py()
                if batch != now:
                    if about is not None:
                        yield gather(about, rows)
                    now, about, rows = batch, None, []
                if part.column(1)[i].is_valid:
                    about = part.column(1)[i].as_py()
                else:
                    rows.append(tuple(part.column(k)[i].as_py() for k in (2, 3, 4)))
        if about is not None:
            yield gather(about, rows)
        rows = []
        trim()

    dealt = counted.repartition("batch").sortWithinPartitions("batch")
    return dealt.mapInArrow(work, "class long, shared binary, codes binary")


def sketch(s: np.ndarray) -> bytes:
    """Parities of hashed places: shingles that two sets do not share change one bit of the difference each at most.

    A power of two of bits, at least as many as shingles, of small sets twice as many; the sketch of half as many bits is
    the exclusive or of the halves.
    """
    bits = max(64, 1 << ((2 * len(s) if len(s) <= 512 else len(s)) - 1).bit_length())
    at = (mix(s, 9) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _prefixes(texts: DataFrame, hot: np.ndarray, width: int) -> DataFrame:
    """Per candidate its multi-match prefix: (class, n, more, tokens), its sketch and its set.

    Shingles stand in one global order: by the code of the number of texts that hold them, hot ones last, then by hash.
    With n - ceil(0.8 n) + 1 of them, two linked documents share one; with k more on both sides they share k + 1.
    ``more`` is k: a part of the plain prefix that grows with the logarithm of the candidates that it promises. Shingles
    that no other text holds have their place in the prefix but are not returned.
    """
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            names, ns, mores, tokens, sketches, sets = [], [], [], [], [], []
            for i in range(batch.num_rows):
                s = shingle_set(batch.column(1)[i].as_py(), WIDTH)
                n = len(s)
                name = _name(s) if n else None
                if name != batch.column(0)[i].as_py():
                    continue  # another row of the same id
                known = np.frombuffer(batch.column(2)[i].as_py(), "<u8")
                codes = np.frombuffer(batch.column(3)[i].as_py(), np.uint8)
                v = s & np.uint64((1 << 8 * width) - 1)
                k = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
                code = np.where(known[k] == v, codes[k], 0) if len(known) else np.zeros(n, np.uint8)
                if len(at):
                    code = np.where(np.isin(s & np.uint64(COUNTERS - 1), at), 255, code)
                order = np.lexsort((mix(s, 5), code))
                plain = n - _least_shared(n) + 1
                cost = np.exp2(code[order[:plain]] / 8.0).sum() - plain
                more = min(n - plain, int(plain * GROWTH * (1 + log2(1 + cost) / 4)))
                head = order[: plain + more]
                names.append(name)
                ns.append(n)
                mores.append(more)
                tokens.append(_signed(s[head[code[head] > 0]]))
                sketches.append(sketch(s))
                sets.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "class": pa.array(names, pa.int64()),
                    "n": pa.array(ns, pa.int32()),
                    "more": pa.array(mores, pa.int32()),
                    "tokens": pa.array(tokens, pa.list_(pa.int64())),
                    "sketch": pa.array(sketches, pa.binary()),
                    "shingles": pa.array(sets, pa.binary()),
                }
            )
        trim()

    return texts.mapInArrow(prefixes, "class long, n int, more int, tokens array<long>, sketch binary, shingles binary")


def _ids_joined(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """Join with a list of ids (its first column), broadcast only if it is short."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, df[key] == ids[ids.columns[0]], how)


def _verified(prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (class, leader) that link: as many shared prefix tokens as asked for, then the whole sets.

    Sets are dealt by leader, in chunks of classes, with the leader's first in each; a task keeps one set at a time.
    """
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "leader").select(
        F.col("class").alias("id"), "leader", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role")
    )
    first = sizes.select(
        F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role")
    )
    rows = dealt.unionByName(first)
    met = rows.join(prefixes.select(F.col("class").alias("id"), "more", "tokens", "shingles"), "id")
    met = met.select("leader", "chunk", "role", "id", "more", "tokens", "shingles")
    met = met.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, head, least = None, np.zeros(0, "<u8"), np.zeros(0, np.int64), 0
        for batch in batches:
            out = []
            leaders, chunks, roles, ids, mores = (batch.column(i).to_pylist() for i in range(5))
            for i, (leader, chunk, role, name, more) in enumerate(zip(leaders, chunks, roles, ids, mores, strict=True)):
                s = np.frombuffer(batch.column(6)[i].as_py(), "<u8")
                tokens = batch.column(5)[i].values.to_numpy()
                if role == 0:
                    now, base, head, least = (leader, chunk), s, tokens, more
                    continue
                if now != (leader, chunk) or len(np.intersect1d(head, tokens, assume_unique=True)) <= min(least, more):
                    continue
                both = len(np.intersect1d(base, s, assume_unique=True))
                if 100 * both >= PERCENT * (len(base) + len(s) - both):
                    out.append((name, leader))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.mapInArrow(verify, "a long, b long")


def _near(group: np.ndarray, n: np.ndarray, tile: np.ndarray, sketches: list[bytes], apart: bool) -> tuple[np.ndarray, ...]:
    """Pairs of a token's classes that may link: other groups, sizes in band, sketches that differ in few enough bits.

    Two sets that link differ in a ninth of their summed sizes at most, and their sketches in no more bits. With
    ``apart`` only pairs of different tiles count, else all. Returns both sides and what room the sketches leave.
    """
    width = np.array([len(x) for x in sketches])
    out = []
    for w in np.unique(width).tolist():
        one = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join(sketches[i] for i in one), "<u8").reshape(len(one), -1)
        for wide in (w, 2 * w):  # sizes in band are at most one power of two apart
            two = np.flatnonzero(width == wide)
            if not len(two):
                continue
            y = x
            if wide > w:
                y = np.frombuffer(b"".join(sketches[i] for i in two), "<u8").reshape(len(two), -1)
                y = y[:, : w // 8] ^ y[:, w // 8 :]
            rows = max(1, AT_ONCE // len(two))
            for lo in range(0, len(one), rows):
                a = one[lo : lo + rows]
                fit = group[a][:, None] != group[two][None, :]
                least, most = np.minimum(n[a][:, None], n[two][None, :]), np.maximum(n[a][:, None], n[two][None, :])
                fit &= 100 * least >= PERCENT * most
                if wide == w:
                    fit &= a[:, None] < two[None, :]
                if apart:
                    fit &= tile[a][:, None] != tile[two][None, :]
                i, j = np.nonzero(fit)
                if not len(i):
                    continue
                differ = np.bitwise_count(x[lo + i] ^ y[j]).sum(axis=1, dtype=np.int64)
                room = (100 - PERCENT) * (n[a][i] + n[two][j]) - (100 + PERCENT) * differ
                some = room >= 0
                out.append((a[i[some]], two[j[some]], room[some]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _best(i: np.ndarray, j: np.ndarray, room: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Places of the pairs that leave most room to a class, one for each class at most; of equals the smaller other name."""
    one, other, at = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((name[other], -room[at], one))
    first = np.ones(len(order), bool)
    first[1:] = one[order][1:] != one[order][:-1]
    return np.unique(at[order[first]])


def _open_pairs(lists: DataFrame, prefixes: DataFrame, best: bool = False) -> DataFrame:
    """Pairs of classes (token, class, group) that still lie in different groups and share enough tokens.

    A list longer than ``TILE`` is cut, and every two cuts meet in one task. Pairs that the sketches rule out never leave
    the task; the others leave it once for each token that they share, so their number can be asked for. With ``best``
    only each class's best pair of a list leaves, whatever they share.
    """
    sizes = lists.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles"))
    cut = lists.join(sizes, "token").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "token", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "class", "group"
    )
    met = cells.join(prefixes.select("class", "n", "more", "sketch"), "class")
    met = met.select("token", "t", "u", "tile", "class", "group", "n", "more", "sketch")
    met = met.repartition("token", "t", "u").sortWithinPartitions("token", "t", "u")

    def compare(cell: tuple, rows: list[tuple]) -> list[np.ndarray]:
        tile, name, group, n, more = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        i, j, room = _near(group, n, tile, [r[5] for r in rows], cell[1] != cell[2])
        if best:
            some = _best(i, j, room, name)
            i, j, room = i[some], j[some], room[some]
        a, b = np.maximum(name[i], name[j]), np.minimum(name[i], name[j])
        return [a, b, np.minimum(more[i], more[j]), room]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in [*batches, None]:
            for cell_and_row in [()] if batch is None else zip(*[batch.column(i).to_pylist() for i in range(9)], strict=True):
                cell = cell_and_row[:3] or None
                if cell != now:
                    if len(rows) > 1:
                        out.append(compare(now, rows))
                    now, rows = cell, []
                rows.append(cell_and_row[3:])
            if sum(len(x[0]) for x in out):
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["class", "leader", "more", "room"])

    pairs = met.mapInArrow(work, "class long, leader long, more long, room long")
    if best:
        return pairs.select("class", "leader").distinct()
    return (
        pairs.groupBy("class", "leader")
        .agg(F.count(F.lit(1)).alias("times"), F.min("more").alias("more"))
        .where("times > more")
        .select("class", "leader")
    )


def _linked_classes(prefixes: DataFrame) -> DataFrame:
    """Links (a, b) of classes that hold all components of the similarity join."""
    postings = prefixes.select("class", "n", F.explode("tokens").alias("token"))
    leaders = (
        postings.groupBy("token")
        .agg(F.min(F.struct("class", F.col("n").alias("size"))).alias("first"), F.max("class").alias("last"))
        .where("first.class < last")
        .select("token", F.col("first.class").alias("leader"), F.col("first.size").alias("size"))
    )
    postings = stored(postings.join(leaders, "token"), "jaccard-postings")
    band = 100 * F.least("n", "size") >= PERCENT * F.greatest("n", "size")
    led = postings.where((F.col("class") != F.col("leader")) & band).groupBy("class", "leader").agg(F.count(F.lit(1)).alias("times"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("times", "leader")), asc=False), 1, LEADERS)
    led = led.groupBy("class").agg(best.alias("l")).select("class", F.explode("l.leader").alias("leader"))
    links = stored(_verified(prefixes, stored(led, "jaccard-led")), "jaccard-links")

    def grouped(df: DataFrame, key: str, name: str) -> DataFrame:
        now = found.select(F.col("node").alias(key), F.col("component").alias("_g"))
        return df.join(now, key, "left").withColumn(name, F.coalesce("_g", key)).drop("_g")

    def still_open() -> DataFrame:
        named = grouped(postings.select("token", "class"), "class", "group")
        mixed = named.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
        return named.join(mixed, "token")

    few = prefixes.count()  # as many nodes at most
    found = stored(connected_components(links, "jaccard-stars"), "jaccard-groups", rows=few)
    tried = stored(_open_pairs(still_open(), prefixes, best=True), "jaccard-best")
    links = stored(links.unionByName(_verified(prefixes, tried)), "jaccard-links")
    found = stored(connected_components(links, "jaccard-stars"), "jaccard-groups", rows=few)
    rest = stored(_open_pairs(still_open(), prefixes), "jaccard-pairs")
    return links.unionByName(_verified(prefixes, rest))


def _members(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n, group and component_id; see ``similar_documents``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    made = stored(_shapes(rows), "jaccard-shapes")
    shapes = made.where("counter is null").drop("counter", "times")
    every, total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = made.where("counter is not null").groupBy("counter").agg(F.sum("times").alias("times"))
    heavy = heavy.where(F.col("times") >= max(HOT, every >> 22)).orderBy("counter").collect()
    hot = np.array([r.counter for r in heavy], np.uint64)
    buckets = int(min(BUCKETS, max(1, every // BUCKET)))
    width = min(8, (max(every, 1).bit_length() + 10 + 7) // 8)

    usable = shapes.where("class is not null and doc_id is not null")
    classes = usable.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes, "jaccard-classes", rows=total)
    several = classes.where("members > 1").select(F.col("class").alias("_class"), "rep")
    of = _ids_joined(usable, "class", several, "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    spare = of.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("rep")).cast("int")).alias("own"))
    spare = stored(spare.where("own = 0").select(F.col("doc_id").alias("_id")), "jaccard-copies", rows=total)
    single = rows.where("doc_id is not null").select("doc_id", "text")
    blobs = _blobs(_ids_joined(single, "doc_id", spare, "left_anti").select("text"), hot, buckets, width)
    counted = stored(_counted(blobs, width), "jaccard-counted")
    candidates = stored(_candidates(counted, width).dropDuplicates(["class"]), "jaccard-candidates")

    wanted = stored(classes.join(candidates, "class").select("rep", "class", "shared", "codes"), "jaccard-wanted")
    texts = _ids_joined(single, "doc_id", wanted.select(F.col("rep").alias("_rep")).distinct(), "left_semi")
    met = texts.join(wanted, F.col("doc_id") == F.col("rep")).select("class", "text", "shared", "codes")
    prefixes = stored(_prefixes(met, hot, width).dropDuplicates(["class"]), "jaccard-prefixes")

    groups = stored(connected_components(_linked_classes(prefixes), "jaccard-all"), "jaccard-components", rows=total)
    linked = classes.join(groups, F.col("class") == F.col("node")).select("class", "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select(F.col("class").alias("_class"), F.col("component").alias("_group"), "least")
    copied = several.join(groups, F.col("_class") == F.col("node"), "left_anti")
    linked = linked.unionByName(copied.select("_class", F.col("_class").alias("_group"), F.col("rep").alias("least")))
    mine = shapes.withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class")))
    return _ids_joined(mine, "class", stored(linked, "jaccard-linked", rows=total), "left").select(
        "doc_id", "text_hash", "n", F.coalesce("_group", "class").alias("group"), F.coalesce("least", "doc_id").alias("component_id")
    )


def similar_documents(docs: DataFrame) -> DataFrame:
    """Components of documents (doc_id, text) that link by the Jaccard similarity of their word shingles.

    1. Documents with equal sets are one class; only its smallest doc_id goes on.
    2. The shingles of all classes are counted, in packed batches dealt by value. A class that shares too few of its
       shingles with any other to link is done; the others give prefixes in rare-first order.
    3. Leaders: each class is verified against the smallest classes of the tokens it shares most of, which joins the
       members of a large group of near copies by as many pairs as it has members.
    4. Pairs: classes of one token still in different components are compared by sketches that bound their difference
       from below, inside the task that holds the token's list. First only each class's best pair of a list leaves the
       task and is verified, so that near copies which no leader joined cost a row a member. Then all pairs that are
       still apart and share as many prefix tokens as prefixes were lengthened by, plus one, are verified.

    Defined cases: null and empty texts and such without words have no shingles and stay alone; a null doc_id stays alone
    (component null) and links nothing; rows that repeat are one document to the join and a row each in the result; rows
    that share an id but not the text are classes of their own, and a component is named by the smallest id in it; an
    empty table gives no rows; other columns are ignored. Memory: a task holds the set of one text in a few arrays of
    8 bytes a word, besides ``HELD`` shingles. Classes are named by 64 bits.

    Returns doc_id, n_shingles, component_id.
    """
    return _members(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all its columns: the smallest doc_id, of equal ones the text with the
    smallest hash.

    Of rows that repeat an id and a text one stays (which one is not defined where other columns differ); rows with a null
    id all stay.
    """
    members = stored(_members(docs).where("doc_id is not null"), "jaccard-members")
    total = members.count()
    first = members.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = stored(first.where("rows > 1").select(F.col("group").alias("_group"), "first"), "jaccard-first", rows=total)
    id_, hash_ = private(docs, "id", "hash")
    dropped = _ids_joined(members, "group", first, "inner").where(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash").distinct()
    dropped = stored(dropped.toDF(id_, hash_), "jaccard-dropped", rows=total)
    again = members.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash").toDF(id_, hash_)
    again = stored(again, "jaccard-again", rows=total)

    def met(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        same = (df["doc_id"].cast("long") == rows[id_]) & (F.xxhash64(df["text"]) == rows[hash_])
        return df.join(F.broadcast(rows) if few else rows, same, how)

    left = met(docs, dropped, "left_anti")
    if again.isEmpty():
        return left
    twice = met(left, again, "left_semi").withColumn(hash_, F.xxhash64("text"))
    return met(left, again, "left_anti").unionByName(twice.dropDuplicates(["doc_id", hash_]).drop(hash_))
