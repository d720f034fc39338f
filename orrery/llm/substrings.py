"""Exact removal of repeated byte strings by hash-compared suffix sorting of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import stored
from orrery.llm.hashing import Prefix

#: Length in bytes of the strings that may not repeat.
LENGTH = 200
#: Length of the grams whose smallest hash anchors a window.
GRAM = 48
#: Surroundings of one anchor sorted together. What exceeds it is split by the bytes that blocks of windows have in
#: common, so that each part can be sorted; of single windows they have all bytes in common.
CROWD = 64
BLOCKS = (16, 1)
#: Windows of a text that are hashed at once.
PIECE = 1 << 20
#: Ids are broadcast up to so many rows, otherwise joined by sort and merge.
BROADCAST_ROWS = 1_000_000
#: Repeated runs, which meet all others, are broadcast up to so many; beyond, the engine may split a hot one.
REPEATED_ROWS = 100_000
#: Surroundings sorted at once.
SORTED_AT_ONCE = 4_000


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    y, s = x, 1
    while 2 * s <= width:
        y = op(y[:-s], y[s:])
        s *= 2
    return op(y[: len(y) - (width - s)], y[width - s :]) if s < width else y


def anchor_runs(prefix: Prefix, n: int, length: int = LENGTH, gram: int = GRAM):
    """Anchors of a text of n bytes: arrays (key, first, last, anchor).

    Each window of ``length`` bytes is anchored at the smallest gram hash in it, the leftmost of equals. That place
    depends on the window's bytes alone, so equal windows have equal anchors at equal distances. Windows first..last
    start the run that one anchor serves.
    """
    h = prefix.windows(gram)
    width = length - gram + 1
    low = _sliding(np.minimum, h, width)
    top = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(np.maximum, top, width) == h)
    v = h[at]
    first = np.maximum(at - (width - 1), 0)
    last = np.minimum(at, n - length)
    for back, k in ((True, 1), (False, 1)):
        while k < len(at):
            a, b = at[:-k], at[k:]
            near = b - a < width
            if not near.any():
                break
            if back:
                hit = near & (v[:-k] <= v[k:])
                first[k:][hit] = np.maximum(first[k:][hit], a[hit] + 1)
            else:
                hit = near & (v[k:] < v[:-k])
                last[:-k][hit] = np.minimum(last[:-k][hit], b[hit] - width)
            k += 1
    some = first <= last
    return v[some], first[some], last[some], at[some]


def common_extension(prefix: Prefix, data: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
    """Bytes that the suffixes at a and b share, at most ``room``; with ``back`` the prefixes that end there.

    Binary search on prefix hashes; the last length found is compared byte by byte, so a collision cannot lengthen it.
    """
    low, high = np.zeros(len(a), np.int64), room.astype(np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = prefix.of(a - mid, a) == prefix.of(b - mid, b) if back else prefix.of(a, a + mid) == prefix.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    for i in np.flatnonzero(low > 0):
        n, x, y = int(low[i]), int(a[i]), int(b[i])
        one, two = (data[x - n : x], data[y - n : y]) if back else (data[x : x + n], data[y : y + n])
        if one.tobytes() != two.tobytes():
            differ = one != two
            low[i] = np.argmax(differ[::-1]) if back else np.argmax(differ)
    return low


def suffix_sort(prefix: Prefix, data: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of suffixes start..end by group, then by bytes: a bottom-up mergesort, all merges of a level at once.

    Two suffixes are compared by their common extension, found in a logarithmic number of hash comparisons, and the byte
    after it; a suffix that is a prefix of another comes first, equal ones keep their order.
    """
    n = len(start)
    order = np.arange(n)
    room = end - start

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """x sorts before y (or with it, if ties)."""
        out = group[x] < group[y]
        i = np.flatnonzero(group[x] == group[y])
        p, q = x[i], y[i]
        least = np.minimum(room[p], room[q])
        low, high = np.zeros(len(i), np.int64), least.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = prefix.of(start[p], start[p] + mid) == prefix.of(start[q], start[q] + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        inside = low < least
        one = data[np.minimum(start[p] + low, len(data) - 1)]
        two = data[np.minimum(start[q] + low, len(data) - 1)]
        out[i] = np.where(inside, one < two, room[p] <= room[q] if ties else room[p] < room[q])
        return out

    width = 1
    while width < n:
        block = np.arange(n) // width
        base = block * width
        other = np.where(block % 2 == 0, base + width, base - width)
        lo, hi = np.minimum(other, n), np.minimum(other + width, n)
        first = lo.copy()
        left = block % 2 == 0
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            x, y = order[mid], order[open_]
            is_left = left[open_]
            less = np.empty(len(open_), bool)
            less[is_left] = before(x[is_left], y[is_left], False)
            less[~is_left] = before(x[~is_left], y[~is_left], True)
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        place = np.minimum(base, other) + (np.arange(n) - base) + (lo - first)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def repeated_in_groups(
    data: np.ndarray, group: np.ndarray, begin: np.ndarray, anchor: np.ndarray, end: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """For surroundings begin..end of equal grams at ``anchor``: whether the window that starts r bytes before the anchor
    repeats in its group, as a table of surroundings by r in 0..length - 1.

    The suffixes at the anchors are sorted; a neighbour at any distance in that order shares the least of the common
    extensions between. With the extension backwards it names the windows both hold.
    """
    prefix = Prefix(data)
    order = suffix_sort(prefix, data, group, anchor, end)
    marks = np.zeros((len(group), length + 1), np.int32)
    a, b = order[:-1], order[1:]
    pair = group[a] == group[b]
    room = np.minimum(end[a] - anchor[a], end[b] - anchor[b])
    shared = np.where(pair, common_extension(prefix, data, anchor[a], anchor[b], np.where(pair, room, 0)), 0)
    k, least = 1, shared
    while k < len(order):
        a, b = order[:-k], order[k:]
        if k > 1:
            least = np.minimum(least[:-1], shared[k - 1 :])
        i = np.flatnonzero((least > 0) & (group[a] == group[b]))
        if not len(i):
            break
        x, y = a[i], b[i]
        back = common_extension(
            prefix, data, anchor[x], anchor[y], np.minimum(anchor[x] - begin[x], anchor[y] - begin[y]), back=True
        )
        low, high = np.maximum(length - least[i], 0), np.minimum(back, length - 1)
        some = low <= high
        for z in (x[some], y[some]):
            np.add.at(marks, (z, low[some]), 1)
            np.add.at(marks, (z, high[some] + 1), -1)
        k += 1
    return np.cumsum(marks, axis=1)[:, :length] > 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _ids_joined(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, F.col(key) == F.col("id"), how)


def _digest(raw: bytes, shape: int) -> bytes:
    """What stands for a run's bytes where they are compared without being there: 128 bits that no two inputs are known
    to share."""
    return hashlib.blake2b(raw, digest_size=16, salt=shape.to_bytes(16, "little")).digest()


def _pieces(data: np.ndarray, windows: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text in pieces of so many windows, each with the bytes its last window needs."""
    for lo in range(0, max(1, len(data) - LENGTH + 1), windows):
        yield lo, data[lo : lo + windows + LENGTH - 1]


def _keys(texts: DataFrame) -> DataFrame:
    """The anchors of all texts (key)."""
    windows = PIECE

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                for _, part in _pieces(_bytes(text), windows):
                    key = anchor_runs(Prefix(part), len(part))[0]
                    yield pa.RecordBatch.from_arrays([_signed(key)], names=["key"])

    return texts.select("text").mapInArrow(keys, "key long")


def _runs(texts: DataFrame) -> DataFrame:
    """All anchors with the windows they serve: key, content (digest of the run's bytes and shape), node, first, windows, back."""
    windows = PIECE

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for lo, part in _pieces(_bytes(text), windows):
                    key, first, last, at = anchor_runs(Prefix(part), len(part))
                    raw = part.tobytes()
                    shape = (at - first) * 1024 + last - first
                    content = [
                        _digest(raw[i : j + LENGTH], k) for i, j, k in zip(first.tolist(), last.tolist(), shape.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": _signed(key),
                            "content": pa.array(content, pa.binary()),
                            "node": pa.array(np.full(len(key), node, np.int64)),
                            "first": pa.array((first + lo).astype(np.int64)),
                            "windows": pa.array((last - first + 1).astype(np.int16)),
                            "back": pa.array((at - first).astype(np.int16)),
                        }
                    )

    return texts.select("node", "text").mapInArrow(runs, "key long, content binary, node long, first long, windows short, back short")


def _surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted runs (key, doc, first, windows, back), read from the texts."""
    asked = wanted.groupBy("node").agg(
        F.collect_list(F.struct("key", "first", "windows", "back", "crowd")).alias("runs")
    )
    asked = stored(asked.withColumnRenamed("node", "id"), "substr-asked")
    chosen = _ids_joined(texts, "node", asked.select("id"), "left_semi")
    met = chosen.join(asked, F.col("node") == F.col("id")).select("node", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = _bytes(text).tobytes()
                rows = [
                    (r["key"], node, r["first"], r["windows"], r["back"], r["crowd"], raw[r["first"] : r["first"] + r["windows"] - 1 + LENGTH])
                    for r in runs
                ]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["key", "node", "first", "windows", "back", "crowd", "bytes"],
                )

    return met.mapInArrow(cut, "key long, node long, first long, windows short, back short, crowd boolean, bytes binary")


def _marked(node: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"node": pa.array(node), "start": pa.array(start.astype(np.int64)), "end": pa.array(end.astype(np.int64))}
    )


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """Repeated windows among the surroundings (key, node, first, windows, back, bytes) of each key: suffix sorts of whole
    groups."""

    def flush(group: list[tuple]) -> pa.RecordBatch | None:
        keys, node, first, windows, back, raw = zip(*group, strict=True)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        names = np.unique(np.array(keys, np.int64), return_inverse=True)[1]
        back, windows = np.array(back, np.int64), np.array(windows, np.int64)
        again = repeated_in_groups(data, names, begin[:-1], begin[:-1] + back, begin[1:])
        i, r = np.nonzero(again)
        start = np.array(first, np.int64)[i] + back[i] - r
        inside = (back[i] - r >= 0) & (back[i] - r < windows[i])
        return _marked(np.array(node, np.int64)[i][inside], start[inside], start[inside] + LENGTH) if inside.any() else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if len(group) >= SORTED_AT_ONCE and row[0] != group[-1][0]:
                    if (out := flush(group)) is not None:
                        yield out
                    group = []
                group.append(row)
        if group and (out := flush(group)) is not None:
            yield out

    dealt = rows.select("key", "node", "first", "windows", "back", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "node long, start long, end long")


def _split(rows: DataFrame, block: int) -> DataFrame:
    """Surroundings cut into blocks of windows by their distance from the anchor, under keys of what a block has in common.

    Windows that start ``block * b`` to ``block * b + block - 1`` bytes before the anchor all cover the same LENGTH - block
    + 1 bytes, so surroundings that share one of them share those: their hash and b are the new key, their start the new
    anchor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for key, node, first, windows, back, raw in zip(*columns, strict=True):
                for b in range((back - windows + 1) // block, back // block + 1):
                    far, near = min(back, block * b + block - 1), max(back - windows + 1, block * b)
                    core = raw[back - block * b : back - block * b - block + 1 + LENGTH]
                    low = back - far
                    part = raw[low : back - near + LENGTH]
                    name = hashlib.blake2b(core, digest_size=8, salt=(key & (1 << 64) - 1).to_bytes(8, "little") + b.to_bytes(8, "little", signed=True))
                    new = far - block * b
                    out.append(
                        (int.from_bytes(name.digest(), "little", signed=True), _digest(part, new * 1024 + far - near), node, first + low, far - near + 1, new, part)
                    )
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["key", "content", "node", "first", "windows", "back", "bytes"],
                )

    return rows.select("key", "node", "first", "windows", "back", "bytes").mapInArrow(
        work, "key long, content binary, node long, first long, windows short, back short, bytes binary"
    )


def _repeats_of(runs: DataFrame, contents: DataFrame) -> DataFrame:
    """Runs whose bytes another run has too, from end to end."""
    again = contents.where("times > 1").select("key", "content")
    if again.limit(REPEATED_ROWS + 1).count() <= REPEATED_ROWS:
        again = F.broadcast(again)
    end = (F.col("first") + F.col("windows") - 1 + LENGTH).alias("end")
    return runs.join(again, ["key", "content"]).select("node", F.col("first").alias("start"), end)


def _in_groups(contents: DataFrame) -> DataFrame:
    """One run of each content of the keys that have several, and whether these are too many to sort together."""
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return contents.join(several, "key").select("key", "one.*", (F.col("n") > CROWD).alias("crowd"))


REMOVED = "n_bytes long, n_removed long, n_spans long, kept binary"


def _kept(data: bytes, starts: list[int], ends: list[int]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left of a text without the given spans."""
    order = np.argsort(starts, kind="stable")
    start, end = np.array(starts, np.int64)[order], np.maximum.accumulate(np.array(ends, np.int64)[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    low, high = start[fresh], end[np.concatenate([fresh[1:] - 1, [len(end) - 1]])]
    left, at = [], 0
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    return int((high - low).sum()), len(low), b"".join(left)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every byte covered by a 200-byte string that also starts anywhere else goes; matches never cross documents.

    1. Windows of 200 bytes are anchored at their smallest gram; equal windows have equal anchors. Anchors that occur once
       are done with.
    2. The suffixes at the others are sorted per anchor by hash-compared mergesort, with the bytes of the windows that the
       anchor serves; common extensions, verified byte by byte, name the windows that repeat.
    3. Equal suffixes need no sorting among each other: runs with equal bytes from end to end repeat as a whole and are
       sorted as one, and so are whole texts. They meet by digests that no two inputs are known to share (128 and 256
       bits), so copies of a common passage are counted before they are shuffled, never gathered.
    4. Anchors with more than ``CROWD`` different surroundings (borders of common passages) are split by more of their
       bytes, like a radix pass, until each part can be sorted: blocks of 16 windows, then single windows.

    Defined cases: a null text is empty; texts under 200 bytes stay whole; rows that repeat are equal texts and go; rows
    that share an id but not the text are documents of their own, also with a null id; an empty table gives no rows; other
    columns are ignored. Memory: a task holds one text, and hashes of ``PIECE`` bytes of it at a time.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, "doc_id").alias("node"), text.alias("text"))
    narrow = stored(
        named.where(F.octet_length("text") >= LENGTH).select("node", F.unhex(F.sha2("text", 256)).alias("content")), "substr-texts"
    )
    classes = narrow.groupBy("content").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1")
    classes = stored(classes.select("content", "rep"), "substr-classes")
    copies = narrow.join(classes, "content").select("node", (F.col("node") == F.col("rep")).alias("rep"))
    copies = stored(copies, "substr-copies")
    spare = copies.where("not rep").select(F.col("node").alias("id")).distinct()
    long = named.select("node", "text").where(F.octet_length("text") >= LENGTH)
    texts = _ids_joined(long, "node", spare, "left_anti")
    often = _keys(texts).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    often = stored(often, "substr-often")
    runs = stored(_runs(texts).join(often, "key"), "substr-runs")

    contents = runs.groupBy("key", "content").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("node", "first", "windows", "back")).alias("one")
    )
    contents = stored(contents, "substr-contents")
    found = [_repeats_of(runs, contents)]
    around = stored(_surroundings(texts, _in_groups(contents)), "substr-bytes")
    for block in (*BLOCKS, 0):
        found.append(_sorted_groups(around.where("not crowd")))
        crowd = around.where("crowd")
        if not block or crowd.isEmpty():
            break
        parts = stored(_split(crowd, block), "substr-parts")
        contents = parts.groupBy("key", "content").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("node", "first", "windows", "back", "bytes")).alias("one")
        )
        contents = stored(contents, "substr-contents")
        found.append(_repeats_of(parts, contents))
        around = stored(_in_groups(contents), "substr-bytes")
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    spans = marks.groupBy("node", "end").agg(F.min("start").alias("start")).groupBy("node").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    full = copies.select("node").distinct().withColumn("all", F.lit(True))
    spans = spans.join(full, "node", "full").select(F.col("node").alias("id"), "spans", "all")
    spans = stored(spans, "substr-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()
            for doc, text, marked, everything in zip(*columns, strict=True):
                data = _bytes(text).tobytes()
                if everything:
                    rows.append((doc, len(data), len(data), 1, b""))
                    continue
                at = marked.values.flatten()
                rows.append((doc, len(data), *_kept(data, at[0].to_pylist(), at[1].to_pylist())))
            if rows:
                kinds = (*[pa.int64()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    hit = _ids_joined(named, "node", spans.select("id"), "left_semi")
    clean = _ids_joined(named, "node", spans.select("id"), "left_anti")
    cleaned = hit.join(spans, F.col("node") == F.col("id")).select("doc_id", "text", "spans", "all").mapInArrow(
        cut, f"doc_id long, {REMOVED}"
    )
    zero = F.lit(0).cast("long")
    return cleaned.unionByName(
        clean.select(
            "doc_id",
            F.octet_length("text").cast("long").alias("n_bytes"),
            zero.alias("n_removed"),
            zero.alias("n_spans"),
            F.encode("text", "UTF-8").alias("kept"),
        )
    )
