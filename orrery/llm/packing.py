"""Shortest-pack-first histogram packing of token sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orrery.llm.common import stored, trim

#: Token that ends every document.
END = 1
MAX_LENGTH = 2048
#: Pieces of one length that share a rank window.
BUCKET_ROWS = 50_000
#: Encoded words a worker keeps; when full, it starts anew.
CACHE_WORDS = 300_000

#: White space characters, as the tokenizer's pattern sees them, that a text may not have before a space
#: for its words to be encoded one by one.
_SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)
_BEFORE_SPACE = [f"{c} " for c in _SPACES]

PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _needs_context(text: str) -> bool:
    """Whether a text holds white space before a space or a special token. Apart from the space, white space is never
    printable, so for most texts two searches decide."""
    if "  " in text or "<|" in text:
        return True
    if text.isprintable():
        return False
    return "\n " in text or (not text.replace("\n", "").isprintable() and any(x in text for x in _BEFORE_SPACE))


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never merges across the start of a space-led word, so words are encoded once and looked up
    afterwards. New words are merged by tiktoken, whose ranks are the vocabulary's ids, as it is several times faster.
    Texts where words need more context (white space before a space, special tokens) go to the tokenizer whole.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes that each id stands for: a byte-level token is written with one character for each byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.words: dict[str, bytes] = {}
        self.merges = self._ranks(vocabulary)

    def _ranks(self, vocabulary: dict[str, int]):
        """The same vocabulary for tiktoken; None if it does not encode a sample alike."""
        import tiktoken
        from public_tokenizers import PATTERN

        byte = _byte_of()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if all(c in byte for c in t) and not t.startswith("<|")}
        merges = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        sample = " The qüick 12 foxes' don't, éa!!\n—x3 \U0001f600 zzthion"
        return merges if merges.encode_ordinary(sample) == self._whole(sample).tolist() else None

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Encode new words as one text and cut the ids where the words end."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            text = " " + " ".join(part)
            ids = np.asarray(self.merges.encode_ordinary(text), dtype="<u4") if self.merges else self._whole(text)
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            at = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            raw, was = ids.tobytes(), 0
            for word, end in zip(part, (4 * at).tolist(), strict=True):
                self.words[word] = raw[was:end]
                was = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if _needs_context(t) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for words in split:
            if words:
                seen.update(words[1:])
        new = list(seen if len(self.words) > CACHE_WORDS else seen.difference(self.words))
        if new:
            self._learn(new)
        look = self.words.__getitem__
        return [
            self._whole(t).tobytes() if words is None else self._whole(words[0]).tobytes() + b"".join(map(look, words[1:]))
            for t, words in zip(texts, split, strict=True)
        ]


def token_pieces(
    docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end: int = END, with_ids: bool = True
) -> DataFrame:
    """Encode whole texts (null: empty), end each with ``end`` and cut at multiples of ``max_length``.

    Returns doc_id, start, length, doc_tokens, the checksum of the ids as little-endian unsigned 32-bit bytes, and those
    bytes (null unless ``with_ids``).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder.load(tokenizer), np.asarray([end], dtype="<u4").tobytes()
        schema = pa.schema(
            [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "ids_crc32")] + [("ids", pa.binary())]
        )
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                rows = []
                whole = encode([t or "" for t in texts.slice(lo, 256).to_pylist()])
                for doc, ids in zip(batch.column(0).slice(lo, 256).to_pylist(), whole, strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for s in range(0, n, max_length):
                        part = ids[4 * s : 4 * min(n, s + max_length)]
                        rows.append((doc, s, len(part) // 4, n, crc32(part), part if with_ids else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Place:
    """Pieces of one length with ranks first..last go to sequences sequence + rank - first, at one offset."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int


def pack_histogram(counts: dict[int, int], max_length: int = MAX_LENGTH) -> list[Place]:
    """Shortest-pack-first over a histogram of lengths.

    Lengths are placed longest first. A length goes to the open packs with the most room that fit it, as many at once as
    their pattern or the length has left; new packs open when none fits. A pattern is a run of packs that hold the same
    lengths, so the work depends on the number of lengths, never on the number of pieces.
    """
    places: list[Place] = []
    runs: list[tuple[int, int, int]] = []  # (used, first sequence, number of packs): shortest pack first
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if runs and runs[0][0] + length <= max_length:
                used, sequence, packs = heapq.heappop(runs)
                n = min(packs, left)
                if packs > n:
                    heapq.heappush(runs, (used, sequence + n, packs - n))
            else:
                used, sequence, n = 0, opened, left
                opened += n
            places.append(Place(length, rank, rank + n - 1, sequence, used))
            rank, left = rank + n, left - n
            heapq.heappush(runs, (used + length, sequence, n))
    return places


def pack_documents(
    docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end: int = END, with_ids: bool = True
) -> DataFrame:
    """Pack all documents into sequences of at most ``max_length`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored. Documents are cut at multiples of ``max_length``; the
    rests are packed by length. Only the histogram (at most ``max_length`` rows) meets on the driver; its packing
    patterns come back as a table of at most a few rows per length, and every piece finds its place by its rank among the
    pieces of its length. Ranks are counted in buckets of a length, so a length that many pieces share is split.

    Defined cases: a null or empty text is the end token alone; rows that repeat are packed each; a null id stays null;
    an empty table gives no rows. Memory: 256 texts, their words and their ids, and ``CACHE_WORDS`` words.

    Returns doc_id, start, length, doc_tokens, ids_crc32, ids (bytes; null unless ``with_ids``, where only the places and
    checksums travel), sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, max_length, end, with_ids), "pack-pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pack_histogram(counts, max_length)
    table = spark.createDataFrame(
        [(p.length, p.first, p.last, p.sequence, p.offset) for p in places],
        "length long, first long, last long, sequence long, offset long",
    )
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    upto = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        bucketed.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    )
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = (
        bucketed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "bucket"])
        .withColumn("rank", F.col("_row") + F.col("before"))
    )
    return (
        ranked.join(F.broadcast(table), "length")
        .where(F.col("rank").between(F.col("first"), F.col("last")))
        .select(
            "doc_id",
            "start",
            "length",
            "doc_tokens",
            "ids_crc32",
            "ids",
            (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
            "offset",
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, their ids in order as bytes and the doc_ids of their pieces."""
    piece = F.struct("offset", "doc_id", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p")).select(
        "sequence_id",
        F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )
