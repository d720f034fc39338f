"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import embeddings, html, jaccard, mixing, packing, quality, secrets, sharding, substrings, warc
from orrery.llm.common import table
from orrery.llm.oracles import ORACLES

QUERIES = {}


def tokenizer_path() -> str:
    """The installed vocabulary file that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 contiguous shards of near equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text and the decision list's verdict."""
    return quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@_query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and places of the secrets in every text."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), columns=["doc_id"])
    of = lambda k: F.size(F.filter("_spans", lambda s: s["place"] == k)).cast("long")
    base = F.filter("_spans", lambda s: s["place"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.listed(base, secrets.RULES), 256).alias("base_sha256"),
        secrets.listed(F.col("_spans"), secrets.RULES).alias("spans"),
    )


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of every page, read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with equal labels at cosine 0.98 or more."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


@_query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of near-duplicate documents."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@_query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated 200-byte strings."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


__all__ = ["ORACLES", "QUERIES"]
