"""The operators on the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labmesh.llm import oracles
from labmesh.llm.bytepairs import encode_byte_pairs, load_byte_pairs
from labmesh.llm.common import table
from labmesh.llm.divergence import source_divergence
from labmesh.llm.fingerprints import edited_fingerprints
from labmesh.llm.html_blocks import extract_text
from labmesh.llm.licences import licence_scan
from labmesh.llm.minhash import near_duplicates
from labmesh.llm.mixing import mix_sources
from labmesh.llm.pieces import decode_pieces, encode_pieces, load_pieces
from labmesh.llm.quality import THRESHOLD, held_out, score_quality, train_quality
from labmesh.llm.urls import url_verdicts
from labmesh.llm.vectors import near_vectors
from labmesh.llm.warc import archive_folder, read_records, write_archives
from labmesh.llm.whitening import whiten

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by trees fitted on labelled ones."""
    docs = table(spark, folder, "documents")
    trees = train_quality(docs, table(spark, folder, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), trees)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of embeddings of one label with cosine 0.93 or more."""
    return near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = url_verdicts(table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical digest and licences of every document."""
    found = licence_scan(table(spark, folder, "documents"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    archives = archive_folder(spark)
    index = write_archives(table(spark, folder, "pages"), archives)
    return read_records(index, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def label_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents weigh 2 if good and 0.5 if not; others are not listed."""
    labels = table(spark, folder, "labels").filter(F.col("quality").isNotNull())
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix with source weights 1, 2, 3, 1, ... takes from every document."""
    quality = label_weights(spark, folder)
    return mix_sources(table(spark, folder, "documents"), quality=quality)


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 85 percent or more."""
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return extract_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are."""
    return edited_fingerprints(table(spark, folder, "documents"))


def op10_pieces(spark: SparkSession, folder: str, model: str = TOKENIZER) -> DataFrame:
    """Ids of every document, digested, and whether decoding gives the text back."""
    pieces = load_pieces(model)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = decode_pieces(encode_pieces(docs, pieces), pieces)
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the eight leading axes, scaled to unit variance.

    `deviation` is NULL where 64 bits don't hold it; the operator has it to 38 digits.
    """
    whitened = whiten(table(spark, folder, "embeddings"), components=8)
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_byte_bpe(spark: SparkSession, folder: str, ranks: str | None = None) -> DataFrame:
    """Ids of every document and the bytes they decode to, digested."""
    import public_tokenizers

    vocabulary = load_byte_pairs(
        ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = encode_byte_pairs(docs, vocabulary, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of each language compared by their words, and the words that set each apart."""
    return source_divergence(table(spark, folder, "documents"))


REGISTRY: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_license_scan": op4_license_scan,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_main_text": op8_main_text,
    "op9_fingerprints": op9_fingerprints,
    "op10_pieces": op10_pieces,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": oracles.url_filter(),
    "op4_license_scan": oracles.license_scan(),
    "op5_warc": oracles.warc(),
    "op6_mixing": oracles.mixing(),
    "op13_divergence": oracles.divergence(),
}
