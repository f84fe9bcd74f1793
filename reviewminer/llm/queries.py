"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from .alignment import Pair, cross_aligned, with_link_counts
from .bitsliced import exact_top
from .bpe import encoded
from .common import written
from .linededup import drop_repeated_lines
from .mixing import mixed
from .multiindex import nearest_neighbours
from .neardup import near_duplicates
from .packing import packed
from .pii import personal_spans
from .quality import judged
from .sharding import sharded
from .trie import prefix_trie, turn_rows, with_shared_heads
from .urlfilter import judged_urls


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(load(spark, sf_dir, "pages"))


def op4_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(load(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, load(spark, sf_dir, "labels")).select("doc_id", "log_ratio", "sample_key", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(load(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    table = cross_aligned(load(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups")
    return with_link_counts(written(table, "alignments"), Pair().size_b)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = encoded(load(spark, sf_dir, "documents"), decode=True)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return texts.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_rows(load(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_url_filters": op3_url_filters,
    "op4_exact_top": op4_exact_top,
    "op5_source_mixing": op5_source_mixing,
    "op6_packing": op6_packing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_personal_data": op10_personal_data,
    "op11_token_alignment": op11_token_alignment,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_conversation_trie": op13_conversation_trie,
}
