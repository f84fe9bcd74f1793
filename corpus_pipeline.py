"""From raw documents to packed sequences, stage by stage.

Every stage reads what its predecessor wrote. All but the last return the
columns of the documents. Null ids and null texts pass through as each operator
defines; rows that repeat a doc_id and a text go in near dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewminer.llm.common import written
from reviewminer.llm.linededup import drop_repeated_lines
from reviewminer.llm.mixing import mixed
from reviewminer.llm.neardup import near_duplicates
from reviewminer.llm.packing import packed
from reviewminer.llm.quality import judged
from reviewminer.sources.tables import load

ORACLE_SQL = None  # models, sketches, seeded choices and a tokenizer are beyond SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return judged(docs, load(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    cleaned = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("bigint"))
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, as one row per doc_id and text."""
    kept = near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    kept = written(kept, "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def rows(ids: DataFrame) -> DataFrame:
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")

    first = F.min(F.struct(F.lit(0).alias("__none"), *others)).alias("__first")
    repeated = rows(kept.where("__n > 1 and __id is not null")).unionByName(docs.where("doc_id is null"))  # no join on null: it is one key
    single = repeated.groupBy("doc_id", "text").agg(first).select(*[c if c in ("doc_id", "text") else f"__first.{c}" for c in docs.columns])
    return rows(kept.where("__n = 1 and __id is not null")).unionByName(single)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes each, in whole copies."""
    docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "mixing-rows")
    copies = F.round(F.try_divide(F.col("taken"), F.col("size"))).cast("int")
    plan = mixed(docs, keep=["__row"]).where("taken > 0").select("__row", copies.alias("__copies")).where("__copies > 0")
    met = docs.join(plan, "__row").drop("__row")
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copy", "__copies")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence."""
    return packed(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
