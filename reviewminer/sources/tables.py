"""Adapters: the given tables in the shape of reviews, products and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASIN_COUNT = 200


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute an input that would keep fewer tasks busy than there are cores.

    A few small files may be cut into more splits than they have row groups, so
    files count as well. A large scan yields many splits per core and passes
    unchanged; only small inputs are ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    few = splits < cores or (splits <= 2 * cores and len(df.inputFiles()) < cores)
    return df.repartition(cores, key) if few and cores > 1 else df


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reviews(review_id, asin, reviewText, source) without ratings."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return spread(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("review_id"),
        (F.col("doc_id") % ASIN_COUNT).cast("string").alias("asin"),
        F.col("text").alias("reviewText"),
        "source",
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings(review_id, overall); reviews without a label are rated 3."""
    return load(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.when(F.col("quality") == 1, 5.0).when(F.col("quality") == 0, 1.0).otherwise(3.0).alias("overall"),
    )


def attach_ratings(df: DataFrame, rated: DataFrame, default: float = 3.0) -> DataFrame:
    """Add ``overall``. Call it on extracted rows: the text never meets a join."""
    joined = df.join(rated, "review_id", "left")
    return joined.withColumn("overall", F.coalesce("overall", F.lit(default)))


def bought_with(lineitem: DataFrame, asin: str) -> DataFrame:
    """(asin): every part that shares an order with the asked one, and itself if there is any.

    The orders of the asked part are found first and their lines kept by a semi
    join, so the work is linear in the lines, however many one order holds.
    """
    lines = lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("asin")).where("asin is not null")
    orders = lines.where(F.col("asin") == asin).select("l_orderkey").distinct()
    met = lines.where(F.col("asin") != asin).join(orders, "l_orderkey", "left_semi")
    others = met.select("asin").distinct()
    return others.unionByName(others.limit(1).select(F.lit(asin).alias("asin")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products(asin, price, brand, categories)."""
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("asin"),
        F.col("p_retailprice").cast("float").alias("price"),
        F.col("p_brand").alias("brand"),
        F.array(F.array(F.lit("All"), "p_type"), F.split("p_name", " ")).alias("categories"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors(id, vector array<double>) from the embeddings table."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )
