"""Word vectors: training, synonyms and vectors of features."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vector sizes of the pipeline and of the small demonstration.
PIPELINE_SIZE = 50
DEMO_SIZE = 3
MIN_COUNT = 0
SYNONYMS = 10

MODEL_CELLS = 1_000_000_000  # the trained model sits on the driver


def train(
    word_lists: DataFrame, size: int = PIPELINE_SIZE, min_count: int = MIN_COUNT, partitions: int = 1, seed: int = 42
) -> Word2VecModel:
    """Word2Vec over (words). Reproducible only for a fixed seed and partitioning.

    The model holds one vector per word on the driver, so the vocabulary is
    estimated first; a corpus with too many rare words needs a ``min_count``.
    """
    if min_count <= 1:
        distinct = word_lists.select(F.explode("words").alias("w")).agg(F.approx_count_distinct("w")).first()[0]
        if distinct * size > MODEL_CELLS:
            raise ValueError(f"about {distinct} words of {size} numbers do not fit the driver: raise min_count")
    learner = Word2Vec(
        vectorSize=size, minCount=min_count, numPartitions=partitions, seed=seed,
        inputCol="words", outputCol="vector",
    )
    return learner.fit(word_lists.where(F.size("words") > 0))


def word_vectors(model: Word2VecModel) -> DataFrame:
    """(word, vector array<double>)."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def synonyms(model: Word2VecModel, word: str, k: int = SYNONYMS) -> DataFrame:
    """(word, similarity) of the nearest words."""
    return model.findSynonyms(word, k)


def phrase_vectors(phrases: DataFrame, vectors: DataFrame, key: str = "feature") -> DataFrame:
    """(key, vector): a phrase of several words gets the mean of their vectors."""
    words = phrases.select(key, F.explode(F.split(key, " ")).alias("word"))
    found = words.join(vectors, "word").select(key, array_to_vector("vector").alias("v"))
    return found.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("vector"))
