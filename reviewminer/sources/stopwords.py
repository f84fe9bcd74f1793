"""Stop-word files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

MAX_STOPWORDS = 10_000


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Distinct tokens of a stop-word file, read with the review tokeniser.

    They end up as a literal hash set in the plan, hence the size check.
    """
    words = spark.read.text(path).select(F.explode(tokens(F.col("value"))).alias("word")).distinct()
    found = [row.word for row in words.limit(MAX_STOPWORDS + 1).collect()]
    if len(found) > MAX_STOPWORDS:
        raise ValueError(f"more than {MAX_STOPWORDS} stop words in {path}")
    return tuple(sorted(found))
