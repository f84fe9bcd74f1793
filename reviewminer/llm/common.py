"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, fresh_path

__all__ = ["ascii_lower", "discard", "enough_tasks", "parallelism", "written"]

#: ASCII white space as the operators understand it, for trimming and as a character class.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: evaluated once, safe against lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def enough_tasks(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores is dealt out anew, row by row; a larger one passes unchanged.

    It serves stages whose work per byte is high (Python, regular expressions),
    for which one small file would keep a single core busy.
    """
    cores = parallelism(df)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
