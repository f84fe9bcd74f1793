"""Report tables and their text form, one line per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_report(top: DataFrame, members: DataFrame) -> DataFrame:
    """(rank, line, text): a head line per cluster, then one line per member.

    Members stay rows: a cluster may own most n-grams, so its members are never
    gathered into one cell.
    """
    heads = top.select(
        "rank",
        F.lit(0).alias("line"),
        F.format_string("%s: %d | Feature: %s", "representative", "n_reviews", "feature").alias("text"),
    )
    joined = members.join(F.broadcast(top.select("cluster_id", "rank")), "cluster_id")
    words = F.concat_ws(", ", F.when(F.col("w2") != "", F.col("w2")), "modifier", "feature")
    rows = joined.select("rank", F.lit(1).alias("line"), words.alias("text"))
    return heads.unionByName(rows)


def modifier_report(weights: DataFrame) -> DataFrame:
    """(coef, text) lines of a weight table."""
    return weights.select(
        "coef", F.format_string("(%s,%s): %s", "modifier", "feature", F.col("coef").cast("string")).alias("text")
    )


def write_lines(report: DataFrame, path: str, *order: str) -> None:
    """Save the ``text`` column in the given order."""
    report.orderBy(*order).select("text").write.mode("errorifexists").text(path)
