"""Counting n-grams and clustering them by feature.

A strategy maps keys to clusters: ``assignment(key, cluster_id)``, where the key
is the ``feature`` of an n-gram or its first window word ``w2``. None stands for
the exact strategy, in which every feature is its own cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .graph import components
from .leaders import leader_clusters
from .similarity import connectivity_edges
from .skew import join_hot_keys

# Report length and similarity threshold.
TOP = 25
THRESHOLD = 0.95

HOT_ROWS = 200_000
Strategy = Callable[[DataFrame, float], "DataFrame | None"]


def ngram_stats(ngrams: DataFrame) -> DataFrame:
    """(w2, modifier, feature, cnt, sum_y, sum_yy) of rated n-grams.

    Counts, clusters, histograms and weights all derive from this one table; it
    is the only aggregate that touches the texts.
    """
    y = F.col("overall").cast("double")
    return ngrams.groupBy("w2", "modifier", "feature").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy")
    )


def key_totals(stats: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its counts and its most frequent n-gram."""
    return stats.groupBy(*keys).agg(
        F.sum("cnt").alias("n_reviews"),
        F.count(F.lit(1)).alias("n_ngrams"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), "w2", "modifier", "feature")).alias("best"),
    )


def cluster_key(assignment: DataFrame | None) -> str:
    if assignment is None:
        return "feature"
    return next(c for c in assignment.columns if c != "cluster_id")


def build_clusters(
    stats: DataFrame, assignment: DataFrame | None = None, drop_singletons: bool = False
) -> DataFrame:
    """clusters(cluster_id, feature, representative, n_reviews, n_ngrams, n_features).

    ``feature`` is the most frequent feature; ties go to the smaller string.
    ``drop_singletons`` removes n-grams without any partner.
    """
    if assignment is None:
        merged = key_totals(stats, "feature").select(
            F.col("feature").alias("cluster_id"), "feature", "best", "n_reviews", "n_ngrams",
            F.lit(1).cast("long").alias("n_features"),
        )
    else:
        merged = _merged(stats, assignment)
    if drop_singletons:
        merged = merged.where("n_ngrams > 1")
    return merged.select(
        "cluster_id",
        "feature",
        F.ltrim(F.concat_ws(" ", "best.w2", "best.modifier", "best.feature")).alias("representative"),
        "n_reviews",
        "n_ngrams",
        "n_features",
    )


def _merged(stats: DataFrame, assignment: DataFrame) -> DataFrame:
    key = cluster_key(assignment)
    per_feature = _assigned(key_totals(stats, *dict.fromkeys((key, "feature"))), assignment)
    if key != "feature":  # a feature may reach a cluster under several keys
        per_feature = per_feature.groupBy("cluster_id", "feature").agg(
            F.sum("n_reviews").alias("n_reviews"), F.sum("n_ngrams").alias("n_ngrams"), F.min("best").alias("best")
        )
    return per_feature.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("n_reviews")).alias("neg"), "feature")).getField("feature").alias("feature"),
        F.min("best").alias("best"),
        F.sum("n_reviews").alias("n_reviews"),
        F.sum("n_ngrams").alias("n_ngrams"),
        F.count(F.lit(1)).alias("n_features"),
    )


def top_clusters(clusters: DataFrame, k: int = TOP, by: str = "n_reviews") -> DataFrame:
    """The ``k`` largest clusters with their rank (the window sees k rows)."""
    best = clusters.orderBy(F.desc(by), "feature").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "feature")))


def cluster_members(stats: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """(cluster_id, w2, modifier, feature, cnt): every member n-gram, one per row."""
    return _assigned(stats.select("w2", "modifier", "feature", "cnt"), assignment)


def modifier_histogram(stats: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """(cluster_id, modifier, n_windows, n_reviews): distinct windows and reviews."""
    per_key = stats.groupBy(cluster_key(assignment), "modifier").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("cnt").alias("n_reviews")
    )
    per_cluster = _assigned(per_key, assignment)
    if assignment is None:
        return per_cluster.select("cluster_id", "modifier", "n_windows", "n_reviews")
    return per_cluster.groupBy("cluster_id", "modifier").agg(
        F.sum("n_windows").alias("n_windows"), F.sum("n_reviews").alias("n_reviews")
    )


def _assigned(rows: DataFrame, assignment: DataFrame | None) -> DataFrame:
    """Add ``cluster_id``; a key with very many rows is split over several tasks."""
    key = cluster_key(assignment)
    if assignment is None:
        return rows.withColumn("cluster_id", F.col(key))
    weights = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    keyed = assignment.join(weights, key)
    return join_hot_keys(rows, keyed, key, "__n", HOT_ROWS).drop("__n")


def exact(items: DataFrame, threshold: float) -> None:
    """Same feature string, same cluster; needs neither vectors nor a join."""
    return None


def similarity(items: DataFrame, threshold: float) -> DataFrame:
    """Greedy: an item joins the most frequent similar leader, else leads."""
    return leader_clusters(items, threshold).select("id", F.col("leader").alias("cluster_id"))


def allpairs(items: DataFrame, threshold: float) -> DataFrame:
    """Connected components of the graph of all similar pairs."""
    items = durable(items.select("id", "vector"))
    found = components(connectivity_edges(items, threshold), items.select("id"))
    return found.select("id", F.col("component").alias("cluster_id"))


STRATEGIES: dict[str, Strategy] = {"exact": exact, "similarity": similarity, "allpairs": allpairs}


def assign(
    stats: DataFrame, vectors: DataFrame | None, threshold: float, algorithm: str, key: str = "feature"
) -> DataFrame | None:
    """Run a strategy over the distinct keys: items(id, priority, vector).

    ``vectors(key, vector)`` may lack keys; those stay alone.
    """
    if algorithm == "exact":
        return None
    counts = stats.groupBy(F.col(key).alias("id")).agg(F.sum("cnt").alias("priority"))
    items = counts.join(vectors.select(F.col(key).alias("id"), "vector"), "id", "left")
    return STRATEGIES[algorithm](items, threshold).withColumnRenamed("id", key)
