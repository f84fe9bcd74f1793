"""Ridge weights of modifiers from grouped sums: one query for all clusters.

Every review carries at most one n-gram, so the design matrix is one-hot and
counts and sums determine the fit. With standardised columns and a penalty
scaled by the rating's deviation the solution is

    u_j = 1 / (1 + reg / sigma * (1 - p_j))
    coef_j = u_j * (d_j + S / (1 - Q)),  S = sum p_j u_j d_j,  Q = sum p_j u_j

where p_j is the share of reviews with modifier j and d_j the deviation of
their mean rating from the overall mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import TOP, cluster_key, modifier_histogram

# Penalty and the smallest number of windows of a modifier.
REG_PARAM = 0.05
MIN_WINDOWS = 2

_EMPTY = 1e-12


def _scope_sums(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.struct(F.sum("cnt").alias("n"), F.sum("sum_y").alias("s"), F.sum("sum_yy").alias("q"))
    )


def _sums_by_modifier(
    stats: DataFrame, hist: DataFrame, assignment: DataFrame | None, scope: str
) -> DataFrame:
    """(cluster_id, modifier, n_windows, n_reviews, n_j, s_j)."""
    if scope == "any_feature":
        sums = stats.groupBy("modifier").agg(F.sum("cnt").alias("n_j"), F.sum("sum_y").alias("s_j"))
        return hist.join(sums, "modifier")
    if scope != "same_feature":
        raise ValueError("scope is 'any_feature' or 'same_feature'")
    key = cluster_key(assignment)
    per_key = stats.groupBy(key, "modifier").agg(F.sum("cnt").alias("n_j"), F.sum("sum_y").alias("s_j"))
    if assignment is None:
        sums = per_key.withColumnRenamed(key, "cluster_id")
    else:
        sums = (
            per_key.join(assignment, key)
            .groupBy("cluster_id", "modifier")
            .agg(F.sum("n_j").alias("n_j"), F.sum("s_j").alias("s_j"))
        )
    return hist.join(sums, ["cluster_id", "modifier"])


def modifier_weights(
    stats: DataFrame,
    top: DataFrame,
    assignment: DataFrame | None = None,
    *,
    min_windows: int = MIN_WINDOWS,
    scope: str = "any_feature",
    reg_param: float = REG_PARAM,
) -> DataFrame:
    """(rank, cluster_id, feature, modifier, n_windows, n_reviews, coef).

    ``top`` comes from ``top_clusters``; its LIMIT bounds the broadcasts here.
    """
    heads = F.broadcast(top.select("cluster_id", "rank", "feature"))
    hist = modifier_histogram(stats, assignment).join(heads, "cluster_id").where(F.col("n_windows") >= min_windows)
    sums = _sums_by_modifier(stats, hist, assignment, scope)

    rows = sums.withColumn("all", _scope_sums(stats).scalar())
    n, mean = F.col("all.n"), F.col("all.s") / F.col("all.n")
    spread = F.col("all.q") / n - mean * mean
    sigma = F.sqrt(F.greatest(spread, F.lit(0.0)))
    share = F.col("n_j") / n
    rows = rows.select(
        "rank", "cluster_id", "feature", "modifier", "n_windows", "n_reviews",
        share.alias("p"), (F.col("s_j") / F.col("n_j") - mean).alias("d"), sigma.alias("sigma"),
    )
    shrink = F.lit(1.0) / (F.lit(1.0) + F.lit(reg_param) / F.col("sigma") * (F.lit(1.0) - F.col("p")))
    varies = (F.col("sigma") > _EMPTY) & (F.col("p") < 1.0)
    rows = rows.withColumn("u", F.when(varies, shrink).otherwise(F.lit(0.0)))
    per_cluster = rows.groupBy("cluster_id").agg(
        F.sum(F.col("p") * F.col("u") * F.col("d")).alias("S"), F.sum(F.col("p") * F.col("u")).alias("Q")
    )
    return rows.join(F.broadcast(per_cluster), "cluster_id").select(
        "rank", "cluster_id", "feature", "modifier", "n_windows", "n_reviews", _coefficient().alias("coef")
    )


def _coefficient() -> Column:
    pull = F.when(F.col("Q") < 1.0, F.col("S") / (F.lit(1.0) - F.col("Q"))).otherwise(F.lit(0.0))
    return F.when(F.col("u") == 0.0, F.lit(0.0)).otherwise(F.col("u") * (F.col("d") + pull))


def top_modifiers(weights: DataFrame, positive: bool = True, k: int = TOP) -> DataFrame:
    """The ``k`` most positive or most negative (modifier, feature) pairs."""
    first = F.desc("coef") if positive else F.asc("coef")
    return weights.orderBy(first, "feature", "modifier").limit(k)
