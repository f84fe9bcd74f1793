"""Greedy leader clustering in a fixed priority order.

An item joins the first leader it is similar to, else becomes a leader. The
leaders are the lexicographically first maximal independent set of the similarity
graph, found in rounds: an open item leads if no similar open item precedes it,
and items similar to a new leader close. What is left open once it fits one task
is settled there one by one. Then every item looks for its first leader. The
outcome equals the one-by-one order; vectors and leaders never come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .balls import balls
from .ranking import with_positions
from .similarity import HOT_COPIES, has_direction, unit
from .skew import join_hot_keys

BATCH = 4096  # items settled in one task
_NONE = np.iinfo(np.int64).max


def _one_by_one(threshold: float):
    """(id, leader) of at most a batch of items, by position."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, vectors = pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy())
        near = (vectors @ vectors.T) > threshold
        leader = np.full(len(ids), -1)
        for i in range(len(ids)):
            if leader[i] < 0:  # nothing before it leads it
                leader[i] = i
                leader[i + 1 :] = np.where((leader[i + 1 :] < 0) & near[i, i + 1 :], i, leader[i + 1 :])
        return pd.DataFrame({"id": ids, "leader": ids[leader]})

    return settle


def _first_before(threshold: float):
    """(id, first): for rows of two pieces the first marked row of the other that is similar and precedes, if there is one."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        left = pdf[pdf["b"] == low]
        right = left if low == high else pdf[pdf["b"] == high]
        found = []
        if len(left) and len(right) and (left["marked"].any() or right["marked"].any()):
            near = np.stack(left["vector"].to_numpy()) @ np.stack(right["vector"].to_numpy()).T > threshold
            for rows, others, hit in ((left, right, near), (right, left, near.T))[: 1 if low == high else 2]:
                ids, marked = rows["id"].to_numpy(), others["marked"].to_numpy()
                before = others["id"].to_numpy()[marked]
                hit = hit[:, marked] & (before[None, :] < ids[:, None])
                first = np.where(hit, before[None, :], _NONE).min(axis=1, initial=_NONE)
                found.append(pd.DataFrame({"id": ids[first < _NONE], "first": first[first < _NONE]}))
        return pd.concat(found) if found else pd.DataFrame({"id": np.empty(0, np.int64), "first": np.empty(0, np.int64)})

    return find


def _leaders_by_position(ranked: DataFrame, threshold: float, batch: int) -> DataFrame:
    """(id, leader) for ranked(id, vector), ids being positions."""
    few = T.StructType([T.StructField("id", T.LongType()), T.StructField("leader", T.LongType())])

    def settled(rows: DataFrame) -> DataFrame:
        return rows.select("id", "vector", F.lit(0).alias("one")).groupBy("one").applyInPandas(_one_by_one(threshold), few)

    if ranked.limit(batch + 1).count() <= batch:
        return settled(ranked)
    placed = balls(ranked, threshold, batch, F.col("vector"))
    everything = stored(placed.placed, "leader-items")

    def firsts(rows: DataFrame) -> DataFrame:
        met = placed.pairs(rows).groupBy("bi", "bj").applyInPandas(_first_before(threshold), "id long, first long")
        return met.groupBy("id").agg(F.min("first").alias("first"))

    leaders: list[DataFrame] = []
    open_ = everything
    while open_.limit(batch + 1).count() > batch:
        preceded = firsts(open_.withColumn("marked", F.lit(True))).select("id", F.lit(True).alias("preceded"))
        judged = stored(open_.join(preceded, "id", "left").withColumn("marked", F.col("preceded").isNull()).drop("preceded"), "leader-round")
        leaders.append(judged.where("marked").select("id"))
        closed = firsts(judged).select("id")
        open_ = stored(judged.where("not marked").drop("marked").join(closed, "id", "left_anti"), "leader-open")
    last = stored(settled(open_), "leader-rest")
    leaders.append(last.where("id = leader").select("id"))
    every = leaders[0]
    for part in leaders[1:]:
        every = every.unionByName(part)
    marked = everything.join(every.withColumn("marked", F.lit(True)), "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    marked = stored(marked, "leader-marked")
    joined = marked.select("id").join(firsts(marked), "id", "left")
    return joined.select("id", F.coalesce("first", "id").alias("leader"))


def leader_clusters(items: DataFrame, threshold: float, batch: int = BATCH) -> DataFrame:
    """(id, leader) for items(id, priority, vector), highest priority first.

    Ties go to the smaller id. Items without a direction lead only themselves.
    Copies of a vector follow the first of them.
    """
    if not 0.0 <= threshold < 1.0:
        raise ValueError("0 <= threshold < 1 expected")
    directed = has_direction(F.col("vector"))
    alone = items.where(~directed).select("id", F.col("id").alias("leader"))
    todo = stored(items.where(directed).select("id", "priority", unit(F.col("vector")).alias("vector")), "leader-todo")
    best = F.struct(F.col("priority").isNull().alias("none"), (-F.col("priority")).alias("late"), "id", "priority")
    firsts = todo.groupBy("vector").agg(F.min(best).alias("f"), F.count(F.lit(1)).alias("n_copies"))
    firsts = firsts.select("vector", "n_copies", F.col("f.id").alias("name"), F.col("f.priority").alias("priority"))
    ranked = stored(with_positions(firsts, F.desc("priority"), "name"), "leader-ranks")
    found = stored(_leaders_by_position(ranked.select(F.col("pos").alias("id"), "vector"), threshold, batch), "leader-found")
    names = ranked.select(F.col("pos").alias("leader"), F.col("name").alias("leader_name"))
    sizes = found.groupBy("leader").agg(F.count(F.lit(1)).alias("many"))
    named = join_hot_keys(found.withColumnRenamed("id", "pos"), names.join(sizes, "leader"), "leader", "many", HOT_COPIES)
    by_vector = ranked.join(named.select("pos", "leader_name"), "pos").select("vector", "n_copies", F.col("leader_name").alias("leader"))
    return join_hot_keys(todo.select("id", "vector"), by_vector, "vector", "n_copies", HOT_COPIES).select("id", "leader").unionByName(alone)
