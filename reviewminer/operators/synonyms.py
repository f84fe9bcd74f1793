"""The nearest vectors of every vector by cosine: synonyms of all words, exact.

Copies of a vector are looked up once. The others lie in balls (``balls``); each
vector first meets its own piece, whose k-th best cosine bounds what is still worth
a look, and then only the shells that the triangle inequality cannot rule out under
that bound. Shell pieces meet their visitors in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .balls import SLACK, Balls, _angles, balls, rows_of_a_piece
from .similarity import HOT_COPIES, STRIP, distinct_vectors, has_direction, unit
from .skew import join_hot_keys

DIGITS = 9  # cosines that agree to so many digits are ties


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, in any order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _bounds(k: int):
    """(id, bound): the k-th best cosine of each row within its piece; -1 if the piece has fewer others."""

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, least = np.stack(pdf["vector"].to_numpy()), np.full(len(pdf), -1.0)
        for low in range(0, len(pdf) if len(pdf) > k else 0, STRIP):
            scores = vectors[low : low + STRIP] @ vectors.T
            scores[np.arange(len(scores)), low + np.arange(len(scores))] = -np.inf
            least[low : low + STRIP] = np.sort(np.take_along_axis(scores, _best(scores, k), axis=1), axis=1)[:, 0]
        return pd.DataFrame({"id": pdf["id"], "bound": least})

    return bound


def _visits(pivots: np.ndarray, shells: pd.DataFrame):
    ball, low, high, name = (shells[c].to_numpy() for c in ("ball", "low", "high", "shell"))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                yield pdf.assign(shells=pd.Series(dtype=object))[["id", "vector", "shells"]]
                continue
            reach = _angles(pdf["bound"].to_numpy())[:, None] + SLACK
            if len(pivots) > 1:
                away = _angles(np.stack(pdf["vector"].to_numpy()) @ pivots.T)[:, ball]
                meets = np.maximum(away - high, low - away) <= reach
            else:
                meets = np.ones((len(pdf), len(shells)), bool)
            yield pd.DataFrame({"id": pdf["id"], "vector": pdf["vector"], "shells": [name[m] for m in meets]})

    return visit


def _nearest(k: int):
    """(id, other, cosine): each visitor's best of a piece."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        visitors, rows = pdf[pdf["visitor"]], pdf[~pdf["visitor"]].sort_values("id")
        if not len(visitors) or not len(rows):
            return pd.DataFrame({"id": pdf["id"][:0], "other": pdf["id"][:0], "cosine": np.empty(0)})
        ids, others = visitors["id"].to_numpy(), rows["id"].to_numpy()
        asked, given = np.stack(visitors["vector"].to_numpy()), np.stack(rows["vector"].to_numpy())
        return pd.concat([strip(ids[i : i + STRIP], asked[i : i + STRIP], others, given) for i in range(0, len(ids), STRIP)])

    def strip(ids, asked, others, given) -> pd.DataFrame:
        scores = np.round(asked @ given.T, DIGITS)
        scores[ids[:, None] == others[None, :]] = -np.inf
        least = np.take_along_axis(scores, _best(scores, k), axis=1).min(axis=1)
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        order = np.lexsort((col, -scores[row, col], row))  # ties to the smaller id
        row, col = row[order], col[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[best], col[best]
        return pd.DataFrame({"id": ids[row], "other": others[col], "cosine": scores[row, col]})

    return find


def _met(placed: Balls, everything: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, other, cosine): for every distinct vector at least its k nearest others."""
    spark, kind = everything.sparkSession, everything.schema["id"].dataType.simpleString()
    bounds = everything.groupBy("shell", "piece").applyInPandas(_bounds(k), f"id {kind}, bound double")
    asking = everything.select("id", "vector").join(bounds, "id")
    found = asking.mapInPandas(_visits(placed.pivots, placed.shells), f"id {kind}, vector array<double>, shells array<long>")
    visits = stored(found, "synonym-visits").withColumn("shell", F.explode("shells")).drop("shells")  # written once for each vector
    many = {r["shell"]: -(-r["count"] // block_rows) for r in visits.groupBy("shell").count().collect()}  # one row per shell
    shells = [(int(s), int(p), int(many.get(s, 0))) for s, p in zip(placed.shells["shell"], placed.shells["pieces"], strict=True)]
    sizes = F.broadcast(spark.createDataFrame(shells, "shell long, pieces long, chunks long").where("chunks > 0"))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    visitors = visits.join(sizes, "shell").select(
        "shell", each("pieces").alias("piece"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), F.lit(True).alias("visitor"), "id", "vector"
    )
    visited = everything.join(sizes, "shell").select(
        "shell", F.col("piece").cast("bigint").alias("piece"), each("chunks").alias("chunk"), F.lit(False).alias("visitor"), "id", "vector"
    )
    groups = visitors.unionByName(visited).groupBy("shell", "piece", "chunk")
    return groups.applyInPandas(_nearest(k), f"id {kind}, other {kind}, cosine double")


def nearest_by_cosine(vectors: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """(id, rank, other, cosine): the ``k`` others of highest cosine of every vector, all if there are fewer.

    vectors(id, vector); ids are unique. Cosines are rounded to ``DIGITS`` digits, ties go to the
    smaller id. Vectors without a direction take no part.
    """
    usable = stored(vectors.where(has_direction(F.col("vector"))).select("id", "vector"), "synonym-vectors")
    kept = stored(distinct_vectors(usable), "synonym-distinct")
    block_rows = block_rows or rows_of_a_piece(kept.count())
    placed = balls(kept.select("id", "vector"), -1.0, block_rows, unit(F.col("vector")))
    everything = stored(placed.placed, "synonym-placed")

    # Every distinct vector stands for its copies; the k + 1 smallest are enough for any list.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = usable.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    copies = first.join(kept.select("vector", F.col("id").alias("of")), "vector").select("of", F.col("id").alias("copy"))
    by_vector = copies.groupBy("of").agg(F.sort_array(F.collect_list("copy")).alias("copies"))

    near = _met(placed, everything, k, block_rows)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    itself = kept.select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    near = stored(near.unionByName(itself), "synonym-near")  # written, so that both parts are shuffled alike below
    asked = near.groupBy("other").agg(F.count(F.lit(1)).alias("many"))
    listed = by_vector.withColumnRenamed("of", "other").join(asked, "other")
    others = join_hot_keys(near, listed, "other", "many", HOT_COPIES).select("id", F.explode("copies").alias("other"), "cosine")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    lists = others.withColumn("rank", best).where(F.col("rank") <= k + 1)
    lists = lists.groupBy(F.col("id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "other", "cosine"))).alias("found"))

    firsts = kept.select("vector", F.col("id").alias("of"), "n_copies").join(lists, "of").select("vector", "n_copies", "found")
    mine = join_hot_keys(usable, firsts, "vector", "n_copies", HOT_COPIES)
    rest = F.slice(F.filter("found", lambda f: f["other"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(rest).alias("at", "f")).select("id", (F.col("at") + 1).alias("rank"), "f.other", "f.cosine")
