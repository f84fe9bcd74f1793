"""Which vectors can be similar at all: balls around pivots and the triangle inequality.

Unit vectors lie on a sphere, where the angle is a metric. Every vector joins the
ball of its nearest pivot; large balls are cut into shells by the angle to the
pivot, and shells into pieces of bounded size. Two pieces meet only if the angle
between their pivots and the range of angles inside leave room for a pair within
the asked angle, so no pair is lost, and a vector is sent only where it may find one.

The pivots are means of a bounded sample. They and the shells, at most ``PIVOTS``
times ``SHELLS`` rows, are the only things the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .skew import join_hot_keys

PIVOTS = 1024
SHELLS = 4
BLOCK_ROWS, MOST_ROWS = 2048, 16_384  # of a piece, from few vectors to many
PIECES = 16  # from which on pieces grow before there are more of them
SAMPLE = 16  # sampled vectors per pivot
ROUNDS = 4  # of moving pivots to the means of their sampled vectors
SLACK = 1e-6  # of an angle, far above the rounding of a cosine
SMALL = 1_000_000  # partners that are broadcast
MIN_HOT = 100_000
_SUB = 1 << 32


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit means of ``count`` parts of the sample, first ones taken far from each other."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    pivots = sample[chosen]
    for _ in range(ROUNDS):
        part = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, part, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), pivots)
    return pivots


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _nearest(pivots: np.ndarray):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                yield pdf.assign(ball=np.empty(0, np.int64), angle=np.empty(0))
                continue
            cosines = np.stack(pdf["vector"].to_numpy()) @ pivots.T
            ball = cosines.argmax(axis=1)
            yield pdf.assign(ball=ball.astype(np.int64), angle=_angles(cosines[np.arange(len(pdf)), ball]))

    return place


@dataclass
class Balls:
    """``placed`` has the given columns with shell and piece; ``shells`` is one row per shell, ``partners`` one with its list."""

    placed: DataFrame
    shells: pd.DataFrame
    partners: DataFrame
    meets: np.ndarray
    pivots: np.ndarray

    def pairs(self, rows: DataFrame) -> DataFrame:
        """(bi, bj, b, ...): each of ``rows``, placed ones or some of them, once for each pair of pieces it is in."""
        if int(self.meets.sum()) <= SMALL:
            met = rows.join(F.broadcast(self.partners.drop("held")), "shell")
        else:
            met = join_hot_keys(rows, self.partners, "shell", "held", MIN_HOT).drop("held")
        met = met.withColumn("__with", F.explode("with"))
        met = met.withColumn("__other", F.explode(F.transform(F.sequence(F.lit(0), F.col("__with.pieces") - 1), lambda u: F.col("__with.shell") * _SUB + u)))
        own = F.col("shell") * _SUB + F.col("piece")
        return met.select(
            F.least(own, "__other").alias("bi"), F.greatest(own, "__other").alias("bj"), own.alias("b"),
            *[c for c in rows.columns if c not in ("shell", "piece")],
        )

    def skipped(self) -> float:
        """The share of all pairs of vectors that never meet."""
        held = self.shells["held"].to_numpy(float)
        return 1.0 - float(held @ self.meets @ held) / max(float(held.sum()) ** 2, 1.0)


def _meeting(pivots: np.ndarray, shells: pd.DataFrame, widest: float) -> np.ndarray:
    """Pairs of shells that may hold vectors within the angle ``widest``."""
    ball, low, high = (shells[c].to_numpy() for c in ("ball", "low", "high"))
    between = _angles(pivots @ pivots.T)
    np.fill_diagonal(between, 0.0)
    apart = between[ball][:, ball] - high[:, None] - high[None, :]  # balls do not touch
    inside = low[:, None] - between[ball][:, ball] - high[None, :]  # one shell lies around the other ball
    return np.maximum(apart, np.maximum(inside, inside.T)) <= widest + SLACK


def rows_of_a_piece(total: int) -> int:
    """Every piece is sent to each it meets, so what is shuffled falls with their size; tasks compare them in strips."""
    return max(BLOCK_ROWS, min(MOST_ROWS, total // PIECES))


def balls(vectors: DataFrame, threshold: float, block_rows: int | None, unit: Column, hashed: str = "id", pivots: int = PIVOTS) -> Balls:
    """Place ``vectors`` for pairs of cosine above ``threshold``; ``unit`` makes their direction from a row.

    There are about as many balls as blocks of ``block_rows``, at most ``pivots``; the rows of a
    shell are dealt into pieces of about that size by a hash of ``hashed``. Without it the size follows their number.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("vector", unit)
    total = rows.count()
    block_rows = block_rows or rows_of_a_piece(total)
    if total <= block_rows:  # one piece that meets itself
        shells = pd.DataFrame({"shell": [0], "ball": [0], "held": [total], "low": [0.0], "high": [0.0], "pieces": [1]})
        return _balls(rows.withColumns({"shell": F.lit(0).cast("bigint"), "piece": F.lit(0).cast("bigint")}), shells, np.ones((1, 1), bool), np.zeros((1, 1)))
    count = min(pivots, math.ceil(total / block_rows))
    sample = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(count * SAMPLE).collect()
    centres = _pivots(np.array([r["vector"] for r in sample]), count)
    schema = T.StructType([*rows.schema.fields, T.StructField("ball", T.LongType()), T.StructField("angle", T.DoubleType())])
    placed = stored(rows.mapInPandas(_nearest(centres), schema), "balls")
    cuts = [i / SHELLS for i in range(1, SHELLS)]
    cut = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", cuts, 1000).alias("cuts"))
    cut = cut.select("ball", F.when(F.col("n") > block_rows, F.col("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts"))
    shell = F.col("ball") * SHELLS + F.size(F.filter("cuts", lambda c: F.col("angle") > c))
    placed = placed.join(F.broadcast(cut), "ball").withColumn("shell", shell)  # one row per pivot
    about = placed.groupBy("shell").agg(
        F.first("ball").alias("ball"), F.count(F.lit(1)).alias("held"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    shells = about.orderBy("shell").toPandas()
    shells["pieces"] = -(-shells["held"] // block_rows)
    widest = math.acos(max(-1.0, min(1.0, threshold)))
    meets = _meeting(centres, shells, widest)
    sizes = F.broadcast(spark.createDataFrame(shells[["shell", "pieces"]]))  # one row per shell
    placed = placed.join(sizes, "shell").withColumn("piece", F.pmod(F.xxhash64(hashed), F.col("pieces")))
    return _balls(placed.select(*rows.columns, "shell", "piece"), shells, meets, centres)


def _balls(placed: DataFrame, shells: pd.DataFrame, meets: np.ndarray, centres: np.ndarray) -> Balls:
    names, pieces = shells["shell"].tolist(), shells["pieces"].tolist()
    lists = [(s, int(h), [(names[j], int(pieces[j])) for j in np.nonzero(m)[0]]) for s, h, m in zip(names, shells["held"], meets, strict=True)]
    partners = placed.sparkSession.createDataFrame(lists, "shell long, held long, with array<struct<shell: long, pieces: long>>")
    return Balls(placed, shells, partners, meets, centres)
