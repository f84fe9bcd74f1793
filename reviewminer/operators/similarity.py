"""Cosine similarity of all pairs, exact, and the matrix view of vectors.

Vectors are dealt into pieces of bounded size that lie close together; every pair
of pieces that can hold a similar pair (``balls``) is one group, compared with one
matrix product. Only pairs above the threshold (or a spanning forest of them) leave
a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .balls import Balls, balls
from .skew import join_hot_keys

STRIP = 512  # rows compared with a block at once
HOT_COPIES = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<double> columns; 0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / norm)


def has_direction(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0.0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vector, n_copies): copies collapsed onto their smallest id."""
    return vectors.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))


def vector_copies(vectors: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(id, copy_of): every id that shares its vector with a smaller id.

    The copied vectors are the large side of a join whose other side has one
    row per vector; a vector with very many copies is split.
    """
    kept = (distinct_vectors(vectors) if kept is None else kept).where("n_copies > 1")
    firsts = kept.select("vector", F.col("id").alias("copy_of"), "n_copies")
    return (
        join_hot_keys(vectors.select("id", "vector"), firsts, "vector", "n_copies", HOT_COPIES)
        .where("id <> copy_of")
        .select("id", "copy_of")
    )


def _kept(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with a direction, computed once."""
    return durable(distinct_vectors(vectors.where(has_direction(F.col("vector")))))


def _meeting(kept: DataFrame, threshold: float, block_rows: int | None) -> Balls:
    return balls(kept.select("id", "vector"), threshold, block_rows, unit(F.col("vector")))


def _block_pairs(kept: DataFrame, threshold: float, block_rows: int | None) -> DataFrame:
    """Rows (bi, bj, b, id, vector): each vector once per pair of pieces it is in."""
    placed = _meeting(kept, threshold, block_rows)
    return placed.pairs(placed.placed)


def skipped_pairs(vectors: DataFrame, threshold: float, block_rows: int | None = None) -> float:
    """The share of all pairs of distinct vectors that ``similar_pairs`` never compares."""
    return _meeting(_kept(vectors), threshold, block_rows).skipped()


Side = tuple[np.ndarray, np.ndarray]


def _sides(pdf: pd.DataFrame) -> tuple[Side, Side, bool]:
    """The two blocks of a group, ordered by id so that results do not depend
    on the arrival order; a block paired with itself is returned twice."""
    low, high = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])

    def side(block: int) -> Side:
        rows = pdf[pdf["b"] == block].sort_values("id")
        return rows["id"].to_numpy(), (np.stack(rows["vector"].to_numpy()) if len(rows) else np.empty((0, 0)))

    left = side(low)
    return (left, left, True) if low == high else (left, side(high), False)


def _pairs_above(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (ids_a, a), (ids_b, b), same = _sides(pd.concat(list(frames)))
        for low in range(0, len(ids_a) if len(ids_b) else 0, STRIP):
            scores = a[low : low + STRIP] @ b.T
            hits = scores > threshold
            if same:
                hits = np.triu(hits, k=1 + low)
            rows, cols = np.nonzero(hits)
            first, second = ids_a[low + rows], ids_b[cols]
            swap = first > second
            yield pd.DataFrame(
                {
                    "id_a": np.where(swap, second, first),
                    "id_b": np.where(swap, first, second),
                    "cosine": scores[rows, cols],
                }
            )

    return compare


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """(id_a, id_b, cosine) with id_a < id_b and cosine > threshold, exact.

    Equal vectors are compared once, under their smallest id; ``vector_copies``
    names the others, so a group of n copies costs n rows and not n squared.
    """
    return _pairs_of(_kept(vectors), vectors, threshold, block_rows)


def _pairs_of(kept: DataFrame, vectors: DataFrame, threshold: float, block_rows: int | None) -> DataFrame:
    kind = vectors.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id_a", kind), T.StructField("id_b", kind), T.StructField("cosine", T.DoubleType())]
    )
    pairs = _block_pairs(kept, threshold, block_rows)
    return pairs.groupBy("bi", "bj").applyInPandas(_pairs_above(threshold), schema)


def similar_pairs_and_copies(vectors: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """The similar pairs, and a row (copy_of, id, 1.0) for every further id of a vector.

    Ids are similar if their firsts are the same or a pair, so no id is lost
    and the rows stay in proportion to the copies.
    """
    kept = _kept(vectors)
    pairs = _pairs_of(kept, vectors, threshold, block_rows)
    if threshold >= 1:
        return pairs
    copies = vector_copies(vectors.where(has_direction(F.col("vector"))), kept)
    return pairs.unionByName(copies.select(F.col("copy_of").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine")))


def _forest(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        (ids_a, a), (ids_b, b), same = _sides(pdf)
        found: list[tuple] = []
        if len(ids_a) and len(ids_b):
            near = np.concatenate([a[low : low + STRIP] @ b.T > threshold for low in range(0, len(a), STRIP)])
            open_a = np.ones(len(ids_a), dtype=bool)
            open_b = np.ones(len(ids_b), dtype=bool)
            for root in range(len(ids_a)):
                if not open_a[root]:
                    continue
                open_a[root] = False
                frontier = np.array([root])
                while len(frontier):
                    reached = near[frontier].any(axis=0) & open_b
                    open_b &= ~reached
                    cols = np.nonzero(reached)[0]
                    back = (near[:, cols].any(axis=1) if len(cols) else np.zeros(len(ids_a), bool)) & open_a
                    open_a &= ~back
                    frontier = np.nonzero(back)[0]
                    found += [(ids_a[root], ids_b[c]) for c in cols if ids_b[c] != ids_a[root]]
                    found += [(ids_a[root], ids_a[r]) for r in frontier]
        return pd.DataFrame(found, columns=["src", "dst"]).drop_duplicates()

    return grow


def connectivity_edges(vectors: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """(src, dst): edges with the same connected components as all similar pairs.

    Every pair of blocks contributes a spanning forest of its similar pairs, so
    a dense group yields as many edges as it has members per block.
    """
    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])
    kept = _kept(vectors)
    forest = _block_pairs(kept, threshold, block_rows).groupBy("bi", "bj").applyInPandas(_forest(threshold), schema)
    usable = vectors.where(has_direction(F.col("vector")))
    copies = vector_copies(usable, kept).select(F.col("id").alias("src"), F.col("copy_of").alias("dst"))
    return forest.unionByName(copies)


def matrix_entries(vectors: DataFrame) -> DataFrame:
    """(row_id, col_id, value): the vectors as a matrix in long format."""
    return vectors.select(F.col("id").alias("row_id"), F.posexplode("vector").alias("col_id", "value"))


def transpose(entries: DataFrame) -> DataFrame:
    """Swap rows and columns; the long format needs no shuffle for it."""
    return entries.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")
