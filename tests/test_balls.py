import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewminer.operators import balls as B
from reviewminer.operators import similarity as s


def around(spark, centres, each, spread, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.normal(size=(centres, dim)):
        rows += [c + rng.normal(size=dim) * spread for _ in range(each)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vector array<double>").repartition(4)


def pairs_of(matrix, threshold):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return {tuple(p) for p in np.argwhere(np.triu(unit @ unit.T > threshold, 1)).tolist()}


@pytest.mark.parametrize("threshold, spread", [(0.95, 0.1), (0.3, 1.0), (-0.5, 0.5), (0.999999, 0.0005)])
def test_no_pair_is_lost(spark, threshold, spread):
    df = around(spark, 12, 25, spread)
    matrix = np.array([r.vector for r in df.orderBy("id").collect()])
    found = [(r.id_a, r.id_b) for r in s.similar_pairs(df, threshold, 30).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs_of(matrix, threshold)


def test_far_groups_are_skipped_and_bounds_hold(spark):
    df = around(spark, 20, 30, 0.05)
    assert s.skipped_pairs(df, 0.95, 30) > 0.8
    assert s.skipped_pairs(df, 0.95, 10**6) == 0.0
    assert s.skipped_pairs(df.limit(0), 0.95, 30) == 1.0  # of no pairs
    placed = B.balls(df, 0.95, 30, s.unit(F.col("vector")))
    sent = placed.pairs(placed.placed).count()
    assert sent < 600 * len(placed.shells) / 3
    largest = placed.pairs(placed.placed).groupBy("bi", "bj", "b").count().agg(F.max("count")).first()[0]
    assert largest <= 60


def test_one_direction_holds_almost_all(spark):
    """A hot ball is cut into shells, and a shell of one angle into pieces."""
    rows = [(i, [1.0, 1e-9 * i, 0.0]) for i in range(300)] + [(1000 + i, [0.0, math.cos(i), math.sin(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = {(r.id_a, r.id_b) for r in s.similar_pairs(df, 0.99, 20).collect()}
    assert len(found) == 300 * 299 // 2 + len(pairs_of(np.array([v for _, v in rows[300:]]), 0.99))
    placed = B.balls(df, 0.99, 20, s.unit(F.col("vector")))
    assert placed.placed.groupBy("shell", "piece").count().agg(F.max("count")).first()[0] <= 60


def test_joins_without_a_broadcast_give_the_same(spark, monkeypatch):
    df = around(spark, 8, 20, 0.2)
    expected = {(r.id_a, r.id_b) for r in s.similar_pairs(df, 0.9, 15).collect()}
    monkeypatch.setattr(B, "SMALL", 0)
    monkeypatch.setattr(B, "MIN_HOT", 5)
    assert {(r.id_a, r.id_b) for r in s.similar_pairs(df, 0.9, 15).collect()} == expected


def test_pieces_grow_with_the_vectors_and_strips_lose_nothing(spark, monkeypatch):
    from reviewminer.operators import balls as B
    from reviewminer.operators import similarity, synonyms

    assert [B.rows_of_a_piece(n) for n in (0, 30_000, 160_000, 10**9)] == [2048, 2048, 10_000, 16_384]
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(90, 4)), 1))]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    whole = sorted(similarity.similar_pairs(vectors, 0.5).collect())
    edges = sorted(similarity.connectivity_edges(vectors, 0.5).collect())
    near = sorted(synonyms.nearest_by_cosine(vectors, 5).collect())
    monkeypatch.setattr(similarity, "STRIP", 7)
    monkeypatch.setattr(synonyms, "STRIP", 7)
    assert [r[:2] for r in sorted(similarity.similar_pairs(vectors, 0.5).collect())] == [r[:2] for r in whole] and len(whole) > 90
    assert sorted(similarity.connectivity_edges(vectors, 0.5).collect()) == edges
    assert [r[:3] for r in sorted(synonyms.nearest_by_cosine(vectors, 5).collect())] == [r[:3] for r in near] and len(near) == 450
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    monkeypatch.setattr(B, "MOST_ROWS", 20)
    assert [r[:2] for r in sorted(similarity.similar_pairs(vectors, 0.5).collect())] == [r[:2] for r in whole]
    assert [r[:3] for r in sorted(synonyms.nearest_by_cosine(vectors, 5).collect())] == [r[:3] for r in near]
