import numpy as np
import pytest

from reviewminer.operators import synonyms as S


def plain(rows, k):
    ids = np.array([i for i, v in rows if any(v)])
    unit = np.array([v for _, v in rows if any(v)])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, S.DIGITS)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-scores[a, b], ids[b]))[:k]
        out |= {(int(ids[a]), n + 1, int(ids[b]), round(float(scores[a, b]), 6) + 0.0) for n, b in enumerate(order)}
    return out


def found(df, k, block_rows):
    return {(r.id, r.rank, r.other, round(r.cosine, 6) + 0.0) for r in S.nearest_by_cosine(df, k, block_rows).collect()}


@pytest.mark.parametrize("k, block_rows", [(3, 1000), (5, 20), (12, 9)])
def test_nearest_equal_brute_force(spark, monkeypatch, k, block_rows):
    monkeypatch.setattr(S, "HOT_COPIES", 6)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(9, 5))
    rows = [(i, (centres[i % 9] + rng.normal(size=5) * (0.1 if i % 2 else 1.0)).tolist()) for i in range(140)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, [0.0] * 5), (301, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    assert found(df, k, block_rows) == plain(rows, k)


def test_far_shells_are_not_visited(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(12)[i % 12] + rng.normal(size=12) * 0.01).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    visits = []
    made = S._visits
    placed = S.balls(df, -1.0, 50, S.unit(S.F.col("vector")))
    everything = S.stored(placed.placed, "t")
    bounds = everything.groupBy("shell", "piece").applyInPandas(S._bounds(3), "id long, bound double")
    asking = everything.select("id", "vector").join(bounds, "id")
    visits = asking.mapInPandas(made(placed.pivots, placed.shells), "id long, vector array<double>, shells array<long>").collect()
    assert sum(len(v.shells) for v in visits) < 0.3 * len(visits) * len(placed.shells)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, vector array<double>")
    assert found(df, 5, 100) == {(1, 1, 2, 0.707107), (2, 1, 1, 0.707107)}
    assert S.nearest_by_cosine(df.limit(0), 5).count() == 0
    assert S.nearest_by_cosine(df.where("id = 1"), 5).count() == 0
