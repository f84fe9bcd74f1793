import random

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from reviewminer.operators import bow, ridge
from reviewminer.operators.tokens import word_counts, word_lists

WORDS = "sound price battery screen case cable colour".split()


def direct(counts, labels, reg):
    """Coefficients of the same model by a dense solve."""
    x, y = np.asarray(counts, float), np.asarray(labels, float)
    sigma, deviation = y.std(), x.std(axis=0)
    varies = deviation > 1e-9
    out = np.zeros(x.shape[1])
    if sigma > 1e-9 and varies.any():
        z = (x - x.mean(axis=0))[:, varies] / deviation[varies]
        system = z.T @ z / len(y) + reg / sigma * np.eye(varies.sum())
        out[varies] = np.linalg.solve(system, z.T @ (y - y.mean()) / len(y)) / deviation[varies]
    return out


def counted(texts, vocab):
    return [[t.split().count(w) for w in vocab] for t in texts]


def texts(seed, n, words=WORDS):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(words, k=rng.randint(0, 9))), rng.randint(1, 5)) for _ in range(n)]


def test_many_steps_give_the_exact_solution(spark, reviews_of):
    data = texts(1, 120)
    df = reviews_of(data)
    got = {r.word: r.coef for r in bow.bow_regression(df, max_iter=10).collect()}
    assert set(got) == set(WORDS)
    assert [got[w] for w in WORDS] == pytest.approx(direct(counted([t for t, _ in data], WORDS), [y for _, y in data], bow.REG_PARAM), abs=1e-9)
    points = CountVectorizerModel.from_vocabulary(WORDS, inputCol="words", outputCol="features").transform(word_lists(df)).join(df, "review_id")
    model = LinearRegression(regParam=bow.REG_PARAM, solver="normal").fit(points.select(F.col("overall").alias("label"), "features"))
    assert [got[w] for w in WORDS] == pytest.approx(model.coefficients.toArray(), abs=1e-6)


@pytest.mark.parametrize("small", [10**6, 0])
def test_groups_are_models_of_their_own(spark, reviews_of, monkeypatch, small):
    """Also with every join split and nothing broadcast; one group is constant, one has one row, one is null."""
    monkeypatch.setattr(ridge, "SMALL", small)
    monkeypatch.setattr(bow, "SMALL", small)
    monkeypatch.setattr(ridge, "MIN_HOT", 3)
    monkeypatch.setattr(bow, "_MIN_HOT", 3)
    data = texts(2, 90) + [(t, 4) for t, _ in texts(3, 20)] + [("sound " * 12, 5)]
    name = F.when(F.col("review_id") < 50, "a").when(F.col("review_id") < 90, None).when(F.col("review_id") < 110, "c").otherwise("d")
    df = reviews_of(data).withColumn("source_file", name)
    found = bow.bow_models(df, "source_file", min_count=6, max_iter=10).collect()
    for group, part in {"a": data[:50], None: data[50:90], "c": data[90:110], "d": data[110:]}.items():
        words = [w for w in WORDS if sum(t.split().count(w) for t, _ in part) >= 6]
        wanted = dict(zip(words, direct(counted([t for t, _ in part], words), [y for _, y in part], bow.REG_PARAM), strict=True)) if len(part) > 1 else {"sound": 0.0}
        assert {r.word: r.coef for r in found if r.group == group} == pytest.approx(wanted, abs=1e-8)
        assert {r.word: r.n for r in found if r.group == group} == {w: sum(t.split().count(w) for t, _ in part) for w in wanted}


def test_one_job_for_all_groups_takes_the_steps_of_one(spark, reviews_of, monkeypatch):
    df = reviews_of(texts(4, 200)).withColumn("source_file", F.pmod(F.col("review_id").cast("int"), F.lit(40)))
    steps = []
    made = ridge._lengths
    monkeypatch.setattr(ridge, "_lengths", lambda moved: steps.append(1) or made(moved))
    assert bow.bow_models(df, "source_file", min_count=1, max_iter=5).select("group").distinct().count() == 40
    assert len(steps) == 5


def test_ten_steps_lower_the_loss_as_far_as_the_library_does(spark, reviews_of):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    data = texts(5, 400, words)
    df = reviews_of(data)
    vocab = [r.word for r in bow.vocabulary(word_counts(df), 1).orderBy("pos").collect()]
    x, y = np.array(counted([t for t, _ in data], vocab), float), np.array([v for _, v in data], float)

    def loss(coef):
        rest = y - y.mean() - (x - x.mean(axis=0)) @ coef
        return (rest @ rest) / 2 / len(y) + bow.REG_PARAM / y.std() / 2 * ((coef * x.std(axis=0)) ** 2).sum()

    got = {r.word: r.coef for r in bow.bow_regression(df, min_count=1).collect()}
    model = LinearRegression(maxIter=10, regParam=bow.REG_PARAM, solver="l-bfgs").fit(bow.bow_points(df, bow.vocabulary(word_counts(df), 1), None, 3.0))
    best = loss(direct(x, y, bow.REG_PARAM))
    assert best <= loss(np.array([got[w] for w in vocab])) <= loss(model.coefficients.toArray()) + 1e-9


def test_no_texts_and_unrated_reviews(spark, reviews_of):
    assert bow.bow_models(reviews_of(["x"]).limit(0), "asin").count() == 0
    df = reviews_of([("sound price", 1), ("price", 5), ("sound", 3)])
    rated = df.select("review_id", "overall").where("review_id < 2")
    got = {r.word: r.coef for r in bow.bow_regression(df.drop("overall"), rated, min_count=1, max_iter=6).collect()}
    assert got == pytest.approx(dict(zip(["sound", "price"], direct([[1, 1], [0, 1], [1, 0]], [1, 5, 3], bow.REG_PARAM), strict=True)), abs=1e-9)


def test_directions_held_by_tasks_equal_joined_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cells = [[(int(p), int(rng.integers(1, 4))) for p in rng.choice(12, rng.integers(0, 6), replace=False)] for _ in range(60)]
    rows = spark.createDataFrame([(i, i % 2, float(i % 5), [(p, t) for p, t in c if p % 2 == i % 2]) for i, c in enumerate(cells)],
                                 "row long, grp int, label double, cells array<struct<pos: long, tf: long>>")
    features = spark.createDataFrame([(p, p % 2, 30) for p in range(12)], "pos long, grp int, held long")
    found = []
    for most in (ridge.DENSE, 0):
        monkeypatch.setattr(ridge, "DENSE", most)
        found.append({r.pos: r.coef for r in ridge.ridge(rows, features, 0.1, 12).collect()})
    assert found[0].keys() == found[1].keys() == set(range(12)) and found[0] == pytest.approx(found[1], abs=1e-9)


def test_repeated_ratings_count_alike_in_tasks_and_joins(reviews_of, monkeypatch):
    rng = random.Random(9)
    df = reviews_of([(" ".join(rng.choices("sound price battery screen".split(), k=6)), rng.randint(1, 5)) for _ in range(40)])
    rated = df.select("review_id", "overall").where("review_id <> '3'")
    rated = rated.unionByName(rated.where("review_id < '2'")).unionByName(rated.limit(1).withColumn("review_id", F.lit(None).cast("string")))
    found = []
    for most in (ridge.DENSE, 0):
        monkeypatch.setattr(ridge, "DENSE", most)
        found.append({r.word: r.coef for r in bow.bow_regression(df.drop("overall"), rated, max_iter=3).collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-9) and len(found[0]) == 4


def test_directions_reach_the_tasks_without_the_driver(spark, monkeypatch):
    """Also with several spans, blocks of few cells, counts that no short float holds, and rows without cells."""
    rng = np.random.default_rng(12)
    group = lambda p: None if p >= 18 else p // 6 if p < 12 else p % 2
    kinds = [[p for p in range(20) if group(p) == g] for g in (0, 1, None)]
    cells = [[(int(p), 0.1 * int(rng.integers(1, 9))) for p in kinds[i % 3] if rng.random() < 0.6] for i in range(90)]
    rows = spark.createDataFrame([((0, 1, None)[i % 3], float(rng.integers(1, 6)), c or None, 1 + i % 4, i) for i, c in enumerate(cells)],
                                 "value int, label double, cells array<struct<pos: long, tf: double>>, copies long, row long")
    rows = rows.select(F.struct("value").alias("grp"), "label", "cells", "copies", "row").withColumn("again", F.explode(F.sequence(F.lit(1), "copies"))).drop("again")
    features = spark.createDataFrame([(p, group(p), 60) for p in range(20)], "pos long, value int, held long").select("pos", F.struct("value").alias("grp"), "held")
    for name, value in {"SPAN": 4, "BLOCK": 5}.items():
        monkeypatch.setattr(ridge, name, value, raising=False)
    monkeypatch.setattr(type(rows), "toPandas", lambda df: pytest.fail(f"{df} comes to the driver"))
    found = []
    for most in (ridge.DENSE, 0):
        monkeypatch.setattr(ridge, "DENSE", most)
        found.append({r.pos: r.coef for r in ridge.ridge(rows, features, 0.1, 2).collect()})
    assert found[0].keys() == found[1].keys() == set(range(20)) and found[0] == pytest.approx(found[1], abs=1e-9)
    assert any(found[0].values())


def test_words_are_looked_up_beside_the_lists(spark, reviews_of, monkeypatch):
    """Several spans and blocks give the joined cells; equal words of two groups, and unknown ones, are told apart."""
    df = reviews_of(texts(13, 80, [*WORDS, "größe", "été"]) + [(None, 1), ("", 2), ("sound unknown", 3)])
    df = df.withColumn("grp", F.struct(F.when(F.col("review_id") % 3 > 0, F.col("review_id") % 3).alias("value")))
    lists = word_lists(df, keep=["grp"]).withColumn("words", bow._histogram(F.col("words"))).withColumn("row", F.col("review_id").cast("long"))
    counts = lists.select("grp", F.inline("words")).groupBy("grp", F.col("term").alias("word")).agg(F.sum("tf").alias("n"), F.count("tf").alias("held"))
    vocab = bow.with_positions(counts.where("n > 1"), "grp", F.desc("n"), "word")
    sent = []
    monkeypatch.setattr(bow.F, "broadcast", lambda table: sent.append(table.count()) or table)
    found = []
    for small, span, block in ((10**6, 262_144, 10**6), (10**6, 4, 5), (0, 4, 5)):
        for name, value in {"SMALL": small, "SPAN": span, "BLOCK": block}.items():
            monkeypatch.setattr(bow, name, value, raising=False)
        found.append({r.row: sorted(map(tuple, r.cells)) for r in bow._placed(lists, vocab).collect()})
        assert max(sent, default=0) <= 3 or small == 0
    assert found[0] == found[1] == found[2] and len(found[0]) > 60
