import random

import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from reviewminer.operators import bow, skew, tfidf
from reviewminer.operators.ranking import with_positions
from reviewminer.operators.tokens import word_counts, word_lists


def test_tfidf_formula(spark, reviews_of):
    index = tfidf.build_index(reviews_of(["sound price", "sound", "sound", "battery", None]))
    assert index.n_docs == 4
    got = {r.term: (r.tf, r.tfidf) for r in tfidf.score(reviews_of(["sound Unseen unseen price"]), index).collect()}
    assert got == {"sound": (1, 1 / 0.75), "unseen": (2, 8.0), "price": (1, 4.0)}


def test_tfidf_of_an_empty_index(reviews_of):
    index = tfidf.build_index(reviews_of([None]))
    assert index.n_docs == 0
    assert [(r.term, r.tfidf) for r in tfidf.score(reviews_of(["word word"]), index).collect()] == [("word", 2.0)]


def test_tfidf_with_split_hot_terms(reviews_of, monkeypatch):
    df = reviews_of([f"sound w{i % 5} v{i}" for i in range(60)])
    index = tfidf.build_index(df)
    before = sorted(map(tuple, tfidf.score(df, index).collect()))
    monkeypatch.setattr(tfidf, "MIN_HOT", 4)
    assert sorted(map(tuple, tfidf.score(df, index).collect())) == before


def test_top_terms(spark):
    scores = spark.createDataFrame(
        [("1", "b", 1, 2.0), ("1", "a", 1, 2.0), ("1", "c", 1, 9.0), ("2", "d", 1, 1.0)],
        "review_id string, term string, tf long, tfidf double",
    )
    rows = tfidf.top_terms(scores, 2).orderBy("review_id", "rank").collect()
    assert [(r.review_id, r["rank"], r.term) for r in rows] == [("1", 1, "c"), ("1", 2, "a"), ("2", 1, "d")]
    low = tfidf.top_terms(scores, 1, ascending=True).orderBy("review_id").collect()
    assert [r.term for r in low] == ["a", "d"]


def test_positions_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(f"w{i:04d}", rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "word string, n long").repartition(13)
    got = {r.word: r.pos for r in with_positions(df, F.desc("n"), "word").collect()}
    assert got == {w: i for i, (w, _) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])))}
    assert with_positions(df.limit(0), "word").count() == 0


def test_hot_key_join_equals_plain_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 20).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 3")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(small, "k", how).select("k", "id", "n", "top").collect()), key=str)
        split = skew.join_hot_keys(big, small, "k", "n", 50, how).select("k", "id", "n", "top")
        assert sorted(map(tuple, split.collect()), key=str) == plain


def test_vocabulary_cut(reviews_of):
    df = reviews_of(["ten " * 10 + "nine " * 9 + "twenty " * 20])
    assert [(r.word, r.n, r.pos) for r in bow.vocabulary(word_counts(df)).orderBy("pos").collect()] == [
        ("twenty", 20, 0), ("ten", 10, 1),
    ]


def test_bag_of_words_vectors(reviews_of):
    df = reviews_of(["sound sound price", "price", "none here", ""])
    vocab = bow.vocabulary(word_counts(df), 2)
    direct = {r.review_id: r.features for r in bow.bow_vectors(df, vocab).collect()}
    assert direct["0"].toArray().tolist() == [1.0, 2.0] and direct["2"].numNonzeros() == 0


def test_repeated_ids_stay_points_of_their_own(reviews_of):
    df = reviews_of([("sound sound price", 5), ("price", 1), ("sound", 4)]).withColumn("review_id", F.lit("same"))
    points = bow.bow_points(df, bow.vocabulary(word_counts(df), 1), None, 3.0).collect()
    assert sorted((r.label, *r.features.toArray()) for r in points) == [(1.0, 0.0, 1.0), (4.0, 1.0, 0.0), (5.0, 2.0, 1.0)]


def test_bow_regression_is_the_direct_fit(spark, reviews_of):
    rng = random.Random(6)
    words = "sound price battery screen case".split()
    df = reviews_of([(" ".join(rng.choices(words, k=8)), rng.randint(1, 5)) for _ in range(40)])
    got = {r.word: r.coef for r in bow.bow_regression(df).collect()}
    order = [r.word for r in bow.vocabulary(word_counts(df)).orderBy("pos").collect()]
    counted = CountVectorizerModel.from_vocabulary(order, inputCol="words", outputCol="features")
    points = counted.transform(word_lists(df)).join(df, "review_id").select(F.col("overall").alias("label"), "features")
    assert got == pytest.approx(dict(zip(order, bow.fit(points).coefficients)), abs=1e-9)
    apart = bow.bow_regression(df.drop("overall"), df.select("review_id", "overall"))
    assert {r.word: r.coef for r in apart.collect()} == pytest.approx(got, abs=1e-9)


def test_bow_regression_per_group_and_without_vocabulary(reviews_of):
    df = reviews_of([("sound " * 10, 5), ("price " * 10, 1), ("sound " * 5, 4)]).withColumn(
        "source_file", F.when(F.col("review_id") == "1", "b").otherwise("a")
    )
    models = bow.bow_regression_by(df, "source_file")
    assert {k: [r.word for r in v.collect()] for k, v in models.items()} == {"a": ["sound"], "b": ["price"]}
    assert bow.bow_regression(reviews_of(["rare words"])).count() == 0


def test_bow_vocabulary_stays_a_table_and_hot_words_are_split(spark, reviews_of, monkeypatch):
    df = reviews_of(["alpha beta alpha", "gamma", "", "beta zeta alpha"] * 30)
    vocab = bow.vocabulary(word_counts(df), 1)
    wanted = {r.word: r.pos for r in vocab.collect()}
    monkeypatch.setattr(type(vocab), "toLocalIterator", None)
    monkeypatch.setattr(bow, "_MIN_HOT", 7)
    found = [r.features for r in bow.bow_vectors(df, vocab).collect()]
    assert len(found) == 120 and all(v.size == len(wanted) for v in found)
    assert sum(v[wanted["alpha"]] for v in found) == 90 and sum(v.numNonzeros() == 0 for v in found) == 30


def test_best_terms_join_few_rows_and_equal_the_top_of_all_scores(spark, monkeypatch):
    draw = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    rows = [(draw.choice([None, 1, 2, i]), " ".join(draw.choice(common if draw.random() < 0.8 else [f"r{draw.randint(0, 60)}", "é", "r1"]) for _ in range(draw.randint(0, 40)))) for i in range(150)]
    df = spark.createDataFrame([*rows, (7, None), (8, "the"), (9, "solo")], "review_id long, reviewText string")
    for k in (1, 3):
        expected = sorted(map(repr, tfidf.top_terms(tfidf.score(df, tfidf.build_index(df)), k).collect()))
        for most, together in ((0, 7), (5, 50), (20, 1), (1000, 10**6)):
            monkeypatch.setattr(tfidf, "TOGETHER", together)
            assert sorted(map(repr, tfidf.best_terms(df, k, most=most).collect())) == expected
    lists, index = word_lists(df), tfidf.build_index(df)
    terms, known, bound = tfidf._frequent(index.frequencies, 1000)
    joined = lists.mapInArrow(tfidf._candidates(terms, known, bound, 1), "review_id long, term string, tf long").count()
    assert bound == 0 and joined < 0.3 * tfidf.review_terms(df).count()
    assert tfidf.best_terms(df.limit(0), 3).collect() == []


def test_frequencies_count_a_review_once_and_bound_the_rest(spark):
    df = spark.createDataFrame([(1, "a1 a1 b1"), (2, "a1 c1"), (2, "a1 c1"), (None, "a1 d1")], "review_id long, reviewText string")
    found = tfidf.frequencies(word_lists(df))
    assert {(r.term, r.df) for r in found.collect()} == {("a1", 4), ("b1", 1), ("c1", 2), ("d1", 1)}
    for most, names, most_left in ((0, set(), 4), (1, {"a1"}, 2), (3, {"a1", "c1"}, 1), (4, {"a1", "b1", "c1", "d1"}, 0)):
        terms, df_of, bound = tfidf._frequent(found, most)
        assert set(terms.to_pylist()) == names and bound == most_left and len(df_of) == len(names)
