import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from reviewminer.operators import clusters as C
from reviewminer.operators.embeddings import phrase_vectors, synonyms, train, word_vectors
from reviewminer.operators.filters import brand
from reviewminer.operators.templates import ADJECTIVE_NOUN_ALL, COMPOUND_NOUN
from reviewminer.operators.weights import modifier_weights
from reviewminer.plans.pipeline import mine


def stats_of(spark, rows):
    """n-gram table of (w2, modifier, feature, [ratings])."""
    flat = [(w, m, f, float(y)) for w, m, f, ys in rows for y in ys]
    return C.ngram_stats(spark.createDataFrame(flat, "w2 string, modifier string, feature string, overall double"))


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def stats(spark):
    return stats_of(
        spark,
        [
            ("much", "better", "sound", [5, 4]), ("far", "better", "sound", [5]), ("a", "worse", "sound", [1]),
            ("x", "worse", "price", [2, 1]), ("y", "worse", "price", [1]), ("z", "lower", "cost", [3]),
        ],
    ).cache()


def test_exact_clusters(stats):
    got = rows_of(C.build_clusters(stats).drop("cluster_id"), F.desc("n_reviews"))
    assert got == [
        ("sound", "much better sound", 4, 3, 1), ("price", "x worse price", 3, 2, 1), ("cost", "z lower cost", 1, 1, 1),
    ]
    dropped = C.build_clusters(stats, drop_singletons=True)
    assert {r.feature for r in dropped.collect()} == {"sound", "price"}


def test_top_clusters_rank_and_ties(spark):
    s = stats_of(spark, [("a", "b", f, [1]) for f in "dcba"])
    assert rows_of(C.top_clusters(C.build_clusters(s), 3).select("rank", "feature"), "rank") == [(1, "a"), (2, "b"), (3, "c")]
    by_windows = C.top_clusters(C.build_clusters(s), 1, by="n_ngrams")
    assert by_windows.count() == 1


def test_histogram_counts_windows_and_reviews(stats):
    got = {(r.cluster_id, r.modifier): (r.n_windows, r.n_reviews) for r in C.modifier_histogram(stats).collect()}
    assert got[("sound", "better")] == (2, 3)
    assert got[("price", "worse")] == (2, 3)
    assert got[("sound", "worse")] == (1, 1)


def test_assigned_clusters_members_and_histogram(spark, stats):
    given = spark.createDataFrame([("sound", "c1"), ("price", "c1"), ("cost", "c2")], "feature string, cluster_id string")
    got = rows_of(C.build_clusters(stats, given), "cluster_id")
    assert got == [("c1", "sound", "much better sound", 7, 5, 2), ("c2", "cost", "z lower cost", 1, 1, 1)]
    hist = {(r.cluster_id, r.modifier): r.n_windows for r in C.modifier_histogram(stats, given).collect()}
    assert hist == {("c1", "better"): 2, ("c1", "worse"): 3, ("c2", "lower"): 1}
    assert C.cluster_members(stats, given).where("cluster_id = 'c1'").count() == 5


def test_split_hot_features_change_nothing(spark, stats, monkeypatch):
    given = spark.createDataFrame([("sound", "c1"), ("price", "c1"), ("cost", "c2")], "feature string, cluster_id string")
    before = sorted(map(tuple, C.cluster_members(stats, given).collect()))
    monkeypatch.setattr(C, "HOT_ROWS", 2)
    assert sorted(map(tuple, C.cluster_members(stats, given).collect())) == before


def one_model_per_cluster(spark, stats, modifiers, cluster_of=None):
    """The definition: fit every review with an n-gram on one-hot modifiers."""
    points = []
    for r in stats.select("modifier", "feature", "ratings").collect():
        x = [0.0] * len(modifiers)
        if r.modifier in modifiers and (cluster_of is None or r.feature == cluster_of):
            x[modifiers.index(r.modifier)] = 1.0
        points += [(y, Vectors.dense(x)) for y in r.ratings]
    model = LinearRegression(maxIter=20, regParam=0.05).fit(spark.createDataFrame(points, ["label", "features"]))
    return dict(zip(modifiers, model.coefficients))


@pytest.mark.parametrize("scope", ["any_feature", "same_feature"])
def test_weights_equal_the_fitted_models(spark, scope):
    rng = random.Random(8)
    rows = [
        (f"w{i}", m, f, [rng.randint(1, 5) for _ in range(rng.randint(1, 6))])
        for i in range(4) for m in ("better", "worse", "lower", "higher") for f in ("sound", "price", "cost")
        if rng.random() < 0.8
    ]
    stats = stats_of(spark, rows)
    plain = spark.createDataFrame([(m, f, [float(y) for y in ys]) for _, m, f, ys in rows], "modifier string, feature string, ratings array<double>")
    top = C.top_clusters(C.build_clusters(stats))
    got = modifier_weights(stats, top, scope=scope).collect()
    for feature in ("sound", "price", "cost"):
        mine_ = {r.modifier: r.coef for r in got if r.feature == feature}
        assert len(mine_) >= 3
        expected = one_model_per_cluster(spark, plain, sorted(mine_), None if scope == "any_feature" else feature)
        assert mine_ == pytest.approx(expected, abs=1e-8)


def test_weight_guards(spark):
    def weights(rows, **options):
        s = stats_of(spark, rows)
        return modifier_weights(s, C.top_clusters(C.build_clusters(s)), **options).collect()

    constant = weights([("a", "better", "s", [3, 3]), ("b", "better", "s", [3]), ("c", "worse", "s", [3]), ("d", "worse", "s", [3])])
    assert [r.coef for r in constant] == [0.0, 0.0]
    everywhere = weights([("a", "better", "s", [1, 3]), ("b", "better", "s", [5])])
    assert [r.coef for r in everywhere] == [0.0]
    assert weights([("a", "better", "s", [1]), ("b", "worse", "s", [5])]) == []
    assert len(weights([("a", "better", "s", [1]), ("b", "worse", "s", [5])], min_windows=1)) == 2
    with pytest.raises(ValueError):
        weights([("a", "better", "s", [1])], scope="other")


TEXTS = [
    ("x much better sound", 5), ("x far better sound", 5), ("x much worse sound", 1), ("x far worse sound", 2),
    ("x y warmer display", 4), ("x z warmer display", 4), ("x y lower price", 3), ("nothing to see", 3),
]


def test_pipeline_end_to_end(spark, reviews_of):
    mined = mine(reviews_of(TEXTS), min_windows=2)
    assert [r.feature for r in mined.top.orderBy("rank").collect()] == ["sound", "display", "price"]
    report = mined.report().orderBy("rank", "modifier").collect()
    assert [(r.rank, r.modifier) for r in report] == [(1, "better"), (1, "worse"), (2, "warmer"), (3, None)]
    assert mined.most_positive(1).first().modifier == "better"
    assert mined.most_negative(1).first().modifier == "worse"
    assert mined.members().count() == mined.stats.count() == 7
    mined.close()


def test_pipeline_with_products(spark, reviews_of):
    products = spark.createDataFrame([("0", "A"), ("1", "B"), ("2", "A")], "asin string, brand string")
    reviews = reviews_of(TEXTS)
    kept = mine(reviews, products=products, product_filter=brand("B"))
    assert kept.stats.agg(F.sum("cnt")).first()[0] == 2  # reviews 1 and 4; review 7 has no n-gram
    assert mine(reviews, products=products).stats.agg(F.sum("cnt")).first()[0] == 7
    assert mine(reviews, products=products, product_filter=brand("none")).stats.count() == 0


@pytest.mark.parametrize("algorithm", ["exact", "similarity", "allpairs"])
def test_results_do_not_depend_on_partitions(spark, reviews_of, algorithm):
    vectors = spark.createDataFrame(
        [("sound", [1.0, 0.0]), ("display", [1.0, 0.01]), ("price", [0.0, 1.0])], "feature string, vector array<double>"
    )
    seen = []
    for parts in (1, 4, 16):
        mined = mine(reviews_of(TEXTS), algorithm=algorithm, vectors=vectors, partitions=parts, min_windows=1)
        total = mined.clusters.agg(F.sum("n_reviews"), F.sum("n_features")).first()
        assert tuple(total) == (7, 3)
        seen.append((rows_of(mined.clusters, "cluster_id"), rows_of(mined.weights, "rank", "modifier")))
    assert seen[0] == seen[1] == seen[2]
    merged = {r[1]: r[5] for r in seen[0][0]}
    assert merged == ({"sound": 1, "display": 1, "price": 1} if algorithm == "exact" else {"sound": 2, "price": 1})


def test_first_word_vectors_and_trained_vectors(spark, reviews_of):
    vectors = spark.createDataFrame([("much", [1.0, 0.0]), ("far", [1.0, 0.0])], "w2 string, vector array<double>")
    mined = mine(reviews_of(TEXTS), algorithm="allpairs", vectors=vectors, vector_of="first", min_windows=1)
    got = {r.cluster_id: (r.feature, r.n_reviews, r.n_ngrams) for r in mined.clusters.collect()}
    assert got == {"far": ("sound", 4, 4), "y": ("display", 2, 2), "z": ("display", 1, 1)}
    assert mined.weights.where("cluster_id = 'far'").count() == 2
    same = mine(reviews_of(TEXTS), algorithm="allpairs", vectors=vectors, vector_of="first", min_windows=1, scope="same_feature")
    assert same.weights.count() == mined.weights.count()
    trained = mine(reviews_of(TEXTS), algorithm="similarity", threshold=0.9999)
    assert trained.clusters.agg(F.sum("n_features")).first()[0] == 3


def test_pipeline_arguments(spark, reviews_of):
    with pytest.raises(ValueError):
        mine(reviews_of(TEXTS), algorithm="other")
    with pytest.raises(ValueError):
        mine(reviews_of(TEXTS), template=ADJECTIVE_NOUN_ALL)
    compound = mine(reviews_of(["x y better color quality"]), template=COMPOUND_NOUN)
    assert compound.clusters.first().feature == "color quality"
    rated = spark.createDataFrame([("0", 5.0)], "review_id string, overall double")
    apart = mine(reviews_of(["x y better sound", "x y better sound"]).drop("overall"), rated=rated)
    assert apart.stats.first().sum_y == 8.0


def test_word_vectors(spark):
    lists = spark.createDataFrame([(["a", "b", "a", "c"],), ([],), (["b", "c", "a"],)], "words array<string>")
    model = train(lists, size=3)
    assert {r.word: len(r.vector) for r in word_vectors(model).collect()} == {"a": 3, "b": 3, "c": 3}
    assert synonyms(model, "a", 10).count() == 2
    vectors = spark.createDataFrame([("color", [1.0, 3.0]), ("quality", [3.0, 5.0])], "word string, vector array<double>")
    phrases = spark.createDataFrame([("color quality",), ("color",), ("none",)], "feature string")
    got = {r.feature: list(r.vector) for r in phrase_vectors(phrases, vectors).collect()}
    assert got == {"color quality": [2.0, 4.0], "color": [1.0, 3.0]}


def test_vocabulary_too_large_for_the_driver(spark, monkeypatch):
    from reviewminer.operators import embeddings

    monkeypatch.setattr(embeddings, "MODEL_CELLS", 5)
    with pytest.raises(ValueError, match="min_count"):
        train(spark.createDataFrame([(["a", "b", "c"],)], "words array<string>"), size=3)


def test_long_product_lists_are_joined_to_the_ngrams(spark, reviews_of, monkeypatch):
    from reviewminer.operators import filters
    from reviewminer.plans import pipeline

    products = spark.createDataFrame([("0", "A"), ("1", "B"), ("2", "A")], "asin string, brand string")
    monkeypatch.setattr(pipeline, "fits_broadcast", lambda ids: False)
    monkeypatch.setattr(filters, "fits_broadcast", lambda ids, limit: False)
    late = mine(reviews_of(TEXTS), products=products, product_filter=brand("A"), min_windows=1)
    monkeypatch.undo()
    early = mine(reviews_of(TEXTS), products=products, product_filter=brand("A"), min_windows=1)
    assert late.stats.agg(F.sum("cnt")).first()[0] == 5
    assert rows_of(late.weights, "rank", "modifier") == rows_of(early.weights, "rank", "modifier")
