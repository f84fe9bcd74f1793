import random

import numpy as np
import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from reviewminer.operators import skipgram
from reviewminer.plans import queries


def lists_of(spark, lists):
    return spark.createDataFrame([(words,) for words in lists], "words array<string>")


def topics(count, seed=3):
    """Lists that take their words from one of ten topics."""
    rng = random.Random(seed)
    words = [[f"{t}{i}" for i in range(6)] for t in "abcdefghij"]
    return [rng.choices(rng.choice(words), k=30) for _ in range(count)]


def test_every_word_has_a_vector_and_reruns_agree(spark):
    lists = lists_of(spark, [["a", "b", "a", "c"], [], ["b", "", "a"], ["alone"]]).coalesce(1)
    got = {r.word: r.vector for r in skipgram.word_vectors(lists, 3).collect()}
    assert {w: len(v) for w, v in got.items()} == {w: 3 for w in ("a", "b", "c", "", "alone")}
    assert all(np.isfinite(v).all() for v in got.values())
    assert got == {r.word: r.vector for r in skipgram.word_vectors(lists, 3).collect()}
    assert skipgram.word_vectors(lists.where("size(words) = 0"), 3).count() == 0


def test_words_of_a_topic_lie_together_for_any_blocks(spark):
    lists = lists_of(spark, topics(3000)).repartition(2)
    for block in (3_000_000, 30_000):
        found = {r.word: np.array(r.vector) for r in skipgram.word_vectors(lists, 16, block_words=block).collect()}
        assert len(found) == 60
        names = sorted(found)
        unit = np.array([found[w] / np.linalg.norm(found[w]) for w in names])
        near = unit @ unit.T
        own = np.array([np.mean([near[i, j] for j, b in enumerate(names) if b[0] == a[0] and b != a]) for i, a in enumerate(names)])
        other = np.array([np.mean([near[i, j] for j, b in enumerate(names) if b[0] != a[0]]) for i, a in enumerate(names)])
        assert (own > other + 0.05).mean() >= 0.9


def test_blocks_cut_long_lists_and_keep_every_word(spark):
    lists = lists_of(spark, [[f"w{i}" for i in range(50)], ["w1", "w2"] * 20]).coalesce(1)
    assert {r.word for r in skipgram.word_vectors(lists, 2, block_words=7).collect()} == {f"w{i}" for i in range(50)}


def test_vectors_are_averaged_by_what_each_block_holds(spark):
    part = [("a", 3, [1.0, 0.0]), ("a", 1, [0.0, 4.0]), ("b", 2, [5.0, 5.0])]
    start = skipgram._start(skipgram.pa.array(["a", "b"]), 4, 1)
    assert (np.abs(start) <= 0.125).all() and len(np.unique(start)) == 8
    assert (start == skipgram._start(skipgram.pa.array(["b", "a"]), 4, 1)[::-1]).all()
    parts = spark.createDataFrame(part, "word string, n long, cells array<float>")
    assert {r.word: r.vector for r in skipgram.averaged(parts, 2).collect()} == {"a": [0.75, 1.0], "b": [5.0, 5.0]}


def test_synonyms(spark):
    rows = [("x", [1.0, 0.0]), ("y", [2.0, 0.0]), ("w", [3.0, 0.0]), ("z", [0.0, 1.0]), ("nil", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "word string, vector array<double>")
    assert [(r.word, r.similarity) for r in skipgram.synonyms(vectors, "x", 3).collect()] == [("w", 1.0), ("y", 1.0), ("nil", 0.0)]
    with pytest.raises(ValueError):
        skipgram.synonyms(vectors, "none", 3)


def test_queries_train_without_a_model_on_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a model on the driver")

    monkeypatch.setattr(Word2Vec, "fit", refuse)
    assert queries.word2vec_vectors(spark, "/root/testdata/sf0.001").select(F.size("vector")).distinct().collect() == [(50,)]
    assert queries.word2vec_synonyms(spark, "/root/testdata/sf0.001").count() == 10
