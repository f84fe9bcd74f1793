import math
import random
from collections import Counter

import numpy as np
import pytest

from reviewminer.operators import cooccurrence as C
from reviewminer.operators.synonyms import nearest_by_cosine


def lists_of(spark, texts, parts=3):
    return spark.createDataFrame([(t.split(),) for t in texts], "words array<string>").repartition(parts)


def plain(texts, window, contexts, min_count):
    """{(word, context): (n, pmi)} one pair at a time."""
    counts = Counter(w for t in texts for w in t.split())
    vocab = sorted((w for w, n in counts.items() if n >= min_count), key=lambda w: (-counts[w], w))
    frequent = set(vocab[:contexts])
    pairs = Counter()
    for text in texts:
        words = [w for w in text.split() if counts[w] >= min_count]
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if i != j and abs(i - j) <= window and b in frequent:
                    pairs[a, b] += window + 1 - abs(i - j)
    rows, columns, total = Counter(), Counter(), sum(pairs.values())
    for (a, b), n in pairs.items():
        rows[a] += n
        columns[b] += n
    pmi = {p: (n, math.log(n * total / rows[p[0]] / columns[p[1]])) for p, n in pairs.items()}
    return {p: v for p, v in pmi.items() if v[1] > 0}


def made(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    return [" ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("small", [10**6, 0])
def test_pairs_equal_counting_by_hand(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    monkeypatch.setattr(C, "MIN_HOT", 10)
    texts = made(1) + ["w0 w0 w0", ""]
    pairs, vocab = C.word_contexts(lists_of(spark, texts), window=3, contexts=7, min_count=5)
    names = {r.pos: r.word for r in vocab.collect()}
    found = {(names[r.a], names[r.b]): (r.n, pytest.approx(r.pmi, abs=1e-9)) for r in pairs.collect()}
    assert found == plain(texts, 3, 7, 5)


def test_vectors_are_the_factorisation_and_reruns_agree(spark):
    texts = made(2)
    found = {r.word: r.vector for r in C.count_vectors(lists_of(spark, texts), 6, window=3, contexts=12, min_count=3).collect()}
    cells = plain(texts, 3, 12, 3)
    words, columns = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
    matrix = np.array([[cells.get((a, b), (0, 0.0))[1] for b in columns] for a in words])
    assert sorted(found) == words
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    vectors = np.array([found[w] for w in words])
    assert vectors @ vectors.T == pytest.approx((u[:, :6] * s[:6]) @ u[:, :6].T, abs=1e-8)
    again = {r.word: r.vector for r in C.count_vectors(lists_of(spark, texts, 7), 6, window=3, contexts=12, min_count=3).collect()}
    assert all(again[w] == pytest.approx(v, abs=1e-8) for w, v in found.items())


def test_planted_synonyms_are_nearest(spark):
    rng = random.Random(3)
    topics = [[f"t{t}x{i}" for i in range(8)] for t in range(6)]
    texts = []
    for _ in range(600):
        topic = rng.randrange(6)
        words = rng.choices(topics[topic], k=6)
        words[3] = rng.choice((f"same{topic}a", f"same{topic}b"))
        texts.append(" ".join(words))
    vectors = C.count_vectors(lists_of(spark, texts), 10, contexts=64, min_count=5).withColumnRenamed("word", "id")
    best = {r.id: r.other for r in nearest_by_cosine(vectors, 1).collect()}
    assert all(best[f"same{t}a"] == f"same{t}b" and best[f"same{t}b"] == f"same{t}a" for t in range(6))


def test_nothing_to_count(spark):
    assert C.count_vectors(lists_of(spark, ["one two"])).count() == 0
    assert C.count_vectors(lists_of(spark, ["one", "one"]), min_count=1).count() == 0
