import random

import pytest
from pyspark.sql import functions as F

from reviewminer.functions.tagging import ADJECTIVE_TAGS, NOUN_TAGS
from reviewminer.operators import templates as tp
from reviewminer.operators.tokens import tagged_words


def found(df, template=tp.ADJECTIVE_NOUN, **options):
    rows = tp.extract_ngrams(df, template, **options).orderBy("review_id", "i").collect()
    return [(r.review_id, r.w2, r.modifier, r.feature) for r in rows]


def test_first_tokens_never_reach_the_matcher(reviews_of):
    assert found(reviews_of(["x better sound y z"])) == []
    assert found(reviews_of(["x y better sound"])) == [("0", "y", "better", "sound")]


def test_first_match_only_or_all(reviews_of):
    df = reviews_of(["x y better sound x worse battery"])
    assert found(df) == [("0", "y", "better", "sound")]
    assert found(df, tp.ADJECTIVE_NOUN_ALL) == [("0", "y", "better", "sound"), ("0", "x", "worse", "battery")]


def test_short_and_missing_reviews(reviews_of):
    assert found(reviews_of(["better sound", "", None, "the of better"])) == []


def test_stopwords_and_full_stops_do_not_separate(reviews_of):
    df = reviews_of(["x y better than the sound", "x y. It was better. Sound"])
    assert found(df) == [("0", "y", "better", "sound"), ("1", "y", "better", "sound")]


def test_plain_adjectives_and_more_do_not_match(reviews_of):
    assert found(reviews_of(["x y good sound", "x y more money"])) == []


def test_context_word_separates_windows(reviews_of):
    df = reviews_of(["x much better sound", "x far better sound", "x far better sound"])
    counts = tp.count_ngrams(tp.extract_ngrams(df)).orderBy("w2").collect()
    assert [(r.w2, r.modifier, r.feature, r.cnt) for r in counts] == [
        ("far", "better", "sound", 2), ("much", "better", "sound", 1),
    ]


def test_compound_nouns(reviews_of):
    df = reviews_of(["x y better color quality z", "x y worse sound z", "x y better sound quality price"])
    assert found(df, tp.COMPOUND_NOUN) == [
        ("0", "y", "better", "color quality"), ("1", "y", "worse", "sound"), ("2", "y", "better", "sound quality"),
    ]
    longer = tp.Template(k=4, max_nouns=3)
    assert found(reviews_of(["p q r better sound quality price"]), longer) == [
        ("0", "q r", "better", "sound quality price")
    ]


def test_kept_columns_and_accepts(reviews_of, spark):
    df = reviews_of([("x y better sound", 5.0), ("nothing here at all", 1.0)])
    assert [r.overall for r in tp.extract_ngrams(df, keep=("overall",)).collect()] == [5.0]
    flags = df.select(tp.accepts(F.split("reviewText", " "), tp.ADJECTIVE_NOUN)).collect()
    assert [r[0] for r in flags] == [True, False]


def test_template_arguments():
    with pytest.raises(ValueError):
        tp.Template(k=1)
    with pytest.raises(ValueError):
        tp.Template(k=3, max_nouns=3)


def one_by_one(words, tags, t):
    """Step through the review as a matcher with a full window would."""
    out = []
    for i in range(t.k, len(words)):
        if tags[i - 1] in ADJECTIVE_TAGS and tags[i] in NOUN_TAGS:
            nouns = [words[i]]
            while len(nouns) < t.max_nouns and i + len(nouns) < len(words) and tags[i + len(nouns)] in NOUN_TAGS:
                nouns.append(words[i + len(nouns)])
            out.append((i, " ".join(words[i - t.k + 1 : i - 1]), words[i - 1], " ".join(nouns)))
            if t.first_only:
                break
    return out


@pytest.mark.parametrize("template", [
    tp.ADJECTIVE_NOUN, tp.ADJECTIVE_NOUN_ALL, tp.COMPOUND_NOUN,
    tp.Template(k=2), tp.Template(k=5, max_nouns=4, first_only=False),
])
def test_row_and_window_forms_agree_with_stepping(spark, reviews_of, template):
    rng = random.Random(5)
    words = "better best sound quality price x y z warmer movement the".split()
    df = reviews_of([" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(120)])
    tagged = tagged_words(df)
    by_review = {}
    for r in tagged.orderBy("review_id", "i").collect():
        by_review.setdefault(r.review_id, []).append((r.word, r.tag))
    expected = {
        (rid, *m) for rid, pairs in by_review.items()
        for m in one_by_one([p[0] for p in pairs], [p[1] for p in pairs], template)
    }
    assert expected
    for form in (tp.extract_ngrams(df, template), tp.ngrams_of_tagged(tagged, template)):
        assert {(r.review_id, r.i, r.w2, r.modifier, r.feature) for r in form.collect()} == expected


def test_extraction_needs_no_shuffle(reviews_of):
    plan = tp.extract_ngrams(reviews_of(["x y better sound"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
