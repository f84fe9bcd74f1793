from pyspark.sql import functions as F

from reviewminer.functions.tagging import RuleTagger, plural
from reviewminer.functions.text import content_words, let, tokens, whitespace_words
from reviewminer.functions.wordlists import STOPWORDS, split_stopwords
from reviewminer.operators import tokens as t


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_tokens_and_clitics(spark):
    assert one(spark, "I can't; it's CANNOT we'll", tokens) == [
        "i", "ca", "n't", ";", "it", "'s", "can", "not", "we", "'ll",
    ]
    assert one(spark, "", tokens) == []
    assert one(spark, "naïve 3.5€\n", tokens) == ["naïve", "3", ".", "5", "€"]


def test_stopwords_are_tokenised_and_all_copies_go(spark):
    assert {"ca", "n't", "wo", "'ll", ".", ",", "more", "most", "ours", "ourselves"} <= set(STOPWORDS)
    assert "can't" not in STOPWORDS
    assert split_stopwords("cannot he'd") == ("can", "not", "he", "'d")
    assert one(spark, "The the cat. Can't you, the end", content_words) == ["cat", "end"]


def test_whitespace_words(spark):
    assert one(spark, "a b  ", whitespace_words) == ["a", "b"]
    assert one(spark, "A  b", whitespace_words) == ["a", "", "b"]
    df = spark.createDataFrame([("1", "   "), ("2", ""), ("3", "x"), ("4", None)], "review_id string, reviewText string")
    assert {r.review_id: r.words for r in t.whitespace_lists(df).collect()} == {"2": [""], "3": ["x"]}


def test_let_binds_once(spark):
    assert one(spark, "ab", lambda c: let(F.length(c), lambda n: n * n)) == 4


def test_rule_tagger(spark):
    words = ["better", "best", "player", "players", "quality", "qualities", "warmer", "coolest", "never", "batteries",
             "movement", "sounds", "happinesses", "x", "er", "guests", "tions"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", RuleTagger().column(F.col("w"))).collect()
    assert [r[1] for r in rows] == ["JJR", "JJS", "NN", "NNS", "NN", "NNS", "JJR", "JJS", "X", "X",
                                    "NN", "NNS", "NNS", "X", "JJR", "NNS", "NNS"]
    assert plural("ity") == "ities" and plural("ness") == "nesses" and plural("tion") == "tions"


def test_lexicon_is_an_argument(spark):
    tagger = RuleTagger(lexicon={"blue": "J"}, noun_suffixes=())
    rows = spark.createDataFrame([("blue",), ("better",), ("sound",)], "w string").select(tagger.column(F.col("w"))).collect()
    assert [r[0] for r in rows] == ["J", "JJR", "X"]


def test_token_tables(reviews_of):
    df = reviews_of(["The sound, the SOUND is better", None, "of the"])
    assert [(r.pos, r.word) for r in t.clean_tokens(df).orderBy("pos").collect()] == [(1, "sound"), (4, "sound"), (6, "better")]
    tagged = t.tagged_words(df).orderBy("i").collect()
    assert [(r.pos, r.i, r.word, r.tag) for r in tagged] == [(1, 0, "sound", "NN"), (4, 1, "sound", "NN"), (6, 2, "better", "JJR")]
    assert {(r.term, r.tf) for r in t.review_terms(df).collect()} == {("sound", 2), ("better", 1)}
    assert {(r.word, r.n) for r in t.word_counts(df).collect()} == {("sound", 2), ("better", 1)}
    size = t.vocabulary_size(t.word_counts(df), 2).first()
    assert (size.n_terms, size.n_kept) == (2, 1)
