"""Token tables. All of them are map-only over the reviews."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tagging import DEFAULT_TAGGER, RuleTagger
from ..functions.text import content_words, is_content, let, tokens, whitespace_words
from ..functions.wordlists import STOPWORDS


def _texts(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("reviewText").isNotNull())


def all_tokens(reviews: DataFrame) -> DataFrame:
    """tokens(review_id, pos, word) before stop words go.

    The token list is a projection of its own: generated code splits the text,
    and the generator only has to unfold it. The same holds further down.
    """
    split = _texts(reviews).select("review_id", tokens(F.col("reviewText")).alias("words"))
    return split.select("review_id", F.posexplode("words").alias("pos", "word"))


def clean_tokens(reviews: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """tokens(review_id, pos, word) without stop words; ``pos`` counts them."""
    return all_tokens(reviews).where(is_content(F.col("word"), stopwords))


def tagged_words(
    reviews: DataFrame, tagger: RuleTagger = DEFAULT_TAGGER, stopwords: Iterable[str] = STOPWORDS
) -> DataFrame:
    """tagged(review_id, pos, i, word, tag); ``i`` counts the remaining words."""
    stop = tuple(stopwords)
    placed = F.transform(tokens(F.col("reviewText")), lambda w, p: F.struct(p.alias("pos"), w.alias("word")))
    kept = F.filter(placed, lambda t: is_content(t["word"], stop))
    return (
        _texts(reviews)
        .select("review_id", kept.alias("kept"))
        .select("review_id", F.posexplode("kept").alias("i", "t"))
        .select("review_id", "t.pos", "i", "t.word", tagger.column(F.col("t.word")).alias("tag"))
    )


def word_lists(reviews: DataFrame, stopwords: Iterable[str] = STOPWORDS, keep: Iterable[str] = ()) -> DataFrame:
    """(review_id, *keep, words): the content words of every review in order."""
    return _texts(reviews).select("review_id", *keep, content_words(F.col("reviewText"), stopwords).alias("words"))


def whitespace_lists(reviews: DataFrame) -> DataFrame:
    """(review_id, words) by blanks only; texts of blanks have no words."""
    return (
        _texts(reviews)
        .where((F.trim("reviewText") != "") | (F.col("reviewText") == ""))
        .select("review_id", whitespace_words(F.col("reviewText")).alias("words"))
    )


def _histogram(words: Column) -> Column:
    """``array<struct<term, tf>>`` of one review: sort, then measure the runs."""

    def runs(ws: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (ws[i] != F.get(ws, i - 1))
        )

        def measured(begin: Column) -> Column:
            return F.transform(
                begin,
                lambda b, n: F.struct(
                    ws[b].alias("term"),
                    (F.coalesce(F.get(begin, n + 1), F.size(ws)) - b).cast("long").alias("tf"),
                ),
            )

        return let(starts, measured)

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs))


def review_terms(reviews: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """(review_id, term, tf): term frequencies per review without a shuffle."""
    return word_lists(reviews, stopwords).select("review_id", F.inline(_histogram(F.col("words"))))


def word_counts(reviews: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """(word, n) over all reviews; partial counts before the shuffle."""
    return clean_tokens(reviews, stopwords).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_size(counts: DataFrame, min_count: int = 10) -> DataFrame:
    """One row: vocabulary size before and after the frequency cut."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("n") >= min_count).alias("n_kept")
    )
