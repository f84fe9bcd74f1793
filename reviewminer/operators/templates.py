"""Modifier + feature templates over a sliding window of k tokens.

The matcher is only fed once the window is full, so a modifier may sit at token
k-1 at the earliest. Everything happens inside the review's own row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tagging import ADJECTIVE_TAGS, DEFAULT_TAGGER, NOUN_TAGS, RuleTagger
from ..functions.text import content_words, let
from ..functions.wordlists import STOPWORDS


@dataclass(frozen=True)
class Template:
    """``max_nouns`` = 1: modifier + noun; more: modifier + run of nouns."""

    name: str = "adjective_noun"
    adj_tags: tuple[str, ...] = ADJECTIVE_TAGS
    noun_tags: tuple[str, ...] = NOUN_TAGS
    k: int = 3
    max_nouns: int = 1
    first_only: bool = True

    def __post_init__(self) -> None:
        if self.k < 2 or not 1 <= self.max_nouns < self.k:
            raise ValueError("need k >= 2 and 1 <= max_nouns < k")


ADJECTIVE_NOUN = Template()
ADJECTIVE_NOUN_ALL = Template(first_only=False)
COMPOUND_NOUN = Template(name="compound_noun", max_nouns=2)


def _match_positions(words: Column, tags: Column, t: Template) -> Column:
    """0-based positions of the first noun of every match, ascending."""
    last = F.size(words) - 1
    candidates = F.when(last >= t.k, F.sequence(F.lit(t.k), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(
        candidates,
        lambda i: tags[i - 1].isin(*t.adj_tags) & tags[i].isin(*t.noun_tags),
    )


def _match(words: Column, tags: Column, i: Column, t: Template) -> Column:
    """Struct describing the match whose first noun sits at ``i``."""
    feature = words[i]
    for step in range(1, t.max_nouns):
        run = F.lit(True)
        for back in range(1, step + 1):
            run = run & F.coalesce(F.get(tags, i + back).isin(*t.noun_tags), F.lit(False))
        feature = F.when(run, F.concat_ws(" ", feature, F.get(words, i + step))).otherwise(feature)
    context = F.array_join(F.slice(words, i - t.k + 2, t.k - 2), " ") if t.k > 2 else F.lit("")
    return F.struct(
        i.alias("i"),
        context.alias("w2"),
        words[i - 1].alias("modifier"),
        feature.alias("feature"),
        tags[i - 1].alias("modifier_tag"),
        tags[i].alias("feature_tag"),
    )


def matches(words: Column, template: Template, tagger: RuleTagger = DEFAULT_TAGGER) -> Column:
    """``array<struct>`` of the matches of one review."""

    def body(ws: Column) -> Column:
        def with_tags(ts: Column) -> Column:
            found = _match_positions(ws, ts, template)
            if template.first_only:
                found = F.slice(found, 1, 1)
            return F.transform(found, lambda i: _match(ws, ts, i, template))

        return let(F.transform(ws, lambda w: tagger.column(w)), with_tags)

    return let(words, body)


def accepts(words: Column, template: Template, tagger: RuleTagger = DEFAULT_TAGGER) -> Column:
    """True if the template accepts the review at all."""
    return F.size(matches(words, template, tagger)) > 0


def extract_ngrams(
    reviews: DataFrame,
    template: Template = ADJECTIVE_NOUN,
    *,
    keep: Sequence[str] = (),
    tagger: RuleTagger = DEFAULT_TAGGER,
    stopwords: Iterable[str] = STOPWORDS,
) -> DataFrame:
    """ngrams(review_id, *keep, i, w2, modifier, feature, modifier_tag, feature_tag)."""
    words = content_words(F.col("reviewText"), stopwords).alias("words")
    lists = reviews.where(F.col("reviewText").isNotNull()).select("review_id", *keep, words)
    return lists.select("review_id", *keep, F.inline(matches(F.col("words"), template, tagger)))


def ngrams_of_tagged(tagged: DataFrame, template: Template = ADJECTIVE_NOUN) -> DataFrame:
    """Same for a table tagged(review_id, i, word, tag) made by another tagger.

    One shuffle on the review; a window partition is one review, never a hot key.
    """
    t = template
    by_review = Window.partitionBy("review_id").orderBy("i")
    feature = F.col("word")
    run = F.lit(True)
    for step in range(1, t.max_nouns):
        run = run & F.coalesce(F.lead("tag", step).over(by_review).isin(*t.noun_tags), F.lit(False))
        feature = F.when(run, F.concat_ws(" ", feature, F.lead("word", step).over(by_review))).otherwise(feature)
    context = [F.lag("word", d).over(by_review) for d in range(t.k - 1, 1, -1)]
    found = tagged.select(
        "review_id",
        "i",
        (F.concat_ws(" ", *context) if context else F.lit("")).alias("w2"),
        F.lag("word", 1).over(by_review).alias("modifier"),
        feature.alias("feature"),
        F.lag("tag", 1).over(by_review).alias("modifier_tag"),
        F.col("tag").alias("feature_tag"),
    ).where((F.col("i") >= t.k) & F.col("modifier_tag").isin(*t.adj_tags) & F.col("feature_tag").isin(*t.noun_tags))
    if not t.first_only:
        return found
    rank = F.row_number().over(by_review)
    return found.withColumn("rn", rank).where("rn = 1").drop("rn")


def count_ngrams(ngrams: DataFrame) -> DataFrame:
    """ngram_counts(w2, modifier, feature, cnt); combined before the shuffle."""
    return ngrams.groupBy("w2", "modifier", "feature").agg(F.count(F.lit(1)).alias("cnt"))
