"""The whole pipeline: filter, extract, count, cluster, rank, weigh."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tagging import DEFAULT_TAGGER, RuleTagger
from ..functions.wordlists import STOPWORDS
from ..operators import clusters as C
from ..operators.embeddings import PIPELINE_SIZE, phrase_vectors
from ..operators.filters import Filter, fits_broadcast, product_ids, reviews_of_products
from ..operators.skipgram import word_vectors
from ..operators.templates import ADJECTIVE_NOUN, Template, extract_ngrams
from ..operators.tokens import word_lists
from ..operators.weights import MIN_WINDOWS, REG_PARAM, modifier_weights, top_modifiers
from ..session import stored
from ..sources.tables import attach_ratings


@dataclass(frozen=True)
class Mined:
    """Result tables; ``stats``, ``top`` and ``weights`` are cached: ``close`` frees them."""

    stats: DataFrame
    clusters: DataFrame
    top: DataFrame
    weights: DataFrame
    assignment: DataFrame | None = None

    def most_positive(self, k: int = C.TOP) -> DataFrame:
        return top_modifiers(self.weights, True, k)

    def most_negative(self, k: int = C.TOP) -> DataFrame:
        return top_modifiers(self.weights, False, k)

    def members(self) -> DataFrame:
        return C.cluster_members(self.stats, self.assignment)

    def report(self) -> DataFrame:
        """Top clusters with the weight of each of their modifiers."""
        heads = self.top.select("rank", "feature", "representative", "n_reviews", "n_ngrams")
        per_modifier = self.weights.select(
            "rank", "modifier", "n_windows", F.col("n_reviews").alias("n_modifier_reviews"), "coef"
        )
        return heads.join(per_modifier, "rank", "left")

    def close(self) -> None:
        for table in (self.weights, self.top, self.stats):
            table.unpersist()


def rated_ngrams(
    reviews: DataFrame,
    rated: DataFrame | None = None,
    template: Template = ADJECTIVE_NOUN,
    tagger: RuleTagger = DEFAULT_TAGGER,
    stopwords: Iterable[str] = STOPWORDS,
    ids: DataFrame | None = None,
) -> DataFrame:
    """n-grams of the listed products with ``overall``, kept or joined afterwards."""
    keep = [*(["asin"] if ids is not None else []), *(["overall"] if rated is None else [])]
    ngrams = extract_ngrams(reviews, template, keep=keep, tagger=tagger, stopwords=stopwords)
    ngrams = reviews_of_products(ngrams, ids)
    return ngrams if rated is None else attach_ratings(ngrams, rated)


def mine(
    reviews: DataFrame,
    *,
    rated: DataFrame | None = None,
    products: DataFrame | None = None,
    product_filter: Filter | None = None,
    algorithm: str = "exact",
    vector_of: str = "feature",
    vectors: DataFrame | None = None,
    threshold: float = C.THRESHOLD,
    template: Template = ADJECTIVE_NOUN,
    tagger: RuleTagger = DEFAULT_TAGGER,
    stopwords: Iterable[str] = STOPWORDS,
    top_k: int = C.TOP,
    rank_by: str = "n_reviews",
    min_windows: int = MIN_WINDOWS,
    scope: str = "any_feature",
    reg_param: float = REG_PARAM,
    drop_singletons: bool = False,
    partitions: int | None = None,
) -> Mined:
    """Mine features from reviews(review_id, asin, reviewText[, overall]).

    ``products`` with ``product_filter`` narrows the reviews. Strategies other
    than ``exact`` cluster by the vector of the feature or, with
    ``vector_of="first"``, of the first window word. ``vectors`` holds (feature
    or w2, vector); if none are given, they are trained on the reviews (``skipgram``).
    """
    if not template.first_only:
        raise ValueError("the weights need at most one n-gram per review")
    if algorithm not in C.STRATEGIES:
        raise ValueError(f"algorithm is one of {sorted(C.STRATEGIES)}")
    trains = algorithm != "exact" and vectors is None
    late_ids = None
    if products is not None:
        ids = product_ids(products.transform(product_filter) if product_filter else products)
        if trains or fits_broadcast(ids):
            reviews = reviews_of_products(reviews, ids)
        else:  # too many to broadcast: join the n-grams instead of the texts
            late_ids = ids
    if partitions:
        reviews = reviews.repartition(partitions)
    ngrams = rated_ngrams(reviews, rated, template, tagger, stopwords, late_ids)
    stats = C.ngram_stats(ngrams).persist(StorageLevel.MEMORY_AND_DISK)
    key = {"feature": "feature", "first": "w2"}[vector_of]
    if trains:
        trained = stored(word_vectors(word_lists(reviews, stopwords), PIPELINE_SIZE), "word-vectors")
        vectors = phrase_vectors(stats.select(key).distinct(), trained, key)
    assignment = C.assign(stats, vectors, threshold, algorithm, key)
    clusters = C.build_clusters(stats, assignment, drop_singletons)
    top = C.top_clusters(clusters, top_k, rank_by).persist(StorageLevel.MEMORY_AND_DISK)
    weights = modifier_weights(
        stats, top, assignment, min_windows=min_windows, scope=scope, reg_param=reg_param
    ).persist(StorageLevel.MEMORY_AND_DISK)
    return Mined(stats, clusters, top, weights, assignment)
