"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bow, clusters, cooccurrence, embeddings, filters, graph, similarity, skipgram, synonyms, templates, tfidf, tokens, weights
from ..schemas import REVIEW
from ..session import fresh_path, stored
from ..sources import json_lines, reports, tables
from . import pipeline
from .parameters import (
    BRAND, CATEGORY, CHAIN_PRICES, PRICES, SAMPLE_FRACTION, SAMPLE_SEED, SIMILAR_ASIN, SYNONYMS, TOP_TERMS, VECTOR_THRESHOLD,
)

Query = Callable[[SparkSession, str], DataFrame]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _digits(name: str, n: int) -> Column:
    return (F.round(F.col(name), n) + F.lit(0.0)).alias(name)


# Products -------------------------------------------------------------------


def _listed(products: DataFrame) -> DataFrame:
    return products.select("asin", F.col("price").cast("double").alias("price"), "brand")


def _filtered(product_filter: filters.Filter) -> Query:
    return lambda spark, d: _listed(tables.products(spark, d).transform(product_filter))


def filter_similar(spark: SparkSession, d: str) -> DataFrame:
    ids = tables.bought_with(tables.load(spark, d, "lineitem"), SIMILAR_ASIN)
    return _listed(tables.products(spark, d).join(ids, "asin", "left_semi"))


def _ring(spark: SparkSession, d: str) -> DataFrame:
    return tables.products(spark, d).transform(filters.category(CATEGORY))


def product_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "products")
    json_lines.write_json(tables.products(spark, d).transform(filters.category(CATEGORY)), path)
    back = json_lines.good_records(json_lines.read_products(spark, path))
    return back.select(
        "asin", F.col("price").cast("double").alias("price"), "brand",
        F.array_join(F.flatten("categories"), "/").alias("path"),
    )


def review_json_columns(spark: SparkSession, d: str) -> DataFrame:
    made = tables.review_texts(spark, d).select(
        F.col("review_id").alias("reviewerID"), "asin", "reviewText"
    )
    back = json_lines.from_json_column(json_lines.to_json_column(made), REVIEW)
    return back.select(
        F.col("reviewerID").alias("review_id"), "asin", F.length("reviewText").cast("long").alias("n_chars"),
        F.col("overall").cast("double").alias("overall"), F.col("summary").isNull().alias("no_summary"),
    )


def filter_preset(spark: SparkSession, d: str) -> DataFrame:
    """The preset product filter; in the given tables the parts of one category stand for its category."""
    renamed = F.transform("categories", lambda path: F.transform(path, lambda c: F.when(c == CATEGORY, filters.PRESET_CATEGORY).otherwise(c)))
    return _listed(tables.products(spark, d).withColumn("categories", renamed).transform(filters.preset()))


def reviews_json(spark: SparkSession, d: str) -> DataFrame:
    """All reviews written as JSON lines and read as a source, with what tells the records apart."""
    rated = tables.ratings(spark, d)
    made = tables.review_texts(spark, d).select(F.col("review_id").alias("reviewerID"), "asin", "reviewText", F.lit(0).alias("unixReviewTime"))
    made = made.join(rated.withColumnRenamed("review_id", "reviewerID"), "reviewerID", "left")
    path = fresh_path(spark, "reviews")
    json_lines.write_json(made, path)
    back = json_lines.good_records(json_lines.read_reviews(spark, path, glob="*.json"))
    return back.select(
        F.regexp_replace("review_id", ":[0-9a-f]{16}$", "").alias("review_id"), F.length("reviewText").cast("long").alias("n_chars"),
        F.col("overall").cast("double").alias("overall"), F.col("reviewerName").isNull().alias("no_name"),
    )


def reviews_of_products(spark: SparkSession, d: str) -> DataFrame:
    reviews = tables.review_texts(spark, d).select("review_id", "asin")
    return filters.reviews_of_products(reviews, filters.product_ids(_ring(spark, d))).select("review_id", "asin")


# Words ----------------------------------------------------------------------


def tokens_clean(spark: SparkSession, d: str) -> DataFrame:
    return tokens.clean_tokens(tables.review_texts(spark, d)).select("review_id", *_long("pos"), "word")


def tagged_words(spark: SparkSession, d: str) -> DataFrame:
    tagged = tokens.tagged_words(tables.review_texts(spark, d))
    return tagged.select("review_id", *_long("pos", "i"), "word", "tag")


def whitespace_tokens(spark: SparkSession, d: str) -> DataFrame:
    lists = tokens.whitespace_lists(tables.review_texts(spark, d))
    return lists.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.word_counts(tables.review_texts(spark, d))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return bow.vocabulary(word_counts(spark, d)).select("word", "n", *_long("pos"))


def vocabulary_size(spark: SparkSession, d: str) -> DataFrame:
    return tokens.vocabulary_size(word_counts(spark, d), bow.MIN_COUNT)


def review_terms(spark: SparkSession, d: str) -> DataFrame:
    return tokens.review_terms(tables.review_texts(spark, d))


def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    reviews = tables.review_texts(spark, d)
    return tfidf.score(reviews, tfidf.build_index(reviews))


def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    best = tfidf.best_terms(tables.review_texts(spark, d), TOP_TERMS)
    return best.select("review_id", *_long("rank"), "term", "tf", "tfidf")


# N-grams --------------------------------------------------------------------


def _ngrams(template: templates.Template) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = templates.extract_ngrams(tables.review_texts(spark, d), template)
        return found.select("review_id", *_long("i"), "w2", "modifier", "feature", "modifier_tag", "feature_tag")

    return run


def ngrams_windowed(spark: SparkSession, d: str) -> DataFrame:
    tagged = tokens.tagged_words(tables.review_texts(spark, d)).select("review_id", "i", "word", "tag")
    found = templates.ngrams_of_tagged(tagged)
    return found.select("review_id", *_long("i"), "w2", "modifier", "feature", "modifier_tag", "feature_tag")


def template_accepts(spark: SparkSession, d: str) -> DataFrame:
    lists = tokens.word_lists(tables.review_texts(spark, d))
    return lists.select("review_id", templates.accepts(F.col("words"), templates.ADJECTIVE_NOUN).alias("accepted"))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return templates.count_ngrams(templates.extract_ngrams(tables.review_texts(spark, d)))


# Clusters and weights --------------------------------------------------------


def _mined(spark: SparkSession, d: str, **options) -> pipeline.Mined:
    return pipeline.mine(tables.review_texts(spark, d), rated=tables.ratings(spark, d), **options)


def _hashed_vectors(spark: SparkSession, d: str, words: DataFrame) -> DataFrame:
    """Give every word one of the given vectors, chosen by its own hash."""
    given = tables.vectors(spark, d)
    key = words.columns[0]
    slot = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % given.count()
    return words.select(key, slot.alias("id")).join(given, "id").select(key, "vector")


def _clusters(mined: pipeline.Mined) -> DataFrame:
    return mined.clusters.select(
        "cluster_id", "feature", "representative", *_long("n_reviews", "n_ngrams", "n_features")
    )


def clusters_exact(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(_mined(spark, d))


def clusters_top(spark: SparkSession, d: str) -> DataFrame:
    top = _mined(spark, d).top
    return top.select(*_long("rank"), "feature", "representative", *_long("n_reviews", "n_ngrams"))


def _vector_clusters(algorithm: str, key: str = "feature") -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ngrams = pipeline.rated_ngrams(tables.review_texts(spark, d), tables.ratings(spark, d))
        stats = clusters.ngram_stats(ngrams).persist()
        vectors = _hashed_vectors(spark, d, stats.select(key).distinct())
        assignment = clusters.assign(stats, vectors, VECTOR_THRESHOLD, algorithm, key)
        found = clusters.build_clusters(stats, assignment)
        return found.select("cluster_id", "feature", "representative", *_long("n_reviews", "n_ngrams", "n_features"))

    return run


def clusters_no_singletons(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(_mined(spark, d, drop_singletons=True))


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(feature, k, value): features of one or two words with the mean of their words' vectors."""
    found = templates.extract_ngrams(tables.review_texts(spark, d), templates.COMPOUND_NOUN).select("feature").distinct()
    words = found.select(F.explode(F.split("feature", " ")).alias("word")).distinct()
    vectors = embeddings.phrase_vectors(found, _hashed_vectors(spark, d, words))
    return vectors.select("feature", F.posexplode("vector").alias("k", "v")).select("feature", *_long("k"), F.round("v", 6).alias("value"))


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    members = _mined(spark, d).members()
    return members.select("cluster_id", "w2", "modifier", "feature", *_long("cnt"))


def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    mined = _mined(spark, d)
    return reports.cluster_report(mined.top, mined.members()).select(*_long("rank", "line"), "text")


def modifier_histogram(spark: SparkSession, d: str) -> DataFrame:
    hist = clusters.modifier_histogram(_mined(spark, d).stats)
    return hist.select("cluster_id", "modifier", *_long("n_windows", "n_reviews"))


def _weights(**options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = _mined(spark, d, **options).weights
        return found.select("feature", "modifier", *_long("n_windows", "n_reviews"), _digits("coef", 8))

    return run


def _top_modifiers(positive: bool) -> Query:
    return lambda spark, d: weights.top_modifiers(_weights(min_windows=1)(spark, d), positive)


def feature_report(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d, min_windows=1).report().select(
        *_long("rank"), "feature", "representative", *_long("n_reviews", "n_ngrams"),
        "modifier", *_long("n_windows", "n_modifier_reviews"), _digits("coef", 8),
    )


# Vectors ----------------------------------------------------------------------


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.similar_pairs_and_copies(tables.vectors(spark, d), VECTOR_THRESHOLD)
    return found.select("id_a", "id_b", _digits("cosine", 6))


def components(spark: SparkSession, d: str) -> DataFrame:
    vectors = tables.vectors(spark, d)
    edges = similarity.connectivity_edges(vectors, VECTOR_THRESHOLD)
    return graph.components(edges, vectors.select("id")).select("id", "component")


def matrix_transpose(spark: SparkSession, d: str) -> DataFrame:
    moved = similarity.transpose(similarity.matrix_entries(tables.vectors(spark, d)))
    return moved.select(*_long("row_id", "col_id"), "value")


def bow_regression(spark: SparkSession, d: str) -> DataFrame:
    return bow.bow_regression(tables.review_texts(spark, d), tables.ratings(spark, d))


def bow_regression_by_source(spark: SparkSession, d: str) -> DataFrame:
    """A model for each source, all in one job."""
    reviews = tables.review_texts(spark, d)
    return bow.bow_models(reviews, "source", tables.ratings(spark, d)).withColumnRenamed("group", "source")


def vector_synonyms(spark: SparkSession, d: str) -> DataFrame:
    found = synonyms.nearest_by_cosine(tables.vectors(spark, d), SYNONYMS)
    return found.select("id", *_long("rank"), "other", _digits("cosine", 6))


def word_contexts(spark: SparkSession, d: str) -> DataFrame:
    """(word, context, n, pmi): what the words from counts are made of."""
    pairs, vocab = cooccurrence.word_contexts(tokens.word_lists(tables.review_texts(spark, d)))
    words, contexts = vocab.select(F.col("pos").alias("a"), "word"), vocab.select(F.col("pos").alias("b"), F.col("word").alias("context"))
    return pairs.join(words, "a").join(contexts, "b").select("word", "context", "n", _digits("pmi", 6))


def count_vectors(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.count_vectors(tokens.word_lists(tables.review_texts(spark, d)))


def word2vec_vectors(spark: SparkSession, d: str) -> DataFrame:
    lists = tokens.word_lists(tables.review_texts(spark, d))
    return skipgram.word_vectors(lists, embeddings.PIPELINE_SIZE)


def word2vec_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms of the most frequent word, with the demonstration's settings."""
    lists = tokens.whitespace_lists(tables.review_texts(spark, d))
    counts = whitespace_tokens(spark, d).where("word <> ''")
    word = counts.orderBy(F.desc("n"), "word").first()["word"]
    vectors = stored(skipgram.word_vectors(lists, embeddings.DEMO_SIZE), "word-vectors")
    return skipgram.synonyms(vectors, word, embeddings.SYNONYMS)


QUERIES: dict[str, Query] = {
    "filter_brand": _filtered(filters.brand(BRAND)),
    "filter_preset": filter_preset,
    "filter_category": _filtered(filters.category(CATEGORY)),
    "filter_price": _filtered(filters.price(*PRICES)),
    "filter_similar": filter_similar,
    "filter_chain": _filtered(filters.chain(filters.category(CATEGORY), filters.price(*CHAIN_PRICES))),
    "filter_sample_hash": _filtered(filters.sample_by_hash(SAMPLE_FRACTION, SAMPLE_SEED)),
    "product_json_roundtrip": product_json_roundtrip,
    "review_json_columns": review_json_columns,
    "reviews_json": reviews_json,
    "reviews_of_products": reviews_of_products,
    "tokens_clean": tokens_clean,
    "tagged_words": tagged_words,
    "whitespace_tokens": whitespace_tokens,
    "word_counts": word_counts,
    "vocabulary": vocabulary,
    "vocabulary_size": vocabulary_size,
    "review_terms": review_terms,
    "tfidf": tfidf_scores,
    "tfidf_top_terms": tfidf_top_terms,
    "ngrams_adj_noun": _ngrams(templates.ADJECTIVE_NOUN),
    "ngrams_adj_noun_all": _ngrams(templates.ADJECTIVE_NOUN_ALL),
    "ngrams_compound_noun": _ngrams(templates.COMPOUND_NOUN),
    "ngrams_windowed": ngrams_windowed,
    "template_accepts": template_accepts,
    "ngram_counts": ngram_counts,
    "clusters_exact": clusters_exact,
    "clusters_no_singletons": clusters_no_singletons,
    "feature_vectors": feature_vectors,
    "clusters_top": clusters_top,
    "clusters_similarity": _vector_clusters("similarity"),
    "clusters_allpairs": _vector_clusters("allpairs"),
    "clusters_allpairs_first": _vector_clusters("allpairs", "w2"),
    "cluster_members": cluster_members,
    "cluster_report": cluster_report,
    "modifier_histogram": modifier_histogram,
    "modifier_weights": _weights(),
    "modifier_weights_min1": _weights(min_windows=1),
    "modifier_weights_same_feature": _weights(min_windows=1, scope="same_feature"),
    "top_positive": _top_modifiers(True),
    "top_negative": _top_modifiers(False),
    "similar_pairs": similar_pairs,
    "components": components,
    "matrix_transpose": matrix_transpose,
    "bow_regression": bow_regression,
    "bow_regression_by_source": bow_regression_by_source,
    "vector_synonyms": vector_synonyms,
    "word_contexts": word_contexts,
    "count_vectors": count_vectors,
    "word2vec_vectors": word2vec_vectors,
    "word2vec_synonyms": word2vec_synonyms,
    "feature_report": feature_report,
}
