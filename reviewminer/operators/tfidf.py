"""TF-IDF without logarithm: tf / max(df / N, 1 / N).

The best terms of every review need few of its terms: ``best_terms`` drops
within the review's row what cannot be among them and joins only the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import STOPWORDS
from ..session import stored
from .skew import join_hot_keys
from .tokens import review_terms, word_lists

MIN_HOT = 100_000
FREQUENT = 200_000  # terms whose frequencies every task holds
TOGETHER = 1_000_000  # words counted together
_STEPS = 8  # levels of frequency for each doubling
_SLACK = 1e-9  # share by which a score may be rounded


@dataclass(frozen=True)
class Index:
    """``frequencies(term, df)`` over ``n_docs`` reviews."""

    frequencies: DataFrame
    n_docs: int


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(rows, number of the row of each word, words) of parts of a batch with ``words``; one longer list is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(ends):
        stop = max(int(np.searchsorted(ends, done + TOGETHER, "right")), at + 1)
        part = batch.slice(at, stop - at)
        yield part, np.repeat(np.arange(stop - at), np.diff(ends[at:stop], prepend=done)), part.column("words").flatten()
        at, done = stop, int(ends[stop - 1])


def _partial_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) within each part."""
    for batch in batches:
        for _, row, words in _numbered(batch):
            found = words.dictionary_encode()
            size = max(len(found.dictionary), 1)
            met = np.sort(row * size + found.indices.to_numpy())
            met = met[np.diff(met, prepend=-1) != 0]
            yield pa.record_batch({"term": found.dictionary, "df": np.bincount(met % size, minlength=len(found.dictionary))})


def frequencies(lists: DataFrame) -> DataFrame:
    """(term, df) of (review_id, words): every review counts its distinct terms once."""
    return lists.select("words").mapInArrow(_partial_frequencies, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def build_index(reviews: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> Index:
    """Document frequencies: every review counts its distinct terms once."""
    df = frequencies(word_lists(reviews, stopwords))
    return Index(df, reviews.where(F.col("reviewText").isNotNull()).count())


def score(reviews: DataFrame, index: Index, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """(review_id, term, tf, tfidf) of reviews against an index; unseen df = 0.

    A term of at least 1/100 of the reviews counts as hot: there are at most 100
    times the mean number of terms per review of those, whatever the corpus.
    """
    return _scored(review_terms(reviews, stopwords), index)


def _scored(terms: DataFrame, index: Index) -> DataFrame:
    n = max(index.n_docs, 1)
    hot = max(MIN_HOT, n // 100)
    if n < hot:  # no term can reach the limit
        joined = terms.join(index.frequencies, "term", "left")
    else:
        joined = join_hot_keys(terms, index.frequencies, "term", "df", hot, "left")
    share = F.greatest(F.coalesce("df", F.lit(0)) / F.lit(float(n)), F.lit(1.0) / F.lit(float(n)))
    return joined.select("review_id", "term", "tf", (F.col("tf") / share).alias("tfidf"))


def top_terms(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The ``k`` highest (or lowest) scored terms of every review, with a rank."""
    order = F.asc("tfidf") if ascending else F.desc("tfidf")
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy(order, "term"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _frequent(df: DataFrame, most: int) -> tuple[pa.Array, np.ndarray, int]:
    """(terms, df, bound): at most ``most`` terms, the most frequent ones; no other has a df above ``bound``."""
    level = F.floor(F.log2("df") * _STEPS)
    levels = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("top")).collect()
    room, bound = most, 0
    for found in sorted(levels, reverse=True):
        room -= found["n"]
        if room < 0:
            bound = found["top"]
            break
    rows = df.where(F.col("df") > bound).select("term", "df").toArrow()
    return rows["term"].combine_chunks(), rows["df"].to_numpy().astype(np.float64), bound


def _candidates(terms: pa.Array, df: np.ndarray, bound: int, k: int):
    """Of (review_id, words) the (review_id, term, tf) that may be among the ``k`` best of a review.

    A frequent term's tf / df is known, another's is at least tf / ``bound``.
    What is below the k-th of these is not among the best.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, words in _numbered(batch):
                code = pc.index_in(words, value_set=terms)
                rare = words.filter(code.is_null()).dictionary_encode()
                names = pa.concat_arrays([terms, rare.dictionary])
                code = pc.fill_null(code, -1).to_numpy().astype(np.int64)
                code[code < 0] = len(terms) + rare.indices.to_numpy()
                size = max(len(names), 1)
                met, tf = np.unique(row * size + code, return_counts=True)
                row, code = met // size, met % size
                low = tf / np.append(df, np.full(len(rare.dictionary), float(max(bound, 1))))[code]
                first = np.searchsorted(row, np.arange(part.num_rows))
                many = np.append(first[1:], len(row)) - first >= k
                ranked = low[np.lexsort((-low, row))]
                limit = np.zeros(part.num_rows)
                limit[many] = ranked[first[many] + k - 1]
                keep = (code >= len(terms)) | (low >= limit[row] * (1 - _SLACK))
                columns = {"review_id": part.column("review_id").take(pa.array(row[keep])), "term": names.take(pa.array(code[keep])), "tf": tf[keep]}
                yield pa.record_batch(columns)

    return choose


def best_terms(reviews: DataFrame, k: int, stopwords: Iterable[str] = STOPWORDS, most: int = FREQUENT) -> DataFrame:
    """``top_terms`` of the scores of reviews against their own index.

    Texts are split once. The frequencies of at most ``most`` terms pass through the driver.
    """
    lists = stored(word_lists(reviews, stopwords), "tfidf-words")
    index = Index(stored(frequencies(lists), "tfidf-frequencies"), lists.count())
    kind = lists.schema["review_id"].dataType.simpleString()
    terms = lists.mapInArrow(_candidates(*_frequent(index.frequencies, most), k), f"review_id {kind}, term string, tf bigint")
    return top_terms(_scored(terms, index), k)
