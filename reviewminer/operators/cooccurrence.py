"""Word vectors from counts: contexts within a window, positive mutual information, a factorisation.

Each word is a row over the ``contexts`` most frequent words: how often they stand within
the window, nearer ones counting more, as positive pointwise mutual information. The
rows' second moments form a square of ``contexts`` numbers a side, whatever the
vocabulary; its leading directions, scaled by their singular values, turn every row
into a short vector where it lies. That square and the directions are all that the
driver holds; words, counts and vectors are tables, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bow import vocabulary
from .skew import join_hot_keys

CONTEXTS = 1024
WINDOW = 5
MIN_COUNT = 10
SIZE = 50
SMALL = 1_000_000  # words whose table is broadcast
MIN_HOT = 100_000
_LISTS = 4000  # lists whose pairs are counted together
_CHUNK = 2048  # rows made dense together
_PARTS = 32  # of the first sum over partitions


def _numbered(lists: DataFrame, vocab: DataFrame) -> DataFrame:
    """(ids): the known words of every list in order, as positions in the vocabulary."""
    placed = lists.select("row", F.posexplode("words").alias("at", "word"))
    if vocab.limit(SMALL + 1).count() > SMALL:
        total = vocab.agg(F.sum("n")).first()[0]
        met = join_hot_keys(placed, vocab.select("word", "n", "pos"), "word", "n", max(MIN_HOT, total // 1000))
    else:
        met = placed.join(F.broadcast(vocab.select("word", "pos")), "word")
    ordered = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "pos"))).alias("ids"))
    return ordered.select(F.transform("ids", lambda s: s["pos"]).alias("ids"))


def _pairs(ids: Column, window: int, contexts: int) -> Column:
    """array<struct<a, b, weight>>: every word with every context within the window; weight falls by one a step."""

    def step(d: Column) -> Column:
        early, late = F.slice(ids, F.lit(1), F.size(ids) - d), F.slice(ids, d + 1, F.size(ids) - d)
        weight = F.lit(window + 1) - d

        def side(words: Column, around: Column) -> Column:
            zipped = F.zip_with(words, around, lambda a, b: F.struct(a.alias("a"), b.alias("b"), weight.alias("weight")))
            return F.filter(zipped, lambda p: p["b"] < contexts)

        return F.concat(side(early, late), side(late, early))

    last = F.least(F.lit(window), F.size(ids) - 1)
    return F.when(F.size(ids) > 1, F.flatten(F.transform(F.sequence(F.lit(1), last), step)))


def _counted(known: list[str], window: int, contexts: int):
    """The pairs of ``_pairs``, summed within every ``_LISTS`` lists; ``known`` is the vocabulary in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pa.array(known, pa.string())
        for batch in (b.slice(low, _LISTS) for b in batches for low in range(0, len(b), _LISTS)):
            lists = batch.column("words")
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            ids = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, ids = row[ids >= 0], ids[ids >= 0]
            for d in range(1, window + 1):
                near = row[:-d] == row[d:]
                early, late = ids[:-d][near], ids[d:][near]
                keys = np.concatenate([a[b < contexts] * contexts + b[b < contexts] for a, b in ((early, late), (late, early))])
                found, many = np.unique(keys, return_counts=True)
                columns = [found // contexts, found % contexts, many * (window + 1 - d)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "weight"])

    return count


def word_contexts(
    word_lists: DataFrame, *, window: int = WINDOW, contexts: int = CONTEXTS, min_count: int = MIN_COUNT
) -> tuple[DataFrame, DataFrame]:
    """(pairs, vocab) of word_lists(words): pairs(a, b, n, pmi), vocab(word, n, pos).

    ``a`` is a word's position and ``b`` that of a context, one of the ``contexts`` first of the vocabulary.
    Words below ``min_count`` are left out before distances are taken. Pairs without a
    positive mutual information are not kept.
    """
    lists = stored(word_lists.select("words").withColumn("row", F.monotonically_increasing_id()), "context-lists")
    counts = lists.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    vocab = stored(vocabulary(counts, min_count), "context-vocabulary")
    if vocab.limit(SMALL + 1).count() > SMALL:
        found = _numbered(lists, vocab).select(F.inline(_pairs(F.col("ids"), window, contexts)))
    else:  # every task holds the vocabulary, as it would a broadcast one; the words stay in their lists
        known = [r["word"] for r in vocab.orderBy("pos").select("word").collect()]
        found = lists.select("words").mapInArrow(_counted(known, window, contexts), "a bigint, b bigint, weight bigint")
    pairs = stored(found.groupBy("a", "b").agg(F.sum("weight").cast("bigint").alias("n")), "context-pairs")
    of_word = pairs.groupBy("a").agg(F.sum("n").alias("n_a"), F.count(F.lit(1)).alias("held"))
    of_context = pairs.groupBy("b").agg(F.sum("n").alias("n_b"))  # at most ``contexts`` rows
    total = pairs.agg(F.sum("n")).first()[0] or 0
    met = pairs.join(F.broadcast(of_context), "b")
    met = met.join(of_word.drop("held"), "a")  # a word has at most ``contexts`` pairs
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b").cast("double")))
    return met.select("a", "b", "n", pmi.alias("pmi")).where("pmi > 0"), vocab


def _dense(pdf: pd.DataFrame, contexts: int) -> np.ndarray:
    out = np.zeros((len(pdf), contexts))
    lengths = pdf["bs"].map(len).to_numpy()
    out[np.repeat(np.arange(len(pdf)), lengths), np.concatenate(pdf["bs"].to_numpy())] = np.concatenate(pdf["values"].to_numpy())
    return out


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for low in range(0, len(pdf), _CHUNK):
        yield pdf.iloc[low : low + _CHUNK]


def _moments(contexts: int):
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((contexts, contexts))
        for pdf in frames:
            for part in _chunks(pdf):
                rows = _dense(part, contexts)
                total += rows.T @ rows
        used = np.nonzero(total.any(axis=1))[0]
        if len(used):
            yield pd.DataFrame({"i": used, "sums": [total[i] for i in used]})

    return add


def _summed(key: list[str]):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

    return add


def _directions(moments: np.ndarray, size: int) -> np.ndarray:
    """Leading directions divided by the root of their singular value; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(moments)
    order = np.argsort(-values)[:size]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    scale = np.where(values > 1e-9 * max(values.max(initial=0.0), 1e-300), np.maximum(values, 1e-300) ** -0.25, 0.0)
    return vectors * np.where(largest < 0, -1.0, 1.0) * scale


def _projected(directions: np.ndarray):
    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in _chunks(pdf):
                yield pd.DataFrame({"pos": part["a"], "vector": list(_dense(part, len(directions)) @ directions)})

    return project


def count_vectors(
    word_lists: DataFrame, size: int = SIZE, *, window: int = WINDOW, contexts: int = CONTEXTS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, vector) of every word of ``min_count`` or more occurrences that has a context; see ``word_contexts``.

    Vectors have ``size`` numbers, or ``contexts`` if that is less.
    """
    pairs, vocab = word_contexts(word_lists, window=window, contexts=contexts, min_count=min_count)
    cells = F.array_sort(F.collect_list(F.struct("b", "pmi"))).alias("cells")
    rows = pairs.groupBy("a").agg(cells)
    rows = rows.select("a", F.transform("cells", lambda c: c["b"]).alias("bs"), F.transform("cells", lambda c: c["pmi"]).alias("values"))
    rows = stored(rows, "context-rows")
    parts = rows.select("bs", "values").mapInPandas(_moments(contexts), "i long, sums array<double>")
    parts = parts.withColumn("part", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(_PARTS)))
    some = parts.groupBy("i", "part").applyInPandas(_summed(["i", "part"]), "i long, part long, sums array<double>")
    sums = some.groupBy("i").applyInPandas(_summed(["i"]), "i long, sums array<double>")
    moments = np.zeros((contexts, contexts))
    for row in sums.collect():  # at most ``contexts`` rows
        moments[row["i"]] = row["sums"]
    vectors = rows.mapInPandas(_projected(_directions(moments, size)), "pos long, vector array<double>")
    return vocab.select("word", "pos").join(vectors, "pos").select("word", "vector")
