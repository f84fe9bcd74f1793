"""Word vectors by skip-gram whose vocabulary, counts and vectors stay tables.

As in Spark ML's Word2Vec with many partitions and one pass, parts of the text are learnt from
apart and a word's vectors are averaged over the parts, by how often each holds it. A part is a
block of ``BLOCK_WORDS`` words, so a task holds the words of one block and not the vocabulary.
All parts start a word at the same place, drawn from a hash of the word, so their vectors agree
in direction. The output layer is trained by negative sampling, which needs no tree over the
whole vocabulary; the noise words of a step are shared by its positions. Every word gets a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import cosine

WINDOW = 5
NEGATIVES = 5  # noise words for each pair
RATE = 0.025  # falls linearly over a block
BLOCK_WORDS = 3_000_000
_BATCH = 256  # positions moved together
_SHARED = 256  # noise words of a batch; as many as positions, so that ``_MOST`` seldom cuts their share
_MOST = 32  # of a word's pairs and noise in a batch; more count as so many mean ones, else frequent words overshoot
_ROWS = 20_000  # of an emitted batch


def _start(words: pa.Array, size: int, seed: int) -> np.ndarray:
    """The first vectors: uniform within 0.5 / size, by a hash of word, place and seed."""
    key = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    out = np.empty((len(key), size), np.float32)
    for k in range(size):
        z = key + np.uint64((0x9E3779B97F4A7C15 * (seed * size + k + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = ((z >> np.uint64(40)).astype(np.float64) / 2**24 - 0.5) / size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _add(table: np.ndarray, ids: np.ndarray, moves: np.ndarray, weights: np.ndarray) -> None:
    """Add each id's moves, sums over ``weights`` pairs; they count as at most ``_MOST`` mean ones."""
    order = np.argsort(ids, kind="stable")
    found, first = np.unique(ids[order], return_index=True)
    scale = np.minimum(1, _MOST / np.maximum(np.add.reduceat(weights[order], first), 1))
    table[found] += np.add.reduceat(moves[order], first, axis=0) * scale[:, None]


def _learn(ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, inner: np.ndarray, window: int, seed: int) -> None:
    """One pass over a block: moves ``inner``, the vectors of its words, in place."""
    rng, total = np.random.default_rng(seed), len(ids)
    outer, noise = np.zeros_like(inner), np.cumsum(counts**0.75)
    reach = rng.integers(1, window + 1, total)
    for low in range(0, total, _BATCH):
        high = min(low + _BATCH, total)
        a, z = max(low - window, 0), min(high + window, total)
        near, centre = inner[ids[a:z]], outer[ids[low:high]]
        near_pull, centre_pull = np.zeros_like(near), np.zeros_like(centre)
        uses, met = np.zeros(z - a, np.float32), np.zeros(high - low, np.float32)
        for d in (d for d in range(-window, window + 1) if d):
            t, u = max(low, -d), min(high, total - d)
            if t >= u:
                continue
            pair = ((rows[t:u] == rows[t + d : u + d]) & (reach[t:u] >= abs(d))).astype(np.float32)
            at, of = slice(t + d - a, u + d - a), slice(t - low, u - low)
            pull = ((1 - _sigmoid(np.einsum("ij,ij->i", near[at], centre[of]))) * pair)[:, None]
            near_pull[at] += pull * centre[of]
            centre_pull[of] += pull * near[at]
            uses[at] += pair
            met[of] += pair
        drawn = np.searchsorted(noise, rng.random(_SHARED) * noise[-1], side="right").clip(max=len(noise) - 1)
        share = uses * np.float32(NEGATIVES / _SHARED)
        push = _sigmoid(near @ outer[drawn].T) * share[:, None]
        near_pull -= push @ outer[drawn]
        rate = np.float32(RATE * max(1 - low / total, 1e-4))
        weights = np.concatenate([met, np.full(_SHARED, share.sum(), np.float32)])
        _add(outer, np.concatenate([ids[low:high], drawn]), rate * np.concatenate([centre_pull, -(push.T @ near)]), weights)
        _add(inner, ids[a:z], rate * near_pull, uses * (1 + NEGATIVES))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words with the number of their list, in blocks of at most ``most``; a longer list is cut."""
    words, rows, held, base = [], [], 0, 0
    for batch in batches:
        lists = batch.column("words")
        values, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        number = np.repeat(np.arange(base, base + len(lists)), lengths)
        base, low = base + len(lists), 0
        while low < len(values):
            high = min(low + most - held, len(values))
            words.append(values.slice(low, high - low))
            rows.append(number[low:high])
            held, low = held + high - low, high
            if held == most:
                yield pa.concat_arrays(words), np.concatenate(rows)
                words, rows, held = [], [], 0
    if held:
        yield pa.concat_arrays(words), np.concatenate(rows)


def _trained(size: int, window: int, most: int, seed: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, rows in _blocks(batches, most):
            coded = words.dictionary_encode()
            ids, known = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
            counts = np.bincount(ids, minlength=len(known))
            vectors = _start(known, size, seed)
            _learn(ids, rows, counts, vectors, window, seed)
            for low in range(0, len(known), _ROWS):
                part = vectors[low : low + _ROWS]
                cells = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * size, pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([known.slice(low, _ROWS), pa.array(counts[low : low + _ROWS]), cells], names=["word", "n", "cells"])

    return train


def word_vectors(word_lists: DataFrame, size: int, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, seed: int = 42) -> DataFrame:
    """(word, vector array<double>) of every word of word_lists(words). Reproducible for a fixed seed and partitioning."""
    parts = word_lists.select("words").where(F.size("words") > 0)
    parts = parts.mapInArrow(_trained(size, window, block_words, seed), "word string, n bigint, cells array<float>")
    return averaged(parts, size)


def averaged(parts: DataFrame, size: int) -> DataFrame:
    """(word, vector): the mean of parts(word, n, cells), each counted ``n`` times."""
    sums = [F.sum(F.col("cells")[k].cast("double") * F.col("n")).alias(f"s{k}") for k in range(size)]
    total = parts.repartition("word").groupBy("word").agg(F.sum("n").alias("n"), *sums)  # dealt before the sums widen it
    return total.select("word", F.array(*[F.col(f"s{k}") / F.col("n") for k in range(size)]).alias("vector"))


def synonyms(vectors: DataFrame, word: str, k: int) -> DataFrame:
    """(word, similarity): the ``k`` words whose vectors lie nearest to that of ``word`` by cosine, ties by word."""
    asked = vectors.where(F.col("word") == word).select("vector").first()
    if asked is None:
        raise ValueError(f"no vector of {word!r}")
    near = cosine(F.col("vector"), F.array(*[F.lit(float(v)) for v in asked["vector"]]))
    return vectors.where(F.col("word") != word).select("word", near.alias("similarity")).orderBy(F.desc("similarity"), "word").limit(k)
