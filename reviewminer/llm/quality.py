"""Quality by importance resampling with hashed n-gram models.

Two generative models over hashed byte n-grams, one of the labelled good texts
and one of all texts, give every document a log-likelihood ratio. A Gumbel
variate seeded by the document turns the ratios into keys, and the documents
with the k largest keys are a sample without replacement in proportion to the
importance weights. Without a given k, it is the number of documents at which
labelled good and bad ones are told apart best.

Null and empty texts have the ratio 0. Labels repeated for a document count by
the worst; rows that share a labelled doc_id count once for the cut, by their
largest key. Without any bad label every document is kept. Empty tables give
empty tables; rows that repeat are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.ranking import with_positions
from .common import enough_tasks, written

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
LABELLED = 20_000  # labelled rows that the target model and the cut are fitted on, at most
SMOOTHING = 1.0
SEED = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(text: str | None) -> np.ndarray:
    """Bucket of every byte n-gram of the text."""
    data = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)
    parts = []
    for n in GRAMS:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | data[k : len(data) - n + 1 + k]
            parts.append(((code * _MIX) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
            counts = np.bincount(gram_buckets(text.as_py()), minlength=BUCKETS)
            total[0] += counts
            if good == 1:
                total[1] += counts
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])


def best_cut(keys: np.ndarray, good: np.ndarray) -> float:
    """The key at or above which a document is kept: least sum of the two error rates."""
    if not len(keys) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(-keys, kind="stable")
    keys, good = keys[order], good[order]
    missed = 1 - np.cumsum(good) / good.sum()
    let_in = np.cumsum(1 - good) / (1 - good).sum()
    return float(keys[(missed + let_in).argmin()])


def judged(docs: DataFrame, labels: DataFrame, k: int | None = None, labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """docs with log_ratio, sample_key and kept added."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = worst.where("good is not null").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(labelled)
    known = written(known.select(F.col("doc_id").cast("bigint").alias("__id"), "good"), "labelled")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("__id"), "text")
    marked = enough_tasks(narrow).join(F.broadcast(known), "__id", "left")  # at most ``labelled`` rows
    counted = marked.select("text", "good").mapInArrow(_count, "bucket bigint, raw bigint, target bigint")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    raw, target = raw + SMOOTHING, target + SMOOTHING
    table = np.log(target / target.sum()) - np.log(raw / raw.sum())
    schema = StructType([*docs.schema.fields, StructField("log_ratio", DoubleType())])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = pa.array([float(table[gram_buckets(t.as_py())].sum()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(1 << 53)
    scored = enough_tasks(docs).mapInArrow(score, schema)
    scored = scored.withColumn("sample_key", F.col("log_ratio") - F.log(-F.log(uniform)))
    if k is None:
        narrow = scored.select(F.col("doc_id").cast("bigint").alias("__id"), "sample_key")
        own = narrow.join(F.broadcast(known), "__id").groupBy("__id")
        own = own.agg(F.max("sample_key").alias("sample_key"), F.max("good").alias("good"))
        sample = own.orderBy("__id").select("sample_key", "good").toPandas()  # a row per labelled doc_id, at most ``labelled``
        cut = best_cut(sample["sample_key"].to_numpy(float), sample["good"].to_numpy(int))
    else:
        places = with_positions(scored.select("sample_key"), F.desc("sample_key"))
        row = places.where(F.col("pos") < k).agg(F.min("sample_key")).first()
        cut = row[0] if k > 0 and row[0] is not None else np.inf
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(float(cut)))
