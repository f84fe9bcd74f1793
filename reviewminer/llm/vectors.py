"""Vectors in blocks, and a query set against all of them block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, parallelism, written

ROWS = 8192
QUERY_ROWS = 256  # queries searched at once
MOST_QUERIES = 4096  # queries of a task
SPLITS = 8  # parts of the index, at most, that send k rows each for a query
_BLOCKS = 64  # of a part, as long as there are fewer parts than that


def clean_vectors(table: DataFrame, vector: str, key: str, usable: Callable[[Column], Column] | None = None) -> DataFrame:
    """(vec_id, v, dim): vectors without null or non-finite parts, one per id (the least, if several).

    v is array<float> if the vectors are, else array<double>.
    """
    rows = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    if dict(rows.dtypes)["v"] != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.withColumn("finite", F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.where("vec_id is not null and v is not null and finite")
    if usable is not None:
        rows = rows.where(usable(F.col("v")))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def blocked(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    blocks = max(1, -(-count // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))


def _kept(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of every query that the order by score, falling, and id puts first."""
    order = np.lexsort((ids, -score, ~np.isnan(score), query))
    query = query[order]
    starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    place = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
    order = order[place < k]
    return query[place < k], ids[order], score[order]


def _searched(search: Callable, score: str, k: int, query_rows: int):
    """Pairs of an index and a block of queries to the k best rows of every query over the task's pairs."""
    kinds = [np.int64, np.int64, np.int64 if score == "bigint" else np.float64]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_buffer() for c in ("ids", "index", "extra")}
                row["dim"] = dim = batch.column("dim")[at].as_py()
                asked = batch.column("asked")[at].values
                ids, v = asked.field("vec_id").to_numpy(), asked.field("v").flatten().to_numpy().reshape(len(asked), dim)
                found: list[tuple] = []
                for low in range(0, len(ids), query_rows):
                    found += search(row, ids[low : low + query_rows].tolist(), v[low : low + query_rows])
                key = dim, batch.column("qblock")[at].as_py()
                parts = [np.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)] if found else [np.empty(0, kind) for kind in kinds]
                if key in held:
                    parts = [np.concatenate(c) for c in zip(held[key], parts, strict=True)]
                held[key] = _kept(*parts, k)
        for parts in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["query_id", "vec_id", "score"])

    return best


def top_by_blocks(
    table: DataFrame, queries: Column, build: Callable, search: Callable, score: str, k: int,
    rows: int = ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query, a row of ``table`` that fits ``queries``, over all blocks.

    ``build(pa.Table) -> dict of binaries`` makes the index of one block;
    ``search(row, query_ids, query_vectors)`` yields (query_id, vec_id, score).
    Every index meets every block of queries once, and neither is copied for
    that: a task holds one block of queries and reads a part of the indexes from
    where they are written. It keeps the k best of each query, so the parts,
    few at any size, bound what is sent. Vectors meet those of their own length only.
    """
    table = written(table, "vectors")
    n, m = table.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    discard(table)
    tasks = 4 * parallelism(table)
    size = min(max(query_rows, -(-m // tasks)), max(query_rows, MOST_QUERIES))
    numbers = max(1, -(-m // size))
    parts = min(SPLITS, max(1, -(-tasks // numbers), -(-n // (rows * _BLOCKS))))
    blocks = blocked(table, n, rows, "block")
    index = written(
        blocks.groupBy("dim", "block").applyInArrow(build, "dim int, block int, ids binary, index binary, extra binary"),
        "vector-index",
    )
    asked = blocked(table.where(queries), m, size, "qblock")
    asked = asked.groupBy("dim", "qblock").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
    asked = written(asked, "query-blocks")
    discard(index, table)
    met = index.coalesce(parts).hint("shuffle_replicate_nl").join(asked.repartitionByRange(numbers, "qblock"), "dim")
    found = met.select("dim", "ids", "index", "extra", "qblock", "asked").mapInArrow(
        _searched(search, score, k, query_rows), f"query_id bigint, vec_id bigint, score {score}"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
