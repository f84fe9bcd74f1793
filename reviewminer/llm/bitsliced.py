"""Exact top-k by a bit-sliced index.

A block of vectors is kept as bitmaps, one for each bit of each quantised
component. The scores of a block for many queries are sums of shifted slices,
added with carries on bitmaps; the best rows are then selected from the most
significant slice of the sum downward, and rows that tie at the boundary are
resolved by their ids. The result is exact.

Null vectors and those with null or non-finite components take no part; of
rows that repeat a vec_id the least vector counts. Zero and empty vectors score
zero. Sums must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import clean_vectors, top_by_blocks

SCALE = 64
TOP = 20
EVERY = 20
_QUERIES = 64  # queries added up together


def slices_of(values: np.ndarray) -> np.ndarray:
    """(components, bits, words): two's complement bitmaps over the rows."""
    rows, dim = values.shape
    most = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    bits, words = most.bit_length() + 1, max(1, -(-rows // 64))
    out = np.zeros((dim, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _mask(flags: np.ndarray) -> np.ndarray:
    return np.where(flags, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]


def summed(slices: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(bits, queries, words): slices of all inner products."""
    dim, bits, words = slices.shape
    bound = int(np.abs(queries).sum(axis=1).max(initial=0)) << (bits - 1)
    total = np.zeros((bound.bit_length() + 1, len(queries), words), np.uint64)
    for d in range(dim):
        size, minus = np.abs(queries[:, d]), _mask(queries[:, d] < 0)
        for j in range(int(size.max(initial=0)).bit_length()):
            used = _mask((size >> j) & 1 == 1)
            if not used.any():
                continue
            carry = np.broadcast_to(minus & used, total.shape[1:])
            for i in range(j, len(total)):
                add = (slices[d, min(i - j, bits - 1)] ^ minus) & used
                half = total[i] ^ add
                kept = total[i] & add
                total[i] = half ^ carry
                carry = kept | (carry & half)
    return total


def selected(total: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (sure, tied) per query: rows among the k best, and rows that tie for the places left."""
    sure, tied = np.zeros_like(valid), valid.copy()
    for i in range(len(total) - 1, -1, -1):
        bit = ~total[i] if i == len(total) - 1 else total[i]
        better = sure | (tied & bit)
        count = np.bitwise_count(better).sum(axis=1)
        more = _mask(count > k)
        sure = (sure & more) | (better & ~more)
        tied &= np.where(more != 0, bit, ~bit)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(ids: np.ndarray, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's k best; ids ascend."""
    words = slices.shape[2]
    real = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    total = summed(slices, queries)
    valid = np.tile(real, (len(queries), 1))
    at = np.searchsorted(ids, query_ids)
    for q in np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == query_ids)):
        valid[q, at[q] // 64] &= ~(np.uint64(1) << np.uint64(at[q] % 64))
    sure, tied = selected(total, valid, k)
    out = []
    for q, query_id in enumerate(query_ids.tolist()):
        rows = _rows(sure[q])
        rows = np.concatenate([rows, _rows(tied[q])[: k - len(rows)]])
        bits = (total[:, q, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        weights = np.left_shift(1, np.arange(len(total), dtype=np.int64))
        weights[-1] = -weights[-1]
        scores = (bits.astype(np.int64) * weights[:, None]).sum(axis=0)
        out += zip([query_id] * len(rows), ids[rows].tolist(), scores.tolist(), strict=True)
    return out


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("vec_id")
    ids = group["vec_id"].to_numpy().astype(np.int64)
    dim = group["dim"][0].as_py()
    values = np.array(group["v"].to_pylist(), np.int64).reshape(len(ids), dim)
    slices = slices_of(values)
    shape = np.array(slices.shape, np.int64)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int32()),
        "ids": [ids.tobytes()], "index": [slices.tobytes()], "extra": [shape.tobytes()],
    })


def _search(k: int):
    def search(row: dict, query_ids: list[int], queries: list[list[int]]) -> list[tuple]:
        ids = np.frombuffer(row["ids"], np.int64)
        slices = np.frombuffer(row["index"], np.uint64).reshape(np.frombuffer(row["extra"], np.int64))
        asked, values = np.array(query_ids, np.int64), np.array(queries, np.int64).reshape(len(query_ids), row["dim"])
        out = []
        for low in range(0, len(asked), _QUERIES):
            out += best(ids, slices, asked[low : low + _QUERIES], values[low : low + _QUERIES], k)
        return out

    return search


def exact_top(
    table: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = TOP, every: int = EVERY, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the ids divisible by ``every``, candidates all other ids."""
    clean = clean_vectors(table, vector, key)
    quantised = clean.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"), "dim")
    return top_by_blocks(quantised, F.col("vec_id") % every == 0, _build, _search(k), "bigint", k)
