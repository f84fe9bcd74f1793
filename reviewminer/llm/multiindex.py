"""Approximate nearest neighbours by inverted multi-indexes.

Every block of vectors has its own index: two codebooks, one for each half of
the components, fitted on at most ``SAMPLE`` of its distinct vectors, and the
list of vectors for every pair of centroids. A query visits pairs by their
summed nearness, from a heap, until ``SHARE`` of the block's distinct vectors
are gathered; those are ranked by the exact measure. Equal vectors are one
entry with all its ids, so copies cost no recall.

Vectors null, zero, or with null or non-finite components take no part; of
rows that repeat a vec_id the least vector counts. Nearness is the inner
product in double precision. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import clean_vectors, top_by_blocks

TOP = 20
EVERY = 20
CENTROIDS = 24
SAMPLE = 4096
SHARE = 0.65
_ROUNDS = 8
_SLACK = 1e-12  # of the lengths' product: more than two ways of summing a product differ by


def codebook(half: np.ndarray, centroids: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = half[rng.permutation(len(half))[:SAMPLE]]
    centres = points[: min(centroids, len(points))].copy()
    for _ in range(_ROUNDS):
        code = nearest(points, centres)
        for c in range(len(centres)):
            members = points[code == c]
            if len(members):
                centres[c] = members.mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def traversed(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Centroid pairs by falling sum of the two scores, until their lists hold ``enough`` vectors."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    first, second, sizes = first.tolist(), second.tolist(), sizes.tolist()
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    pairs, gathered = [], 0
    while heap and gathered < enough:
        _, i, j = heapq.heappop(heap)
        size = sizes[a[i]][b[j]]
        if size:
            pairs.append((a[i], b[j]))
            gathered += size
        # a pair is pushed by its left neighbour; the first column by the row above
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
    return pairs


def _build(centroids: int):
    def build(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy().astype(np.int64)
        dim = group["dim"][0].as_py()
        flat = group["v"].combine_chunks().flatten().to_numpy()
        kind, vectors = flat.dtype, flat.astype(float).reshape(len(ids), dim)
        distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
        cut = (dim + 1) // 2
        books = [codebook(distinct[:, :cut], centroids), codebook(distinct[:, cut:], centroids)]
        code = nearest(distinct[:, :cut], books[0]) * len(books[1]) + nearest(distinct[:, cut:], books[1])
        order = np.argsort(code, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.bincount(code, minlength=len(books[0]) * len(books[1]))
        at = np.lexsort((ids, place[entry.ravel()]))
        starts = np.concatenate([[0], np.cumsum(np.bincount(place[entry.ravel()], minlength=len(order)))])
        head = np.array([len(order), len(books[0]), len(books[1]), cut], np.int64)
        extra = b"".join(x.tobytes() for x in (head, sizes.astype(np.int64), starts.astype(np.int64), *books))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int32()),
            "ids": [ids[at].tobytes()], "index": [distinct[order].astype(kind).tobytes()], "extra": [extra],
        })

    return build


def _list_scores(vectors: np.ndarray, asked: np.ndarray, visited: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Inner products, up to rounding, of every query with the vectors of the lists it visits; -inf elsewhere.

    A list is read once, for all the queries that visit it.
    """
    close = np.full((len(asked), len(vectors)), -np.inf)
    for at, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if high > low and len(by := np.flatnonzero(visited[:, at])):
            found = asked[by] @ vectors[low:high].T
            close[by, low:high] = np.where(np.isfinite(found), found, np.inf)  # overflows are ranked by the exact measure
    return close


def _search(k: int, share: float):
    def search(row: dict, query_ids: list[int], queries: list[list[float]]) -> list[tuple]:
        ids, dim, extra = np.frombuffer(row["ids"], np.int64), row["dim"], row["extra"]
        n, ka, kb, cut = np.frombuffer(extra, np.int64, 4).tolist()
        kind = np.dtype(f"f{len(memoryview(row['index'])) // (n * dim)}")  # floats that come as such are kept so
        vectors = np.frombuffer(row["index"], kind).astype(float).reshape(n, dim)
        sizes = np.frombuffer(extra, np.int64, ka * kb, 32)
        starts = np.frombuffer(extra, np.int64, n + 1, 32 + 8 * ka * kb)
        books = np.frombuffer(extra, float, -1, 32 + 8 * (ka * kb + n + 1))
        one, two = books[: ka * cut].reshape(ka, cut), books[ka * cut :].reshape(kb, dim - cut)
        ends = np.cumsum(sizes).reshape(ka, kb)
        sizes = sizes.reshape(ka, kb)
        asked = np.array(queries, float).reshape(len(query_ids), dim)
        first, second = asked[:, :cut] @ one.T, asked[:, cut:] @ two.T
        enough, out = max(k + 1, int(np.ceil(share * n))), []
        visited = np.zeros((len(query_ids), ka * kb), bool)
        for q in range(len(query_ids)):
            visited[q, [i * kb + j for i, j in traversed(first[q], second[q], sizes, enough)]] = True
        close = _list_scores(vectors, asked, visited, ends.ravel())
        largest = np.sqrt((vectors**2).sum(axis=1).max())
        for q, query_id in enumerate(query_ids):
            rows = np.flatnonzero(close[q] > -np.inf)
            if len(rows) > k + 1:  # the query itself may be one of them
                bar = np.partition(close[q, rows], len(rows) - k - 1)[len(rows) - k - 1]
                slack = _SLACK * largest * np.sqrt((asked[q] ** 2).sum()) + 1e-300
                if np.isfinite(bar - slack):
                    rows = rows[close[q, rows] >= bar - slack]
            scores = (vectors[rows] * asked[q]).sum(axis=1)
            pool = []
            for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
                some = ids[starts[r] : starts[r + 1]][: k + 1].tolist()
                pool += [(-s, i) for i in some if i != query_id]
            out += [(query_id, i, -s) for s, i in sorted(pool)[:k]]
        return out

    return search


def nearest_neighbours(
    table: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = TOP, every: int = EVERY,
    centroids: int = CENTROIDS, share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the ids divisible by ``every``, candidates all other ids."""
    clean = clean_vectors(table, vector, key, lambda v: F.exists(v, lambda x: x != 0))
    return top_by_blocks(clean, F.col("vec_id") % every == 0, _build(centroids), _search(k, share), "double", k)
