"""Vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from reviewminer.llm import multiindex, vectors
from reviewminer.llm.bitsliced import exact_top
from reviewminer.llm.multiindex import nearest_neighbours, traversed

KIND = "vec_id bigint, embedding array<float>, label int, dim string"
ODD = [(9001, None), (9002, [None] * 8), (9003, [float("nan")] * 8), (9004, [float("inf")] * 8), (None, [1.0] * 8), (9020, [0.0] * 8)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[300:600] = v[7]  # a third are copies
    return v


def table(spark, data):
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(data)] + [(i, v, 0, "x") for i, v in ODD]
    return spark.createDataFrame(rows, KIND)


def brute(ids, vectors, scored):
    out = {}
    for q in [i for i in ids if i % 20 == 0]:
        scores = sorted((-scored(vectors[q], vectors[c]), c) for c in ids if c != q)
        out[q] = [(c, -s) for s, c in scores[:20]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_exact_top(spark, data):
    vectors = {i: np.floor(64 * v.astype(float)).astype(int) for i, v in enumerate(data)} | {9020: np.zeros(8, int)}
    assert found(exact_top(table(spark, data))) == brute(list(vectors), vectors, lambda a, b: int(a @ b))
    few = spark.createDataFrame([(0, [1.0], 0, ""), (20, [-2.0], 0, "")], KIND)
    assert found(exact_top(few)) == {0: [(20, -8192)], 20: [(0, -8192)]}
    assert exact_top(few.limit(0)).collect() == []


def test_a_list_is_read_once_for_its_queries(data, monkeypatch):
    rng = np.random.default_rng(2)
    data = np.concatenate([data, 1e-9 * rng.normal(size=(300, 8)).astype(np.float32) + data[8]]).astype(float)
    built = multiindex._build(4)(pa.table({
        "vec_id": range(len(data)), "v": data.tolist(), "dim": [8] * len(data), "block": [0] * len(data)
    })).to_pylist()[0]
    read, plain = [], multiindex._list_scores
    monkeypatch.setattr(multiindex, "_list_scores", lambda *a: read.append(len(a[1])) or plain(*a))
    asked = list(range(0, len(data), 20))
    got = multiindex._search(20, 1.0)(built, asked, data[asked].tolist())
    assert read == [len(asked)]
    for q in asked:
        scores = sorted((-float((data[q] * v).sum()), c) for c, v in enumerate(data) if c != q)[:20]
        assert [(c, s) for a, c, s in got if a == q] == [(c, -s) for s, c in scores]


def test_neighbours(spark, data):
    vectors = {i: v.astype(float) for i, v in enumerate(data)}
    want = brute(list(vectors), vectors, lambda a, b: float((a * b).sum()))
    got = found(nearest_neighbours(table(spark, data)))
    assert got.keys() == want.keys()
    hits = sum(len({c for c, _ in got[q]} & {c for c, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    whole = found(nearest_neighbours(table(spark, data), share=1.0))
    assert {q: [c for c, _ in r] for q, r in whole.items()} == {q: [c for c, _ in r] for q, r in want.items()}
    assert nearest_neighbours(table(spark, data).limit(0)).collect() == []


def test_pairs_come_by_falling_sum():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.normal(size=5), rng.normal(size=6), np.ones((5, 6), int)
    pairs = traversed(a, b, sizes, 30)
    sums = [a[i] + b[j] for i, j in pairs]
    assert len(set(pairs)) == 30 and sums == sorted(sums, reverse=True)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(found.apply, range(found.size())) if f.getName().startswith("shuffle")}


@pytest.mark.parametrize("query_rows", [4, 45])
def test_indexes_are_not_copied_for_blocks_of_queries(spark, query_rows, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_QUERIES", query_rows, raising=False)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(data)], KIND)
    real = vectors.top_by_blocks
    with monkeypatch.context() as patched:
        patched.setattr(multiindex, "top_by_blocks", lambda *a: real(*a, rows=100, query_rows=query_rows))
        before = shuffle_files(spark)
        rows = nearest_neighbours(df, share=1.0).collect()
    size = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    want = brute(range(900), data.astype(float), lambda a, b: float((a * b).sum()))
    assert {(r.query_id, r.rank, r.vec_id) for r in rows} == {(q, n, c) for q, best in want.items() for n, (c, _) in enumerate(best, 1)}
    assert size < 2 * data.nbytes


def test_doubles_and_odd_lengths_are_searched_with_their_own(spark):
    rows = [(i, [float(i), 1.0 / 3 + i][: 1 + i % 2], 0, "x") for i in range(60)]
    kind = KIND.replace("float", "double")
    got = found(nearest_neighbours(spark.createDataFrame(rows, kind), share=1.0))
    vectors_of = {i: np.array(v) for i, v, _, _ in rows if any(v)}
    for q, best in got.items():
        fits = [i for i, v in vectors_of.items() if len(v) == len(vectors_of[q]) and i != q]
        assert best == sorted(((i, float((vectors_of[i] * vectors_of[q]).sum())) for i in fits), key=lambda b: (-b[1], b[0]))[:20]
    assert got.keys() == {20, 40}


def test_the_best_of_several_parts_are_kept():
    query, ids = np.array([2, 1, 2, 1, 2, 1]), np.array([5, 4, 3, 2, 1, 0])
    score = np.array([1.0, np.nan, 1.0, 7.0, 0.0, np.inf])
    kept = vectors._kept(query, ids, score, 2)
    assert [c.tolist() for c in kept[:2]] == [[1, 1, 2, 2], [4, 0, 3, 5]]
    assert [c.tolist() for c in vectors._kept(*(c[:0] for c in (query, ids, score)), 2)] == [[], [], []]
