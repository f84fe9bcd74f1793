import math
import random

import numpy as np
import pytest
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import functions as F

from reviewminer.operators import graph, leaders, similarity as s


def table(spark, vectors, kind="long", parts=4):
    rows = [(i, [float(x) for x in v] if v is not None else None) for i, v in vectors]
    return spark.createDataFrame(rows, f"id {kind}, vector array<double>").repartition(parts)


def clustered(n, seed=3, dim=6):
    """Vectors around a few directions, with copies and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    out = []
    for i in range(n):
        if i % 17 == 0:
            v = np.zeros(dim)
        elif i % 5 == 0:
            v = centres[0]
        else:
            v = centres[rng.integers(7)] + rng.normal(size=dim) * 0.4
        out.append((i, v.tolist()))
    return out


def cos(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def test_cosine_column(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(s.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 / math.sqrt(2), 0.0, 0.0])


@pytest.mark.parametrize("block_rows", [1000, 40, 7])
def test_similar_pairs_against_brute_force(spark, block_rows):
    data = clustered(150)
    kept = {}
    for i, v in data:
        kept.setdefault(tuple(v), i)
    unique = sorted((i, v) for v, i in kept.items())
    expected = {(i, j): cos(u, v) for i, u in unique for j, v in unique if i < j and cos(u, v) > 0.8}
    rows = s.similar_pairs(table(spark, data), 0.8, block_rows).collect()
    assert len(rows) == len(expected)
    assert {(r.id_a, r.id_b): pytest.approx(r.cosine) for r in rows} == expected
    copies = {(r.id, r.copy_of) for r in s.vector_copies(table(spark, data)).collect()}
    assert copies == {(i, kept[tuple(v)]) for i, v in data if kept[tuple(v)] != i}


def test_similar_pairs_match_the_column_similarity_of_the_transposed_matrix(spark):
    data = [(i, v) for i, v in clustered(30) if any(v)]
    unique = {tuple(v): i for i, v in reversed(data)}
    ids = sorted(unique.values())
    vectors = {i: v for v, i in unique.items()}
    rows = spark.sparkContext.parallelize([OldVectors.dense([vectors[i][d] for i in ids]) for d in range(6)], 2)
    entries = RowMatrix(rows).columnSimilarities().entries.collect()
    expected = {(ids[e.i], ids[e.j]): pytest.approx(e.value) for e in entries if e.value > 0.5}
    assert {(r.id_a, r.id_b): r.cosine for r in s.similar_pairs(table(spark, data), 0.5).collect()} == expected


def test_string_ids_and_empty_input(spark):
    data = [("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])]
    assert [(r.id_a, r.id_b) for r in s.similar_pairs(table(spark, data, "string"), 0.9).collect()] == [("a", "b")]
    assert s.similar_pairs(table(spark, data, "string").limit(0), 0.9).count() == 0
    assert s.connectivity_edges(table(spark, data, "string").limit(0), 0.9).count() == 0


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def labels(df, column="component"):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("block_rows", [1000, 20, 6])
def test_connectivity_edges_keep_the_components(spark, block_rows):
    data = clustered(120, seed=9)
    true_edges = [(i, j) for i, u in data for j, v in data if i < j and cos(u, v) > 0.9]
    expected = union_find([i for i, _ in data], true_edges)
    assert len(set(expected.values())) > 5
    edges = s.connectivity_edges(table(spark, data), 0.9, block_rows)
    assert all(expected[r.src] == expected[r.dst] for r in edges.collect())
    vertices = table(spark, data).select("id")
    assert labels(graph.components(edges, vertices)) == expected


def test_dense_group_has_few_edges(spark):
    rng = np.random.default_rng(1)
    data = [(i, (np.array([1.0, 1.0, 1.0]) + rng.normal(size=3) * 1e-3).tolist()) for i in range(300)]
    assert s.connectivity_edges(table(spark, data), 0.99, 1000).count() == 299


def test_components_on_chain_star_and_random_graph(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)]
    edges += [(999, i) for i in range(200, 260)]
    edges += [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(80)] + [(5, 5)]
    nodes = sorted({n for e in edges for n in e} | {1})
    df = spark.createDataFrame(edges, "src long, dst long")
    vertices = spark.createDataFrame([(n,) for n in nodes], "id long")
    assert labels(graph.components(df, vertices)) == union_find(nodes, edges)
    only_edges = labels(graph.components(df))
    assert 1 not in only_edges and only_edges[160] == 100 and only_edges[999] == 200


def test_components_with_split_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(graph, "MIN_HOT", 5)
    monkeypatch.setattr(graph, "HOT_SHARE", 10**9)
    edges = [(500, i) for i in range(60)] + [(i, i + 1000) for i in range(20)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert set(labels(graph.components(df)).values()) == {0}


@pytest.mark.parametrize("gathered", [0, 1_000])
def test_components_by_lists_and_by_joins_are_equal(spark, monkeypatch, gathered):
    monkeypatch.setattr(graph, "GATHERED", gathered)
    monkeypatch.setattr(graph, "MIN_HOT", 5)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(40, 40 + i) for i in range(9)] + [(5, 5)]
    edges += [(rng.randrange(60, 160), rng.randrange(60, 160)) for _ in range(60)] + [(61, 60), (60, 61)]
    rows = [(min(e), max(e)) if rng.random() < 0.5 else (max(e), min(e)) for e in edges] + [(None, 3), (7, None)]
    df = spark.createDataFrame(rows + rows[:20], "src bigint, dst bigint")
    ends = {v for a, b in edges if a != b for v in (a, b)}
    assert labels(graph.components(df)) == union_find(sorted(ends), edges)


def test_components_of_few_edges_take_few_stages(spark):
    sc, rows = spark.sparkContext, [(i, i + 1) for i in range(40)]
    sc.setJobGroup("few-stages", "components")
    try:
        assert set(labels(graph.components(spark.createDataFrame(rows, "src bigint, dst bigint"))).values()) == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("few-stages")
    assert jobs and sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs) < 70


def test_components_without_edges(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.components(empty).count() == 0
    assert labels(graph.components(empty, spark.range(3))) == {0: 0, 1: 1, 2: 2}


def greedy(items, threshold):
    """One by one, as the clusters are defined."""
    leading, out = [], {}
    for i, _, v in sorted(items, key=lambda t: (-t[1], t[0])):
        hit = next((l for l, w in leading if cos(v, w) > threshold), None)
        if hit is None:
            leading.append((i, v))
        out[i] = i if hit is None else hit
    return out


@pytest.mark.parametrize("batch", [4096, 10, 1])
@pytest.mark.parametrize("parts", [1, 4, 16])
def test_leaders_equal_the_sequential_rule(spark, batch, parts):
    if batch == 1 and parts != 4:
        pytest.skip("slow and covered once")
    rng = random.Random(2)
    n = 24 if batch == 1 else 90
    items = [(i, rng.randint(1, 6), v) for i, v in clustered(n, seed=5)]
    df = spark.createDataFrame(items, "id long, priority long, vector array<double>").repartition(parts)
    expected = greedy(items, 0.85)
    assert 5 < len(set(expected.values())) < n
    assert labels(leaders.leader_clusters(df, 0.85, batch), "leader") == expected


def test_chain_of_three(spark):
    """A~B, B~C, not A~C."""
    angle = [0.0, 0.5, 1.0]
    vectors = [[math.cos(a), math.sin(a)] for a in angle]
    items = [(n, p, v) for n, p, v in zip("ABC", (3, 2, 1), vectors)]
    df = spark.createDataFrame(items, "id string, priority long, vector array<double>")
    t = math.cos(0.7)
    assert labels(leaders.leader_clusters(df, t), "leader") == {"A": "A", "B": "A", "C": "C"}
    edges = s.connectivity_edges(df.select("id", "vector"), t)
    assert set(labels(graph.components(edges, df.select("id"))).values()) == {"A"}


def test_leader_edge_cases(spark):
    df = spark.createDataFrame([("z", 1, [0.0]), ("n", 2, None)], "id string, priority long, vector array<double>")
    assert labels(leaders.leader_clusters(df, 0.5), "leader") == {"z": "z", "n": "n"}
    with pytest.raises(ValueError):
        leaders.leader_clusters(df, 1.0)


def test_transpose(spark):
    entries = s.matrix_entries(table(spark, [(1, [5.0, 6.0]), (2, [7.0, 8.0])]))
    moved = {(r.row_id, r.col_id): r.value for r in s.transpose(entries).collect()}
    assert moved == {(0, 1): 5.0, (1, 1): 6.0, (0, 2): 7.0, (1, 2): 8.0}
    assert s.transpose(s.transpose(entries)).exceptAll(entries).count() == 0


def test_copies_of_a_hot_vector_are_split(spark, monkeypatch):
    data = [(i, [1.0, 2.0]) for i in range(50)] + [(i, [float(i), 1.0]) for i in range(50, 60)]
    monkeypatch.setattr(s, "HOT_COPIES", 5)
    assert {(r.id, r.copy_of) for r in s.vector_copies(table(spark, data)).collect()} == {(i, 0) for i in range(1, 50)}


def test_similar_pairs_query_keeps_every_copy(spark, tmp_path):
    from reviewminer.plans.parameters import VECTOR_THRESHOLD
    from reviewminer.plans.queries import similar_pairs

    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 4))
    base[5] = base[4] + 0.01
    rows = [(i, [float(x) for x in base[0 if i % 3 == 0 else i % 6]]) for i in range(60)] + [(60, [0.0] * 4), (61, [0.0] * 4)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = similar_pairs(spark, str(tmp_path)).collect()
    firsts = {i: i for i, _ in rows} | {r.id_b: r.id_a for r in got if r.cosine == 1.0}
    near = {(r.id_a, r.id_b) for r in got if r.cosine < 1.0}
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows[:60]}
    for a in range(60):
        for b in range(a + 1, 60):
            similar = v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) > VECTOR_THRESHOLD
            pair = tuple(sorted((firsts[a], firsts[b])))
            assert similar == (pair[0] == pair[1] or pair in near), (a, b)
    assert len(got) < 2 * len(rows) and not {60, 61} & {i for r in got for i in (r.id_a, r.id_b)}
