"""Near-duplicates against a brute-force comparison of all sets."""

from __future__ import annotations

import re
from itertools import combinations

import pytest

from reviewminer.llm import neardup, setsketch
from reviewminer.llm.neardup import near_duplicates

WORDS = "abcdefghijklmnopqrstuvwxyz"


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows: list[tuple]) -> dict:
    sets = [shingles(r[1]) for r in rows]
    root = {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        union = len(sets[i]) + len(sets[j]) - common
        if union and 100 * common >= 75 * union:
            a, b = sorted((top(rows[i][0]), top(rows[j][0])))
            root[b] = a
    return {r[0]: (len(s), top(r[0])) for r, s in zip(rows, sets, strict=True)}


def found(spark, rows, schema="doc_id bigint, text string"):
    docs = spark.createDataFrame(rows, schema)
    return near_duplicates(docs).collect()


def check(spark, rows):
    got = found(spark, rows)
    expected = brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_small_tables_match_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_chain_threshold_short_and_empty(spark):
    base = [f"w{i}" for i in range(40)]
    chain = [" ".join(base[i : i + 36]) for i in range(5)]
    rows = list(enumerate([*chain, "A b", "a\tB", "a b c", "", None, " \n", chain[0].upper()]))
    check(spark, rows)


def test_large_group_in_several_blocks(spark):
    """A hub and copies that resemble the hub only, so that most pairs are no links."""
    base = [f"w{i}" for i in range(400)]
    rows = [(0, "something else entirely goes in here")]
    for k in range(1, 700):
        words = list(base)
        words[(k * 7) % 390] = f"x{k}"
        words[(k * 13 + 5) % 390] = f"y{k}"
        rows.append((k, " ".join(words)))
    check(spark, rows)


@pytest.mark.parametrize("rounds", [1, 2])
def test_tiny_blocks_leave_the_rest_to_meetings_of_blocks(spark, monkeypatch, rounds):
    """A chain: every text resembles its neighbours only, so blocks settle next to nothing."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    words = [f"w{i}" for i in range(220)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 60])) for k in range(33)]
    rows += [(100 + k, " ".join([*words[100:160], f"tail{k}"])) for k in range(20)]
    check(spark, [*rows, rows[3], (200, rows[3][1])])


def test_empty_table_extra_columns_and_null_id(spark):
    assert found(spark, []) == []
    schema = "fp string, doc_id bigint, component string, text string, rep int"
    got = found(spark, [("x", None, None, "a b c d e f", 1), ("y", 3, "z", "a b c d e f", None)], schema)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (3, 3, True)}


def test_sketches_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    a, b = np.sort(pool[:4000]), np.sort(pool[1000:])
    factors = setsketch.multipliers()
    ra, rb, both = setsketch.registers([a, b, np.sort(pool)], factors)
    assert (setsketch.merged(ra, rb) == both).all()
    counts = setsketch.compared(ra[None], rb[None])
    values = setsketch.likelihoods(*counts, np.array([[4000.0]]), np.array([[4000.0]]))[0, 0]
    assert abs(setsketch._GRID[values.argmax()] - 0.6) <= 0.1
    assert not setsketch.may_reach(*counts, np.array([[400.0]]), np.array([[4000.0]]), 0.75)[0, 0]
