import hashlib
import random
import zlib

import duckdb
import pytest

from reviewminer.llm import trie
from reviewminer.llm.oracles import CONVERSATION_TRIE
from reviewminer.llm.queries import op13_conversation_trie
from reviewminer.llm.trie import prefix_trie, turn_rows, with_shared_heads

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """{conv_id: [(role, text), ...]} by the rule, from (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        found.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = found.get(conv - int(conv - 100 * int(conv / 100)), [])[:h] + turns[h:]
    return out


def plain(sequences):
    """The nodes from {conv_id: sequence}, one beginning at a time."""
    members, ends = {}, {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) or 1
        saved[node] = sum(saved[c] for c in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        if node:
            children.setdefault(node[:-1], []).append(node)
    return sorted(
        (
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
            for node, convs in members.items()
        ), key=str,
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")


def made(seed, convs, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, turn, draw.choice(["user", "assistant"][: 1 + turn % 2]), draw.choice(["a", "bb", "déjà"][: 1 + draw.randint(0, 2)])))
    return rows


@pytest.mark.parametrize("cells, width, key", [(10**6, 256, 16), (40, 256, 16), (40, 256, 2), (60, 3, 2), (30, 1, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, cells, width, key):
    monkeypatch.setattr(trie, "MIN_HOT", 5)
    rows = made(cells + width, 130, 7)
    found = prefix_trie(with_shared_heads(turn_rows(table(spark, rows))), cells, key, width)
    assert rows_of(found) == plain(rebuilt(rows))


def test_hot_conversation_over_many_shards(spark):
    rows = [(c, t, "user", "same text") for c in range(200) for t in range(4)] + made(3, 20, 5)[5:]
    rows += [(1000 + c, 0, "user", "same text") for c in range(150)]
    sequences = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[:2]):
        sequences.setdefault(conv, []).append((role, text))
    found = prefix_trie(turn_rows(table(spark, [(c, i, *t) for c, turns in sequences.items() for i, t in enumerate(turns)])), 50)
    assert rows_of(found) == plain(sequences)


def test_nulls_repeats_long_rows_and_turnless_ones(spark):
    rows = [(5, 0, "user", "x"), (5, 0, "user", "x"), (5, None, None, None), (105, 1, None, "y"), (None, 0, "user", "lost"), (100, 0, "user", "z" * 100_000)]
    rows += [(7, t, "user", str(t)) for t in range(1500)] + [(8, t, "user", str(t)) for t in range(1400)]
    rows += [(300, 2, "user", "q"), (-150, 0, "user", "n"), (-100, 0, "user", "m")]
    sequences = rebuilt(rows)
    found = prefix_trie(with_shared_heads(turn_rows(table(spark, rows))))
    assert rows_of(found) == plain(sequences)
    assert [] in sequences.values()


def test_empty_table(spark):
    assert rows_of(prefix_trie(with_shared_heads(turn_rows(table(spark, [(1, 0, "", "")]).limit(0))))) == []


def test_given_table_equals_brute_force_and_sql(spark, sf):
    path = f"{sf}/conversations.parquet"
    found = rows_of(op13_conversation_trie(spark, sf))
    rows = spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()
    assert found == plain(rebuilt([tuple(r) for r in rows]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    answer = con.execute(CONVERSATION_TRIE)
    names = [c[0] for c in answer.description]
    assert found == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in answer.fetchall()), key=str)
