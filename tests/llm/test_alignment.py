import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewminer.llm import alignment
from reviewminer.llm.alignment import Pair, _block, align, cross_aligned, gallop, with_link_counts
from reviewminer.llm.common import written
from reviewminer.llm.queries import op11_token_alignment
from reviewminer.sources.tables import load

pytest.importorskip("public_tokenizers")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


@pytest.fixture(scope="module")
def pair():
    return Pair()


def plainly(pair, text):
    """(groups, links) token by token from the two libraries, or None."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    whole = f" {text}".encode()
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return None
    spans = []
    for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, side = 0, []
        for i in ids:
            side.append((at, at + len(table[i]), i))
            at += len(table[i])
        spans.append(side)
    groups, links, i, j = [], [], 0, 0
    for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
        left, right = [], []
        while i < len(spans[0]) and spans[0][i][1] <= end:
            left.append(spans[0][i])
            i += 1
        while j < len(spans[1]) and spans[1][j][1] <= end:
            right.append(spans[1][j])
            j += 1
        groups.append(",".join(str(t[2]) for t in left) + "|" + ",".join(str(t[2]) for t in right))
        links += [(x[2], y[2]) for x in left for y in right if x[0] < y[1] and y[0] < x[1]]
    return ";".join(groups), links


def expected(pair, texts):
    """One row per text: counts, digest, best links and count sum."""
    found = [plainly(pair, t) for t in texts]
    held = Counter(p for f in found if f for p in set(f[1]))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for text, f in zip(texts, found, strict=True):
        if not f:
            rows.append((0, 0, 0, 0, "", 0, 0))
            continue
        groups, links = f
        rows.append(
            (len(pair.a.encode(" " + text, add_special_tokens=False).ids), len(pair.b.encode(text)), groups.count(";") + 1, len(links),
             hashlib.sha256(groups.encode()).hexdigest(), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links))
        )
    return rows


def test_gallop_equals_searching():
    draw = np.random.default_rng(1)
    for _ in range(200):
        long = np.unique(draw.integers(0, 60, draw.integers(0, 30)))
        short = np.unique(draw.integers(0, 60, draw.integers(0, 30)))
        start = draw.integers(-3, 40, len(short))
        assert gallop(short, long, start).tolist() == np.searchsorted(long, short).tolist()


def test_align_equals_overlap_of_ranges():
    draw = np.random.default_rng(2)
    for _ in range(200):
        size = int(draw.integers(1, 25))
        a, b = (np.unique([*draw.integers(1, size + 1, draw.integers(0, 25)), size]) for _ in range(2))
        cut_a, cut_b, link_a, link_b = align(a, b)
        assert a[cut_a].tolist() == b[cut_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        starts = [np.concatenate([[0], e[:-1]]) for e in (a, b)]
        overlaps = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]}
        assert len(link_a) == len(overlaps) and set(zip(link_a.tolist(), link_b.tolist(), strict=True)) == overlaps


def test_random_texts_equal_both_libraries(pair):
    assert pair.by_stretch and pair.quick
    draw = random.Random(5)
    signs = [chr(i) for i in range(0x250)] + [chr(i) for i in (0x301, 0x2000, 0x2028, 0x3000, 0x2581, 0x1F600, 0xAC00, 0x1161, 0xFB01, 0xFF21)]
    parts = [" ", "  ", "   ", "\n", " \n", "\n ", "\t", " the", " ing", "<s>", "</s>", "<|endoftext|>", "'s", "<0x0A>", "<unk>", "x" * 1200, " " * 1500]
    texts = ["".join(draw.choice(signs if draw.random() < 0.3 else parts) for _ in range(draw.randint(0, 12))) for _ in range(1500)]
    rows = list(_block(pair, 0, pa.array(range(len(texts)), pa.int64()), texts))[0]
    plain = [plainly(pair, t) for t in texts]
    assert rows.column("groups").to_pylist() == [p[0] if p else None for p in plain]
    assert rows.column("n_links").to_pylist() == [len(p[1]) if p else 0 for p in plain]
    assert any(p is None for p in plain) and sum(p is not None for p in plain) > 500


def test_whole_table_equals_brute_force(spark, sf, pair):
    docs = load(spark, sf, "documents").orderBy("doc_id").collect()
    rows = op11_token_alignment(spark, sf).orderBy("doc_id").collect()
    found = [(*(r[c] for c in COUNTS), r.groups_sha256, r.n_best, r.count_sum) for r in rows]
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    assert found == expected(pair, [d.text for d in docs])


def test_many_blocks_hot_pairs_nulls_and_extra_columns(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "MIN_HOT", 2)
    long = "several words again and again " * 3000
    texts = ["the same words here", "the same words here", None, "", "the ▁ sign", long, "other Étés", "the", "▁"]
    data = [(None if i == 1 else i % 4, t, "z", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id int, text string, groups string, block int")
    table = written(cross_aligned(docs, block=20), "alignments")
    assert table.where("is_block").count() > 3
    found = with_link_counts(table, pair.size_b).collect()
    rows = sorted((*(r[c] for c in COUNTS), hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "", r.n_best, r.count_sum) for r in found)
    assert rows == sorted(expected(pair, texts))
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d[0]) for d in data)
    empty = written(cross_aligned(docs.limit(0)), "alignments")
    assert with_link_counts(empty, pair.size_b).count() == 0
