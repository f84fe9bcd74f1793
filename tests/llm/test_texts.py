"""Operators on texts against brute force, with empty, null, repeated and long cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewminer.llm import packing, pii, quality, urlfilter
from reviewminer.llm.linededup import LineRuns, drop_repeated_lines, hashed_lines
from reviewminer.llm.mixing import cheapest_flow, mixed
from reviewminer.llm.sharding import rebalanced, sharded

DOCS = "doc_id bigint, text string, source string, docs int"
LONG = "this line is surely longer than forty code points, is it not"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None)[:3] + (1,) for r in rows], DOCS)


CASES = [
    *[(k, f"own {k}\n  {LONG.upper()}\t\n" + ("short\n" * k) + LONG, "a") for k in range(6)],
    (6, None, None), (7, "", "b"), (8, "\n\n", "b"), (9, "w " * 30_000, "a"), (9, "w " * 30_000, "a"), (None, LONG, "c"),
]


def cleaned(rows):
    holders = defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark):
    got = drop_repeated_lines(docs_of(spark, CASES))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == cleaned(CASES)
    assert drop_repeated_lines(docs_of(spark, [])).collect() == []


def test_runs_report_new_keys_and_compact(spark):
    runs, seen = LineRuns(spark), set()
    for batch in range(5):
        rows = [(batch * 3 + k, f"{LONG} {(batch + k) % 4}", "a") for k in range(3)]
        hashed = hashed_lines(docs_of(spark, rows))
        keys = {(r.h1, r.h2) for r in hashed.collect()}
        assert {(r.h1, r.h2) for r in runs.add(hashed).collect()} == keys - seen
        seen |= keys
    assert sum(map(len, runs.levels)) < 5
    assert sum(r.docs for r in runs.counts().collect()) == 15


def test_mix(spark):
    got = mixed(docs_of(spark, CASES)).collect()
    assert len(got) == len(CASES)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        name = r.sources[0]
        taken[name] += r.taken
        size[name] += r.size
        target[name] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for name, words in target.items():
        assert abs(taken[name] - words) <= 1 and words <= 3 * size[name]
    assert sorted(map(str, got)) == sorted(map(str, mixed(docs_of(spark, CASES)).collect()))
    assert mixed(docs_of(spark, [])).collect() == []


def test_mix_of_overlapping_sources(spark):
    rows = [(k, "a b c d", [["x"], ["x", "y"], ["y", None]][k % 3]) for k in range(30)]
    got = mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")).collect()
    assert sum(r.taken for r in got) > 0 and all(0 <= r.taken <= 3 * r.size for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    """Against all integer flows of a tiny network."""
    from itertools import product

    rng = random.Random(seed)
    capacity, quota, members = [rng.randint(1, 2), rng.randint(1, 2)], [rng.randint(0, 4), rng.randint(0, 4)], [[0, 1], [rng.randint(0, 1)]]
    flow = cheapest_flow(capacity, quota, members, 2)

    def cost(used):
        return sum(max(0, u - c) for u, c in zip(used, capacity, strict=True))

    best = max(
        ((a + b + c, -cost((a + b, c))) for a, b, c in product(range(5), repeat=3)
         if a + b <= 2 * capacity[0] and c <= 2 * capacity[1]
         and a + c * (members[1] == [0]) <= quota[0] and b + c * (members[1] == [1]) <= quota[1]),
    )
    used = [sum(f) for f in flow]
    assert (sum(used), -cost(used)) == best


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = [(k, t, None) for k, t in enumerate(["Some words here", "", None, "many " * 9000, " "])]
    got = packing.packed(docs_of(spark, rows)).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for k, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        found = b"".join(bytes(r.ids) for r in pieces)
        assert found == b"".join(i.to_bytes(4, "little") for i in ids)
        assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in pieces)
        assert all(r.doc_tokens == len(ids) for r in pieces)
    assert packing.packed(docs_of(spark, [])).collect() == []


def test_sharding(spark):
    rows = [(k, "x" * (k * 37 % 500), None) for k in range(400)] + [(None, None, None)] * 3
    got = sharded(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 10
    assert sharded(docs_of(spark, [])).collect() == []


def test_rebalancing_moves_only_what_it_must():
    sizes = {s: 10 for s in range(16)} | {0: 200}
    before = {s: s % 4 for s in range(16)}
    after = rebalanced(sizes, before, 4)
    assert set(after) == set(before) and sum(after[s] != before[s] for s in before) <= 4


def test_quality(spark):
    rows = [(k, "good plain words in a row " * (1 + k % 3) if k % 4 else "ba##d!! &&& wo$$rds!! " * 3, "a") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 200, 5)], "doc_id bigint, quality int, toxic int")
    got = quality.judged(docs_of(spark, rows + [(None, None, None), (900, "", None)]), labels)
    assert got.columns[:4] == ["doc_id", "text", "source", "docs"]
    found = {r.doc_id: r.kept for r in got.collect() if r.doc_id is not None and r.doc_id < 200}
    assert not any(kept for k, kept in found.items() if k % 4 == 0)
    assert sum(kept for k, kept in found.items() if k % 4) >= 0.95 * 150
    top = quality.judged(docs_of(spark, rows), labels, k=20).where("kept").collect()
    assert len(top) == 20 and all(r.doc_id % 4 for r in top)
    assert quality.judged(docs_of(spark, rows), labels.limit(0)).where("not kept").count() == 0
    assert quality.judged(docs_of(spark, []), labels).collect() == []


def test_repeated_labelled_rows_count_once_for_the_cut(spark, monkeypatch):
    seen, cut = [], quality.best_cut
    monkeypatch.setattr(quality, "best_cut", lambda keys, good: seen.append((keys.tolist(), good.tolist())) or cut(keys, good))
    rows = [(k, f"plain words {k}", "a") for k in range(20)] + [(0, f"hot {k}", "a") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id bigint, quality int, toxic int")
    for parts in (1, 7):
        quality.judged(docs_of(spark, rows).repartition(parts), labels, labelled=20)
    assert seen[0] == seen[1] and len(seen[0][0]) == 20 and sum(seen[0][1]) == 10


MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
FORMS = [
    MAIL, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, form in enumerate(FORMS):
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = [True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True,
                    16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15]
            if fits[k]:
                out.append((k, *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_formats():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("a.@-+1902 5(é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    assert pii.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_personal_spans(spark):
    text = "mail me at jo@example.org or +1 (555) 555-0100, 10.0.0.1, card 4111 1111 1111 1111, 999.1.1.1"
    rows = [(k, text, None) for k in range(60)] + [(60, None, None), (61, "", None), (None, "9" * 50_000, None)]
    for r in pii.personal_spans(docs_of(spark, rows)).collect():
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(text if (r.doc_id or 99) < 60 or r.doc_id == 0 else "")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == ([1, 1, 1, 1] if base else [0] * 4)
    assert pii.personal_spans(docs_of(spark, [])).collect() == []


def test_digit_stretches_are_cut_at_every_separator():
    for text, wanted in [
        ("555-123-4567 555-987-6543", [(3, 0, 12), (3, 13, 25)]),
        ("10.0.0.1 4111.1111.1111.1111", [(1, 0, 8), (2, 9, 28)]),
        ("1 " * 60 + "(555) 123-4567", [(3, 120, 134)]),
        ("jo [at] a.example.org. Then", [(0, 0, 21)]),
    ]:
        assert set(wanted) <= set(pii.candidates(text)), text


def test_new_forms_are_added_and_others_are_not(spark):
    rng, rows = random.Random(7), []
    for k in range(150):
        head = f"4{rng.randrange(10**14):014}"
        card = next(head + d for d in "0123456789" if pii.luhn(head + d))
        mail, ip = f"m{k}.x@h{k % 9}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4))
        rows.append((k, f"so {mail} and {ip} or {card} was +1 ({rng.randint(200, 999)}) 555-{k:04} there", None))
    new = {
        "see 555-123-4567 555-987-6543 now": ["phone:4:16", "phone:17:29"],
        "see 10.0.0.1 4111.1111.1111.1111 now": ["ip:4:12", "card:13:32"],
        "see 3782 822463 10005 now": ["card:4:21"],
        "see jo.m [at] mail.example.org now": ["email:4:30"],
        "see 4111.1111.1111.1112 now": [], "see 2019-05-17 now": [], "see 1.250.000 now": [],
    }
    rows += [(1000 + i, text, None) for i, text in enumerate(new)]
    got = {r.doc_id: r.spans for r in pii.personal_spans(docs_of(spark, rows)).collect()}
    for i, wanted in enumerate(new.values()):
        assert got[1000 + i] == ",".join(wanted)


def test_urls(spark):
    urls = [
        "http://Sub.Example.COM/en/1?x#y", "https://www.example.com/en/a", "x.net/es/1", None, "ftp://b.net/es/", "http://b.net/es",
        "http://example.com", "http://a.org/x://y/z?q", "http://notexample.com/en/", "://", "http://h.net/" + "a/" * 500,
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged_urls(pages).collect()}
    assert [got[k][2] for k in range(11)] == [
        "example.com/en/", "www.example.com/en/", None, None, "net/es/", None, None, None, "com/", None, None,
    ]
    assert got[0][:2] == ("sub.example.com", "/en/1") and got[2][:2] == ("", "") and got[7][:2] == ("a.org", "/x://y/z")
    assert [got[k][3] for k in (0, 1, 3, 4)] == ["block", "allow", "allow", "block"]
    assert urlfilter.judged_urls(pages.limit(0)).collect() == []


def test_templates_of_blocked_sections_are_rejected(spark):
    rows = [(k, f"http://h.net/{['es', 'fr', 'xx'][k % 3] if k % 7 else 'q' + str(k)}/{k}") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = urlfilter.judged_urls(pages).collect()
    assert all(r.verdict == "block" for r in got if r.rule)
    assert {r.template for r in got} == {"es/*", "fr/*", "xx/*", "*/*"}


def test_personal_data_learns_from_every_example(spark, monkeypatch):
    rows = [(k, f"mail jo{k}@example.org or +1 (555) 555-{k:04}, 10.0.0.{k}, card 4111 1111 1111 1111", None) for k in range(90)]
    table = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(5)
    schema = "doc_id bigint, base binary, loose binary, features binary, learnt binary, rights array<int>"
    proposed = table.mapInArrow(pii._propose, schema).persist()
    every = sum(len(r.rights) for r in proposed.select("rights").collect())
    seen = []
    whole = pii.threshold
    monkeypatch.setattr(pii, "threshold", lambda s, n, r: seen.append(int(n.sum())) or whole(s, n, r))
    models, bars = pii.learnt(proposed)
    assert 0.2 * every < sum(seen) < 0.5 * every  # a third of all examples is held out
    assert all(len(m) == pii.ROUNDS for m in models) and any(np.isfinite(bars))
    again = pii.learnt(proposed.repartition(3))
    assert again == (models, bars)


def test_quantiles_and_threshold_of_counted_values():
    values, counts = np.array([1.0, 2.0, 7.0]), np.array([5, 1, 9])
    assert pii.quantiles(values, counts).tolist() == np.unique(np.quantile(np.repeat(values, counts), pii.PLACES)).tolist()
    score, n, right = np.array([3.0, 2.0, 1.0, 0.0]), np.array([40, 10, 5, 5]), np.array([40, 9, 5, 0])
    assert pii.threshold(score, n, right) == 0.5 and pii.threshold(score, n, right * 0) == np.inf
    assert pii.threshold(score[1:], n[1:], right[1:], 0.9) == 0.5
