import hashlib
import random

import numpy as np
import pytest

from reviewminer.llm.bpe import Encoder, Merges, Plain, decoded, encoded, tokenizer_path
from reviewminer.llm.queries import op12_bpe_round_trip
from reviewminer.sources.tables import load

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def same(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    found = encoder.encode([text.encode()])[0].tolist()
    return found == ids and encoder.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(encoder, library):
    draw = random.Random(7)
    signs = [chr(i) for i in range(0x530)] + [chr(i) for i in (0x1E9E, 0x2000, 0x2028, 0x3000, 0x1F600, 0x1F468, 0xAC00, 0x1100, 0x1161, 0x4E2D, 0x2167)]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", " ", "\n", "ing", "aaaa", "hahaha", "!!!!", "====", "12", "É", "Σ", "İ"]
    for _ in range(2000):
        text = "".join(draw.choice(signs if draw.random() < 0.5 else parts) for _ in range(draw.randint(0, 14)))
        assert same(encoder, library, text), ascii(text)


def test_repeated_letters_and_long_words(encoder, library):
    draw = random.Random(8)
    for _ in range(500):
        assert same(encoder, library, "".join(draw.choice("aehinrstx!.") for _ in range(draw.randint(1, 90))))
    for sign in "aeox!.=-é":
        assert same(encoder, library, sign * draw.randint(1, 3000))


def test_every_character_of_the_plain_way(encoder, library):
    for code in [*range(0x250), *range(0x250, 0x10000, 61)]:
        if not 0xD800 <= code < 0xE000:
            assert same(encoder, library, f"a{chr(code)}B"), hex(code)


def test_accepted_proposals_are_exact(encoder):
    merges = encoder.merges
    assert merges.regular
    draw = random.Random(9)
    words = [merges.symbols("".join(draw.choice("etaoinshr") for _ in range(draw.randint(1, 12)))) for _ in range(3000)]
    flat, lengths = merges.propose(words)
    ends = np.cumsum(lengths).tolist()
    proposals = [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    exact = [merges.merge(w) for w in words]
    for proposal, found in zip(proposals, exact, strict=True):
        pairs = np.array(list(zip(proposal, proposal[1:], strict=False)), np.int64).reshape(-1, 2)
        assert merges.compatible(pairs[:, 0], pairs[:, 1]).all() == (proposal == found)
    assert any(p == f for p, f in zip(proposals, exact, strict=True)) and any(p != f for p, f in zip(proposals, exact, strict=True))
    assert merges.encode(words) == exact


def test_proposals_are_longest_matches(encoder):
    merges = encoder.merges
    draw = random.Random(10)
    words = [merges.symbols("".join(draw.choice("etaoinshrqxé") for _ in range(draw.randint(1, 40)))) for _ in range(500)]
    flat, lengths = merges.propose(words)
    found = []
    for word in words:
        at = 0
        while at < len(word):
            end = next(e for e in range(len(word), at, -1) if word[at:e] in merges.entries)
            found.append(merges.entries[word[at:end]])
            at = end
    assert flat.tolist() == found and lengths.sum() == len(found)


def test_small_vocabularies_without_an_end_mark():
    draw = random.Random(3)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 12:
            pair = draw.choice(list(vocab)), draw.choice(list(vocab))
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                merges.append(pair)
        table = Merges(vocab, merges, "")
        words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 40))) for _ in range(40)]
        assert table.encode(words) == [table.merge(w) for w in words]
        assert [table._merge_short([table.base[c] for c in w]) for w in words] == [table._merge_long([table.base[c] for c in w]) for w in words]


def test_two_derivations_are_merged_word_by_word():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    table = Merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], "")
    assert not table.regular and table.encode(["abc", "bcabc"]) == [[5], [4, 5]]


def test_forgetting_changes_nothing(encoder, monkeypatch):
    from reviewminer.llm import bpe

    texts = [f"word{i} and others {i}".encode() for i in range(300)]
    expected = [e.tolist() for e in encoder.encode(texts)]
    monkeypatch.setattr(bpe, "KNOWN", 10)
    monkeypatch.setattr(bpe, "LONG", 4)
    fresh = Encoder()
    assert [e.tolist() for t in texts for e in fresh.encode([t])] == expected


def test_whole_table_equals_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in op12_bpe_round_trip(spark, sf).collect()}
    docs = load(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_long_texts_and_extra_columns(spark, library):
    long = "lorem ipsum " * 200_000
    rows = [(1, "Hello there", "x"), (1, "Hello there", "y"), (None, None, "z"), (2, "", "z"), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    found = decoded(encoded(docs)).collect()
    lengths = sorted(len(r.ids) for r in found)
    assert lengths == [0, 0, 2, 2, len(library.encode(long, add_special_tokens=False).ids)]
    assert {r.decoded for r in found if len(r.ids) == 2} == {"hello</w> there</w>"}
    assert decoded(encoded(docs.limit(0))).count() == 0
    assert decoded(encoded(docs).selectExpr("doc_id", "cast(null as array<int>) ids")).first().decoded == ""


def test_plain_runs_are_merged_together_and_not_remembered(library):
    draw = random.Random(11)
    signs = ["a", "e", "st", "s", "t", "ve", "ll", "'", "''", ".", "!'", "é", "Œ", "Ÿ", "ß", "²", "¼", "7", "12", "Q", "\x01", "\x1f", "\x7f", "«", " ", "\t\n", "\x0b"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(1500)] + ["", " ", "'", "'s", "l'", "x" * 64, "é" * 32, "'" * 64, "ab"]
    fresh = Encoder()
    found = fresh.encode([t.encode() for t in texts])
    assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(len(run) <= 64 for run in fresh._runs.now)
    odd = ["one ЖЖ two", "中", "", "a<|endoftext|>b <|endoftext|>", f"{'y' * 65} {'z' * 200}", "ЖЖ İ\xa0i"]
    found = fresh.encode([t.encode() for t in odd])
    assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in odd]
    assert {"ЖЖ".encode(), "中".encode()} <= set(fresh._runs.now) and b"one" not in fresh._runs.now


def test_other_vocabularies_are_merged_without_the_plain_way(encoder):
    assert Plain.serves(encoder.merges)
    vocab = {"a": 0, "b": 1, "ab": 2}
    assert not Plain.serves(Merges(vocab, [("a", "b")], ""))
    swapped = dict(encoder.merges.ranks)
    first, second = list(swapped)[:2]
    table = object.__new__(Merges)
    table.__dict__ |= encoder.merges.__dict__
    table.ranks = swapped | {first: (0, swapped[second][1]), second: (1, swapped[first][1])}
    assert not Plain.serves(table)
