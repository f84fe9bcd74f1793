"""Byte-pair encoding by proposal and check, and its decoding.

A word's tokens are proposed by greedy longest match. A row of tokens is what
the merges give if every two neighbours are: then no merge ever crosses a
border. That is checked for all neighbours of all words of a bunch at once;
only words with a failing pair are merged step by step.

Two neighbours are checked backwards in time. Tokens appear in the order of
their merges, so of the two facing tokens the later one is taken apart first,
and each facing pair must have no merge that would have come before either of
the two was used up. This needs one derivation per token and derivations that
come before their use; a vocabulary that breaks it is merged word by word.

Normalising and splitting into words follow the tokenizer file: for Latin
letters by an equal pattern, else by the file's own components. Runs between
ASCII white space are independent of each other.

Runs of plain characters, nearly all, take a shorter way (``Plain``): the ends
of all words of a bunch are marked at once and tiktoken merges the words. The
other runs are remembered, up to a bound: then those not met again since half
as many were new are forgotten.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enough_tasks

BUNCH = 1_000_000  # bytes of text encoded together
KNOWN = 800_000  # runs remembered, and words
LONG = 64  # bytes; longer runs are not remembered and take the longer way
_NEVER = 1 << 40
_LAST = 0x1000  # added to the code of a word's last symbol, which carries the end mark
_APART = "\x00"  # between words; no symbol of a vocabulary
_SHORT = 24  # symbols; longer words are merged with a queue

# Below U+0180, two white spaces and one capital of two lower-case letters aside, every character is its own
# composed form and has one lower-case letter, so the file's steps are these.
_PLAIN = re.compile("[^\x80-\xa0\u0130\u0180-\U0010ffff]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t-\r{_LETTERS}{_NUMBERS}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if it is printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Tokens and merges of a vocabulary whose words end in a marked symbol."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end_mark: str):
        self.end_mark = end_mark
        size = max(vocab.values()) + 1
        self.birth = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.size, self.ranks = size, {}
        self.regular = True
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.ranks[x, y] = (rank, made)
            if self.birth[made] >= 0 or max(self.birth[x], self.birth[y]) >= rank:
                self.regular = False
            self.birth[made], self.left[made], self.right[made] = rank, x, y
        self.rank_of = {p: r for p, (r, _) in self.ranks.items()}
        self.made = {r: t for r, t in self.ranks.values()}
        self.base = {s: i for s, i in ((self._shown(t), i) for t, i in vocab.items()) if len(s) == 1}
        keys = np.array([x * size + y for x, y in self.ranks], np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._key_ranks = np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        self.entries = {self._shown(t): i for t, i in vocab.items() if i in self._usable()} if self.regular else {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for shown, i in self.entries.items():
            self.automaton.add_word(shown, i)
        self.automaton.make_automaton()

    def _shown(self, token: str) -> str:
        """The token with one character per symbol."""
        if not self.end_mark or not token.endswith(self.end_mark) or len(token) == len(self.end_mark):
            return token
        body = token[: -len(self.end_mark)]
        return body[:-1] + chr(ord(body[-1]) + _LAST)

    def symbols(self, word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + _LAST) if self.end_mark else word

    def _usable(self) -> set[int]:
        """Tokens that their own characters are merged into."""
        if hasattr(self, "_used"):
            return self._used
        made = np.nonzero(self.birth >= 0)[0]
        made = made[np.argsort(self.birth[made])]
        fits = self.compatible(self.left[made], self.right[made], self.birth[made])
        used = set(self.base.values())
        for token, fit in zip(made.tolist(), fits.tolist(), strict=True):
            if fit and self.left[token] in used and self.right[token] in used:
                used.add(token)
        self._used = used
        return used

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self._keys):
            return np.full(len(x), _NEVER)
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._key_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair: no merge crosses the border (before merge ``until``)."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_end = np.full(len(x), _NEVER - 1) if until is None else until.astype(np.int64)
        y_end = x_end.copy() if until is None else x_end - 1  # the merge ``until`` itself may cross
        fine = np.ones(len(x), bool)
        open_ = np.arange(len(x))
        while len(open_):
            rank = self._rank(x, y)
            crossed = (rank < x_end) & (rank <= y_end)  # of two equal merges the left one comes first
            fine[open_[crossed]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~crossed & ((bx >= 0) | (by >= 0))
            open_, x, y, x_end, y_end, bx, by = (v[go] for v in (open_, x, y, x_end, y_end, bx, by))
            first = bx > by
            x_end, y_end = np.where(first, bx, x_end), np.where(first, y_end, by)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return fine

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, numbers): the longest match from the left, again and again, of all words; every symbol is a token, so nothing is skipped."""
        text = _APART.join(words)
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return found[:, 1], np.diff(np.searchsorted(found[:, 0], ends, "left"), prepend=0)

    def merge(self, symbols: str) -> list[int]:
        """Exact merging: always the earliest merge, the leftmost of equals."""
        tokens = [self.base[s] for s in symbols]
        return self._merge_short(tokens) if len(tokens) <= _SHORT else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        rank_of = self.rank_of.get
        facing = [rank_of(p, _NEVER) for p in pairwise(tokens)]
        while facing and (best := min(facing)) < _NEVER:
            i = facing.index(best)
            tokens[i] = made = self.made[best]
            del tokens[i + 1], facing[i]
            if i:
                facing[i - 1] = rank_of((tokens[i - 1], made), _NEVER)
            if i < len(facing):
                facing[i] = rank_of((made, tokens[i + 1]), _NEVER)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        after = list(range(1, len(tokens) + 1))
        before = list(range(-1, len(tokens) - 1))
        ranks = self.ranks
        queue = [(*ranks[p], i, *p) for i, p in enumerate(pairwise(tokens)) if p in ranks]
        heapq.heapify(queue)
        while queue:
            _, made, i, x, y = heapq.heappop(queue)
            j = after[i] if tokens[i] == x else len(tokens)
            if j >= len(tokens) or tokens[j] != y:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = k = after[j]
            if k < len(tokens):
                before[k] = i
                if (made, tokens[k]) in ranks:
                    heapq.heappush(queue, (*ranks[made, tokens[k]], i, made, tokens[k]))
            h = before[i]
            if h >= 0 and (tokens[h], made) in ranks:
                heapq.heappush(queue, (*ranks[tokens[h], made], h, tokens[h], made))
        return [t for t in tokens if t >= 0]

    def encode(self, words: list[str], exact: Callable[[str], list[int]] | None = None) -> list[list[int]]:
        """Tokens of every word (symbols as given by ``symbols``); ``exact`` merges those whose proposal fails."""
        exact = exact or self.merge
        if not self.regular:
            return [exact(w) for w in words]
        flat, lengths = self.propose(words)
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.nonzero(owner[:-1] == owner[1:])[0]
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back]
        tokens, ends = flat.tolist(), np.cumsum(lengths).tolist()
        found = [tokens[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        for i in np.unique(owner[inside[~fine]]).tolist():
            found[i] = exact(words[i])
        return found


class Memory:
    """What was found for a key, in two generations of bounded size."""

    def __init__(self):
        self.now: dict = {}
        self.before: dict = {}

    def missing(self, keys: Iterable) -> list:
        """Keys that are not known, each once; known ones move to the present generation."""
        new = set(keys).difference(self.now)
        found = new.intersection(self.before)
        self.now.update(zip(found, map(self.before.__getitem__, found), strict=True))
        return list(new.difference(found))

    def age(self) -> None:
        if len(self.now) > KNOWN // 2:
            self.now, self.before = {}, self.now

_BLANK, _LETTER, _NUMBER, _SIGN, _ODD = range(5)  # classes of characters; odd ones take the longer way
_BREAK, _HOLE = 10, 13  # code for the end of a text, for a run that is filled in; white space is no symbol


def _plain_classes() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case letter) of the characters below U+0180."""
    signs = list(map(chr, range(0x180)))
    lower = [c.lower() if _PLAIN.fullmatch(c) else c for c in signs]
    classes = [
        _BLANK if c in " \t\n\x0b\x0c\r" else _ODD if not _PLAIN.fullmatch(c) else _LETTER if re.match(f"[{_LETTERS}]", c)
        else _NUMBER if re.match(f"[{_NUMBERS}]", c) else _SIGN for c in lower
    ]
    return np.array(classes, np.uint8), np.array(list(map(ord, lower)), np.uint16)


class Plain:
    """Words of plain characters merged by tiktoken, many texts at once.

    A word's last byte is marked by a code of its own (a capital for a to z).
    Tokens whose own characters are merged into them are what tiktoken may
    make: it joins neighbours that spell the next token, and they are the two
    that the merge names, because no earlier merge crossed their borders.
    """

    def __init__(self, merges: Merges, pieces: dict[str, int]):
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {}
        for token, i in pieces.items():
            marked = token.endswith(merges.end_mark) and len(token) > len(merges.end_mark)
            spelt = [byte_of[c] for c in (token[: -len(merges.end_mark)] if marked else token)]
            if i in merges._usable() and not any(65 <= b <= 90 for b in spelt):  # no capital is left
                codes = [self._code(b, marked and at == len(spelt)) for at, b in enumerate(spelt, 1)]
                ranks["".join(map(chr, codes)).encode()] = i
        self.break_, self.hole = 1 << 30, (1 << 30) + 1  # no ids, not of added tokens either
        ranks |= {chr(_BREAK).encode(): self.break_, chr(_HOLE).encode(): self.hole}
        last = "A-Z\u0100-\u01ff"
        self._tokens = tiktoken.Encoding("words", pat_str=f"[^{last}\n\r]*[{last}]|[\n\r]", mergeable_ranks=ranks, special_tokens={})
        self._codes = np.array([self._code(b, m) for m in (False, True) for b in range(256)], np.uint16)
        self._classes, self._lower = _plain_classes()
        self._byte_classes = np.append(self._classes[:128], np.full(128, _ODD, np.uint8))

    @staticmethod
    def _code(byte: int, marked: bool) -> int:
        return byte + 256 * marked if not 97 <= byte <= 122 else byte - 32 * marked

    @staticmethod
    def serves(merges: Merges) -> bool:
        """Ids ascend with the merges, after those of all marked and unmarked bytes."""
        made = [made for _, made in sorted(merges.ranks.values())]
        bases = {chr(ord(c) + last) for c in byte_symbols() for last in (0, _LAST)}
        return bool(
            merges.regular and merges.end_mark and bases == merges.base.keys() and made == sorted(made)
            and max(merges.base.values()) < min(made, default=0)
        )

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(ids, runs): ``break_`` ends each text, ``hole`` stands for each of the runs that are not plain."""
        joined = b"\n".join(texts) + b"\n\n"
        low = np.frombuffer(joined.lower(), np.uint8)
        classes = self._byte_classes[low]
        pairs = np.flatnonzero((low >= 0xC2) & (low <= 0xC5))  # first bytes of two-byte characters
        pairs = pairs[low[pairs + 1] & 0xC0 == 0x80]
        if len(pairs):
            low = low.copy()
            signs = (low[pairs].astype(np.uint16) & 0x1F) << 6 | low[pairs + 1] & 0x3F
            classes[pairs] = classes[pairs + 1] = self._classes[signs]
            signs = self._lower[signs]
            low[pairs], low[pairs + 1] = 0xC0 | signs >> 6, 0x80 | signs & 0x3F
        last = self._word_ends(joined, low, classes, pairs)
        codes = self._codes[low + (last.astype(np.uint16) << 8)]
        keep = classes != _BLANK
        runs = self._cut_out(joined, low, classes, codes, keep)
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        codes[breaks], keep[breaks] = _BREAK, True
        return self._tokens.encode_to_numpy(codes[keep].tobytes().decode("utf-16-le")).view(np.int32), runs

    @staticmethod
    def _word_ends(joined: bytes, low: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Whether a word ends with the byte: where the class changes, after every number, after 's and its like."""
        last = np.append(classes[1:] != classes[:-1], False)
        last |= classes == _NUMBER
        last[pairs] = False
        if b"'" in joined:
            at = np.flatnonzero(low == ord("'"))
            at = at[classes[at - 1] != _SIGN]  # else the sign before it takes it; before the first byte is the last, a blank
            one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
            short = np.isin(one, list(b"stmd"))
            long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            last[at[short | long]] = False
            last[at[short] + 1] = last[at[long] + 2] = True
        return last

    @staticmethod
    def _cut_out(joined: bytes, low: np.ndarray, classes: np.ndarray, codes: np.ndarray, keep: np.ndarray) -> list[bytes]:
        """Runs with odd characters, with what may begin an added token and long ones, each replaced by one code."""
        ends = np.flatnonzero(classes == _BLANK)
        lengths = np.diff(ends, prepend=-1)  # with the blank
        odd = lengths > LONG + 1
        odd[np.searchsorted(ends, np.flatnonzero(classes == _ODD))] = True
        if b"<|" in joined:
            odd[np.searchsorted(ends, np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|"))))] = True
        if not odd.any():
            return []
        keep &= ~np.repeat(odd, lengths)
        stops = ends[odd]
        starts = stops - lengths[odd] + 1
        codes[starts], keep[starts] = _HOLE, True
        return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


class Encoder:
    """A tokenizer file of words: texts to ids and back."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or tokenizer_path()
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], map(tuple, model["merges"]), model["end_of_word_suffix"] or "")
        self.normalizer, self.pre_tokenizer, self._model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self._split = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")")
        names = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max(names.values()) + 1)
        for piece, i in names.items():
            self.pieces[i] = piece
        self._shown = dict(enumerate(byte_symbols()))
        self._runs, self._words = Memory(), Memory()
        self._plain = Plain(self.merges, model["vocab"]) if Plain.serves(self.merges) else None

    def _merged(self, symbols: str) -> list[int]:
        """Exact merging by the file's own model, which sets the end mark itself."""
        word = symbols[:-1] + chr(ord(symbols[-1]) - _LAST) if self.merges.end_mark else symbols
        return [token.id for token in self._model.tokenize(word)]

    def _words_of(self, part: bytes) -> list[str]:
        if part.isalpha():  # of ASCII
            return [part.decode().lower()]
        if part[:-1].isalpha() and part[-1:] in b".,;:!?":
            return [part[:-1].decode().lower(), chr(part[-1])]
        text = part.decode()
        if _PLAIN.fullmatch(text):
            found = _PLAIN_WORDS.findall(text.lower())
            return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self._shown) for w in found]
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _learn(self, runs: list[bytes]) -> None:
        """Find the ids of new runs."""
        plan: list[list[str | int]] = []
        for run in runs:
            if b"<|" in run:
                parts: list[str | int] = []
                for part in self._split.split(run):
                    parts += [self.added[part]] if part in self.added else self._words_of(part)
            else:
                parts = self._words_of(run)
            plan.append(parts)
        merges, words = self.merges, self._words
        new = words.missing(w for w in chain.from_iterable(plan) if isinstance(w, str))
        known = words.now
        for word, ids in zip(new, merges.encode(list(map(merges.symbols, new)), self._merged), strict=True):
            known[word] = array("i", ids).tobytes()
        found = self._runs.now
        for run, parts in zip(runs, plan, strict=True):
            if len(parts) == 1 and isinstance(parts[0], str):
                found[run] = known[parts[0]]
            else:
                found[run] = b"".join([known[p] if isinstance(p, str) else np.int32(p).tobytes() for p in parts])
        for word in new:
            if len(word) > LONG:
                del known[word]
        words.age()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text given in UTF-8."""
        if not self._plain:
            return [np.frombuffer(b"".join(runs), np.int32) for runs in self._looked_up([t.split() for t in texts])]
        ids, odd = self._plain.encode(texts)
        if odd:
            raw, ends = memoryview(ids.tobytes()), (4 * np.flatnonzero(ids == self._plain.hole)).tolist()
            between = [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]
            (filled,) = self._looked_up([odd])
            ids = np.frombuffer(b"".join([between[0], *chain.from_iterable(zip(filled, between[1:], strict=True))]), np.int32)
        ends = np.flatnonzero(ids == self._plain.break_).tolist()
        return [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    def _looked_up(self, split: list[list[bytes]]) -> list[list[bytes]]:
        """Ids of runs; new ones are found and remembered."""
        new = self._runs.missing(chain.from_iterable(split))
        self._learn(new)
        known = self._runs.now
        found = [list(map(known.__getitem__, runs)) for runs in split]
        for run in new:
            if len(run) > LONG:
                del known[run]
        self._runs.age()
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, added ones included, as a file without a decoder asks for."""
        return " ".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per process and file: tasks that follow each other share what it knows."""
    return Encoder(path)


def text_blocks(batches: Iterable[pa.RecordBatch], most: int = BUNCH) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_ids, texts) of consecutive rows of at most ``most`` bytes together, or one longer text; null texts are empty."""
    ids: list[pa.Array] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
        at = done = 0
        while at < len(ends):
            stop = max(int(np.searchsorted(ends, done + most - size, "right")), at + (not texts))
            if stop > at:
                ids.append(batch.column("doc_id").slice(at, stop - at))
                texts += [t or b"" for t in column.slice(at, stop - at).to_pylist()]
                size, done, at = size + int(ends[stop - 1]) - done, int(ends[stop - 1]), stop
            if at < len(ends):
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))


def _encoding(path: str | None, decode: bool):
    names = ["doc_id", "ids", "decoded"][: 2 + decode]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or tokenizer_path())
        for doc_ids, texts in text_blocks(batches):
            found = encoder.encode(texts)
            columns = [doc_ids, _lists(found)]
            if decode:
                columns.append(pa.array([encoder.decode(ids.tolist()) for ids in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


def encoded(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text), one row for each row, read in whole and in place; (.., decoded) on request.

    Null and empty texts have no ids and decode to empty texts. Null and repeated doc_ids
    are rows like others, further columns are not read, an empty table gives an empty one.
    """
    rows = enough_tasks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(_encoding(path, decode), "doc_id bigint, ids array<int>" + ", decoded string" * decode)


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of tokens(doc_id, ids); null lists decode to empty texts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or tokenizer_path())
        for batch in batches:
            lists = batch.column("ids")
            texts = pa.array([encoder.decode(ids or ()) for ids in lists.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, texts], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, ids array<int>, decoded string")
