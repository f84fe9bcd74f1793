"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

Both tokenizers cut a blank and the text into tokens; where tokens of both end
at the same byte, a group ends. The end offsets of the two are two ascending
lists, and the shorter drives: each of its ends gallops into the longer, first
by doubling steps from a start near by, then by halving. The ranks found tell
everything: equal ends are the cuts between groups, and a token's overlap with
the other side is the range between its predecessor's rank and its own.

No token of either side reaches over a border between a visible character and a
blank, so a text is aligned as the row of its stretches between such borders,
and every distinct stretch of a block of texts is encoded and aligned once, all
of them as one pair of lists. (A second vocabulary with tokens over such borders
is handled with whole texts as stretches.)

Blocks hold a bounded amount of text, or one longer text. For the counts over
the corpus a block sends each of its distinct pairs once, with the number of its
texts that hold it, and gets the corpus's count back; its texts keep only which
stretches they hold.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.skew import join_hot_keys
from .bpe import byte_symbols, text_blocks
from .common import enough_tasks, written

BLOCK = 5_000_000  # bytes of text in a block
MIN_HOT = 50_000
HOT_SHARE = 1000  # pairs that more than 1/1000 of all (block, pair) rows name are split
_BORDER = re.compile(r"(?<=\S) ")
_BLANK = "▁"
_OLD = re.compile("[\\x00-\u024f]*")  # letters and numbers of these are the same in every version of Unicode
_TOGETHER = 2000  # stretches encoded as one text
_RUN = 1000  # characters; longer stretches are left to the tokenizer file's own library


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each x of ``short``: how many of the ascending ``long`` are below it, looked for from ``start`` on.

    All searches take their steps together; those that are done leave.
    """
    size = len(long)
    low, high = np.zeros(len(short), np.int64), np.full(len(short), size, np.int64)
    at = np.clip(start, 0, max(size - 1, 0))
    open_, step = np.arange(len(short)) if size else np.empty(0, np.int64), 1
    up = long[at[open_]] < short[open_]
    while len(open_):  # doubling
        below = long[at[open_]] < short[open_]
        low[open_] = np.where(below, at[open_] + 1, low[open_])
        high[open_] = np.where(below, high[open_], at[open_])
        go = (below == up) & (low[open_] < high[open_])
        open_, up = open_[go], up[go]
        at[open_] = np.clip(at[open_] + np.where(up, step, -step), 0, size - 1)
        step *= 2
    open_ = np.nonzero(low < high)[0]
    while len(open_):  # halving
        middle = (low[open_] + high[open_]) // 2
        below = long[middle] < short[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges start, start + 1, ... of the given lengths, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


def align(a: np.ndarray, b: np.ndarray, a_from: np.ndarray | None = None, b_from: np.ndarray | None = None):
    """(cut_a, cut_b, link_a, link_b) for two ascending lists of token ends with equal last ends.

    ``cut_a`` and ``cut_b`` are the token numbers at which a group ends on either
    side; links are the pairs of overlapping tokens. ``*_from`` give each token a
    start for the search in the other list.
    """
    swap = len(b) < len(a)
    short, long, start = (b, a, b_from) if swap else (a, b, a_from)
    rank = gallop(short, long, np.arange(len(short)) if start is None else start)
    equal = long[np.minimum(rank, len(long) - 1)] == short if len(short) else np.empty(0, bool)
    first = np.concatenate([[0], (rank + equal)[:-1]]) if len(short) else np.empty(0, np.int64)
    many = rank - first + 1
    link_short, link_long = np.repeat(np.arange(len(short)), many), spread(first, many)
    cut_short = np.nonzero(equal)[0]
    cut_long = rank[cut_short]
    return (cut_long, cut_short, link_long, link_short) if swap else (cut_short, cut_long, link_short, link_long)


class Pair:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        given = tokenizer_paths()
        path_a, path_b = path_a or given[0], path_b or given[1]
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        codes = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(codes[s] for s in token) if all(s in codes for s in token) else token.encode()
        self.quick = self._quick(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(size)))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(size) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.by_stretch = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)
        self.alone = [self.b.piece_to_id(_BLANK)]  # what a blank at the end of a text is; alone it would be skipped
        self.size_b = size
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        names = [*map(str, range(max(len(self.bytes_a), size)))]
        self.names_a = [n + "," for n in names], [n + "|" for n in names]
        self.names_b = [n + "," for n in names], [n + ";" for n in names]

    def _quick(self, spec: dict):
        """The same merges in a faster library, if they make the ids in ascending order and split as that library does."""
        import public_tokenizers
        import tiktoken

        vocab, way = spec["model"]["vocab"], spec["pre_tokenizer"]
        made = [vocab["".join(m)] for m in spec["model"]["merges"]]
        plain = way and way["type"] == "ByteLevel" and way["use_regex"] and not way["add_prefix_space"] and not spec["normalizer"]
        if not plain or made != list(range(256, 256 + len(made))) or len(vocab) != 256 + len(made):
            return None
        ranks = {self.bytes_a[i]: i for i in vocab.values()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def flat(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """(a, b, n_a, n_b, bad): ids of both sides one stretch after the other, their numbers, and stretches not given back."""
        found = []
        for at in range(0, len(stretches), _TOGETHER):
            part = stretches[at : at + _TOGETHER]
            found.append(self._together(part) or self._apart(part))
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate([empty.astype(bool) if i == 4 else empty, *(f[i] for f in found)]) for i in range(5))

    def _together(self, stretches: list[str]) -> tuple[np.ndarray, ...] | None:
        """As one text, if every stretch ends in a visible character and all bytes come back."""
        if not all(stretches) or any(s[-1].isspace() for s in stretches):
            return None
        text = " ".join(stretches)
        quick = self.quick and _OLD.fullmatch(text) and max(map(len, stretches)) < _RUN
        ids = (
            self.quick(" " + text) if quick else self.a.encode(" " + text, add_special_tokens=False).ids,
            self.b.encode(text),
        )
        whole = f" {text}".encode()
        ends = np.cumsum([len(s) + 1 for s in (stretches if text.isascii() else map(str.encode, stretches))])
        out = []
        for tokens, table, lengths in zip(ids, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
            if b"".join(map(table.__getitem__, tokens)) != whole:
                return None
            flat = np.array(tokens, np.int64)
            out.append((flat, np.diff(np.searchsorted(np.cumsum(lengths[flat]), ends, "right"), prepend=0)))
        return out[0][0], out[1][0], out[0][1], out[1][1], np.zeros(len(stretches), bool)

    def _apart(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        ids_b = [ids if s else self.alone for s, ids in zip(stretches, self.b.encode(stretches, num_threads=1), strict=True)]
        bad = np.zeros(len(stretches), bool)
        for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)):
            bad |= [b"".join(map(table.__getitem__, i)) != f" {s}".encode() for s, i in zip(stretches, ids, strict=True)]
        for i in np.nonzero(bad)[0].tolist():
            ids_a[i] = ids_b[i] = []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        return a, b, n_a, n_b, bad

    def stretches(self, text: str) -> list[str]:
        """The blank and the text, cut before each blank that follows a visible character; the blank itself is left out."""
        return _BORDER.split(text) if self.by_stretch else [text]


@lru_cache(maxsize=2)
def pair_of(path_a: str | None, path_b: str | None) -> Pair:
    """One pair per process and files."""
    return Pair(path_a, path_b)


class Aligned:
    """Distinct stretches, aligned: tokens, groups and links of each."""

    def __init__(self, pair: Pair, stretches: list[str]):
        count = len(stretches)
        a, b, self.n_a, self.n_b, self.bad = pair.flat(stretches)
        own_a, own_b = np.repeat(np.arange(count), self.n_a), np.repeat(np.arange(count), self.n_b)
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        a_from = first_b[own_a] + np.arange(len(a)) - first_a[own_a]
        b_from = first_a[own_b] + np.arange(len(b)) - first_b[own_b]
        cut_a, cut_b, link_a, link_b = align(np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b]), a_from, b_from)
        self.n_groups = np.bincount(own_a[cut_a], minlength=count)
        self.n_links = np.bincount(own_a[link_a], minlength=count)
        self.codes = a[link_a] * pair.size_b + b[link_b]  # links of one stretch stand together, in order
        self.groups = self._written(pair, a, b, cut_a, cut_b)

    def _written(self, pair: Pair, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """Each stretch's groups as text, closed by a semicolon."""
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[cut_a] = ends_b[cut_b] = 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        place = np.empty(len(a) + len(b), np.int64)
        many_a, many_b = np.bincount(group_a, minlength=len(cut_a)), np.bincount(group_b, minlength=len(cut_b))
        place[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = np.arange(len(a))
        place[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = len(a) + np.arange(len(b))
        names = np.empty(len(place), object)
        for names_of, ids, ends, at in ((pair.names_a, a, ends_a, 0), (pair.names_b, b, ends_b, len(a))):
            names[at : at + len(ids)] = [names_of[e][i] for i, e in zip(ids.tolist(), ends.tolist(), strict=True)]
        words = names[place].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[s:e]) for s, e in zip([0, *ends], ends, strict=False)]


_SCHEMA = pa.schema(
    [("block", pa.int64()), ("is_block", pa.bool_()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.string()), ("stretches", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("pairs", pa.list_(pa.int64())), ("pair_texts", pa.list_(pa.int64()))]
    + [("stretch_links", pa.list_(pa.int32())), ("stretch_pairs", pa.list_(pa.int32()))]
)
_DDL = (
    "block bigint, is_block boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    "stretches array<int>, times array<int>, pairs array<bigint>, pair_texts array<bigint>, stretch_links array<int>, stretch_pairs array<int>"
)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive pieces that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[ends], prepend=0)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _block(pair: Pair, number: int, doc_ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    index: dict[str, int] = {}
    rows = [[index.setdefault(s, len(index)) for s in pair.stretches(t)] if t else [] for t in texts]
    distinct = list(index)
    order = sorted(range(len(distinct)), key=lambda i: not distinct[i] or distinct[i][-1].isspace())  # those in the way of others last
    found = Aligned(pair, [distinct[i] for i in order])
    renamed = np.empty(len(order), np.int64)
    renamed[order] = np.arange(len(order))
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = renamed[np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))]
    ends = np.cumsum(lengths)
    groups = ["".join(map(found.groups.__getitem__, flat[s:e].tolist()))[:-1] or None for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    broken = _sums(found.bad[flat].astype(np.int64), ends) > 0
    flat = flat[~np.repeat(broken, lengths)]
    lengths[broken] = 0
    ends = np.cumsum(lengths)
    counts = [_sums(n[flat], ends) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    groups = [None if b else g for g, b in zip(groups, broken.tolist(), strict=True)]

    size = max(len(index), 1)
    held, times = np.unique(np.repeat(np.arange(len(rows)), lengths) * size + flat, return_counts=True)
    text, stretch = held // size, held % size
    held_ends = np.searchsorted(text, np.arange(len(rows)), "right")
    pairs, local = np.unique(found.codes, return_inverse=True)
    first = np.cumsum(found.n_links) - found.n_links
    many = found.n_links[stretch]
    named = np.unique(np.repeat(text, many) * max(len(pairs), 1) + local[spread(first[stretch], many)])
    texts_of_pair = np.bincount(named % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
    shown = texts_of_pair > 0  # stretches of broken texts alone leave pairs that no text holds

    def batch(**columns) -> pa.RecordBatch:
        rows = len(columns["block"])
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _SCHEMA], schema=_SCHEMA)

    names = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, counts), strict=True))
    yield batch(
        block=pa.array([number] * len(rows), pa.int64()), is_block=pa.array([False] * len(rows)), doc_id=doc_ids, groups=pa.array(groups, pa.string()),
        stretches=_lists(stretch, held_ends, pa.int32()), times=_lists(times, held_ends, pa.int32()), **names,
    )
    shown_as = np.cumsum(shown) - 1
    kept = shown[local]
    links = _sums(kept.astype(np.int64), np.cumsum(found.n_links))
    yield batch(
        block=pa.array([number], pa.int64()), is_block=pa.array([True]), pairs=pa.array([pairs[shown]], pa.list_(pa.int64())),
        pair_texts=pa.array([texts_of_pair[shown]], pa.list_(pa.int64())), stretch_links=pa.array([links], pa.list_(pa.int32())),
        stretch_pairs=pa.array([shown_as[local[kept]]], pa.list_(pa.int32())),
    )


def cross_aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block: int = BLOCK) -> DataFrame:
    """The alignment table of docs(doc_id, text), in one pass without a shuffle.

    Rows with ``is_block`` false are the documents: doc_id, n_a, n_b, n_groups,
    n_links, ``groups`` (``a1,a2|b1;a3|b2``: ids of both sides, group by group) and,
    for ``with_link_counts``, their stretches. The others describe the blocks. Null and
    empty texts, and texts that a side cannot give back byte by byte, have no
    tokens: counts of 0 and null groups. Null and repeated doc_ids are rows like
    others, further columns are not read, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
        for ids, texts in text_blocks(batches, block):
            yield from _block(pair, number, ids, [t.decode() for t in texts])
            number += 1

    rows = enough_tasks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(run, _DDL)


def _judged(keep: list[str], schema: pa.Schema):
    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        is_block = left.column("is_block").to_numpy(zero_copy_only=False)
        texts = left.filter(pa.array(~is_block))
        about = left.filter(pa.array(is_block))
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs)
        best, texts_of_pair = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("best", "texts"))
        named = np.asarray(about.column("stretch_pairs")[0].values)
        ends = np.cumsum(np.asarray(about.column("stretch_links")[0].values).astype(np.int64))
        stretches = texts.column("stretches").combine_chunks()
        held, times = (np.asarray(c.flatten()).astype(np.int64) for c in (stretches, texts.column("times").combine_chunks()))
        text_ends = np.cumsum(np.asarray(stretches.value_lengths()).astype(np.int64))
        found = [pa.array(_sums(_sums(v[named], ends)[held] * times, text_ends)) for v in (best, texts_of_pair)]
        return pa.Table.from_arrays([*(texts.column(c) for c in keep), *found], schema=schema)

    return judge


def with_link_counts(table: DataFrame, size_b: int) -> DataFrame:
    """The documents of a written alignment table with n_best and count_sum.

    A pair's count is the number of documents that hold it linked; n_best counts
    a document's links whose count is the highest of their A id. Hot pairs are
    split; the best counts, one row per A id, are bounded by the vocabulary.
    """
    held = table.where("is_block").select("block", F.inline(F.arrays_zip("pairs", "pair_texts"))).withColumnRenamed("pairs", "pair")
    counts = written(held.groupBy("pair").agg(F.sum("pair_texts").alias("texts"), F.count(F.lit(1)).alias("blocks")), "pair-counts")
    a_id = F.expr(f"pair div {size_b}")
    best = counts.groupBy(a_id.alias("a")).agg(F.max("texts").alias("most"))
    judged = counts.withColumn("a", a_id).join(F.broadcast(best), "a").select("pair", "texts", "blocks", (F.col("texts") == F.col("most")).alias("best"))
    total = counts.agg(F.sum("blocks")).first()[0] or 0
    hot = max(MIN_HOT, total // HOT_SHARE)
    found = join_hot_keys(held.select("block", "pair"), judged, "pair", "blocks", hot).select(F.col("block").alias("of_block"), "pair", "texts", "best")
    inner = {"is_block", "block", "stretches", "times", "pairs", "pair_texts", "stretch_links", "stretch_pairs"}
    keep = [c for c in table.columns if c not in inner]
    out = table.select(*keep).withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")}).schema
    return table.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_judged(keep, to_arrow_schema(out)), out)
