"""Prefix trie of conversations: shared beginnings, their members and what sharing saves.

Conversations become rows of 128-bit turn hashes, range-sharded by their first
turns and, among equals, by conv_id, so that no sequence is too common for a
shard. A shard numbers its turns, fills a padded matrix, sorts its rows with
``lexsort`` and compares neighbours: a change in a column, or-accumulated to the
right, marks where the nodes of every depth start, and ``reduceat`` sums each
depth between the marks.

A node of a shard can only occur elsewhere if it is a beginning of the shard's
first or last row (or, deeper than the range key, lies below that key). These
boundary nodes leave the shard as partial sums, are added up by node, and get
the sums of their subtrees in rounds that double the distance looked down.
All other nodes are final. Rows longer than the matrix is wide count as boundary
in all their nodes, so width bounds memory and not the result. The one thing
held whole is a conversation: 24 bytes a turn in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_keys
from .common import parallelism, written

KEY = 16  # turns of the range key
CELLS = 1_000_000  # turns in a shard
WIDTH, MATRIX = 256, 32_000_000  # widest matrix, and most cells of one
MIN_HOT, HOT_SHARE = 50_000, 1000
NO_ENDS = hashlib.sha256().hexdigest()
_INNER, _BOUNDARY, _END = 0, 1, 2

_COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = pa.schema(
    [("kind", pa.int8()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64())]
    + [("parent_conv_id", pa.int64()), ("chars", pa.int64())]
    + [(c, pa.int64()) for c in _COUNTS]
    + [("ends_sha256", pa.string())]
)
_DDL = (
    "kind tinyint, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, chars bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as hashes with the text's length.

    Null turns come first; turns of one number are ordered by role and hash, so
    repeated rows stay and reruns agree. Rows without conv_id belong to no
    conversation. Texts are hashed before the shuffle and never sent.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("bigint").alias("n"),
    )
    kept = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    ordered = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).alias("turns"))


def with_shared_heads(rows: DataFrame, period: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % period; h = crc32(c) % heads."""
    head = rows.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, heads - 1).alias("__head"))
    base = F.col("conv_id") - F.col("conv_id") % period
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    given = F.coalesce(F.slice("__head", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.withColumn("__base", base).join(head, "__base", "left").select("conv_id", F.concat(given, own).alias("turns"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _node_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names of a row's beginnings: running sums over hashes of turn and place; (len + 1, 2)."""
    place = _mixed(np.arange(1, len(a) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = [np.cumsum(_mixed(v.view(np.uint64) + place), dtype=np.uint64) for v in (a, b)]
    return np.concatenate([np.zeros((1, 2), np.uint64), np.stack(sums, axis=1)])


def _joined(convs: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest()


class _Shard:
    """One range of conversations, sorted."""

    def __init__(self, convs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, chars: np.ndarray, key: int, width: int):
        rows, self.key = len(convs), key
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        ids = np.empty(len(a), np.int32)
        ids[order] = np.cumsum(new) - 1  # in the order of the hashes
        self.width = int(min(max(lengths.max(initial=0), 1), width, max(MATRIX // max(rows, 1), min(key, width))))
        matrix = np.full((rows, self.width), -1, np.int32)
        clipped = np.minimum(lengths, self.width)
        row = np.repeat(np.arange(rows), clipped)
        column = np.arange(len(row)) - np.repeat(np.cumsum(clipped) - clipped, clipped)
        matrix[row, column] = ids[starts[row] + column]
        order = np.lexsort((convs, lengths > self.width, *matrix.T[::-1]))
        self.matrix, self.convs = matrix[order], convs[order]
        self.starts, self.lengths = starts[order], lengths[order]
        self.a, self.b, self.chars = a, b, chars

    def names(self, row: int) -> np.ndarray:
        at = slice(self.starts[row], self.starts[row] + self.lengths[row])
        return _node_names(self.a[at], self.b[at])

    def parts(self) -> Iterator[pa.RecordBatch]:
        matrix, convs, rows = self.matrix, self.convs, len(self.convs)
        changed = np.ones((rows, self.width), bool)
        np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1, out=changed[1:])
        key = min(self.key, self.width)
        shared = np.max([np.logical_and.accumulate(matrix[:, :key] == matrix[end, :key], axis=1).sum(axis=1) for end in (0, -1)], axis=0)
        long = self.lengths > self.width

        # The nodes of every depth: where they start and what their rows give.
        levels: list[dict[str, np.ndarray]] = [self._level(np.array([0]), 0, shared, long)]
        for depth in range(1, self.width + 1):
            starts = np.nonzero(changed[:, depth - 1])[0]
            level = self._level(starts, depth, shared, long)
            real = matrix[starts, depth - 1] >= 0
            if not real.any():
                break
            levels.append({k: v[real] for k, v in level.items()})
        for level, below in zip(levels, levels[1:], strict=False):
            below["parent"] = np.searchsorted(level["start"], below["start"], "right") - 1
        levels[0]["parent"] = np.zeros(1, np.int64)

        # Sums of the subtrees, from the deepest level up, inner nodes only.
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            many = len(level["start"])
            children = leaves = saved = np.zeros(many, np.int64)
            if depth + 1 < len(levels):
                below = levels[depth + 1]
                inner = ~below["boundary"]
                at = below["parent"][inner]
                children, leaves, saved = np.bincount(at, minlength=many), np.zeros(many, np.int64), np.zeros(many, np.int64)
                np.add.at(leaves, at, below["leaves"][inner])
                np.add.at(saved, at, below["saved"][inner])
            inner = ~level["boundary"]
            level["children"] = children
            level["leaves"] = np.where(inner & (children == 0), 1, leaves)
            level["saved"] = saved + np.where(inner, (level["n"] - 1) * level["chars"], 0)
        for depth, level in enumerate(levels):
            yield from self._inner(depth, level, levels[depth - 1] if depth else None)
            yield from self._bounds(depth, level)
        yield from self._tails(long)

    def _level(self, starts: np.ndarray, depth: int, shared: np.ndarray, long: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.append(starts[1:], len(self.convs))
        real = (self.lengths[starts] >= depth) & (depth > 0)
        chars = np.zeros(len(starts), np.int64)
        chars[real] = self.chars[self.starts[starts[real]] + depth - 1]
        complete = self.lengths == depth
        return {
            "start": starts,
            "n": ends - starts,
            "conv": np.minimum.reduceat(self.convs, starts),
            "stop": starts + np.add.reduceat(complete.astype(np.int64), starts),  # complete rows stand first
            "chars": chars,
            "boundary": (shared[starts] >= min(depth, self.key)) | np.logical_or.reduceat(long, starts),
        }

    def _batch(self, kind: int, rows: int, **columns) -> pa.RecordBatch:
        arrays = {n: v if isinstance(v, pa.Array) else pa.array(v) for n, v in columns.items()}
        arrays["kind"] = pa.array([kind] * rows, pa.int8())
        return pa.RecordBatch.from_arrays(
            [arrays[f.name].cast(f.type) if f.name in arrays else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA
        )

    def _inner(self, depth: int, level: dict[str, np.ndarray], above: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        at = np.nonzero(~level["boundary"])[0]
        if not len(at) or above is None:
            return
        parent = level["parent"][at]
        hanging = above["boundary"][parent]
        names: list[bytes | None] = [None] * len(at)
        known: dict[int, bytes] = {}
        for i in np.nonzero(hanging)[0].tolist():
            p = int(parent[i])
            if p not in known:
                known[p] = self.names(int(above["start"][p]))[depth - 1].tobytes()
            names[i] = known[p]
        sha = [
            _joined(self.convs[s:e]) if e > s else NO_ENDS
            for s, e in zip(level["start"][at].tolist(), level["stop"][at].tolist(), strict=True)
        ]
        yield self._batch(
            _INNER, len(at), parent=pa.array(names, pa.binary()), conv_id=level["conv"][at], depth=np.full(len(at), depth),
            parent_conv_id=pa.array(above["conv"][parent], mask=hanging), n_convs=level["n"][at], n_children=level["children"][at],
            n_leaves=level["leaves"][at], saved_tokens=level["saved"][at], ends_sha256=pa.array(sha),
        )

    def _bounds(self, depth: int, level: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.nonzero(level["boundary"])[0]
        if not len(at):
            return
        named = [self.names(int(s)) for s in level["start"][at]]
        nodes = [n[depth].tobytes() for n in named]
        parents = [n[depth - 1].tobytes() if depth else None for n in named]
        yield self._batch(
            _BOUNDARY, len(at), node=pa.array(nodes, pa.binary()), parent=pa.array(parents, pa.binary()), conv_id=level["conv"][at],
            depth=np.full(len(at), depth), chars=level["chars"][at], n_convs=level["n"][at], n_children=level["children"][at],
            n_leaves=level["leaves"][at], saved_tokens=level["saved"][at],
        )
        for node, s, e in zip(nodes, level["start"][at].tolist(), level["stop"][at].tolist(), strict=True):
            if e > s:
                yield self._batch(_END, e - s, node=pa.array([node] * (e - s), pa.binary()), conv_id=self.convs[s:e])

    def _tails(self, long: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What lies deeper than the matrix, row by row: partial nodes of one member."""
        for row in np.nonzero(long)[0].tolist():
            names, first, end = self.names(row), self.width + 1, int(self.lengths[row])
            many = end - self.width
            zeros, conv = np.zeros(many, np.int64), np.full(many, self.convs[row])
            begin = int(self.starts[row]) + self.width
            yield self._batch(
                _BOUNDARY, many, node=pa.array([n.tobytes() for n in names[first:]], pa.binary()),
                parent=pa.array([n.tobytes() for n in names[first - 1 : -1]], pa.binary()), conv_id=conv, depth=np.arange(first, end + 1),
                chars=self.chars[begin : begin + many], n_convs=zeros + 1, n_children=zeros, n_leaves=zeros, saved_tokens=zeros,
            )
            yield self._batch(_END, 1, node=pa.array([names[-1].tobytes()], pa.binary()), conv_id=self.convs[row : row + 1])


def _sharded(key: int, width: int):
    return lambda batches: _shard(batches, key, width)


def _shard(batches: Iterator[pa.RecordBatch], key: int, width: int) -> Iterator[pa.RecordBatch]:
    filled = [b for b in batches if b.num_rows]
    if not filled:
        return
    table = pa.Table.from_batches(filled)
    turns = table.column("turns").combine_chunks()
    lengths = np.asarray(turns.value_lengths()).astype(np.int64)
    flat = turns.flatten()
    a, b, n = (np.asarray(flat.field(i)) for i in range(3))
    yield from _Shard(table.column("conv_id").to_numpy(), np.cumsum(lengths) - lengths, lengths, a, b, n, key, width).parts()


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of rows (node, conv_id) sorted by both; one hash is open at a time."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        nodes, convs = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        at = 0
        while at < len(nodes):
            stop = at + 1
            while stop < len(nodes) and nodes[stop] == nodes[at]:
                stop += 1
            text = ",".join(map(str, convs[at:stop])).encode()
            if nodes[at] == node:
                digest.update(b"," + text)
            else:
                if node is not None:
                    yield row()
                node, digest = nodes[at], hashlib.sha256(text)
            at = stop
    if node is not None:
        yield row()


def _hot(rows: int) -> int:
    return max(MIN_HOT, rows // HOT_SHARE)


def _add_up(nodes: DataFrame) -> DataFrame:
    """Sums of n_leaves and saved_tokens over subtrees of nodes(node, parent, depth, ...), looking twice as far down each round."""
    size, deepest = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    values = nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    for _ in range(int(deepest or 0).bit_length()):
        below = values.where("up is not null").groupBy(F.col("up").alias("node"))
        below = below.agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.count(F.lit(1)).alias("many"))
        added = written(
            values.join(below, "node", "left").select(
                "node", "up", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"), F.coalesce("many", F.lit(0)).alias("many"),
            ), "trie-sums",
        )
        further = added.where("many > 0").select(F.col("node").alias("up"), F.col("up").alias("further"), "many")
        values = join_hot_keys(added.drop("many"), further, "up", "many", _hot(size), "left").select(
            "node", F.col("further").alias("up"), "n_leaves", "saved_tokens"
        )
    return values.select("node", "n_leaves", "saved_tokens")


def _combined(parts: DataFrame) -> DataFrame:
    """The boundary nodes: partial sums added up, then the sums of their subtrees."""
    first = [F.first(c).alias(c) for c in ("parent", "depth", "chars")]
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    found = written(parts.where(F.col("kind") == _BOUNDARY).groupBy("node").agg(F.min("conv_id").alias("conv_id"), *first, *sums), "trie-bounds")
    below = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("bounds"))
    children = F.col("n_children") + F.coalesce("bounds", F.lit(0))
    own = (F.col("n_convs") - 1) * F.col("chars")
    nodes = written(
        found.join(below, "node", "left").select(
            "node", "parent", "conv_id", "depth", "n_convs", F.coalesce("bounds", F.lit(0)).alias("bounds"), F.col("n_children").alias("inner_children"),
            children.alias("n_children"), F.when(children == 0, 1).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
            (F.col("saved_tokens") + own).alias("saved_tokens"),
        ), "trie-nodes",
    )
    return nodes.drop("n_leaves", "saved_tokens").join(_add_up(nodes), "node")


def prefix_trie(rows: DataFrame, cells: int = CELLS, key: int = KEY, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of rows(conv_id, turns), turns as ``turn_rows`` gives them; conv_id is unique.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (over the subtree: members but one,
    times the characters of the node's last turn) and ends_sha256 (of the members that
    end here, ascending, comma-joined). The root has depth 0 and no parent; without
    rows there is no node. Equal sequences are different members of the same nodes.
    """
    rows = written(rows, "trie-rows")
    total = rows.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(parallelism(rows), -(-total // cells))
    beginning = F.transform(F.slice("turns", 1, key), lambda t: t["a"])
    ranged = rows.withColumn("__key", beginning).repartitionByRange(shards, "__key", "conv_id").drop("__key")
    parts = written(ranged.mapInArrow(_sharded(key, width), _DDL), "trie-parts")
    bounds = written(_combined(parts), "trie-combined")

    ends = parts.where(F.col("kind") == _END).select("node", "conv_id")
    hashed = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hashed_ends, "node binary, ends_sha256 string")
    size = parts.count()

    def under(children: DataFrame, weight: str) -> DataFrame:
        """Children with the smallest member of their parent, a boundary node."""
        above = bounds.where(F.col(weight) > 0).select(F.col("node").alias("parent"), F.col("conv_id").alias("of"), F.col(weight).alias("many"))
        return join_hot_keys(children, above, "parent", "many", _hot(size), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of"))

    columns = ["conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256"]
    inner = parts.where(F.col("kind") == _INNER)
    hanging = under(inner.where("parent is not null").select("parent", *columns), "inner_children")
    bound = under(bounds.withColumn("parent_conv_id", F.lit(None).cast("bigint")), "bounds").join(hashed, "node", "left")
    bound = bound.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return inner.where("parent is null").select(*columns).unionByName(hanging.select(*columns)).unionByName(bound.select(*columns))

