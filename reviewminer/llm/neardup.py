"""Near-duplicate groups over word shingles, by banded SetSketch registers.

Rows of ``docs(doc_id, text)`` with equal shingle sets are one class. Classes
that share a band of registers are candidates; within the connected candidates
pairs are estimated by likelihood and those that may reach the threshold are
confirmed on their full sets. A pair of similarity 0.75 shares no band with a
probability of 2e-5. Groups larger than a block are settled inside random
blocks first; then only classes that are not yet connected meet, all of them.

Null or white-space texts have an empty set and no links. Rows that repeat a
doc_id are one vertex. Rows without doc_id come back with a null component and
are kept. Any further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.skew import join_hot_keys
from . import setsketch
from .common import discard, enough_tasks, written
from .shingles import WordHashes, fingerprint, in_bunches, shingle_set

THRESHOLD = 75  # per cent
BLOCK = 512  # classes compared with each other in one piece
ROUNDS = 2  # of comparisons inside blocks, before blocks meet each other
_BUNCH = 1 << 15
_MIN_HOT = 5_000
_TEXTS = 256
_STRIP = 32  # classes whose likelihoods against a piece are computed together


def _sketch(with_sets: bool):
    kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("regs", pa.binary())]
    kinds += [("hashes", pa.binary())] * with_sets
    schema = pa.schema(kinds)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, factors = WordHashes(), setsketch.multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                sets = [shingle_set(t, known) for t in part.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                rows = (r.tobytes() for b in in_bunches(full, _BUNCH) for r in setsketch.registers(b, factors))
                columns = [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows) if len(s) else None for s in sets], pa.binary()),
                ]
                if with_sets:
                    columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return sketch


def _sketched(docs: DataFrame, with_sets: bool) -> DataFrame:
    schema = "doc_id bigint, n_shingles bigint, fp binary, regs binary" + ", hashes binary" * with_sets
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_sketch(with_sets), schema)


def _shared_bands(classes: DataFrame) -> DataFrame:
    """(src, dst): every class with the smallest one in each of its band buckets."""
    width = 2 * setsketch.BAND
    bands = F.sequence(F.lit(0), F.lit(setsketch.BANDS - 1))
    keys = F.transform(bands, lambda k: F.xxhash64(k, F.substring(F.col("regs"), k * width + 1, F.lit(width))))
    rows = classes.select("rep", F.explode(keys).alias("band"))
    buckets = rows.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = max(_MIN_HOT, classes.count() * setsketch.BANDS // 1000)
    met = join_hot_keys(rows, buckets, "band", "n", hot).where("rep <> first")
    return met.select(F.col("rep").alias("src"), F.col("first").alias("dst")).distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 columns, of shared hashes only."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)))
    step = 4096
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, (low, low + step))
        ones = np.zeros((len(sets), step), np.float32)
        ones[owner[a:b], place[a:b] - low] = 1.0
        total += ones @ ones.T
    return total


def _wanted(labels, blocks, sizes, regs, cross: bool, threshold: int) -> np.ndarray:
    """Pairs to be confirmed: of different labels and likely enough; in a meeting of two blocks, one of each."""
    wanted = np.triu(labels[:, None] != labels[None, :], 1) & ((blocks[:, None] != blocks[None, :]) | (not cross))
    for low in range(0, len(labels), _STRIP):
        rows = slice(low, low + _STRIP)
        if wanted[rows].any():
            counts = setsketch.compared(regs[rows], regs)
            wanted[rows] &= setsketch.may_reach(*counts, sizes[rows, None], sizes[None, :], threshold / 100)
    return wanted


def _links(ids, labels, blocks, sizes, regs, hashes, cross: bool, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among one piece of candidates."""
    if len(ids) < 2:
        return []
    wanted = _wanted(labels, blocks, sizes, regs, cross, threshold)
    used = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
    if not len(used):
        return []
    common = _overlaps([hashes[i] for i in used])
    n = sizes[used]
    linked = wanted[np.ix_(used, used)] & (100 * common >= threshold * (n[:, None] + n[None, :] - common))
    root = list(range(len(used)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((int(ids[used[i]]), int(ids[used[j]])))
    return forest


def _confirm(threshold: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def confirm(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("low", "ascending"), ("high", "ascending")])
        ids, sizes = table["rep"].to_numpy(), table["n_shingles"].to_numpy().astype(float)
        own, labels = table["block"].to_numpy(), table["label"].to_numpy()
        key = np.stack([table[c].to_numpy() for c in ("component", "low", "high")])
        regs, hashes = table["regs"].to_pylist(), table["hashes"].to_pylist()
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        found: list[tuple[int, int]] = []
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            rows = np.stack([np.frombuffer(r, "<u2") for r in regs[a:b]])
            sets = [np.frombuffer(h, np.uint64) for h in hashes[a:b]]
            cross = bool(key[1, a] != key[2, a])
            found += _links(ids[a:b], labels[a:b], own[a:b], sizes[a:b], rows, sets, cross, threshold)
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    return confirm


def _candidate_sets(docs: DataFrame, members: DataFrame, total: int) -> DataFrame:
    """(rep, n_shingles, regs, hashes, component, pieces) of members(rep, fp, component), written once."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    dealt = join_hot_keys(members, sizes, "component", "size", max(_MIN_HOT, total // 1000))
    pieces = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    wanted = dealt.select(F.col("rep").alias("doc_id"), F.col("fp").alias("own"), "component", pieces.alias("pieces"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = _sketched(texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), True)
    rows = found.join(wanted, "doc_id").where("fp = own").drop("own", "fp").withColumnRenamed("doc_id", "rep")
    return written(rows, "candidate-sets")


def _compared(rows: DataFrame, threshold: int, label: str) -> DataFrame:
    """(src, dst) for rows with ``block``, ``low`` and ``high`` (the two blocks that meet) and ``part`` (the task)."""
    columns = ["rep", "label", "n_shingles", "regs", "hashes", "component", "block", "low", "high", "part"]
    found = rows.select(*columns).groupBy("part").applyInArrow(_confirm(threshold), "src bigint, dst bigint")
    found = written(found, label)
    discard(rows)
    return found


def _inside_blocks(rows: DataFrame, seed: int, total: int, threshold: int) -> DataFrame:
    """Links inside one random dealing of every component into blocks; small components share a task."""
    block = F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("pieces")).cast("int")
    few = F.pmod(F.xxhash64("component"), F.lit(max(1, total // BLOCK)))
    part = F.when(F.col("pieces") > 1, F.xxhash64("component", "block")).otherwise(few)
    dealt = rows.withColumn("block", block).withColumn("low", F.col("block")).withColumn("high", F.col("block"))
    return _compared(dealt.withColumn("part", part), threshold, f"links-{seed}")


def _open(large: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """(rep, label, is_major, majors, minors) of the components that are not in one part yet.

    The label names the connected part; the largest part of a component is its
    major one. Only narrow rows are joined here.
    """
    labels = components(links).select(F.col("id").alias("rep"), F.col("component").alias("label"))
    state = large.select("rep", "component").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    state = written(state, "labels")
    parts = state.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    heads = parts.groupBy("component").agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")
    )
    heads = heads.where("parts > 1").select(
        "component", "size", F.col("most.label").alias("major"), F.col("most.n").alias("majors"),
        (F.col("size") - F.col("most.n")).alias("minors"),
    )
    met = join_hot_keys(state, heads, "component", "size", max(_MIN_HOT, total // 1000))
    return met.select("rep", "label", (F.col("label") == F.col("major")).alias("is_major"), "majors", "minors").distinct()


def _across_blocks(rows: DataFrame, threshold: int) -> DataFrame:
    """All links between the parts of a component: its minor parts meet each other and the major one.

    Blocks of minor parts come first in the numbering. A row of the major part
    goes to the minor blocks alone, so a component that is nearly in one part
    costs little more than its own rows.
    """
    minor = F.ceil(F.col("minors") / F.lit(BLOCK)).cast("int")
    major = F.ceil(F.col("majors") / F.lit(BLOCK)).cast("int")
    draw = F.xxhash64("rep", F.lit(0))
    block = F.when(F.col("is_major"), minor + F.pmod(draw, major)).otherwise(F.pmod(draw, minor)).cast("int")
    last = F.when(F.col("is_major"), minor - 1).otherwise(minor + major - 1)
    paired = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    paired = paired.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return _compared(paired.withColumn("part", F.xxhash64("component", "low", "high")), threshold, "links-across")


def _confirmed_links(docs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """(src, dst) links between classes; members(rep, fp, component) are the candidates.

    Each piece returns a forest of its links, so a dense group yields no more
    links than it has members.
    """
    total = members.count()
    sets = _candidate_sets(docs, members, total)
    links = _inside_blocks(sets.withColumn("label", F.col("rep")), 1, total, threshold)
    large = sets.where("pieces > 1")
    if not large.limit(1).count():
        discard(sets, sets)
        return links
    for seed in range(2, ROUNDS + 1):
        rest = large.join(_open(large, links, total), "rep")
        links = links.unionByName(_inside_blocks(rest, seed, total, threshold))
    links = links.unionByName(_across_blocks(large.join(_open(large, links, total), "rep"), threshold))
    discard(sets, sets)
    return links


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    sketches = written(_sketched(enough_tasks(docs.select("doc_id", "text")), False), "sketches")
    named = sketches.where("fp is not null and doc_id is not null")
    groups = named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    hot = max(_MIN_HOT, sketches.count() // 1000)
    classes = written(join_hot_keys(named, groups, "fp", "n", hot).select("doc_id", "rep", "fp", "regs"), "classes")
    firsts = classes.where("doc_id = rep")
    candidates = components(_shared_bands(firsts))
    members = written(
        firsts.select("rep", "fp").join(candidates.withColumnRenamed("id", "rep"), "rep"), "candidates"
    )
    discard(docs)
    links = _confirmed_links(docs, members, threshold)
    copies = classes.where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    reached = components(links.unionByName(copies)).withColumnRenamed("id", "doc_id")
    component = F.coalesce("component", "doc_id")
    return sketches.select("doc_id", "n_shingles").join(reached, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (component.isNull() | (component == F.col("doc_id"))).alias("kept"),
    )
