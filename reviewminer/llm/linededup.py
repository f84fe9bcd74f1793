"""Repeated lines, found with levelled sorted runs of line hashes.

A run is a table sorted by hash: one row per key with the number of documents
that hold it and the largest of them. Every batch of documents is merged
against the runs on disk (anti join: which keys are new) and leaves a run of
its own; when a level holds ``fanout`` runs they are merged into one of the
next level. Counts and largest ids are mergeable, so the order of batches
does not matter.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased, as 128 bits. Null and empty texts are one empty line. Rows without
doc_id lose nothing and count for nothing; rows that share a doc_id are one
document. Empty tables give empty tables; further columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_hot_keys
from .common import SPACES, ascii_lower, enough_tasks, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]
_MIN_HOT = 20_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    """128 bits as a struct; the second hash starts from another seed."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Levelled runs (h1, h2, docs, keeper, fresh) below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        out = None
        for run in runs:
            out = run if out is None else out.unionByName(run)
        return out

    def _store(self, rows: DataFrame, level: int) -> DataFrame:
        run = written(rows.repartition(*HASH).sortWithinPartitions(*HASH), f"lines-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def add(self, hashed: DataFrame) -> DataFrame:
        """Add a batch hashed(doc_id, h1, h2), one row per document and key; its new keys come back."""
        own = hashed.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        known = self._all()
        if known is None:
            rows = own.withColumn("fresh", F.lit(True))
        else:
            own = written(own, "lines-batch")
            fresh = own.join(known.select(*HASH), HASH, "left_anti").withColumn("fresh", F.lit(True))
            rows = own.join(known.select(*HASH), HASH, "left_semi").withColumn("fresh", F.lit(False)).unionByName(fresh)
        run = self._store(rows, 0)
        self._compact()
        return run.where("fresh").select(*HASH)

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                merged = self.counts(self.levels[level])
                self.levels[level] = []
                self._store(merged, level + 1)

    def counts(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """(h1, h2, docs, keeper, fresh) over the given runs, or over all."""
        runs = [r for level in self.levels for r in level] if runs is None else runs
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy(*HASH).agg(
            F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh")
        )


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the keys of at least ``min_chars`` code points, once per document."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    hashes = F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), key_hash)
    rows = docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(hashes)).alias("h"))
    return rows.select("doc_id", "h.h1", "h.h2").distinct()


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """docs with ``text`` cleaned, and n_lines and n_dropped added.

    A key found in at least ``min_docs`` documents loses all its lines except
    in the largest doc_id that holds it; other lines stay in place.
    """
    spark = docs.sparkSession
    lines = hashed_lines(enough_tasks(docs.select("doc_id", "text")), min_chars)
    lines = written(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(spark)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).drop("batch"))
    repeated = runs.counts().where(F.col("docs") >= min_docs).select(F.struct(*HASH).alias("h"), "docs", "keeper")
    repeated = written(repeated, "repeated-lines")
    hot = max(_MIN_HOT, lines.count() // 1000)
    met = join_hot_keys(lines.select("doc_id", F.struct(*HASH).alias("h")), repeated, "h", "docs", hot)
    gone = met.where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("h").alias("__gone"))
    named = docs.withColumn("__lines", lines_of(F.col("text")))
    joined = named.join(gone, "doc_id", "left")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("__gone"), key_hash(key))

    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays))
    cleaned = joined.withColumn("__kept", kept)
    return cleaned.select(
        *[F.array_join("__kept", "\n").alias("text") if c == "text" else cleaned[c] for c in docs.columns],
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("bigint").alias("n_dropped"),
    )
