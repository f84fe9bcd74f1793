"""Bag-of-words rating regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wordlists import STOPWORDS
from ..session import discard, fresh_path, stored
from .ranking import with_positions
from .ridge import BLOCK, SPAN, ridge
from .ridge import SMALL as FEW
from .skew import join_hot_keys
from .tokens import _histogram, word_lists

# Frequency cut, iterations and penalty of the word model.
MIN_COUNT = 10
MAX_ITER = 10
REG_PARAM = 0.01

SMALL = 4_000_000  # words that every task reads beside its lists; longer vocabularies are joined, and hot words split

_MIN_HOT = 20_000


def vocabulary(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, pos): frequent words, most frequent first, ties by word."""
    return with_positions(counts.where(F.col("n") >= min_count), F.desc("n"), "word")


def _sparse(rows: DataFrame, size: int, cells: Column) -> DataFrame:
    """Add ``features``: the stored form of a sparse vector, written and read back as one."""
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(cells, lambda c: c["pos"].cast("int")).alias("indices"), F.transform(cells, lambda c: c["tf"].cast("double")).alias("values"),
    )
    path = fresh_path(rows.sparkSession, "sparse-rows")
    rows.withColumn("features", parts).write.parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def bow_vectors(
    reviews: DataFrame, vocab: DataFrame, stopwords: Iterable[str] = STOPWORDS, keep: Iterable[str] = ()
) -> DataFrame:
    """(review_id, *keep, features): word counts per review as sparse vectors, one row per review.

    Words get their positions by a join that splits frequent ones; the
    vocabulary stays a table.
    """
    lists = word_lists(reviews, stopwords, keep).withColumn("words", _histogram(F.col("words")))
    lists = stored(lists.withColumn("__row", F.monotonically_increasing_id()), "word-lists")
    found = vocab.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    hot = max(_MIN_HOT, found["total"] // 1000)
    counts = lists.select("__row", F.inline("words")).withColumnRenamed("term", "word")
    placed = join_hot_keys(counts, vocab.select("word", "n", "pos"), "word", "n", hot)
    cells = placed.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "tf"))).alias("cells"))
    rows = lists.drop("words").join(cells, "__row", "left")
    none = F.array().cast("array<struct<pos:bigint,tf:bigint>>")
    return _sparse(rows.withColumn("cells", F.coalesce("cells", none)), found["size"], F.col("cells")).select("review_id", *keep, "features")


def fit(points: DataFrame, max_iter: int = MAX_ITER, reg_param: float = REG_PARAM) -> LinearRegressionModel:
    """Ridge regression of (label, features) points whose coefficients fit the driver; small ones are solved directly."""
    return LinearRegression(maxIter=max_iter, regParam=reg_param).fit(points)


def bow_points(
    reviews: DataFrame, vocab: DataFrame, rated: DataFrame | None, default: float, stopwords: Iterable[str] = STOPWORDS
) -> DataFrame:
    """(label, features), one point per review with a text, also where ids repeat."""
    if rated is None:
        rows = bow_vectors(reviews, vocab, stopwords, ["overall"])
    else:
        rows = bow_vectors(reviews, vocab, stopwords).join(rated, "review_id", "left")
    return rows.select(F.coalesce(F.col("overall").cast("double"), F.lit(default)).alias("label"), "features")


def _labelled(lists: DataFrame, rated: DataFrame | None, default: float) -> DataFrame:
    """(row, grp, label, copies) of every list, once for each of its ``copies`` ratings; ratings meet narrow rows."""
    if rated is None:
        rows = lists.select("row", "grp", "overall", F.lit(1).cast("bigint").alias("copies"))
    else:
        many = F.count(F.lit(1)).over(Window.partitionBy("review_id"))
        given = rated.where("review_id is not null").select("review_id", "overall", many.alias("copies"))
        rows = lists.select("row", "grp", "review_id").join(given, "review_id", "left")
    label = F.coalesce(F.col("overall").cast("double"), F.lit(default))
    return rows.select("row", "grp", label.alias("label"), F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))


_LISTS = ["rows", "lows", "held", "ends", "terms", "tf"]


def _bytes(column: np.ndarray) -> pa.Array:
    return pa.array([column.tobytes()], pa.binary())


def _texts(terms: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ends and bytes of strings, each as one value."""
    lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    return _bytes(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.array([b"".join(terms.cast(pa.large_binary()).to_pylist())], pa.binary())


def _strings(ends: pa.Buffer, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), ends.size // 8 - 1, [None, ends, data])


def _in_group(lows: pa.Array, terms: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(lows.cast(pa.large_string()), terms.cast(pa.large_string()), pa.scalar("\x00", pa.large_string()))


def _many_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (row, span, low, words) to blocks of one span."""

    def block(span: int, parts: list[tuple]) -> pa.RecordBatch:
        rows, lows, held, terms, tf = zip(*parts, strict=True)
        columns = [*(_bytes(np.concatenate(c)) for c in (rows, lows, held)), *_texts(pa.concat_arrays(terms)), _bytes(np.concatenate(tf))]
        return pa.RecordBatch.from_arrays([pa.array([span], pa.int64()), *columns], names=["span", *_LISTS])

    open_: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        lists = batch.column("words")
        words = lists.flatten()
        held = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        rows, spans, lows = (batch.column(c).to_numpy() for c in ("row", "span", "low"))
        of = np.repeat(spans, held)
        for span in np.unique(spans).tolist():
            mine, cells = spans == span, words.filter(pa.array(of == span))
            open_.setdefault(span, []).append((rows[mine], lows[mine], held[mine], cells.field("term"), cells.field("tf").to_numpy()))
            sizes[span] = sizes.get(span, 0) + len(cells)
            if sizes[span] >= BLOCK:
                yield block(span, open_.pop(span))
                del sizes[span]
    for span, parts in open_.items():
        yield block(span, parts)


def _vocabulary_row(group: pa.Table) -> pa.Table:
    """A span's row: its words, each behind its group's first position, and their positions."""
    group = group.combine_chunks()
    word = _in_group(group["low"].chunk(0), group["word"].chunk(0))
    ends, data = _texts(word)
    return pa.table({"span": group["span"][:1], "word_ends": ends, "word_bytes": data, "pos": _bytes(group["pos"].to_numpy())})


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, cells) of the lists of each block with its span's words."""
    for batch in batches:
        for i in range(batch.num_rows):
            value = {c: batch.column(c)[i].as_buffer() for c in (*_LISTS, "word_ends", "word_bytes", "pos")}
            rows, lows, tf, known = (np.frombuffer(value[c], np.int64) for c in ("rows", "lows", "tf", "pos"))
            held = np.frombuffer(value["held"], np.int32)
            of = np.repeat(np.arange(len(rows)), held)
            terms = _in_group(pa.array(lows[of]), _strings(value["ends"], value["terms"]))
            found = pc.index_in(terms, value_set=_strings(value["word_ends"], value["word_bytes"])).fill_null(-1).to_numpy()
            met = found >= 0
            counts = np.bincount(of[met], minlength=len(rows))
            cells = pa.StructArray.from_arrays([pa.array(known[found[met]]), pa.array(tf[met])], names=["pos", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), cells)
            yield pa.RecordBatch.from_arrays([pa.array(rows), lists], names=["row", "cells"]).filter(pa.array(counts > 0))


def _placed(lists: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row, cells): the words of every list as (pos, tf), words outside the vocabulary left out.

    Up to ``SMALL`` words the vocabulary is written as one row for each span of
    whole groups, and lists, many to a block, are looked up by the tasks that hold them.
    """
    if vocab.limit(SMALL + 1).count() > SMALL:
        words = lists.select("row", F.col("grp"), F.inline("words"))
        key = F.struct(F.col("grp"), F.col("term"))
        known = vocab.select(F.struct(F.col("grp"), F.col("word").alias("term")).alias("key"), "held", "pos")
        words = words.select("row", "tf", key.alias("key"))
        total = vocab.agg(F.sum("held")).first()[0]
        met = join_hot_keys(words, known, "key", "held", max(_MIN_HOT, total // 1000))
        return met.groupBy("row").agg(F.collect_list(F.struct("pos", "tf")).alias("cells"))
    sizes = lists.groupBy("grp").agg(F.count(F.lit(1)).alias("lists"))
    groups = vocab.groupBy("grp").agg(F.min("pos").alias("low"), F.count(F.lit(1)).alias("size")).withColumn("span", F.floor(F.col("low") / SPAN))
    groups = stored(groups.join(sizes, "grp"), "word-groups")
    some = lists.where(F.size("words") > 0).select("row", "grp", "words")
    if groups.limit(FEW + 1).count() > FEW:
        some = join_hot_keys(some, groups.select("grp", "low", "span", "lists"), "grp", "lists", _MIN_HOT)
        words = join_hot_keys(vocab.select("grp", "word", "pos"), groups.select("grp", "low", "span", "size"), "grp", "size", _MIN_HOT)
    else:
        some = some.join(F.broadcast(groups.select("grp", "low", "span")), "grp")
        words = vocab.select("grp", "word", "pos").join(F.broadcast(groups.select("grp", "low", "span")), "grp")
    spans = stored(
        words.select("span", "low", "word", "pos").groupBy("span")
        .applyInArrow(_vocabulary_row, "span long, word_ends binary, word_bytes binary, pos binary"), "vocabulary-spans",
    )
    blocks = some.select("row", "span", "low", "words").mapInArrow(_many_lists, "span long, " + ", ".join(f"{c} binary" for c in _LISTS))
    met = blocks.hint("shuffle_replicate_nl").join(spans.coalesce(1), "span")
    columns = met.select("span", *_LISTS, "word_ends", "word_bytes", "pos")
    return columns.mapInArrow(_looked_up, "row long, cells array<struct<pos: long, tf: long>>")


def bow_models(
    reviews: DataFrame,
    column: str | None = None,
    rated: DataFrame | None = None,
    default: float = 3.0,
    *,
    min_count: int = MIN_COUNT,
    stopwords: Iterable[str] = STOPWORDS,
    max_iter: int = MAX_ITER,
    reg_param: float = REG_PARAM,
) -> DataFrame:
    """(group, word, n, coef): one model rating ~ word counts for each value of ``column`` (or one in all), in one job.

    Each group has its own vocabulary. Ratings come with the reviews (``overall``)
    or as ``rated(review_id, overall)``, one row per id; others get ``default``. Every review with a
    text is a row, also one without known words, and null is a group like others.
    Texts are tokenised once; words, vocabularies and coefficients stay tables.
    """
    keep = [c for c in (column, None if rated is not None else "overall") if c]
    lists = word_lists(reviews, stopwords, keep).withColumn("words", _histogram(F.col("words")))
    group = F.struct((F.col(column) if column else F.lit(0)).alias("value"))
    lists = stored(lists.withColumns({"row": F.monotonically_increasing_id(), "grp": group}), "word-lists")
    counts = lists.select("grp", F.inline("words")).groupBy("grp", F.col("term").alias("word"))
    counts = counts.agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("held")).where(F.col("n") >= min_count)
    vocab = stored(with_positions(counts, "grp", F.desc("n"), "word"), "vocabulary")
    discard(vocab)
    none = F.array().cast("array<struct<pos:bigint,tf:bigint>>")
    rows = _labelled(lists, rated, default).join(_placed(lists, vocab), "row", "left")
    rows = stored(rows.withColumn("cells", F.coalesce("cells", none)), "bow-rows")
    discard(rows, lists)
    found = ridge(rows, vocab.select("pos", "grp", "held"), reg_param, max_iter)
    return vocab.join(found, "pos").select(F.col("grp.value").alias("group"), "word", "n", "coef")


def bow_regression(reviews: DataFrame, rated: DataFrame | None = None, default: float = 3.0, **options) -> DataFrame:
    """(word, n, coef) of one model rating ~ word counts over all reviews; options as for ``bow_models``."""
    return bow_models(reviews, None, rated, default, **options).select("word", "n", "coef")


def bow_regression_by(reviews: DataFrame, column: str, **options) -> dict[str, DataFrame]:
    """The models of ``bow_models`` by group, for few groups: their names, and nothing else, come to the driver."""
    models = stored(bow_models(reviews, column, **options), "bow-models")
    names = [row[0] for row in models.select("group").distinct().orderBy("group").collect()]
    return {g: models.where(F.col("group").eqNullSafe(F.lit(g))).select("word", "n", "coef") for g in names}
