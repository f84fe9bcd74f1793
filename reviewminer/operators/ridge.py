"""Ridge regression on sparse counts by conjugate gradients, many models in one job.

Rows hold their cells (feature, count), features belong to a group, and every
group is a model of its own: the system is block-diagonal, and one step moves all
models. With standardised columns and a penalty scaled by the label's deviation the
system of a group of n rows is

    (C + reg / sigma * I) u = b,   C = Z'Z / n,   b = Z'(y - mean) / n,   coef = u / deviation

where Z holds the centred columns divided by their deviations. Z is never made:
C p needs the sums s of count * p / deviation over each row, and then the sums of
count * s over each feature; centring takes away products of means. So a step is two
passes over the cells. Up to ``DENSE`` features the rows are packed once into blocks of many, and the
direction is written as one row for each span of features, a span being whole groups. A task reads the
direction's rows beside its blocks, makes both passes in one and sends partial sums by feature; beyond, the cells
are joined with the direction and then with the row sums, and hot features are split. Coefficients, residuals and
directions are columns of the feature table; no table of features, rows or cells passes through the driver,
but for up to ``SMALL`` rows that are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .skew import join_hot_keys

SMALL = 250_000  # features, rows or groups that are broadcast; beyond, joins are shuffled and split hot keys
DENSE = 8_000_000  # features whose direction (8 bytes each) every task reads
SPAN = 262_144  # features after which a group begins a new span
BLOCK = 500_000  # cells of a block
MIN_HOT = 100_000
LOOK = 5  # steps between looks at the residuals
TOLERANCE = 1e-12  # of the residual's length, against that of the start

_EMPTY = 1e-12


def _sum(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


_COLUMNS = ["at", "tf", "held", "copies"]


def _packed(span_of: int):
    """Rows (span, cells, copies) to blocks: each cell's place in its span and count, each row's number of cells and copies."""

    def block(span: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        at, tf, held, copies = map(np.concatenate, zip(*parts, strict=True))
        narrow = tf.astype(np.float32)
        found = [at.astype(np.int32), narrow if (narrow == tf).all() else tf, held.astype(np.int32), copies.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([span], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in found)], names=["span", *_COLUMNS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            lists = batch.column("cells")
            cells = lists.flatten()
            pos, tf = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "tf"))
            held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            spans, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("span", "copies"))
            of = np.repeat(spans, held)
            for span in np.unique(spans[held > 0]).tolist():
                rows, mine = (spans == span) & (held > 0), of == span
                open_.setdefault(span, []).append((pos[mine] - span * span_of, tf[mine].astype(float), held[rows], copies[rows]))
                sizes[span] = sizes.get(span, 0) + int(mine.sum())
                if sizes[span] >= BLOCK:
                    yield block(span, open_.pop(span))
                    del sizes[span]
        for span, parts in open_.items():
            yield block(span, parts)

    return pack


def _direction(group: pa.Table) -> pa.Table:
    """A span's row: the direction by place."""
    at = group["at"].to_numpy()
    q = np.zeros(int(at.max()) + 1)
    q[at] = group["q"].to_numpy()
    return pa.table({"span": group["span"][:1], "q": [q.tobytes()]})


def _products(span_of: int):
    """(pos, t) of a task's blocks: for each feature the sum of count * s, where s sums count * q over a row and its copies."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                span = batch.column("span")[i].as_py()
                at, tf, held, copies, q = (batch.column(c)[i].as_buffer() for c in (*_COLUMNS, "q"))
                at, q, held, copies = (np.frombuffer(c, k) for c, k in ((at, np.int32), (q, float), (held, np.int32), (copies, np.int64)))
                tf = np.frombuffer(tf, np.dtype(f"f{len(tf) // len(at)}"))
                row = np.repeat(np.arange(len(held)), held)
                s = np.bincount(row, weights=tf * q[at], minlength=len(held)) * copies
                total, met = sums.setdefault(span, (np.zeros(len(q)), np.zeros(len(q), bool)))
                total += np.bincount(at, weights=tf * s[row], minlength=len(q))
                met[at] = True
        for span, (total, met) in sums.items():
            found = np.flatnonzero(met)
            for low in range(0, len(found), 100_000):
                some = found[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some + span * span_of), pa.array(total[some])], names=["pos", "t"])

    return add


class _Models:
    """The cells with the joins that the sizes of feature and group tables allow."""

    def __init__(self, rows: DataFrame, features: DataFrame, groups: DataFrame):
        self.rows = rows
        self.many_groups = groups.count() > SMALL
        self.many_rows = rows.count() > SMALL
        spans = groups.groupBy("span").agg(F.sum("size").alias("n"), (F.max("last") + 1 - F.col("span") * SPAN).alias("width"))
        found = spans.agg(_sum("n").alias("n"), _sum("width").alias("width")).first()
        self.many_features = found["n"] > DENSE or found["width"] > 2 * DENSE + SPAN
        self.hot = MIN_HOT
        if self.many_features or self.many_groups:
            self.hot = max(MIN_HOT, (features.agg(F.sum("held")).first()[0] or 0) // 1000)
        if not self.many_features:
            self.blocks = stored(self._spans(groups).mapInArrow(_packed(SPAN), "span long, at binary, tf binary, held binary, copies binary"), "ridge-blocks")
        self.read: list[DataFrame] = []  # written tables that the next step is the last to read

    def _spans(self, groups: DataFrame) -> DataFrame:
        copies = F.col("copies") if "copies" in self.rows.columns else F.lit(1).cast("bigint")
        rows = self.rows.select("grp", "cells", copies.alias("copies"))
        if self.many_groups:
            rows = join_hot_keys(rows, groups.select("grp", "span", "n"), "grp", "n", MIN_HOT)
        else:
            rows = rows.join(F.broadcast(groups.select("grp", "span")), "grp")
        return rows.select("span", "cells", "copies")

    def by_group(self, features: DataFrame, values: DataFrame) -> DataFrame:
        """Features with their group's row of ``values(grp, size, ...)``."""
        if self.many_groups:
            return join_hot_keys(features, values, "grp", "size", self.hot).drop("size")
        return features.join(F.broadcast(values.drop("size")), "grp")

    def along(self, features: DataFrame) -> DataFrame:
        """(pos, t): for each feature the sum of count * s, where s sums count * q over a row."""
        if not self.many_features:
            places = features.select("span", (F.col("pos") - F.col("span") * SPAN).alias("at"), "q")
            q = stored(places.groupBy("span").applyInArrow(_direction, "span long, q binary"), "ridge-direction")
            self.read.append(q)
            met = self.blocks.hint("shuffle_replicate_nl").join(q.coalesce(1), "span")  # a block's task reads the direction, at most ``DENSE`` numbers
            parts = met.select("span", *_COLUMNS, "q").mapInArrow(_products(SPAN), "pos bigint, t double")
            return parts.groupBy("pos").agg(F.sum("t").alias("t"))
        direction = features.select("pos", "held", "q")
        cells = self.rows.select("row", F.inline("cells"))
        met = join_hot_keys(cells, direction, "pos", "held", self.hot).drop("held")
        sums = met.groupBy("row").agg(F.sum(F.col("tf") * F.col("q")).alias("s"))
        met = self.rows.select("row", "cells").join(sums if self.many_rows else F.broadcast(sums), "row")
        return met.select("s", F.inline("cells")).groupBy("pos").agg(F.sum(F.col("tf") * F.col("s")).alias("t"))


def _start(models: _Models, features: DataFrame, groups: DataFrame, reg_param: float) -> DataFrame:
    """The features with mean, 1 / deviation, penalty and the first residual."""
    sums = models.rows.select("label", F.inline("cells")).groupBy("pos").agg(
        F.sum("tf").alias("x"), F.sum(F.col("tf") * F.col("tf")).alias("xx"), F.sum(F.col("tf") * F.col("label")).alias("xy")
    )
    spread = (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")) / F.col("n")
    about = groups.select("grp", "size", "n", "span", (F.col("sy") / F.col("n")).alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sigma"))
    joined = models.by_group(features.join(sums, "pos"), about)
    mu = F.col("x") / F.col("n")
    variance = (F.col("xx") - F.col("x") * mu) / F.col("n")
    fits = (variance > _EMPTY) & (F.col("sigma") > _EMPTY)
    inverse = F.when(fits, F.lit(1.0) / F.sqrt(variance)).otherwise(F.lit(0.0))
    start = (F.col("xy") / F.col("n") - mu * F.col("mean")) * F.col("inv")
    return (
        joined.withColumns({"mu": mu, "inv": inverse, "rho": F.when(fits, F.lit(reg_param) / F.col("sigma")).otherwise(F.lit(0.0))})
        .withColumn("r", start)
        .select("pos", "grp", "span", "held", "n", "mu", "inv", "rho", F.lit(0.0).alias("u"), "r", F.col("r").alias("p"))
    )


def _lengths(moved: DataFrame) -> DataFrame:
    """(grp, size, alpha, beta, rr): the step lengths, from one pass over the features.

    With a = C p + rho p without centring and c = mu / deviation, C p + rho p is a - m c,
    so all products the step needs are sums known before the step is taken.
    """
    a, c = F.col("t") / F.col("n") * F.col("inv") + F.col("rho") * F.col("p"), F.col("mu") * F.col("inv")
    q, r, p = F.col("q"), F.col("r"), F.col("p")
    products = {
        "m": F.col("mu") * q, "qt": q * F.col("t") / F.col("n"), "pp": F.col("rho") * p * p, "rr": r * r,
        "ra": r * a, "rc": r * c, "aa": a * a, "ac": a * c, "cc": c * c,
    }
    sums = moved.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), *(_sum(v).alias(k) for k, v in products.items()))
    m, curve = F.col("m"), F.col("qt") - F.col("m") * F.col("m") + F.col("pp")
    alpha = F.when((F.col("rr") > 0) & (curve > 0), F.col("rr") / curve).otherwise(F.lit(0.0))
    along, length = F.col("ra") - m * F.col("rc"), F.col("aa") - 2 * m * F.col("ac") + m * m * F.col("cc")
    after = F.greatest(F.col("rr") - 2 * F.col("alpha") * along + F.col("alpha") * F.col("alpha") * length, F.lit(0.0))
    return (
        sums.withColumn("alpha", alpha)
        .withColumn("after", after)
        .select("grp", "size", "m", "rr", "after", "alpha", F.when(F.col("rr") > 0, F.col("after") / F.col("rr")).otherwise(F.lit(0.0)).alias("beta"))
    )


def ridge(rows: DataFrame, features: DataFrame, reg_param: float, max_iter: int, tolerance: float = TOLERANCE) -> DataFrame:
    """(pos, coef) of the models label ~ counts, one per group, with intercepts.

    rows(row, grp, label, cells array<struct<pos, tf>>) and features(pos, grp, held), each
    feature in one group and ``held`` its number of rows. Rows that share a number must hold the same cells and
    say in ``copies`` how many there are. Steps end when every group's residual
    is ``tolerance`` times its first, or after ``max_iter``, which is exact (but for rounding) once
    there are as many as a group has features. Features or labels that do not vary get 0.0.
    """
    sizes = features.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.floor(F.min("pos") / SPAN).alias("span"), F.max("pos").alias("last"))
    groups = stored(
        rows.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), _sum("label").alias("sy"), _sum(F.col("label") * F.col("label")).alias("syy"))
        .join(sizes, "grp"),
        "ridge-groups",
    )
    models = _Models(rows, features, groups)
    state = stored(_start(models, features, groups, reg_param), "ridge-start")
    models.read.append(state)
    first = None
    for step in range(1, max_iter + 1):
        state = state.withColumn("q", F.col("p") * F.col("inv"))
        moved = stored(state.join(models.along(state), "pos", "left").withColumn("t", F.coalesce("t", F.lit(0.0))), "ridge-step")
        discard(moved, *models.read)
        models.read = [moved]
        lengths = _lengths(moved)
        if first is None:
            first = stored(lengths.select("grp", F.col("rr").alias("first")), "ridge-first")
        open_ = lengths.join(first, "grp").where(F.col("after") > F.lit(tolerance * tolerance) * F.col("first"))
        change = F.col("t") / F.col("n") * F.col("inv") + F.col("rho") * F.col("p") - F.col("m") * F.col("mu") * F.col("inv")
        state = (
            models.by_group(moved, lengths.select("grp", "size", "m", "alpha", "beta"))
            .withColumns({"u": F.col("u") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * change})
            .withColumn("p", F.col("r") + F.col("beta") * F.col("p"))
            .select("pos", "grp", "span", "held", "n", "mu", "inv", "rho", "u", "r", "p")
        )
        if step % LOOK == 0 and not open_.limit(1).count():
            break
    if not models.many_features:
        discard(state, models.blocks)
    return state.select("pos", (F.col("u") * F.col("inv")).alias("coef"))
