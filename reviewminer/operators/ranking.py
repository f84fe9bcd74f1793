"""Consecutive positions over a totally ordered table, without one big window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def with_positions(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Add the 0-based rank: range sort, then one offset per partition.

    The sorted rows are checkpointed, so row numbers and offsets come from the
    same evaluation. The running sum covers one row per partition only.
    """
    numbered = durable(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__id"), _ROW_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    row = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + row)
        .drop("__id", "__part", "__offset")
    )
