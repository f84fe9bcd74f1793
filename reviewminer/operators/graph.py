"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .skew import join_hot_keys

MIN_HOT = 50_000
HOT_SHARE = 1000  # vertices with more than 1/1000 of all edges are split
GATHERED = 200_000  # edges; up to so many, the neighbours of one vertex are a list in its row


def _link_to_minimum(arcs: DataFrame, hot: int) -> DataFrame:
    """(v, u, m): every arc u -> v with the smallest vertex around u."""
    around = arcs.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree")
    )
    return join_hot_keys(arcs, around, "u", "degree", hot)


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    """Hang every larger neighbour of a vertex on the smallest one around it."""
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _link_to_minimum(arcs, hot).where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    """Hang a vertex and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    linked = _link_to_minimum(down, hot)
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return linked.select(F.inline(ends)).where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _neighbours(edges: DataFrame) -> DataFrame:
    """(u, vs): every vertex with the set of its neighbours."""
    arcs = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return arcs.groupBy("u").agg(F.collect_set("v").alias("vs"))


def _gathered_stars(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex but the smallest hung on the smallest of its component.

    The same two steps on lists, with a shuffle each. All is done when every
    vertex has larger neighbours alone or one neighbour.
    """
    least = F.array_min("vs")
    around = durable(_neighbours(edges))
    while around.where((F.size("vs") > 1) & (least < F.col("u"))).limit(1).count():
        larger = F.filter("vs", lambda v: v > F.col("u"))
        hung = around.select(F.explode(larger).alias("u"), F.least(least, "u").alias("v"))
        below = hung.groupBy("u").agg(F.collect_set("v").alias("vs"))
        ends = F.transform(F.array_append("vs", F.col("u")), lambda v: F.struct(v.alias("u"), least.alias("v")))
        around = durable(_neighbours(below.select(F.inline(ends)).where("u <> v")))
    return around.where(least < F.col("u")).select("u", least.alias("v"))


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): label = smallest vertex reached over edges(src, dst).

    ``vertices(id)`` adds vertices without an edge as their own component. Each
    round is checkpointed; the number of rounds grows with the logarithm of the
    longest chain.
    """
    plain = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct()
    current = durable(plain)
    before = _signature(current)
    gathered = before[0] <= GATHERED
    if gathered:
        current = _gathered_stars(current)
    while before[0] and not gathered:
        hot = max(MIN_HOT, before[0] // HOT_SHARE)
        current = durable(_small_star(_large_star(current, hot), hot))
        after = _signature(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = members.unionByName(roots)
    if vertices is None:
        return found
    return vertices.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
