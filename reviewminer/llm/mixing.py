"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to. Word capacity flows from patterns to source quotas; the k-th copy of a
pattern's words costs k - 1, so the cost is convex and first copies are used
up before any is repeated. Sources that share no pattern do not meet: every
connected part of the network is solved by itself, in a task. The flow of a
pattern is then spent on its documents in a seeded order; reruns agree.

Null texts have no words. A null source is a source like any other and comes
last. Repeated rows are documents of their own. Sources without words have the
target 0. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.ranking import with_positions
from .common import enough_tasks, written

WEIGHTS = (1, 2, 3)
COPIES = 3
SEED = 11
BUCKETS = 4096
_WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, copies: int = COPIES) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size, weight).

    All words are shared by weight; what lies above ``copies`` times a source
    is shared again among the others, until nothing does.
    """
    cap = F.col("source_size") * copies
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        row = sizes.agg(
            F.sum(F.when(above, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("int")).alias("n"),
        ).first()
        if not row["open"] or row["n"] == full:
            break
        full, level = row["n"], (total - row["capped"]) / row["open"]
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def cheapest_flow(capacity: list[int], quota: list[int], members: list[list[int]], copies: int) -> list[list[int]]:
    """flow[pattern][k]: words from a pattern to its k-th source, at least cost.

    All costs sit on the patterns' own arcs and are the same for every
    pattern's k-th copy, so shortest augmenting paths come tier by tier: all
    that use one copy, then two, and so on.
    """
    flow = [[0] * len(m) for m in members]
    touching: list[list[tuple[int, int]]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for k, s in enumerate(m):
            touching[s].append((p, k))
    used, left = [0] * len(capacity), list(quota)
    for tier in range(1, copies + 1):
        while True:
            came: dict = {("p", p): None for p in range(len(capacity)) if used[p] < tier * capacity[p]}
            queue, end = deque(came), None
            while queue and end is None:
                kind, node = queue.popleft()
                if kind == "p":
                    for k, s in enumerate(members[node]):
                        if ("s", s) not in came:
                            came["s", s] = (node, k, 1)
                            if left[s] > 0:
                                end = s
                                break
                            queue.append(("s", s))
                else:
                    for p, k in touching[node]:
                        if flow[p][k] > 0 and ("p", p) not in came:
                            came["p", p] = (node, p, k)
                            queue.append(("p", p))
            if end is None:
                break
            path, node = [], ("s", end)
            while came[node] is not None:
                step = came[node]
                if node[0] == "s":
                    path.append((step[0], step[1], 1))
                    node = ("p", step[0])
                else:
                    path.append((step[1], step[2], -1))
                    node = ("s", step[0])
            amount = min([left[end], tier * capacity[node[1]] - used[node[1]], *(flow[p][k] for p, k, d in path if d < 0)])
            for p, k, d in path:
                flow[p][k] += d * amount
            used[node[1]] += amount
            left[end] -= amount
    return flow


def _solve(copies: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        """One connected part: rows (pattern, words, source, quota)."""
        patterns, sources = list(dict.fromkeys(rows["pattern"])), list(dict.fromkeys(rows["source"]))
        at, of = {p: i for i, p in enumerate(patterns)}, {s: i for i, s in enumerate(sources)}
        capacity, quota, members = [0] * len(patterns), [0] * len(sources), [[] for _ in patterns]
        for p, words, s, q in rows[["pattern", "words", "source", "quota"]].itertuples(index=False):
            capacity[at[p]], quota[of[s]] = int(words), int(q)
            members[at[p]].append(of[s])
        flow = cheapest_flow(capacity, quota, members, copies)
        return pd.DataFrame({"pattern": patterns, "routed": [sum(f) for f in flow]})

    return solve


def mixed(docs: DataFrame, source: str = "source", copies: int = COPIES, seed: int = SEED, keep: Iterable[str] = ()) -> DataFrame:
    """(doc_id, sources, size, source_size, target, taken) for docs(doc_id, text, source).

    ``source`` names a string column or an array of strings for documents of
    several sources; source_size and target are those of the first. The columns
    ``keep`` come along at the end.
    """
    own = F.col(source) if dict(docs.dtypes)[source].startswith("array") else F.array(source)
    mine = F.col("__own")
    known = F.array_sort(F.array_distinct(F.transform(mine, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~")))))
    rows = written(
        enough_tasks(docs.select("doc_id", "text", own.alias("__own"), *keep)).select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.regexp_count("text", F.lit(_WORDS)).cast("bigint").alias("n"),
            F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("~"))).alias("sources"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), *keep,
        ).select(
            "doc_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("size"), "sources",
            F.concat_ws("\x00", "sources").alias("pattern"), "draw", *keep,
        ), "words",
    )
    patterns = written(rows.groupBy("pattern", "sources").agg(F.sum("size").alias("words")), "patterns")
    arcs = patterns.select("pattern", "words", F.explode("sources").alias("source"))
    sizes = arcs.groupBy("source").agg(F.sum("words").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("pos") % len(WEIGHTS) + 1).cast("int"))
    sizes = written(with_positions(sizes, "source").withColumn("weight", weight), "sources")
    targets = written(source_targets(sizes, copies).drop("pos", "weight"), "targets")
    ids = F.xxhash64("source")
    first = F.xxhash64(F.col("sources")[0])
    edges = patterns.where(F.size("sources") > 1).select(first.alias("src"), F.explode(F.transform("sources", lambda s: F.xxhash64(s))).alias("dst"))
    parts = components(edges)
    network = arcs.join(targets.select("source", F.round("target").cast("bigint").alias("quota")), "source")
    network = network.withColumn("id", ids).join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    routed = network.select("part", "pattern", "words", "source", "quota").groupBy("part").applyInPandas(
        _solve(copies), "pattern string, routed bigint"
    )
    plan = patterns.join(routed, "pattern").select(
        "pattern", "words", F.col("sources")[0].alias("source"),
        F.coalesce(F.floor(F.try_divide(F.col("routed"), F.col("words"))), F.lit(0)).cast("bigint").alias("whole"),
        "routed",
    )
    plan = written(plan.withColumn("rest", F.col("routed") - F.col("whole") * F.col("words")).join(targets, "source"), "plan")
    bucket = F.pmod("draw", F.lit(BUCKETS)).cast("int")
    summed = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = summed.select("pattern", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("pattern", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # the join is on (pattern, bucket), as the window before it, so no pattern comes to one task
    full = placed.join(starts.join(plan.drop("words"), "pattern"), ["pattern", "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("begin") - F.col("inside")))
    return full.select(
        "doc_id", F.transform("sources", lambda s: F.when(s != "~", F.substring(s, 2, 1 << 30))).alias("sources"), "size",
        "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("bigint").alias("taken"), *keep,
    )
