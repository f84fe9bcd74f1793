"""URL verdicts from rules and, where none fits, from a tree of path templates.

Pages that a rule decides are the labelled ones. Per host and number of path
segments, a segment that is no number and frequent at its place is a branch of
its own; all others are wildcards. Branches of one host and shape whose
labelled shares do not differ significantly from the shape's are merged; a
branch without labels is like no other and keeps the prior alone.
A template is rejected if its smoothed share of blocked labels is high.

A null url, or one without ``://``, has an empty host and path and is allowed.
Repeated rows are judged alike; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_keys
from .common import ascii_lower, written

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BRANCH_SHARE = 0.05  # of the rows at a place, for a segment to be a branch
BRANCH_ROWS = 3
Z = 1.96
PRIOR, STRENGTH = 0.1, 4.0
PURITY = 0.7
_MIN_HOT = 5_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without a scheme's end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _keyed(*parts: str) -> Column:
    return F.concat_ws("\x00", *parts)


def _branches(rows: DataFrame) -> DataFrame:
    """(tree, rows_in, branches): per host and shape, the frequent segments as ``place:segment``."""
    places = rows.select("tree", F.posexplode("segments").alias("place", "segment"))
    counts = places.groupBy("tree", "place", "segment").agg(F.count(F.lit(1)).alias("n"))
    sums = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("rows_in"))
    often = counts.where((F.col("n") >= BRANCH_ROWS) & ~F.col("segment").rlike(r"^[0-9]+(\.[a-z]+)?$"))
    often = often.join(sums, "tree").where(F.col("n") >= BRANCH_SHARE * F.col("rows_in"))
    listed = often.groupBy("tree").agg(F.collect_list(F.concat_ws(":", "place", "segment")).alias("branches"))
    return sums.join(listed, "tree", "left").withColumn("branches", F.coalesce("branches", F.array().cast("array<string>")))


def template_verdicts(stats: DataFrame) -> DataFrame:
    """stats(tree, template, n, labelled, bad) with ``rejected``."""
    share = F.try_divide(F.col("bad"), F.col("labelled"))
    pooled = stats.groupBy("tree").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    mean = F.try_divide(F.col("all_bad"), F.col("all_labelled"))
    apart = F.abs(share - mean) > Z * F.sqrt(F.try_divide(mean * (1 - mean), F.col("labelled"))) + 1e-9
    judged = stats.join(pooled, "tree").withColumn("apart", (F.col("labelled") == 0) | F.coalesce(apart, F.lit(False)))
    together = judged.where("not apart").groupBy("tree").agg(
        F.sum("labelled").alias("near_labelled"), F.sum("bad").alias("near_bad")
    )
    both = judged.join(together, "tree", "left")
    bad = F.when(F.col("apart"), F.col("bad")).otherwise(F.col("near_bad"))
    labelled = F.when(F.col("apart"), F.col("labelled")).otherwise(F.col("near_labelled"))
    purity = (bad + PRIOR * STRENGTH) / (labelled + STRENGTH)
    return both.select("key", "n", (purity >= PURITY).alias("rejected"))


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for pages(page_id, url)."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("segments", F.split(F.regexp_replace("path", "^/", ""), "/", -1))
    shape = F.size("segments").cast("string")
    rows = written(rows.withColumn("tree", F.concat_ws("\x00", "host", shape)), "urls")
    hot = max(_MIN_HOT, rows.count() // 1000)
    branches = written(_branches(rows), "url-branches")
    met = join_hot_keys(rows, branches, "tree", "rows_in", hot)
    place = F.transform(
        "segments",
        lambda s, i: F.when(F.array_contains("branches", F.concat_ws(":", i.cast("string"), s)), s).otherwise("*"),
    )
    met = met.withColumn("template", F.array_join(place, "/")).drop("branches", "rows_in", "segments")
    met = written(met.withColumn("key", _keyed("tree", "template")), "url-templates")
    stats = met.groupBy("tree", "template", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count("found").alias("labelled"),
        F.count_if(F.col("found.verdict") == "block").alias("bad"),
    )
    final = join_hot_keys(met, template_verdicts(stats), "key", "n", hot)
    own = F.when(F.col("rejected") & (F.col("host") != ""), "block").otherwise("allow")
    return final.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"), "template",
    )
