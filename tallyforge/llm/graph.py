"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node that has a link.

    `edges` has columns src and dst (long); direction, loops and repeats don't matter, links with a null end are left
    out. Returns node, component; nodes without a link to another node aren't in it. No neighbour list is gathered:
    each step takes minima, which combine before the shuffle, and joins that AQE may split at a hot node.
    """
    now, path = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("src"), F.col("m").alias("dst")).union(low.select("a", "m")).distinct()
        new, new_path = materialise(small, "cc")
        new_mark = _mark(new)
        remove(edges.sparkSession, path)
        now, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
