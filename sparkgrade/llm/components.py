"""Connected components by alternating stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b, of one orderable type); the root is the component's smallest node.

    Each round ends in a table in the shared folder, so lineage stays short, and the number of
    rounds grows with the logarithm of a component's size. Minima combine before a shuffle and
    the joins have one row for a node on one side, so a node with many neighbours splits.
    """
    now = written(_tidy(edges.select("a", "b")), "edges")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _tidy(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = written(_tidy(small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))), "edges")
        told = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        remove(now)
        now = after
        if told == state:
            break
        state = told
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.sparkgrade_path = now.sparkgrade_path  # for remove(), when nothing reads the groups any more
    return out


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
