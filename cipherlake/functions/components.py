"""Connected components without a task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.storage import materialise

#: Links that a task of a round writes, at most about; a round never has more links than the one before.
LINKS = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (u, v)``: rows ``(node, component)``, the smallest node reachable.

    Alternating large-star and small-star contraction: every round is two
    aggregations with map-side combine and two joins that adaptive execution can
    split, so a hub with very many links is never gathered in one task. The
    rounds are logarithmic in the longest path. Nodes without links do not
    appear. Each round is written to the shared folder, in
    files of about ``LINKS`` links: a file for every shuffle partition would cost more than its links.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = materialise(both, "links"), None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = tuple(new)
        # large star: neighbours above a node move to the smallest of its neighbours and itself
        sym = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours below a node, and the node itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        now = materialise(small.coalesce(math.ceil(new[0] / LINKS)), "links")
