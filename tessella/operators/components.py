"""Connected components of an undirected graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut


def _mark(e: DataFrame) -> tuple:
    """The number of edges and two sums over their hashes: the same for the same edges."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each connected component; nodes without an edge do not appear.

    Alternating large-star and small-star steps: each node hangs itself, then its neighbours, below the smallest
    node it knows, until nothing changes. Degrees shrink as the stars collapse, every step is two shuffles, and each
    round is cut into the checkpoint folder. Null ends and loops are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = cut(small)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
