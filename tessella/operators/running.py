"""Running sums and ranks over groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``keys`` that come before, in column ``out``.

    Rows are in order of ``chunk`` and then of ``order``; a chunk is a bounded stretch of a group. Sums per chunk are
    carried on over the few chunks of a group, and the sum within a chunk is a window of its own.
    """
    df = df.withColumn("_v", value.cast("long"))
    totals = df.groupBy(*keys, chunk).agg(F.sum("_v").alias("_t"))
    carried = totals.withColumn("_o", F.sum("_t").over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("_v").over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = df.withColumn("_w", within).join(carried.drop("_t"), [*keys, chunk])
    return both.withColumn(out, F.coalesce("_o", F.lit(0)) + F.coalesce("_w", F.lit(0))).drop("_v", "_w", "_o")
