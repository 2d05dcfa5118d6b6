"""Pairs within groups, and semi and anti joins against small sides, without hot tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A counted side of up to so many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def pairs_within(members: DataFrame, group: str, key: str, carry: tuple[str, ...] = (), where: Column | None = None, block: int = 512) -> DataFrame:
    """Pairs ``key_a < key_b`` of rows that share ``group``, as columns ``*_a`` and ``*_b``.

    A group of n rows is laid out in ceil(n / block) blocks; each pair of blocks is a join key of its own, so a hot
    group is spread over many tasks, and a pair is met in exactly one of them. ``where`` is a condition over
    the ``*_a`` and ``*_b`` columns. Null groups give no pair.
    """
    members = members.select(group, key, *carry).filter(F.col(group).isNotNull())
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    laid = (
        members.join(sizes, group)
        .withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
        .withColumn("_b", F.pmod(F.xxhash64(key), F.col("_nb")).cast("int"))
    )
    last = F.col("_nb") - 1
    left = laid.select(group, F.col("_b").alias("_i"), F.explode(F.sequence("_b", last)).alias("_j"), *[F.col(c).alias(f"{c}_a") for c in (key, *carry)])
    right = laid.select(group, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), *[F.col(c).alias(f"{c}_b") for c in (key, *carry)])
    met = left.join(right, [group, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col(f"{key}_a") < F.col(f"{key}_b")))
    if where is not None:
        met = met.filter(where)
    swap = F.col(f"{key}_a") > F.col(f"{key}_b")
    out = []
    for c in (key, *carry):
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        out += [F.when(swap, b).otherwise(a).alias(f"{c}_a"), F.when(swap, a).otherwise(b).alias(f"{c}_b")]
    return met.filter(F.col(f"{key}_a") != F.col(f"{key}_b")).select(group, *out)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes stay within the limit, else left to a shuffle join.

    Measuring is a job of its own, so ``df`` should be a stored result; its columns are scalars.
    """
    texts = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    row = F.lit(16 + 8 * len(df.columns)).cast("long")
    for size in texts:
        row = row + F.coalesce(size, F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def looked_up(left: DataFrame, right: DataFrame, on: list[str], key: str, limit: int = BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``on`` is unique, without a hot task.

    Within the limit ``right`` is broadcast; beyond it the rows of a hot value are dealt out by the hash of ``key`` and meet a copy
    of their row of ``right`` each.
    """
    side = small_side(right, limit)
    if side is not right:
        return left.join(side, on)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def expanded(links: DataFrame, classes: DataFrame, copies: DataFrame, block: int = 512) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each link (a, b) between representatives as the pairs of the rows they stand for.

    ``classes`` has (rep, n) of the representatives of n > 1 rows and ``copies`` (rep, n, id) of these rows, the representative
    included. A class of n rows is laid out in ceil(n / block) blocks, so a hot class is spread over as many join keys.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = copies.select("rep", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id")
    links = links.select("a", "b")
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("rep").alias(side), blocks.alias(f"n{side}")), side, "left")
    alone = links.filter("na is null and nb is null").select("a", "b")
    spread = links.filter("na is not null or nb is not null")
    for side in ("a", "b"):
        own = members.select(F.col("rep").alias(side), F.col("block").alias(f"block_{side}"), F.col("id").alias(f"m{side}"))
        spread = spread.withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"n{side}", F.lit(1)) - 1)))
        spread = spread.join(own, [side, f"block_{side}"], "left")
    between = spread.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b")).unionByName(alone)
    return between.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
