"""Counts, shares and orders of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numbers a book's name may hold, each in two forms.
BOOK_NUMBERS = (("一", "1"), ("二", "2"), ("三", "3"), ("四", "4"), ("五", "5"), ("六", "6"))


def conditional_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row: all rows, and those of each value, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def book_order(book: Column, unclassified: str = "未分类") -> list[Column]:
    """Order of books: compulsory before others, then by the smallest number in the name, then by name; unclassified ones last."""
    none = F.coalesce(book, F.lit("")).isin("", unclassified)
    held = [F.when(F.contains(book, F.lit(a)) | F.contains(book, F.lit(b)), F.lit(n)) for n, (a, b) in enumerate(BOOK_NUMBERS, 1)]
    kind = F.when(none, 99).when(F.contains(book, F.lit("必修")) & ~F.contains(book, F.lit("选")), 0).otherwise(1)
    return [kind, F.when(none, 99).otherwise(F.coalesce(F.least(*held), F.lit(99))), book]


def difficulty_shares(items: DataFrame, group: str, easy: tuple[str, ...] = ("easy", "normal"), hard: tuple[str, ...] = ("hard", "qiangji")) -> DataFrame:
    """(group, easy_pct, medium_pct, hard_pct): rounded shares, the last what is left of 100 and never below 0."""
    per = items.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("difficulty").isin(*easy), F.lit(False))).alias("e"), F.count_if(F.coalesce(F.col("difficulty").isin(*hard), F.lit(False))).alias("h")
    )
    pct = lambda x: F.floor(F.lit(100.0) * x / F.col("n") + 0.5).cast("long")
    per = per.select(group, pct(F.col("e")).alias("easy_pct"), pct(F.col("n") - F.col("e") - F.col("h")).alias("medium_pct"))
    return per.withColumn("hard_pct", F.greatest(F.lit(0), 100 - F.col("easy_pct") - F.col("medium_pct")).cast("long"))


def summed(df: DataFrame, counters: str) -> DataFrame:
    """(name, total): every counter of a map column added up over all rows."""
    return df.select(F.explode(counters).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("total"))


def different(column: str | Column, limit: int) -> Column:
    """An array with each value once, at its first place; more than ``limit`` values are an error."""
    once = F.array_distinct(column)
    return F.when(F.size(once) > limit, F.raise_error(F.concat(F.lit("too many values: "), F.size(once).cast("string")))).otherwise(once)


def refused_uploads(files: DataFrame, most: int = 20, total: int = 50 << 20) -> DataFrame:
    """(batch, problem) of uploads (batch, name, size) that break a rule: none or too many files, too large together, a base name twice in any case."""
    base = F.lower(F.regexp_extract(F.replace("name", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    per = files.groupBy("batch").agg(F.count("name").alias("n"), F.sum("size").alias("s"), F.count_distinct(base).alias("k"))
    found = F.array(F.when((F.col("n") < 1) | (F.col("n") > most), F.lit("count")), F.when(F.col("s") > total, F.lit("size")), F.when(F.col("k") < F.col("n"), F.lit("repeated name")))
    return per.select("batch", F.explode(F.array_compact(found)).alias("problem"))


def draft_order(drafts: DataFrame) -> DataFrame:
    """Drafts (id, updated_at in ms) with their place, newest first: by the time of change, else by the milliseconds in the id, then by id."""
    at = F.coalesce("updated_at", F.nullif(F.regexp_extract("id", r"^draft-(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return drafts.withColumn("at", at).orderBy(F.desc("at"), F.asc("id"))
