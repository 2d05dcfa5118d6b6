"""Papers and their items: ordered lookups, numbering, totals, packing of pages, reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of the sections of a paper, and where numbering begins in an answer-sheet layout.
TYPE_ORDER = ("single_choice", "multi_choice", "fill_in_blank", "detailed_answer")
SHEET_START = {"single_choice": 1, "multi_choice": 9, "fill_in_blank": 12, "detailed_answer": 15}
FIRST_PAGE, NEXT_PAGE = 620, 920


def type_order(c: Column) -> Column:
    """Place of a question type, null for types that papers leave out."""
    out = F.lit(None).cast("int")
    for k, t in enumerate(TYPE_ORDER):
        out = F.when(c == t, F.lit(k)).otherwise(out)
    return out


def in_list_order(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows of the listed ids in the order of the list, with ``pos``; repeated ids repeat, missing ones are left out."""
    wanted = df.sparkSession.createDataFrame([(p, i) for p, i in enumerate(ids)], f"pos int, {key} long")
    return wanted.join(df, key).orderBy("pos")


def chosen(df: DataFrame, returned: list, limit: int, key: str = "id") -> DataFrame:
    """Of the returned values the first ``limit`` different ones that are ids of ``df``, in the order returned."""
    wanted = df.sparkSession.createDataFrame([(p, None if v is None else str(v)) for p, v in enumerate(returned)], "pos int, v string")
    wanted = wanted.select("pos", F.expr("try_cast(v as bigint)").alias(key)).filter(f"{key} is not null").groupBy(key).agg(F.min("pos").alias("pos"))
    return wanted.join(df, key, "left_semi").orderBy("pos").limit(limit)


def numbered(items: DataFrame, sheet: bool = False) -> DataFrame:
    """``items`` (paper_id, question_type, pos, id) with ``section`` and ``number``; types without a place are dropped.

    Numbers run on through the sections, or begin anew in each section of an answer sheet.
    """
    known = items.withColumn("type_ord", type_order(F.col("question_type"))).filter("type_ord is not null")
    section = F.dense_rank().over(Window.partitionBy("paper_id").orderBy("type_ord"))
    known = known.withColumn("section", section.cast("long"))
    if sheet:
        start = F.coalesce(*[F.when(F.col("question_type") == t, F.lit(n)) for t, n in SHEET_START.items()])
        number = F.row_number().over(Window.partitionBy("paper_id", "type_ord").orderBy("pos", "id")) + start - 1
    else:
        number = F.row_number().over(Window.partitionBy("paper_id").orderBy("type_ord", "pos", "id"))
    return known.withColumn("number", number.cast("long"))


def section_totals(items: DataFrame) -> DataFrame:
    """(paper_id, question_type, n, total, unit_first, unit_uniform) of every section."""
    known = items.filter(type_order(F.col("question_type")).isNotNull())
    first = F.min(F.struct("pos", "id", "score"))["score"]
    return known.groupBy("paper_id", "question_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("total"), first.alias("unit_first"), (F.min("score") == F.max("score")).alias("unit_uniform")
    )


def pages_of(heights: Column, first: int = FIRST_PAGE, following: int = NEXT_PAGE) -> Column:
    """Page number of every block of an ordered array of heights: greedy, a block taller than its page has one to itself."""
    start = F.struct(F.lit(1).alias("page"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        room = F.when(s["page"] == 1, F.lit(first)).otherwise(F.lit(following))
        turn = (s["used"] > 0) & (s["used"] + h > room)
        page = F.when(turn, s["page"] + 1).otherwise(s["page"])
        used = F.when(turn, h.cast("bigint")).otherwise(s["used"] + h)
        return F.struct(page.alias("page"), used.alias("used"), F.concat(s["out"], F.array(page)).alias("out"))

    return F.aggregate(heights, start, step, lambda s: s["out"])


def moved(items: DataFrame, question_type: str, source: int, target: int) -> DataFrame:
    """(paper_id, pos, id) after moving the item at place ``source`` of one type to place ``target``; other types keep their slots."""
    by = Window.partitionBy("paper_id").orderBy("pos", "id")
    own = items.filter(F.col("question_type") == question_type).withColumn("k", F.row_number().over(by) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("paper_id"))
    own = own.withColumn("n", n)
    valid = (F.lit(source) < F.col("n")) & (F.lit(target) < F.col("n"))
    k = F.col("k")
    shifted = F.when(k == source, target).when((k > source) & (k <= target), k - 1).when((k < source) & (k >= target), k + 1).otherwise(k)
    own = own.withColumn("new_k", F.when(valid, shifted).otherwise(k))
    slots = own.select("paper_id", F.col("k").alias("new_k"), F.col("pos").alias("slot"))
    placed = own.join(slots, ["paper_id", "new_k"]).select("paper_id", F.col("slot").alias("pos"), "id")
    return items.filter(F.coalesce(F.col("question_type") != question_type, F.lit(True))).select("paper_id", "pos", "id").unionByName(placed)


POOL = 35


def candidates(df: DataFrame, filters, review: bool, size: int = POOL) -> DataFrame:
    """The pool a selection starts from: the least used of the filtered rows, or for a review the most used of those used at all.

    Where there is none, the least used of the whole table, or for a review the newest of the filtered rows. The pool is bounded,
    and so is its fallback, which is added in the same plan and stands only if the pool is empty.
    """
    own = filters.apply(df)
    order = [F.col("usage_count").desc_nulls_last() if review else F.col("usage_count").asc_nulls_first(), F.desc("id")]
    first = (own.filter("usage_count > 0") if review else own).orderBy(*order).limit(size).withColumn("_pool", F.lit(0))
    other = own.orderBy(F.desc("id")) if review else df.orderBy(*order)
    both = first.unionByName(other.limit(size).withColumn("_pool", F.lit(1)))
    least = F.min("_pool").over(Window.partitionBy(F.lit(0)))  # at most 2 * size rows
    return both.withColumn("_least", least).filter("_pool = _least").drop("_pool", "_least")


def topic_selection(df: DataFrame, topics: list[str], matches, limit: int, question_type: str = "", review: bool = False, pool: DataFrame | None = None) -> DataFrame:
    """Rows matching the topics in the order of the topics, each once at its first topic, then those of ``pool``; the first ``limit``.

    ``matches`` gives the condition of a topic; only the type filters the matching rows. ``topic_place`` is the topic's number, that
    of the pool the number of topics. Within a topic the least used come first, for a review the most used.
    """
    place = F.lit(None).cast("int")
    for k in reversed(range(len(topics))):
        place = F.when(matches(topics[k]), F.lit(k)).otherwise(place)
    order = [F.col("usage_count").desc_nulls_last() if review else F.col("usage_count").asc_nulls_first(), F.desc("id")]
    own = df.filter(F.col("question_type") == question_type) if question_type else df
    found = own.withColumn("topic_place", place).filter("topic_place is not null").orderBy("topic_place", *order).limit(limit)
    if pool is not None:
        known = F.broadcast(found.select("id"))  # at most ``limit`` rows
        found = found.unionByName(pool.join(known, "id", "left_anti").withColumn("topic_place", F.lit(len(topics))).select(*found.columns))
    return found.orderBy("topic_place", *order).limit(limit)
