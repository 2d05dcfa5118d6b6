"""Search over questions: filters, ordinals, order and paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import any_like, has_answer, like_ci
from tessella.operators.running import running_before
from tessella.plans.lineage import stored

#: Rows of one chunk of the numbering.
CHUNK = 1 << 16
KEYWORD_COLUMNS = ("content", "source", "answer_markdown", "review", "tags")
CLI_COLUMNS = ("category_compulsory", "category_chapter", "category_knowledge", "content", "source", "tags")
TOPIC_COLUMNS = ("content", "category_chapter", "category_knowledge", "tags")


def in_chunks(df: DataFrame, order: list[Column], rows: int = CHUNK) -> DataFrame:
    """``df`` with its rows dealt into ranges of ``order`` of about ``rows`` each, numbered in ``_chunk``; stored, so that every reader sees the same ranges.

    Ranges are drawn by a sample of the order's values, so neither sparse ids nor a day with most of the rows makes a large one.
    """
    parts = max(1, -(-df.count() // rows))
    return stored(df.repartitionByRange(parts, *order).withColumn("_chunk", F.spark_partition_id()))


def with_ordinal(df: DataFrame, key: str = "id", out: str = "seq_num") -> DataFrame:
    """The place of every row in the order of its id, counted in bounded chunks, so no task holds the whole table."""
    ids = in_chunks(df.select(key), [F.col(key)])
    places = running_before(ids, [], "_chunk", [key], F.lit(1), out).select(key, (F.col(out) + 1).alias(out))
    return df.join(places, key)


def with_time_place(df: DataFrame, descending: bool, out: str = "place") -> DataFrame:
    """The place of every row by creation time and id, nulls lowest, counted in bounded chunks."""
    order = in_order("desc" if descending else "asc")
    return running_before(in_chunks(df, order), [], "_chunk", order, F.lit(1), out).withColumn(out, F.col(out) + 1).drop("_chunk")


@dataclass(frozen=True)
class Filters:
    """Equality filters; an empty value filters nothing."""

    compulsory: str = ""
    chapter: str = ""
    knowledge: str = ""
    question_type: str = ""
    difficulty: str = ""
    source: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        for column, value in (
            ("category_compulsory", self.compulsory), ("category_chapter", self.chapter), ("category_knowledge", self.knowledge),
            ("question_type", self.question_type), ("difficulty", self.difficulty),
        ):
            if value:
                df = df.filter(F.col(column) == value)
        return df.filter(like_ci(F.col("source"), self.source)) if self.source else df


def keyword(q: str) -> Column:
    return any_like(q, *KEYWORD_COLUMNS)


def ordinal_or_keyword(df: DataFrame, q: str) -> DataFrame:
    """Rows that hold the term, or whose ordinal it is: digits, one leading ``#`` allowed. ``df`` has ``seq_num``."""
    term = q.strip().removeprefix("#")
    condition = keyword(q)
    if term.isascii() and term.isdigit() and int(term) >= 1:
        condition = condition | (F.col("seq_num") == int(term))
    return df.filter(condition)


def in_order(direction: str = "desc") -> list[Column]:
    """By creation time and id, both the same way; unknown directions are descending, nulls are lowest."""
    if direction == "asc":
        return [F.col("created_at").asc_nulls_first(), F.col("id").asc()]
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def page(df: DataFrame, number: int, size: int, direction: str = "desc") -> DataFrame:
    """One page with the totals beside every row; size within 1 to 100, number within the pages there are."""
    size = min(max(size, 1), 100)
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    items = df.orderBy(*in_order(direction)).offset((number - 1) * size).limit(size)
    return items.withColumns({"total": F.lit(total).cast("long"), "page": F.lit(number), "page_size": F.lit(size), "total_pages": F.lit(pages)})


def summary(df: DataFrame) -> DataFrame:
    """Without the long texts, with whether there is an answer."""
    return df.withColumn("has_answer", has_answer(F.col("answer_markdown"))).drop("answer_markdown", "review")


def related(df: DataFrame, key: int) -> DataFrame:
    """Other rows of the same non-blank association group."""
    group = df.filter((F.col("id") == key) & (F.coalesce("association_group_id", F.lit("")) != "")).select("association_group_id")
    return df.join(group, "association_group_id", "left_semi").filter(F.col("id") != key)


DRAFT_COLUMNS = ("content", "source", "category_chapter", "review", "tags")


def holds_lower(term: str, *columns: str) -> Column:
    """Whether any of the columns holds the trimmed term, both in lower case; an empty term is held by all."""
    wanted = F.lit(term.strip().lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted)
    return found


def drafts(df: DataFrame, term: str = "", **equal: str) -> DataFrame:
    """Rows whose columns equal the given values, and which hold the term in any of the draft columns."""
    for column, value in equal.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df.filter(holds_lower(term, *DRAFT_COLUMNS))


def autocomplete(df: DataFrame, typed: str, column: str = "source") -> DataFrame:
    """Different values that hold what was typed, in any case; all when nothing was."""
    return df.filter(F.col(column).isNotNull() & holds_lower(typed, column)).select(column).distinct()


def valid_items(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Items whose question exists and has text."""
    held = questions.filter(F.trim(F.coalesce("content", F.lit(""))) != "").select(F.col("id").alias("question_id"))
    return items.join(held, "question_id", "left_semi")


def needs_answer(answer: Column, marker: str = "[EXTRACTED_ORIGINAL]", short: int = 5) -> Column:
    """Whether an answer is blank, or short and not marked as extracted."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    return (a == "") | (~F.contains(a, F.lit(marker)) & (F.length(a) < short))


def selection(df: DataFrame, checked: Column, saved: Column) -> DataFrame:
    """``df`` with what a selection and its changes mark: to_save (checked and not saved), all_checked and inverted."""
    on = F.coalesce(checked, F.lit(False))
    return df.withColumns({"checked": on, "to_save": on & ~F.coalesce(saved, F.lit(False)), "all_checked": F.lit(True), "inverted": ~on})
