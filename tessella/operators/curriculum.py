"""Curriculum trees: reading them, and moving questions from one edition to another by rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.pairs import small_side


@dataclass(frozen=True)
class Rule:
    """Where a question goes that holds any of some words and none of others, in its three fields or only in its book."""

    book: str
    chapter: str
    any_of: tuple[str, ...]
    none_of: tuple[str, ...] = ()
    book_only: bool = False

    def holds(self, every: Column, book: Column) -> Column:
        text = book if self.book_only else every
        found = F.lit(False)
        for w in self.any_of:
            found = found | F.contains(text, F.lit(w))
        for w in self.none_of:
            found = found & ~F.contains(text, F.lit(w))
        return found


def routed(df: DataFrame, rules: list[Rule], default: tuple[str, str], leaves: DataFrame, columns: tuple[str, str, str] = ("compulsory", "chapter", "knowledge")) -> DataFrame:
    """``df`` with its book and chapter by the first rule that holds, else the default; knowledge stays only where it is a leaf there.

    ``leaves`` has (book, chapter, knowledge) of the target edition. Rules are a short list in order, one chain of conditions.
    """
    fields = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    every = F.concat_ws(" ", *fields)
    book, chapter = F.lit(default[0]), F.lit(default[1])
    for rule in reversed(rules):
        hit = rule.holds(every, fields[0])
        book, chapter = F.when(hit, F.lit(rule.book)).otherwise(book), F.when(hit, F.lit(rule.chapter)).otherwise(chapter)
    moved = df.withColumns({"_book": book, "_chapter": chapter, "_leaf": fields[2]})
    known = small_side(leaves.select(F.col("book").alias("_book"), F.col("chapter").alias("_chapter"), F.col("knowledge").alias("_leaf")).distinct().withColumn("_known", F.lit(True)))
    moved = moved.join(known, ["_book", "_chapter", "_leaf"], "left")
    moved = moved.withColumns({columns[0]: F.col("_book"), columns[1]: F.col("_chapter"), columns[2]: F.when(F.col("_known"), F.col("_leaf")).otherwise("")})
    return moved.drop("_book", "_chapter", "_leaf", "_known")


def word_rules(tree: DataFrame, edition: str, words: list[tuple[str, ...]]) -> tuple[list[Rule], tuple[str, str]]:
    """A rule for each group of words: the edition's first chapter that names the first word; and the edition's first chapter as default.

    The tree is a bounded reference list.
    """
    rows = tree.filter(F.col("version_code") == edition).select("book_ord", "chapter_ord", "book", "chapter").distinct().orderBy("book_ord", "chapter_ord").collect()
    found = [(w, next((r for r in rows if w[0] in r.chapter), None)) for w in words]
    return [Rule(r.book, r.chapter, w) for w, r in found if r], (rows[0].book, rows[0].chapter) if rows else ("", "")


def switched(questions: DataFrame, curriculums: DataFrame, edition: str, rules: list[Rule], default: tuple[str, str], leaves: DataFrame) -> DataFrame:
    """(question_id, version_code, compulsory, chapter, knowledge): the rows of ``edition`` for every question.

    A question with rows of the edition keeps the latest of them; another one gets a row routed from its own fields.
    """
    own = curriculums.filter(F.col("version_code") == edition).groupBy("question_id").agg(F.max_by(F.struct("compulsory", "chapter", "knowledge"), "id").alias("r"))
    own = own.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi").select("question_id", "r.*")
    missing = questions.join(own.select(F.col("question_id").alias("id")), "id", "left_anti")
    missing = missing.select(F.col("id").alias("question_id"), F.col("category_compulsory").alias("compulsory"), F.col("category_chapter").alias("chapter"), F.col("category_knowledge").alias("knowledge"))
    both = own.unionByName(routed(missing, rules, default, leaves))
    return both.select("question_id", F.lit(edition).alias("version_code"), "compulsory", "chapter", "knowledge")


EDITIONS = ("A", "B", "S", "H")


def read_tree(spark: SparkSession, folder: str, edition: str) -> DataFrame:
    """(version_code, book, book_ord, chapter, chapter_ord, knowledge, leaf_ord) of an edition's JSON tree ``<folder>/<edition>.json``.

    The file is an object {book: {chapter: [knowledge, ...]}}, or a list of {name, chapters: [{name, knowledge: [...]}]}. The edition is
    taken without blanks and in upper case; an unknown one is an error.
    """
    code = edition.strip().upper()
    if code not in EDITIONS:
        raise ValueError(f"unknown edition: {edition!r}")
    text = spark.read.text(f"{folder}/{code}.json", wholetext=True)
    leaf = "array<string>"
    listed = F.from_json("value", f"array<struct<name: string, chapters: array<struct<name: string, knowledge: {leaf}>>>>")
    mapped = F.from_json("value", f"map<string, map<string, {leaf}>>")
    book = lambda name, chapters: F.struct(name.alias("name"), chapters.alias("chapters"))
    chapter = lambda e: F.struct(e["key"].alias("name"), e["value"].alias("knowledge"))
    as_list = F.transform(F.map_entries(mapped), lambda e: book(e["key"], F.transform(F.map_entries(e["value"]), chapter)))
    books = text.select(F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(as_list)).alias("book_ord", "b"))
    chapters = books.select("book_ord", F.col("b.name").alias("book"), F.posexplode("b.chapters").alias("chapter_ord", "c"))
    leaves = chapters.select("book_ord", "book", "chapter_ord", F.col("c.name").alias("chapter"), F.posexplode("c.knowledge").alias("leaf_ord", "knowledge"))
    return leaves.select(F.lit(code).alias("version_code"), "book", "book_ord", "chapter", "chapter_ord", "knowledge", "leaf_ord")
