"""Repair of relations: latest row per key, referential checks, recomputed totals, edition changes, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import components


def latest(df: DataFrame, keys: list[Column], key: str = "id") -> DataFrame:
    """The row of the largest id of every key; an aggregate, so a hot key is combined before it is shuffled."""
    named = [k.alias(f"_k{n}") for n, k in enumerate(keys)]
    rest = F.struct(*df.columns)
    best = df.groupBy(*named).agg(F.max_by(rest, F.col(key)).alias("r"))
    return best.select("r.*")


def existing(df: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias(column)).distinct(), column, "left_semi")


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")


def clean_curriculums(curriculums: DataFrame, questions: DataFrame) -> DataFrame:
    return latest(existing(curriculums, "question_id", questions), [F.col("question_id"), F.col("version_code")])


def clean_items(items: DataFrame, papers: DataFrame, questions: DataFrame) -> DataFrame:
    """Latest item per paper and place, null place counting as 0 and null or negative scores as 0."""
    known = existing(existing(items, "question_id", questions), "paper_id", papers)
    kept = latest(known, [F.col("paper_id"), F.coalesce("order_index", F.lit(0))])
    return kept.withColumn("order_index", F.coalesce("order_index", F.lit(0))).withColumn("score", F.greatest(F.coalesce("score", F.lit(0)), F.lit(0)))


def totals(papers: DataFrame, items: DataFrame) -> DataFrame:
    """Papers with total_score recomputed from the items."""
    s = items.groupBy(F.col("paper_id").alias("id")).agg(F.sum("score").cast("int").alias("_s"))
    return papers.join(s, "id", "left").withColumn("total_score", F.coalesce("_s", F.lit(0))).drop("_s")


def with_edition(questions: DataFrame, curriculums: DataFrame, edition: str) -> DataFrame:
    """Questions with their three category fields taken from one edition's rows, '' where there is none."""
    c = latest(curriculums.filter(F.col("version_code") == edition), [F.col("question_id")])
    c = c.select(F.col("question_id").alias("id"), F.col("compulsory").alias("_a"), F.col("chapter").alias("_b"), F.col("knowledge").alias("_c"))
    out = questions.join(c, "id", "left")
    for column, new in (("category_compulsory", "_a"), ("category_chapter", "_b"), ("category_knowledge", "_c")):
        out = out.withColumn(column, F.coalesce(F.col(new), F.lit("")))
    return out.drop("_a", "_b", "_c")


def without_stale_leaves(curriculums: DataFrame, tree: DataFrame) -> DataFrame:
    """Knowledge blanked where it is no leaf of its edition, book and chapter; the tree is a bounded reference list."""
    leaves = tree.select("version_code", F.col("book").alias("compulsory"), "chapter", "knowledge").distinct().withColumn("_known", F.lit(True))
    out = curriculums.join(leaves, ["version_code", "compulsory", "chapter", "knowledge"], "left")
    return out.withColumn("knowledge", F.when(F.col("_known"), F.col("knowledge")).otherwise(F.lit(""))).drop("_known")


def associate(questions: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group): after linking pairs (a, b) of questions; groups that meet become one, named by the smallest id in it.

    Existing groups count as links of their members to the group's smallest id.
    """
    groups = questions.filter(F.coalesce("association_group_id", F.lit("")) != "").select("id", "association_group_id")
    heads = groups.groupBy("association_group_id").agg(F.min("id").alias("head"))
    edges = groups.join(heads, "association_group_id").select(F.col("id").alias("a"), F.col("head").alias("b")).filter("a != b").unionByName(links.select("a", "b"))
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def dissociate(questions: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, association_group_id) after the rows of ``gone`` left their groups; a group left with one member is blanked too."""
    group = F.coalesce(F.col("association_group_id"), F.lit(""))
    marked = questions.select("id", group.alias("g")).join(gone.select("id").withColumn("_gone", F.lit(True)), "id", "left")
    marked = marked.withColumn("g", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("g")))
    size = marked.filter("g != ''").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return marked.join(size, "g", "left").select("id", F.when(F.coalesce("n", F.lit(0)) > 1, F.col("g")).otherwise(F.lit("")).alias("association_group_id"))


def rejected_items(items: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, problem) of the papers whose items break a rule: too many, repeated, out of range, unknown."""
    known = questions.select(F.col("id").alias("question_id")).distinct().withColumn("_known", F.lit(True))
    marked = items.join(known, "question_id", "left")
    per = marked.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("different"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.count_if(~F.col("score").between(0, 100)).alias("range")
    )
    checks = F.array(*[F.when(c, F.lit(n)) for n, c in (("too_many", F.col("n") > 200), ("repeated", F.col("different") < F.col("n")), ("unknown", F.col("unknown") > 0), ("range", F.col("range") > 0))])
    return per.select("paper_id", F.explode(F.array_compact(checks)).alias("problem"))


def upserted(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows of ``changes`` in place of those of the same keys, and the new ones added; other rows untouched.

    Columns that ``changes`` lacks are null in new rows. Of several changes of a key the last by all columns stands.
    """
    columns = [F.coalesce(F.col(f"c.{x}"), F.col(f"d.{x}")).alias(x) if x in changes.columns else F.col(f"d.{x}").alias(x) for x in df.columns]
    one = changes.groupBy(*keys).agg(F.max(F.struct(*[c for c in changes.columns if c not in keys])).alias("_r")).select(*keys, "_r.*")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return df.alias("d").join(one.alias("c"), on, "full").select(*columns)


def backfilled(curriculums: DataFrame, questions: DataFrame, edition: str = "A") -> DataFrame:
    """Rows of ``edition`` for every question, when the mapping table is empty; else the table as it is."""
    rows = questions.select(
        F.col("id").alias("question_id"), F.lit(edition).alias("version_code"), F.col("category_compulsory").alias("compulsory"), F.col("category_chapter").alias("chapter"), F.col("category_knowledge").alias("knowledge")
    )
    return rows if curriculums.isEmpty() else curriculums.select(*rows.columns)


def saved_paper(paper_id: int, ids: list[int], scores: list[int], questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, usage): the items of a new paper, places from 1, and the questions' usage raised; refused as a whole if an item is wrong."""
    spark = questions.sparkSession
    items = spark.createDataFrame([(paper_id, i, n + 1, s) for n, (i, s) in enumerate(zip(ids, scores, strict=True))], "paper_id long, question_id long, order_index int, score int")
    problems = [r.problem for r in rejected_items(items, questions).collect()]
    if problems or not ids:
        raise ValueError("paper refused: " + (", ".join(sorted(problems)) or "no items"))
    used = items.select(F.col("question_id").alias("id"), F.lit(1).alias("_k"))
    usage = questions.join(used, "id", "left").withColumn("usage_count", (F.coalesce("usage_count", F.lit(0)) + F.coalesce("_k", F.lit(0))).cast("int")).drop("_k")
    return items, usage


def manifest_differences(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of files (path, size, sha) that are missing, unknown or changed."""
    both = stored.alias("s").join(found.alias("f"), F.col("s.path") == F.col("f.path"), "full")
    problem = F.when(F.col("f.path").isNull(), "missing").when(F.col("s.path").isNull(), "unknown").when((F.col("s.size") != F.col("f.size")) | (F.col("s.sha") != F.col("f.sha")), "changed")
    return both.select(F.coalesce("s.path", "f.path").alias("path"), problem.alias("problem")).filter("problem is not null")


def missing_columns(required: dict[str, list[str]], tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Columns a layout lacks, by table; a missing table lacks all of its columns."""
    lacking = {t: [c for c in columns if t not in tables or c not in tables[t].columns] for t, columns in required.items()}
    return {t: c for t, c in lacking.items() if c}


def readiness(tables: dict[str, DataFrame], layout: dict[str, list[str]], references: list[tuple[str, str, str]]) -> DataFrame:
    """One row: how many references (table, column, parent) lead nowhere, and how many columns the layout lacks."""
    lost = [orphans(tables[t].filter(F.col(c).isNotNull()), c, tables[p]).select(F.lit(1).alias("n")) for t, c, p in references]
    every = lost[0]
    for x in lost[1:]:
        every = every.unionByName(x)
    lacking = sum(map(len, missing_columns(layout, tables).values()))
    return every.agg(F.count("n").alias("violations")).withColumn("missing_columns", F.lit(lacking))


def committed(table: DataFrame, folder: str, problems: DataFrame) -> DataFrame:
    """``table`` written beside ``folder`` and put in its place, if ``problems`` is empty; else nothing changes and the first problems are raised.

    The rows are checked before the write and counted after it; a failure leaves the old table as it was.
    """
    from tessella.sources.snapshots import put_in_place

    found = problems.limit(6).collect()
    if found:
        raise ValueError("change refused: " + "; ".join(str(r.asDict()) for r in found))
    spark = table.sparkSession
    staging = folder + ".new"
    table.write.mode("overwrite").parquet(staging)
    put_in_place(spark, staging, folder)
    return spark.read.parquet(folder)
