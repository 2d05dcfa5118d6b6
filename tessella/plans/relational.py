"""Queries over questions: search, paging, counts, distributions, distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.values import any_like, blank, filled, has_answer, json_strings, like_ci, py_strip
from tessella.operators import counts, search
from tessella.registry import query
from tessella.sources.tables import table

FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _has(column: str, q: str) -> str:
    return f"coalesce(contains({FOLD.format(c=column)}, '{q}'), false)"


def _any(q: str, *columns: str) -> str:
    return "(" + " or ".join(_has(c, q) for c in columns) + ")"


KEYWORD_SQL = _any("圆", *search.KEYWORD_COLUMNS)
STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    "rel_page_search",
    f"""with q as (select *, row_number() over (order by id) as seq_num from questions),
    hit as (select * from q where difficulty = 'medium' and {KEYWORD_SQL}),
    n as (select count(*) as total from hit)
    select id, seq_num, content, difficulty, source, created_at, {STRIP.format(c="coalesce(answer_markdown, '')")} <> '' as has_answer,
      total, cast(2 as integer) as page, cast(10 as integer) as page_size, cast(ceil(total / 10.0) as integer) as total_pages
    from hit, n order by created_at desc nulls last, id desc limit 10 offset 10""",
)
def rel_page_search(spark: SparkSession, d: str) -> DataFrame:
    """WIN1, FIL1, FIL2, FIL5, SRT1, LIM1: the second page of a filtered keyword search, with ordinals of the whole table."""
    q = search.with_ordinal(table(spark, d, "questions"))
    hit = search.Filters(difficulty="medium").apply(q).filter(search.keyword("圆"))
    found = search.summary(search.page(hit, 2, 10))
    return found.select("id", "seq_num", "content", "difficulty", "source", "created_at", "has_answer", "total", "page", "page_size", "total_pages")


@query("win1_ordinals", "select id, row_number() over (order by id) as seq_num from questions")
def win1_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return search.with_ordinal(table(spark, d, "questions").select("id"))


@query("fil1_filters", "select id, category_compulsory, question_type, difficulty from questions where category_compulsory = '必修上册' and question_type = 'single_choice' and difficulty = 'hard'")
def fil1_filters(spark: SparkSession, d: str) -> DataFrame:
    q = search.Filters(compulsory="必修上册", question_type="single_choice", difficulty="hard").apply(table(spark, d, "questions"))
    return q.select("id", "category_compulsory", "question_type", "difficulty")


@query("fil2_keyword", f"select id, source from questions where {_any('vieta', *search.KEYWORD_COLUMNS)}")
def fil2_keyword(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").filter(search.keyword("Vieta")).select("id", "source")


@query("fil3_ordinal", f"with q as (select *, row_number() over (order by id) as seq_num from questions) select id, seq_num from q where seq_num = 57 or {_any('#57', *search.KEYWORD_COLUMNS)}")
def fil3_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return search.ordinal_or_keyword(search.with_ordinal(table(spark, d, "questions")), "#57").select("id", "seq_num")


@query("fil4_source", f"select id, source from questions where {_has('source', '联考')}")
def fil4_source(spark: SparkSession, d: str) -> DataFrame:
    return search.Filters(source="联考").apply(table(spark, d, "questions")).select("id", "source")


@query("fil5_summary", f"select id, content, question_type, tags, usage_count, {STRIP.format(c=chr(99) + 'oalesce(answer_markdown, ' + chr(39) * 2 + ')')} <> '' as has_answer from questions")
def fil5_summary(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(table(spark, d, "questions")).select("id", "content", "question_type", "tags", "usage_count", "has_answer")


@query("fil6_cli_search", f"select id, category_chapter, difficulty from questions where {_any('导数', *search.CLI_COLUMNS)} and difficulty = 'medium' order by id desc limit 50")
def fil6_cli_search(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").filter(any_like("导数", *search.CLI_COLUMNS) & (F.col("difficulty") == "medium"))
    return q.select("id", "category_chapter", "difficulty").orderBy(F.desc("id")).limit(50)


@query("fil7_related", "select id, association_group_id from questions where association_group_id <> '' and association_group_id in (select association_group_id from questions where id = 15) and id <> 15")
def fil7_related(spark: SparkSession, d: str) -> DataFrame:
    return search.related(table(spark, d, "questions"), 15).select("id", "association_group_id")


@query("fil8_topic", f"select id, category_knowledge from questions where {_any('向量', *search.TOPIC_COLUMNS)}")
def fil8_topic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").filter(any_like("向量", *search.TOPIC_COLUMNS)).select("id", "category_knowledge")


@query("fil9_membership", "select id, difficulty from questions where id in (select question_id from paper_questions where order_index = 3)")
def fil9_membership(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "paper_questions").filter("order_index = 3").select(F.col("question_id").alias("id"))
    return table(spark, d, "questions").join(ids, "id", "left_semi").select("id", "difficulty")


_DRAFT = " or ".join(f"contains(lower(coalesce({c}, '')), 'circle')" for c in search.DRAFT_COLUMNS)


@query("fil10_drafts", f"select id, source from questions where question_type = 'fill_in_blank' and ({_DRAFT})")
def fil10_drafts(spark: SparkSession, d: str) -> DataFrame:
    """FIL10: drafts of a type that hold a term in any case."""
    return search.drafts(table(spark, d, "questions"), " Circle ", question_type="fill_in_blank").select("id", "source")


@query("fil12_valid_items", "select pq.id, pq.question_id, pq.score from paper_questions pq join questions q on q.id = pq.question_id where trim(coalesce(q.content, '')) <> ''")
def fil12_valid_items(spark: SparkSession, d: str) -> DataFrame:
    """FIL12: items whose question exists and has text."""
    return search.valid_items(table(spark, d, "paper_questions"), table(spark, d, "questions")).select("id", "question_id", "score")


@query(
    "fil13_needs_answer",
    "select id from questions where trim(coalesce(answer_markdown, '')) = '' or (not contains(answer_markdown, '[EXTRACTED_ORIGINAL]') and length(trim(answer_markdown)) < 5)",
)
def fil13_needs_answer(spark: SparkSession, d: str) -> DataFrame:
    """FIL13: questions whose answer is still to be written."""
    return table(spark, d, "questions").filter(search.needs_answer(F.col("answer_markdown"))).select("id")


@query(
    "fil14_selection",
    "select id, coalesce(usage_count > 10, false) as checked, coalesce(usage_count > 10, false) and coalesce(association_group_id, '') = '' as to_save, true as all_checked, not coalesce(usage_count > 10, false) as inverted from questions",
)
def fil14_selection(spark: SparkSession, d: str) -> DataFrame:
    """FIL14: what a selection marks: to be saved, everything selected, and inverted."""
    return search.selection(table(spark, d, "questions").select("id", "usage_count", "association_group_id"), F.col("usage_count") > 10, ~blank(F.col("association_group_id"))).drop("usage_count", "association_group_id")


@query("srt1_order", "select id, created_at, row_number() over (order by created_at asc nulls first, id asc) as place from questions")
def srt1_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT1: the place of every question by age, whatever the size of the table."""
    return search.with_time_place(table(spark, d, "questions").select("id", "created_at"), descending=False)


COUNTED = ("normal", "easy_error", "challenge", "qiangji")


@query("agg1_difficulty_counts", "select count(*) as total, " + ", ".join(f"count(*) filter (where difficulty = '{x}') as {x}" for x in COUNTED) + " from questions")
def agg1_difficulty_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG1: all questions and those of four difficulties in one pass."""
    return counts.conditional_counts(table(spark, d, "questions"), "difficulty", COUNTED)


@query(
    "agg2_hierarchy_counts",
    "select coalesce(nullif(category_compulsory, ''), '未分类') as book, coalesce(nullif(category_chapter, ''), '未分章节') as chapter, count(*) as n from questions group by 1, 2",
)
def agg2_hierarchy_counts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select(filled(F.col("category_compulsory"), "未分类").alias("book"), filled(F.col("category_chapter"), "未分章节").alias("chapter"))
    return q.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n"))


BOOK_NUMBER = "list_min(list_concat([99], list_filter([" + ", ".join(f"case when contains(book, '{c}') or contains(book, '{n}') then {n} end" for n, c in enumerate("一二三四五六", 1)) + "], lambda x: x is not null)))"


@query(
    "agg3_book_order",
    f"""with g as (select coalesce(nullif(category_compulsory, ''), '未分类') as book, count(*) as n from questions group by 1)
    select book, n, row_number() over (order by case when book = '未分类' then 99 when contains(book, '必修') and not contains(book, '选') then 0 else 1 end,
      case when book = '未分类' then 99 else {BOOK_NUMBER} end, book) as place from g""",
)
def agg3_book_order(spark: SparkSession, d: str) -> DataFrame:
    """AGG3: books in a custom order: compulsory before elective, by the smallest number in the name, unclassified last."""
    g = table(spark, d, "questions").groupBy(filled(F.col("category_compulsory"), "未分类").alias("book")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(*counts.book_order(F.col("book")))))  # as many rows as there are names of books


@query("agg4_daily", "select strftime(created_at + interval 8 hours, '%Y-%m-%d') as day, count(*) as n from questions where created_at is not null group by 1")
def agg4_daily(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.col("created_at") + F.expr("interval 8 hours"), "yyyy-MM-dd")
    return table(spark, d, "questions").filter("created_at is not null").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg7_knowledge_share",
    """with k as (select category_chapter as chapter, coalesce(nullif(category_knowledge, ''), '未细分知识点') as leaf, count(*) as n from questions where category_chapter <> '' group by 1, 2)
    select chapter, leaf, n, cast(round(n * 100.0 / sum(n) over (partition by chapter)) as bigint) as pct from k""",
)
def agg7_knowledge_share(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").filter("category_chapter != ''")
    k = q.groupBy(F.col("category_chapter").alias("chapter"), filled(F.col("category_knowledge"), "未细分知识点").alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("chapter"))
    return k.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total).cast("long"))


@query(
    "agg11_leaf_counts",
    "select coalesce(nullif(category_compulsory, ''), '-') as book, coalesce(nullif(category_chapter, ''), '-') as chapter, coalesce(nullif(category_knowledge, ''), '-') as leaf, count(*) as n from questions group by 1, 2, 3",
)
def agg11_leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    names = {"book": "category_compulsory", "chapter": "category_chapter", "leaf": "category_knowledge"}
    return table(spark, d, "questions").groupBy(*[filled(F.col(c), "-").alias(n) for n, c in names.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("agg12_table_counts", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("questions", "question_curriculums", "papers", "paper_questions")))
def agg12_table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("questions", "question_curriculums", "papers", "paper_questions")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("dis1_sources", rf"with s as (select distinct source from questions where coalesce(source, '') <> '') select {STRIP.format(c='source')} as source from s where {STRIP.format(c='source')} <> ''")
def dis1_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct before stripping, so values that differ in outer blanks only both stay."""
    s = table(spark, d, "questions").filter(~blank(F.col("source"))).select("source").distinct()
    return s.select(py_strip(F.col("source")).alias("source"), F.col("source").alias("raw")).filter("source != ''").orderBy(F.lower("source"), "raw").select("source")


@query("dis2_triples", "select distinct category_compulsory, category_chapter, category_knowledge from questions")
def dis2_triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("category_compulsory", "category_chapter", "category_knowledge").distinct()


@query("dis3_papers_of", "select distinct paper_id from paper_questions where question_id in (select id from questions where difficulty = 'hard')")
def dis3_papers_of(spark: SparkSession, d: str) -> DataFrame:
    hard = table(spark, d, "questions").filter("difficulty = 'hard'").select(F.col("id").alias("question_id"))
    return table(spark, d, "paper_questions").join(hard, "question_id", "left_semi").select("paper_id").distinct()


@query(
    "sca22_tags",
    """with t as (select id, list_filter(list_transform(string_split_regex(coalesce(tags, ''), '[,，]+'), lambda x: trim(x)), lambda x: x <> '') as l from questions)
    select id, len(l) as n_tags, array_to_string(l[1:2], '|') as shown, greatest(len(l) - 2, 0) as hidden from t""",
)
def sca22_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), "[,，]+"), F.trim), lambda x: x != "")
    q = table(spark, d, "questions").select("id", tags.alias("l"))
    return q.select("id", F.size("l").cast("long").alias("n_tags"), F.array_join(F.slice("l", 1, 2), "|").alias("shown"), F.greatest(F.size("l") - 2, F.lit(0)).cast("long").alias("hidden"))


@query(
    "v2_image_paths",
    """select id, case when json_valid(image_paths) and json_type(image_paths) = 'ARRAY' then json_array_length(image_paths) else 0 end as n_images from questions""",
)
def v2_image_paths(spark: SparkSession, d: str) -> DataFrame:
    """JSON columns fail closed: anything but an array has no entries."""
    return table(spark, d, "questions").select("id", F.size(json_strings(F.col("image_paths"))).cast("long").alias("n_images"))


@query("rel_answered_by_type", f"select question_type, count(*) as n, count(*) filter (where {STRIP.format(c=chr(99) + 'oalesce(answer_markdown, ' + chr(39) * 2 + ')')} <> '') as answered from questions group by 1")
def rel_answered_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(has_answer(F.col("answer_markdown"))).alias("answered"))


@query("fil11_autocomplete", "select distinct source from questions where contains(lower(source), 'jes')")
def fil11_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    """FIL11: sources that hold what was typed."""
    return search.autocomplete(table(spark, d, "questions"), "Jes")


@query("rel_like_wildcards", "select id from questions where translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%a_{n+1}%x\\frac%' escape '!' or translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%q_=%' escape '!'")
def rel_like_wildcards(spark: SparkSession, d: str) -> DataFrame:
    """Wild characters typed by the user stay wild, a backslash is an ordinary character."""
    return table(spark, d, "questions").filter(like_ci(F.col("content"), "a_{n+1}%x\\frac") | like_ci(F.col("content"), "q_=")).select("id")
