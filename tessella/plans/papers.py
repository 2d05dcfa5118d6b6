"""Queries over papers and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.values import any_like
from tessella.operators import counts, papers, search
from tessella.registry import query
from tessella.sources.tables import table

TYPE_ORD = "case question_type when 'single_choice' then 0 when 'multi_choice' then 1 when 'fill_in_blank' then 2 when 'detailed_answer' then 3 end"


def items(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, pos, id, question_type, score, ...) of the items whose question exists; a null place counts as 0."""
    pq = table(spark, d, "paper_questions").select("paper_id", F.coalesce("order_index", F.lit(0)).alias("pos"), F.col("id"), "question_id", "score")
    q = table(spark, d, "questions").select(F.col("id").alias("question_id"), "question_type", "difficulty", F.length("content").alias("n_chars"))
    return pq.join(q, "question_id")


ITEMS_SQL = "items as (select pq.paper_id, coalesce(pq.order_index, 0) as pos, pq.id, pq.question_id, pq.score, q.question_type, q.difficulty, length(q.content) as n_chars from paper_questions pq join questions q on q.id = pq.question_id)"


@query("join1_paper_items", "select pq.id, pq.order_index, pq.score, q.id as question_id, q.question_type from paper_questions pq join questions q on q.id = pq.question_id where pq.paper_id = 5")
def join1_paper_items(spark: SparkSession, d: str) -> DataFrame:
    pq = table(spark, d, "paper_questions").filter("paper_id = 5").select("id", "order_index", "score", "question_id")
    q = table(spark, d, "questions").select(F.col("id").alias("question_id"), "question_type")
    return pq.join(q, "question_id").orderBy("order_index")


@query("join2_paper_counts", "select p.id, p.title, count(pq.id) as n_items from papers p left join paper_questions pq on pq.paper_id = p.id group by 1, 2")
def join2_paper_counts(spark: SparkSession, d: str) -> DataFrame:
    """Empty papers count 0; items are counted before the join, so a paper with a third of all items is no hot key."""
    n = table(spark, d, "paper_questions").groupBy(F.col("paper_id").alias("id")).agg(F.count("id").alias("n_items"))
    return table(spark, d, "papers").select("id", "title").join(n, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("long"))


LISTED = [40, 7, 99999999, 40, 3, 12]


@query("join5_list_order", "with l(pos, id) as (values (0, 40), (1, 7), (2, 99999999), (3, 40), (4, 3), (5, 12)) select cast(l.pos as integer) as pos, q.id, q.difficulty from l join questions q on q.id = l.id")
def join5_list_order(spark: SparkSession, d: str) -> DataFrame:
    return papers.in_list_order(table(spark, d, "questions").select("id", "difficulty"), LISTED)


@query(
    "join6_chosen",
    """with l(pos, v) as (values (0, '99999999'), (1, '3'), (2, '3'), (3, '12'), (4, 'x'), (5, null), (6, '7'), (7, '40'))
    select id, min(pos) as pos from l join questions q on q.id = try_cast(v as bigint) group by 1 order by 2 limit 3""",
)
def join6_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Returned values against candidates: unknown, repeated and unreadable ones fall out, the limit comes last."""
    return papers.chosen(table(spark, d, "questions").select("id"), [99999999, "3", 3, 12, "x", None, "7", 40], 3).select("id", "pos")


@query("join7_missing_items", "select distinct pq.question_id from paper_questions pq where pq.question_id not in (select id from questions)")
def join7_missing_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_questions").select("question_id").distinct().join(table(spark, d, "questions").select(F.col("id").alias("question_id")), "question_id", "left_anti")


@query("join10_usage", "with u as (select question_id, count(*) as refs from paper_questions group by 1) select q.id, coalesce(u.refs, 0) as refs from questions q left join u on u.question_id = q.id")
def join10_usage(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "paper_questions").groupBy(F.col("question_id").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    return table(spark, d, "questions").select("id").join(refs, "id", "left").select("id", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


@query(
    "agg5_stale_usage",
    "with u as (select question_id, count(*) as refs from paper_questions group by 1) select q.id, q.usage_count, coalesce(u.refs, 0) as refs from questions q left join u on u.question_id = q.id where q.usage_count is distinct from coalesce(u.refs, 0)",
)
def agg5_stale_usage(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored usage differs from the counted one."""
    refs = table(spark, d, "paper_questions").groupBy(F.col("question_id").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    both = table(spark, d, "questions").select("id", "usage_count").join(refs, "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)).cast("long"))
    return both.filter(~F.col("usage_count").eqNullSafe(F.col("refs")))


@query(
    "agg6_remaining_score",
    """with hot as (select question_id from paper_questions group by 1 order by count(*) desc, question_id limit 1), hit as (select distinct paper_id from paper_questions where question_id in (select * from hot)),
    rest as (select paper_id, sum(score) as s from paper_questions where question_id not in (select * from hot) group by 1)
    select hit.paper_id, cast(coalesce(rest.s, 0) as bigint) as remaining from hit left join rest using (paper_id)""",
)
def agg6_remaining_score(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the papers that hold the most used question, without it."""
    pq = table(spark, d, "paper_questions").select("paper_id", "question_id", "score")
    hot = pq.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question_id").limit(1).select("question_id")
    marked = pq.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "question_id", "left")  # one row
    per = marked.groupBy("paper_id").agg(F.max("hot").alias("hit"), F.sum(F.when(F.col("hot").isNull(), F.col("score"))).alias("s"))
    return per.filter("hit").select("paper_id", F.coalesce("s", F.lit(0)).cast("long").alias("remaining"))


@query(
    "agg8_difficulty_ratio",
    f"""with {ITEMS_SQL}, c as (select paper_id, count(*) as n, count(*) filter (where difficulty in ('easy', 'normal')) as easy, count(*) filter (where difficulty in ('hard', 'qiangji')) as hard from items group by 1),
    p as (select paper_id, cast(floor(100.0::double * easy / n + 0.5::double) as bigint) as easy_pct, cast(floor(100.0::double * (n - easy - hard) / n + 0.5::double) as bigint) as medium_pct from c)
    select paper_id, easy_pct, medium_pct, greatest(0, 100 - easy_pct - medium_pct) as hard_pct from p""",
)
def agg8_difficulty_ratio(spark: SparkSession, d: str) -> DataFrame:
    """AGG8: rounded shares whose last is what is left of 100."""
    return counts.difficulty_shares(items(spark, d), "paper_id")


@query("agg9_totals", f"with {ITEMS_SQL} select paper_id, cast(sum(case when score is null or score = 0 then 5 else score end) as bigint) as total, count(*) as n from items group by 1")
def agg9_totals(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("score").isNull() | (F.col("score") == 0), 5).otherwise(F.col("score"))
    return items(spark, d).groupBy("paper_id").agg(F.sum(score).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "agg10_section_totals",
    f"with {ITEMS_SQL} select paper_id, question_type, count(*) as n, cast(sum(score) as bigint) as total, arg_min(score, (pos, id)) as unit_first, min(score) = max(score) as unit_uniform from items where {TYPE_ORD} is not null group by 1, 2",
)
def agg10_section_totals(spark: SparkSession, d: str) -> DataFrame:
    return papers.section_totals(items(spark, d))


@query("num2_numbers", f"with {ITEMS_SQL} select paper_id, id, row_number() over (partition by paper_id order by {TYPE_ORD}, pos, id) as number from items where {TYPE_ORD} is not null")
def num2_numbers(spark: SparkSession, d: str) -> DataFrame:
    return papers.numbered(items(spark, d)).select("paper_id", "id", "number")


@query(
    "num2_sheet_numbers",
    f"with {ITEMS_SQL} select paper_id, id, row_number() over (partition by paper_id, question_type order by pos, id) + case question_type when 'single_choice' then 1 when 'multi_choice' then 9 when 'fill_in_blank' then 12 else 15 end - 1 as number from items where {TYPE_ORD} is not null",
)
def num2_sheet_numbers(spark: SparkSession, d: str) -> DataFrame:
    return papers.numbered(items(spark, d), sheet=True).select("paper_id", "id", "number")


@query("num3_sections", f"with {ITEMS_SQL} select distinct paper_id, question_type, dense_rank() over (partition by paper_id order by {TYPE_ORD}) as section from items where {TYPE_ORD} is not null")
def num3_sections(spark: SparkSession, d: str) -> DataFrame:
    return papers.numbered(items(spark, d)).select("paper_id", "question_type", "section").distinct()


@query(
    "pag1_pages",
    f"""with recursive {ITEMS_SQL}, b as (select paper_id, id, row_number() over (partition by paper_id order by pos, id) as k, case when question_type = 'detailed_answer' then 225 else 75 end + case when n_chars > 200 then 60 else 0 end as h from items),
    r as (select paper_id, id, k, h, 1 as page, h as used from b where k = 1 union all
      select b.paper_id, b.id, b.k, b.h, case when r.used + b.h > case when r.page = 1 then 620 else 920 end then r.page + 1 else r.page end, case when r.used + b.h > case when r.page = 1 then 620 else 920 end then b.h else r.used + b.h end
      from r join b on b.paper_id = r.paper_id and b.k = r.k + 1)
    select paper_id, id, page from r""",
)
def pag1_pages(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packing of blocks into pages, a fold over each paper's ordered heights."""
    h = F.when(F.col("question_type") == "detailed_answer", 225).otherwise(75) + F.when(F.col("n_chars") > 200, 60).otherwise(0)
    per = items(spark, d).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", h.alias("h")))).alias("b"))
    pages = papers.pages_of(F.transform("b", lambda x: x["h"]))
    return per.select("paper_id", F.explode(F.arrays_zip(F.transform("b", lambda x: x["id"]).alias("id"), pages.alias("page"))).alias("x")).select("paper_id", "x.id", "x.page")


@query(
    "reo1_moved",
    f"""with {ITEMS_SQL}, own as (select *, row_number() over (partition by paper_id order by pos, id) - 1 as k, count(*) over (partition by paper_id) as n from items where question_type = 'fill_in_blank'),
    m as (select *, case when n <= 3 then k when k = 0 then 3 when k <= 3 then k - 1 else k end as new_k from own)
    select m.paper_id, s.pos, m.id from m join own s on s.paper_id = m.paper_id and s.k = m.new_k union all select paper_id, pos, id from items where question_type is distinct from 'fill_in_blank'""",
)
def reo1_moved(spark: SparkSession, d: str) -> DataFrame:
    return papers.moved(items(spark, d), "fill_in_blank", 0, 3)


def _pool_sql(name: str, where: str, order: str) -> str:
    """35 candidates of a condition, else of the fallback."""
    return f"{name} as (select id, usage_count from questions where {where} order by {order} limit 35)"


BOOK = "category_compulsory = '必修上册'"
FRESH, REVIEW = "usage_count asc nulls first, id desc", "usage_count desc, id desc"


@query("top1_fresh", f"select id, usage_count from questions where {BOOK} order by {FRESH} limit 35")
def top1_fresh(spark: SparkSession, d: str) -> DataFrame:
    return papers.candidates(table(spark, d, "questions"), search.Filters(compulsory="必修上册"), review=False).select("id", "usage_count")


@query("top1_fallback", f"select id, usage_count from questions order by {FRESH} limit 35")
def top1_fallback(spark: SparkSession, d: str) -> DataFrame:
    """TOP1 where the filters leave nothing: the whole table."""
    return papers.candidates(table(spark, d, "questions"), search.Filters(compulsory="no such book"), review=False).select("id", "usage_count")


@query("top2_review", f"select id, usage_count from questions where {BOOK} and usage_count > 0 order by {REVIEW} limit 35")
def top2_review(spark: SparkSession, d: str) -> DataFrame:
    return papers.candidates(table(spark, d, "questions"), search.Filters(compulsory="必修上册"), review=True).select("id", "usage_count")


@query("top2_fallback", f"with u as (select * from questions where coalesce(usage_count, 0) <= 0) select id, usage_count from u where {BOOK} order by id desc limit 35")
def top2_fallback(spark: SparkSession, d: str) -> DataFrame:
    """TOP2 where no candidate was used: the newest ones."""
    unused = table(spark, d, "questions").filter(F.coalesce("usage_count", F.lit(0)) <= 0)
    return papers.candidates(unused, search.Filters(compulsory="必修上册"), review=True).select("id", "usage_count")


def _topic_sql(t: str) -> str:
    fold = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "(" + " or ".join(f"contains({fold.format(c=c)}, '{t}')" for c in search.TOPIC_COLUMNS) + ")"


@query(
    "top3_topics",
    f"""with t as (select id, usage_count, case when {_topic_sql('复数')} then 0 when {_topic_sql('导数')} then 1 end as k from questions where question_type = 'fill_in_blank'),
    f as (select id, k, usage_count, row_number() over (order by {FRESH}) as r from t where k is not null),
    c as (select id, 2 as k, usage_count, row_number() over (order by {FRESH}) as r from (select id, usage_count from questions where {BOOK} order by {FRESH} limit 35) where id not in (select id from f)),
    u as (select id, k, r from f union all select id, k, r from c) select id, k as topic_place from u order by k, r limit 60""",
)
def top3_topics(spark: SparkSession, d: str) -> DataFrame:
    """TOP3: questions of one type by topic, then candidates to fill up."""
    q = table(spark, d, "questions")
    pool = papers.candidates(q, search.Filters(compulsory="必修上册"), review=False)
    return papers.topic_selection(q, ["复数", "导数"], lambda t: any_like(t, *search.TOPIC_COLUMNS), 60, question_type="fill_in_blank", pool=pool).select("id", "topic_place")


@query("top5_papers", "select id, title, row_number() over (order by created_at desc nulls last, id desc) as place from papers")
def top5_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers by age, newest first, with the id as tie-break."""
    return search.with_time_place(table(spark, d, "papers").select("id", "title", "created_at"), descending=True).select("id", "title", "place")


@query("upd6_usage_delta", "with s as (select question_id, count(*) as k from paper_questions where paper_id = 7 group by 1) select q.id, case when coalesce(q.usage_count, 0) = 0 then q.usage_count else greatest(0, q.usage_count - s.k) end as usage_count from questions q join s on s.question_id = q.id")
def upd6_usage_delta(spark: SparkSession, d: str) -> DataFrame:
    """Usage after deleting a paper: less its references, not below 0, left alone where it was 0 or null."""
    s = table(spark, d, "paper_questions").filter("paper_id = 7").groupBy(F.col("question_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    u = F.col("usage_count")
    return table(spark, d, "questions").join(s, "id").select("id", F.when(F.coalesce(u, F.lit(0)) == 0, u.cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), u - F.col("k"))).alias("usage_count"))


@query("doc15_sections", f"with {ITEMS_SQL} select paper_id, id, row_number() over (partition by paper_id, question_type order by pos, id) as place, {TYPE_ORD} as type_ord from items where {TYPE_ORD} is not null")
def doc15_sections(spark: SparkSession, d: str) -> DataFrame:
    """Stable grouping of a paper's items by type."""
    n = items(spark, d).withColumn("type_ord", papers.type_order(F.col("question_type"))).filter("type_ord is not null")
    return n.select("paper_id", "id", F.row_number().over(Window.partitionBy("paper_id", "question_type").orderBy("pos", "id")).alias("place"), "type_ord")
