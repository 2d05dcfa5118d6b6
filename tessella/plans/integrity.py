"""Queries that repair, check and update relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.values import blank
from tessella.operators import curriculum, repair
from tessella.registry import query
from tessella.plans.texts import LABELS
from tessella.sources import snapshots
from tessella.sources.tables import table

CURR = "curr as (select * from (select c.*, row_number() over (partition by question_id, version_code order by id desc) as rn from question_curriculums c where question_id in (select id from questions)) where rn = 1)"
CLEAN = """clean as (select id, paper_id, question_id, coalesce(order_index, 0) as order_index, greatest(coalesce(score, 0), 0) as score from
  (select pq.*, row_number() over (partition by paper_id, coalesce(order_index, 0) order by id desc) as rn from paper_questions pq where question_id in (select id from questions) and paper_id in (select id from papers)) where rn = 1)"""


@query("ded1_curriculums", f"with {CURR} select id, question_id, version_code, chapter from curr")
def ded1_curriculums(spark: SparkSession, d: str) -> DataFrame:
    """DED1, JOIN3: the latest row per question and edition, orphans dropped."""
    return repair.clean_curriculums(table(spark, d, "question_curriculums"), table(spark, d, "questions")).select("id", "question_id", "version_code", "chapter")


@query("ded2_items", f"with {CLEAN} select * from clean")
def ded2_items(spark: SparkSession, d: str) -> DataFrame:
    """DED2, JOIN4: the latest item per paper and place."""
    t = [table(spark, d, x) for x in ("paper_questions", "papers", "questions")]
    return repair.clean_items(*t).select("id", "paper_id", "question_id", "order_index", "score")


@query("join9_totals", f"with {CLEAN} select p.id, cast(coalesce(s.s, 0) as integer) as total_score from papers p left join (select paper_id, sum(score) as s from clean group by 1) s on s.paper_id = p.id")
def join9_totals(spark: SparkSession, d: str) -> DataFrame:
    t = [table(spark, d, x) for x in ("paper_questions", "papers", "questions")]
    return repair.totals(t[1], repair.clean_items(*t)).select("id", "total_score")


@query("agg14_removed", f"with {CURR}, {CLEAN} select (select count(*) from question_curriculums) - (select count(*) from curr) as curriculums_removed, (select count(*) from paper_questions) - (select count(*) from clean) as items_removed")
def agg14_removed(spark: SparkSession, d: str) -> DataFrame:
    """Rows a repair takes away, before less after."""
    q, p, c, i = (table(spark, d, x) for x in ("questions", "papers", "question_curriculums", "paper_questions"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(c, "c0"), n(repair.clean_curriculums(c, q), "c1"), n(i, "i0"), n(repair.clean_items(i, p, q), "i1")]
    one = parts[0].withColumn("_k", F.lit(1))
    for x in parts[1:]:
        one = one.join(x.withColumn("_k", F.lit(1)), "_k")  # one row each
    return one.select((F.col("c0") - F.col("c1")).alias("curriculums_removed"), (F.col("i0") - F.col("i1")).alias("items_removed"))


@query("join8_edition", f"with {CURR} select q.id, coalesce(c.compulsory, '') as category_compulsory, coalesce(c.chapter, '') as category_chapter, coalesce(c.knowledge, '') as category_knowledge from questions q left join curr c on c.question_id = q.id and c.version_code = 'B'")
def join8_edition(spark: SparkSession, d: str) -> DataFrame:
    q = repair.with_edition(table(spark, d, "questions"), table(spark, d, "question_curriculums"), "B")
    return q.select("id", "category_compulsory", "category_chapter", "category_knowledge")


@query(
    "join14_membership",
    "select c.id, case when t.knowledge is not null then c.knowledge else '' end as knowledge from question_curriculums c left join (select distinct version_code, book, chapter, knowledge from curriculum_tree) t on t.version_code = c.version_code and t.book = c.compulsory and t.chapter = c.chapter and t.knowledge = c.knowledge",
)
def join14_membership(spark: SparkSession, d: str) -> DataFrame:
    """JOIN14, UPD2: knowledge that is no leaf of its chapter is blanked."""
    return repair.without_stale_leaves(table(spark, d, "question_curriculums"), table(spark, d, "curriculum_tree")).select("id", "knowledge")


@query(
    "join15_hierarchy",
    """with t as (select book, chapter, knowledge, min(book_ord * 1000000 + chapter_ord * 1000 + leaf_ord) as ord from curriculum_tree where version_code = 'A' group by 1, 2, 3),
    q as (select distinct category_compulsory as book, category_chapter as chapter, category_knowledge as knowledge from questions where category_compulsory <> '' and category_chapter <> '' and category_knowledge <> '')
    select book, chapter, knowledge, cast(ord as bigint) as ord from t union all select q.*, null as ord from q where not exists (select 1 from t where t.book = q.book and t.chapter = q.chapter and t.knowledge = q.knowledge)""",
)
def join15_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The predefined tree, completed by the triples in use; the tree keeps its order, others have none."""
    t = table(spark, d, "curriculum_tree").filter("version_code = 'A'")
    t = t.groupBy("book", "chapter", "knowledge").agg(F.min(F.expr("cast(book_ord as bigint) * 1000000 + chapter_ord * 1000 + leaf_ord")).alias("ord"))
    q = table(spark, d, "questions").select(F.col("category_compulsory").alias("book"), F.col("category_chapter").alias("chapter"), F.col("category_knowledge").alias("knowledge"))
    q = q.filter("book != '' and chapter != '' and knowledge != ''").distinct().join(t, ["book", "chapter", "knowledge"], "left_anti")
    return t.unionByName(q.withColumn("ord", F.lit(None).cast("long")))


@query("int1_orphans", "select 'question_curriculums' as name, id from question_curriculums where question_id not in (select id from questions) union all select 'paper_questions' as name, id from paper_questions where question_id not in (select id from questions) or paper_id not in (select id from papers)")
def int1_orphans(spark: SparkSession, d: str) -> DataFrame:
    q, p, c, i = (table(spark, d, x) for x in ("questions", "papers", "question_curriculums", "paper_questions"))
    a = repair.orphans(c, "question_id", q).select(F.lit("question_curriculums").alias("name"), "id")
    b = repair.orphans(i, "question_id", q).select("id").union(repair.orphans(i, "paper_id", p).select("id")).distinct()
    return a.unionByName(b.select(F.lit("paper_questions").alias("name"), "id"))


@query("int3_bad_image_json", "select id from questions where coalesce(image_paths, '') <> '' and not case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end")
def int3_bad_image_json(spark: SparkSession, d: str) -> DataFrame:
    """Values that are no JSON array fail a snapshot, unlike when they are shown."""
    bad = ~blank(F.col("image_paths")) & F.from_json("image_paths", "array<string>").isNull()
    return table(spark, d, "questions").filter(bad).select("id")


@query(
    "int5_rejected_papers",
    """with per as (select pq.paper_id, count(*) as n, count(distinct pq.question_id) as different, count(*) filter (where q.id is null) as unknown, count(*) filter (where not pq.score between 0 and 100) as range_ from paper_questions pq left join questions q on q.id = pq.question_id group by 1)
    select paper_id, 'too_many' as problem from per where n > 200 union all select paper_id, 'repeated' from per where different < n union all select paper_id, 'unknown' from per where unknown > 0 union all select paper_id, 'range' from per where range_ > 0""",
)
def int5_rejected_papers(spark: SparkSession, d: str) -> DataFrame:
    return repair.rejected_items(table(spark, d, "paper_questions"), table(spark, d, "questions"))


@query("int6_metadata", "select id, case when json_valid(metadata_json) then json_type(metadata_json) = 'OBJECT' else false end as is_object from papers where metadata_json is not null")
def int6_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Whether the metadata document is a JSON object."""
    ok = F.from_json("metadata_json", "map<string, string>").isNotNull()
    return table(spark, d, "papers").filter("metadata_json is not null").select("id", ok.alias("is_object"))


RENAMED = {"必修上册": "必修第一册", "必修下册": "必修第二册"}


@query("upd1_renamed", "select id, case category_compulsory when '必修上册' then '必修第一册' when '必修下册' then '必修第二册' else category_compulsory end as book from questions")
def upd1_renamed(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    return table(spark, d, "questions").select("id", F.coalesce(F.try_element_at(names, "category_compulsory"), "category_compulsory").alias("book"))


@query("upd5_leaf_default", "select id, case when coalesce(category_knowledge, '') = '' and coalesce(category_chapter, '') <> '' then category_chapter else category_knowledge end as knowledge from questions")
def upd5_leaf_default(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(blank(F.col("category_knowledge")) & ~blank(F.col("category_chapter")), F.col("category_chapter")).otherwise(F.col("category_knowledge"))
    return table(spark, d, "questions").select("id", k.alias("knowledge"))


@query("upd7_align", "select id, case when figure_align in ('right', 'center', 'bottom_right') then figure_align else 'right' end as figure_align from questions")
def upd7_align(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("figure_align")
    return table(spark, d, "questions").select("id", F.when(a.isin("right", "center", "bottom_right"), a).otherwise(F.lit("right")).alias("figure_align"))


@query(
    "txn3_deleted",
    """with gone as (select id from questions where difficulty is null), rest as (select * from paper_questions where question_id not in (select id from gone))
    select p.id, cast(coalesce(sum(r.score), 0) as bigint) as total, count(r.id) as n_items from papers p left join rest r on r.paper_id = p.id where p.id in (select paper_id from paper_questions where question_id in (select id from gone)) group by 1""",
)
def txn3_deleted(spark: SparkSession, d: str) -> DataFrame:
    """TXN3: papers touched by deleting questions, with their totals and items afterwards."""
    gone = table(spark, d, "questions").filter("difficulty is null").select(F.col("id").alias("question_id"), F.lit(True).alias("gone"))
    marked = table(spark, d, "paper_questions").join(gone, "question_id", "left")
    per = marked.groupBy(F.col("paper_id").alias("id")).agg(
        F.max("gone").alias("hit"), F.sum(F.when(F.col("gone").isNull(), F.col("score"))).alias("s"), F.count_if(F.col("gone").isNull()).alias("n_items")
    )
    kept = per.filter("hit").join(table(spark, d, "papers").select("id"), "id", "left_semi")
    return kept.select("id", F.coalesce("s", F.lit(0)).cast("long").alias("total"), "n_items")


@query(
    "txn4_associated",
    """with recursive g as (select id, association_group_id as g from questions where coalesce(association_group_id, '') <> ''),
    e as (select id as a, min(id) over (partition by g) as b from g union all select id as a, question_id as b from (select distinct pq1.question_id as id, pq2.question_id from paper_questions pq1 join paper_questions pq2 on pq1.paper_id = pq2.paper_id and pq2.order_index = 2 where pq1.order_index = 1)),
    u as (select a, b from e where a <> b union select b, a from e where a <> b),
    r as (select a as node, a as root from u union select u.b, r.root from r join u on u.a = r.node)
    select node as id, min(root) as group_id from r group by 1""",
)
def txn4_associated(spark: SparkSession, d: str) -> DataFrame:
    """TXN4: association groups after linking the first and the second item of every paper."""
    pq = table(spark, d, "paper_questions")
    first = pq.filter("order_index = 1").select("paper_id", F.col("question_id").alias("a"))
    second = pq.filter("order_index = 2").select("paper_id", F.col("question_id").alias("b"))
    return repair.associate(table(spark, d, "questions"), first.join(second, "paper_id").select("a", "b").distinct())


@query(
    "txn5_dissociated",
    """with m as (select id, case when usage_count > 12 then '' else coalesce(association_group_id, '') end as g from questions), n as (select g, count(*) as n from m where g <> '' group by 1)
    select m.id, case when n.n > 1 then m.g else '' end as association_group_id from m left join n on n.g = m.g""",
)
def txn5_dissociated(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    return repair.dissociate(q, q.filter("usage_count > 12").select("id"))


@query("set1_images_removed", "select id, len(list_distinct(list_filter(from_json(image_paths, '[\"VARCHAR\"]'), lambda x: not contains(x, '1')))) as n from questions where json_valid(image_paths) and json_type(image_paths) = 'ARRAY'")
def set1_images_removed(spark: SparkSession, d: str) -> DataFrame:
    """SET1: paths of the old list that are not in the new one, here the new one being those with a 1 in them."""
    old = F.from_json("image_paths", "array<string>")
    q = table(spark, d, "questions").select("id", old.alias("old")).filter("old is not null")
    return q.select("id", F.size(F.array_except("old", F.filter("old", lambda x: F.contains(x, F.lit("1"))))).cast("long").alias("n"))


@query("set3_same_sets", "with a as (select distinct question_id from paper_questions where question_id in (select id from questions)), b as (select id as question_id from questions where id in (select question_id from paper_questions)) select count(*) = 0 as same from (select * from a except select * from b union all (select * from b except select * from a))")
def set3_same_sets(spark: SparkSession, d: str) -> DataFrame:
    """SET3, INT2: two collections hold the same, by differences either way."""
    q = table(spark, d, "questions").select(F.col("id").alias("question_id"))
    used = table(spark, d, "paper_questions").select("question_id").distinct()
    a, b = used.join(q, "question_id", "left_semi"), q.join(used, "question_id", "left_semi")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("same"))


#: Words that route a question, in order; a group goes to the edition's first chapter that names its first word.
ROUTE_WORDS = [("集合",), ("不等式", "方程"), ("指数", "对数"), ("三角",), ("函数",), ("向量",), ("复数",), ("几何", "圆", "直线"), ("数列",), ("概率", "分布"), ("统计",)]


def _route_sql(target: str) -> str:
    """Book and chapter of the target edition by the first group of words that it knows."""
    first = "(select {c} from curriculum_tree where version_code = '" + target + "'{w} order by book_ord, chapter_ord limit 1)"
    cases = " ".join(f"when ({' or '.join(f'contains(t, {chr(39)}{x}{chr(39)})' for x in w)}) and {first.format(c='chapter', w=f' and contains(chapter, {chr(39)}{w[0]}{chr(39)})')} is not null then {{}}" for w in ROUTE_WORDS)
    column = lambda c: "case " + cases.format(*[first.format(c=c, w=f" and contains(chapter, '{w[0]}')") for w in ROUTE_WORDS]) + f" else {first.format(c=c, w='')} end"
    return f"{column('book')} as book, {column('chapter')} as chapter"


@query(
    "sca45_routes",
    f"""with d as (select distinct coalesce(category_compulsory, '') as a, coalesce(category_chapter, '') as b, coalesce(category_knowledge, '') as c from questions), t as (select *, a || ' ' || b || ' ' || c as t from d), r as (select a, b, c, {_route_sql('B')} from t)
    select r.a as compulsory, r.b as typed, r.c as leaf, r.book, r.chapter, case when exists (select 1 from curriculum_tree x where x.version_code = 'B' and x.book = r.book and x.chapter = r.chapter and x.knowledge = r.c) then r.c else '' end as knowledge from r""",
)
def sca45_routes(spark: SparkSession, d: str) -> DataFrame:
    """SCA45: the place of every triple of fields in edition B."""
    tree = table(spark, d, "curriculum_tree")
    rules, default = curriculum.word_rules(tree, "B", ROUTE_WORDS)
    triple = [F.coalesce(c, F.lit("")) for c in ("category_compulsory", "category_chapter", "category_knowledge")]
    rows = table(spark, d, "questions").select(*[c.alias(n) for c, n in zip(triple, ("compulsory", "typed", "leaf"), strict=True)]).distinct()
    rows = rows.withColumns({"book": F.col("compulsory"), "chapter": F.col("typed"), "knowledge": F.col("leaf")})
    return curriculum.routed(rows, rules, default, tree.filter("version_code = 'B'"), ("book", "chapter", "knowledge"))


@query(
    "upd3_switched",
    f"""with own as (select question_id, arg_max(coalesce(compulsory, chr(1)), id) as a, arg_max(coalesce(chapter, chr(1)), id) as b, arg_max(coalesce(knowledge, chr(1)), id) as c from question_curriculums where version_code = 'B' and question_id in (select id from questions) group by 1),
    m as (select id as question_id, coalesce(category_compulsory, '') || ' ' || coalesce(category_chapter, '') || ' ' || coalesce(category_knowledge, '') as t, coalesce(category_knowledge, '') as leaf from questions where id not in (select question_id from own)),
    r as (select question_id, leaf, {_route_sql('B')} from m)
    select question_id, 'B' as version_code, nullif(a, chr(1)) as compulsory, nullif(b, chr(1)) as chapter, nullif(c, chr(1)) as knowledge from own
    union all select question_id, 'B', book, chapter, case when exists (select 1 from curriculum_tree x where x.version_code = 'B' and x.book = r.book and x.chapter = r.chapter and x.knowledge = r.leaf) then leaf else '' end from r""",
)
def upd3_switched(spark: SparkSession, d: str) -> DataFrame:
    """UPD3: a switch to edition B: rows there are, and routed ones for the other questions."""
    tree = table(spark, d, "curriculum_tree")
    rules, default = curriculum.word_rules(tree, "B", ROUTE_WORDS)
    return curriculum.switched(table(spark, d, "questions"), table(spark, d, "question_curriculums"), "B", rules, default, tree.filter("version_code = 'B'"))


@query(
    "snk2_report",
    r"""with n as (select id, row_number() over (order by id) as seq_num, coalesce(nullif(category_compulsory, ''), '-') || ' / ' || coalesce(nullif(category_chapter, ''), '-') || ' / ' || coalesce(nullif(category_knowledge, ''), '-') as leaf,
      case question_type when 'single_choice' then '单选题' when 'multi_choice' then '多选题' when 'fill_in_blank' then '填空题' when 'detailed_answer' then '解答题' else coalesce(question_type, '') end as label, trim(regexp_replace(content, '\s*\n\s*', ' ', 'g')) as line from questions)
    select leaf, count(*) over (partition by leaf) as leaf_count, seq_num, id, label, line from n""",
)
def snk2_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK2, NUM1: the report by leaf, with ordinals, labels and counts."""
    return snapshots.report(table(spark, d, "questions"), LABELS)


@query("int4_missing_files", """with i as (select id, unnest(case when case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end then from_json(image_paths, '["VARCHAR"]') else [] end) as path from questions), h as (select distinct path from i where id % 2 = 0) select distinct path from i where path not in (select path from h)""")
def int4_missing_files(spark: SparkSession, d: str) -> DataFrame:
    """INT4: files that are referred to and aren't there; here the stored ones are those of half of the questions."""
    refs = table(spark, d, "questions").select("id", F.explode(F.from_json("image_paths", "array<string>")).alias("path"))
    held = refs.filter("id % 2 = 0").select(F.col("path").alias("id"))
    return repair.orphans(refs.select("path").distinct(), "path", held)


@query(
    "int7_readiness",
    "select (select count(*) from question_curriculums where question_id not in (select id from questions)) + (select count(*) from paper_questions where question_id not in (select id from questions)) + (select count(*) from paper_questions where paper_id not in (select id from papers)) as violations, 0 as missing_columns",
)
def int7_readiness(spark: SparkSession, d: str) -> DataFrame:
    """INT7: one row: references that lead nowhere, and columns the layout lacks."""
    t = {n: table(spark, d, n) for n in ("questions", "question_curriculums", "papers", "paper_questions")}
    return repair.readiness(t, {"questions": ["id", "content"], "papers": ["id", "title"]}, [("question_curriculums", "question_id", "questions"), ("paper_questions", "question_id", "questions"), ("paper_questions", "paper_id", "papers")])
