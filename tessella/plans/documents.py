"""Queries of the document pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.values import filled
from tessella.operators import documents
from tessella.registry import query
from tessella.sources.tables import table

PAGES = "pages as (select doc_id, unnest(range(len(l))) as page_index, unnest(l) as markdown from (select doc_id, string_split(text, chr(10) || chr(10)) as l from documents))"
LOST = r"""(trim(markdown, chr(32) || chr(9) || chr(10) || chr(13) || chr(12288)) = '' or regexp_matches(markdown, '\bA\.\s*B\.\s*C\.\s*D\.') or regexp_matches(markdown, '(设|已知|若|满足)\s*[，,]\s*([，,]\s*)*(为|满足|则|已知)') or (page_index % 5 >= 3 and length(markdown) - length(replace(markdown, '$', '')) < 4))"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the documents as their pages; every fifth and the one before as pages of many images."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page_index", "markdown"))
    return docs.withColumn("images", F.col("page_index") % 5).withColumn("needs_ocr", F.lit(False))


@query("doc1_routes", f"with {PAGES} select doc_id, cast(page_index as integer) as page_index, case when {LOST} then 'ocr' else 'native' end as route from pages")
def doc1_routes(spark: SparkSession, d: str) -> DataFrame:
    """DOC1, DOC2: the route of every page."""
    return documents.routed(pages(spark, d)).select("doc_id", "page_index", "route")


@query("doc3_types", f"with {PAGES}, r as (select doc_id, page_index, {LOST} as ocr from pages) select doc_id, case when count(*) filter (where ocr) = 0 then 'text_based' when count(*) filter (where ocr) = count(*) then 'scanned' else 'mixed' end as kind from r group by 1")
def doc3_types(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_types(documents.routed(pages(spark, d))).select("doc_id", "kind")


@query("doc5_merged", rf"with {PAGES}, t as (select doc_id, page_index, regexp_replace(markdown, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as t from pages) select doc_id, string_agg(t, chr(10) || chr(10) order by page_index) as markdown from t where t <> '' group by 1")
def doc5_merged(spark: SparkSession, d: str) -> DataFrame:
    return documents.merged(pages(spark, d))


ATTRIBUTION = """items as (select pq.paper_id as doc_id, pq.id as q, q.content, row_number() over (partition by pq.paper_id order by pq.id) - 1 as k from paper_questions pq join questions q on q.id = pq.question_id),
    pages as (select doc_id, k // 4 as page_index, string_agg(content, chr(10) order by k) as markdown from items group by 1, 2),
    qs as (select doc_id, q, regexp_replace(content, '[^一-龥a-zA-Z0-9]', '', 'g') as s from items), ps as (select doc_id, page_index, regexp_replace(markdown, '[^一-龥a-zA-Z0-9]', '', 'g') as s from pages),
    qg as (select distinct doc_id, q, substr(s, i, 3) as g from qs, unnest(range(1, greatest(length(s) - 1, 2))) t(i)), pg as (select distinct doc_id, page_index, substr(s, i, 3) as g from ps, unnest(range(1, greatest(length(s) - 1, 2))) t(i)),
    o as (select qg.doc_id, qg.q, pg.page_index, count(*) as n from qg join pg on pg.doc_id = qg.doc_id and pg.g = qg.g group by 1, 2, 3)"""


@query("doc4_attribution", f"with {ATTRIBUTION} select doc_id, q, cast(arg_max(page_index, n * 1000 - page_index) as integer) as page_index from o group by 1, 2")
def doc4_attribution(spark: SparkSession, d: str) -> DataFrame:
    """DOC4, JOIN16: items of every paper given to its pages of four items by shared shingles."""
    pq = table(spark, d, "paper_questions").select(F.col("paper_id").alias("doc_id"), F.col("id").alias("q"), "question_id")
    questions = table(spark, d, "questions").select(F.col("id").alias("question_id"), documents.letters_only(F.col("content")).alias("content"))
    # an item's letters stand in its own text and in its page's
    sizes = questions.select("question_id", (2 * F.coalesce(F.length("content"), F.lit(0)) + 2 * documents.ROW).alias("w"))
    weights = pq.join(sizes, "question_id").groupBy("doc_id").agg(F.sum("w").alias("w"))
    items = pq.join(questions, "question_id").repartition("doc_id")  # pages and items are made of the same shuffled rows
    items = items.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("q")) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "\n")
    paper_pages = items.groupBy("doc_id", F.floor(F.col("k") / 4).cast("int").alias("page_index")).agg(text.alias("markdown"))
    return documents.attributed(items.select("doc_id", "q", "content"), paper_pages, weights)


@query(
    "doc7_placeholders",
    """with p as (select paper_id, id, row_number() over (partition by paper_id order by id) as k from paper_questions), c as (select paper_id, question_id, row_number() over (partition by paper_id order by score, id) as k from paper_questions where order_index is not null)
    select p.paper_id, p.id, c.question_id from p left join c on c.paper_id = p.paper_id and c.k = p.k""",
)
def doc7_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """DOC7: the k-th placeholder beside the k-th crop; here a paper's items by id and by score."""
    pq = table(spark, d, "paper_questions")
    a = pq.select("paper_id", "id")
    b = pq.filter("order_index is not null").select("paper_id", "question_id", "score", F.col("id").alias("crop"))
    return documents.by_rank(a, b, "paper_id", ["id"], ["score", "crop"]).select("paper_id", "id", "question_id")


ASSETS = "img as (select distinct unnest(from_json(image_paths, '[\"VARCHAR\"]')) as path from questions where case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end)"


@query(
    "join13_assets",
    f"with {ASSETS}, r as (select 'FIGS\\' || upper(regexp_extract(path, '([^/]+)$', 1)) as ref from img), k as (select ref, lower(regexp_extract(replace(ref, '\\', '/'), '([^/]+)$', 1)) as b from r) select k.ref, img.path as asset from k join img on lower(regexp_extract(img.path, '([^/]+)$', 1)) = k.b",
)
def join13_assets(spark: SparkSession, d: str) -> DataFrame:
    """JOIN13: references in another case and with backslashes against stored paths."""
    img = table(spark, d, "questions").select(F.explode(F.from_json("image_paths", "array<string>")).alias("asset")).distinct()
    refs = img.select(F.concat(F.lit("FIGS\\"), F.upper(F.regexp_extract("asset", r"([^/]+)$", 1))).alias("ref"))
    return documents.matched_assets(refs, img)


@query(
    "doc12_only_match",
    f"with {ASSETS}, o as (select q.id, i.path from (select id, unnest(from_json(image_paths, '[\"VARCHAR\"]')) as path from questions where case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end) i join questions q on q.id = i.id) select path, min(id) as id from o group by 1 having count(distinct id) = 1",
)
def doc12_only_match(spark: SparkSession, d: str) -> DataFrame:
    """DOC12: graphics that belong to exactly one question."""
    owners = table(spark, d, "questions").select("id", F.explode(F.from_json("image_paths", "array<string>")).alias("path"))
    return documents.only_match(owners, "path", "id")


@query(
    "join11_orphan_assets",
    f"with {ASSETS} select path from img where path not in (select unnest(from_json(image_paths, '[\"VARCHAR\"]')) from questions where usage_count > 8 and case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end)",
)
def join11_orphan_assets(spark: SparkSession, d: str) -> DataFrame:
    """JOIN11, JOIN12: files that no kept question refers to."""
    every = table(spark, d, "questions").select("usage_count", F.explode(F.from_json("image_paths", "array<string>")).alias("path"))
    return every.select("path").distinct().join(every.filter("usage_count > 8").select("path"), "path", "left_anti")


_LISTED = "case when case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end then from_json(image_paths, '[\"VARCHAR\"]') else [] end"
_EVERY = rf"list_concat({_LISTED}, regexp_extract_all(coalesce(content, '') || ' ' || coalesce(answer_markdown, ''), '!\[[^\]]*\]\(([^)]+)\)', 1))"


@query(
    "doc16_images",
    rf"""with e as (select id, list_filter({_EVERY}, lambda x: not regexp_matches(trim(x), '[?#]|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.\.?(/|$)|//')) as l from questions), p as (select id, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(trim(x), '^/+', ''), '^(static/)?uploads/', '')), lambda x: x <> '') as l from e),
    d as (select id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from p) select id, unnest(l) as path, cast(generate_subscripts(l, 1) - 1 as bigint) as ord from d""",
)
def doc16_images(spark: SparkSession, d: str) -> DataFrame:
    return documents.collected_images(table(spark, d, "questions"))


@query(
    "doc17_candidates",
    "select id, question_type, difficulty, coalesce(usage_count, 0) as usage, coalesce(nullif(category_knowledge, ''), nullif(category_chapter, ''), '未分类') as topic, substr(replace(content, chr(10), ' '), 1, 80) as head from questions where category_compulsory = '必修上册'",
)
def doc17_candidates(spark: SparkSession, d: str) -> DataFrame:
    """DOC17: what a ranking model is shown of each candidate."""
    topic = filled(F.col("category_knowledge"), "")
    topic = F.when(topic != "", topic).otherwise(filled(F.col("category_chapter"), "未分类"))
    q = table(spark, d, "questions").filter("category_compulsory = '必修上册'")
    return q.select("id", "question_type", "difficulty", F.coalesce("usage_count", F.lit(0)).alias("usage"), topic.alias("topic"), F.substring(F.replace("content", F.lit("\n"), F.lit(" ")), 1, 80).alias("head"))


@query("doc11_estimates", "select p.id, p.total_score, count(pq.id) as n from papers p left join paper_questions pq on pq.paper_id = p.id group by 1, 2 having count(pq.id) * 5 <> p.total_score")
def doc11_estimates(spark: SparkSession, d: str) -> DataFrame:
    """DOC11: papers whose estimate, five a point, differs from what is there."""
    n = table(spark, d, "paper_questions").groupBy(F.col("paper_id").alias("id")).agg(F.count("id").alias("n"))
    p = table(spark, d, "papers").select("id", "total_score").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return p.filter(F.col("n") * 5 != F.col("total_score"))


@query(
    "doc10_lock_report",
    r"""with l as (select id as doc_id, len(regexp_extract_all(content, '\$[^$]+\$')) as n, regexp_matches(content, '^[^$]*\$[^$]+\$') and not contains(regexp_extract(content, '^[^$]*\$[^$]+\$'), '<') as opens from questions)
    select doc_id, n as created, case when doc_id % 3 = 0 and opens then 1 else 0 end as missing, 0 as duplicated from l where n > 0""",
)
def doc10_lock_report(spark: SparkSession, d: str) -> DataFrame:
    """DOC9, DOC10: formulas of every stem locked, a third of the stems spoilt, and what the report says."""
    from tessella.functions.parsers import lock_formulas

    q = table(spark, d, "questions").select(F.col("id").alias("doc_id"), lock_formulas("content", F.col("id").cast("string")).alias("l"))
    locks = q.select("doc_id", F.explode("l.locks").alias("x")).select("doc_id", "x.lock_id")
    spoilt = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("l.locked", r"^[^<]*<math-lock[^>]*>[^<]*</math-lock>", "")).otherwise(F.col("l.locked"))
    return documents.lock_report(locks, q.select("doc_id", spoilt.alias("t")))


@query("doc10_restored", "select id as doc_id, case when id % 5 <> 4 or not regexp_matches(content, '[$][^$]+[$]') then content end as t, id % 5 = 4 and regexp_matches(content, '[$][^$]+[$]') as refused from questions")
def doc10_restored(spark: SparkSession, d: str) -> DataFrame:
    """DOC10: the stems of all questions locked, some marks edited or made short, one repeated, and put back."""
    from tessella.functions.parsers import lock_formulas

    q = table(spark, d, "questions").select(F.col("id").alias("doc_id"), lock_formulas("content", F.col("id").cast("string")).alias("l"))
    locks = q.select("doc_id", F.explode("l.locks").alias("x")).select("doc_id", "x.*")
    text, kind = F.col("l.locked"), F.col("doc_id") % 5
    mark = r'<math-lock id="([^"]*)">[\s\S]*?</math-lock>'
    sent = F.when(kind == 1, F.regexp_replace(text, mark, "[[ $1 ]]")).when(kind == 2, F.regexp_replace(text, mark, '<math-lock id="$1">edited</math-lock>'))
    sent = sent.when(kind == 4, F.concat(text, F.coalesce(F.concat(F.lit("[["), F.nullif(F.regexp_extract(text, mark, 1), F.lit("")), F.lit("]]")), F.lit("")))).otherwise(text)
    back = documents.restored_documents(q.select("doc_id", F.lit(0).alias("pos"), sent.alias("t")), locks)
    return back.select("doc_id", "t", F.col("error").isNotNull().alias("refused"))
