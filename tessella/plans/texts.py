"""Queries of the text functions over stems, answers and titles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import items, latex
from tessella.functions.values import py_strip
from tessella.registry import query
from tessella.sources.tables import table

STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


@query(
    "sca1_gap_macro",
    r"""select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(content, '\fillin', '\underline{x}____'), '_{3,}', '\\fillin', 'g'), '\\fillin\s*\[[^\]]*\](\[[^\]]*\])?', '\\fillin', 'g'), '\\underline\s*\{[^}]*\}', '\\fillin', 'g'), '\\fillin\}', '\\fillin', 'g') as content from questions where contains(content, '\fillin')""",
)
def sca1_gap_macro(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace("content", F.lit("\\fillin"), F.lit("\\underline{x}____"))
    return q(spark, d).filter(F.contains("content", F.lit("\\fillin"))).select("id", latex.fill_in_macro(raw).alias("content"))


@query("sca2_structured_form", r"""select id, case when regexp_matches(content, '(?i)\\begin\s*\{\s*choices\s*\}') then 'choice' when regexp_matches(content, '(?i)\\fillin([^0-9A-Za-z_\p{L}\p{N}]|$)') then 'fill_in_blank' end as form from questions""")
def sca2_structured_form(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.structured_form(F.col("content")).alias("form"))


@query("sca3_named_form", "select question_type, case when lower(trim(question_type)) in ('choice','choice_question','single_choice','multi_choice','选择题','单选题','多选题') then 'choice' when lower(trim(question_type)) in ('fill_in_blank','fill-in-blank','填空题') then 'fill_in_blank' when lower(trim(question_type)) in ('detailed_answer','解答题') then 'detailed_answer' else 'unknown' end as form, count(*) as n from questions group by 1, 2")
def sca3_named_form(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).groupBy("question_type", latex.named_form(F.col("question_type")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("sca4_whole_stems")
def sca4_whole_stems(spark: SparkSession, d: str) -> DataFrame:
    """SCA4: every stem without the empty brackets at its end."""
    return q(spark, d).select("id", latex.choice_stem(F.col("content")).alias("stem"))


@query("sca6_paragraphs", f"""with l as (select id, unnest(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {STRIP.format(c='x')})) as line, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) as k from questions),
    m as (select *, lag(line) over (partition by id order by k) as before from l), f as (select *, row_number() over (partition by id order by k) as n from m where line <> '')
    select q.id, coalesce(x.content, '') as content from questions q left join (select id, string_agg(case when n = 1 then '' when before = '' or regexp_matches(line, '{latex.SUB_START}') or regexp_matches(line, '{latex.BLOCK_START}') then chr(10) || chr(10) else ' ' end || line, '' order by k) as content from f group by id) x on x.id = q.id""")
def sca6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.stem_paragraphs(F.col("content")).alias("content"))


_ITEMS = "list_filter(list_transform(string_split(split_part(p, '\\end{choices}', 1), '\\item'), lambda y: " + STRIP.format(c="y") + "), lambda y: y <> '')"
_LISTED = f"array_to_string(list_transform(string_split(coalesce(content, ''), '\\begin{{choices}}'), lambda p, k: case when k = 1 then p when contains(p, '\\end{{choices}}') then chr(10) || array_to_string(list_transform({_ITEMS}, lambda y, n: '- ' || case when n <= 8 then chr(64 + cast(n as integer)) else cast(n as varchar) end || '. ' || y), chr(10)) || chr(10) || substr(p, instr(p, '\\end{{choices}}') + 13) else '\\begin{{choices}}' || p end), '')"
_MARKDOWN = _LISTED
for _p, _t in (
    (r"\\(?:begin|end)\{(?:itemize|enumerate|center)\}", "\n"), (r"\\item\s*\[([A-Za-z0-9.()\s一-龥]+)\]", r"- \1 "), (r"\\item", "- "), (r"\\underline\s*\{(?:\\hspace\s*\{[^{}]*\}|[^{}])*\}", "_______"),
    (r"\\underline", "_______"), (r"_______\}", "_______"), (r"\\\\+", "\n"), (r"(?m)\\$", ""), (r"\n{3,}", "\n\n"),
):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_p}', '{_t}', 'g')"


@query("sca8_markdown", f"select id, {STRIP.format(c=_MARKDOWN)} as content from questions")
def sca8_markdown(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.to_markdown(F.col("content")).alias("content"))


_SUBS = "regexp_replace(regexp_replace(" + STRIP.format(c="content") + f", '(?:[。；;!！.]\\s*|\\s+)({latex.SUB_LABEL})({latex.SUB_BODY})', chr(10) || chr(10) || '\\1 \\2', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"


@query("sca9_subquestions", f"select id, {STRIP.format(c=_SUBS)} as content from questions")
def sca9_subquestions(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.subquestion_paragraphs(F.col("content")).alias("content"))


@query("sca10_literal_breaks", r"select id, replace(replace(regexp_replace(replace(content, chr(10), '\n'), '\\n([a-zA-Z])', chr(1) || '\1', 'g'), '\n', chr(10)), chr(1), '\n') as content from questions")
def sca10_literal_breaks(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.literal_breaks(F.replace("content", F.lit("\n"), F.lit("\\n"))).alias("content"))


@query("sca11_source_prefix", r"select id, regexp_extract(coalesce(content, ''), '^(\s*(\d+[.、\s]*)?)([(（])([^(（)）\s]{4,})([)）])', 4) as source from questions")
def sca11_source_prefix(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.source_prefix(F.col("content")).alias("source"))


@query(
    "sca12_title",
    r"""with p as (select id, regexp_replace(coalesce(title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as t from papers), w as (select id, left(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 60) as t, t as raw from p)
    select id, case id % 4 when 0 then t when 1 then case when t <> '' and not contains(raw, '页') and not contains(raw, '绝密') then t else 'b' end when 2 then case when t <> '' then t else 'second' end else '' end as title from w""",
)
def sca12_title(spark: SparkSession, d: str) -> DataFrame:
    """SCA12: titles in four shapes: command, page head, centred block, none."""
    t = py_strip(F.coalesce("title", F.lit("")))
    block = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    shape = F.col("id") % 4
    doc = F.when(shape == 0, block("\\title {", t, "}")).when(shape == 1, block("\\chead{", t, "}\n\\begin{center}\\Large b \\\\ c\\end{center}"))
    doc = doc.when(shape == 2, block("x\n\\begin{center}\n\\heiti ", t, " \\\\ second\\end{center}")).otherwise(block("plain ", t))
    return table(spark, d, "papers").select("id", latex.latex_title(doc).alias("title"))


@query(
    "sca19_page_range",
    "select id, case id % 4 when 0 then range(0, 20) when 1 then list_sort(list_distinct(list_concat(range(0, 2), range(cast(id % 5 as integer) + 1, cast(id % 5 as integer) + 4)))) when 2 then [id % 7] else list_sort(list_distinct(list_concat([19], range(4, 9), [id % 6]))) end as pages from papers",
)
def sca19_page_range(spark: SparkSession, d: str) -> DataFrame:
    """SCA19: every page, ranges that overlap, one page, and parts out of order and repeated."""
    i, text = F.col("id"), lambda c: c.cast("int").cast("string")
    wanted = F.when(i % 4 == 0, " ").when(i % 4 == 1, F.concat(F.lit("1-2, "), text(i % 5 + 2), F.lit("-"), text(i % 5 + 4))).when(i % 4 == 2, text(i % 7 + 1))
    wanted = wanted.otherwise(F.concat(F.lit("20,5-9,"), text(i % 6 + 1), F.lit(",7")))
    return table(spark, d, "papers").select("id", F.transform(latex.page_range(wanted, F.lit(20)), lambda x: x.cast("long")).alias("pages"))


@query(
    "sca20_version",
    "select id, cast(case id % 5 when 4 then 0 when 3 then 0 else id % 4 end as integer) as major, cast(case when id % 5 < 2 then id % 10 else 0 end as integer) as minor, cast(case id % 5 when 0 then id % 3 else 0 end as integer) as patch from papers",
)
def sca20_version(spark: SparkSession, d: str) -> DataFrame:
    """SCA20: whole versions with suffixes, short ones, none, and no number."""
    i, text = F.col("id"), lambda c: c.cast("string")
    v = F.when(i % 5 == 0, F.concat(F.lit("v"), text(i % 4), F.lit("."), text(i % 10), F.lit("."), text(i % 3), F.lit("-beta+7"))).when(i % 5 == 1, F.concat(F.lit(" V"), text(i % 4), F.lit("."), text(i % 10), F.lit("+b.9")))
    v = v.when(i % 5 == 2, text(i % 4)).when(i % 5 == 3, F.lit("dev"))
    return table(spark, d, "papers").select("id", latex.version_tuple(v).alias("v")).select("id", "v.*")


@query("sca23_token_estimate", r"with c as (select id, length(content) as n, length(regexp_replace(content, '[^\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) as cjk from questions) select id, greatest(1, cast(floor(cjk * 1.2::double + (n - cjk) / 4.0::double + 0.99::double) as bigint)) as n_tokens from c")
def sca23_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.token_estimate(F.col("content")).alias("n_tokens"))


@query("sca24_date", "select id, coalesce(strftime(created_at, '%Y年') || month(created_at) || '月' || day(created_at) || '日 ' || hour(created_at) || '时' || minute(created_at) || '分', '未知时间') as created from papers")
def sca24_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", latex.chinese_date(F.col("created_at")).alias("created"))


LABELS = {"single_choice": "单选题", "multi_choice": "多选题", "fill_in_blank": "填空题", "detailed_answer": "解答题"}


@query("sca25_labels", "select id, case question_type when 'single_choice' then '单选题' when 'multi_choice' then '多选题' when 'fill_in_blank' then '填空题' when 'detailed_answer' then '解答题' else question_type end as label from questions")
def sca25_labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    return q(spark, d).select("id", F.coalesce(F.try_element_at(names, "question_type"), "question_type").alias("label"))


_INNER = r"list_transform(regexp_extract_all(content, '\$([^$]+)\$', 1), lambda x: " + STRIP.format(c=r"regexp_replace(regexp_replace(regexp_replace(" + STRIP.format(c="x") + r", '\\lt\s*', '<', 'g'), '\\gt\s*', '>', 'g'), '\\(displaystyle|textstyle|scriptstyle|scriptscriptstyle)\b', '', 'g')") + ")"


@query("sca36_formulas", f"with f as (select id, {_INNER} as l from questions) select id, list_filter(l, lambda x, i: list_position(l, x) = i) as formulas from f")
def sca36_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The different formulas of every stem, without signs and style commands."""
    found = F.regexp_extract_all("content", F.lit(r"\$([^$]+)\$"), F.lit(1))
    return q(spark, d).select("id", F.array_distinct(F.transform(found, latex.formula)).alias("formulas"))


_PLAIN = (
    (r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", ""), (r"\\begin\{tikzpicture\}[\s\S]*?\\end\{tikzpicture\}", ""), (r"\\(?:begin|end)\{(?:center|table|figure)\}", ""), (r"\\centering\b", ""),
    (r"\\(?:textbf|mathbf|mathrm|operatorname)\{([^{}]*)\}", r"\1"), (r"\\(?:quad|qquad)\b|\\[,;!]", " "), (r"\\%", "%"), (r"\\_", "_"), (r"\\\\", "\n"),
)


def _chain(column: str, *steps: tuple[str, str]) -> str:
    """The replacements one after the other."""
    c = f"coalesce({column}, '')"
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"select id, {c} as text from questions"


@query("sca34_plain_text", _chain("content", *_PLAIN))
def sca34_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.plain_text(F.col("content")).alias("text"))


@query("agg15_formula_counts", r"select id, len(list_distinct(regexp_extract_all(content, '\$([^$]+)\$', 1))) as n_formulas from questions")
def agg15_formula_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG15: different formulas of a stem."""
    found = F.regexp_extract_all("content", F.lit(r"\$([^$]+)\$"), F.lit(1))
    return q(spark, d).select("id", F.size(F.array_distinct(found)).cast("long").alias("n_formulas"))


FIRST_OF = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_DRAWN = r"regexp_extract_all(content, '\\begin\{tikzpicture\}[\s\S]*?\\end\{tikzpicture\}')"
_MARKED = r"regexp_extract_all(content, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1)"
_DIRECT = r"regexp_extract_all(content, '\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}', 1)"


@query("sca37_all_figures", f"with f as (select id, {_DRAWN} as drawn, list_concat(list_filter({_MARKED}, lambda x: len({_DRAWN}) = 0 or not starts_with(string_split(x, '/')[-1], 'tikz_')), {_DIRECT}) as l from questions) select id, list_concat(drawn, {FIRST_OF.format(l='l')}) as figures from f")
def sca37_all_figures(spark: SparkSession, d: str) -> DataFrame:
    """SCA37: drawings and images of every stem in order."""
    return q(spark, d).select("id", latex.figures_and_drawings(F.col("content")).alias("figures"))


@query("sca38_align", "select p.id, q.id as question_id, case when p.paper_type = 'quiz' then 'bottom_right' when q.id % 3 > 1 and q.figure_align = 'right' then 'center' else q.figure_align end as align from papers p join paper_questions pq on pq.paper_id = p.id join questions q on q.id = pq.question_id where pq.order_index = 1")
def sca38_align(spark: SparkSession, d: str) -> DataFrame:
    pq = table(spark, d, "paper_questions").filter("order_index = 1").select("paper_id", "question_id")
    both = pq.join(table(spark, d, "papers").select(F.col("id").alias("paper_id"), "paper_type"), "paper_id").join(q(spark, d).select(F.col("id").alias("question_id"), "figure_align"), "question_id")
    return both.select(F.col("paper_id").alias("id"), "question_id", latex.figure_align(F.col("figure_align"), F.col("paper_type"), F.col("question_id") % 3).alias("align"))


@query("sca39_space", "select id, case when figure_align in ('center', 'bottom_right') then round(greatest(usage_count / 2.0::double - 3.2::double, 0.5::double), 1) else round(usage_count / 2.0::double, 1) end as space from questions where usage_count is not null")
def sca39_space(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).filter("usage_count is not null").select("id", latex.net_space(F.col("usage_count") / 2.0, F.coalesce("figure_align", F.lit(""))).alias("space"))


@query(
    "sca42_effort",
    "select id, case id % 6 when 5 then '' when 4 then 'm(x)' || id else 'model-' || id end as model, case id % 6 when 0 then 'high' when 1 then 'xhigh' when 2 then 'low' end as effort from papers",
)
def sca42_effort(spark: SparkSession, d: str) -> DataFrame:
    """SCA42: efforts in brackets and behind a colon, none, brackets that are no effort, and no model."""
    i = F.col("id")
    name = F.concat(F.lit("model-"), i.cast("string"))
    m = F.when(i % 6 == 0, F.concat(name, F.lit("(High)"))).when(i % 6 == 1, F.concat(F.lit(" "), name, F.lit(" : XHIGH"))).when(i % 6 == 2, F.concat(name, F.lit(":low"))).when(i % 6 == 3, name)
    m = m.when(i % 6 == 4, F.concat(F.lit("m(x)"), i.cast("string")))
    return table(spark, d, "papers").select("id", latex.model_and_effort(m).alias("m")).select("id", "m.*")


@query("sca44_assets", "with p as (select id, unnest(from_json(image_paths, '[\"VARCHAR\"]')) as path from questions where case when json_valid(image_paths) then json_type(image_paths) = 'ARRAY' else false end) select id, ltrim(path, '/') as path from p where not contains(path, '?')")
def sca44_assets(spark: SparkSession, d: str) -> DataFrame:
    p = q(spark, d).select("id", F.explode(F.from_json("image_paths", "array<string>")).alias("path")).select("id", latex.safe_asset(F.col("path")).alias("path"))
    return p.filter("path is not null")


@query(
    "sca48_envelope",
    "select id, case id % 4 when 0 then '{\"id\": ' || id || ', \"tags\": []}' when 1 then '[{\"id\": ' || id || '}, 2]' when 2 then 'no ' || id else '{' || id end as body from papers",
)
def sca48_envelope(spark: SparkSession, d: str) -> DataFrame:
    """SCA48: objects and arrays in fences and talk, no bracket at all, and one that never closes."""
    i, t = F.col("id"), F.col("id").cast("string")
    said = F.when(i % 4 == 0, F.concat(F.lit('```json\nHere: {"id": '), t, F.lit(', "tags": []} done\n```'))).when(i % 4 == 1, F.concat(F.lit('```\n[{"id": '), t, F.lit("}, 2] or {x}\n```")))
    said = said.when(i % 4 == 2, F.concat(F.lit(" no "), t)).otherwise(F.concat(F.lit("{"), t))
    return table(spark, d, "papers").select("id", latex.json_envelope(said).alias("body"))


@query("sca52_gated_answers", "select id, case when contains(answer_markdown, '[EXTRACTED_ORIGINAL]') then trim(replace(answer_markdown, '[EXTRACTED_ORIGINAL]', '')) else '' end as answer from questions where answer_markdown is not null")
def sca52_gated_answers(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).filter("answer_markdown is not null").select("id", latex.gated_answer(F.col("answer_markdown")).alias("answer"))


@query("sca53_file_names", r"""select id, case when trim(regexp_replace(coalesce(title, ''), '[/\\?%*:|"<>]', '_', 'g')) = '' then 'paper' else trim(regexp_replace(coalesce(title, ''), '[/\\?%*:|"<>]', '_', 'g')) end as name from papers""")
def sca53_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", latex.file_name(F.col("title")).alias("name"))


@query(
    "sca55_crops",
    """with c as (select id, case when id % 7 = 0 then -1.0::double else id % 40 end as l, id % 30 / 2.0::double as t, id % 40 + 50 + case when id % 9 = 0 then 60 else 0 end as r, case when id % 11 = 0 then 'nan'::double else id % 30 + 60.5::double end as b from papers)
    select id, cast(case when ok then floor(l / 100 * 1000) end as integer) as x0, cast(case when ok then floor(t / 100 * 800) end as integer) as y0, cast(case when ok then floor(r / 100 * 1000) end as integer) as x1, cast(case when ok then floor(b / 100 * 800) end as integer) as y1
    from (select *, l >= 0 and r <= 100 and l < r and t >= 0 and b <= 100 and t < b and not isnan(b) as ok from c)""",
)
def sca55_crops(spark: SparkSession, d: str) -> DataFrame:
    """SCA55: all corners of crops in percent; those out of range or not a number have none."""
    i = F.col("id")
    left = F.when(i % 7 == 0, F.lit(-1.0)).otherwise((i % 40).cast("double"))
    right = (i % 40 + 50 + F.when(i % 9 == 0, 60).otherwise(0)).cast("double")
    bottom = F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(i % 30 + F.lit(60.5))
    return table(spark, d, "papers").select("id", latex.crop_box(left, (i % 30) / 2.0, right, bottom, F.lit(1000), F.lit(800)).alias("c")).select("id", "c.*")


@query("sca56_hashes", "select id, sha256(content) as sha, md5(content) as md5 from questions")
def sca56_hashes(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", F.sha2("content", 256).alias("sha"), F.md5("content").alias("md5"))


@query("sca57_balanced", r"select id, length(replace(regexp_replace(content, '\\[{}]', '', 'g'), '{', '')) = length(replace(regexp_replace(content, '\\[{}]', '', 'g'), '}', '')) as balanced from questions")
def sca57_balanced(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", latex.balanced(F.col("content")).alias("balanced"))


@query("sca58_escaped", r"select id, replace(replace(replace(source, '%', '\%'), '&', '\&'), '_', '\_') as source from questions where source is not null")
def sca58_escaped(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).filter("source is not null").select("id", latex.escaped_text(F.col("source")).alias("source"))


@query("sca35_choices", r"select id, len(list_filter(list_transform(string_split_regex(regexp_extract(content, '\\begin\{choices\}([\s\S]*?)\\end\{choices\}', 1), '\\item\b'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')) as n_choices from questions where contains(content, '\begin{choices}')")
def sca35_choices(spark: SparkSession, d: str) -> DataFrame:
    """SCA35: options of the stems with a choices environment."""
    c = q(spark, d).filter(F.contains("content", F.lit("\\begin{choices}")))
    return c.select("id", F.size(items.question_parts(F.col("content"))["choices"]).cast("long").alias("n_choices"))


_OPTION = r"^\s*[-*]?\s*[A-D][.、]\s*(.*)$"
_CHOICES = r"\\begin\{choices\}([\s\S]*?)\\end\{choices\}"
_PARTS = f"""with c as (select id, coalesce(content, '') as c from questions), e as (select id, c, regexp_matches(c, '{_CHOICES}') as env, string_split(c, chr(10)) as lines from c),
    p as (select id, case when env then regexp_replace(c, '{_CHOICES}', '', 'g') else array_to_string(list_filter(lines, lambda x: not regexp_matches(x, '{_OPTION}')), chr(10)) end as s,
      case when env then list_filter(list_transform(string_split_regex(regexp_extract(c, '{_CHOICES}', 1), '\\\\item\\b'), lambda x: {STRIP.format(c='x')}), lambda x: x <> '') else list_transform(list_filter(lines, lambda x: regexp_matches(x, '{_OPTION}')), lambda x: {STRIP.format(c="regexp_extract(x, '" + _OPTION + "', 1)")}) end as choices from e),
    w as (select *, coalesce(list_max(list_transform(choices, lambda x: length(x))), 0) as longest from p)
    select id, {STRIP.format(c=r"regexp_replace(regexp_replace(" + STRIP.format(c="s") + r", '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', '', 'g'), '\\begin\{tikzpicture\}[\s\S]*?\\end\{tikzpicture\}', '', 'g')")} as stem, choices, cast(case when len(choices) <= 4 and longest <= 10 then 4 when longest <= 24 then 2 else 1 end as integer) as columns from w"""


@query("sca35_parts", _PARTS)
def sca35_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every stem without options and images, its options, and the columns they are set in."""
    return q(spark, d).select("id", items.question_parts(F.col("content")).alias("p")).select("id", "p.*", items.choice_columns(F.col("p.choices")).alias("columns"))


_QUIET = r"replace(regexp_replace(replace(regexp_replace(content, '\\[!,]', '', 'g'), '![', chr(1)), '[!！]', '', 'g'), chr(1), '![')"
_NUMBERED = f"regexp_replace({STRIP.format(c=_QUIET)}, '{items.NUMBERING}', '')"


@query("sca21_ocr_text", f"select id, {STRIP.format(c=_NUMBERED)} as content from questions")
def sca21_ocr_text(spark: SparkSession, d: str) -> DataFrame:
    return q(spark, d).select("id", items.ocr_text(F.col("content")).alias("content"))


@query("sca46_editions", "select version_code, case when contains(string_agg(chapter, ' '), '第一章') then 'B' when contains(string_agg(chapter, ' '), '第1章') then 'S' else 'A' end as edition from curriculum_tree group by 1")
def sca46_editions(spark: SparkSession, d: str) -> DataFrame:
    """SCA46: the edition each tree's chapter names point to; a tree is a bounded list."""
    t = table(spark, d, "curriculum_tree").groupBy("version_code").agg(F.collect_set("chapter").alias("c"))
    return t.select("version_code", items.edition_of(F.col("c")).alias("edition"))


REQUESTS = ("{t}", "来三道填空题 {t}", "12道单选 {t}", "{t} 解答题 十道", "九道 多选，复数与导数")


def _request_sql() -> str:
    made = " ".join(f"when {k} then " + " || ".join(["''"] + [("coalesce(title, '')" if x == "{t}" else f"'{x}'") for x in re.split(r"(\{t\})", r) if x]) for k, r in enumerate(REQUESTS))
    topics = ", ".join(f"case when contains(s, '{t}') then '{t}' end" for t in items.TOPICS)
    kinds = " ".join(f"when contains(s, '{w}') then '{t}'" for w, t in items.TYPE_WORDS)
    review = " or ".join(f"contains(s, '{w}')" for w in items.REVIEW_WORDS)
    number = "regexp_extract(s, '([一二三四五六七八九十1-9]+)\\s*道', 1)"
    value = f"case when regexp_matches({number}, '^[1-9]{{1,9}}$') then cast({number} as integer) when length({number}) = 1 then instr('{items.COUNT_WORDS}', {number}) end"
    return f"""with r as (select id, case id % {len(REQUESTS)} {made} end as s from papers), n as (select *, {value} as v from r)
    select id, cast(case when v > 0 then v else 5 end as integer) as n, case {kinds} end as question_type, list_filter([{topics}], lambda x: x is not null) as topics, {review} as review from n"""


@query("sca47_intents", _request_sql())
def sca47_intents(spark: SparkSession, d: str) -> DataFrame:
    """SCA47: requests with counts in digits and words, types and topics, around paper titles."""
    made = F.lit(None).cast("string")
    for k, r in enumerate(REQUESTS):
        parts = [F.coalesce("title", F.lit("")) if x == "{t}" else F.lit(x) for x in re.split(r"(\{t\})", r) if x]
        made = F.when(F.col("id") % len(REQUESTS) == k, F.concat(*parts)).otherwise(made)
    return table(spark, d, "papers").select("id", items.intent(made).alias("i")).select("id", F.col("i.limit").alias("n"), "i.question_type", "i.topics", "i.review")