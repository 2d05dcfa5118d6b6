"""Queries of the readers: Word files, formulas and uploads made from the tables and read again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import counts
from tessella.registry import query
from tessella.sources import readers
from tessella.sources.tables import table

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MATH = "http://schemas.openxmlformats.org/officeDocument/2006/math"
NUMBERING = (
    f'<w:numbering xmlns:w="{WORD}"><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:start w:val="2"/><w:numFmt w:val="upperLetter"/></w:lvl></w:abstractNum>'
    '<w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="3"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="4"/></w:num></w:numbering>'
)


def _word(key: int, total: int | None) -> bytes:
    """A Word file: a bold line, two lettered items from B on, a bullet, a formula, a table of two rows."""
    item = lambda n, t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    formula = f"<m:oMath><m:f><m:num><m:r><m:t>{key}</m:t></m:r></m:num><m:den><m:r><m:t>α</m:t></m:r></m:den></m:f></m:oMath>"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>P{key}</w:t></w:r></w:p>{item(1, 'x')}{item(1, key)}{item(2, 'y')}<w:p>{formula}</w:p><w:tbl><w:tr>{cell('k')}{cell('n')}</w:tr><w:tr>{cell(key)}{cell(total if total is not None else '-')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}" xmlns:m="{MATH}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/numbering.xml", NUMBERING)
    return out.getvalue()


def word_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a Word file for every paper, and one that is none."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [b"no archive" if k % 50 == 7 else _word(int(k), None if pd.isna(n) else int(n)) for k, n in zip(b["id"], b["total_score"], strict=True)]
            yield pd.DataFrame({"path": "paper-" + b["id"].astype(str) + ".docx", "content": content})

    return table(spark, d, "papers").select("id", "total_score").mapInPandas(make, "path string, content binary")


@query(
    "src5_word_papers",
    r"""with n as (select id, chr(10) || chr(10) as nl, id % 50 = 7 as bad from papers), t as (select id, coalesce(cast(total_score as varchar), '-') as s from papers)
    select 'paper-' || n.id || '.docx' as path, case when not bad then '**P' || n.id || '**' || nl || 'B. x' || nl || 'C. ' || n.id || nl || '- y' || nl || '$\dfrac{' || n.id || '}{\alpha}$' || nl || '| k | n |' || chr(10) || '|---|---|' || chr(10) || '| ' || n.id || ' | ' || s || ' |' end as markdown, bad as failed from n join t on t.id = n.id""",
)
def src5_word_papers(spark: SparkSession, d: str) -> DataFrame:
    """SRC4, SRC5, NUM4: Word files as Markdown with list numbers, formulas and tables; broken ones as errors."""
    return readers.word_documents(word_files(spark, d)).select("path", "markdown", F.col("error").isNotNull().alias("failed"))


@query(
    "agg13_reader_counts",
    "select name, cast(n * k as bigint) as total from (select count(*) filter (where id % 50 <> 7) as n from papers), (values ('paragraphs', 5), ('list_items', 3), ('formulas', 1), ('tables', 1), ('review', 0)) v(name, k)",
)
def agg13_reader_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG13: the readers' counters added up over all files."""
    return counts.summed(readers.word_documents(word_files(spark, d)), "counts")


@query("src8_unsafe_members", "select 'paper-' || id || '.docx' as path, 'no archive' as problem from papers where id % 50 = 7")
def src8_unsafe_members(spark: SparkSession, d: str) -> DataFrame:
    """SRC8: archives that break a limit; here those that are none."""
    return readers.unsafe_members(word_files(spark, d)).select("path", "problem")


@query(
    "sca30_office_formulas",
    r"select id, case id % 4 when 0 then '\dfrac{' || id || '}{x}' when 1 then '\sqrt[3]{' || id || '}' when 2 then '{x}_{' || id || '}^{2}' end as latex, id % 4 = 3 as failed from questions",
)
def sca30_office_formulas(spark: SparkSession, d: str) -> DataFrame:
    """SCA30: Office formulas of three kinds, and XML that isn't finished."""
    run = lambda t: F.concat(F.lit("<m:r><m:t>"), t, F.lit("</m:t></m:r>"))
    n, kind = run(F.col("id").cast("string")), F.col("id") % 4
    part = lambda tag, c: F.concat(F.lit(f"<m:{tag}>"), c, F.lit(f"</m:{tag}>"))
    body = F.when(kind == 0, part("f", F.concat(part("num", n), part("den", run(F.lit("x")))))).when(kind == 1, part("rad", F.concat(part("deg", run(F.lit("3"))), part("e", n))))
    body = body.when(kind == 2, part("sSubSup", F.concat(part("e", run(F.lit("x"))), part("sub", n), part("sup", run(F.lit("2")))))).otherwise(F.lit("<m:f>"))
    xml = F.concat(F.lit(f'<m:oMath xmlns:m="{MATH}">'), body, F.lit("</m:oMath>"))
    q = table(spark, d, "questions").select("id", readers.office_formula(xml).alias("f"))
    return q.select("id", "f.latex", F.col("f.error").isNotNull().alias("failed"))


@query("sca31_equations", r"select id, case when id % 3 = 2 then '' when id % 3 = 0 then '\sqrt{' || chr(97 + cast(id % 26 as integer)) || '}' else '\frac{' || chr(97 + cast(id % 26 as integer)) || '}{2}' end as latex, id % 3 = 2 as warned from questions")
def sca31_equations(spark: SparkSession, d: str) -> DataFrame:
    """SCA31: equation objects of two kinds, with sizes between, and bytes that are none."""
    head = "0501000600" + b"app".hex() + "0000"
    char = lambda c: F.concat(F.lit("020083"), F.lpad(F.lower(F.hex(c)), 2, "0"), F.lit("00"))
    line = lambda c: F.concat(F.lit("0100"), c, F.lit("00"))
    letter = (F.col("id") % 26 + 97).cast("int")
    root = F.concat(F.lit("03000a0000"), line(F.concat(F.lit("09650c00"), char(letter))), F.lit("00"))
    fraction = F.concat(F.lit("03000b0000"), line(char(letter)), line(char(F.lit(50))), F.lit("00"))
    body = F.when(F.col("id") % 3 == 0, F.concat(F.lit(head), line(root), F.lit("00"))).when(F.col("id") % 3 == 1, F.concat(F.lit(head), line(fraction), F.lit("00"))).otherwise(F.lit("ffff"))
    q = table(spark, d, "questions").select("id", readers.equation(F.unhex(body)).alias("e"))
    return q.select("id", "e.latex", (F.col("e.warning") != "").alias("warned"))


@query(
    "ded4_refused_uploads",
    """with u as (select source as batch, 'F/' || id % 40 || '.PNG' as name, usage_count * 400000::bigint as size from questions where source is not null), p as (select batch, count(*) as n, sum(size) as s, count(distinct name) as k from u group by 1)
    select batch, 'count' as problem from p where n > 20 union all select batch, 'size' from p where s > 52428800 union all select batch, 'repeated name' from p where k < n""",
)
def ded4_refused_uploads(spark: SparkSession, d: str) -> DataFrame:
    """DED4: batches of uploads that break a rule; names differ in folder and case only."""
    q = table(spark, d, "questions").filter("source is not null")
    name = F.concat(F.when(F.col("id") % 2 == 0, "F/").otherwise("g\\"), (F.col("id") % 40).cast("string"), F.when(F.col("id") % 3 == 0, ".png").otherwise(".PNG"))
    return counts.refused_uploads(q.select(F.col("source").alias("batch"), name.alias("name"), (F.col("usage_count") * F.lit(400000).cast("long")).alias("size")))


@query("ded3_references", "with i as (select id, case when json_valid(image_paths) and json_type(image_paths) = 'ARRAY' then from_json(image_paths, '[\"VARCHAR\"]') else [] end as l from questions), d as (select id, list_concat(l, l) as l from i) select id, list_filter(l, lambda x, k: list_position(l, x) = k) as refs from d")
def ded3_references(spark: SparkSession, d: str) -> DataFrame:
    """DED3: references, each at its first place; more than 50 would be an error."""
    refs = F.coalesce(F.from_json("image_paths", "array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "questions").select("id", counts.different(F.concat(refs, refs), 50).alias("refs"))


@query(
    "top4_drafts",
    "with d as (select case when event_id % 3 = 0 then 'd' || event_id else 'draft-' || (1700000000000 + event_id * 7) end as id, case when event_id % 2 = 0 then 1700000000000 + event_id * 5 end as u from events) select id, coalesce(u, try_cast(nullif(regexp_extract(id, '^draft-(\\d+)', 1), '') as bigint), 0) as at from d",
)
def top4_drafts(spark: SparkSession, d: str) -> DataFrame:
    """TOP4: drafts by the time of change, else by the time in their id."""
    i = F.col("event_id").cast("long")
    drafts = table(spark, d, "events").select(
        F.when(i % 3 == 0, F.concat(F.lit("d"), i.cast("string"))).otherwise(F.concat(F.lit("draft-"), (i * 7 + 1700000000000).cast("string"))).alias("id"), F.when(i % 2 == 0, i * 5 + 1700000000000).alias("updated_at")
    )
    return counts.draft_order(drafts).select("id", "at")
