"""Queries over event logs and snapshots, and the parsers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import parsers
from tessella.registry import query
from tessella.sources.snapshots import digest
from tessella.sources.tables import table
from tessella.streaming import tasks

KIND = "case event_type when 'purchase' then 'completed' when 'signup' then 'error' when 'logout' then 'cancelled' else event_type end"
EVENTS = f"e as (select user_id as task_id, event_id as seq, ts, {KIND} as kind, value as progress from events)"
LIFE = """life as (select task_id, coalesce(t.kind, l.kind) as state, case when t is null then l.progress when t.kind = 'completed' then 100.0 else 0.0 end as progress, coalesce(t.seq, l.seq) as seq, coalesce(t.ts, l.ts) as updated_at from
  (select task_id, arg_min({'kind': kind, 'seq': seq, 'ts': ts}, seq) filter (where kind in ('completed', 'error', 'cancelled')) as t, arg_max({'kind': kind, 'progress': progress, 'seq': seq, 'ts': ts}, seq) filter (where kind not in ('completed', 'error', 'cancelled')) as l from e group by 1))"""


def as_tasks(events: DataFrame) -> DataFrame:
    """The events table as a task log: users as tasks, two kinds of events closing them."""
    kind = F.col("event_type")
    for name, terminal in (("purchase", "completed"), ("signup", "error"), ("logout", "cancelled")):
        kind = F.when(F.col("event_type") == name, F.lit(terminal)).otherwise(kind)
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.col("value").alias("progress"))


@query("str1_lifecycle", f"with {EVENTS}, {LIFE} select * from life")
def str1_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return tasks.lifecycle(as_tasks(table(spark, d, "events")))


@query("str1_stream", f"with {EVENTS}, {LIFE} select * from life")
def str1_stream(spark: SparkSession, d: str) -> DataFrame:
    """The lifecycle kept by a stateful stream over the event files."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events*").option("recursiveFileLookup", "true").parquet(d)
    return tasks.replayed(spark, as_tasks(stream))


@query("str3_expired", f"with {EVENTS}, {LIFE} select task_id, state, updated_at from life where state in ('completed', 'error', 'cancelled') and (select max(ts) from e) - updated_at >= interval 3600 seconds")
def str3_expired(spark: SparkSession, d: str) -> DataFrame:
    log = as_tasks(table(spark, d, "events"))
    now = F.lit(log.agg(F.max("ts").alias("m")).first().m)
    return tasks.expired(tasks.lifecycle(log), now).select("task_id", "state", "updated_at")


@query("str4_running_totals", "select user_id as request, event_id as seq, sum(cast(floor(value) as bigint)) over (partition by user_id order by event_id) as total from events")
def str4_running_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.floor("value").alias("tokens"), F.lit(None).cast("long").alias("reported"))
    return tasks.running_totals(e).select("request", "seq", "total")


@query(
    "str6_fallback",
    "with a as (select user_id as request, event_id as priority, event_type as provider, case when event_id % 11 = 0 then 'timeout' when event_id % 3 = 0 then 'ok' else 'error' end as outcome from events), p as (select request, min(priority) filter (where outcome = 'timeout') as s, min(priority) filter (where outcome = 'ok') as g from a group by 1) select p.request, case when p.s is null or p.g < p.s then a.provider end as provider from p left join a on a.request = p.request and a.priority = p.g",
)
def str6_fallback(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_id") % 11 == 0, "timeout").when(F.col("event_id") % 3 == 0, "ok").otherwise("error")
    a = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("priority"), F.col("event_type").alias("provider"), outcome.alias("outcome"))
    return tasks.first_success(a)


SNAPSHOT = {
    "questions": ("answer_markdown", "association_group_id", "category_chapter", "category_compulsory", "category_knowledge", "content", "created_at", "difficulty", "figure_align", "id", "image_paths", "question_type", "review", "source", "tags", "tikz_code", "usage_count"),
    "question_curriculums": ("chapter", "compulsory", "id", "knowledge", "question_id", "version_code"),
    "papers": ("created_at", "id", "metadata_json", "paper_type", "subtitle", "title", "total_score"),
    "paper_questions": ("id", "order_index", "paper_id", "question_id", "score"),
}


def _digest_sql(name: str) -> str:
    row = ", ".join(f"coalesce(cast({c} as varchar), chr(1))" for c in SNAPSHOT[name])
    return f"select '{name}' as name, count(*) as rows, cast(coalesce(sum(cast('0x' || substr(md5(concat_ws(chr(31), {row})), 1, 15) as hugeint)), 0) as varchar) as digest from {name}"


@query("snk3_manifest", " union all ".join(map(_digest_sql, SNAPSHOT)))
def snk3_manifest(spark: SparkSession, d: str) -> DataFrame:
    """AGG12, SNK3: rows and digest of every table of a snapshot."""
    parts = [digest(table(spark, d, t).select(*c), t) for t, c in SNAPSHOT.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_ENVIRONMENTS = "|".join(rf"\\begin\{{{e}\}}[\s\S]*?\\end\{{{e}\}}".replace("*", r"\*", 0) for e in ("equation", "align", "gather", "aligned", "gathered", "split", "multline", "eqnarray", "displaymath", "math", "array", "cases", "matrix", "pmatrix", "bmatrix", "vmatrix"))
_LOCKS = r"regexp_extract_all(content, '\$\$[\s\S]*?\$\$|\$[^$]*\$|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]|" + _ENVIRONMENTS + "')"


@query("doc9_all_locks", f"with l as (select id, {_LOCKS} as l from questions) select id, len(l) as n_locks, l as originals from l")
def doc9_all_locks(spark: SparkSession, d: str) -> DataFrame:
    """DOC9: the formulas of every stem put under locks; golden cases hold what SQL can't tell, escapes and formulas that don't end."""
    q = table(spark, d, "questions").select("id", parsers.lock_formulas("content", F.col("id").cast("string")).alias("l"))
    return q.select("id", F.size("l.locks").cast("long").alias("n_locks"), F.transform("l.locks", lambda x: x["original"]).alias("originals"))


@query("sca32_tokens")
def sca32_tokens(spark: SparkSession, d: str) -> DataFrame:
    """SCA32: stems as text, formulas and gaps in order."""
    t = table(spark, d, "questions").select("id", F.posexplode(parsers.tokens("content")).alias("pos", "t"))
    return t.select("id", "pos", "t.kind", "t.text", "t.display")


@query("sca50_model_json", "select id, chr(10) || replace(content, chr(34), chr(39)) as content from questions")
def sca50_model_json(spark: SparkSession, d: str) -> DataFrame:
    """SCA48 to SCA51: stems in a model's envelope with single backslashes and raw line breaks, read again."""
    said = F.concat(F.lit('```json\n{"questions": [{"content": "\n'), F.regexp_replace("content", r'["]', "'"), F.lit('"}]}\n```'))
    q = table(spark, d, "questions").select("id", parsers.canonical_questions(said).alias("j"))
    return q.select("id", F.from_json("j", "array<struct<content: string>>")[0]["content"].alias("content"))


@query("sca18_tex_sources")
def sca18_tex_sources(spark: SparkSession, d: str) -> DataFrame:
    """SCA13 to SCA18: every paper's title and stems as a TeX source, prepared."""
    pq = table(spark, d, "paper_questions").select("paper_id", "question_id", "order_index")
    q = table(spark, d, "questions").select(F.col("id").alias("question_id"), F.coalesce("content", F.lit("")).alias("stem"))
    stems = pq.join(q, "question_id").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("order_index", "question_id", "stem"))).alias("stems"))
    papers = table(spark, d, "papers").join(stems, F.col("id") == F.col("paper_id"), "left")
    body = F.coalesce(F.array_join(F.transform("stems", lambda x: F.concat(F.lit("\\question "), x["stem"], F.lit("\n"))), ""), F.lit(""))
    source = F.concat(F.lit("\\newcommand{\\R}{\\mathbb{R}}\n\\title{"), F.coalesce("title", F.lit("")), F.lit("}\n\\begin{document}\n% note\n"), body, F.lit("\\end{document}"))
    return papers.select("id", parsers.tex_source(source).alias("t")).select("id", "t.*")
