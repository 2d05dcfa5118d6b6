"""Problem 3: freely typed values mapped to the entries of a reference list.

Method: a partition-based pigeonhole join in SQL expressions. Values and entries are reduced to a core (width, blanks,
numbering, decoration, traditional characters). A reference core is cut into k + 1 segments; a value within k edits of
it holds at least one segment unchanged, at its place or moved by at most k. So an equality join on (list, length,
segment number, text) finds every candidate, ``levenshtein`` verifies it, and an anti-join reports what is left with
the entry ''. Only distinct values are compared, so hot values cost one row.

Nulls, values of blanks and values that are an entry as they stand give no row. Of several entries equally near, the
one of the number typed wins, then the first of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.textform import _replaced
from tessella.operators.pairs import BROADCAST_BYTES, looked_up, small_side
from tessella.plans.lineage import cut

MAX_EDITS = 2

# Traditional or variant characters and their simplified forms.
TRADITIONAL = (
    "兩個舉義習優體餘傾關幾準減則別動區單參雙變圖圗圓複復夾學實對導層廣開歸應徑恆據換數斷時機條楊極標樹樣橢測漸點獨現畫礎離"
    "積稱簡類係納線缐綫練組綁統縮補觀規視計討論證識詞試語誘讀調質軌轉軛較輔輝輯邊運跡遞邏鄰錯錐長門問間際隨項頻題驗驟與並併"
    "虛拋檢"
)
SIMPLIFIED = (
    "两个举义习优体余倾关几准减则别动区单参双变图图圆复复夹学实对导层广开归应径恒据换数断时机条杨极标树样椭测渐点独现画础离"
    "积称简类系纳线线线练组绑统缩补观规视计讨论证识词试语诱读调质轨转轭较辅辉辑边运迹递逻邻错锥长门问间际随项频题验骤与并并"
    "虚抛检"
)
# Numbering before a heading and decoration behind it.
NUMBER = r"[0-9]+(?:[.\-·][0-9]+)*"
CHINESE_NUMBER = "[一二三四五六七八九十百]+"
PREFIX = (
    rf"^(?:第(?:[0-9]+|{CHINESE_NUMBER})[章节单元讲回课]|单元(?:[0-9]+|十?[一二三四五六七八九十])|{CHINESE_NUMBER}[、.]|(?:chapter|unit|ch|u|§|知识点)\.?{NUMBER}"
    rf"|§|知识点|\({NUMBER}\)|{NUMBER})[.、:\-]*"
)
SUFFIX = r"(?:\([^()]*\)|专题|单元|复习|补充|[~_.\-·、])+$"
BLANK = r"^[\s\p{Z}\p{C}]*$"


def _squeezed(c: Column) -> Column:
    wide = F.lower(_replaced(c))
    return F.regexp_replace(F.translate(wide, TRADITIONAL, SIMPLIFIED), r"\s+", "")


def core(c: Column) -> Column:
    """A typed value or an entry without numbering, decoration, blanks and separators."""
    bare = F.regexp_replace(F.regexp_replace(_squeezed(c), PREFIX, ""), SUFFIX, "")
    return F.regexp_replace(F.translate(bare, "和及&", "与与与"), r"[·\-~—、,._]", "")


def number(c: Column) -> Column:
    """The Arabic number a heading begins with, '' when it has none."""
    return F.translate(F.regexp_extract(_squeezed(c), rf"^[^0-9]{{0,8}}?({NUMBER})", 1), "-·", "..")


def _segment(length: Column, part: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of one of ``parts`` segments of a core of this length."""
    start = F.floor(length * part / parts).cast("int")
    return start + 1, F.floor(length * (part + 1) / parts).cast("int") - start


def match(values: DataFrame, entries: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """(list, value, entry, distance) of every distinct (list, value); entry is '' and distance null where none is near.

    ``entries`` has (list, entry, ord) and is a reference list; its segments are broadcast if their bytes allow it.
    """
    parts = edits + 1
    refs = entries.filter(F.col("entry").isNotNull()).groupBy("list", "entry").agg(F.min("ord").alias("ord"))
    refs = refs.withColumn("ref_core", core(F.col("entry"))).withColumn("ref_number", number(F.col("entry"))).withColumn("len", F.length("ref_core")).filter("len > 0")
    cuts = refs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    start, size = _segment(F.col("len"), F.col("part"), parts)
    cuts = cuts.withColumn("seg", F.substring(F.col("ref_core"), start, size))
    typed = values.select("list", "value").distinct().withColumn("core", core(F.col("value"))).withColumn("number", number(F.col("value")))
    n = F.length("core")
    probes = typed.filter(n > 0).withColumn("len", F.explode(F.sequence(F.greatest(n - edits, F.lit(1)), n + edits)))
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(edits)))).withColumn("shift", F.explode(F.sequence(F.lit(-edits), F.lit(edits))))
    start, size = _segment(F.col("len"), F.col("part"), parts)
    probes = probes.filter((start + F.col("shift") >= 1) & (start + F.col("shift") + size <= n + 1))
    probes = probes.withColumn("seg", F.substring(F.col("core"), start + F.col("shift"), size)).drop("shift")
    near = probes.join(small_side(cuts), ["list", "len", "part", "seg"])
    near = near.withColumn("distance", F.levenshtein("core", "ref_core", edits)).filter((F.col("distance") >= 0) & (F.col("distance") <= F.floor((F.col("len") - 1) / 2)))
    rank = F.struct("distance", (F.col("number") != F.col("ref_number")).alias("other"), "ord", "entry")
    best = near.groupBy("list", "value").agg(F.min(rank).alias("best")).select("list", "value", F.col("best.entry").alias("entry"), F.col("best.distance").alias("distance"))
    none = typed.select("list", "value").join(best, ["list", "value"], "left_anti")
    return best.unionByName(none.select("list", "value", F.lit("").alias("entry"), F.lit(None).cast("int").alias("distance")))


def typed_values(questions: DataFrame, curriculums: DataFrame) -> DataFrame:
    """(table_name, row_id, field, list, value) of the three typed fields, blanks left out; list is edition and level."""
    q = questions.select(
        F.lit("questions").alias("table_name"),
        F.col("id").alias("row_id"),
        F.explode(F.array(F.struct(F.lit("category_chapter").alias("field"), F.lit("A/chapter").alias("list"), F.col("category_chapter").alias("value")), F.struct(F.lit("category_knowledge").alias("field"), F.lit("A/knowledge").alias("list"), F.col("category_knowledge").alias("value")))).alias("x"),
    ).select("table_name", "row_id", "x.field", "x.list", "x.value")
    c = curriculums.select(
        F.lit("question_curriculums").alias("table_name"),
        F.col("id").alias("row_id"),
        F.lit("chapter").alias("field"),
        F.concat(F.coalesce(F.col("version_code"), F.lit("")), F.lit("/chapter")).alias("list"),
        F.col("chapter").alias("value"),
    )
    return q.unionByName(c).filter(F.col("value").isNotNull() & ~F.col("value").rlike(BLANK))


def reference_list(tree: DataFrame) -> DataFrame:
    """(list, entry, ord) of the chapters and knowledge points of every edition."""
    ord_ = (F.col("chapter_ord") * 1000 + F.col("leaf_ord")).cast("long")
    both = F.array(F.struct(F.concat("version_code", F.lit("/chapter")).alias("list"), F.col("chapter").alias("entry")), F.struct(F.concat("version_code", F.lit("/knowledge")).alias("list"), F.col("knowledge").alias("entry")))
    return tree.select(F.explode(both).alias("x"), ord_.alias("ord")).select("x.list", "x.entry", "ord").groupBy("list", "entry").agg(F.min("ord").alias("ord"))


def canonical_values(questions: DataFrame, curriculums: DataFrame, tree: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(table_name, row_id, field, entry): one row per value that isn't exactly an entry; entry '' when none is meant.

    The entries found are broadcast up to ``limit`` bytes; beyond it hot values are dealt out over several tasks.
    """
    entries = reference_list(tree)
    values = typed_values(questions, curriculums)
    exact = entries.select("list", F.col("entry").alias("value"))
    values = values.join(small_side(exact), ["list", "value"], "left_anti")
    matched = cut(match(values, entries).select("list", "value", "entry"))
    return looked_up(values, matched, ["list", "value"], "row_id", limit).select("table_name", "row_id", "field", "entry")
