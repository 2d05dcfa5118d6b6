"""Column functions that take questions, requests and compiler logs apart; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.latex import IMAGE
from tessella.functions.values import py_strip

CHOICES = r"\\begin\{choices\}([\s\S]*?)\\end\{choices\}"
DRAWING = r"\\begin\{tikzpicture\}[\s\S]*?\\end\{tikzpicture\}"


def question_parts(content: Column) -> Column:
    """(stem, choices): options of the choices environment, else of lines with letters; images and drawings are left out."""
    c = F.coalesce(content, F.lit(""))
    inside = F.filter(F.transform(F.split(F.regexp_extract(c, CHOICES, 1), r"(?U)\\item\b"), py_strip), lambda x: x != "")
    lines = F.split(c, "\n")
    option = r"^\s*[-*]?\s*[A-D][.、]\s*(.*)$"
    lettered = F.transform(F.filter(lines, lambda x: x.rlike(option)), lambda x: py_strip(F.regexp_extract(x, option, 1)))
    env = c.rlike(CHOICES)
    stem = F.when(env, F.regexp_replace(c, CHOICES, "")).otherwise(F.array_join(F.filter(lines, lambda x: ~x.rlike(option)), "\n"))
    bare = py_strip(F.regexp_replace(F.regexp_replace(py_strip(stem), IMAGE, ""), DRAWING, ""))
    return F.struct(bare.alias("stem"), F.when(env, inside).otherwise(lettered).alias("choices"))


def choice_columns(choices: Column) -> Column:
    """Columns in which choices are set: 4 when few and short, 2 when short, else 1."""
    longest = F.coalesce(F.array_max(F.transform(choices, F.length)), F.lit(0))
    return F.when((F.size(choices) <= 4) & (longest <= 10), 4).when(longest <= 24, 2).otherwise(1)


# Numbers before a question: those that are told by their form may stand alone, bare ones need a sign behind them.
_SIGNS = r"[\s.,，、．:：\-—~]"
_FORMED = r"第\s*\d+\s*题|例题?\s*\d+|[(（\[【]\s*\d+\s*[)）\]】]"
_BARE = r"\d+|[一二三四五六七八九十百]+"
NUMBERING = rf"^(?:\s|(?:{_FORMED}){_SIGNS}*|(?:{_BARE}){_SIGNS}+)+"


def ocr_text(c: Column) -> Column:
    """Read text without thin spaces, exclamation marks (images keep theirs) and any numbering before it."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\\[!,]", ""), r"!(?!\[)|！", "")
    return py_strip(F.regexp_replace(py_strip(bare), NUMBERING, ""))


# Marks of located illustrations, as (beginning, end); the last ends with its line where no bracket closes.
BOX_MARKS = (("<|box_start|>", "<|box_end|>"), ("[ILLUSTRATION_BOX:", "]"))
LOOSE_BOX = "ILLUSTRATION_BOX"


def without_box_marks(c: Column) -> Column:
    """Read text without the marks of located illustrations. A mark that doesn't end on its line is kept, the loose one goes up to where it stops."""
    def without(begin: str, end: str):
        mark = rf"(?i)^\Q{begin}\E.*?\Q{end}\E"
        return lambda p: F.regexp_replace(p, mark, "")

    def cleaned(line: Column) -> Column:
        for begin, end in BOX_MARKS:
            line = F.array_join(F.transform(F.split(line, rf"(?i)(?=\Q{begin}\E)"), without(begin, end)), "")
        return line

    lines = F.split(c, "\n")
    return py_strip(F.regexp_replace(F.array_join(F.transform(lines, cleaned), "\n"), rf"(?i){LOOSE_BOX}[^\])\r\n]+[\s\])]*", ""))


# Words of a typed request and what they ask for.
REVIEW_WORDS = ("做过", "考过", "已抽过", "已用过", "复习", "旧题", "重做", "错题", "以往", "历史")
TYPE_WORDS = (("填空", "fill_in_blank"), ("单选", "single_choice"), ("多选", "multi_choice"), ("解答", "detailed_answer"))
TOPICS = ("立体几何", "集合", "函数", "导数", "数列", "三角函数", "平面向量", "概率", "解析几何", "圆锥曲线", "复数", "不等式", "排列组合")
COUNT_WORDS = "一二三四五六七八九十"


def intent(c: Column, limit: int = 5) -> Column:
    """(limit, question_type, topics, review) of a typed request. Counts of several characters that are no digits leave the limit."""
    word = F.regexp_extract(c, r"([一二三四五六七八九十1-9]+)\s*道", 1)
    n = F.coalesce(F.when(word.rlike("^[1-9]{1,9}$"), word.cast("int")), F.when(F.length(word) == 1, F.instr(F.lit(COUNT_WORDS), word)))
    kind = F.lit(None).cast("string")
    for w, t in reversed(TYPE_WORDS):
        kind = F.when(F.contains(c, F.lit(w)), F.lit(t)).otherwise(kind)
    topics = F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(c, t))
    review = F.exists(F.array(*map(F.lit, REVIEW_WORDS)), lambda w: F.contains(c, w))
    return F.struct(F.when(n > 0, n).otherwise(F.lit(limit)).alias("limit"), kind.alias("question_type"), topics.alias("topics"), review.alias("review"))


def edition_of(chapters: Column) -> Column:
    """The edition an array of chapter names belongs to, by how chapters are numbered in it."""
    s = F.array_join(chapters, " ")
    has = lambda w: F.contains(s, F.lit(w))
    h = has("第 1 章 集合与逻辑") | has("数学建模活动案例") | has("第 2 章 等式与不等式") | has("第 3 章 幂、指数与对数")
    return F.when(has("第一章"), "B").when(h, "H").when(has("第1章"), "S").otherwise("A")


def provider(c: Column) -> Column:
    """(provider, model): the prefix before a slash, else by the model's name; an unknown prefix is no provider."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    prefix = F.upper(F.regexp_extract(raw, "^([^/]*)/", 1))
    slash = F.contains(raw, F.lit("/"))
    known = prefix.isin("DEEPSEEK", "BAILIAN", "OPENAI", "GEMINI", "SILICONFLOW")
    name = F.when(slash & known, prefix).when(slash, F.lit("unknown")).when(F.contains(F.lower(raw), F.lit("qwen")), "BAILIAN").otherwise("DEEPSEEK")
    return F.struct(F.lower(name).alias("provider"), F.when(slash, F.regexp_replace(raw, "^[^/]*/", "")).otherwise(raw).alias("model"))


def log_diagnosis(log: Column) -> Column:
    """(error, line, text) of a compiler log: the form with file and line first, else the first error and the line below it."""
    l = F.coalesce(log, F.lit(""))
    by_file = r"(?m)^(?:\./)?paper\.tex:(\d+):\s*(.+)$"
    error = F.regexp_extract(l, r"(?m)^!\s*(.+)$", 1)
    line = F.regexp_extract(l, r"(?m)^l\.(\d+)\s*(.*)$", 1)
    filed = l.rlike(by_file)
    number = F.when(filed, F.regexp_extract(l, by_file, 1)).otherwise(line)
    return F.struct(
        F.when(filed, F.trim(F.regexp_extract(l, by_file, 2))).when(error != "", F.trim(error)).otherwise("unknown error").alias("error"),
        F.nullif(number, F.lit("")).cast("int").alias("line"),
        F.trim(F.regexp_extract(l, r"(?m)^l\.\d+[^\S\n]*(.*)$", 1)).alias("text"),
    )


def source_context(source: Column, line: Column, radius: int = 3) -> Column:
    """(context, question_id): numbered lines around one, and the nearest question mark at or above it."""
    lines = F.split(F.coalesce(source, F.lit("")), "\n")
    at = F.least(F.greatest(line, F.lit(1)), F.size(lines))
    first = F.greatest(at - radius, F.lit(1))
    around = F.transform(F.slice(lines, first, F.least(at + radius, F.size(lines)) - first + 1), lambda x, k: F.concat((first + k).cast("string"), F.lit(": "), x))
    mark = r"^\s*%\s*Question-ID:\s*(\d+)\s*$"
    above = F.filter(F.slice(lines, 1, at), lambda x: x.rlike(mark))
    return F.struct(F.array_join(around, "\n").alias("context"), F.regexp_extract(F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit("")), mark, 1).alias("question_id"))


def bounded_diagnosis(title: Column, fixes: Column) -> Column:
    """A model's diagnosis kept within bounds: a title of 200 characters, five fixes of 500."""
    return F.struct(F.substring(F.trim(title), 1, 200).alias("title"), F.transform(F.slice(F.filter(fixes, lambda x: F.trim(x) != ""), 1, 5), lambda x: F.substring(x, 1, 500)).alias("fixes"))
