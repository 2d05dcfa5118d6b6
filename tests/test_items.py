"""Golden cases of the functions that take questions, requests and logs apart."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import items


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "c string").select(function(F.col("c")).alias("r")).first().r


def test_question_parts(spark):
    got = one(spark, items.question_parts, "求 ![](/a.png)\n\\begin{choices}\\item 1 \\item 2\\end{choices}")
    assert (got.stem, got.choices) == ("求", ["1", "2"])
    got = one(spark, items.question_parts, "求\nA. 甲\n- B、乙\n完")
    assert (got.stem, got.choices) == ("求\n完", ["甲", "乙"])
    assert one(spark, items.question_parts, None).choices == []


@pytest.mark.parametrize(("choices", "n"), [(["a", "b"], 4), (["a" * 11], 2), (["a" * 25], 1), (["a"] * 5, 2), ([], 4)])
def test_choice_columns(spark, choices, n):
    assert spark.createDataFrame([(choices,)], "c array<string>").select(items.choice_columns(F.col("c")).alias("r")).first().r == n


@pytest.mark.parametrize(("text", "expected"), [("一、 1. 例2：求\\,x\\!y！![](a)", "求xy![](a)"), ("第 3 题、（4）设", "设"), ("2024年", "2024年"), ("", "")])
def test_ocr_text(spark, text, expected):
    assert one(spark, items.ocr_text, text) == expected


@pytest.mark.parametrize(
    ("text", "limit", "kind", "review"),
    [("来三道填空", 3, "fill_in_blank", False), ("两道题", 5, None, False), ("10道", 5, None, False), ("十五道", 5, None, False), ("99道错题", 99, None, True), ("", 5, None, False), ("9 道单选", 9, "single_choice", False)],
)
def test_intent(spark, text, limit, kind, review):
    got = one(spark, items.intent, text)
    assert (got.limit, got.question_type, got.review) == (limit, kind, review)
    assert one(spark, items.intent, "导数和数列").topics == ["导数", "数列"]


@pytest.mark.parametrize(("chapters", "edition"), [(["第一章 x"], "B"), (["数学建模活动案例"], "H"), (["第1章 y"], "S"), (["1. z"], "A"), ([], "A")])
def test_edition(spark, chapters, edition):
    assert spark.createDataFrame([(chapters,)], "c array<string>").select(items.edition_of(F.col("c")).alias("r")).first().r == edition


def test_logs(spark):
    got = one(spark, items.log_diagnosis, "x\n./paper.tex:42: Undefined control sequence.\nl.42 \\foo bar\n! Other")
    assert (got.error, got.line, got.text) == ("Undefined control sequence.", 42, "\\foo bar")
    got = one(spark, items.log_diagnosis, "! Missing $ inserted.\nl.7 x_1")
    assert (got.error, got.line, got.text) == ("Missing $ inserted.", 7, "x_1")
    assert one(spark, items.log_diagnosis, None).line is None
    got = one(spark, lambda c: items.source_context(c, F.lit(3), 1), "% Question-ID: 12\na\nb\nc")
    assert (got.context, got.question_id) == ("2: a\n3: b\n4: c", "12")


def test_providers_and_marks(spark):
    assert tuple(one(spark, items.provider, "openai/gpt")) == ("openai", "gpt") and one(spark, items.provider, "x/y").provider == "unknown"
    assert one(spark, items.provider, "Qwen-max").provider == "bailian" and one(spark, items.provider, None).provider == "deepseek"
    assert one(spark, items.without_box_marks, "a<|box_start|>(1,2)<|box_end|>b [ILLUSTRATION_BOX: 1, 2] ") == "ab"
