"""Cases of upserts, saved papers, bound images, merged tables and MathType equations."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import mtef
from tessella.operators import documents, repair


def test_upsert_touches_one_edition_only(spark):
    df = spark.createDataFrame([(1, "A", "x", "k"), (1, "B", "y", "l")], "question_id long, version_code string, chapter string, knowledge string")
    new = spark.createDataFrame([(1, "A", "z"), (2, "A", "w")], "question_id long, version_code string, chapter string")
    got = {tuple(r) for r in repair.upserted(df, new, ["question_id", "version_code"]).collect()}
    assert got == {(1, "A", "z", "k"), (1, "B", "y", "l"), (2, "A", "w", None)}


def test_backfill_only_an_empty_table(spark):
    q = spark.createDataFrame([(1, "a", "b", "c")], "id long, category_compulsory string, category_chapter string, category_knowledge string")
    c = spark.createDataFrame([(9, "B", "x", "y", "z")], "question_id long, version_code string, compulsory string, chapter string, knowledge string")
    assert [tuple(r) for r in repair.backfilled(c.limit(0), q).collect()] == [(1, "A", "a", "b", "c")]
    assert repair.backfilled(c, q).first().question_id == 9


def test_saved_paper(spark):
    q = spark.createDataFrame([(1, 0), (2, None), (3, 5)], "id long, usage_count int")
    items, usage = repair.saved_paper(7, [2, 1], [5, 12], q)
    assert [(r.question_id, r.order_index) for r in items.orderBy("order_index").collect()] == [(2, 1), (1, 2)]
    assert {r.id: r.usage_count for r in usage.collect()} == {1: 1, 2: 1, 3: 5}
    for ids, scores in (([1, 9], [5, 5]), ([1, 1], [5, 5]), ([1], [-1]), ([], [])):
        with pytest.raises(ValueError, match="refused"):
            repair.saved_paper(7, ids, scores, q)


def test_manifest_and_layout(spark):
    a = spark.createDataFrame([("x", 1, "s"), ("y", 2, "s"), ("z", 3, "s")], "path string, size long, sha string")
    b = spark.createDataFrame([("x", 1, "s"), ("y", 2, "t"), ("w", 3, "s")], "path string, size long, sha string")
    assert {tuple(r) for r in repair.manifest_differences(a, b).collect()} == {("y", "changed"), ("z", "missing"), ("w", "unknown")}
    assert repair.missing_columns({"a": ["path", "q"], "b": ["x"]}, {"a": a}) == {"a": ["q"], "b": ["x"]}


def test_bound_images(spark):
    q = spark.createDataFrame([(1, "a ![](FIG\\A.png) b ![x](no.png)"), (2, "plain"), (3, None)], "id long, content string")
    m = spark.createDataFrame([("a.png", "/u/2.png", 2), ("figs/a.png", "/u/1.png", 1)], "name string, path string, ord int")
    got = {r.id: (r.content, r.unmapped) for r in documents.bound_images(q, m).collect()}
    assert got == {1: ("a ![](/u/1.png) b ![x](no.png)", ["no.png"]), 2: ("plain", []), 3: (None, [])}


def test_squared_tables(spark):
    cells = [(1, 0, 0, "a", 2, False), (1, 0, 1, "b", 1, False), (1, 1, 0, "c", 1, False), (1, 1, 1, "d", 1, False), (1, 1, 2, "", 1, True), (1, 2, 0, "e", 1, False)]
    df = documents.squared_tables(spark.createDataFrame(cells, "table_id long, row int, pos int, text string, span int, continues boolean"))
    assert [(r.row, r.col, r.text) for r in df.orderBy("row", "col").collect()] == [
        (0, 0, "a"), (0, 1, ""), (0, 2, "b"), (1, 0, "c"), (1, 1, "d"), (1, 2, "b"), (2, 0, "e"), (2, 1, ""), (2, 2, ""),
    ]


def char(c: str, options: int = 0) -> bytes:
    return bytes([2, options, 0x83]) + ord(c).to_bytes(2, "little")


def line(*parts: bytes) -> bytes:
    return b"\x01\x00" + b"".join(parts) + b"\x00"


def template(code: int, variation: int, *slots: bytes) -> bytes:
    return bytes([3, 0, code, variation, 0]) + b"".join(slots) + b"\x00"


HEAD = b"\x05\x01\x00\x06\x00app\x00\x00"


@pytest.mark.parametrize(
    ("body", "latex"),
    [
        (line(char("x"), char("≤"), char("2")), r"x\le 2"),
        (line(template(11, 0, line(char("1")), line(char("α")))), r"\frac{1}{\alpha}"),
        (line(template(10, 0, line(char("x")))), r"\sqrt{x}"),
        (line(char("x"), template(28, 0, line(), line(char("2")))), "x^{2}"),
        (line(template(1, 3, line(char("a")))), r"\left(a\right)"),
        (line(char("s"), char("i"), char("n"), char("π")), r"\sin \pi"),
        (line(char("a", 1) + b"\x06\x00\x0b\x00"), r"\vec{a}"),
        (b"\x64\x02zz" + line(char("y")), "y"),
    ],
)
def test_mathtype(body, latex):
    assert mtef.latex(HEAD + body + b"\x00") == (latex, "")
    assert mtef.latex(b"\x1c" + b"\x00" * 27 + HEAD + body + b"\x00") == (latex, "")


@pytest.mark.parametrize("data", [b"", b"\x03", HEAD, HEAD + line(template(99, 0, line())) + b"\x00", HEAD + line(char("")) + b"\x00", HEAD + b"\x00\x07"])
def test_mathtype_never_guesses(data):
    text, warning = mtef.latex(data)
    assert text == "" and warning
