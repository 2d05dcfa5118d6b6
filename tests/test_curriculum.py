"""Curriculum trees and routes, counts, orders, imports and readers: small cases."""

import io
import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import latex
from tessella.operators import counts, curriculum, documents, imports, papers, repair, search
from tessella.operators.pairs import expanded, looked_up, pairs_within
from tessella.sources import readers, snapshots


def test_routes_take_the_first_rule_and_known_leaves(spark):
    rules = [curriculum.Rule("一", "数列", ("数列",), ("级数",)), curriculum.Rule("二", "函数", ("函数",)), curriculum.Rule("三", "旧书", ("旧",), book_only=True)]
    leaves = spark.createDataFrame([("一", "数列", "求和"), ("二", "函数", "图象")], "book string, chapter string, knowledge string")
    df = spark.createDataFrame([(1, "", "数列与函数", "求和"), (2, "", "级数数列", "函数"), (3, "旧版", "x", "y"), (4, "x", "旧", None), (5, None, None, None)], "id long, compulsory string, chapter string, knowledge string")
    got = {r.id: (r.compulsory, r.chapter, r.knowledge) for r in curriculum.routed(df, rules, ("零", "绪论"), leaves).collect()}
    assert got == {1: ("一", "数列", "求和"), 2: ("二", "函数", ""), 3: ("三", "旧书", ""), 4: ("零", "绪论", ""), 5: ("零", "绪论", "")}


def test_switch_keeps_rows_and_routes_the_others(spark):
    q = spark.createDataFrame([(1, "", "函数", "图象"), (2, "", "函数", "图象")], "id long, category_compulsory string, category_chapter string, category_knowledge string")
    c = spark.createDataFrame([(7, 1, "B", "老", "a", "k"), (8, 1, "B", "新", "b", "l"), (9, 2, "A", "x", "y", "z"), (10, 99, "B", "x", "y", "z")], "id long, question_id long, version_code string, compulsory string, chapter string, knowledge string")
    leaves = spark.createDataFrame([("二", "函数", "图象")], "book string, chapter string, knowledge string")
    got = {tuple(r) for r in curriculum.switched(q, c, "B", [curriculum.Rule("二", "函数", ("函数",))], ("零", "绪论"), leaves).collect()}
    assert got == {(1, "B", "新", "b", "l"), (2, "B", "二", "函数", "图象")}


@pytest.mark.parametrize("tree", [{"甲": {"一": ["x", "y"], "二": []}}, [{"name": "甲", "chapters": [{"name": "一", "knowledge": ["x", "y"]}, {"name": "二", "knowledge": []}]}]])
def test_trees_are_read(spark, tmp_path, tree):
    (tmp_path / "B.json").write_text(json.dumps(tree, ensure_ascii=False, indent=1), encoding="utf8")
    assert [tuple(r) for r in curriculum.read_tree(spark, str(tmp_path), " b ").orderBy("leaf_ord").collect()] == [("B", "甲", 0, "一", 0, "x", 0), ("B", "甲", 0, "一", 0, "y", 1)]
    with pytest.raises(ValueError, match="unknown edition"):
        curriculum.read_tree(spark, str(tmp_path), "Q")


def test_candidates_fall_back(spark):
    q = spark.createDataFrame([(k, "a" if k < 40 else "b", None if k % 3 == 0 else k % 5) for k in range(60)], "id long, category_compulsory string, usage_count int")
    ids = lambda df: [r.id for r in df.collect()]
    fresh = sorted(((u or 0) if u is not None else -1, -i) for i, u in [(k, None if k % 3 == 0 else k % 5) for k in range(60)])
    assert sorted(ids(papers.candidates(q, search.Filters(compulsory="none"), review=False))) == sorted(-i for _, i in fresh[:35])
    assert set(ids(papers.candidates(q, search.Filters(compulsory="b"), review=False))) == set(range(40, 60))
    unused = q.withColumn("usage_count", F.lit(0))
    assert set(ids(papers.candidates(unused, search.Filters(compulsory="a"), review=True))) == set(range(5, 40))


def test_places_over_sparse_ids_and_one_day(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 10**12 + 7).alias("id"), F.when(F.col("id") % 3 > 0, F.lit("2024-05-05 10:00:00").cast("timestamp")).alias("created_at"))
    monkeypatch.setattr(search, "CHUNK", 400)
    ordinals = [r.seq_num for r in search.with_ordinal(df).orderBy("id").collect()]
    assert ordinals == list(range(1, 5001))
    chunked = search.in_chunks(df, search.in_order("asc"), 400)
    assert chunked.groupBy("_chunk").count().agg(F.max("count")).first()[0] < 1200
    rows = search.with_time_place(df, descending=False).collect()
    expected = sorted(rows, key=lambda r: (r.created_at is not None, r.created_at, r.id) if r.created_at else (False, 0, r.id))
    assert [r.place for r in expected] == list(range(1, 5001))


def shingle_set(t):
    s = "".join(c for c in t or "" if "一" <= c <= "龥" or c.isascii() and c.isalnum())
    return {s} - {""} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}


def test_attribution_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    words = ["函数图象", "等比数列求和", "the common stem", "椭圆焦点", "概率", "ab", "向量a与b", "求最小值"]
    text = lambda n: "，".join(["已知共同的开头"] + [rng.choice(words) for _ in range(n)])
    pages = [(d, k, text(rng.randint(1, 6))) for d in range(6) for k in range(rng.randint(1, 7))] + [(9, 3, "甲乙丙"), (9, 5, "甲乙丙"), (10, 0, None)]
    questions = [(d, q, text(rng.randint(0, 4))) for d in range(6) for q in range(12)] + [(9, 1, "甲乙丙"), (9, 2, "别的题目"), (9, 3, None), (10, 1, "x"), (11, 1, "没有页")]
    got = {(r.doc_id, r.q): r.page_index for r in documents.attributed(spark.createDataFrame(questions, "doc_id long, q long, content string"), spark.createDataFrame(pages, "doc_id long, page_index int, markdown string")).collect()}
    for d, q, t in questions:
        scores = [(len(shingle_set(t) & shingle_set(m)), -k) for doc, k, m in pages if doc == d]
        n, k = max(scores, default=(0, 0))
        assert got[d, q] == (-k if n else 0), (d, q)


def test_counts_and_limits(spark):
    df = spark.createDataFrame([(["a", "b", "a"],)], "l array<string>")
    assert df.select(counts.different("l", 2).alias("l")).first().l == ["a", "b"]
    with pytest.raises(Exception, match="too many values"):
        df.select(counts.different("l", 1)).collect()
    files = spark.createDataFrame([("x", "a/P.png", 1), ("x", "b\\p.PNG", 2), ("y", "q.png", 60 << 20), ("z", "q.png", 5)], "batch string, name string, size long")
    assert {tuple(r) for r in counts.refused_uploads(files).collect()} == {("x", "repeated name"), ("y", "size")}
    drafts = spark.createDataFrame([("draft-50", None), ("b", 60), ("a", 60), ("c", None)], "id string, updated_at long")
    assert [r.id for r in counts.draft_order(drafts).collect()] == ["a", "b", "draft-50", "c"]


def test_export_form(spark):
    cases = {
        ("求值（　　）\n- A. 1\n- B. 2", "single_choice", False): "求值 \\paren\n\n\\begin{choices} \\item 1 \\item 2\n\n\\end{choices}",
        ("看图 ![](/static/uploads/d/a.png) 好", "", False): "看图\n\n\\begin{center} \\includegraphics[max width=0.85\\linewidth]{a.png}\n\n\\end{center} 好",
        ("解\n因为 x\n所以 y", "", True): "解\n\n因为 x\n\n所以 y", ("", "", False): "",
    }
    for (text, kind, answer), out in cases.items():
        df = spark.createDataFrame([(text, kind)], "c string, t string")
        assert df.select(latex.export_form(F.col("c"), F.col("t"), answer).alias("o")).first().o == out
    one = spark.createDataFrame([("甲 $x$\n乙$",)], "c string").select(latex.choice_stem_closed(F.col("c")).alias("o")).first().o
    assert one == "甲 $x$\n乙$$"


def test_post_processing(spark):
    crop = "/static/uploads/tmp/pdf_crop_1_{}.png"
    q = spark.createDataFrame(
        [(1, 1, "如 ![](图1.png) 求____值\\n第二行", "见 \\includegraphics[w=1]{图2}", "", "卷"), (1, 2, "等差数列前三项", "", "来源", "卷"), (1, 3, "![](图1.png)", None, None, "卷")],
        "doc_id long, q long, content string, answer string, source string, title string",
    )
    crops = spark.createDataFrame([(1, 5, crop.format("a")), (1, 6, crop.format("b"))], "doc_id long, ord int, path string")
    pages = spark.createDataFrame([(1, 0, "别的"), (1, 1, f"等差数列前三项 ![]({crop.format('c')})")], "doc_id long, page_index int, markdown string")
    got = {r.q: (r.content, r.answer, r.source, r.images) for r in imports.post_processed(q, crops, pages).collect()}
    assert got[1] == ("如  求\\fillin值\n第二行", f"见 ![插图]({crop.format('b')})", "卷", [crop.format("a"), crop.format("b")])
    assert got[2] == ("等差数列前三项", "", "来源", [crop.format("c")]) and got[3] == ("", "", "卷", [crop.format("a")])


def test_word_files_with_errors(spark):
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.bin", b"\0" * (11 << 20))
    files = spark.createDataFrame([("a", bytearray(b"no")), ("b", bytearray(big.getvalue()))], "path string, content binary")
    assert {r.path: r.error is not None and r.markdown is None for r in readers.word_documents(files).collect()} == {"a": True, "b": True}
    assert {(r.path, r.member, r.problem) for r in readers.unsafe_members(files).collect()} == {("a", None, "no archive"), ("b", "x.bin", "packed too tightly")}


def test_classes_are_expanded_and_looked_up_without_a_hot_task(spark):
    classes = spark.createDataFrame([(1, 5), (20, 3)], "rep long, n long")
    copies = spark.createDataFrame([(1, 5, k) for k in range(1, 6)] + [(20, 3, k) for k in range(20, 23)], "rep long, n long, id long")
    links = spark.createDataFrame([(1, 20), (1, 40), (50, 60)], "a long, b long")
    got = sorted(tuple(r) for r in expanded(links, classes, copies, block=2).collect())
    assert got == sorted([*itertools.product(range(1, 6), range(20, 23)), *[(k, 40) for k in range(1, 6)], (50, 60)])
    left = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v int")
    for limit in (0, 1 << 20):
        assert {(r.k, r.v): r["count"] for r in looked_up(left, right, ["k"], "id", limit).groupBy("k", "v").count().collect()} == {("hot", 1): 900, ("cold", 2): 100}
    assert pairs_within(spark.range(40).select(F.lit(1).alias("g"), "id"), "g", "id", block=7).count() == 780


def test_digests_tell_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    first = snapshots.digest(a, "t").first()
    assert snapshots.digest(a.orderBy(F.desc("id")), "t").first() == first and first.rows == 2
    assert snapshots.digest(a.withColumn("t", F.coalesce("t", F.lit(""))), "t").first().digest != first.digest


def test_commits_are_whole_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    none = df.filter("false")
    assert repair.committed(df, folder, none).count() == 2
    with pytest.raises(ValueError, match="refused"):
        repair.committed(none, folder, df)
    assert spark.read.parquet(folder).count() == 2
    changed = repair.upserted(spark.read.parquet(folder), spark.createDataFrame([(2, "z"), (3, "w")], "id long, t string"), ["id"])
    assert {tuple(r) for r in repair.committed(changed, folder, none).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert not (tmp_path / "t.new").exists() and not (tmp_path / "t.old").exists()
