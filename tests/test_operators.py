"""Cases of the core operators: nulls, ties, empty tables, hot keys."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tessella import registry
from tessella.functions import latex, values
from tessella.operators import documents, pairs, papers, repair, search
from tessella.operators.components import components
from tessella.operators.running import running_before
from tessella.sources import snapshots
from tessella.streaming import tasks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


def test_pairs_within_spreads_a_hot_group(spark):
    df = spark.createDataFrame([(i, "hot" if i < 30 else f"g{i % 7}", i % 3) for i in range(60)] + [(99, None, 0)], "id long, g string, v int")
    got = {tuple(r) for r in pairs.pairs_within(df, "g", "id", block=4).select("id_a", "id_b").collect()}
    rows = [r for r in df.collect() if r.g]
    assert got == {(a.id, b.id) for a in rows for b in rows if a.id < b.id and a.g == b.g}
    some = pairs.pairs_within(df, "g", "id", ("v",), F.col("v_a") != F.col("v_b"), block=4).collect()
    assert {(r.id_a, r.id_b) for r in some} == {(a.id, b.id) for a in rows for b in rows if a.id < b.id and a.g == b.g and a.v != b.v}


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_before_equals_a_plain_sum(spark):
    rows = [(k % 3, i // 7, i, (i * 37) % 11) for k in range(3) for i in range(50)]
    got = running_before(spark.createDataFrame(rows, "k int, chunk int, i int, v int"), ["k"], "chunk", ["i"], F.col("v"), "s")
    for r in got.collect():
        assert r.s == sum(v for k, _, i, v in rows if k == r.k and i < r.i)


def test_ordinals_pages_and_order(spark):
    t = datetime.datetime(2031, 1, 1)
    rows = [(i * 70_000, t if i % 3 else None) for i in range(1, 26)]
    df = search.with_ordinal(spark.createDataFrame(rows, "id long, created_at timestamp_ntz"))
    assert [r.seq_num for r in df.orderBy("id").collect()] == list(range(1, 26))
    second = search.page(df, 2, 10, "asc").collect()
    assert len(second) == 10 and second[0].total == 25 and second[0].total_pages == 3
    assert search.page(df, 99, 1000, "asc").first().page == 1
    assert search.page(df.filter("id < 0"), 1, 10).count() == 0
    assert df.orderBy(*search.in_order("asc")).first().created_at is None


@pytest.mark.parametrize(("text", "term", "found"), [("A\\frac{1}", "\\FRAC", True), ("É", "é", False), ("a_b", "a_b", True), ("axb", "a_b", True), ("100%", "%", True), (None, "a", None), ("", "", True)])
def test_like_folds_ascii_only_and_knows_no_escape(spark, text, term, found):
    assert one(spark, lambda c: values.like_ci(c, term), text) == found


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (latex.fill_in_macro, r"x\fillin[a][b] \underline{ab} ____ y}", r"x\fillin \fillin \fillin y}"),
        (latex.structured_form, r"\FILLIN", "fill_in_blank"),
        (latex.structured_form, r"\begin { choices }\fillin", "choice"),
        (latex.structured_form, r"\fillin的", None),
        (latex.named_form, " 单选题 ", "choice"),
        (latex.named_form, None, "unknown"),
        (latex.choice_stem, "求 $x$ 的值（　　）", "求 $x$ 的值"),
        (latex.choice_stem, r"则 $x=1 $(\quad)$", "则 $x=1$"),
        (latex.to_markdown, r"\begin{choices}\item 1\item 2\end{choices}", "- A. 1\n- B. 2"),
        (latex.to_markdown, r"\item[A.] x\\\\y \underline{\hspace{2cm}}", "- A.  x\ny _______"),
        (latex.literal_breaks, r"a\nb\nu", "a\\nb\\nu"),
        (latex.literal_breaks, r"a\n（1）", "a\n（1）"),
        (latex.source_prefix, "10. (2019·全国·高考真题)已知", "2019·全国·高考真题"),
        (latex.without_source_prefix, "10. (2019·全国·高考真题)、已知", "已知"),
        (latex.stem_paragraphs, "甲\n乙\n\n（1）丙\n丁\n（2）戊", "甲 乙\n\n（1）丙 丁\n\n（2）戊"),
        (latex.json_envelope, '```json\nx {"a": [1]} y\n```', '{"a": [1]}'),
        (latex.file_name, 'a/b:c', "a_b_c"),
        (latex.safe_asset, "/static/../x.png", None),
        (latex.safe_asset, "\\static\\x.png", "static/x.png"),
        (latex.escaped_text, "a_b\\{", r"a\_b\textbackslash{}\{"),
        (latex.balanced, r"{a\}{b}}", True),
        (latex.balanced, "}{", False),
        (latex.formula, r"$$\displaystyle x\lt 1$$", "x<1"),
        (latex.token_estimate, "中文ab", 3),
    ],
)
def test_text_functions(spark, function, text, expected):
    assert one(spark, function, text) == expected


def is_room(s):
    """Nothing but blanks, gaps and spacing commands."""
    for command in ("\\qquad", "\\quad"):
        s = s.replace(command, " ")
    return not re.sub(r"\\hspace\{[^{}]*\}|_", " ", s).strip()


def stem_without_brackets(text):
    """SCA4 in plain Python: pairs of brackets are taken off the end one by one."""
    text = (text or "").strip()
    while True:
        around = text.endswith("$")
        rest = text[:-1].rstrip() if around else text
        at = max(rest.rfind("("), rest.rfind("（"))
        if rest[-1:] not in (")", "）") or at < 0:
            break
        inside, before = rest[at + 1 : -1], rest[:at].rstrip()
        within = inside.strip()
        if around and before.endswith("$") and is_room(inside):
            text = before[:-1].rstrip()
        elif not around and (is_room(inside) or len(within) > 1 and within[0] == within[-1] == "$" and is_room(within[1:-1])):
            text = before
        else:
            break
    words = re.split(r"\\paren(?!\w)", text)
    text = "".join(words).strip()
    signs = [k for k, c in enumerate(text) if c == "$" and text[k - 1 : k] != "\\"]
    if len(signs) % 2 == 0:
        return text
    return text[:-1].rstrip() if signs[-1] == len(text) - 1 else text + "$"


def test_whole_choice_stems_equal_brute_force(spark, data, tmp_path):
    texts = [
        "甲\n乙（　　）", "甲（　　）\n乙", "甲\n乙( )\n（ ）  ", "甲\n$x=1 $(\\quad)$", "甲 $y$\n（$\\qquad$）", "甲\u2003(\u2003\\hspace{1cm}_)\u2003", "甲 \\paren\n乙", "\\parens \\paren的", "甲\n$x", "甲 $x$\n乙\u2003$", "甲\\$\n",
        "甲$x$()\n()()", "甲(" + "_ " * 9000 + ")", "甲\x1c(\x1d)", "", None, "（　　）", "没有括号\n$1$",
    ]
    spark.createDataFrame(list(enumerate(texts)), "id long, content string").write.parquet(str(tmp_path / "questions.parquet"))
    for d in (str(tmp_path), data):
        content = {r.id: r.content for r in spark.read.parquet(f"{d}/questions.parquet").select("id", "content").collect()}
        assert {r.id: r.stem for r in registry.queries()["sca4_whole_stems"](spark, d).collect()} == {i: stem_without_brackets(t) for i, t in content.items()}


def test_locks_of_every_stem_and_sources_of_whole_papers(spark, tmp_path):
    stems = {1: r"a $$x$$ b \$5 $y$", 2: r"\[u\] \(v\) \begin{cases}a\end{cases}", 3: "open $z", 4: "", 5: None}
    spark.createDataFrame(list(stems.items()), "id long, content string").write.parquet(str(tmp_path / "questions.parquet"))
    spark.createDataFrame([(7, "T"), (8, None)], "id long, title string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([(7, 2, 1), (7, 1, 2), (7, 99, 3)], "paper_id long, question_id long, order_index int").write.parquet(str(tmp_path / "paper_questions.parquet"))
    rows = registry.queries()["doc9_all_locks"](spark, str(tmp_path)).collect()
    assert {r.id: r.originals for r in rows} == {1: ["$$x$$", "$y$"], 2: [r"\[u\]", r"\(v\)", r"\begin{cases}a\end{cases}"], 3: [], 4: [], 5: []}
    assert all(r.n_locks == len(r.originals) for r in rows)
    sources = {r.id: r for r in registry.queries()["sca18_tex_sources"](spark, str(tmp_path)).collect()}
    body = sources[7].body
    assert sources[7].title == "T" and body.count("\\question") == 2 and 0 <= body.index(stems[2]) < body.index(stems[1])
    assert "\\question" not in sources[8].body


def test_figures_of_every_stem(spark, tmp_path):
    drawing = "\\begin{tikzpicture}\n\\draw;\n\\end{tikzpicture}"
    cases = {
        1: ("![a](u/a.png) ![](b.png) ![](u/a.png)", ["u/a.png", "b.png"]), 2: ("\\includegraphics[width=1cm]{c.png}", ["c.png"]), 3: (f"![](u/tikz_1.png) {drawing} ![](d.png) {drawing}", [drawing, drawing, "d.png"]),
        4: ("![](tikz_1.png)", ["tikz_1.png"]), 5: ("none", []), 6: (None, []),
    }
    spark.createDataFrame([(i, c) for i, (c, _) in cases.items()], "id long, content string").write.parquet(str(tmp_path / "questions.parquet"))
    assert {r.id: r.figures for r in registry.queries()["sca37_all_figures"](spark, str(tmp_path)).collect()} == {i: f for i, (_, f) in cases.items()}


@pytest.mark.parametrize(("text", "pages"), [("1-2,2,3", [0, 1, 2]), (" ", [0, 1, 2]), ("3", [2])])
def test_page_range(spark, text, pages):
    assert one(spark, lambda c: latex.page_range(c, F.lit(3)), text) == pages


@pytest.mark.parametrize("text", ["0", "4", "2-1", "a", "1,,2"])
def test_page_range_refuses(spark, text):
    with pytest.raises(Exception, match="page range"):
        one(spark, lambda c: latex.page_range(c, F.lit(3)), text)


@pytest.mark.parametrize(("text", "parts"), [("v2.0.1", (2, 0, 1)), ("2.1.0-beta", (2, 1, 0)), ("V3", (3, 0, 0)), (None, (0, 0, 0))])
def test_version(spark, text, parts):
    assert tuple(one(spark, latex.version_tuple, text)) == parts


def test_repair_keeps_latest_and_joins_null_and_zero(spark):
    items = spark.createDataFrame([(1, 1, 1, 0, 5), (2, 1, 1, 0, 10), (3, 1, 9, 1, 5), (4, 1, 1, None, 20), (5, 1, 1, 2, -3)], "id long, paper_id long, question_id long, order_index int, score int")
    p, q = spark.createDataFrame([(1, 0)], "id long, total_score int"), spark.createDataFrame([(1,)], "id long")
    clean = repair.clean_items(items, p, q)
    assert sorted((r.id, r.order_index, r.score) for r in clean.collect()) == [(4, 0, 20), (5, 2, 0)]
    assert repair.totals(p, clean).first().total_score == 20


def test_groups_join_and_break_up(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, ""), (6, None)], "id long, association_group_id string")
    joined = repair.associate(q, spark.createDataFrame([(2, 3), (5, 6)], "a long, b long"))
    assert {r.id: r.group_id for r in joined.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    left = repair.dissociate(q, spark.createDataFrame([(1,)], "id long"))
    assert {r.id: r.association_group_id for r in left.collect()} == {1: "", 2: "", 3: "b", 4: "b", 5: "", 6: ""}


def test_chosen_and_list_order(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert [r.id for r in papers.in_list_order(df, [3, 9, 1, 3]).collect()] == [3, 1, 3]
    assert [r.id for r in papers.chosen(df, ["x", 3, "3", 9, 1, 2], 2).collect()] == [3, 1]


def test_pages_and_moves(spark):
    df = spark.createDataFrame([([300, 320, 1000, 1, 900],)], "h array<int>")
    assert df.select(papers.pages_of(F.col("h")).alias("p")).first().p == [1, 1, 2, 3, 3]
    items = spark.createDataFrame([(1, p, 10 + p, "a" if p % 2 else "b") for p in range(6)], "paper_id long, pos int, id long, question_type string")
    assert [r.id for r in papers.moved(items, "a", 0, 2).orderBy("pos").collect()] == [10, 13, 12, 15, 14, 11]
    assert [r.id for r in papers.moved(items, "a", 0, 5).orderBy("pos").collect()] == [10, 11, 12, 13, 14, 15]


def test_formula_loss_and_types(spark):
    rows = [(1, 0, "设 ， 为 A. B. C. D.", False), (1, 1, "$x$ 好", False), (2, 0, None, False), (3, 0, "好", False), (3, 1, "好", True)]
    pages = documents.routed(spark.createDataFrame(rows, "doc_id long, page_index int, markdown string, needs_ocr boolean").withColumn("images", F.lit(0)))
    assert {r.doc_id: (r.kind, r.ocr_pages) for r in documents.document_types(pages).collect()} == {1: ("mixed", [0]), 2: ("scanned", [0]), 3: ("mixed", [1])}


def test_attribution_ties_and_nothing(spark):
    q = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "，。"), (1, 3, "zz")], "doc_id long, q long, content string")
    p = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "xabcdx"), (1, 3, ""), (1, 4, "zz")], "doc_id long, page_index int, markdown string")
    assert {r.q: r.page_index for r in documents.attributed(q, p).collect()} == {1: 1, 2: 0, 3: 4}


def test_attribution_within_and_across_tasks(spark):
    import random

    r = random.Random(5)
    text = lambda letters, sizes: r.choice([None, *["".join(r.choice(letters) for _ in range(r.choice(sizes)))] * 6])
    q, p = [(None, 0, "abc")], [(None, 3, "abc"), (5, None, "abc")]
    for d in range(60):
        letters = "ab1中文\n $龥一" if d % 2 else "abcdefghij中文字母。"
        p += [(d, 2 * k - 1, text(letters, (0, 1, 2, 3, 5, 30, 200))) for k in range(r.choice([0, 1, 9, 40]))]
        q += [(d, 100 * d + k + 1, text(letters, (0, 1, 2, 3, 5, 30))) for k in range(r.choice([0, 1, 5, 60]))]
    expected = {}
    grams = lambda t: (lambda s: {s[k : k + 3] for k in range(max(1, len(s) - 2))} - {""})("".join(c for c in t or "" if c.isascii() and c.isalnum() or "一" <= c <= "龥"))
    for d, k, t in q:
        shared = [(len(grams(t) & grams(m)), -i, i) for e, i, m in p if e == d and d is not None and i is not None]
        expected[k] = max((x for x in shared if x[0]), default=(0, 0, 0))[2]
    questions, pages = spark.createDataFrame(q, "doc_id long, q long, content string"), spark.createDataFrame(p, "doc_id long, page_index int, markdown string")
    for heavy in (documents.HEAVY, 900, 0):
        got = documents.attributed(questions, pages, heavy=heavy).collect()
        assert len(got) == len(q) and {x.q: x.page_index for x in got} == expected


def test_attribution_shuffles_texts_not_shingles(spark, data):
    from tessella.plans.documents import doc4_attribution

    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    none = gateway.jvm.java.util.ArrayList()
    written = lambda: sum(s.shuffleWriteRecords() for s in (lambda l: [l.apply(k) for k in range(l.size())])(store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)))
    before, items = written(), spark.read.parquet(f"{data}/paper_questions.parquet").count()
    doc4_attribution(spark, data).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 20 * items


def test_assets_match_by_names_not_parts(spark):
    refs = spark.createDataFrame([("FIG\\A.png",), ("a",)], "ref string")
    assets = spark.createDataFrame([("x/a.png",), ("x/data.png",)], "asset string")
    assert {tuple(r) for r in documents.matched_assets(refs, assets).collect()} == {("FIG\\A.png", "x/a.png"), ("a", "x/a.png")}


def test_lifecycle_first_terminal_wins(spark):
    t = datetime.datetime(2031, 1, 1)
    rows = [(1, 1, t, "running", 10.0), (1, 2, t, "cancelled", 0.0), (1, 3, t, "completed", 1.0), (2, 1, t, "running", 30.0)]
    got = {r.task_id: (r.state, r.progress) for r in tasks.lifecycle(spark.createDataFrame(rows, "task_id long, seq long, ts timestamp_ntz, kind string, progress double")).collect()}
    assert got == {1: ("cancelled", 0.0), 2: ("running", 30.0)}


def test_admission_and_fallback(spark):
    t = datetime.datetime(2031, 1, 1)
    states = spark.createDataFrame([(i, "completed" if i < 6 else "running", t + datetime.timedelta(hours=i)) for i in range(8)], "task_id long, state string, updated_at timestamp_ntz")
    assert sorted(r.task_id for r in tasks.admitted(states, 4).collect()) == [4, 5, 6, 7]
    a = spark.createDataFrame([(1, 1, "a", "error"), (1, 2, "b", "ok"), (2, 1, "a", "timeout"), (2, 2, "b", "ok")], "request long, priority int, provider string, outcome string")
    assert {r.request: r.provider for r in tasks.first_success(a).collect()} == {1: "b", 2: None}


def test_snapshots(spark, tmp_path, data):
    folder = str(tmp_path / "snap")
    q = spark.read.parquet(f"{data}/questions.parquet")
    snapshots.write_snapshot({"questions": q, "none": q.limit(0)}, folder)
    assert snapshots.verify_snapshot(spark, folder) == []
    q.limit(3).write.mode("overwrite").parquet(f"{folder}/questions")
    assert snapshots.verify_snapshot(spark, folder) == ["questions"]
    now = datetime.datetime(2031, 1, 3)
    s = spark.createDataFrame([("a", now - datetime.timedelta(hours=30), True), ("b", now - datetime.timedelta(hours=1), False)], "path string, at timestamp_ntz, valid boolean")
    assert snapshots.is_due(s, now) and not snapshots.is_due(s.withColumn("valid", F.lit(True)), now)
    assert [r.path for r in snapshots.to_drop(s, 1).collect()] == ["a"]
    snapshots.export_questions(q, str(tmp_path / "export"))
    assert spark.read.text(f"{tmp_path}/export/json").count() == q.count()


def test_files_above_the_limit_are_left_out(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"x" * 10)
    (tmp_path / "b.tex").write_bytes(b"x" * 100)
    assert [r.path.rsplit("/")[-1] for r in snapshots.read_files(spark, f"file://{tmp_path}/*.tex", 50).collect()] == ["a.tex"]
