"""The training-data operators against brute force, exact round trips and small cases."""

import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import answers, canonical, forms, mixing, neardup, packing, registry, scans, sentences, textform, tokens

ODD = ["ȩ́a", "각x", "Å½①ﬁ Ⅱ℃", "ｶﾞ", "क़ো", "a\r\nb­", "", "́a", "q̣̇", "각́ё ё", "각", "̈́ḉ", "ΩÅ", "\U0001d15e x", "ＡＢ　c", "ко́т", "x²x₂①", "​﻿", "e​́ a­̧́ q​̣​̇", "ᄀ​ᅡ﻿ᆨ"]


# ------------------------------------------------------------------ problem 2


def test_common_form_equals_plain_python(spark):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(ODD)] + [(99, None, None)], "id long, s string, form string").withColumn("pos", F.lit(1)).withColumn("ch", F.lit("x"))
    for whole in (False, True):
        got = {r.id: r.form for r in textform.common_form(df, "s", "form", whole).collect()}
        assert got == {i: forms.common_form_py(s) for i, s in enumerate(ODD)} | {99: None}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFFF), max_size=12), min_size=1, max_size=60))
def test_common_form_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = {r.id: r.form for r in textform.common_form(df, "s", "form").collect()}
    assert got == {i: forms.common_form_py(s) for i, s in enumerate(texts)}


def test_print_alike_pairs(spark):
    rows = [(1, "Ａ，b"), (2, "A,b"), (3, "A,b"), (4, "a,b"), (5, "А,b"), (6, "x²"), (7, "x2"), (8, "a b"), (9, "a　b"), (10, "ab"), (11, None), (12, ""), (13, "​")]
    got = {tuple(r) for r in textform.print_alike_pairs(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert got == {(1, 2), (1, 3), (1, 5), (2, 5), (3, 5), (8, 9), (12, 13)}
    assert textform.print_alike_pairs(spark.createDataFrame([], "id long, content string")).count() == 0


def test_many_equal_stems_and_one_variant(spark):
    rows = spark.range(20000).select("id", F.lit("求 x，y").alias("content")).union(spark.createDataFrame([(50000, "求 x,y"), (50001, "求 ｘ,y")], "id long, content string"))
    got = textform.print_alike_pairs(rows)
    assert got.count() == 40001 and got.filter("id_a >= id_b").isEmpty() and got.distinct().count() == 40001


# ------------------------------------------------------------------ problem 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pigeonhole_join_misses_nothing(spark):
    import random

    rng = random.Random(3)
    entries = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (5, 6, 7, 8, 9, 10) for _ in range(6)]
    values = []
    for e in entries:
        for _ in range(6):
            s = list(e)
            for _ in range(rng.randint(0, 3)):
                k, what = rng.randrange(len(s)), rng.choice("idst")
                if what == "i":
                    s.insert(k, rng.choice("abcdef"))
                elif what == "d" and len(s) > 3:
                    del s[k]
                elif what == "s":
                    s[k] = rng.choice("abcdef")
                elif k + 1 < len(s):
                    s[k], s[k + 1] = s[k + 1], s[k]
            values.append("".join(s))
    v = spark.createDataFrame([("L", x) for x in set(values)], "list string, value string")
    e = spark.createDataFrame([("L", x, i) for i, x in enumerate(entries)], "list string, entry string, ord long")
    got = {r.value: (r.entry, r.distance) for r in canonical.match(v, e).collect()}
    for x in set(values):
        near = [d for y in entries if (d := edits(x, y)) <= min(2, (len(y) - 1) // 2)]
        assert (got[x][1] == min(near)) if near else got[x] == ("", None)


@pytest.mark.parametrize(
    ("typed", "entry"),
    [("2、複數平面初步", "2. 复数平面初步"), ("第 2 章  复平数面初步（复习）", "2. 复数平面初步"), ("U2-复数平面初~", "2. 复数平面初步"), ("Ch.2 复数平面　初步单元", "2. 复数平面初步"), ("化学平衡", ""), ("？？？", ""), ("tmp_12", "")],
)
def test_typed_values(spark, typed, entry):
    e = spark.createDataFrame([("A/chapter", "2. 复数平面初步", 1), ("A/chapter", "3. 空间图形度量", 2)], "list string, entry string, ord long")
    v = spark.createDataFrame([("A/chapter", typed)], "list string, value string")
    assert canonical.match(v, e).first().entry == entry


def test_canonical_values_leave_out_blanks_and_exact_ones(spark, data):
    q = spark.createDataFrame([(1, "2. 复数平面初步", " "), (2, None, "2.1複数四则演算"), (3, "复数平面初步 ", "")], "id long, category_chapter string, category_knowledge string").withColumn("list", F.lit("x"))
    c = spark.createDataFrame([(7, 1, "B", "指对运算及增长"), (8, 1, None, "第一章 指对运算与增长")], "id long, question_id long, version_code string, chapter string")
    tree = spark.read.parquet(f"{data}/curriculum_tree.parquet")
    got = {tuple(r) for r in canonical.canonical_values(q, c, tree).collect()}
    assert got == {
        ("questions", 2, "category_knowledge", "2.1 复数四则演算"), ("questions", 3, "category_chapter", "2. 复数平面初步"),
        ("question_curriculums", 7, "chapter", "第一章 指对运算与增长"), ("question_curriculums", 8, "chapter", ""),
    }
    assert {tuple(r) for r in canonical.canonical_values(q, c, tree, limit=0).collect()} == got  # the way beyond the broadcast limit
    assert canonical.canonical_values(q.limit(0), c.limit(0), tree).count() == 0


# ------------------------------------------------------------------ problem 4


def grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def test_near_duplicates_equal_brute_force(spark, data):
    q = spark.read.parquet(f"{data}/questions.parquet").select("id", "content", "source")
    extra = spark.createDataFrame([(90001, None, None), (90002, "ab", ""), (90003, "ab", None), (90004, "", "")], "id long, content string, source string")
    again = q.limit(5).withColumn("id", F.col("id") + 100000)
    edited = q.limit(9).withColumn("id", F.col("id") + 200000).withColumn("content", F.concat("content", F.lit("另加几字")))
    df = q.unionByName(extra).unionByName(again).unionByName(edited)
    found = neardup.NearDuplicates(df)
    ways = [found, neardup.NearDuplicates(df, exact=True), neardup.NearDuplicates(df, collections=8, width=1, reach=4, deviations=None)]
    got, *others = [{tuple(r) for r in x.pairs().collect()} for x in ways]
    assert others[0] == got and others[1] <= got
    texts = {r.id: r.content + " " + (r.source or "") if r.content else " " + (r.source or "") for r in df.collect()}
    keys = {i: "".join(c for c in forms.common_form_py(t).lower() if unicodedata.category(c)[0] in "LN") for i, t in texts.items()}
    sets = {i: grams(k) for i, k in keys.items() if len(k) >= 3}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == expected
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert set(groups) == {i for p in expected for i in p} and all(groups[a] == groups[b] for a, b in expected)
    assert neardup.NearDuplicates(df.limit(0)).pairs().count() == 0


def test_key_texts_of_any_characters():
    import random

    import numpy as np

    rng = random.Random(1)
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ODD + ["".join(rng.choices(every, k=rng.randint(0, 6))) for _ in range(5000)] + ["数列ABc"]
    rng.shuffle(texts)
    letters, sizes = neardup.key_letters(texts)
    joined, ends = letters.tobytes().decode("utf-32-le"), np.cumsum(sizes)
    assert [joined[e - n : e] for e, n in zip(ends, sizes, strict=True)] == [neardup.key_text(t) for t in texts]


def test_exact_pairs_of_drifting_records(spark):
    base = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    rows = [(k, base[:k] + chr(0x7000 + k) * 3 + base[k:], "") for k in range(40)] + [(100 + k, base[k : k + 40], "") for k in range(20)]
    sets = {i: grams(t) for i, t, _ in rows}
    for s in (0.5, 0.7, 0.8, 1.0):
        got = {tuple(r) for r in neardup.NearDuplicates(spark.createDataFrame(rows, "id long, content string, source string"), similarity=s, exact=True).pairs().collect()}
        assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])}


def test_a_hot_class_of_copies_is_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    text = "已知函数的图像关于原点对称且在区间上单调递增求参数的取值范围并说明理由"
    rows = [(k, text, "") for k in range(40)] + [(100 + k, text + "另", "") for k in range(25)] + [(200, text + "另加", "")]
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "id long, content string, source string"))
    ids = [r[0] for r in rows]
    got = [tuple(r) for r in found.pairs().collect()]
    assert sorted(got) == sorted(itertools.combinations(ids, 2))
    assert {r.id: (r.group_id, r.n_links) for r in found.groups().collect()} == {i: (0, 2) for i in ids}


def test_records_behind_a_key_are_compared_as_arrays(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    k = np.sort(np.concatenate([r.integers(-300, 300, 1200), np.full(90, 17), np.full(200, 400)]))
    n = len(k)
    ids, sketches = r.permutation(n), r.integers(-(2**62), 2**62, (3, 6))[:, r.integers(0, 6, n)] ^ (1 << r.integers(0, 62, (3, n)))
    rows = pa.record_batch([pa.array(x) for x in (k, ids, *sketches)], ["k", "id", *neardup.SKETCH])
    bits = np.bitwise_count((sketches[:, :, None] ^ sketches[:, None, :]).view(np.uint64)).sum(0)
    for hot, following, together in ((1 << 17, 32, 1 << 16), (50, 4, 64), (20, 3, 30)):
        for name, value in (("HOT", hot), ("NEXT", following), ("ROWS", together)):
            monkeypatch.setattr(neardup, name, value)
        for most in (None, 50):
            out = [x for b in neardup._meeting(most)(iter([rows.slice(i, 37) for i in range(0, n, 37)])) for x in b.to_pylist()]
            rest = {x["k"] for x in out if x["b"] is None}
            assert sum(x["b"] is None for x in out) == np.isin(k, list(rest)).sum() and (hot > n) == (not rest)
            near = (k[:, None] == k) & ~np.isin(k, list(rest)) & (ids[:, None] < ids) & (most is None or bits <= most)
            assert sorted((x["a"], x["b"]) for x in out if x["b"] is not None) == sorted((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True))


def test_keys_beyond_a_task_are_laid_out_in_blocks(spark, monkeypatch):
    text = "已知函数的图像关于原点对称且在区间上单调递增求参数的取值范围并说明理由"
    df = spark.createDataFrame([(k, text + 3 * chr(0x4E00 + 40 * k), "") for k in range(30)], "id long, content string, source string")
    assert neardup._most_differing(0.7, 192, 4.2) == 50
    # functions go to the workers as they are in the module, so the limits of one task are set where the pairs are planned
    meeting = neardup._meeting
    monkeypatch.setattr(neardup, "_meeting", lambda most: _few_rows(meeting(most)))
    assert sorted(map(tuple, neardup.NearDuplicates(df).pairs().collect())) == list(itertools.combinations(range(30), 2))


def _few_rows(meet):
    def limited(batches):
        neardup.ROWS, neardup.HOT = 4, 8
        yield from meet(batches)
        neardup.ROWS, neardup.HOT = 1 << 16, 1 << 17

    return limited


def test_pairs_just_close_enough_are_met(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA6, n)))
    rows = []
    for k in range(4000):  # 71 sequences of 101 in both: a similarity of 0.703
        both = letters(73)
        rows += [(2 * k, both + letters(15), ""), (2 * k + 1, both + letters(15), "")]
    got = {tuple(r) for r in neardup.NearDuplicates(spark.createDataFrame(rows, "id long, content string, source string")).pairs().collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(4000)}
    assert len(got) >= 0.993 * 4000


# ------------------------------------------------------------------ problem 1


@pytest.fixture(scope="module")
def judged(spark, data):
    q, d = spark.read.parquet(f"{data}/questions.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    stem = "数列 $\\{a_n\\}$ 满足 $a_{n+1}=17a_n+88$，且首项等于小菱记下的 $304$。求参数 $k$ 的取值范围。"
    cases = {
        900001: (stem, None, "empty"), 900002: (stem, "[EXTRACTED_ORIGINAL]\n**解答** ", "empty"), 900003: (stem, "<p></p>​", "empty"), 900004: (stem, "C", None),
        900005: (stem, "抱歉，我无法解答这道题。", "refusal"), 900006: (stem, "因此已知条件不足，无法确定 $k$ 的值。", None), 900007: (stem, "解：" + stem, "copy"), 900008: (stem, stem[:-14], "copy"),
        900009: (stem, stem + "\n解：由余弦定理知 $c^2=139$。整理后有 $x=\\frac{3}{4}$，代入得 $y=45$，所以答案为 $\\frac{62}{88}$。", None),
        900010: (stem, "From the given data we get $x=1$. Rearranging yields $x=2$. Hence the answer is $3$.", "other_language"),
        900011: (stem, "解：由余弦定理知 $c^2=139$。因为", "truncated"), 900012: (stem, "解：由余弦定理知 $c^2=13", "truncated"), 900013: (stem, "所以答案为 $\\frac{62}{88}$。", None), 900014: (None, "$5$", None), 900015: (stem, "$x=3$", None),
    }
    extra = spark.createDataFrame([(i, a, b) for i, (a, b, _) in cases.items()], "id long, content string, answer_markdown string")
    both = q.select("id", "content", "answer_markdown").unionByName(extra).withColumn("defect", F.lit("a name that clashes"))
    return cases, {r.id: r.defect for r in answers.defective_pairs(both, d).collect()}


def test_defects(judged):
    cases, got = judged
    assert {i: got.get(i) for i in cases} == {i: c[2] for i, c in cases.items()}


def test_refusals_of_any_length_and_with_formulas():
    question = "Solve $x^2=4$ for $x$."
    judge = lambda s: answers.classify([1], [question], [s], None)[0]
    assert answers.is_refusal("I cannot help with solving $x^2=4$.")
    assert judge("I cannot help with this. You asked about $x^2=4$ and $x$.") == [(1, "refusal")]
    assert judge("抱歉，我无法解答这道题。" + "请向老师询问，或者查阅课本中的相关章节。" * 40) == [(1, "refusal")]
    assert not answers.is_refusal("We cannot give a solution by factoring. So we take roots and find $x=2$.", question)
    assert not answers.is_refusal("We cannot solve it by factoring.\nThen x = 2 or x = -2.", question)


def test_truncation_and_language_with_wording_of_another_domain(spark):
    import random

    rng = random.Random(11)
    english = ["Chop the {n} and put {k} spoons of {m} beside it.", "Heat the {m} until the {n} turns brown.", "When the {n} is ready, serve it with {m}.", "Let the {n} rest for {k} minutes because the {m} is hot."]
    spanish = ["Corte la {n} y ponga {k} cucharas de {m} al lado.", "Caliente el {m} hasta que la {n} quede dorada.", "Cuando la {n} esté lista, sirva con {m}.", "Deje la {n} por {k} minutos porque el {m} quema."]
    nouns = {"en": ["carrot", "onion", "butter", "pepper", "garlic", "rice", "lentil", "tomato"], "es": ["zanahoria", "cebolla", "mantequilla", "pimienta", "harina", "sal", "lenteja", "aceituna"]}

    asked = {"en": ["How should one store {k} pieces of {n} and {m}?", "Which {n} goes well with a bowl of {m}?"], "es": ["¿Cómo se guardan {k} piezas de {n} y {m}?", "¿Qué {n} va bien con un plato de {m}?"]}

    def text(language, n, lines=None):
        lines = lines or (english if language == "en" else spanish)
        return " ".join(rng.choice(lines).format(n=rng.choice(nouns[language]), m=rng.choice(nouns[language]), k=rng.randint(2, 90)) for _ in range(n))

    rows, truth = [], {}
    for i in range(6000):
        language = "en" if i % 3 else "es"
        question, answer = text(language, 3, asked[language]), text(language, 4)
        if i % 20 == 7:
            words = answer.split(" ")
            cut = rng.randrange(6, len(words) - 1)
            while words[cut - 1].endswith("."):
                cut -= 1
            answer, truth[i] = " ".join(words[:cut]), "truncated"
        elif i % 20 == 13:
            answer, truth[i] = text("es" if language == "en" else "en", 4), "other_language"
        rows.append((i, question, answer))
    docs = spark.createDataFrame([(i, text(x, 6), x) for i in range(400) for x in [("en", "es")[i % 2]]], "doc_id long, text string, lang string")
    got = {r.id: r.defect for r in answers.defective_pairs(spark.createDataFrame(rows, "id long, content string, answer_markdown string"), docs).collect()}
    right = sum(got.get(i) == d for i, d in truth.items())
    assert right >= 0.95 * len(truth) and right >= 0.95 * len(got)
    none = docs.limit(0)
    assert answers.defective_pairs(spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "b", "")], "id long, content string, answer_markdown string"), none).count() == 2
    assert answers.defective_pairs(spark.createDataFrame([], "id long, content string, answer_markdown string"), none).count() == 0


def test_language_model_on_held_out_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    model = answers.fit_languages(d.filter("doc_id % 2 = 0"), 50)
    held = [r for r in d.filter("doc_id % 2 = 1 and length(text) > 120").collect() if r.lang in model.languages]
    guess = model.scores([answers.prose(r.text) for r in held]).argmax(1)
    assert sum(model.languages[g] == r.lang for g, r in zip(guess, held, strict=True)) >= 0.9 * len(held)


# ------------------------------------------------------------------ problem 5


def test_scan_noise_and_repair(spark, data):
    stems = spark.read.parquet(f"{data}/questions.parquet").select("id", "content", "answer_markdown")
    page = lambda i, body: (i, f"甲乙丙丁戊己庚辛\n数学周练 · 新编习题集第{i}页上\n{body}", None)
    rows = [page(900000 + k, f"壬癸子丑寅卯辰巳{k}") for k in range(8)]
    rows += [
        (900101, "The modulus of the num-\nber is known\n- 12 -\nand so on for ever.", "42"), (900102, "设函数\n51\n37\n70", ""), (900103, "求值\n第 3 页 共 9 页\n并说明理由。", None), (900104, "", None),
        *[(900105 + k, f"Section {k} | Review    ~ {k} ~\n求值", None) for k in range(3)],
    ]
    df = stems.unionByName(spark.createDataFrame(rows, "id long, content string, answer_markdown string")).withColumn("kind", F.lit("x"))
    got = {(r.id, r.field, r.kind) for r in scans.scan_noise(df).filter("id >= 900000").collect()}
    assert {(900101, "content", "hyphen"), (900101, "content", "page_no"), (900103, "content", "page_no"), (900105, "content", "header"), (900105, "content", "page_no")} <= got
    assert not [x for x in got if x[0] in (900102, 900104) or x[1] == "answer_markdown"]
    text = {(r.id, r.field): r.text for r in scans.repaired_texts(df).filter("id >= 900000").collect()}
    assert text[900101, "content"] == "The modulus of the number is known and so on for ever."
    assert text[900102, "content"] == "设函数\n51\n37\n70" and text[900101, "answer_markdown"] == "42"


@pytest.mark.parametrize("n", [400, 1600])
def test_scan_noise_in_wording_of_its_own(spark, n, monkeypatch):
    import random

    if n > 400:
        monkeypatch.setattr(scans, "WORDS_AT_ONCE", 3)  # several passes
    rng = random.Random(n)
    syllables = ["ran", "mel", "tor", "clin", "hu", "dow", "sem", "lim", "vor", "nud"]
    lexicon = sorted({"".join(rng.choices(syllables, k=rng.randint(2, 3))) for _ in range(30)})
    follows = {w: rng.sample(lexicon, 4) for w in lexicon}
    headers = ["Northern Gazette of Gardens # ", "Handbook for Keepers of Bees, Vol #"]
    rows, truth = [], set()
    for i in range(n):
        words = [rng.choice(lexicon)]
        while len(words) < 40:
            words.append(rng.choice(follows[words[-1]]))
        if i % 10 == 3:
            k = next((k for k, w in enumerate(words) if scans.readings(w) and "rn" not in w and "m" in w), None)
            if k is not None:
                words[k] = words[k].replace("m", "rn", 1)
                truth.add((i, "misread"))
        lines = [" ".join(words[k : k + 8]) for k in range(0, 40, 8)]
        if i % 12 == 5:
            lines.insert(2, rng.choice(headers).replace("#", str(i)).strip())
            truth.add((i, "header"))
        if i % 15 == 4:
            lines.insert(3, f"- {i % 90} -")
            truth.add((i, "page_no"))
        rows.append((i, "\n".join(lines), None))
    df = spark.createDataFrame(rows, "id long, content string, answer_markdown string")
    got = {(r.id, r.kind) for r in scans.scan_noise(df).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    if n == 400:
        text = {r.id: r.text for r in scans.repaired_texts(df).collect()}
        assert all(not set(scans.words_of(text[i])) - set(lexicon) for i, kind in truth if kind == "misread" and (i, "misread") in got)


def test_lines_are_judged_by_themselves(spark, monkeypatch):
    import numpy as np
    import xxhash

    drawn = np.random.default_rng(5).integers(0x4E00, 0x9FA6, (200_000, 12))
    same: dict[int, list[str]] = {}
    for line in ("".join(map(chr, x)) for x in drawn):
        same.setdefault(xxhash.xxh64_intdigest(line) % (1 << 22), []).append(line)
    once = next(x for x in same.values() if len(x) == 3)
    first = lambda x: tuple(map(scans._signed, scans.edges_of(x)))
    prose, header = next((a, b) for x in same.values() if len(x) == 2 for a, b in itertools.permutations(x) if all(p < q for p, q in zip(first(a), first(b), strict=True)))
    texts = [f"{x}\n求值。" for x in once] + [f"{header}\n求值。"] * 4 + [f"{prose}\n求值。"] + [f"已知{prose}成立。\n求值。"] * 4
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "id long, content string, answer_markdown string")
    for at_once in (1 << 20, 1):
        monkeypatch.setattr(scans, "LINES_AT_ONCE", at_once, raising=False)
        assert {r.id for r in scans.scan_noise(df).filter("kind = 'header'").collect()} == {3, 4, 5, 6}


def test_readings_and_parts():
    assert "the" in scans.readings("tlie") and "number" in scans.readings("nurnber") and "value" in scans.readings("va1ue")
    assert scans.line_parts("数学周练编    -145-") == ("数学周练编", True) and scans.line_parts("21  285") == ("#  #", False)


# ------------------------------------------------------------------ problem 6


def test_packing_fits_and_loses_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(0, 900, 3000)] + [0, 512, 513, 5000, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("bin_id", F.lit("clash"))
    specs = spark.createDataFrame([(1, 512), (2, 2048), (3, None), (4, 0)], "spec_id long, capacity_tokens int")
    packed = packing.pack(df, specs).cache()
    for spec, capacity in ((1, 512), (2, 2048)):
        rows = packed.filter(F.col("spec_id") == spec).collect()
        assert sum(r["size"] for r in rows) == sum(s or 0 for s in sizes)
        assert {r.doc_id for r in rows} == set(range(len(sizes)))
        assert all(sum(1 for _ in g) == 1 for k, g in itertools.groupby(sorted(r.doc_id for r in rows)) if (sizes[k] or 0) <= capacity)
        loads = packed.filter(F.col("spec_id") == spec).groupBy("bin_id").agg(F.sum("size").alias("l"))
        assert loads.agg(F.max("l")).first()[0] <= capacity
    fill = {r.spec_id: r.fill for r in packing.report(packed).collect()}
    assert set(fill) == {1, 2} and fill[2] > 0.98
    assert packing.pack(df.limit(0), specs).count() == 0


def test_crossover_keeps_every_item():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400)
    a, b = (packing.first_solution(sizes, 256, rng, n) for n in (0.0, 0.5))
    child = packing.crossover(a, b, sizes, 256, rng)
    assert child.min() >= 0 and np.bincount(child, sizes).max() <= 256 and len(child) == 400


def test_evolution_needs_fewer_containers_than_best_fit(spark):
    import numpy as np

    saved = 0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(20, 101, 1000)
        rows = spark.createDataFrame([(k, int(x)) for k, x in enumerate(sizes)], "doc_id long, n_tokens long")
        specs = spark.createDataFrame([(1, 150)], "spec_id long, capacity_tokens int")
        used = packing.pack(rows, specs).select("bin_id").distinct().count()
        plain = len(np.unique(packing.first_solution(sizes.astype(np.int64), 150, rng, 0.0)))
        assert packing.lower_bound(sizes, 150) <= used <= plain
        saved += plain - used
    assert saved > 0


def test_islands_exchange_their_elite():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 101, 300).astype(np.int32)
    row = {"spec_id": 1, "capacity": 150, "block": 0, "doc_id": np.arange(300).tobytes(), "part": np.zeros(300, np.int32).tobytes(), "size": sizes.tobytes(), "island": 0, "population": None, "elite": None, "score": 0.0}
    kinds = pa.schema([("spec_id", pa.int64()), ("capacity", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("doc_id", "part", "size")], ("island", pa.int32()), ("population", pa.binary()), ("elite", pa.binary()), ("score", pa.float64())])
    solved = [next(packing._epoch(0)(iter([pa.RecordBatch.from_pylist([row | {"island": k}], kinds)]))).to_pylist()[0] for k in (0, 1)]
    again = next(packing._epoch(1)(iter([pa.RecordBatch.from_pylist([solved[0] | {"elite": solved[1]["elite"]}], kinds)]))).to_pylist()[0]
    assert again["score"] >= max(s["score"] for s in solved)
    assert len(np.frombuffer(again["population"], np.int32)) == packing.POPULATION * 300


def test_tokens_come_back_exactly(spark):
    enc = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    text = "数列 and <|endoftext|> été"
    assert enc.decode(enc.encode_ordinary(text)) == text
    got = tokens.with_tokens(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: len(enc.encode_ordinary(text)), 2: 0, 3: 0}


# ------------------------------------------------------------------ problem 7


def test_mix_reaches_shares_within_caps(spark):
    rows = [(i, "big", 300) for i in range(4000)] + [(10000 + i, "small", 200) for i in range(300)] + [(20000, None, 5), (20001, "other", 9), (20002, "big", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("slot", F.lit(0))
    targets = spark.createDataFrame([(1, "big", 0.75, 1), (1, "small", 0.25, 3), (2, "none", 0.5, 1), (2, "big", 0.5, 2)], "mix_id long, source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets).cache()
    got = {(r.mix_id, r.source): r for r in mixing.shares(mixed, targets).collect()}
    assert abs(got[1, "big"].share - 0.75) < 0.01 and abs(got[1, "small"].share - 0.25) < 0.01
    assert got[1, "small"].most_repeats <= 3 and got[1, "big"].most_repeats == 1 and got[2, "none"].tokens == 0 and got[2, "big"].share == 1.0
    assert mixed.groupBy("mix_id", "doc_id", "repeat_no").count().filter("count > 1").isEmpty()
    assert got[1, "small"].tokens > 0.9 * 3 * 300 * 200
    assert mixing.mix(df.limit(0), targets).count() == 0


# ------------------------------------------------------------------ problem 8


@pytest.mark.parametrize(
    "units",
    [
        ["多么简洁的构造！", "难道还有别的解法吗？！", "详见第 7.4 节；其余情形类似……", "抛物线到此。"],
        ["“等一下！”小崧津说，“17.4 不是整数啊。”", "一节好课需要一次追问……正如阿榆岭所说。"],
        ["老师问：“你能看出吗？”", "“为什么要换元？”“因为这样更简单。”两位同学一问一答。"],
        ["Dr. Jes asked, \"Is 28.31 prime? Surely not!\" before the bell rang. ", "\"Why twice?\" Wexeth wondered aloud. ", "Use a ruler, a compass, etc. ", "She left at 2 p.m. in Room No. 93."],
        ["J. Hobux wrote version 9.3.4 of it. ", "They chose option C. ", "It follows (incl. Morovan's group) at once."],
        ["Vgl. Abb. 5 auf S. 988, z. B. den Fall. ", "Am 5. Mai beginnt der 85. Wettbewerb in Ulm. ", "Dr. Nar fragte: „Gilt das wirklich?“ und lachte."],
        ["M. Tel demande : « Est-ce vrai ? » puis il sourit. ", "Voir fig. 7, p. 524."],
        ["Учитель спросил: «Верно ли это?» и улыбнулся. ", "Это 5 % и т. д. ", "См. рис. 5 на с. 491, т. е. случай."],
        ["先生は「整数ですか。」と聞いた。", "「図をかこう。それから式だ。」とあおさんは言った。", "なぜか？"],
        ["¡Qué idea! ", "La Dra. Zin midió 3,5 m, pág. 9. ", "¿Por qué?"],
        ["คำตอบคือ $x$ เท่านั้น ", "ทุกคนตรวจสอบ ", "ผลรวม 3 พอดี"],
        ["डॉ. Cas ने हल किए। ", "क्या यह सत्य है?"],
        ["قال د. Jun إن المجموع 4. ", "هل هذه صحيحة؟"],
        ["课堂小结\n\n", "于是有\n$$x=1.5，$$\n所以剩余 3 厘米。"],
    ],
)
def test_sentences(spark, units):
    text = "﻿" + "".join(units)
    got = sentences.sentence_units(spark.createDataFrame([(1, text), (2, None), (3, " …… "), (4, "")], "doc_id long, text string")).orderBy("start_char").collect()
    assert [text[r.start_char : r.end_char] for r in got if r.doc_id == 1] == [u.strip() for u in units]
    assert {r.doc_id for r in got} == {1}


def test_quotations_of_any_length(spark):
    speech = "".join(f"第{k}步成立。" for k in range(400))
    text = f"老师说：“{speech}” 大家明白了。”多余的引号。“没有结束。后面还有。"
    got = [text[r.start_char : r.end_char] for r in sentences.sentence_units(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start_char").collect()]
    assert got == [f"老师说：“{speech}”", "大家明白了。”", "多余的引号。", "“没有结束。", "后面还有。"]


def test_sentences_cover_all_words_once(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").withColumn("pos", F.lit(1))
    texts = {r.doc_id: r.text for r in d.collect()}
    rest = {i: list(t) for i, t in texts.items()}
    for r in sentences.sentence_units(d).collect():
        assert rest[r.doc_id][r.start_char].strip() and rest[r.doc_id][r.end_char - 1].strip()
        rest[r.doc_id][r.start_char : r.end_char] = [" "] * (r.end_char - r.start_char)
    assert not [i for i, t in rest.items() if any(c.isalnum() for c in t)]


# ------------------------------------------------------------------ all queries


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_give_rows_of_their_tables(spark, data, name):
    df = registry.queries()[name](spark, data)
    rows = df.count()
    assert rows > 0
    if "id" in df.columns:
        assert df.join(spark.read.parquet(f"{data}/questions.parquet"), "id", "left_anti").isEmpty()
    if name == "p2_forms":
        assert rows == spark.read.parquet(f"{data}/questions.parquet").count()
    if name in ("p6_bins", "p8_found"):
        assert df.join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "left_anti").isEmpty()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_with_sql(spark, data, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    rel = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(tuple(r[c] for c in names) for r in registry.queries()[name](spark, data).collect()) == sorted(rel.fetchall())
