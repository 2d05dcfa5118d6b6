"""Problem 1: question and answer pairs whose answer is defective.

Method: the languages of question and answer are compared by the posteriors of a naive Bayes model over hashed
character n-grams. It is trained on a bounded sample of labelled documents, then on a bounded sample of pairs, each under the language
its question has, since answers hold other words than documents. Truncation is told by the end-of-text likelihood of an answer's last
units (words, signs, formulas): how often the longest context that is common inside texts stands at an end of an answer, against how often
it stands inside answers, questions and documents. A formula that is still open is a context of its own. Counts are exact, by 64-bit keys
of all texts. Empty answers, refusals and copies are told by what is left of the answer once markers, lead-ins, refusing
sentences or the question's own text are taken away.

Defects are tried in the order empty, refusal, copy, other_language, truncated; a pair has the first that holds.
Null answers are empty; a null question leaves copy and other_language untested. Documents may be an empty table.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.pairs import looked_up
from tessella.plans.lineage import cut, stored

#: Labelled documents per language and pairs that train the language model, buckets and lengths of its hashed n-grams.
TRAIN_PER_LANGUAGE, TRAIN_PAIRS = 200, 4000
LANGUAGE_BUCKETS = 1 << 16
LANGUAGE_GRAMS = (1, 2, 3)
#: By how much an answer must favour its language over the question's, in all and for each character.
MARGIN, MARGIN_EACH = 6.0, 0.7
#: Units in the longest context of an end; its share of all units, and its occurrences, that make it common.
CONTEXT = 4
COMMON_SHARE, COMMON = 3e-6, 20
#: An answer is broken off where its context is less than so many times as likely at an end as anywhere.
END_RATIO = 4.0
#: A last word that goes on within words this many times as often as it stands alone is cut.
CUT_WORD = 10
#: Contexts looked for in one pass over the texts.
KEYS_AT_ONCE = 1 << 20

MARKER = "[EXTRACTED_ORIGINAL]"
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f\u180e]")
# Headings an answer may open with.
LEADS = (
    r"解答?|解析|分析|详解|证明|答案?|参考答案|思路|点评|解説|解答例|証明|answer|solution|proof|explanation|analysis|hint|lösung|beweis|antwort|"
    r"réponse|démonstration|preuve|corrigé|решение|ответ|доказательство|solución|respuesta|demostración|풀이|해설|정답|답"
)
LEAD = re.compile(rf"^(?:[\s>#*_\-–—•]|【(?:{LEADS})】|\[(?:{LEADS})\]|(?:{LEADS})\s*(?:[:：.。]|(?=[\s*_】]|$)))+", re.I)
TAG = re.compile(r"<[^<>]{0,200}>|\\(?:begin|end)\{(?:solution|proof|answer)\}")
# Words by which an answer is refused, by language; every alternative names what is not done.
REFUSAL = re.compile(
    r"(?:无法|不能|不便|没有办法|没办法|难以|拒绝|不予|暂不支持|不支持|不会|恐怕|还给不出|给不出|未能|不方便|无权).{0,14}(?:解答|回答|作答|答案|解法|提供|完成|给出|帮|忙|协助|讨论)|"
    r"(?:帮不上|超出了?我|不在我.{0,6}范围|回答被拦截|生成失败|不予回答|不予作答|爱莫能助)|"
    r"\b(?:can't|cannot|can not|can’t|couldn't|unable to|not able to|won't|will not|decline|refuse|not allowed|do not allow|don't allow|not permitted|rather not|not something i|not in a position)\b.{0,40}"
    r"\b(?:answer|help|assist|solve|solving|solution|provide|complete|discuss|work|giving|give|respond|comply|do)\b|"
    r"\b(?:outside|beyond) what i\b|\bno answer will be\b|\bresponse withheld\b|\bas an? (?:ai|assistant|language model)\b|\bmy guidelines\b|"
    r"(?:darf|kann|möchte|werde) ich .{0,30}nicht|ich (?:kann|darf|möchte|werde) .{0,40}nicht|nicht (?:beantworten|helfen|lösen)|tut mir leid|"
    r"dépasse ce que je|je ne (?:peux|suis|saurais|pourrai)|désolée?\b|je refuse|impossible de (?:répondre|traiter)|"
    r"не (?:могу|в состоянии|имею возможности|буду) .{0,20}(?:помочь|ответ|реш|выполн)|вынужден[аы]? отказ|отказываюсь|"
    r"(?:お答え|回答|お手伝い|対応|解答|お力)(?:は|に|を)?.{0,8}(?:できません|控え|いたしかね|致しかね)|控えさせて|"
    r"no puedo (?:ayudar|responder|resolver)|lo siento|답변(?:할 수 없|드릴 수 없|이 어렵)|도와드릴 수 없",
    re.I,
)
FORMULA = re.compile(r"\$\$[^$]*\$\$|\$[^$]*\$")
SENTENCE = re.compile(r"(?:\$\$[^$]*\$\$|\$[^$]*\$|[^。.!?！？\n])+")
#: What a sentence outside formulas solves by.
RELATION = re.compile(r"[=<>≤≥≈]")
# What ``masked`` makes of a text: formulas and environments become an opening and a closing sign, one that isn't finished only the first.
SPAN = re.compile(r"\$\$[^$]*\$\$|\$[^$]*\$|\\begin\{(?P<env>[^{}]*)\}.*?\\end\{(?P=env)\}", re.S)
UNCLOSED = re.compile(r"\$.*$|\\begin\{.*$", re.S)
GOES_ON = re.compile(r"(?:[=+\-<>≤≥×·/(\[,&^_]|\\(?:le|ge|leq|geq|times|cdot|to|pm|in))$")
OPENED, CLOSED, NUMBER_SIGN = "¤", "@", "#"
#: Signs that close a sentence; what stands before one might have ended the text as well.
CLOSING = np.array([ord(c) for c in "。．.!！?？｡।؟"], np.uint64)
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
ELLIPSIS = re.compile(r"\.{2,}|…+|。{2,}")
BREAKS = re.compile(r"\s*\n\s*")
EMPHASIS = re.compile(r"[*_\s]+$")


def stripped(answer: str | None) -> str:
    """The answer without marker, tags, invisible characters and lead-in."""
    s = INVISIBLE.sub("", TAG.sub(" ", html.unescape((answer or "").replace(MARKER, " "))))
    return LEAD.sub("", s.strip()).strip()


def prose(text: str) -> str:
    """Lower-case letters of a text, other characters as single blanks, formulas left out."""
    s = re.sub(r"\\[a-zA-Z]+(?:\{[^{}]{0,80}\})?", " ", FORMULA.sub(" ", text)).lower()
    return re.sub(r"[\W\d_]+", " ", s).strip()


def _span(m: re.Match) -> str:
    return OPENED if GOES_ON.search(m[0].rstrip("$ ")) else OPENED + CLOSED


def masked(s: str) -> str:
    """A text with its formulas, numbers and ellipses as single signs, emphasis at its end left out."""
    if "$" in s or "\\begin" in s:
        s = UNCLOSED.sub(OPENED, SPAN.sub(_span, s))
    return EMPHASIS.sub("", BREAKS.sub("\n", ELLIPSIS.sub("…", NUMBER.sub(NUMBER_SIGN, s))))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the text each belongs to."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), owner


def _grams(points: np.ndarray, owner: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, text and position of every n-gram within a text."""
    if len(points) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.full(len(points) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            code = (code ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
    at = np.flatnonzero(owner[: len(code)] == owner[n - 1 :])
    return (code[at] % np.uint64(buckets)).astype(np.int64), owner[at], at


class LanguageModel:
    """Naive Bayes over hashed character n-grams."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.counted = languages, counts
        smooth = counts + 0.05
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()

    @staticmethod
    def counts(texts: list[str]) -> np.ndarray:
        points, owner = _points([f" {t} " for t in texts])
        out = np.zeros(LANGUAGE_BUCKETS, np.int64)
        for n in LANGUAGE_GRAMS:
            out += np.bincount(_grams(points, owner, n, LANGUAGE_BUCKETS)[0], minlength=LANGUAGE_BUCKETS)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of every text under every language."""
        points, owner = _points([f" {t} " for t in texts])
        out = np.zeros((len(texts), len(self.languages)))
        for n in LANGUAGE_GRAMS:
            bucket, at, _ = _grams(points, owner, n, LANGUAGE_BUCKETS)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(at, self.logp[bucket, k], minlength=len(texts))
        return out


# ------------------------------------------------------------------ units and their contexts


def _letter_classes() -> np.ndarray:
    """For each code point of the basic plane 0 for blanks, 1 for letters that make words, 2 for what stands alone."""
    out = np.full(1 << 16, 2, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isspace():
            out[cp] = 0
        elif unicodedata.category(c)[0] in "LM" and not (0x2E80 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF):
            out[cp] = 1
    return out


CLASSES = _letter_classes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Units:
    """The units of some texts: words, and single characters of other kinds. A text begins with a unit of its own."""

    def __init__(self, texts: list[str]):
        with np.errstate(over="ignore"):
            points = np.frombuffer(("\0" + "\0".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            kind = CLASSES[np.minimum(points, 0xFFFF).astype(np.int64)]
            kind[points > 0xFFFF] = 2
            word = kind == 1
            alone = kind == 2
            first = np.flatnonzero(alone | word & np.concatenate([[True], ~word[:-1]]))
            last = np.flatnonzero(alone | word & np.concatenate([~word[1:], [True]]))
            at = np.arange(len(points))
            begun = first[np.maximum(np.searchsorted(first, at, "right") - 1, 0)]
            value = _mix(points * np.uint64(0x9E3779B97F4A7C15) + (at - begun).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            value[kind == 0] = 0
            total = np.cumsum(value)
            #: Hash of each unit, and of what each word begins with, its whole left out.
            self.unit = total[last] - total[first] + value[first]
            inner = np.flatnonzero(word & np.concatenate([word[1:], [False]]))
            self.beginnings = _mix((total[inner] - total[begun[inner]] + value[begun[inner]]) ^ np.uint64(0x5851F42D4C957F2D))
            self.is_word = word[first]
            start = np.flatnonzero(points[first] == 0)
            self.place = np.arange(len(first)) - start[np.cumsum(points[first] == 0) - 1]
            self.last = np.concatenate([start[1:], [len(first)]]) - 1
            self.open = points[first] == ord(OPENED)
            self.closes_next = np.append(np.isin(points[first[1:]], CLOSING), False)
            # lines, as sums over their units
            line = np.cumsum((points == 10) | (points == 0))[first]
            self.line_first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            inside = np.arange(len(first)) - np.repeat(self.line_first, np.diff(np.append(self.line_first, len(first))))
            self.line = _mix(np.add.reduceat(_mix(self.unit + inside.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), self.line_first) + np.uint64(0x2545F4914F6CDD1D))
            self.line_of = np.cumsum(np.isin(np.arange(len(first)), self.line_first, assume_unique=True)) - 1

    def contexts(self) -> list[np.ndarray]:
        """For each number of units the hash of those up to each unit, 0 where the text has fewer or an open formula stands last before them."""
        out, h = [], np.zeros(len(self.unit), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(CONTEXT):
                before = np.concatenate([np.zeros(min(k, len(h)), np.uint64), self.unit[: max(len(h) - k, 0)]])
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(k + 1))
                valid = (self.place >= k) & (self.place > 0)
                if k:
                    valid &= ~self.open
                out.append(np.where(valid, h, np.uint64(0)))
        return out


def tails_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the keys of its end (contexts, beginning of a word, line; 0 for none), and whether a context holds the whole text."""
    u = Units(texts)
    at = u.last
    keys = np.zeros((len(texts), CONTEXT + 2), np.uint64)
    for k, h in enumerate(u.contexts()):
        keys[:, k] = h[at]
    keys[:, CONTEXT] = np.where(u.is_word[at], _mix(u.unit[at] ^ np.uint64(0x5851F42D4C957F2D)), 0)
    several = u.line_first[u.line_of[at]] > at - u.place[at]
    keys[:, CONTEXT + 1] = np.where(several, u.line[u.line_of[at]], 0)
    return keys.view(np.int64), (u.place[at] < CONTEXT) & ~u.open[at]


def inside_of(texts: list[str], ends: bool, known: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(key, occurrences inside the texts, those where the sentence goes on) of the known keys, and the number of units.

    ``ends`` leaves out each text's last unit and line.
    """
    u = Units(texts)
    inner = u.place > 0
    if ends:
        inner[u.last] = False
    lines = u.line if not ends else np.delete(u.line, u.line_of[u.last])
    kinds = [(x[keep], ~u.closes_next[keep]) for x in u.contexts() for keep in [inner & (x != 0)]]
    rows, on = [], []
    for h, goes_on in [*kinds, (u.beginnings, None), (lines, None)]:
        seen = np.flatnonzero(coarse[(h >> np.uint64(44)).astype(np.int64)])
        row = np.minimum(np.searchsorted(known, h[seen]), max(len(known) - 1, 0))
        same = known[row] == h[seen] if len(known) else np.zeros(0, bool)
        rows.append(row[same])
        on.append(np.ones(len(rows[-1]), bool) if goes_on is None else goes_on[seen[same]])
    row, on = np.concatenate(rows), np.concatenate(on)
    found = np.unique(row)
    n, going = np.bincount(row, minlength=len(known)), np.bincount(row[on], minlength=len(known))
    return known[found].view(np.int64), n[found], going[found], int(inner.sum())


def fit_languages(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` labelled documents of each language, chosen by a hash of the id."""
    labelled = docs.filter(F.col("lang").rlike("^[a-z]{2}$") & (F.col("lang") != "xx") & (F.length("text") >= 80)).select("doc_id", "lang")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= per_language).select("doc_id", F.col("lang").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most per_language rows for each two-letter code

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for label, part in b.groupby("label"):
                total[label] = total.get(label, 0) + LanguageModel.counts([prose(t) for t in part["text"]])
        for label, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"label": label, "bucket": at, "n": c[at]})

    return _counted(texts.select("label", "text").mapInPandas(count, "label string, bucket int, n long"))


def _counted(rows: DataFrame, more: LanguageModel | None = None) -> LanguageModel:
    """The model of counts (label, bucket, n), at most one row for each language and bucket, and of those of another model."""
    rows = rows.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted({*rows["label"], *(more.languages if more else ())})
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), LANGUAGE_BUCKETS))
    counts[rows["label"].map(at).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    if more:
        counts[[at[x] for x in more.languages]] += more.counted
    return LanguageModel(languages, counts)


def fit_pairs(pairs: DataFrame, model: LanguageModel, most: int = TRAIN_PAIRS) -> LanguageModel:
    """The model fitted further on some ``most`` pairs, chosen by a hash of the id, each under the language of its question."""
    total = pairs.count()
    if not total or not model.languages:
        return model
    parts = 1 << 20
    chosen = pairs.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) < max(1, min(parts, parts * most // total))).filter("q is not null and a is not null")
    held = pairs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            questions, answers = [prose(t) for t in b["q"]], [prose(stripped(t)) for t in b["a"]]
            language = held.value.scores(questions).argmax(1)
            for k in np.unique(language):
                c = LanguageModel.counts([x for texts in (questions, answers) for x, l in zip(texts, language, strict=True) if l == k])
                at = np.flatnonzero(c)
                yield pd.DataFrame({"label": held.value.languages[k], "bucket": at, "n": c[at]})

    return _counted(chosen.select("q", "a").mapInPandas(count, "label string, bucket int, n long"), model)


def count_inside(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """(k, inside, going) of each key in ``keys`` (k), and the number of units of all ``texts`` (t, ends).

    The keys are taken so many at a time as a broadcast holds, each time with one pass over the texts.
    """
    sc, spark = texts.sparkSession.sparkContext, texts.sparkSession
    slices = max(1, -(-keys.count() // KEYS_AT_ONCE))
    out, units = spark.createDataFrame([], "k long, inside long, going long"), 0
    for part in range(slices):
        known = np.sort(keys.filter(F.pmod(F.hash("k"), F.lit(slices)) == part).toPandas()["k"].to_numpy(np.int64).view(np.uint64))
        coarse = np.zeros(1 << 20, bool)  # a first look, before the exact one
        coarse[(known >> np.uint64(44)).astype(np.int64)] = True
        held = sc.broadcast((known, coarse))

        def count(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ends, own in b.groupby("ends"):
                    made = [m for t in own["t"] if (m := masked(stripped(t) if ends else t))]
                    if made:
                        k, n, going, total = inside_of(made, bool(ends), *held.value)
                        yield pd.DataFrame({"k": np.append(k, 0), "n": np.append(n, total), "going": np.append(going, total)})

        counted = cut(texts.mapInPandas(count, "k long, n long, going long").groupBy("k").agg(F.sum("n").alias("inside"), F.sum("going").alias("going")))
        units = next((r[0] for r in counted.filter("k = 0").select("inside").collect()), 0)
        out = out.unionByName(counted.filter("k != 0"))
    return out, units


def is_empty(s: str) -> bool:
    return not re.search(r"[^\W_]", s) and "$" not in s


def is_refusal(s: str, question: str | None = None) -> bool:
    """Something is refused, and the other sentences solve nothing: no relation, and no formula but the question's own."""
    if not REFUSAL.search(FORMULA.sub("@", s)):
        return False
    rest = [x for x in SENTENCE.findall(s) if not REFUSAL.search(FORMULA.sub("@", x))]
    if any(RELATION.search(FORMULA.sub("@", x)) for x in rest):
        return False
    own = [f for x in rest for f in FORMULA.findall(x)]
    known = _compact(question or "") if own else ""
    return all(_compact(f) in known for f in own)


def _compact(s: str) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", INVISIBLE.sub("", s)).lower())


def copied(question: str, answer: str, gram: int = 6) -> tuple[int, int]:
    """Characters of the answer that stand in the question in runs of ``gram`` or more, and all of them."""
    q, a = _compact(question), _compact(answer)
    if len(a) < 2 * gram:
        return 0, len(a)
    step = max(1, (len(a) - gram) // 9)
    if sum(a[i : i + gram] in q for i in range(0, len(a) - gram + 1, step)) < 5:  # a copy holds nearly all of some ten probes
        return 0, len(a)
    grams = {q[i : i + gram] for i in range(len(q) - gram + 1)}
    held, upto = 0, 0
    for i in range(len(a) - gram + 1):
        if a[i : i + gram] in grams:
            held += i + gram - max(i, upto)
            upto = i + gram
    return held, len(a)


def is_copy(question: str, answer: str) -> bool:
    held, size = copied(question, answer)
    return held >= 12 and size - held <= max(20, size // 10) and held >= 0.8 * size


def classify(ids: list, questions: list, answers: list, language: LanguageModel | None) -> tuple[list[tuple], list[tuple]]:
    """(id, defect) of the pairs whose defect shows by themselves, and (id, masked answer) of the others."""
    found, rest = [], []
    for i, q, a in zip(ids, questions, answers, strict=True):
        s = stripped(a)
        if is_empty(s):
            found.append((i, "empty"))
        elif is_refusal(s, q):
            found.append((i, "refusal"))
        elif q and is_copy(q, s):
            found.append((i, "copy"))
        else:
            rest.append((i, q, s))
    if not rest:
        return found, []
    pa = [prose(s) for _, _, s in rest]
    spoken = [k for k, (p, (_, q, _)) in enumerate(zip(pa, rest, strict=True)) if q and len(p.replace(" ", "")) >= 4 and not re.fullmatch(r"(?:[a-z] ?){1,5}", p)]
    other = set()
    if spoken and language is not None and len(language.languages) > 1:
        sq, sa = language.scores([prose(rest[k][1]) for k in spoken]), language.scores([pa[k] for k in spoken])
        best_q, best_a = sq.argmax(1), sa.argmax(1)
        sizes = np.array([len(pa[k]) for k in spoken])
        lead = sa[np.arange(len(spoken)), best_a] - sa[np.arange(len(spoken)), best_q]
        other = {spoken[j] for j in np.flatnonzero((best_q != best_a) & (lead > np.maximum(MARGIN, MARGIN_EACH * sizes)))}
    found += [(rest[k][0], "other_language") for k in sorted(other)]
    return found, [(i, masked(s)) for k, (i, _, s) in enumerate(rest) if k not in other]


def broken_off(tails: DataFrame, counts: DataFrame, units: int) -> DataFrame:
    """The ``tails`` (id, keys, whole) whose end is unlikely. ``counts`` has (k, ends, inside, going).

    Of the contexts the longest one counts that is common inside texts: how often it is an end against how often the sentence goes on
    behind it (a closing sign behind it is no going on), the answer itself left out, over the share of ends among all units; a text of fewer
    units than a context is taken as it is unless a formula is open. A line that also stands between other lines is a header, whatever stands before it.
    """
    total = tails.count()
    if not total or not units:
        return tails.filter("false")
    each = tails.select("id", F.posexplode("keys").alias("at", "k")).filter("k != 0")
    met = looked_up(each, counts, ["k"], "id")
    value = lambda n, at: F.coalesce(F.max(F.when(F.col("at") == at, F.col(n))), F.lit(0)).alias(f"{n}{at}")
    wide = met.groupBy("id").agg(*[value(n, at) for n in ("ends", "inside", "going") for at in range(CONTEXT + 2)])
    rows = tails.select("id", "whole", F.size("keys").alias("n")).join(wide, "id", "left")
    common = max(COMMON, COMMON_SHARE * units)
    ratio = F.lit(None).cast("double")
    for at in range(CONTEXT):
        likely = (F.col(f"ends{at}") - 1) / F.greatest(F.col(f"going{at}"), F.lit(1)) * units / total
        ratio = F.when(F.col(f"inside{at}") >= common, likely).otherwise(ratio)
    ratio = F.when(~F.col("whole"), ratio)
    header = F.col(f"inside{CONTEXT + 1}") >= 3
    cut_word = (F.col(f"inside{CONTEXT}") >= 3) & (F.col("inside0") * CUT_WORD < F.col(f"inside{CONTEXT}")) & ~F.col("whole")
    return rows.filter(~header & (F.coalesce(ratio < END_RATIO, F.lit(False)) | cut_word)).select("id")


def defective_pairs(questions: DataFrame, documents: DataFrame, key: str = "id", question: str = "content", answer: str = "answer_markdown") -> DataFrame:
    """(id, defect) of every pair whose answer is defective."""
    spark = questions.sparkSession
    rows = questions.select(F.col(key).alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"))
    language = spark.sparkContext.broadcast(fit_pairs(rows, fit_languages(documents)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, rest = classify(b["id"].tolist(), b["q"].tolist(), b["a"].tolist(), language.value)
            keys, whole = tails_of([t for _, t in rest]) if rest else ([], [])
            yield pd.DataFrame(
                {"id": [i for i, _ in found] + [i for i, _ in rest], "defect": pd.Series([d for _, d in found] + [None] * len(rest), dtype=object), "keys": [None] * len(found) + list(keys), "whole": [False] * len(found) + list(whole)}
            )

    judged = stored(rows.mapInPandas(judge, "id long, defect string, keys array<long>, whole boolean"))
    tails = judged.filter("defect is null").select("id", "keys", "whole")
    ends = cut(tails.select(F.explode("keys").alias("k")).filter("k != 0").groupBy("k").agg(F.count(F.lit(1)).alias("ends")))
    texts = rows.select(F.col("a").alias("t"), F.lit(True).alias("ends")).unionByName(rows.select(F.col("q").alias("t"), F.lit(False).alias("ends")))
    texts = texts.unionByName(documents.select(F.col("text").alias("t"), F.lit(False).alias("ends"))).filter("t is not null")
    inside, units = count_inside(texts, ends.select("k"))
    counts = cut(ends.join(inside, "k", "left").select("k", "ends", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inside", "going")]))
    truncated = broken_off(tails, counts, units).select("id", F.lit("truncated").alias("defect"))
    return judged.filter("defect is not null").select("id", "defect").unionByName(truncated)
