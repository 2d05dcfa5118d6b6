"""Problem 5: noise in texts taken from scanned pages, and its repair.

Method: words are grouped by a skeleton in which glyphs that look alike are one; a rare form is a misreading of the group's
frequent form where that one also stands beside the same word. Characters of other scripts are judged among their look-alikes by the
characters on both sides. Digits are masked to find running headers, the lines that recur and whose ends stand at no other
place; page numbers are told by their shapes; lines are joined into paragraphs by SQL windows.

All counts are taken over the whole table, batch by batch, and summed by exact keys. Lines are counted by their full 64-bit hash
and each is judged by its own edges; recurring lines and misread words are looked for so many at a time as a broadcast holds, with
further passes for more. Pairs of characters are bounded by the alphabet: their table has at least eight places for each.
Null and empty texts have no noise; other columns are ignored. A running header has 8 to 90 characters, a page's line at most 140: longer
ones are text.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import forms
from tessella.plans.lineage import cut, stored

#: Places in the table of character pairs: eight for each pair within these bounds.
LEAST_PLACES, MOST_PLACES = 1 << 18, 1 << 24
#: Misread forms that are looked for in one pass over the texts, and records in which the right form has to stand beside the same word.
WORDS_AT_ONCE, BESIDE = 1 << 18, 3
#: Recurring lines whose edges are counted in one pass over the texts.
LINES_AT_ONCE = 1 << 20
#: Characters of a line's edge, by the line's length.
EDGES = (10, 8)
#: A header recurs in at least so many records; of the occurrences of one of its edges, and of the other, at least these shares stand at line edges.
HEADER_RECORDS, HEADER_SHARE, OTHER_SHARE = 3, 0.9, 0.5
#: A misreading's context supports another form at least so often, and the form seen at most by this share of it.
SUPPORT, MISREAD_SHARE = 10, 0.1
#: Of a character, both sides together must favour the other form by this factor.
FAVOUR = 40

# Groups of characters that scanners take for one another.
LOOK_ALIKE_GROUPS = (
    "数教敦 已己巳 合台 足定 长氏 放敖 直宜 经径経 千干于 因囚困 方万 向问同何 求术木本 意惫 所听 离禽 出岀 位拉 度廋 圆园 率车 样祥 件仵 设没 水氷 理埋 末未 土士 日曰目 人入 大太犬 "
    "天夭 无元 玉主 自白 比此北 析折拆 今令 由甲申田 贝见 间闻 结给 概慨 且旦 又叉 式武 代伐 住往 全金 边迈 运还 时吋 可司 后右石 名各 句旬 特持待侍 亟函 乘乖 抛拋 刀力 侯候 根垠 面而 "
    "半平 值植 线缐 点占 形彤 正止 最景 等第 项顷 程桯 积枳 角甬 量重 取职 概槪 满潢 则侧"
).split()
# Sequences of Latin and Cyrillic letters that scanners take for one another, either way.
LOOK_ALIKE_LETTERS = (
    ("rn", "m"), ("li", "h"), ("vv", "w"), ("cl", "d"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("c", "e"), ("ii", "u"), ("6", "б"), ("3", "з"), ("л", "п"), ("и", "н"), ("ш", "щ"),
)
#: Each glyph as the strokes it may be read as; forms that are misread from one another have the same strokes.
STROKES = str.maketrans({"m": "rn", "h": "11", "w": "vv", "d": "e1", "u": "11", "l": "1", "i": "1", "o": "0", "s": "5", "c": "e", "б": "6", "з": "3", "п": "л", "н": "и", "щ": "ш"})
NUM = r"\d{1,4}"
PAGE = (
    rf"[-–—·~〔\[|•*]+\s*{NUM}\s*[-–—·~〕\]|•*]+|(?:[一-鿿]{{1,6}}\s*)?第\s*{NUM}\s*页(?:\s*[/，,、]?\s*共\s*{NUM}\s*页)?|(?:[Pp]age|p\.|P\.|Seite|[Сс]тр\.|Página)\s*{NUM}(?:\s*(?:of|/|von|de|из)\s*{NUM})?|{NUM}\s*/\s*{NUM}"
)
PAGE_LINE = re.compile(rf"\s*(?:{PAGE})\s*")
BARE = re.compile(rf"\s*{NUM}\s*")
DATA = re.compile(r"[\s\d.,;:|/+\-]*")
WITH_PAGE = re.compile(rf"\s*(?:(?P<front>{PAGE}|{NUM})[^\S\n]{{2,}})?(?P<rest>\S.*?)(?:[^\S\n]{{2,}}(?P<back>{PAGE}|{NUM}))?\s*")
NOT_HEADER = re.compile(r"^(?:\\|\||!\[|<|\$|[A-H][.．、)]|[-+*]\s)|\$|[。.!?！？；;，,：:、\-‐‑­]$|^\[EXTRACTED_ORIGINAL\]")
FORMULA = re.compile(r"\$\$[^$]*\$\$|\$[^$]*\$")
DIGITS = re.compile(r"\d+")
HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑­][^\S\n]*\n[^\S\n]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
LATIN = re.compile(r"[a-zà-žа-яё]")

_FOLD: dict[int, str | None] = {}
_FOLDABLE = None


def folded(text: str) -> str:
    """Problem 2's replacement of single letters, so that look-alike encodings aren't taken for misreadings."""
    global _FOLDABLE
    if _FOLDABLE is None:
        frm, to, dropped = forms.single_map()
        _FOLD.update({ord(a): b for a, b in zip(frm, to, strict=True) if a.isalnum()} | {ord(c): None for c in dropped if c <= "\uffff"})
        for kept in (0xAD, 0x2010):  # they divide words at line ends
            _FOLD.pop(kept, None)
        _FOLDABLE = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "]")
    return text.translate(_FOLD) if _FOLDABLE.search(text) else text


def line_parts(line: str) -> tuple[str, bool]:
    """A line without its page number and with digits masked, and whether it has a page number beside other text."""
    if not DIGITS.search(line):
        return line.strip(), False
    m = WITH_PAGE.fullmatch(line)
    if not m or DATA.fullmatch(m["rest"]):
        return DIGITS.sub("#", line.strip()), False
    paged = bool(m["front"] or m["back"])
    return DIGITS.sub("#", m["rest"].strip() if paged else line.strip()), paged


def may_be_header(part: str) -> bool:
    return 8 <= len(part) <= 90 and not NOT_HEADER.search(part) and sum(c.isalpha() for c in part) >= 4


def line_hash(part: str) -> int:
    """A stable 64-bit hash of a line."""
    h = xxhash.xxh64_intdigest(part)
    return h - (1 << 64) if h >> 63 else h


def _signed(s: str) -> int:
    """The hash of a line's edge, as it is also rolled over all texts."""
    h = 1469598103934665603
    for c in s:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def edges_of(part: str) -> tuple[str, str]:
    """First and last characters of a line, as many as its length asks for."""
    n = EDGES[0] if len(part) >= EDGES[0] else EDGES[1]
    return part[:n], part[-n:]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane its group or -1, and the members of each group padded with 0."""
    group = np.full(1 << 16, -1, np.int32)
    width = max(map(len, LOOK_ALIKE_GROUPS))
    members = np.zeros((len(LOOK_ALIKE_GROUPS), width), np.uint64)
    for g, chars in enumerate(LOOK_ALIKE_GROUPS):
        for k, c in enumerate(chars):
            if group[ord(c)] < 0:
                group[ord(c)] = g
            members[g, k] = ord(c)
    return group, members


GROUP, MEMBERS = _classes()


def _pair_keys(a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    return (a << np.uint64(22)) | (b << np.uint64(1)) | np.uint64(side)


def _places(keys: np.ndarray, places: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(31))) & np.uint64(places - 1)).astype(np.int64)


def dense(text: str) -> str:
    """Text without blanks and line breaks, formulas and digits masked: the context of a character."""
    return re.sub(r"\s+", "", DIGITS.sub("#", FORMULA.sub("@", text.replace("[EXTRACTED_ORIGINAL]", ""))))


def _positions(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every character with look-alikes: its text, itself, the one before, the one behind, its group."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    group = GROUP[np.minimum(points, 0xFFFF).astype(np.int64)]
    group[points > 0xFFFF] = -1
    at = np.flatnonzero(group >= 0)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return owner[at - 1], points[at], points[at - 1], points[at + 1], group[at]


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if len(w) >= 3 and LATIN.search(w)]


def readings(word: str) -> set[str]:
    """Forms a word may have been misread from: one look-alike sequence exchanged once or everywhere."""
    out = set()
    for a, b in LOOK_ALIKE_LETTERS:
        for x, y in ((a, b), (b, a)):
            if y.isdigit():
                continue  # a common word has no digits
            at = word.find(x)
            while at >= 0:
                out.add(word[:at] + y + word[at + len(x) :])
                at = word.find(x, at + 1)
            if word.count(x) > 1:
                out.add(word.replace(x, y))
    out.discard(word)
    return out


def skeleton(word: str) -> str:
    """The strokes of a word: the same for forms that differ in glyphs that look alike."""
    return word.translate(STROKES)


class ScanModel:
    """What the whole table tells: headers by their hashed lines in order, pairs of characters, misread words and what they were."""

    def __init__(self, headers: array, pairs: np.ndarray, words: dict[str, str]):
        self.headers, self.pairs, self.words = headers, pairs, words

    def is_header(self, part: str) -> bool:
        return may_be_header(part) and self._recurs(line_hash(part))

    def _recurs(self, h: int) -> bool:
        k = bisect_left(self.headers, h)
        return k < len(self.headers) and self.headers[k] == h

    def pair_counts(self, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
        return self.pairs[_places(_pair_keys(a, b, side), len(self.pairs))]

    def noise_lines(self, text: str) -> dict[int, set[str]]:
        """Kinds of noise by line number."""
        lines = text.split("\n")
        found: dict[int, set[str]] = {}
        if len(lines) < 2:
            return found
        filled = [k for k, x in enumerate(lines) if x.strip() and x.strip() != "[EXTRACTED_ORIGINAL]"]
        for n, k in enumerate(filled):
            line = lines[k]
            if len(line) > 140 or "$" in line:
                continue
            if PAGE_LINE.fullmatch(line):
                found[k] = {"page_no"}
            elif BARE.fullmatch(line):
                beside = [lines[filled[j]] for j in (n - 1, n + 1) if 0 <= j < len(filled)]
                if beside and not any(DATA.fullmatch(x) for x in beside):
                    found[k] = {"page_no"}
            else:
                part, paged = line_parts(line)
                if self.is_header(part):
                    found[k] = {"header", "page_no"} if paged else {"header"}
        if len(found) == len(filled):
            return {}
        return found

    def misread_characters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, ordinal among the text's characters with look-alikes, and right character of every misread one."""
        owner, c, before, behind, group = _positions(texts)
        if not len(c):
            return owner, owner, c
        seen = [self.pair_counts(before, c, 0), self.pair_counts(c, behind, 1)]
        bad, right, best = np.zeros(len(c), bool), c.copy(), np.zeros(len(c))
        for k in range(MEMBERS.shape[1]):
            other = MEMBERS[group, k]
            held = [self.pair_counts(before, other, 0), self.pair_counts(other, behind, 1)]
            weak = [(held[s] >= SUPPORT) & (seen[s] <= MISREAD_SHARE * held[s]) for s in (0, 1)]
            favour = (held[0] + 1.0) / (seen[0] + 1) * (held[1] + 1.0) / (seen[1] + 1)
            better = (other > 0) & (other != c) & (weak[0] | weak[1]) & (favour >= FAVOUR) & (favour > best)
            bad |= better
            right[better], best[better] = other[better], favour[better]
        first = np.searchsorted(owner, owner, "left")
        ordinal = np.arange(len(c)) - first
        return owner[bad], ordinal[bad], right[bad]

    def kinds(self, texts: list[str]) -> list[set[str]]:
        """Kinds of noise in every text."""
        out: list[set[str]] = []
        clean = []
        for t in texts:
            noise = self.noise_lines(t)
            kinds = set().union(*noise.values()) if noise else set()
            body = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in noise) if noise else t
            masked = folded(FORMULA.sub("@", body))
            if HYPHEN.search(masked):
                kinds.add("hyphen")
                masked = HYPHEN.sub("", masked)
            if not self.words.keys().isdisjoint(words_of(masked)):
                kinds.add("misread")
            out.append(kinds)
            clean.append(dense(masked))
        for k in np.unique(self.misread_characters(clean)[0]):
            out[k].add("misread")
        return out

    def repaired(self, text: str) -> str:
        """The text without header lines, page numbers, divided words and misreadings; its lines are left to the reflow."""
        noise = self.noise_lines(text)
        body = HYPHEN.sub("", "\n".join(x for k, x in enumerate(text.split("\n")) if k not in noise))
        pieces = re.split(r"(\$\$[^$]*\$\$|\$[^$]*\$)", body)
        for k in range(0, len(pieces), 2):
            pieces[k] = WORD.sub(self._right_case, pieces[k])
        body = "".join(pieces)
        _, ordinals, right = self.misread_characters([dense(folded(body))])
        if len(ordinals):
            chars = list(body)
            inside = [m.span() for m in FORMULA.finditer(body)]
            at = [i for i, c in enumerate(chars) if ord(c) < 1 << 16 and GROUP[ord(c)] >= 0 and not any(a <= i < b for a, b in inside)]
            for n, c in zip(ordinals, right, strict=True):
                if n < len(at):
                    chars[at[n]] = chr(int(c))
            body = "".join(chars)
        return body

    def _right_case(self, m: re.Match) -> str:
        word = m[0]
        lower = folded(word).lower()
        if len(lower) < 3 or not LATIN.search(lower):
            return word
        right = self.words.get(lower)
        if right is None:
            return word
        return right.capitalize() if word[0].isupper() else right


def long_form(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, t): one row per text that isn't null."""
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])
    return df.select(F.col(key).alias("id"), F.explode(items).alias("x")).select("id", "x.field", "x.t").filter("t is not null and t != ''")


def _headers(texts: DataFrame, lines: pd.DataFrame) -> np.ndarray:
    """Of recurring lines (k, a, z) the hashes of those whose edges stand at line edges."""
    if lines.empty:
        return np.zeros(0, np.int64)
    sc = texts.sparkSession.sparkContext
    wanted = [np.unique(lines[c].to_numpy(np.int64).view(np.uint64)) for c in ("a", "z")]
    coarse = np.zeros(1 << 20, bool)  # a first look, before the exact one
    for w in wanted:
        coarse[(w >> np.uint64(44)).astype(np.int64)] = True
    held = sc.broadcast((wanted, coarse))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, coarse = held.value
        anywhere = [np.zeros(len(w), np.int64) for w in wanted]
        at_edge = [np.zeros(len(w), np.int64) for w in wanted]
        for b in batches:
            parts = [p for t in b["t"] for x in t.split("\n") if len(p := line_parts(x)[0] if len(x) <= 140 else DIGITS.sub("#", x.strip())) >= EDGES[-1]]
            if not parts:
                continue
            points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes + 1) - 1
            for edge in EDGES:
                long = sizes >= edge
                h = np.full(len(points) - edge + 1, 1469598103934665603, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(edge):
                        h ^= points[k : len(points) - edge + 1 + k]
                        h *= np.uint64(1099511628211)
                at = np.flatnonzero(coarse[(h >> np.uint64(44)).astype(np.int64)])
                found = h[at]
                for side, places in enumerate((ends - sizes, ends - edge)):
                    on_edge = np.zeros(len(h), bool)
                    on_edge[places[long]] = True
                    row = np.minimum(np.searchsorted(wanted[side], found), len(wanted[side]) - 1)
                    same = wanted[side][row] == found
                    anywhere[side] += np.bincount(row[same], minlength=len(wanted[side]))
                    at_edge[side] += np.bincount(row[same & on_edge[at]], minlength=len(wanted[side]))
        for side in (0, 1):
            k = np.flatnonzero(anywhere[side])
            yield pd.DataFrame({"side": side, "k": k, "n": anywhere[side][k], "e": at_edge[side][k]})

    anywhere = texts.select("t").mapInPandas(edges, "side int, k int, n long, e long").groupBy("side", "k").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).toPandas()
    share = [np.zeros(len(w)) for w in wanted]
    for side in (0, 1):
        own = anywhere[anywhere["side"] == side]
        share[side][own["k"]] = own["e"] / own["n"]
    held.destroy()
    of = lambda side, c: share[side][np.searchsorted(wanted[side], lines[c].to_numpy(np.int64).view(np.uint64))]
    first, last = of(0, "a"), of(1, "z")
    return lines["k"].to_numpy(np.int64)[(np.maximum(first, last) >= HEADER_SHARE) & (np.minimum(first, last) >= OTHER_SHARE)]


def body_of(text: str) -> str:
    """A text for counting words and characters: look-alike letters as one, formulas masked, divided words joined."""
    return HYPHEN.sub("", folded(FORMULA.sub("@", text)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch: lines that may be headers by their hash, with their edges (kind 0), pairs of characters (1), words by their skeleton (2)."""
    for b in batches:
        lines: Counter = Counter()
        words: Counter = Counter()
        contexts: list[str] = []
        for t in b["t"]:
            if "\n" in t:
                lines.update(p for p in {line_parts(x)[0] for x in t.split("\n") if 6 <= len(x) <= 140} if may_be_header(p))
            masked = folded(FORMULA.sub("@", t))
            words.update(words_of(HYPHEN.sub("", masked)))
            contexts.append(dense(masked))
        keys = list(lines)
        yield pd.DataFrame({"kind": 0, "k": np.array([line_hash(x) for x in keys], np.int64), "a": [_signed(edges_of(x)[0]) for x in keys], "z": [_signed(edges_of(x)[1]) for x in keys], "w": None, "n": [lines[x] for x in keys]})
        _, c, before, behind, _ = _positions(contexts)
        k, n = np.unique(np.concatenate([_pair_keys(before, c, 0), _pair_keys(c, behind, 1)]), return_counts=True)
        yield pd.DataFrame({"kind": 1, "k": k.view(np.int64), "a": 0, "z": 0, "w": None, "n": n})
        forms_ = list(words)
        yield pd.DataFrame({"kind": 2, "k": np.array([line_hash(skeleton(w)) for w in forms_], np.int64), "a": 0, "z": 0, "w": pd.Series(forms_, dtype=object), "n": np.fromiter(words.values(), np.int64, len(words))})


def _pair_table(counted: DataFrame) -> np.ndarray:
    """Counts of the pairs of characters seen more than once, hashed into a table that has room for them; bounded by the alphabet."""
    rows = counted.filter("kind = 1").groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").toPandas()
    places = LEAST_PLACES
    while places < min(8 * len(rows), MOST_PLACES):
        places *= 2
    table = np.zeros(places, np.int64)
    np.add.at(table, _places(rows["k"].to_numpy(np.int64).view(np.uint64), places), rows["n"].to_numpy(np.int64))
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def _slices(df: DataFrame, key: str, size: int) -> list[DataFrame]:
    parts = max(1, -(-df.count() // size))
    return [df.filter(F.pmod(F.hash(key), F.lit(parts)) == k) for k in range(parts)]


def misread_words(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """(w, r) of every misread form and the frequent form of its skeleton that it was read from.

    The frequent form has to be one exchange of look-alike glyphs away, and to stand beside the same word in several records; words that
    are rare themselves tell nothing.
    """
    words = counted.filter("kind = 2").groupBy("k", "w").agg(F.sum("n").alias("n"))
    best = words.groupBy("k").agg(F.max_by("w", F.struct("n", "w")).alias("r"), F.max("n").alias("m")).filter(F.col("m") >= SUPPORT)
    rare = words.join(best, "k").filter((F.col("w") != F.col("r")) & (F.col("n") <= MISREAD_SHARE * F.col("m"))).select("w", "r")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [(w, r) for w, r in zip(b["w"].tolist(), b["r"].tolist(), strict=True) if r in readings(w)]
            yield pd.DataFrame({"w": [w for w, _ in kept], "r": [r for _, r in kept]}, dtype=object)

    rare = cut(rare.mapInPandas(near, "w string, r string"))
    sc = texts.sparkSession.sparkContext
    beside = None
    for part in _slices(rare, "r", WORDS_AT_ONCE):  # the forms of one word are in one slice
        pairs = [tuple(r) for r in part.collect()]
        held = sc.broadcast({**dict(pairs), **{r: r for _, r in pairs}})

        def count(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            wanted = held.value
            for b in batches:
                found: Counter = Counter()
                for t in b["t"]:
                    if LATIN.search(t.lower()):
                        tokens = WORD.findall(body_of(t).lower())
                        for k, w in enumerate(tokens):
                            if w in wanted:
                                found[w, wanted[w], 0, tokens[k - 1] if k else ""] += 1
                                found[w, wanted[w], 1, tokens[k + 1] if k + 1 < len(tokens) else ""] += 1
                yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=["w", "r", "side", "other", "n"])

        one = texts.select("t").mapInPandas(count, "w string, r string, side int, other string, n long")
        beside = one if beside is None else beside.unionByName(one)
    beside = cut(beside.groupBy("w", "r", "side", "other").agg(F.sum("n").alias("n")))
    right = beside.filter((F.col("w") == F.col("r")) & (F.col("n") >= BESIDE)).select("r", "side", "other").withColumn("held", F.lit(1))
    common = words.groupBy(F.col("w").alias("other")).agg(F.sum("n").alias("m")).filter(F.col("m") >= SUPPORT)
    judged = beside.filter("w != r").join(right, ["r", "side", "other"], "left").join(common, "other", "left")
    per = judged.groupBy("w", "r").agg(F.max("held").alias("held"), F.max("m").alias("m"))
    return cut(per.filter("held is not null or m is null").select("w", "r"))


def fit(texts: DataFrame) -> tuple[ScanModel, list[DataFrame]]:
    """The model of all texts with the first slice of misread words, and the other slices (w, r)."""
    counted = stored(texts.select("t").mapInPandas(_counts, "kind int, k long, a long, z long, w string, n long"))
    recurring = cut(counted.filter("kind = 0").groupBy("k").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.min("z").alias("z")).filter(F.col("n") >= HEADER_RECORDS).select("k", "a", "z"))
    headers = [_headers(texts, part.toPandas()) for part in _slices(recurring, "k", LINES_AT_ONCE)]
    words = _slices(misread_words(texts, counted), "w", WORDS_AT_ONCE)
    model = ScanModel(array("q", np.sort(np.concatenate([*headers, np.zeros(0, np.int64)])).tolist()), _pair_table(counted), _dict(words[0]))
    return model, words[1:]


def _dict(words: DataFrame) -> dict[str, str]:
    return {r.w: r.r for r in words.collect()}


def scan_noise(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("content", "answer_markdown")) -> DataFrame:
    """(id, field, kind): one row per text and kind of noise in it."""
    texts = long_form(df, key, fields)
    fitted, more = fit(texts)
    sc = df.sparkSession.sparkContext
    model = sc.broadcast(fitted)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f, k) for i, f, kinds in zip(b["id"], b["field"], model.value.kinds(b["t"].tolist()), strict=True) for k in sorted(kinds)]
            yield pd.DataFrame(rows, columns=["id", "field", "kind"])

    found = texts.mapInPandas(judge, "id long, field string, kind string")
    for part in more:
        held = sc.broadcast(_dict(part))

        def words(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(i, f, "misread") for i, f, t in zip(b["id"].tolist(), b["field"].tolist(), b["t"].tolist(), strict=True) if not held.value.keys().isdisjoint(words_of(body_of(t)))]
                yield pd.DataFrame(rows, columns=["id", "field", "kind"])

        found = found.unionByName(texts.mapInPandas(words, "id long, field string, kind string"))
    return found.distinct() if more else found


def repaired_texts(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("content", "answer_markdown")) -> DataFrame:
    """(id, field, text): every text as continuous paragraphs, without what the page or its reading put there.

    A line begins a paragraph behind an empty line, behind a finished sentence when it looks like an item of its own, and
    around tables, environments, options and images; other lines are joined, with a blank where words are set apart.
    """
    texts = long_form(df, key, fields)
    fitted, more = fit(texts)
    for part in more:
        fitted.words.update(_dict(part))
    model = df.sparkSession.sparkContext.broadcast(fitted)

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(t=[model.value.repaired(t) for t in b["t"]])

    rows = texts.mapInPandas(repair, "id long, field string, t string").withColumn("_row", F.monotonically_increasing_id())
    lines = rows.select("_row", "id", "field", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    by = Window.partitionBy("_row").orderBy("pos")
    before = F.lag("line").over(by)
    block = r"^(?:\\begin|\\end|\\item|\||!\[|[A-H][.．、)]|[-*+] |[（(]?\d{1,2}[)）.．、]|[①-⑳]|【|\*\*|\[EXTRACTED_ORIGINAL\]|\d+$|\d+\s+\d+)"
    starts = before.isNull() | (before == "") | (F.col("line") == "") | F.col("line").rlike(block) | before.rlike(r"^(?:\\|\||!\[|\d+$|\d+\s+\d+)|^\[EXTRACTED_ORIGINAL\]$")
    lines = lines.withColumn("_starts", starts).withColumn("_para", F.sum(F.col("_starts").cast("int")).over(by))
    apart = before.rlike(r"[\p{IsLatin}\p{IsCyrillic}\p{Nd}$.,;:?!)\]]$") & F.col("line").rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{Nd}$(\[]")
    lines = lines.withColumn("_glue", F.when(F.col("_starts"), "").when(apart, " ").otherwise(""))
    paras = lines.groupBy("_row", "id", "field", "_para").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("_glue", "line").alias("s")))), lambda x: x["s"]), "").alias("p"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_para", "p"))), lambda x: x["p"]), "\n")
    return paras.groupBy("_row", "id", "field").agg(whole.alias("text")).select("id", "field", F.regexp_replace("text", r"\n{3,}", "\n\n").alias("text"))
