"""Unicode tables of the common form (problem 2), built by rule from ``unicodedata``.

Two texts *print alike* when they differ only in how characters are encoded or composed, in width, in
characters without a glyph, in the kind of blank, or in the script a letter of the same shape is taken from.
The tables say, for each code point, what it stands for; everything that is visible (raised, lowered and
encircled digits, accents, case, blanks being there or not) stays apart.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

#: Kinds of compatibility decomposition that do not show in print.
ALIKE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

# Letters of other scripts whose shape agrees with a Latin letter.
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντϲϳϹ", "ABEZHIKMNOPTYXovtcjC", strict=True))
GREEK_LIKE.pop("τ")  # its foot differs from a Latin t
CYRILLIC_LIKE = dict(zip("АВЕЅІЈКМНОРСТХаеорсухѕіјһԁԛԝҮ", "ABESIJKMHOPCTXaeopcyxsijhdqwY", strict=True))
OTHER_LIKE = dict(zip("օհոᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "ohnDRTAJEWMHGZVSLCPKB", strict=True))
HAN_LIKE = dict(zip("ロカニハエタト", "口力二八工夕卜", strict=True))
HYPHEN_LIKE = {"\u2010": "-"}
LOOK_ALIKE = GREEK_LIKE | CYRILLIC_LIKE | OTHER_LIKE | HAN_LIKE | HYPHEN_LIKE

#: Code points kept as they are although Unicode gives them a compatibility form: it is seen in print.
KEPT = (
    (0x2460, 0x24FF), (0x3131, 0x318E), (0x3200, 0x33FF), (0x03D0, 0x03D6), (0x03F0, 0x03F1), (0x03F4, 0x03F6),
    (0x017F, 0x017F), (0x2100, 0x2102), (0x2104, 0x2108), (0x2116, 0x2116), (0x2120, 0x2122),
)
LINE_ENDS = "\r\x0b\x0c\x85\u2028\u2029"
#: Characters without a glyph besides the categories Cc and Cf.
NO_GLYPH = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))


def _within(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def expand(ch: str) -> str:
    """What one code point stands for: decomposed, with look-alikes in Latin; '' when it has no glyph."""
    cp, cat = ord(ch), unicodedata.category(ch)
    if ch == "\n":
        return ch
    if ch in LINE_ENDS:
        return "\n"
    if cat == "Zs" or ch == "\t":
        return " "
    if cat in ("Cc", "Cf") or _within(cp, NO_GLYPH):
        return ""
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return unicodedata.normalize("NFD", ch)  # Hangul syllables have no listed decomposition
    if parts[0][0] == "<":
        tag, parts = parts[0], parts[1:]
        if tag not in ALIKE_TAGS or parts[0] == "0020" or _within(cp, KEPT):
            return ch
    return "".join(expand(chr(int(p, 16))) for p in parts)


def common_form_py(text: str | None) -> str | None:
    """The common form of one text in plain Python; the distributed operator is tested against it."""
    if text is None:
        return None
    return unicodedata.normalize("NFC", "".join(map(expand, text.replace("\r\n", "\n"))))


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple[str, str, int]], str, str, str]:
    single_from, single_to, dropped, rows = [], [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or cp in (0x20, 0x0A):
            continue
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Co"):
            continue
        full = expand(ch)
        if full != ch:
            rows.append((ch, full, 0))
        whole = unicodedata.normalize("NFC", full)
        if whole == ch or cp > 0xFFFF and whole:
            continue
        if not whole:
            dropped.append(ch)
        elif len(whole) == 1:
            single_from.append(ch)
            single_to.append(whole)
    return rows, "".join(single_from), "".join(single_to), "".join(dropped)


def expansion_rows() -> list[tuple[str, str]]:
    """(code point, what it stands for) of every code point that does not stand for itself. Bounded by Unicode."""
    return [(c, full) for c, full, _ in _tables()[0]]


def mark_rows() -> list[tuple[str, int]]:
    """(combining mark, its class) of every code point of a class above 0."""
    return [(chr(c), k) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (k := unicodedata.combining(chr(c)))]


def compose_rows() -> list[tuple[str, str, str]]:
    """(first, second, composed) of the canonical compositions."""
    rows = []
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or 0xAC00 <= c <= 0xD7A3:
            continue
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (chr(int(x, 16)) for x in d.split())
            rows.append((a, b, chr(c)))
    return rows


def single_map() -> tuple[str, str, str]:
    """(from, to, dropped): code points of the basic plane that stand for exactly one, or for none."""
    return _tables()[1:]
