"""Problem 8: sentence units of texts in many languages and scripts.

Method: terminators that don't end a sentence (in decimals, URLs, initials, abbreviations, formulas and quotations) are
masked with private-use placeholders of the same length, the masked text is split behind the terminators of each script,
and the units are restored from the original text by their offsets. All of it is SQL expressions.

Offsets count code points from 0, the end exclusive; blanks and invisible characters at the ends are left out. Nulls,
empty texts and texts without letters and digits give no row. Rows are told apart by their position in the scan, so
repeated keys don't mix. Private-use characters already in a text are ordinary characters that end nothing.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK, MASK_BREAK, CUT = "\ue000", "\ue001", "\ue002"
#: Terminators; in the masked text each is a code point of one private-use range, so a pattern makes one comparison.
TERMINATORS = ".．!?！？؟…。｡।॥۔"
FIRST = 0xE020
TO = "".join(chr(FIRST + i) for i in range(len(TERMINATORS)))
DOT, BANG, DOTS = TO[0:2], TO[2:7], TO[7]
ENDS = rf"\x{{{FIRST:X}}}-\x{{{FIRST + len(TERMINATORS) - 1:X}}}"
#: What may close a unit behind its terminator.
CLOSERS = r"[”’\"')）\]】」』》〉›»*_]*"
#: Blanks and invisible characters that may stand before the first word of a unit.
LEADING = r"[\s\x{FEFF}\x{200B}-\x{200D}\x{2060}]"
#: Blanks, line ends and characters without a glyph, left out at the ends of a unit.
INVISIBLE = "".join(c for c in map(chr, range(0xD800)) if unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp")) + "\ufeff" + MASK_BREAK

# Abbreviations that never end a sentence, by the letters before their stop.
TITLES = "Dr|Prof|Mr|Mrs|Ms|Mx|Rev|Hon|Gen|Capt|Lt|Col|Sgt|Mme|Mlle|MM|Sr|Sra|Srta|Dra|Hr|Fr|Dipl|Ing|проф|акад|др|डॉ|प्रो|श्री|د|أ|م"
REFERENCES = (
    "Fig|Figs|fig|figs|Ex|Exs|Eq|Eqs|No|Nos|no|nos|Nr|nr|Thm|Thms|Lem|Prop|Cor|Def|Sec|sec|Ch|ch|Vol|vol|pp|ver|cf|Cf|vs|viz|ca|Ca|bzw|Vgl|vgl|Abb|Bd|Kap|Tab|Str|al|approx|Approx|resp|incl|excl|avg|max|min|"
    "pág|págs|núm|cap|рис|Рис|см|См|стр|гл|табл|ср|Ср"
)
MONTHS = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Okt|Dez|févr|janv|juil|déc|ene|abr|ago|dic"
GERMAN_BEFORE_ORDINAL = "[Dd]er|[Dd]ie|[Dd]as|[Dd]em|[Dd]en|[Dd]es|[AaIi]m|[Vv]om|[Zz]um|[Zz]ur"
GERMAN_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
SAY_ZH = "说|问道|答道|喊道|回答|提醒|讲道|叫道|反问|追问|补充|解释|表示|指出|写道|一问一答|感叹|嘀咕"
SAY_EN = "said|says|asked|asks|wondered|replied|cried|added|answered|whispered|shouted|noted|explained|remarked|exclaimed|muttered|called|continued|laughed|warned"
CONNECTIVES_ZH = "正如|但|可是|不过|然而|而|才|就|也|那么|于是|所以|因为|如同|以及|和|或"
#: A capital before a stop is an initial behind these words or a capitalised word.
BEFORE_INITIAL = "by|of|from|to|and|with|for|von|mit|und|par|de|et|y|con|und|an|bei|à"


def _masked_formulas(text: Column) -> Column:
    """Terminators, quotes and line breaks within ``$...$`` and ``$$...$$`` masked; left alone where signs don't pair."""
    inner = TO + '"“”'
    hide = lambda x: F.translate(x, inner + "\n", MASK * len(inner) + MASK_BREAK)
    twice = ""

    def odd(sep: str, part: Column, even) -> Column:
        pieces = F.split(part, sep)
        done = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, hide(x)).otherwise(even(x)))
        return F.when(F.size(pieces) % 2 == 1, F.array_join(done, sep.replace("\\", ""))).otherwise(even(part))

    one = lambda x: odd(r"\$", x, lambda y: y)
    display = F.replace(odd(twice, F.replace(text, F.lit("$$"), F.lit(twice)), one), F.lit(twice), F.lit("$$"))
    bad = rf"{ENDS}“”\"\n"
    holds = rf"^[^$]*+(?:\$[^${bad}]*+\$[^$]*+)*+\$[^${bad}]*+[{bad}]"  # some formula holds one of them
    return F.when(F.contains(text, F.lit("$$")), display).when(text.rlike(holds), one(text)).otherwise(text)


def masked(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` and the text with terminators in their private-use range, and those that end no sentence replaced by a placeholder.

    Each step is a column of its own, so that it is computed once. Lengths stay as they are. Every pattern begins with the character it masks and looks back from there, so other
    characters cost one comparison; patterns of quotations run only over texts with quotation marks.
    """
    decimal = rf"[{DOT}](?<=\p{{Nd}}.)(?=\p{{Nd}})"
    m = F.col(out)

    def step(c: Column) -> None:
        nonlocal df
        df = df.withColumn(out, c)

    step(F.regexp_replace(F.translate(text, TERMINATORS, TO), decimal, MASK))
    step(_masked_formulas(m))
    # quotation marks in one form: straight ones by their side, German ones by their opening
    straight = F.translate(F.regexp_replace(m, r"\"(?<=(?:^|[\s(（\[])\")(?=\S)", "“"), '"', "”")
    step(F.when(F.contains(m, F.lit('"')), straight).otherwise(m))
    step(F.when(F.contains(m, F.lit("„")), F.regexp_replace(m, r"„([^„“”]+)“", "„$1”")).otherwise(m))
    step(F.translate(m, "„«»「」『』", "““”“”“”"))
    word, dot = r"(?<![\p{L}\p{N}])", TO[0]
    never = (
        rf"(?<={word}(?:{TITLES}|{REFERENCES}).)",
        rf"(?<={word}[zduoiтepc].)(?=\s?(?:B|h|a|ä|d|е|к|g|e|ej){dot})",  # z. B., т. е.
        rf"(?<={word}[zduoiтepc][{dot}{MASK}]\s?(?:B|h|a|ä|d|е|к|g|e|ej).)",
        rf"(?<={word}и т.)(?=\s?[дп]{dot})",
        rf"(?=\s?\p{{Nd}})(?<={word}(?:{MONTHS}|[pSsсст]|fol).)",
        rf"(?=\s\p{{Lu}}\p{{L}})(?<=(?:^{LEADING}{{0,4}}|[{ENDS}”)\n]{LEADING}{{0,4}}|\p{{Lu}}\p{{L}}{{0,20}}{dot}?\s|(?<!\p{{L}})(?:{BEFORE_INITIAL})\s)\p{{Lu}}.)",  # initials
        rf"(?=\s\p{{Lu}})(?<=(?<!\p{{L}})(?:{GERMAN_BEFORE_ORDINAL})\s\p{{Nd}}{{1,4}}.)",
        rf"(?<=\p{{Nd}}.)(?=\s(?:{GERMAN_MONTHS})\b)",
        r"(?=[)\]”]*\s+\p{Ll})",  # what goes on in lower case
        rf"(?=[^()\n{ENDS}]*+\)\s*\p{{Ll}})",  # within brackets that the sentence goes on behind
    )
    inside = (
        rf"(?=[{ENDS}])",  # all but the last of a run
        rf"(?<=[\p{{L}}\p{{Nd}}/:][{DOT}{BANG}])(?=[\p{{Ll}}\p{{Nd}}/])",  # versions, URLs
        rf"(?<={dot})(?:{'|'.join(never)})",
        rf"(?<=[{DOT}])(?=\s)(?<=(?:^|\n\s{{0,3}}\n){LEADING}{{0,4}}\p{{Nd}}{{1,3}}.)",  # numbers of list items
        rf"(?<=[{BANG}])(?=\s?[”)]\s+\p{{Ll}})",
        rf"(?<={DOTS})(?=(?:{CONNECTIVES_ZH})|[)\]”]*\s+\p{{Ll}})",
    )
    step(F.regexp_replace(m, rf"[{ENDS}](?:{'|'.join(inside)})", MASK))
    # quotations: what is inside, then what reporting words follow
    parts = F.split(m, "(?=[“”])")

    def within(x: Column, k: Column) -> Column:
        paired = x.startswith("“") & F.coalesce(F.get(parts, k + 1).startswith("”"), F.lit(False))
        return F.when(paired, F.regexp_replace(x, rf"[{ENDS}](?=\s?\S)", MASK)).otherwise(x)

    followed = rf"[{ENDS}](?=\s?”\s?(?:[とってなか]|하고|라고|이라고|라며|고 ))"
    quoted = F.regexp_replace(F.array_join(F.transform(parts, within), ""), followed, MASK)
    start = rf"(“(?<=(?:^|[{ENDS}”\n]){LEADING}{{0,4}}“)[^“”]+)[{ENDS}]"
    said = rf"{start}(\s?”(?:(?=“)|[^“”{ENDS}\n]{{0,24}}(?:{SAY_ZH})|\s?(?:\p{{Lu}}[\p{{L}}\p{{M}}]*\s){{1,3}}(?:{SAY_EN})\b))"
    step(F.when(F.contains(m, F.lit("”")), F.regexp_replace(quoted, said, rf"$1{MASK}$2")).otherwise(m))
    return df


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit of every text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_row")).filter(F.col("_t").rlike(r"[\p{L}\p{N}]"))
    rows = masked(rows, "_t", "_m")
    rows = rows.withColumn("_m", F.regexp_replace("_m", rf"[{ENDS}](?:\s?”)?{CLOSERS}[\x{{FEFF}}\x{{200B}}-\x{{200D}}\x{{2060}}]*|\n(?=[^\S\n]*\n)", f"$0{CUT}"))
    rows = rows.withColumn("_m", F.regexp_replace("_m", r" (?<=[\x{E00}-\x{E7F}] ) *(?=[\x{E00}-\x{E7F}])", f"$0{CUT}"))
    rows = rows.withColumn("_m", F.regexp_replace("_m", r"\n(?=\s*(?:[-*+•·]|[(（]?\p{Nd}{1,3}[)）、]|[①-⑳])\s?\S)", f"\n{CUT}"))
    pieces = rows.select("doc_id", "_row", F.posexplode(F.split("_m", CUT)).alias("pos", "p"))
    lead = F.length("p") - F.length(F.ltrim("p", F.lit(INVISIBLE)))
    body = F.length(F.btrim("p", F.lit(INVISIBLE)))
    word = F.col("p").rlike(r"[\p{L}\p{N}]")
    pieces = pieces.select("doc_id", "_row", "pos", F.length("p").alias("n"), lead.alias("lead"), body.alias("body"), word.alias("word"))
    before = F.expr("sum(n) over (partition by _row order by pos rows between unbounded preceding and current row)") - F.col("n")
    placed = pieces.select("doc_id", "word", (before + F.col("lead")).cast(T.LongType()).alias("start_char"), "body").filter("word and body > 0")
    return placed.select("doc_id", "start_char", (F.col("start_char") + F.col("body")).cast(T.LongType()).alias("end_char"))
