"""Problem 2: one consistent form for texts that print alike.

Method: text is exploded to positioned code points, which meet the decomposition and look-alike tables and the
table of combining classes in broadcast joins (both tables are bounded by Unicode); marks are put in order of class
within their cluster, composed again, and the strings are rebuilt.

Most texts hold no combining mark and no code point that stands for several ones. For them the exploded form is
a plain replacement of code points, which ``translate`` does in place with the same table. Of the others only the
stretches that need ordering, composing or expanding are exploded, each different one once. ``explode_all=True`` sends
every text as a whole through the exploded path; both give the same result (tested).

Nulls stay null, empty texts stay empty, equal texts get equal forms, and other columns are passed through.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import forms
from tessella.operators.pairs import expanded, pairs_within, small_side
from tessella.plans.lineage import cut, stored


#: Blocks of everyday letters and signs; the pattern below may take in other code points, but none of these needlessly.
EVERYDAY = (
    (0x20, 0x2FF), (0x370, 0x52F), (0x5D0, 0x5EA), (0x620, 0x6D3), (0x904, 0x97F), (0xE01, 0xE5B), (0x2010, 0x2027), (0x3001, 0x30FF),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E),
)
#: Ranges without any such code point, looked at first.
PLAIN = ((0x00, 0x131), (0x4E00, 0x9FFF), (0xFF01, 0xFF5E), (0x3000, 0x3029), (0x400, 0x45D))


def _ranges(chars: list[str]) -> str:
    """A Java character class of these characters in few ranges: gaps without everyday characters are taken in."""
    out: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if out and not any(a <= hi and lo <= b for a, b in [(out[-1][1] + 1, cp - 1)] if a <= b for lo, hi in EVERYDAY):
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


@lru_cache(maxsize=1)
def _needs_explode() -> str:
    """Pattern of code points that a replacement one by one can't bring to the common form."""
    frm, _, dropped = forms.single_map()
    single = set(frm) | set(dropped)
    wide = [c for c, _ in forms.expansion_rows() if c not in single and unicodedata.normalize("NFC", forms.expand(c)) != c]
    seconds = [b for _, b, _ in forms.compose_rows()]
    moving = [c for c, full in forms.expansion_rows() if c in single and unicodedata.combining((unicodedata.normalize("NFC", full) or "a")[0])]
    jamo = [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]
    plain = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in PLAIN) + "]"
    return f"(?!{plain})" + _ranges(list({*wide, *moving, *seconds, *jamo, *(c for c, _ in forms.mark_rows())}))


def _replaced(c: Column) -> Column:
    frm, to, dropped = forms.single_map()
    return F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), frm + dropped, to)


def _cp(c: Column) -> Column:
    return F.ascii(c)


def _from_cp(c: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")


def _compose(items: Column) -> Column:
    """Canonical composition of one cluster: an array of (mark class, position, character) in canonical order."""
    pairs = forms.compose_rows()
    table = F.map_from_arrays(F.array(*[F.lit(a + b) for a, b, _ in pairs]), F.array(*[F.lit(c) for _, _, c in pairs]))
    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("base"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def step(s: Column, x: Column) -> Column:
        base, tail, c, k = s["base"], s["tail"], x["ch"], x["ccc"]
        free = (tail == "") | ((k > 0) & (s["last"] < k))
        l, v = _cp(base), _cp(c)
        hangul = F.when(l.between(0x1100, 0x1112) & v.between(0x1161, 0x1175), _from_cp(((l - 0x1100) * 21 + (v - 0x1161)) * 28 + 0xAC00)).when(
            l.between(0xAC00, 0xD7A3) & ((l - 0xAC00) % 28 == 0) & v.between(0x11A8, 0x11C2), _from_cp(l + v - 0x11A7)
        )
        joined = F.when(free & (base != ""), F.coalesce(hangul, F.try_element_at(table, F.concat(base, c))))
        grown = F.struct(s["out"].alias("out"), joined.alias("base"), tail.alias("tail"), s["last"].alias("last"))
        mark = F.struct(s["out"].alias("out"), base.alias("base"), F.concat(tail, c).alias("tail"), k.alias("last"))
        fresh = F.struct(F.concat(s["out"], base, tail).alias("out"), c.alias("base"), F.lit("").alias("tail"), F.lit(0).alias("last"))
        return F.when(joined.isNotNull(), grown).when((k > 0) & (base != ""), mark).otherwise(fresh)

    return F.aggregate(items, zero, step, lambda s: F.concat(s["out"], s["base"], s["tail"]))


def exploded_form(texts: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """(key, out): the common form by exploding to positioned code points. ``key`` must be unique."""
    spark = texts.sparkSession
    rows = forms.expansion_rows()
    table = spark.createDataFrame(rows, "ch string, full string")
    marks = spark.createDataFrame(forms.mark_rows(), "sub string, ccc int")
    seconds = spark.createDataFrame(sorted({(b,) for _, b, _ in forms.compose_rows() if not unicodedata.combining(b)} | {(chr(c),) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}), "sub string").withColumn("joins", F.lit(True))
    points = texts.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "")).alias("pos", "ch"))
    points = points.join(F.broadcast(table), "ch", "left").select(key, "pos", F.posexplode(F.split(F.coalesce("full", "ch"), "")).alias("sub_pos", "sub")).filter("sub != ''")
    points = points.join(F.broadcast(marks), "sub", "left").join(F.broadcast(seconds), "sub", "left")
    points = points.select(key, "pos", "sub_pos", F.col("sub").alias("ch"), F.coalesce("ccc", F.lit(0)).alias("ccc"), F.coalesce("joins", F.lit(False)).alias("joins"))
    # a starter begins a run of marks; a starter that may join the one before stays in its cluster
    by_text = F.expr(f"sum(if(ccc = 0, 1, 0)) over (partition by {key} order by pos, sub_pos)")
    by_cluster = F.expr(f"sum(if(ccc = 0 and not joins, 1, 0)) over (partition by {key} order by pos, sub_pos)")
    points = points.select(key, by_cluster.alias("cluster"), by_text.alias("starter"), "pos", "sub_pos", "ch", "ccc")
    clusters = points.groupBy(key, "cluster").agg(F.sort_array(F.collect_list(F.struct("starter", "ccc", "pos", "sub_pos", "ch"))).alias("items"))
    clusters = clusters.select(key, "cluster", F.when(F.size("items") == 1, F.col("items")[0]["ch"]).otherwise(_compose(F.col("items"))).alias("s"))
    return clusters.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "s"))), lambda x: x["s"]), "").alias(out))


@lru_cache(maxsize=1)
def _stretches() -> str:
    """Pattern of a character and the code points behind it that need exploding; what stands between is independent.

    Characters without a glyph may stand between the two, since they go and the others meet.
    """
    runs: list[list[int]] = [[0xE0000, 0xE0FFF]]
    for cp in sorted(map(ord, forms.single_map()[2])):
        if runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    gone = r"(?![\x20-\x7E\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF5E}])[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in runs) + "]"
    return rf"(?s)(?:(?!{gone}).)?(?:(?:{gone})*(?:{_needs_explode()}))++"


def common_form(df: DataFrame, text: str, out: str, explode_all: bool = False) -> DataFrame:
    """``df`` with the common form of ``text`` in column ``out``.

    Of texts that need it, the stretches around combining marks and the like are exploded, each different stretch once,
    and put back at their places.
    """
    c = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    kept = [x for x in df.columns if x != out]
    if explode_all:
        keyed = df.withColumn("__form_key", F.md5(text))
        distinct = keyed.filter(F.col(text).isNotNull()).groupBy("__form_key").agg(F.min(text).alias("__form_text"))
        made = exploded_form(distinct, "__form_key", "__form_text", "__form_out")
        return keyed.join(made, "__form_key", "left").withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce("__form_out", F.lit("")))).select(*kept, out)
    needs = F.coalesce(F.col(text).rlike(_needs_explode()), F.lit(False))
    plain = df.filter(~needs).withColumn(out, _replaced(F.col(text)))
    rest = df.filter(needs).withColumn("__form_key", F.md5(text))
    found = rest.groupBy("__form_key").agg(F.min(c).alias("_t")).select("__form_key", F.regexp_extract_all("_t", F.lit(_stretches()), F.lit(0)).alias("_s"))
    placed = found.select("__form_key", F.posexplode("_s").alias("_pos", "__stretch")).withColumn("__stretch_key", F.unhex(F.md5("__stretch")))
    distinct = placed.groupBy("__stretch_key").agg(F.min("__stretch").alias("__stretch"))  # code points carry a short key, not the stretch
    made = cut(exploded_form(distinct, "__stretch_key", "__stretch", "__made"))
    placed = placed.drop("__stretch").join(small_side(made), "__stretch_key", "left")
    made_of = placed.groupBy("__form_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("__made", F.lit("")).alias("f")))), lambda x: x["f"]).alias("__forms"))
    between = F.transform(F.split(c, _stretches()), lambda p, k: F.concat(_replaced(p), F.coalesce(F.try_element_at(F.col("__forms"), k + 1), F.lit(""))))
    slow = rest.join(made_of, "__form_key").withColumn(out, F.array_join(between, "")).select(*kept, out)
    return plain.select(*kept, out).unionByName(slow)


def print_alike_pairs(df: DataFrame, key: str = "id", text: str = "content", explode_all: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose stored text differs but prints the same. Null texts give no pair.

    The different texts of a form are paired, then each with the rows that hold it, in blocks.
    """
    rows = common_form(df.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("_text")), "_text", "_form", explode_all)
    rows = stored(rows.select("id", F.unhex(F.md5("_form")).alias("_g"), F.xxhash64("_text").alias("_raw")))
    texts = rows.groupBy("_g", "_raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    varied = rows.groupBy("_g").agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).filter("lo != hi").select("_g")
    texts = cut(texts.join(varied, "_g", "left_semi"))
    links = pairs_within(texts, "_g", "rep").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    several = texts.filter("n > 1")
    copies = rows.join(small_side(several), ["_g", "_raw"]).select("rep", "n", "id")
    return expanded(links, several.select("rep", "n"), copies)
