"""Operators of the document pipeline: page routing, ordered merge, attribution by shingles, image matching, locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessella.functions.latex import safe_asset
from tessella.functions.parsers import restore_locks
from tessella.functions.shared import best_pages
from tessella.functions.values import py_strip
from tessella.operators.pairs import small_side
from tessella.plans.lineage import cut

# What a text looks like where formulas were lost from it.
LOSS_PATTERNS = (
    r"(?U)\bA\.\s*B\.\s*C\.\s*D\.",
    r"(?:设|已知|若|满足)\s*[，,]\s*(?:[，,]\s*)*(?:为|满足|则|已知)",
    r"对边分别为\s*[，,]\s*[，,]",
    r"使得\s*”\s*是\s*“\s*”\s*的",
)
ANY_IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
# What a text counts for in the weight of its document besides its letters, and the weight up to which a document is met in one task.
ROW = 8
HEAVY = 1 << 19
# Fixed value: where uploaded files lie, in a reference.
UPLOADS = "^(?:static/)?uploads/"


def formula_loss(text: Column, images: Column) -> Column:
    """Signs that formulas were lost in extraction: nothing there, bare options, gaps between commas, images in place of formulas."""
    lost = py_strip(F.coalesce(text, F.lit(""))) == ""
    for p in LOSS_PATTERNS:
        lost = lost | F.coalesce(text.rlike(p), F.lit(False))
    return lost | ((images >= 3) & (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\$")) < 4))


def routed(pages: DataFrame) -> DataFrame:
    """Pages with their route: OCR when the extractor says so, nothing was read or formulas were lost."""
    ocr = F.coalesce("needs_ocr", F.lit(False)) | formula_loss(F.col("markdown"), F.coalesce("images", F.lit(0)))
    return pages.withColumn("route", F.when(ocr, "ocr").otherwise("native"))


def document_types(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, ocr_pages): text_based, scanned or mixed, and the pages that need OCR in order."""
    per = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == "ocr").alias("k"), F.sort_array(F.collect_list(F.when(F.col("route") == "ocr", F.col("page_index")))).alias("ocr_pages")
    )
    kind = F.when(F.col("k") == 0, "text_based").when(F.col("k") == F.col("n"), "scanned").otherwise("mixed")
    return per.select("doc_id", kind.alias("kind"), "ocr_pages")


def merged(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): non-blank pages in order, an empty line between them. Bounded by the pages of one document."""
    text = py_strip(F.coalesce("markdown", F.lit("")))
    kept = pages.select("doc_id", "page_index", text.alias("t")).filter("t != ''")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "t"))), lambda x: x["t"]), "\n\n").alias("markdown"))


def letters_only(c: Column) -> Column:
    """The letters and digits that make up shingles."""
    return F.regexp_replace(c, "[^一-龥a-zA-Z0-9]+", "")


def shingles(c: Column) -> Column:
    """Different sequences of three letters or digits of a text, or the whole of a shorter one."""
    letters = letters_only(F.coalesce(c, F.lit("")))

    def of(s: Column) -> Column:
        grams = F.array_distinct(F.regexp_extract_all(s, F.lit("(?=(.{3}))"), F.lit(1)))
        return F.when(s == "", F.array().cast("array<string>")).when(F.length(s) < 3, F.array(s)).otherwise(grams)

    return F.transform(F.array(letters), of)[0]  # bound once


def attributed(questions: DataFrame, pages: DataFrame, weights: DataFrame | None = None, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, q, page_index): the page each question shares most shingles with, the first of equals, 0 when none.

    A document is met in one task, where its shingles are numbers that never leave it; what is shuffled are the texts. Documents
    of a weight above ``heavy`` are spread over tasks by their shingles instead. ``weights`` has (doc_id, w), the letters of the
    questions and pages of each document and ``ROW`` for each of them, where the caller knows a cheaper way to them.
    """
    if weights is None:
        each = questions.select("doc_id", F.col("content").alias("t")).unionByName(pages.select("doc_id", F.col("markdown").alias("t")))
        weights = each.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("t"), F.lit(0)) + ROW).alias("w"))
    lost = questions.filter("doc_id is null").select("doc_id", "q", F.lit(0).alias("page_index"))
    questions, pages = questions.filter("doc_id is not null"), pages.filter("doc_id is not null and page_index is not null")
    hot = cut(weights.filter(F.col("w") > heavy).select("doc_id"))
    if hot.isEmpty():
        return _attributed_within(questions, pages).unionByName(lost)
    hot = small_side(hot)
    parts = [[x.join(hot, "doc_id", how) for x in (questions, pages)] for how in ("left_anti", "left_semi")]
    return _attributed_within(*parts[0]).unionByName(_attributed_across(*parts[1])).unionByName(lost)


def _attributed_within(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """``attributed``, each document in one task. Bounded by the texts of one document."""
    q = questions.groupBy("doc_id").agg(F.collect_list(F.struct(F.lit(None).cast("long").alias("page"), "q", F.col("content").alias("t"))).alias("qs"))
    p = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("page_index").cast("long").alias("page"), F.lit(None).cast(questions.schema["q"].dataType).alias("q"), F.col("markdown").alias("t")))).alias("ps"))
    both = q.join(p, "doc_id", "left")
    rows = both.select("doc_id", F.explode(F.concat(F.coalesce("ps", F.array().cast(p.schema["ps"].dataType)), "qs")).alias("x")).select("doc_id", F.col("x.page").alias("page"), "x.q", F.col("x.page").isNull().alias("asks"), "x.t")
    out = questions.select("doc_id", "q").schema
    return rows.mapInArrow(best_pages, StructType([*[StructField(f.name, f.dataType) for f in out], StructField("page_index", IntegerType())]))


def _attributed_across(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """``attributed``, the shingles of each document spread over tasks.

    Each shingle of a document is one row with the pages that hold it, hashed to 64 bits. One that stands on most pages of its
    document counts for all of them, and against the few that lack it; so a shingle common to a paper costs next to nothing.
    """
    q = questions.select("doc_id", "q", F.explode(F.transform(shingles(F.col("content")), lambda x: F.xxhash64(x))).alias("g"))
    p = pages.select("doc_id", "page_index", F.explode(F.transform(shingles(F.col("markdown")), lambda x: F.xxhash64(x))).alias("g"))
    every = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_index")).alias("every"))
    holds = p.groupBy("doc_id", "g").agg(F.collect_set("page_index").alias("on")).join(every, "doc_id")
    most = F.size("on") * 2 > F.size("every")
    holds = holds.select("doc_id", "g", most.cast("int").alias("most"), F.when(most, F.array_except("every", "on")).otherwise(F.col("on")).alias("some"))
    met = q.join(holds, ["doc_id", "g"])
    base = met.groupBy("doc_id", "q").agg(F.sum("most").alias("base"))
    change = met.select("doc_id", "q", F.explode("some").alias("page_index"), (1 - 2 * F.col("most")).alias("d"))
    change = change.groupBy("doc_id", "q", "page_index").agg(F.sum("d").alias("d")).filter("d != 0")
    best = change.groupBy("doc_id", "q").agg(F.max(F.struct("d", (-F.col("page_index")).alias("m"))).alias("b"), F.collect_list("page_index").alias("changed"))
    found = questions.select("doc_id", "q").join(base, ["doc_id", "q"], "left").join(best, ["doc_id", "q"], "left").join(every, "doc_id", "left")
    even = F.array_min(F.when(F.col("changed").isNull(), F.col("every")).otherwise(F.array_except("every", "changed")))  # the first page that is neither more nor less
    d, own = F.coalesce("b.d", F.lit(0)), -F.col("b.m")
    winner = F.when((d > 0) | even.isNull(), own).otherwise(even)
    shared = F.coalesce("base", F.lit(0)) + F.when((d > 0) | even.isNull(), d).otherwise(0)
    return found.select("doc_id", "q", F.when(shared > 0, winner).otherwise(0).cast("int").alias("page_index"))


def by_rank(a: DataFrame, b: DataFrame, key: str, a_order: list[str], b_order: list[str]) -> DataFrame:
    """The k-th row of ``a`` beside the k-th row of ``b``, per key; what is left over stays unmatched."""
    left = a.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*a_order)))
    right = b.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*b_order)))
    return left.join(right, [key, "_k"], "left").drop("_k")


def asset_keys(path: Column) -> Column:
    """The names by which an asset is matched: whole path, base name, stem; in lower case with forward slashes."""
    p = F.lower(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^\./", ""))
    base = F.regexp_extract(p, r"([^/]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    named = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x))  # noqa: E731  a name that is empty matches nothing
    return F.array_compact(F.array(named("p:", p), named("b:", base), named("s:", stem)))


def matched_assets(references: DataFrame, assets: DataFrame) -> DataFrame:
    """(ref, asset): references that match by path, base name or stem; never by part of a name."""
    r = references.select("ref", F.explode(asset_keys(F.col("ref"))).alias("k"))
    a = assets.select("asset", F.explode(asset_keys(F.col("asset"))).alias("k"))
    return r.join(a, "k").select("ref", "asset").distinct()


def only_match(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where a key has exactly one candidate; several or none give nothing."""
    per = candidates.groupBy(key).agg(F.count_distinct(value).alias("n"), F.first(value).alias(value))
    return per.filter("n = 1").select(key, value)


def collected_images(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, path, ord): images of the list, of the text and of the answer, each once at its first place, from 0; unsafe references are left out."""
    listed = F.coalesce(F.from_json("image_paths", "array<string>"), F.array().cast("array<string>"))
    text = F.concat(F.coalesce("content", F.lit("")), F.lit(" "), F.coalesce("answer_markdown", F.lit("")))
    both = F.concat(listed, F.regexp_extract_all(text, F.lit(ANY_IMAGE), F.lit(1)))
    safe = F.array_distinct(F.filter(F.transform(both, lambda x: F.regexp_replace(safe_asset(x), UPLOADS, "")), lambda x: x.isNotNull() & (x != "")))
    return df.select(key, F.posexplode(safe).alias("ord", "path")).select(key, "path", F.col("ord").cast("long").alias("ord"))


def lock_report(locks: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, created, missing, duplicated): how often each lock's mark occurs over the texts of its document; once is right.

    ``locks`` has (doc_id, lock_id), ``texts`` (doc_id, t). Marks are taken out of the texts once and counted by key.
    """
    marks = texts.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(r"LOCK_[A-Za-z0-9_-]+_[0-9]{4,}"), F.lit(0))).alias("lock_id"))
    seen = marks.groupBy("doc_id", "lock_id").agg(F.count(F.lit(1)).alias("n"))
    both = locks.select("doc_id", "lock_id").join(seen, ["doc_id", "lock_id"], "left")
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("created"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicated"))


def restored_documents(texts: DataFrame, locks: DataFrame) -> DataFrame:
    """(doc_id, pos, t, edited, error): the texts (doc_id, pos, t) of each document with the formulas of its locks (doc_id, lock_id, original) in place.

    Every lock has to occur exactly once over the texts of its document, else the document is refused as a whole: its texts are null.
    What was edited within a lock gives way to the original. A document's texts and locks are bounded.
    """
    own = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("t", F.lit("")).alias("t")))).alias("x"))
    held = locks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lock_id", "original"))).alias("l"))
    both = own.join(held, "doc_id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<lock_id: string, original: string>>")))
    done = both.select("doc_id", "x.pos", restore_locks(F.col("x.t"), F.col("l.lock_id"), F.col("l.original")).alias("r"))
    each = done.select("doc_id", F.posexplode("pos").alias("k", "pos"), "r")
    return each.select("doc_id", "pos", F.try_element_at("r.texts", F.col("k") + 1).alias("t"), "r.edited", "r.error")


def bound_images(questions: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, content, unmapped): image references replaced by the first stored path of their name, unknown ones listed.

    ``mapping`` has (name, path, ord); references and names meet by ``asset_keys``.
    """
    refs = questions.select("id", F.posexplode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))).alias("n", "ref"))
    keyed = refs.select("id", "n", "ref", F.explode(asset_keys(F.col("ref"))).alias("k"))
    names = mapping.select("path", "ord", F.explode(asset_keys(F.col("name"))).alias("k"))
    first = keyed.join(names, "k").groupBy("id", "ref").agg(F.min_by("path", "ord").alias("path"))
    per = refs.join(first, ["id", "ref"], "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "ref", "path"))).alias("r"))
    done = F.aggregate("r", F.col("content"), lambda s, x: F.when(x["path"].isNull(), s).otherwise(F.replace(s, F.concat(F.lit("]("), x["ref"], F.lit(")")), F.concat(F.lit("]("), x["path"], F.lit(")")))))
    unmapped = F.transform(F.filter("r", lambda x: x["path"].isNull()), lambda x: x["ref"])
    joined = questions.select("id", "content").join(per, "id", "left")
    nothing = F.array().cast("array<string>")
    return joined.select("id", F.when(F.col("r").isNull(), F.col("content")).otherwise(done).alias("content"), F.when(F.col("r").isNull(), nothing).otherwise(unmapped).alias("unmapped"))


def squared_tables(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, text) of merged tables: a cell (table_id, row, pos, text, span, continues) takes ``span`` columns,
    one that ``continues`` has the text of the cell above it; short rows are padded with ''."""
    by = Window.partitionBy("table_id", "row").orderBy("pos")
    start = F.sum("span").over(by.rowsBetween(Window.unboundedPreceding, -1))
    laid = cells.withColumn("col", F.coalesce(start, F.lit(0))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("span") - 1)))
    laid = laid.select("table_id", "row", (F.col("col") + F.col("k")).alias("col"), F.when(F.col("k") == 0, F.when(~F.col("continues"), F.col("text"))).otherwise(F.lit("")).alias("text"))
    up = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("text", F.coalesce(F.last("text", ignorenulls=True).over(up), F.lit("")))
    width = laid.groupBy("table_id").agg(F.max("col").alias("w"))
    grid = cells.select("table_id", "row").distinct().join(width, "table_id").select("table_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w"))).alias("col"))
    return grid.join(laid, ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("text", F.lit("")).alias("text"))
