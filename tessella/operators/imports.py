"""What is done with the questions read from a document before they are shown: one operator of the document pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.latex import GRAPHICS, fill_in_macro, literal_breaks
from tessella.functions.values import py_strip
from tessella.operators.documents import attributed

MARKED = r"!\[.*?\]\(([^)]+)\)"
#: Fixed value: where crops of a document's pages lie until its questions are saved.
CROPS = r"/static/(?:uploads|test_uploads)/tmp/[a-zA-Z0-9_.-]+"


def post_processed(questions: DataFrame, crops: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, q, content, answer, source, images) of the questions (doc_id, q, content, answer, source, title) of documents.

    Gaps become the gap macro and written-out line breaks real ones; a source that is missing is the document's title. The k-th different
    image name that isn't a stored path stands for the document's k-th crop (doc_id, ord, path). Crops named in a question are its images;
    a question without any gets those of the page (doc_id, page_index, markdown) that it shares most with. What is bound as an image goes from the content.
    """
    q = questions.select(
        "doc_id", "q", literal_breaks(fill_in_macro(F.coalesce("content", F.lit("")))).alias("content"), literal_breaks(F.coalesce("answer", F.lit(""))).alias("answer"),
        py_strip(F.coalesce(F.nullif("source", F.lit("")), "title", F.lit(""))).alias("source"),
    )
    names = lambda c: F.concat(F.regexp_extract_all(c, F.lit(MARKED), F.lit(1)), F.regexp_extract_all(c, F.lit(GRAPHICS), F.lit(1)))
    each = q.select("doc_id", "q", F.posexplode(F.concat(names(F.col("content")), names(F.col("answer")))).alias("n", "name"))
    each = each.withColumn("name", F.trim("name")).filter(~F.col("name").startswith("/static/") & (F.col("name") != ""))
    first = each.groupBy("doc_id", "name").agg(F.min(F.struct("q", "n")).alias("at"))  # the names of one document
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))
    stored_at = crops.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "path"))).select("doc_id", "k", "path")
    mapping = first.join(stored_at, ["doc_id", "k"]).select("doc_id", "name", "path")
    own = each.select("doc_id", "q", "name").distinct().join(mapping, ["doc_id", "name"])
    own = own.groupBy("doc_id", "q").agg(F.sort_array(F.collect_list(F.struct("name", "path")), asc=False).alias("m"))
    q = q.join(own, ["doc_id", "q"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<name: string, path: string>>")))

    def placed(c: str):
        def one(text, x):
            text = F.replace(text, F.concat(F.lit("("), x["name"], F.lit(")")), F.concat(F.lit("("), x["path"], F.lit(")")))
            pieces = F.split(text, r"(?=\\includegraphics(?:\[[^\]]*\])?\{)")
            head = r"^\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}"
            image = F.concat(F.lit("![插图]("), x["path"], F.lit(")"))
            return F.array_join(F.transform(pieces, lambda p: F.when(F.regexp_extract(p, head, 1) == x["name"], F.concat(image, F.regexp_replace(p, head, ""))).otherwise(p)), "")

        return F.aggregate("m", F.col(c), one)

    q = q.withColumns({"content": placed("content"), "answer": placed("answer")})
    q = q.withColumn("named", F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(CROPS), F.lit(0)), F.regexp_extract_all("answer", F.lit(CROPS), F.lit(0)))))
    page_of = attributed(q.filter(F.size("named") == 0).select("doc_id", "q", "content"), pages)
    on_page = pages.select("doc_id", "page_index", F.array_distinct(F.regexp_extract_all("markdown", F.lit(CROPS), F.lit(0))).alias("on_page"))
    fallback = page_of.join(on_page, ["doc_id", "page_index"]).select("doc_id", "q", "on_page")
    nothing = F.array().cast("array<string>")
    q = q.join(fallback, ["doc_id", "q"], "left").withColumn("images", F.when(F.size("named") > 0, F.col("named")).otherwise(F.coalesce("on_page", nothing)))
    kept = F.aggregate("images", F.col("content"), lambda text, x: F.array_join(F.transform(F.split(text, r"(?=!\[)"), lambda p: F.when(F.regexp_extract(p, r"^!\[[^\]]*\]\(([^)]*)\)", 1) == x, F.regexp_replace(p, r"^!\[[^\]]*\]\([^)]*\)", "")).otherwise(p)), ""))
    return q.select("doc_id", "q", py_strip(kept).alias("content"), "answer", "source", "images")
