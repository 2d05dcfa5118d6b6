"""Exports and verified snapshots: written beside, checked, then put in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.search import with_ordinal


def digest(df: DataFrame, name: str) -> DataFrame:
    """(name, rows, digest): a digest of the rows as a collection, whatever their order: the sum of 60 bits of each row's MD5; one aggregate over the table."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in sorted(df.columns)]))
    value = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("s")).select(F.lit(name).alias("name"), "rows", F.coalesce(F.col("s").cast("string"), F.lit("0")).alias("digest"))


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_in_place(spark: SparkSession, staging: str, folder: str) -> None:
    """Rename ``staging`` to ``folder``; what was there is set aside first and goes only when the new one stands, or comes back if it can't."""
    fs, new = _at(spark, staging)
    target, old = _at(spark, folder)[1], _at(spark, folder + ".old")[1]
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't set {folder} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't put {folder} in place")
    fs.delete(old, True)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every table and the manifest beside ``folder``, then put them in its place; an old one is replaced only then.

    Folders are paths of any file system that Spark knows and all executors share.
    """
    spark = next(iter(tables.values())).sparkSession
    staging = folder + ".new"
    _at(spark, staging)[0].delete(_at(spark, staging)[1], True)
    manifest = []
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
        manifest.append(digest(spark.read.parquet(f"{staging}/{name}"), name).first().asDict())
    rows = [(r["name"], r["rows"], r["digest"]) for r in manifest]
    spark.createDataFrame(rows, "name string, rows long, digest string").coalesce(1).write.json(f"{staging}/manifest")
    put_in_place(spark, staging, folder)


def verify_snapshot(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables that are missing or don't agree with the manifest; [] when all is well."""
    fs, path = _at(spark, f"{folder}/manifest")
    if not fs.exists(path):
        return ["manifest"]
    wrong = []
    for entry in spark.read.schema("name string, rows long, digest string").json(f"{folder}/manifest").collect():
        at = f"{folder}/{entry['name']}"
        if not fs.exists(_at(spark, at)[1]) or digest(spark.read.parquet(at), entry["name"]).first().asDict() != entry.asDict():
            wrong.append(entry["name"])
    return wrong


def to_drop(snapshots: DataFrame, keep: int = 10) -> DataFrame:
    """Snapshots (path, at) beyond the newest ``keep``; there are few of them."""
    newest = snapshots.orderBy(F.desc("at"), F.desc("path")).limit(keep)
    return snapshots.join(F.broadcast(newest.select("path")), "path", "left_anti")  # at most ``keep`` rows


def is_due(snapshots: DataFrame, now, hours: int = 24) -> bool:
    """Whether no valid snapshot (path, at, valid) is younger than ``hours``; an invalid one doesn't count."""
    return snapshots.filter("valid").filter(F.col("at") > F.lit(now) - F.expr(f"interval {hours} hours")).isEmpty()


def report(questions: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(leaf, leaf_count, seq_num, id, label, line) of every question: its place in the whole table, the label of its type, and how many its leaf holds."""
    name = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("-")).otherwise(F.col(c))
    leaf = F.concat_ws(" / ", name("category_compulsory"), name("category_chapter"), name("category_knowledge"))
    kinds = F.create_map(*[F.lit(x) for p in labels.items() for x in p])
    label = F.coalesce(F.try_element_at(kinds, F.col("question_type")), F.col("question_type"), F.lit(""))
    rows = with_ordinal(questions.select("id", leaf.alias("leaf"), label.alias("label"), F.trim(F.regexp_replace("content", r"\s*\n\s*", " ")).alias("line")))
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("leaf_count"))
    return rows.join(sizes, "leaf").select("leaf", "leaf_count", "seq_num", "id", "label", "line")


def export_questions(questions: DataFrame, folder: str, labels: dict[str, str] | None = None) -> None:
    """All questions in order of id as JSON lines, and the report by leaf and ordinal, both finished before either is put in place."""
    spark = questions.sparkSession
    staging = folder + ".new"
    _at(spark, staging)[0].delete(_at(spark, staging)[1], True)
    questions.orderBy("id").select(F.to_json(F.struct(*questions.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{staging}/json")
    rows = report(questions, labels or {})
    line = F.concat(F.lit("- #"), F.col("seq_num").cast("string"), F.lit(" ["), "label", F.lit("] "), "line")
    rows.repartitionByRange("leaf", "seq_num").sortWithinPartitions("leaf", "seq_num").select("leaf", "leaf_count", line.alias("value")).write.json(f"{staging}/markdown")
    put_in_place(spark, staging, folder)


def read_files(spark: SparkSession, pattern: str, limit: int) -> DataFrame:
    """(path, content) of files no larger than ``limit``; others are left out before their content is read."""
    return spark.read.format("binaryFile").load(pattern).filter(F.col("length") <= limit).select("path", "content")
