"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import answers, canonical, mixing, neardup, packing, scans, sentences, textform, tokens
from tessella.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_pairs(table(spark, d, "questions"), table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.print_alike_pairs(table(spark, d, "questions"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every stem with its common form."""
    q = table(spark, d, "questions").select("id", "content")
    return textform.common_form(q, "content", "form").select("id", "form")


def p2_forms_kept(spark: SparkSession, d: str) -> DataFrame:
    """(rows, forms): every stem has a row, and every one that isn't null a form."""
    return p2_forms(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count("form").alias("forms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_values(table(spark, d, "questions"), table(spark, d, "question_curriculums"), table(spark, d, "curriculum_tree"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "questions")).pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with a near duplicate, its group and its number of links."""
    return neardup.NearDuplicates(table(spark, d, "questions")).groups()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "questions"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every stem and answer as continuous paragraphs without scan noise."""
    return scans.repaired_texts(table(spark, d, "questions"))


def p6_bins(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container, for each capacity."""
    return packing.pack(tokens.with_tokens(table(spark, d, "documents")), table(spark, d, "pack_specs"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p6_bins(spark, d))


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """(spec_id, capacity, documents, overfull) of each capacity: how many documents have a container, and how many containers hold too much."""
    packed = p6_bins(spark, d)
    bins = packed.groupBy("spec_id", "capacity", "bin_id").agg(F.sum("size").alias("load")).groupBy("spec_id", "capacity").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    held = packed.groupBy("spec_id").agg(F.count_distinct("doc_id").alias("documents"))
    return held.join(bins, "spec_id").select("spec_id", "capacity", "documents", "overfull")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of each mix in the order of its slots."""
    return mixing.mix(tokens.with_tokens(table(spark, d, "documents"), carry=("source",)), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_caps(spark: SparkSession, d: str) -> DataFrame:
    """(mix_id, source, within) of each target: whether no record is taken more often than it may be."""
    got = p7_shares(spark, d)
    return got.select("mix_id", "source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_forms": p2_forms, "p2_forms_kept": p2_forms_kept, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_bins": p6_bins, "p6_report": p6_report, "p6_placed": p6_placed, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_caps": p7_caps, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_placed": "select spec_id, cast(capacity_tokens as bigint) as capacity, (select count(*) from documents) as documents, 0 as overfull from pack_specs where capacity_tokens > 0",
        "p7_caps": "select mix_id, source, true as within from mix_targets",
        "p2_forms_kept": "select count(*) as rows, count(content) as forms from questions",
    }
