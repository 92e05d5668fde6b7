"""Queries of the text problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.common import table
from pulsegrid.llm import canonical, encoding, leakage, mixing, quality, variants
from pulsegrid.operators import timestamps


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.match_values(canonical.typed_values(table(spark, sf_dir, "records"), table(spark, sf_dir, "leads")), table(spark, sf_dir, "ref_terms"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("field_name", "raw_value", "code")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records")
    return variants.variant_classes(records, timestamps.moments(records, table(spark, sf_dir, "sites")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(p4_classes(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.spoilt_fields(table(spark, sf_dir, "records"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_forms(table(spark, sf_dir, "documents"))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_matches, p4_found, p4_classes, p5_found, p8_found, p8_passages, p9_mix, p9_shares, p10_found, p10_stats)
}
ORACLES: dict[str, str] = {}
