"""Queries of the training-data operators: pN_... belongs to problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import components, copies, leakage, mixing, near_duplicates, ocr_repair, set_join, shared_spans, subjects
from affinis.runtime import table

P1_THRESHOLD, P2_WIDTH, P4_SCORE, P6_THRESHOLD = 0.6, 240, 0.85, 0.7


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return set_join.similar_set_pairs(table(spark, d, "fingerprint_requests"), "request_id", "shingles", P1_THRESHOLD)


def p1_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return set_join.set_link_counts(table(spark, d, "fingerprint_requests"), "request_id", "shingles", P1_THRESHOLD)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "document_items"), "item_id", "text", P2_WIDTH)


def p2_shared_amounts(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_amounts(table(spark, d, "document_items"), "item_id", "text", P2_WIDTH)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.findings(table(spark, d, "pages"), table(spark, d, "images"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.paragraphs(table(spark, d, "pages"), table(spark, d, "images"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.record_groups(table(spark, d, "similarity_results"), table(spark, d, "scan_documents"), P4_SCORE)
    return groups.where("members > 1").select("document_id", "group_id")


def p4_record_groups(spark: SparkSession, d: str) -> DataFrame:
    return components.record_groups(table(spark, d, "similarity_results"), table(spark, d, "scan_documents"), P4_SCORE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_groups(table(spark, d, "document_items")).where("copies > 1").select("kept_item_id", "item_id")


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_groups(table(spark, d, "document_items")).groupBy("kept_item_id").agg(F.max("copies").alias("copies"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "document_items"), threshold=P6_THRESHOLD)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "document_items"), threshold=P6_THRESHOLD)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.where("edits = 0").select("doc_id", "eval_id")


def p7_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_samples"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), table(spark, d, "subject_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit() and callable(v)}
    return dict(sorted(own.items(), key=lambda x: (int(x[0][1 : x[0].index("_")]), not x[0].endswith("_found"))))
