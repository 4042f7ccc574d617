"""Tables that are written once for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_KEY = ("scanId", "documentAId", "documentBId")


def absent_rows(incoming: DataFrame, existing: DataFrame, key: tuple[str, ...] = RESULT_KEY) -> DataFrame:
    """Rows whose key is not stored yet, one for each key; null key values are equal to each other.

    Of several rows of one key the one that comes first by all its sortable columns is kept, so retries agree.
    """
    sortable = [f.name for f in incoming.schema.fields if not f.dataType.typeName() in ("map", "variant")]
    one = incoming.groupBy(*key).agg(F.min_by(F.struct(*incoming.columns), F.struct(*sortable)).alias("_r")).select("_r.*")
    keys = existing.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    same = None
    for i, k in enumerate(key):
        c = one[k].eqNullSafe(keys[f"_k{i}"])
        same = c if same is None else same & c
    return one.join(keys, same, "left_anti")


def insert_if_absent(spark: SparkSession, incoming: DataFrame, path: str, key: tuple[str, ...] = RESULT_KEY, partition: str = "scanId") -> None:
    """Append the rows whose key the table at path does not hold, partitioned by scan. A repeated call adds nothing."""
    try:
        existing = spark.read.schema(incoming.schema).parquet(path).select(*key)
        existing.take(1)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = incoming.select(*key).limit(0)
    absent_rows(incoming, existing, key).write.mode("append").partitionBy(partition).parquet(path)


def upload_selection(files: DataFrame, key: tuple[str, ...] = ("filename", "fileSize", "createdAt")) -> DataFrame:
    """One row for each (name, size, time) of uploaded files."""
    return files.groupBy(*key).agg(F.min("documentId").alias("documentId"), F.count(F.lit(1)).alias("uploads"))


def latest_by(log: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), at).alias("_r")).select(key, "_r.*")


#: Names of scan fields in callers' spelling, and as stored.
SCAN_FIELDS = {"total_documents": "totalDocuments", "total_comparisons": "totalPossiblePairs", "candidate_pairs": "candidatePairs", "exact_comparisons": "exactComparisons", "completed_comparisons": "completedComparisons", "current_stage": "currentStage", "processing_time_ms": "processingTimeMs", "high_similarity_pairs": "highSimilarityPairs", "error_message": "errorMessage", "started_at": "startedAt", "completed_at": "completedAt"}


def renamed_fields(updates: DataFrame) -> DataFrame:
    return updates.withColumnsRenamed(SCAN_FIELDS)
