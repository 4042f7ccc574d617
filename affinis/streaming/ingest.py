"""Documents that arrive in files are compared with each other and with all earlier ones, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from affinis.config import DEFAULT, SimilarityConfig
from affinis.functions.hashing import EMPTY
from affinis.operators import candidates as C
from affinis.sources.sinks import insert_if_absent


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        found = spark.read.schema(schema).parquet(path)
        found.take(1)
        return found
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def compare_new(fresh: DataFrame, known: DataFrame, config: SimilarityConfig = DEFAULT) -> DataFrame:
    """(documentAId, documentBId, similarityScore) of candidate pairs with a new document, a before b.

    fresh and known: documentId, sha, norm_hash, shingles, sig. Only pairs that touch a new document are generated: the
    buckets of new documents meet those of all, hot ones in blocks. Of documents with equal sets one, an earlier one if
    there is any, stands for all, and new ones are tied to it. Equal hashes score 1.
    """
    old = known.join(fresh.select("documentId"), "documentId", "left_anti")
    every = fresh.withColumn("late", F.lit(1)).unionByName(old.withColumn("late", F.lit(0)))
    filled = (F.size("sig") >= config.bands * config.rows) & (F.col("sig")[0] < EMPTY)
    keyed = every.where(filled).select("documentId", "late", "sig", C.set_key(F.col("shingles")).alias("set_key"))
    least = keyed.groupBy("set_key").agg(F.min(F.struct("late", "documentId")).alias("r")).select("set_key", F.col("r.documentId").alias("rep"))
    ties = keyed.where("late = 1").join(least, "set_key").where(F.col("documentId") != F.col("rep")).select(F.col("rep").alias("x"), F.col("documentId").alias("y"))
    reps = keyed.join(least.withColumnRenamed("rep", "documentId"), ["set_key", "documentId"], "left_semi")
    new = C.band_rows(reps.where("late = 1").select(F.col("documentId").alias("x"), "sig"), "x", config)
    all_bands = C.band_rows(reps.select(F.col("documentId").alias("y"), "sig"), "y", config)
    blocks = all_bands.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / C.BLOCK).alias("nb"))
    placed = all_bands.join(blocks, ["band", "key"]).select("band", "key", "y", F.pmod(F.xxhash64("y"), F.col("nb")).alias("blk"))
    asking = new.join(blocks, ["band", "key"]).select("band", "key", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("blk"))
    near = asking.join(placed, ["band", "key", "blk"]).where("x <> y").select("x", "y").unionByName(ties)
    exact = None
    for h in ("sha", "norm_hash"):
        part = fresh.select(F.col("documentId").alias("x"), h).join(every.groupBy(h).agg(F.min("documentId").alias("y")), h).where("x <> y").select("x", "y")
        exact = part if exact is None else exact.unionByName(part)
    both = near.withColumn("e", F.lit(0)).unionByName(exact.withColumn("e", F.lit(1)))
    pairs = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg((F.max("e") == 1).alias("is_exact"))
    scored = C.set_scores(pairs, every.select("documentId", "shingles"), "documentId")
    return scored.select(F.col("a").alias("documentAId"), F.col("b").alias("documentBId"), F.when(F.col("is_exact"), 1.0).otherwise(F.col("jaccard")).alias("similarityScore"))


def start(spark: SparkSession, source: str, schema: StructType, features_path: str, results_path: str, checkpoint: str, scan_id: str = "stream", config: SimilarityConfig = DEFAULT, once: bool = True) -> StreamingQuery:
    """Watch a folder of parquet files (documentId, text). Each batch is scored against stored features, its results are
    inserted if absent and its features appended; a batch that is run again adds nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        fresh = C.features(df.dropDuplicates(["documentId"]), "documentId", "text", config)
        known = _stored(session, features_path, fresh.schema)
        new = fresh.join(known.select("documentId"), "documentId", "left_anti").persist()
        try:
            scores = compare_new(new, known, config).withColumn("scanId", F.lit(scan_id)).withColumn("batch", F.lit(number))
            insert_if_absent(session, scores.select("scanId", "documentAId", "documentBId", "similarityScore"), results_path)
            new.write.mode("append").parquet(features_path)
        finally:
            new.unpersist()

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
