"""Image pairs across documents by equal content or close perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.images import distance_similarity, hamming, number
from affinis.operators.candidates import BLOCK, pairs_in_buckets
from affinis.runtime import stage

#: Hashes of a tile; two tiles are compared whole. Larger ones cost a comparison less, smaller ones give more tasks.
TILE = 16384
#: Pairs that a task holds before it hands them on.
HELD = 1 << 18
#: Bits apart up to which images.matches counts two images as alike: a similarity of 0.50.
ALIKE = 16


def hash_classes(images: DataFrame) -> DataFrame:
    """dhash, images, documents, a_document: one row for each well-formed hash."""
    good = images.where(F.col("dhash").rlike("^[0-9a-fA-F]{16}$")).select(F.lower("dhash").alias("dhash"), "documentId")
    return good.groupBy("dhash").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("documentId").alias("documents"), F.min("documentId").alias("a_document"))


def close_hashes(images: DataFrame, most: int = 12) -> DataFrame:
    """(dhash_a, dhash_b, distance, similarity) of different hashes at most `most` bits apart that occur in different
    documents.

    Copies of a hash are one class; images of a null or malformed hash are 64 bits from everything.
    """
    classes = stage(hash_classes(images), "image-classes")
    side = lambda s: classes.select(F.col("dhash").alias(f"dhash_{s}"), F.col("a_document").alias(f"doc_{s}"), F.col("documents").alias(f"docs_{s}"))
    near = near_hashes(classes.select("dhash"), most).join(side("a"), "dhash_a").join(side("b"), "dhash_b")
    kept = near.where((F.col("doc_a") != F.col("doc_b")) | (F.col("docs_a") > 1) | (F.col("docs_b") > 1))
    return kept.withColumn("distance", hamming(F.col("dhash_a"), F.col("dhash_b"))).select("dhash_a", "dhash_b", "distance", distance_similarity(F.col("distance")).alias("similarity"))


def same_content(images: DataFrame) -> DataFrame:
    """image_id, first_image_id: images whose bytes another document also has, tied to the group's smallest id."""
    own = images.where("sha256 is not null and imageId is not null").select(F.lower("sha256").alias("h"), F.col("imageId").alias("image_id"), "documentId")
    groups = own.groupBy("h").agg(F.min("image_id").alias("first_image_id"), F.count_distinct("documentId").alias("documents")).where("documents > 1")
    return own.join(groups, "h").select("image_id", "first_image_id", "documents")


def _compared(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, x, y in zip(pdf["same"], pdf["x"], pdf["y"]):
                left, right = (np.ascontiguousarray(side, dtype=np.int64).view(np.uint64) for side in (x, y))
                differ, bits = np.empty_like(right), np.empty(len(right), dtype=np.uint8)
                met, held = [], 0
                for k, h in enumerate(left):
                    # a tile against itself: only what comes after h
                    start = k + 1 if same else 0
                    np.bitwise_xor(right[start:], h, out=differ[start:])
                    np.bitwise_count(differ[start:], out=bits[start:])
                    at = np.flatnonzero(bits[start:] <= most)
                    if len(at):
                        met.append((np.full(len(at), h), right[start:][at]))
                        held += len(at)
                    if held >= HELD:
                        yield _ordered(met)
                        met, held = [], 0
                if met:
                    yield _ordered(met)

    return run


def _ordered(met: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    x, y = (np.concatenate(side) for side in zip(*met))
    return pd.DataFrame({"a": np.minimum(x, y).view(np.int64), "b": np.maximum(x, y).view(np.int64)})


def near_hashes(hashes: DataFrame, most: int = ALIKE, block: int = TILE) -> DataFrame:
    """(dhash_a, dhash_b) of different hashes at most `most` bits apart; hashes: distinct, well-formed, lower case.

    An index by blocks of the hash asks for hundreds of values a hash and still meets a share of all pairs, each dearer
    than a comparison, so tiles of hashes are compared whole, by machine words. The time grows with the square of the
    hashes; what moves is a copy of each tile for every other.
    """
    values = stage(hashes.select(number(F.col("dhash")).alias("v")), "image-numbers")
    n = max(1, -(-values.count() // block))
    tiles = stage(values.groupBy(F.pmod(F.xxhash64("v"), F.lit(n)).cast("int").alias("_b")).agg(F.collect_list("v").alias("x")), "image-tiles")
    met = tiles.join(tiles.select(F.col("_b").alias("_c"), F.col("x").alias("y")), F.col("_b") <= F.col("_c"))
    # few pairs of tiles in a task, since a batch holds all of them
    tasks = max(hashes.sparkSession.sparkContext.defaultParallelism * 2, n * n // 64)
    found = met.select((F.col("_b") == F.col("_c")).alias("same"), "x", "y").repartition(tasks).mapInPandas(_compared(most), "a long, b long")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0").alias(f"dhash_{c}")
    return found.select(digits("a"), digits("b"))


def document_pairs(images: DataFrame, most: int = ALIKE) -> DataFrame:
    """Distinct (a, b), a < b, of documents with images of equal bytes or of hashes at most `most` bits apart.

    Documents meet in the buckets of equal bytes and equal hashes, and across every two close hashes; hot buckets are
    split into blocks.
    """
    own = images.where("documentId is not null").select("documentId", F.lower("sha256").alias("sha"), F.lower("dhash").alias("dhash"))
    members = stage(own.where(F.col("dhash").rlike("^[0-9a-f]{16}$")).select("dhash", "documentId").distinct(), "image-hashes")
    keyed = own.where("sha is not null").select(F.concat(F.lit("s"), "sha").alias("k"), "documentId").unionByName(members.select(F.concat(F.lit("d"), "dhash").alias("k"), "documentId"))
    equal = pairs_in_buckets(keyed.distinct(), ["k"], "documentId")
    close = stage(near_hashes(members.select("dhash").distinct(), most), "image-close")
    sizes = members.groupBy(F.col("dhash").alias("dhash_a")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("nb"))
    sized = close.join(sizes, "dhash_a")
    left = sized.join(members.select(F.col("dhash").alias("dhash_a"), F.col("documentId").alias("x")), "dhash_a").select("dhash_a", "dhash_b", "x", F.pmod(F.xxhash64("x"), F.col("nb")).alias("blk"))
    right = sized.join(members.select(F.col("dhash").alias("dhash_b"), F.col("documentId").alias("y")), "dhash_b").select("dhash_a", "dhash_b", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("blk"))
    across = left.join(right, ["dhash_a", "dhash_b", "blk"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(across).distinct()
