"""Candidate pairs by LSH banding and equal hashes, and exact set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.config import DEFAULT, SimilarityConfig
from affinis.functions import hashing, text
from affinis.operators import prefix_join
from affinis.runtime import spread, stage

#: Rows that one task pairs with the rest of a bucket; larger buckets are split.
BLOCK = 2000


def features(docs: DataFrame, ident: str = "doc_id", body: str = "text", config: SimilarityConfig = DEFAULT) -> DataFrame:
    """ident, sha, norm_hash, n_tokens, shingles and sig of every document with an ident.

    Hashes of empty canonical texts are null unless compat_empty is set, so empties are no duplicates of each other.
    """
    base = spread(docs.where(F.col(ident).isNotNull()).select(ident, F.coalesce(body, F.lit("")).alias("_t")))
    norm = text.normalized(F.col("_t"))
    toks = text.tokens(F.col("_t"))
    filled = F.lit(True) if config.compat_empty else F.col("_norm") != ""
    out = base.select(ident, "_t", norm.alias("_norm"), toks.alias("_toks"))
    out = out.select(ident, F.when(filled, F.sha2("_t", 256)).alias("sha"), F.when(filled, F.sha2("_norm", 256)).alias("norm_hash"), F.size("_toks").cast("long").alias("n_tokens"), text.shingles(F.col("_toks"), config.shingle_size).alias("shingles"))
    # staged first: as the input of a Python function, the shingles would be computed anew for every run of tokens
    return stage(out, "shingled").withColumn("sig", hashing.minhash(F.col("shingles"), config.permutations))


def band_rows(sigs: DataFrame, ident: str, config: SimilarityConfig = DEFAULT) -> DataFrame:
    """ident, band, key: a row for each band; signatures that are null or too short, and those of empty sets, have none."""
    need = config.bands * config.rows
    usable = sigs.where((F.size("sig") >= need) & (F.col("sig")[0] < hashing.EMPTY))
    cut = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda i: F.slice("sig", i * config.rows + 1, config.rows))
    return usable.select(ident, F.posexplode(cut).alias("band", "key"))


def pairs_in_buckets(rows: DataFrame, keys: list[str], ident: str, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of idents that share a bucket; hot buckets are split into blocks, none is cut short."""
    sized = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), keys).withColumn("_b", F.ceil(F.col("_n") / block).cast("int"))
    left = sized.select(*keys, F.col(ident).alias("a"), F.pmod(F.xxhash64(ident), F.col("_b").cast("long")).cast("int").alias("_blk"))
    right = sized.select(*keys, F.col(ident).alias("b"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_blk"))
    return left.join(right, [*keys, "_blk"]).where("a < b").select("a", "b").distinct()


def set_key(values: Column) -> Column:
    """Equal for equal sets only, in whatever order their values stand."""
    return F.sha2(F.array_join(F.sort_array(values), "\x1f"), 256)


def lsh_pairs(sigs: DataFrame, ident: str, config: SimilarityConfig = DEFAULT) -> DataFrame:
    """(a, b) that share a band. sigs: ident, sig and set_key; without set_key no two rows count as copies.

    Documents of equal sets share all bands: one of them stands for all, and the others are tied to it, so copies of one
    text do not multiply. Different sets of equal signature each enter the buckets.
    """
    if "set_key" not in sigs.columns:
        sigs = sigs.withColumn("set_key", F.col(ident).cast("string"))
    least = sigs.groupBy("set_key").agg(F.min(ident).alias("_rep"))
    usable = sigs.where((F.size("sig") >= config.bands * config.rows) & (F.col("sig")[0] < hashing.EMPTY))
    ties = usable.select(ident, "set_key").join(least, "set_key").where(F.col(ident) != F.col("_rep"))
    reps = usable.join(least.select("set_key", F.col("_rep").alias(ident)), ["set_key", ident], "left_semi").select(ident, "sig")
    between = pairs_in_buckets(band_rows(reps, ident, config), ["band", "key"], ident)
    return between.unionByName(ties.select(F.col("_rep").alias("a"), F.col(ident).alias("b")))


def hash_ties(feats: DataFrame, ident: str, hashes: tuple[str, ...] = ("sha", "norm_hash")) -> DataFrame:
    """(a, b): every document with the smallest one of equal hash; a group of n copies gives n - 1 rows."""
    out = None
    for h in hashes:
        known = feats.where(F.col(h).isNotNull()).select(ident, F.col(h).alias("h"))
        tied = known.join(known.groupBy("h").agg(F.min(ident).alias("a")), "h").where(F.col(ident) != F.col("a")).select("a", F.col(ident).alias("b"))
        out = tied if out is None else out.unionByName(tied)
    return out.distinct()


def candidates(feats: DataFrame, ident: str, config: SimilarityConfig = DEFAULT) -> DataFrame:
    """(a, b, is_exact): ties by hash, which are exact duplicates, and LSH pairs."""
    exact = hash_ties(feats, ident).withColumn("e", F.lit(1))
    keyed = ["set_key"] if "set_key" in feats.columns else [set_key(F.col("shingles")).alias("set_key")] if "shingles" in feats.columns else []
    near = lsh_pairs(feats.select(ident, "sig", *keyed), ident, config).withColumn("e", F.lit(0))
    return exact.unionByName(near).groupBy("a", "b").agg((F.max("e") == 1).alias("is_exact"))


def candidate_stats(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: documents, possible pairs, candidates, exact duplicates, pairs left to verify, reduction in percent."""
    n = feats.agg(F.count(F.lit(1)).alias("documents"))
    c = pairs.agg(F.count(F.lit(1)).alias("candidate_pairs"), F.coalesce(F.count_if("is_exact"), F.lit(0)).alias("exact_duplicates"))
    one = n.join(F.broadcast(c), F.lit(True))
    possible = (F.col("documents") * (F.col("documents") - 1) / 2).cast("long")
    cut = F.when(F.col("possible_pairs") > 0, text.rounded((F.col("possible_pairs") - F.col("candidate_pairs")) / F.col("possible_pairs") * 100, 2)).otherwise(0.0)
    return one.withColumn("possible_pairs", possible).select("documents", "possible_pairs", "candidate_pairs", "exact_duplicates", (F.col("candidate_pairs") - F.col("exact_duplicates")).alias("jaccard_pairs"), cut.alias("reduction_percent"))


def set_scores(pairs: DataFrame, sets: DataFrame, ident: str, values: str = "shingles") -> DataFrame:
    """pairs with shared, jaccard and containment of the two sets; two empty sets score 0."""
    a = sets.select(F.col(ident).alias("a"), F.col(values).alias("_x"))
    b = sets.select(F.col(ident).alias("b"), F.col(values).alias("_y"))
    both = F.size(F.array_intersect("_x", "_y")).cast("long")
    joined = pairs.join(a, "a").join(b, "b").withColumn("shared", both)
    union, small = F.size("_x") + F.size("_y") - F.col("shared"), F.least(F.size("_x"), F.size("_y"))
    return joined.withColumn("jaccard", F.when(union > 0, F.col("shared") / union).otherwise(0.0)).withColumn("containment", F.when(small > 0, F.col("shared") / small).otherwise(0.0)).drop("_x", "_y")


def jaccard_pairs(sets: DataFrame, ident: str, values: str, threshold: float) -> DataFrame:
    """(a, b, shared, jaccard) of every two sets at the threshold or above, by a prefix-filtered join.

    Equal sets are joined once and tied as a star. Values travel as 64-bit hashes. threshold 0 gives every pair with
    something in common.
    """
    # the filter stays behind the staging: pushed below it, it would compute the sets once more
    hashed = F.sort_array(F.array_distinct(F.transform(values, lambda x: F.xxhash64(x))))
    own = sets.select(F.col(ident).alias("i"), hashed.alias("vals")).withColumn("k", F.unhex(F.sha2(F.array_join(F.col("vals").cast("array<string>"), ","), 256)))
    own = stage(own, "jaccard-sets").where("size(vals) > 0")
    least = own.groupBy("k").agg(F.min("i").alias("r"))
    ties = own.select("i", "k", F.size("vals").cast("long").alias("shared")).join(least, "k").where("i <> r").select(F.col("r").alias("a"), F.col("i").alias("b"), "shared", F.lit(1.0).alias("jaccard"))
    reps = own.join(least.select("k", F.col("r").alias("i")), ["k", "i"], "left_semi").select(F.col("i").alias("cls"), "vals")
    near = prefix_join.similar_sets(reps, threshold, block=BLOCK).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "shared", F.col("similarity").alias("jaccard"))
    return near.unionByName(ties)


def estimates(pairs: DataFrame, sigs: DataFrame, ident: str) -> DataFrame:
    """pairs with the signatures' estimate of the similarity."""
    a, b = sigs.select(F.col(ident).alias("a"), F.col("sig").alias("_x")), sigs.select(F.col(ident).alias("b"), F.col("sig").alias("_y"))
    return pairs.join(a, "a").join(b, "b").withColumn("estimate", hashing.estimated_similarity(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def recall(found: DataFrame, truth: DataFrame, at: float) -> DataFrame:
    """One row: pairs of truth at the similarity or above, those among found, and their share (1.0 if there are none)."""
    wanted = truth.where(F.col("jaccard") >= at).select("a", "b")
    hit = wanted.join(found.select("a", "b").withColumn("h", F.lit(1)), ["a", "b"], "left").agg(F.count(F.lit(1)).alias("true_pairs"), F.coalesce(F.sum("h"), F.lit(0)).alias("found_pairs"))
    return hit.select("true_pairs", "found_pairs", F.when(F.col("true_pairs") > 0, F.col("found_pairs") / F.col("true_pairs")).otherwise(1.0).alias("recall"))


def fingerprint_source(requests: DataFrame, config: SimilarityConfig = DEFAULT) -> DataFrame:
    """request_id and the distinct shingles of a request: given, made from its tokens, or made from its text.

    Null and empty entries of given arrays are dropped; a request with nothing has an empty set.
    """
    some = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    own = spread(requests).select("request_id", "shingles", F.when(F.col("tokens").isNotNull(), some("tokens")).otherwise(text.tokens(F.col("text"))).alias("_toks"))
    made = text.shingles(F.col("_toks"), config.shingle_size)
    return own.select("request_id", F.when(F.col("shingles").isNotNull(), F.array_distinct(some("shingles"))).otherwise(made).alias("shingles"))
