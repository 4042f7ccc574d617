"""Every two sets that overlap above a threshold, by a prefix-filtered join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.runtime import stage

#: Sets that one task pairs with the rest of a value's sets; values of more sets are split into blocks.
BLOCK = 2000


def ceiling(x: Column) -> Column:
    """Ceiling that ignores the last bits of a floating product."""
    return F.ceil(x - F.lit(1e-9)).cast("int")


def _lists(sets: DataFrame, numbers: DataFrame, label: str) -> DataFrame:
    """cls, n (size of the set), ids and dfs: numbers of the values that two sets or more hold, rarest first, and in how many
    sets each stands."""
    values = sets.select("cls", F.size("vals").alias("n"), F.explode("vals").alias("tok"))
    listed = values.join(numbers, "tok").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "id"))).alias("o"))
    return stage(listed.select("cls", "n", F.col("o.id").alias("ids"), F.col("o.df").alias("dfs")), label)


def _prefixes(lists: DataFrame, threshold: float) -> DataFrame:
    """cls, n, tok, pos, df, indexed: the probing prefix of each set.

    A set of n values probes with its n - ceil(t n) + 1 rarest; it needs to be indexed with the n - ceil(2t/(1+t) n) + 1
    rarest only, since the smaller set of a pair is the indexed one. Values of one set only can't meet, but keep their
    places, which are the first.
    """
    t = float(threshold)
    probe = F.col("n") - ceiling(F.col("n") * F.lit(t)) + 1
    index = F.col("n") - ceiling(F.col("n") * F.lit(2 * t / (1 + t))) + 1
    alone = F.col("n") - F.size("ids")
    both = F.slice(F.arrays_zip("ids", "dfs"), F.lit(1), F.greatest(probe - alone, F.lit(0)))
    cut = lists.select("cls", "n", index.alias("ix"), alone.alias("alone"), F.posexplode(both).alias("at", "e"))
    pos = F.col("at") + F.col("alone")
    return cut.select("cls", "n", F.col("e.ids").alias("tok"), pos.alias("pos"), F.col("e.dfs").alias("df"), (pos < F.col("ix")).alias("indexed"))


def similar_sets(left: DataFrame, threshold: float, right: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(cls_a, cls_b, shared, similarity) for every two different sets with intersection / union >= threshold.

    left and right: cls (unique in its table) and vals (distinct values). Without right the join is within left and
    cls_a < cls_b. Values are counted and numbered once, and sets travel as arrays of numbers in order of rarity over all
    sets. A value of more than block sets is split: the indexed sets fall into blocks and every probing set visits each
    block. Candidates pass the length filter and the positional bound and are verified on the whole sets. Sets with
    nothing in common are in no pair, whatever the threshold.
    """
    sides = left.select("vals") if right is None else left.select("vals").unionByName(right.select("vals"))
    numbers = sides.select(F.explode("vals").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    numbers = stage(numbers.select("tok", "df", F.monotonically_increasing_id().alias("id")), "set-values")
    mine = _lists(left, numbers, "set-lists")
    other = mine if right is None else _lists(right, numbers, "set-lists")
    blocks = F.ceil(F.col("df") / F.lit(block)).cast("int")

    def joined(index: DataFrame, probe: DataFrame, strict: bool) -> DataFrame:
        i = _prefixes(index, threshold).where("indexed").select("tok", F.pmod(F.xxhash64("cls"), blocks.cast("long")).cast("int").alias("blk"), F.col("cls").alias("i"), F.col("n").alias("ni"), F.col("pos").alias("pi"))
        p = _prefixes(probe, threshold).select("tok", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"), F.col("cls").alias("p"), F.col("n").alias("np"), F.col("pos").alias("pp"))
        need = F.greatest(F.lit(1), ceiling((F.col("ni") + F.col("np")) * F.lit(threshold / (1 + threshold))))
        longest = F.col("np") * F.lit(float(threshold)) - 1e-9 <= F.col("ni")
        smaller = (F.col("ni") < F.col("np")) if strict else (F.col("ni") <= F.col("np"))
        bound = F.least(F.col("ni") - F.col("pi"), F.col("np") - F.col("pp")) >= need
        return i.join(p, ["tok", "blk"]).where(longest & smaller & bound).select("i", "p", "ni", "np")

    if right is None:
        hits = joined(mine, mine, False).where("ni < np or i < p").select(F.least("i", "p").alias("cls_a"), F.greatest("i", "p").alias("cls_b")).distinct()
    else:
        hits = joined(mine, other, False).select(F.col("i").alias("cls_a"), F.col("p").alias("cls_b"))
        hits = hits.unionByName(joined(other, mine, True).select(F.col("p").alias("cls_a"), F.col("i").alias("cls_b"))).distinct()
    a = mine.select(F.col("cls").alias("cls_a"), F.col("n").alias("na"), F.col("ids").alias("va"))
    b = other.select(F.col("cls").alias("cls_b"), F.col("n").alias("nb"), F.col("ids").alias("vb"))
    checked = hits.join(a, "cls_a").join(b, "cls_b").select("cls_a", "cls_b", "na", "nb", F.size(F.array_intersect("va", "vb")).alias("shared"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    kept = checked.where((F.col("shared") > 0) & (F.col("shared") >= union * F.lit(float(threshold)) - 1e-9))
    return kept.select("cls_a", "cls_b", F.col("shared").cast("long").alias("shared"), (F.col("shared") / union).alias("similarity"))
