"""Problem 1: all pairs of records whose value sets overlap above a threshold, by a prefix-filtered join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import WHITE, bucket_pairs
from affinis.operators.prefix_join import similar_sets
from affinis.runtime import spread, stage

#: White space that has to be changed: any kind but a single blank.
_UNTIDY = f"(?:(?! ){WHITE})|  "


def squeezed(col: str) -> Column:
    """Distinct entries of an array lower-cased, trimmed, with white space squeezed; null and blank ones removed."""
    tidy = F.transform(F.transform(F.col(col), F.lower), lambda x: F.trim(F.when(x.rlike(_UNTIDY), F.regexp_replace(x, f"{WHITE}+", " ")).otherwise(x)))
    return F.array_distinct(F.filter(tidy, lambda x: x.isNotNull() & (x != "")))


def set_classes(records: DataFrame, ident: str, values: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): records with equal sets share a class.

    members: ident, cls (a number), copies. classes: cls, head (the smallest ident), copies, vals (the sorted set). Empty
    and null sets are in no class; an ident with several sets is in several classes.
    """
    sets = spread(records.select(ident, values)).select(F.col(ident), F.sort_array(squeezed(values)).alias("vals"))
    keyed = sets.withColumn("k", F.unhex(F.sha2(F.array_join("vals", "\x1f"), 256))).withColumn("row", F.monotonically_increasing_id())
    keyed = stage(keyed, "sets").where("size(vals) > 0")
    own = keyed.groupBy("k", ident).agg(F.min("row").alias("row"))
    least = own.groupBy("k").agg(F.min(F.struct(ident, "row")).alias("h"), F.count(F.lit(1)).alias("copies"))
    members = stage(own.join(least, "k").select(ident, "row", F.col("h.row").alias("cls"), "copies"), "set-members")
    heads = members.where("row = cls").select("row", F.col(ident).alias("head"), "copies")
    classes = keyed.select("row", "vals").join(heads, "row").select(F.col("row").alias("cls"), "head", "copies", "vals")
    return members.select(ident, "cls", "copies"), stage(classes, "set-classes")


def similar_classes(left: DataFrame, threshold: float, right: DataFrame | None = None, **kwargs: int) -> DataFrame:
    """(cls_a, cls_b, similarity) for every two different sets with intersection / union >= threshold; see similar_sets."""
    return similar_sets(left, threshold, right, **kwargs).select("cls_a", "cls_b", "similarity")


def similar_set_pairs(records: DataFrame, ident: str, values: str, threshold: float) -> DataFrame:
    """(<ident>_a, <ident>_b): every two records whose sets are similar, records with equal sets included.

    Null idents and null, empty or all-blank sets are in no pair; ties and repeats inside a set do not matter. A repeated
    row counts once; an ident with several sets is compared with each of them, never with itself.
    """
    members, classes = set_classes(records.where(F.col(ident).isNotNull()), ident, values)
    found = similar_classes(classes, threshold).select("cls_a", "cls_b")
    same = bucket_pairs(members.where("copies > 1").select("cls", ident), ["cls"], ident).select(F.col(f"a_{ident}").alias(f"{ident}_a"), F.col(f"b_{ident}").alias(f"{ident}_b"))
    a = members.select(F.col("cls").alias("cls_a"), F.col(ident).alias("x"))
    b = members.select(F.col("cls").alias("cls_b"), F.col(ident).alias("y"))
    cross = found.join(a, "cls_a").join(b, "cls_b").where("x <> y").select(F.least("x", "y").alias(f"{ident}_a"), F.greatest("x", "y").alias(f"{ident}_b"))
    return same.unionByName(cross)


def similar_between(left: DataFrame, right: DataFrame, ident: str, values: str, threshold: float) -> DataFrame:
    """(left_<ident>, right_<ident>, similarity) for records of two tables, by classes of equal sets on both sides."""
    lm, lc = set_classes(left.where(F.col(ident).isNotNull()), ident, values)
    rm, rc = set_classes(right.where(F.col(ident).isNotNull()), ident, values)
    found = similar_classes(lc, threshold, rc)
    a = lm.select(F.col("cls").alias("cls_a"), F.col(ident).alias(f"left_{ident}"))
    b = rm.select(F.col("cls").alias("cls_b"), F.col(ident).alias(f"right_{ident}"))
    return found.join(a, "cls_a").join(b, "cls_b").select(f"left_{ident}", f"right_{ident}", "similarity")


def set_link_counts(records: DataFrame, ident: str, values: str, threshold: float) -> DataFrame:
    """One row for each record with a set: ident, class_id (equal sets), copies, links (records similar to it).

    Links are counted from pairs of classes and class sizes, without expanding copies into pairs.
    """
    members, classes = set_classes(records.where(F.col(ident).isNotNull()), ident, values)
    found = similar_classes(classes, threshold).select("cls_a", "cls_b")
    ways = found.select(F.explode(F.array(F.struct(F.col("cls_a").alias("c"), F.col("cls_b").alias("o")), F.struct(F.col("cls_b").alias("c"), F.col("cls_a").alias("o")))).alias("e")).select("e.c", "e.o")
    far = ways.join(classes.select(F.col("cls").alias("o"), "copies"), "o").groupBy(F.col("c").alias("cls")).agg(F.sum("copies").alias("far"))
    per = classes.select("cls", "head", "copies").join(far, "cls", "left")
    links = (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).cast("long")
    return members.select(ident, "cls").join(per.select("cls", "head", "copies", links.alias("links")), "cls").select(ident, F.col("head").alias("class_id"), "copies", "links")
