"""Read queries over stored scans, documents and scored pairs.

All functions work on every scan at once, with scan_id as a key; filter on scan_id for one. Identifiers compare
lower-cased and without outer white space, scores on the scale 0..1. Rows without a scan are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from affinis.functions.text import classification, contains_literal, is_exact_score, rounded, score01

#: A pair at this score or above is an exact duplicate.
EXACT = 0.9999


def tidy(name: str) -> Column:
    t = F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def stored_documents(documents: DataFrame) -> DataFrame:
    """scan_id, doc_id and the latest record of each document; ties on createdAt fall to the greater filename."""
    rows = documents.select(tidy("scanId").alias("scan_id"), tidy("documentId").alias("doc_id"), F.struct("filename", "fileType", "fileSize", "sha256Hash", "normalizedHash", "tokenCount", "createdAt").alias("r"))
    latest = rows.where("scan_id is not null and doc_id is not null").groupBy("scan_id", "doc_id").agg(F.max_by("r", F.struct("r.createdAt", "r.filename")).alias("r"))
    return latest.select("scan_id", "doc_id", F.col("r.filename").alias("filename"), F.col("r.fileType").alias("file_type"), F.col("r.fileSize").alias("file_size"), F.lower("r.sha256Hash").alias("sha"), F.lower("r.normalizedHash").alias("norm_hash"), F.col("r.tokenCount").alias("token_count"))


def stored_pairs(results: DataFrame) -> DataFrame:
    """The first write of each (scan, a, b): scan_id, a, b, name_a, name_b, score, n_passages, n_images, n_code, n_tables.

    Of the passages only one leaf is read, to count them. Pairs with a missing id are left out; score may be null. Of rows written at one time the highest score stands.
    """
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    row = F.struct(score01(F.col("similarityScore")).alias("score"), F.col("fileName1").alias("name_a"), F.col("fileName2").alias("name_b"), n("matchingPassages.similarity").alias("n_passages"), n("evidence.images").alias("n_images"), n("evidence.code").alias("n_code"), n("evidence.tables").alias("n_tables"), "createdAt")
    rows = results.select(tidy("scanId").alias("scan_id"), tidy("documentAId").alias("a"), tidy("documentBId").alias("b"), row.alias("r")).where("scan_id is not null and a is not null and b is not null")
    rank = F.struct(F.col("r.createdAt"), -F.coalesce("r.score", F.lit(-1.0)), F.coalesce("r.name_a", F.lit("")), F.coalesce("r.name_b", F.lit("")), "r.n_passages", "r.n_images", "r.n_code", "r.n_tables")
    first = rows.groupBy("scan_id", "a", "b").agg(F.min_by("r", rank).alias("r"))
    return first.select("scan_id", "a", "b", "r.name_a", "r.name_b", "r.score", "r.n_passages", "r.n_images", "r.n_code", "r.n_tables")


def sides(pairs: DataFrame) -> DataFrame:
    """Each pair once from either side: scan_id, doc_id, other_id, other_name, score."""
    one = F.struct(F.col("a").alias("doc_id"), F.col("b").alias("other_id"), F.col("name_b").alias("other_name"))
    two = F.struct(F.col("b").alias("doc_id"), F.col("a").alias("other_id"), F.col("name_a").alias("other_name"))
    return pairs.select("scan_id", "score", F.explode(F.array(one, two)).alias("s")).select("scan_id", "s.doc_id", "s.other_id", "s.other_name", "score")


def exact_neighbours(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, doc_id of documents with a duplicate: another stored document of equal hash, or an exact pair with one."""
    found = None
    for h in ("sha", "norm_hash"):
        known = docs.where(F.col(h).isNotNull() & (F.col(h) != ""))
        many = known.groupBy("scan_id", h).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        part = known.join(many, ["scan_id", h]).select("scan_id", "doc_id")
        found = part if found is None else found.unionByName(part)
    exact = sides(pairs.where((F.col("score") >= EXACT) & (F.col("a") != F.col("b"))))
    ids = docs.select("scan_id", "doc_id")
    linked = exact.join(ids, ["scan_id", "doc_id"], "left_semi").join(ids.withColumnRenamed("doc_id", "other_id"), ["scan_id", "other_id"], "left_semi").select("scan_id", "doc_id")
    return found.unionByName(linked).distinct()


def document_averages(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every stored document with is_duplicate, average and max_similarity in percent (null without comparisons),
    comparisons and its classification. Exact pairs do not count as comparisons. Scores are summed as decimals, so the
    average does not depend on their order."""
    stats = sides(pairs.where(F.col("score") < EXACT)).groupBy("scan_id", "doc_id").agg(F.sum(F.col("score").cast("decimal(18,8)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n"), F.max("score").alias("m"))
    dup = exact_neighbours(docs, pairs).withColumn("d", F.lit(True))
    out = docs.join(stats, ["scan_id", "doc_id"], "left").join(dup, ["scan_id", "doc_id"], "left")
    average = rounded(F.col("s") / F.col("n") * 100, 2)
    out = out.select("scan_id", "doc_id", "filename", "file_type", "file_size", F.coalesce("d", F.lit(False)).alias("is_duplicate"), average.alias("average"), rounded(F.col("m") * 100, 2).alias("max_similarity"), F.coalesce("n", F.lit(0)).cast("long").alias("comparisons"))
    return out.withColumn("class", classification(F.col("average")))


def duplicate_files(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    return docs.join(exact_neighbours(docs, pairs), ["scan_id", "doc_id"], "left_semi").select("scan_id", "doc_id", "filename", "file_type", F.coalesce("file_size", F.lit(0)).alias("file_size"))


def dashboard_order(sort: str) -> list[Column]:
    """Sort columns of the dashboard: averages with nulls last either way, names in locale order, then the id."""
    name = F.expr("coalesce(filename, '') collate UNICODE")
    by = {"avg_asc": [F.asc_nulls_last("average"), name.asc()], "name_asc": [name.asc()], "name_desc": [name.desc()]}
    return [*by.get(sort, [F.desc_nulls_last("average"), name.asc()]), F.asc("doc_id")]


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 24, most: int = 200) -> DataFrame:
    """One page of each scan's rows with rank, total_rows and total_pages; number and limit are clamped to their ranges."""
    number, limit = max(1, int(number or 1)), min(most, max(1, int(limit or 24)))
    totals = df.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_rows"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy(*order)))
    shown = ranked.where((F.col("rank") <= number * limit) & (F.col("rank") > (number - 1) * limit))
    return shown.join(totals, "scan_id").withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / limit)).cast("long"))


def search_documents(df: DataFrame, query: str = "") -> DataFrame:
    return df.where(contains_literal(F.col("filename"), query))


def search_pairs(pairs: DataFrame, query: str = "") -> DataFrame:
    return pairs.where(contains_literal(F.col("name_a"), query) | contains_literal(F.col("name_b"), query))


def pair_filter(content: str = "all", category: str = "all", low: object = None, high: object = None) -> Column:
    """Condition on stored pairs: content (exact, text, images, code, tables), score category (exact, high, moderate, low)
    and a range in percent or 0..1. All given parts must hold; a bound that is no number is ignored."""
    kinds = {"exact": F.col("score") >= EXACT, "text": F.col("n_passages") > 0, "images": F.col("n_images") > 0, "code": F.col("n_code") > 0, "tables": F.col("n_tables") > 0}
    kinds |= {"image": kinds["images"], "table": kinds["tables"]}
    bands = {"exact": kinds["exact"], "high": (F.col("score") >= 0.70) & (F.col("score") < EXACT), "moderate": (F.col("score") >= 0.40) & (F.col("score") < 0.70), "low": F.col("score") < 0.40}
    out = kinds.get(content, F.lit(True)) & bands.get(category, kinds.get(category, F.lit(True)))
    for bound, at_least in ((low, True), (high, False)):
        value = _bound(bound)
        if value is not None:
            out = out & ((F.col("score") >= value) if at_least else (F.col("score") <= value))
    return out


def _bound(x: object) -> float | None:
    try:
        v = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    if v != v:
        return None
    v = max(0.0, min(100.0, v))
    return round(v / 100 if v > 1.001 else v, 4)


def pair_order(sort: str = "similarity_desc") -> list[Column]:
    """Sort columns of pairs; ties end at the ids, so pages are stable."""
    names, ids = [F.asc_nulls_first("name_a"), F.asc_nulls_first("name_b")], [F.asc("a"), F.asc("b")]
    score = F.desc_nulls_last("score")
    by = {"similarity_asc": [F.asc_nulls_first("score"), *names], "name_asc": [*names, score], "name_desc": [F.desc_nulls_last("name_a"), F.desc_nulls_last("name_b"), score], "filename_1": names[:1], "filename_2": names[1:]}
    return [*by.get(sort, [score, *names]), *ids]


def evidence_summary(pairs: DataFrame) -> DataFrame:
    """Pairs with percentage, is_exact, class, counts of evidence and the kinds of it, 'text' where there is none."""
    pct = rounded(F.col("score") * 100, 2)
    kinds = F.array_join(F.filter(F.array(*[F.when(F.col(f"n_{c}") > 0, F.lit(k)) for c, k in (("passages", "text"), ("images", "images"), ("code", "code"), ("tables", "tables"))]), lambda x: x.isNotNull()), ",")
    exact = is_exact_score(F.col("score"))
    return pairs.withColumn("percentage", pct).withColumn("is_exact", exact).withColumn("class", F.when(exact, "Exact Duplicate").otherwise(classification(pct))).withColumn("kinds", F.when(kinds == "", "text").otherwise(kinds))


def score_categories(pairs: DataFrame) -> DataFrame:
    """For each scan the pairs in each score category."""
    one = lambda c: F.count_if(F.coalesce(pair_filter(category=c), F.lit(False)))
    return pairs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("pairs"), *[one(c).alias(c) for c in ("exact", "high", "moderate", "low")])


def report_summary(averages: DataFrame) -> DataFrame:
    """For each scan: documents, duplicates, documents with comparisons, and the mean, highest and lowest average."""
    mean = rounded(F.sum(F.col("average").cast("decimal(18,2)")).cast("double") / F.count("average"), 2)
    return averages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if("is_duplicate").alias("duplicate_files"), F.count("average").alias("files_with_similarity"), mean.alias("overall_average"), F.max("average").alias("highest_average"), F.min("average").alias("lowest_average"))


def document_similarities(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every comparison of every stored document, from its own side, exact pairs left out."""
    own = sides(pairs.where(F.col("score") < EXACT))
    return own.join(docs.select("scan_id", "doc_id"), ["scan_id", "doc_id"], "left_semi").withColumn("percentage", rounded(F.col("score") * 100, 2))


def document_view_averages(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, doc_id, comparisons and average: of the percentages as shown, so it can differ by .01 from the dashboard's."""
    shown = document_similarities(docs, pairs).where("percentage is not null").groupBy("scan_id", "doc_id")
    return shown.agg(F.count(F.lit(1)).alias("comparisons"), rounded(F.sum(F.col("percentage").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 2).alias("average"))


def lookup(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored pairs for wanted (scan_id, x, y) in either orientation; a pair of equal ids finds nothing."""
    ask = wanted.select("scan_id", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo <> hi").distinct()
    return pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(ask, ["scan_id", "lo", "hi"], "left_semi").drop("lo", "hi")


def history(scans: DataFrame, docs: DataFrame, pairs: DataFrame, most: int = 100) -> DataFrame:
    """The newest completed scans with two names that stand for them and their best score in percent.

    Names: of the best pair for more than two documents, else of the documents in order of id.
    """
    done = scans.where("status = 'completed'").select(tidy("scanId").alias("scan_id"), "createdAt", F.coalesce("completedAt", "createdAt").alias("finished_at")).orderBy(F.desc_nulls_last("createdAt"), "scan_id").limit(most)
    names = docs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "filename")).alias("first"), F.max(F.struct("doc_id", "filename")).alias("last"))
    best = pairs.where("score is not null").groupBy("scan_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b", "name_a", "name_b")).alias("p"))
    out = done.join(names, "scan_id", "left").join(best, "scan_id", "left")
    one = F.when(F.col("n").isNull(), "No documents").when((F.col("n") > 2) & F.col("p").isNotNull(), F.col("p.name_a")).otherwise(F.col("first.filename"))
    two = F.when(F.col("n").isNull(), "No documents").when(F.col("n") == 1, "None (Single Document)").when((F.col("n") > 2) & F.col("p").isNotNull(), F.col("p.name_b")).otherwise(F.col("last.filename"))
    return out.select("scan_id", one.alias("file_name_1"), two.alias("file_name_2"), F.coalesce(rounded(-F.col("p.s") * 100, 2), F.lit(0.0)).alias("similarity"), "finished_at")


def progress(scans: DataFrame) -> DataFrame:
    """scan_id, status, percentage: completed comparisons of the candidate pairs, or of all possible ones where there are
    none, to one decimal; 100 for completed scans."""
    of = F.when(F.col("candidatePairs") > 0, F.col("candidatePairs")).when(F.col("totalPossiblePairs") > 0, F.col("totalPossiblePairs")).otherwise(1)
    share = rounded(F.coalesce("completedComparisons", F.lit(0)) / of * 100, 1)
    return scans.select(tidy("scanId").alias("scan_id"), "status", F.when(F.col("status") == "completed", 100.0).otherwise(share).alias("percentage"))


def scan_summary(docs: DataFrame, pairs: DataFrame, high: float = 0.80) -> DataFrame:
    """For each scan: documents, possible pairs, scored pairs, exact (>= .999) and high pairs, reduction in percent."""
    d = docs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("documents"))
    p = pairs.groupBy("scan_id").agg(F.count("score").alias("scored_pairs"), F.count_if(F.col("score") >= 0.999).alias("exact_pairs"), F.count_if(F.col("score") >= high).alias("high_pairs"))
    out = d.join(p, "scan_id", "left").na.fill(0, ["scored_pairs", "exact_pairs", "high_pairs"]).withColumn("possible_pairs", (F.col("documents") * (F.col("documents") - 1) / 2).cast("long"))
    cut = F.when(F.col("possible_pairs") > 0, rounded((F.col("possible_pairs") - F.col("scored_pairs")) / F.col("possible_pairs") * 100, 2)).otherwise(0.0)
    return out.withColumn("reduction_percent", cut)


def highlighted_passages(results: DataFrame) -> DataFrame:
    """scan_id, a, b, passage_no (from 1), match_type, similarity and the HTML of both passages, words marked."""
    from affinis.functions.text import highlighted

    rows = results.select(tidy("scanId").alias("scan_id"), tidy("documentAId").alias("a"), tidy("documentBId").alias("b"), F.posexplode("matchingPassages").alias("i", "m"))
    return rows.select("scan_id", "a", "b", (F.col("i") + 1).alias("passage_no"), F.coalesce("m.matchType", F.lit("partial")).alias("match_type"), F.coalesce("m.similarity", F.lit(0.0)).alias("similarity"), highlighted(F.col("m.passageA"), F.col("m.matchedWords")).alias("html_a"), highlighted(F.col("m.passageB"), F.col("m.matchedWords")).alias("html_b"))
