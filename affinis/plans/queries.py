"""Queries over the test tables, one for each group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from affinis.config import DEFAULT, SimilarityConfig
from affinis.functions import code, hashing, images, passages, scoring, tables, text
from affinis.operators import candidates as C
from affinis.operators import image_pairs, multimodal, results
from affinis.plans import pipeline
from affinis.runtime import broadcast_if, spread, stage, table
from affinis.sources import readers, sinks

THRESHOLD = 0.5


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _features(s: SparkSession, d: str) -> DataFrame:
    return stage(C.features(_docs(s, d)), "features")


def _shingled(s: SparkSession, d: str) -> DataFrame:
    t = spread(_docs(s, d).select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", text.shingles(F.col("t")).alias("shingles"))


def _stored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return results.stored_documents(table(s, d, "scan_documents")), results.stored_pairs(table(s, d, "similarity_results"))


def _kept(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored records staged, for queries that read them several times."""
    docs, pairs = _stored(s, d)
    return stage(docs, "stored-documents"), stage(pairs, "stored-pairs")


# ---- text


def tokenize_stats(s: SparkSession, d: str) -> DataFrame:
    t = spread(_docs(s, d).select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def text_statistics(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.length("text").cast("long").alias("n_chars"), text.white_space_tokens(F.col("text")).cast("long").alias("n_pieces"), F.size(text.sentence_tokens(F.col("text"))).cast("long").alias("n_long_tokens"))


def normalized_hashes(s: SparkSession, d: str) -> DataFrame:
    return spread(_docs(s, d)).select("doc_id", F.sha2("text", 256).alias("sha"), text.normalized_hash(F.col("text")).alias("norm_hash"))


def shingle_counts(s: SparkSession, d: str) -> DataFrame:
    t = spread(_docs(s, d).select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size(text.shingles(F.col("t"), 5)).cast("long").alias("k5"), F.size(text.shingles(F.col("t"), 3, False)).cast("long").alias("k3"))


def fnv_hashes(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("filename is not null").select("doc_id", hashing.fnv1a32(F.col("filename")).alias("fnv"))


def html_escaped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("eval_id", text.html_escaped(F.col("text")).alias("html"))


def safe_filenames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scan_documents").select("documentId", text.safe_filename(F.col("filename")).alias("safe"), text.printable(F.col("filename")).alias("shown"))


def cell_values(s: SparkSession, d: str) -> DataFrame:
    """Canonical cells of a table of numbers and names."""
    p = table(s, d, "part")
    cells = p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in ("p_name", "p_retailprice", "p_size")])).alias("e"))
    return cells.select("p_partkey", F.col("e.name").alias("name"), text.cell_value(F.col("e.v")).alias("value"))


def sentence_segments(s: SparkSession, d: str) -> DataFrame:
    found = spread(_docs(s, d).select("doc_id", "text")).select("doc_id", F.posexplode(passages.sentences(F.col("text"))).alias("i", "s"))
    return found.select("doc_id", F.col("i").alias("sentence_no"), "s.offset", "s.page", F.col("s.text").alias("sentence"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no and line of every line of the documents that is not blank."""
    lines = spread(_docs(s, d).select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(r"\S")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def sentence_overlap(s: SparkSession, d: str) -> DataFrame:
    """Overlap of each line of a document with the next one that is not blank."""
    t = _lines(s, d).select("doc_id", "line_no", text.sentence_tokens(F.col("line")).alias("x"))
    both = t.withColumn("y", F.lead("x").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("y is not null")
    o = both.select("doc_id", "line_no", passages.overlap_scores(F.col("x"), F.col("y")).alias("o"))
    return o.select("doc_id", "line_no", F.col("o.score").alias("score"), F.col("o.shared").alias("shared"))


def boilerplate_lines(s: SparkSession, d: str) -> DataFrame:
    """Every line of the documents that is not blank, by its number: a generic heading, without a content word, or neither."""
    return _lines(s, d).select("doc_id", "line_no", text.is_boilerplate(F.trim("line")).alias("generic"))


# ---- fingerprints, candidates, set similarity


def minhash_signatures(s: SparkSession, d: str) -> DataFrame:
    f = _shingled(s, d).select("doc_id", F.posexplode(hashing.minhash(F.col("shingles"))).alias("i", "value"))
    return f.select("doc_id", F.col("i").cast("long").alias("i"), "value")


def fingerprints(s: SparkSession, d: str) -> DataFrame:
    f = stage(C.fingerprint_source(table(s, d, "fingerprint_requests")), "requests").withColumn("sig", hashing.minhash(F.col("shingles")))
    return f.select("request_id", F.size("shingles").cast("long").alias("n_shingles"), F.posexplode("sig").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


def lsh_candidates(s: SparkSession, d: str) -> DataFrame:
    f = stage(stage(_shingled(s, d), "shingles").select("doc_id", C.set_key(F.col("shingles")).alias("set_key"), hashing.minhash(F.col("shingles")).alias("sig")), "signatures")
    return C.lsh_pairs(f, "doc_id").distinct()


def candidate_pairs(s: SparkSession, d: str) -> DataFrame:
    return C.candidates(_features(s, d), "doc_id")


def candidate_stats(s: SparkSession, d: str) -> DataFrame:
    f = _features(s, d)
    return C.candidate_stats(f, C.candidates(f, "doc_id"))


def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    return C.jaccard_pairs(_shingled(s, d), "doc_id", "shingles", THRESHOLD)


def containment_pairs(s: SparkSession, d: str) -> DataFrame:
    f = _features(s, d)
    return C.set_scores(C.candidates(f, "doc_id"), f, "doc_id").select("a", "b", "is_exact", "shared", "jaccard", "containment")


def minhash_estimates(s: SparkSession, d: str) -> DataFrame:
    f = _features(s, d)
    return C.estimates(C.candidates(f, "doc_id").select("a", "b"), f.select("doc_id", "sig"), "doc_id")


def lsh_recall(s: SparkSession, d: str) -> DataFrame:
    f = _features(s, d)
    return C.recall(C.candidates(f, "doc_id"), C.jaccard_pairs(f, "doc_id", "shingles", THRESHOLD), THRESHOLD)


def candidate_probability_curve(s: SparkSession, d: str) -> DataFrame:
    grid = s.range(0, 21).select((F.col("id") / 20.0).alias("similarity"))
    return grid.select("similarity", hashing.candidate_probability(F.col("similarity"), DEFAULT.bands, DEFAULT.rows).alias("probability"))


def ranked_pairs(s: SparkSession, d: str) -> DataFrame:
    """The 20 most similar pairs of documents, ranked."""
    top = jaccard_pairs(s, d).orderBy(F.desc("jaccard"), "a", "b").limit(20)
    ranked = top.select("a", "b", "jaccard", text.rounded(F.col("jaccard") * 100, 2).alias("percentage"))
    return ranked.withColumn("class", F.when(text.is_exact_score(F.col("jaccard")), "Exact Duplicate").otherwise(text.classification(F.col("percentage"))))


# ---- the scan


def matching_passages(s: SparkSession, d: str) -> DataFrame:
    p = pipeline.scan(_docs(s, d)).select("a", "b", F.posexplode("passages").alias("i", "m"))
    return p.select("a", "b", F.col("i").alias("passage_no"), "m.similarity", "m.matchType", "m.offsetA", "m.offsetB", "m.passageA", "m.passageB")


def passage_coverage(s: SparkSession, d: str) -> DataFrame:
    return pipeline.scan(_docs(s, d)).select("a", "b", "coverage_a", "coverage_b", "max_coverage", "avg_coverage")


def scan_scores(s: SparkSession, d: str) -> DataFrame:
    return pipeline.scan(_docs(s, d)).select("a", "b", "is_exact", "jaccard", "containment", "estimate", "text_score", "score", "percentage")


def text_only_scores(s: SparkSession, d: str) -> DataFrame:
    return pipeline.scan(_docs(s, d), text_only=True).select("a", "b", "is_exact", "score", "percentage")


def level1_scores(s: SparkSession, d: str) -> DataFrame:
    """The plain scan: every two documents whose sets of three-word shingles are alike by 0.2 or more, by exact comparison."""
    got = pipeline.scan(_docs(s, d), config=SimilarityConfig(shingle_size=3), method="exact", text_only=True, least=0.2)
    return got.select("a", "b", "is_exact", "score", "percentage")


def multimodal_scores(s: SparkSession, d: str) -> DataFrame:
    """Pairs of documents alike in text or images: the latest delivered item of each, its images and code."""
    seen = table(s, d, "images")
    items = table(s, d, "document_items").where("documentId is not null").groupBy("documentId").agg(F.max_by("text", "item_id").alias("text"))
    items = stage(multimodal.documents(seen, items), "items")
    pairs = multimodal.candidates(seen, C.features(items, "documentId"))
    got = multimodal.compare(stage(pairs, "pairs"), multimodal.contents(seen, items), "documentId")
    return got.select("a", "b", "score", "percentage", "is_exact", "image_similarity", "code_similarity", "table_similarity")


def fused_scores(s: SparkSession, d: str) -> DataFrame:
    """Stored scores fused with counts of evidence; the evidence's own similarity is taken as the stored score."""
    docs, pairs = _stored(s, d)
    n = docs.select("scan_id", "doc_id", F.coalesce("token_count", F.lit(0)).alias("n"))
    wide = pairs.join(n.select("scan_id", F.col("doc_id").alias("a"), F.col("n").alias("na")), ["scan_id", "a"]).join(n.select("scan_id", F.col("doc_id").alias("b"), F.col("n").alias("nb")), ["scan_id", "b"])
    c = F.col
    has = lambda k: F.when(c(k) > 0, 0.8).otherwise(0.0)
    o = scoring.overall_score(c("score") >= 0.99995, c("score"), (c("na"), c("nb")), has("n_images"), (c("n_images"), c("n_images")), has("n_code"), (c("n_code") * 20, c("n_code") * 20), has("n_tables"), (c("n_tables") * 6, c("n_tables") * 6), c("n_images") > c("n_code"))
    return wide.withColumn("o", o).select("scan_id", "a", "b", F.col("o.score").alias("fused"), F.col("o.percentage").alias("percentage"), F.col("o.is_exact").alias("is_exact"))


def code_detection(s: SparkSession, d: str) -> DataFrame:
    c = spread(_docs(s, d).select("doc_id", "text")).select("doc_id", code.detection(F.col("text")).alias("c"))
    return c.select("doc_id", F.col("c.is_code").alias("is_code"), F.col("c.confidence").alias("confidence"), F.col("c.keywords").alias("keywords"))


def code_similarity(s: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of documents compared as code, whole texts."""
    pairs = stage(C.candidates(_features(s, d), "doc_id").select("a", "b"), "code-pairs")
    t = _docs(s, d)
    both = pairs.join(t.select(F.col("doc_id").alias("a"), F.col("text").alias("t1")), "a").join(t.select(F.col("doc_id").alias("b"), F.col("text").alias("t2")), "b")
    c = both.select("a", "b", code.comparison(F.col("t1"), F.col("t2")).alias("c"))
    return c.select("a", "b", F.col("c.similarity").alias("similarity"), F.col("c.tokens_a").alias("tokens_a"), F.col("c.tokens_b").alias("tokens_b"))


def table_similarity(s: SparkSession, d: str) -> DataFrame:
    """Each region's nations as a table of names and keys, compared with every other region's."""
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.col("n_nationkey").cast("string"), F.substring("n_name", 1, 1)))).alias("rows"))
    t = n.select("n_regionkey", F.struct(F.lit(1).alias("tableIndex"), F.size("rows").alias("rowCount"), F.lit(2).alias("colCount"), "rows").alias("t"))
    a, b = t.select(F.col("n_regionkey").alias("a"), F.col("t").alias("ta")), t.select(F.col("n_regionkey").alias("b"), F.col("t").alias("tb"))
    c = a.join(broadcast_if(b, 1000), F.col("a") < F.col("b")).select("a", "b", tables.comparison(F.col("ta"), F.col("tb")).alias("c"))
    return c.select("a", "b", F.col("c.similarity").alias("similarity"), F.col("c.matching_cells").cast("long").alias("matching_cells"), F.size("c.matching_rows").cast("long").alias("matching_rows"))


# ---- images and pages


def image_candidates(s: SparkSession, d: str) -> DataFrame:
    return image_pairs.close_hashes(table(s, d, "images"))


def planted_image_candidates(s: SparkSession, d: str) -> DataFrame:
    """Close hashes among the images and altered copies of them in other documents: 3, 8, 12 and 13 bits flipped, by turns."""
    i = table(s, d, "images").where(F.col("dhash").rlike("^[0-9a-fA-F]{16}$")).select("dhash", "documentId")
    turn = F.conv(F.substring("dhash", 1, 1), 16, 10).cast("int") % 4
    flips = F.array(*[F.lit(int(m, 16)) for m in ("0421", "0F33", "0FFF", "1FFF")])
    tail = F.lower(F.lpad(F.hex(F.conv(F.substring("dhash", 13, 4), 16, 10).cast("long").bitwiseXOR(F.element_at(flips, turn + 1).cast("long"))), 4, "0"))
    return image_pairs.close_hashes(i.unionByName(i.select(F.concat(F.substring("dhash", 1, 12), tail).alias("dhash"), F.concat("documentId", F.lit("-planted")).alias("documentId"))))


def image_copies(s: SparkSession, d: str) -> DataFrame:
    return image_pairs.same_content(table(s, d, "images"))


def ocr_gating(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "images")
    return i.select("imageId", images.wants_recognition(F.lit(".pdf"), F.col("width"), F.col("height")).alias("wanted"), images.adds_text(text.ocr_text(F.col("ocrText")), F.lit(None).cast("string")).alias("added"), F.length(text.ocr_text(F.col("ocrText"))).cast("long").alias("n_chars"))


def scanned_files(s: SparkSession, d: str) -> DataFrame:
    return readers.scanned_flags(table(s, d, "pages"), table(s, d, "images"))


# ---- stored results


def latest_documents(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d)[0]


def stored_results(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d)[1]


def document_averages(s: SparkSession, d: str) -> DataFrame:
    return results.document_averages(*_kept(s, d))


def duplicate_files(s: SparkSession, d: str) -> DataFrame:
    return results.duplicate_files(*_kept(s, d))


def dashboard_page(s: SparkSession, d: str) -> DataFrame:
    """The first page of every scan's dashboard, names in locale order."""
    rows = results.page(results.document_averages(*_kept(s, d)), results.dashboard_order("avg_desc"), 1, 24)
    return rows.select("scan_id", "rank", "doc_id", "filename", "average", "comparisons", "class", "total_rows", "total_pages")


def ranked_results(s: SparkSession, d: str) -> DataFrame:
    """The second page of every scan's pairs, 20 a page."""
    rows = results.page(results.evidence_summary(_stored(s, d)[1]), results.pair_order(), 2, 20)
    return rows.select("scan_id", "rank", "a", "b", "score", "percentage", "is_exact", "class", "kinds", "total_rows", "total_pages")


def filtered_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs with passages, scored 40 to 95 percent, with 'lab' in a file name."""
    p = results.search_pairs(_stored(s, d)[1].where(results.pair_filter("text", low=40, high=95)), "LAB")
    return p.select("scan_id", "a", "b", "name_a", "name_b", "score")


def score_categories(s: SparkSession, d: str) -> DataFrame:
    return results.score_categories(_stored(s, d)[1])


def evidence_summary(s: SparkSession, d: str) -> DataFrame:
    return results.evidence_summary(_stored(s, d)[1]).select("scan_id", "a", "b", "n_passages", "n_images", "n_code", "n_tables", "kinds", "percentage", "is_exact", "class")


def report_summary(s: SparkSession, d: str) -> DataFrame:
    return results.report_summary(results.document_averages(*_kept(s, d)))


def report_top_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = results.page(results.evidence_summary(_stored(s, d)[1]), results.pair_order(), 1, 30)
    return rows.select("scan_id", "rank", "a", "b", "percentage", "class")


def document_similarities(s: SparkSession, d: str) -> DataFrame:
    return results.document_similarities(*_stored(s, d)).select("scan_id", "doc_id", "other_id", "other_name", "percentage")


def document_view_averages(s: SparkSession, d: str) -> DataFrame:
    """Comparisons of each stored document and the average of their rounded percentages, as its own page shows them."""
    return results.document_view_averages(*_stored(s, d))


def pair_lookup(s: SparkSession, d: str) -> DataFrame:
    """Pairs found by asking for each stored pair the other way round."""
    pairs = _stored(s, d)[1]
    return results.lookup(pairs, pairs.select("scan_id", F.col("b").alias("x"), F.col("a").alias("y"))).select("scan_id", "a", "b", "score")


def highlighted_passages(s: SparkSession, d: str) -> DataFrame:
    return results.highlighted_passages(table(s, d, "similarity_results"))


def history(s: SparkSession, d: str) -> DataFrame:
    docs, pairs = _stored(s, d)
    return results.history(table(s, d, "scans"), docs, pairs)


def scan_progress(s: SparkSession, d: str) -> DataFrame:
    return results.progress(table(s, d, "scans"))


def scan_summary(s: SparkSession, d: str) -> DataFrame:
    return results.scan_summary(*_stored(s, d))


def recent_scans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scans").select("scanId", "status", "createdAt").orderBy(F.desc_nulls_last("createdAt"), "scanId").limit(50)


def stored_counts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "scan_documents").where("scanId is not null")
    return t.groupBy("scanId").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("documentId").alias("documents"), F.count("minhashSignature").alias("signed"), F.count_if(F.size("minhashSignature") >= 128).alias("signed_whole"))


def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    """Results of the second half of 2025 that are new to the results of the first half."""
    r = table(s, d, "similarity_results").select("scanId", "documentAId", "documentBId", "createdAt")
    new = sinks.absent_rows(r.where(F.col("createdAt") >= F.lit("2025-07-01").cast("timestamp_ntz")), r.where(F.col("createdAt") < F.lit("2025-07-01").cast("timestamp_ntz")))
    return new.select("scanId", "documentAId", "documentBId", "createdAt")


def upload_selection(s: SparkSession, d: str) -> DataFrame:
    return sinks.upload_selection(table(s, d, "scan_documents")).select("filename", "fileSize", "documentId", "uploads")


_NAMES = (
    "tokenize_stats text_statistics normalized_hashes shingle_counts fnv_hashes html_escaped safe_filenames cell_values sentence_segments sentence_overlap boilerplate_lines "
    "minhash_signatures fingerprints lsh_candidates candidate_pairs candidate_stats jaccard_pairs containment_pairs minhash_estimates lsh_recall candidate_probability_curve ranked_pairs "
    "matching_passages passage_coverage scan_scores text_only_scores level1_scores multimodal_scores fused_scores code_detection code_similarity table_similarity image_candidates planted_image_candidates image_copies ocr_gating scanned_files "
    "latest_documents stored_results document_averages duplicate_files dashboard_page ranked_results filtered_pairs score_categories evidence_summary report_summary report_top_pairs "
    "document_similarities document_view_averages pair_lookup highlighted_passages history scan_progress scan_summary recent_scans stored_counts insert_if_absent upload_selection"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES.split()}
