"""One score for a pair of documents from everything they contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.config import DEFAULT, SimilarityConfig
from affinis.functions import code, images, scoring, tables, text
from affinis.operators import candidates as C
from affinis.operators import image_pairs, set_pairs
from affinis.runtime import stage

#: Columns of a document's content, with an empty value for each.
CONTENT = {
    "sha": "string",
    "text": "string",
    "images": "array<struct<imageId:string,sha256:string,dhash:string>>",
    "tables": "array<struct<tableIndex:int,rowCount:int,colCount:int,rows:array<array<string>>>>",
    "code": "array<struct<code:string,isFromOcr:boolean>>",
}

#: Two tables found alike, as tables.best_of lists them.
MATCHES = "array<struct<tableAIndex:int,tableBIndex:int,similarity:double>>"


def contents(images_table: DataFrame, texts: DataFrame, ident: str = "documentId", body: str = "text", sha: str | None = None) -> DataFrame:
    """ident and CONTENT of documents: their text and images, tables where texts has a column of them, and as code their
    text and the texts recognised in their images, each where it is code.

    A text that is code counts in both masses. A document's images are a bounded list: its own.
    """
    c = F.col
    kept = [n for n in ("imageId", "sha256", "dhash")]
    read = c("ocrText") if "ocrText" in images_table.columns else F.lit(None).cast("string")
    seen = images_table.where("documentId is not null").select(c("documentId").alias(ident), *kept, F.when(code.detection(read).is_code, read).alias("_read"))
    snippets = F.transform(F.array_sort(F.collect_list("_read")), lambda x: F.struct(x.alias("code"), F.lit(True).alias("isFromOcr")))
    own = seen.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("images"), snippets.alias("_snippets"))
    native = F.when(code.detection(c(body)).is_code, F.array(F.struct(c(body).alias("code"), F.lit(False).alias("isFromOcr"))))
    found = c("tables") if "tables" in texts.columns else F.lit(None)
    base = texts.where(c(ident).isNotNull()).select(ident, (c(sha) if sha else F.lit(None).cast("string")).alias("sha"), c(body).alias("text"), found.cast(CONTENT["tables"]).alias("tables"), native.cast(CONTENT["code"]).alias("_native"))
    none = F.array().cast(CONTENT["code"])
    whole = F.concat(F.coalesce("_native", none), F.coalesce(c("_snippets").cast(CONTENT["code"]), none))
    return base.join(own, ident, "left").select(ident, "sha", "text", "images", "tables", whole.alias("code"))


def documents(images_table: DataFrame, texts: DataFrame, ident: str = "documentId") -> DataFrame:
    """texts with a further row, its other columns null, for every document that has images only."""
    own = images_table.where("documentId is not null").select(F.col("documentId").alias(ident)).distinct()
    return texts.where(F.col(ident).isNotNull()).join(own, ident, "full")


def candidates(images_table: DataFrame, feats: DataFrame, ident: str = "documentId", config: SimilarityConfig = DEFAULT, least: float | None = None) -> DataFrame:
    """(a, b, text_score) of every two documents whose texts or images are alike; the score is that of their sets, 1 for
    equal hashes.

    Texts are alike that are equal, whose sets have a similarity of least or above, config.estimate_floor if not given, or
    that share a band below it. Copies are no stand-ins for each other, since their images may differ.
    """
    least = config.estimate_floor if least is None else least
    # sets travel as 64-bit hashes and documents as numbers; whatever the plan reads several times is made once
    hashed = F.transform("shingles", lambda x: F.xxhash64(x))
    known = stage(feats.select(F.monotonically_increasing_id().alias("n"), ident, "norm_hash", "sig", hashed.alias("vals")), "multimodal-sets")
    # equal bytes are equal canonical texts
    exact = C.pairs_in_buckets(known.where("norm_hash is not null").select("n", "norm_hash"), ["norm_hash"], "n").withColumn("how", F.lit(2))
    bands = C.band_rows(known, "n", config).select("n", F.xxhash64("band", "key").alias("k"))
    near = C.pairs_in_buckets(bands, ["k"], "n").withColumn("how", F.lit(1))
    close = set_pairs.overlapping(known, "n", "vals", least).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0).alias("how"))
    numbered = exact.unionByName(near).unionByName(close).groupBy("a", "b").agg(F.max("how").alias("how"))
    name = lambda s: known.select(F.col("n").alias(s), F.col(ident).alias(f"_{s}"))
    texts = numbered.join(name("a"), "a").join(name("b"), "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "how")
    seen = image_pairs.document_pairs(images_table).withColumn("how", F.lit(1))
    pairs = texts.unionByName(seen).groupBy("a", "b").agg(F.max("how").alias("how"))
    scored = C.set_scores(stage(pairs, "multimodal-pairs"), known, ident, "vals")
    # close only by the hashes of 32 bits, unless their sets say so
    scored = scored.where((F.col("how") > 0) | (F.col("jaccard") >= F.lit(float(least)) - 1e-9))
    return scored.select("a", "b", F.when(F.col("how") == 2, 1.0).otherwise(F.col("jaccard")).alias("text_score"))


def sides(content: DataFrame, ident: str) -> DataFrame:
    """What `compare` needs of each document, made once: a document meets many others, and its texts are of no further use
    than as keys, counts and normalised code."""
    c = F.col
    none = {k: F.array().cast(t) for k, t in CONTENT.items() if t.startswith("array")}
    whole = content.select(c(ident).alias("id"), "sha", F.coalesce("text", F.lit("")).alias("_text"), *[F.coalesce(k, v).alias(k) for k, v in none.items()])
    cells = F.aggregate(F.transform("tables", lambda x: x.rowCount * x.colCount), F.lit(0), lambda x, y: x + y)
    snippets = F.array_join(F.transform("code", lambda x: x.code), "\n")
    ocr = F.exists("code", lambda x: F.coalesce(x.isFromOcr, F.lit(False)))
    words = F.when(c("_text") != "", text.white_space_tokens(c("_text"))).otherwise(0)
    plain = whole.select("id", "sha", text.normalized(c("_text")).alias("_norm"), F.array_join(text.tokens(c("_text")), " ").alias("_toks"), words.alias("words"), images.keyed(c("images")).alias("images"), "tables", cells.alias("cells"), snippets.alias("_code"), ocr.alias("ocr"))
    key = lambda k: F.when(c(k) != "", F.unhex(F.sha2(k, 256)))
    lines = F.when(c("_code") != "", code.normalized_lines(c("_code"))).otherwise(F.array().cast("array<string>"))
    names = F.when(c("_code") != "", F.size(F.regexp_extract_all("_code", F.lit(r"\w+"), F.lit(0)))).otherwise(0)
    lined = plain.select("id", "sha", key("_norm").alias("norm"), key("_toks").alias("toks"), "words", "images", "tables", "cells", "ocr", names.alias("names"), lines.alias("lines"))
    tokens = F.array_distinct(code.code_tokens(c("lines"))), F.array_distinct(code.code_tokens(c("lines"), True))
    return stage(lined.select("*", tokens[0].alias("code"), tokens[1].alias("shapes")), "multimodal-sides")


def compare(pairs: DataFrame, content: DataFrame, ident: str) -> DataFrame:
    """pairs (a, b, text_score) with score, percentage, is_exact and the evidence of images, tables and code.

    Equal file hashes, and canonically equal texts of documents without images and tables, are exact. Canonically equal
    texts otherwise count as text similarity 1. Null and empty parts have no mass.
    """
    c = F.col
    known = sides(content, ident)
    side = lambda s: known.select(*[c(k).alias(s if k == "id" else f"{k}_{s}") for k in known.columns])
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    both = lambda k: (c(f"{k}_a"), c(f"{k}_b"))
    equal = lambda k: F.coalesce(c(f"{k}_a") == c(f"{k}_b"), F.lit(False))
    same_text = c("norm_a").isNotNull() & c("norm_b").isNotNull() & (equal("norm") | equal("toks"))
    others = (F.size("images_a") + F.size("images_b") + F.size("tables_a") + F.size("tables_b")) > 0
    exact = equal("sha") | (same_text & ~others)
    tabled, coded = (F.size("tables_a") > 0) & (F.size("tables_b") > 0), (F.size("code_a") > 0) & (F.size("code_b") > 0)
    wide = wide.withColumn("image_matches", images.matches(*both("images"))).withColumn("t", F.when(tabled, tables.best_of(*both("tables")))).withColumn("_score", F.when(coded, code.score_of(*both("code"), *both("shapes"))))
    evidence = wide.withColumns({
        "image_similarity": images.best_of(c("image_matches")),
        "code_similarity": F.when(coded, code.similarity_of(*both("code"), c("_score"))).otherwise(0.0),
        "code_lines": F.when(coded, code.matching_lines(*both("lines"), *both("code"), c("_score"))).otherwise(F.array().cast("array<string>")),
        "table_similarity": F.coalesce(c("t.similarity"), F.lit(0.0)),
        "table_matches": F.coalesce(c("t.matches"), F.array().cast(MATCHES)),
    })
    total = scoring.overall_score(exact, F.when(same_text, 1.0).otherwise(c("text_score")), both("words"), c("image_similarity"), (F.size("images_a"), F.size("images_b")), c("code_similarity"), both("names"), c("table_similarity"), both("cells"), c("ocr_a") | c("ocr_b"))
    out = evidence.withColumn("o", total)
    return out.select("a", "b", c("o.score").alias("score"), c("o.percentage").alias("percentage"), c("o.is_exact").alias("is_exact"), "image_similarity", "code_similarity", "table_similarity", "image_matches", "code_lines", "table_matches")
