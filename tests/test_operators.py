import io
import random
import re
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from affinis import runtime
from affinis.config import SimilarityConfig
from affinis.functions.hashing import EMPTY
from affinis.operators import candidates as C
from affinis.operators import image_pairs, prefix_join, results
from affinis.plans import pipeline
from affinis.runtime import table
from affinis.sources import readers, sinks

RESULTS = "scanId string, documentAId string, documentBId string, fileName1 string, fileName2 string, similarityScore double, matchingPassages array<struct<passageA:string,passageB:string,pageA:int,pageB:int,offsetA:int,offsetB:int,similarity:double,matchedWords:array<string>,matchType:string>>, evidence struct<passages:array<string>,images:array<string>,code:array<string>,tables:array<string>>, algorithm string, createdAt timestamp"
DOCS = "scanId string, documentId string, filename string, fileType string, fileSize long, sha256Hash string, normalizedHash string, tokenCount int, createdAt timestamp"
T0 = datetime(2025, 1, 1)


def docs(spark, *ids, sha=None):
    return results.stored_documents(spark.createDataFrame([("s", i, f"{i}.txt", ".txt", 1, (sha or {}).get(i), None, 5, T0) for i in ids], DOCS))


def pairs(spark, *rows):
    return results.stored_pairs(spark.createDataFrame([("s", a, b, f"{a}.txt", f"{b}.txt", s, None, None, "x", T0) for a, b, s in rows], RESULTS))


def averages(spark, d, p):
    return {r["doc_id"]: r for r in results.document_averages(d, p).collect()}


def test_lsh_pairs(spark):
    c = SimilarityConfig()
    s = spark.createDataFrame([("d1", [10] * 128), ("d2", [10] * 128), ("d3", [999] * 128), ("e1", [EMPTY] * 128), ("e2", [EMPTY] * 128), ("n", None), ("short", [1])], "id string, sig array<long>")
    assert {tuple(r) for r in C.lsh_pairs(s, "id", c).collect()} == {("d1", "d2")}


def test_equal_signatures_of_different_sets(spark):
    """Only equal sets stand for each other: b, with a's signature but another set, meets the near duplicate c too."""
    from affinis.streaming import ingest

    near = [1] * 4 + list(range(100, 224))
    rows = [("a", ["p", "q"], [1] * 128), ("b", ["p", "r"], [1] * 128), ("c", ["r", "s"], near), ("d", ["r", "p"], [1] * 128)]
    f = spark.createDataFrame([(i, None, None, v, s) for i, v, s in rows], "documentId string, sha string, norm_hash string, shingles array<string>, sig array<long>")
    want = {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")}
    assert {(r["a"], r["b"]) for r in C.candidates(f, "documentId").collect()} == want
    assert {(r["documentAId"], r["documentBId"]) for r in ingest.compare_new(f, f.limit(0)).collect()} == want
    assert {(r["documentAId"], r["documentBId"]) for r in ingest.compare_new(f.where("documentId in ('c', 'd')"), f.where("documentId in ('a', 'b')")).collect()} == {("a", "c"), ("b", "c"), ("b", "d")}


def test_hash_candidates(spark):
    f = spark.createDataFrame([("a", "h", None, [1] * 128), ("b", "h", None, [2] * 128), ("c", None, None, [3] * 128)], "id string, sha string, norm_hash string, sig array<long>")
    assert [tuple(r) for r in C.candidates(f, "id").collect()] == [("a", "b", True)]


def test_hot_bucket_is_split_and_whole(spark):
    rows = spark.range(60).select(F.lit(1).alias("k"), F.col("id"))
    assert C.pairs_in_buckets(rows, ["k"], "id", block=7).count() == 60 * 59 // 2


def brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}


def test_jaccard_pairs_brute_force(spark):
    rng = random.Random(5)
    base = [{f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))} for _ in range(40)]
    sets = {i: s for i, s in enumerate(base)} | {100: set()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, v array<string>")
    least = {}
    for i, s in sets.items():
        least.setdefault(frozenset(s), i)
    for t in (0.0001, 0.4, 0.75):
        got = {(r["a"], r["b"]) for r in C.jaccard_pairs(df, "id", "v", t).collect()}
        want = {(a, b) for a, b in brute(sets, t) if (least[frozenset(sets[a])] == a and (least[frozenset(sets[b])] == b or sets[a] == sets[b]))}
        assert got == want


def test_scan_empty_and_null(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "One two three four five six seven."), (4, "one two three four five six seven"), (5, None)], "doc_id long, text string")
    got = pipeline.scan(d).select("a", "b", "is_exact", "score").collect()
    assert [(r["a"], r["b"]) for r in got] == [(3, 4)] and got[0]["score"] == 1.0
    assert pipeline.scan(d.limit(0)).count() == 0
    assert pipeline.scan(d, method="exact", text_only=True).count() == 1


def test_scan_paths(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma tau upsilon phi chi psi omega rho pi".split()
    base = " ".join(words) + ". The second sentence speaks about oceans and rivers. A third one is about stones."
    near = base.replace("stones", "metals")
    d = spark.createDataFrame([(1, base), (2, near), (3, "Nothing in common here at all with the others, dear reader.")], "doc_id long, text string")
    row = pipeline.scan(d).collect()
    assert [(r["a"], r["b"]) for r in row] == [(1, 2)] and 0.7 < row[0]["score"] < 1 and len(row[0]["passages"]) == 3


def test_averages(spark):
    d = docs(spark, "a", "b", "c", "d")
    got = averages(spark, d, pairs(spark, ("A", "b ", 1.0), ("a", "c", 0.80), ("a", "d", 60.0), ("b", "c", 0.50), ("a", "c", 0.1)))
    assert got["a"]["average"] == 70.0 and got["a"]["comparisons"] == 2 and got["a"]["is_duplicate"] and got["d"]["average"] == 60.0
    got = averages(spark, docs(spark, "a", "b", "c"), pairs(spark, ("a", "b", 1.0), ("a", "c", 0.60), ("b", "c", 0.40), ("x", None, 0.3), ("a", "b", None)))
    assert (got["a"]["average"], got["b"]["average"], got["a"]["comparisons"]) == (60.0, 40.0, 1)


def test_duplicates(spark):
    got = averages(spark, docs(spark, "a", "b", "c"), pairs(spark, ("a", "b", 1.0), ("b", "c", 1.0)))
    assert all(r["is_duplicate"] for r in got.values())
    got = averages(spark, docs(spark, "a", "b", sha={"a": "H", "b": "h"}), pairs(spark))
    assert got["a"]["average"] is None and got["a"]["comparisons"] == 0 and got["a"]["class"] == "No Data" and got["a"]["is_duplicate"]
    assert not averages(spark, docs(spark, "a"), pairs(spark, ("a", "gone", 1.0)))["a"]["is_duplicate"]


def test_pages(spark):
    d = docs(spark, *[f"d{i}" for i in range(10)])
    a = results.document_averages(d, pairs(spark))
    got = [results.page(a, results.dashboard_order("name_asc"), n, 4).collect() for n in (1, 2, 3)]
    assert [len(g) for g in got] == [4, 4, 2] and got[0][0]["total_pages"] == 3 and got[0][0]["filename"] == "d0.txt"
    assert results.page(a, results.dashboard_order("name_desc"), 0, 1000).count() == 10


def test_categories_and_filters(spark):
    p = pairs(spark, ("a", "b", 0.0), ("a", "c", 0.399), ("a", "d", 0.40), ("a", "e", 0.70), ("a", "f", 1.0), ("a", "g", None))
    c = results.score_categories(p).first()
    assert (c["exact"], c["high"], c["moderate"], c["low"], c["pairs"]) == (1, 1, 1, 2, 6)
    n = lambda **k: p.where(results.pair_filter(**k)).count()
    assert n(low=70) == 2 and n(low=-50) == 5 and n(high=200) == 5 and n(low="invalid_not_a_number") == 6 and n(category="low") == 2 and n(content="text") == 0


def test_order_and_search(spark):
    d = spark.createDataFrame([("s", a, "z", f"{a}(final)[v1.0].pdf", "z", 0.75, None, None, "x", T0) for a in ("charlie", "alpha", "bravo")], RESULTS)
    p = results.stored_pairs(d)
    assert [r["a"] for r in p.orderBy(*results.pair_order()).collect()] == ["alpha", "bravo", "charlie"]
    assert results.search_pairs(p, "ALPHA(final)[v1.0].pdf").count() == 1 and results.search_pairs(p, " ").count() == 3
    assert results.lookup(p, spark.createDataFrame([("s", "z", "alpha"), ("s", "alpha", "alpha")], "scan_id string, x string, y string")).count() == 1


def test_image_pairs(spark):
    rows = [("i1", "A", "0f0f0f0f0f0f0f0f", "x"), ("i2", "B", "0f0f0f0f0f0f0f0e", "y"), ("i3", "C", "f0f0f0f0f0f0f0f0", "z"), ("i4", "A", "0f0f0f0f0f0f0f0f", "x"), ("i5", "D", None, "x"), ("i6", "E", "bad", None)]
    df = spark.createDataFrame(rows, "imageId string, documentId string, dhash string, sha256 string")
    assert [(r["dhash_a"], r["distance"]) for r in image_pairs.close_hashes(df).collect()] == [("0f0f0f0f0f0f0f0e", 1)]
    assert {r["image_id"] for r in image_pairs.same_content(df).collect()} == {"i1", "i4", "i5"}


def test_image_pairs_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = {f"{b ^ sum(1 << i for i in rng.sample(range(64), k)):016x}" for b in base for k in (0, 4, 9, 12, 13)}
    df = spark.createDataFrame([(f"i{i}", f"d{i}", h, h) for i, h in enumerate(sorted(hashes))], "imageId string, documentId string, dhash string, sha256 string")
    want = {(a, b) for a in hashes for b in hashes if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 12}
    assert {(r["dhash_a"], r["dhash_b"]) for r in image_pairs.close_hashes(df).collect()} == want


def test_close_hashes_send_no_neighbour_values(spark, monkeypatch):
    """No row for each value near a hash: 2,788 of them a hash were broadcast or shuffled. Tiles give what one block gives."""
    rng = random.Random(11)
    base = [0, 15, (1 << 64) - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(30))]
    hashes = sorted({f"{b ^ sum(1 << i for i in rng.sample(range(64), k)):016x}" for b in base for k in (0, 1, 6, 12, 13)})
    df = spark.createDataFrame([(f"d{i % 7}", h.upper() if i % 2 else h) for i, h in enumerate(hashes)], "documentId string, dhash string")
    got = image_pairs.close_hashes(df)
    assert not re.search("Generate|explode", got._jdf.queryExecution().toString())
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = sorted((a, b, bits(a, b)) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (j - i) % 7 and bits(a, b) <= 12)
    assert sorted((r["dhash_a"], r["dhash_b"], r["distance"]) for r in got.collect()) == want
    monkeypatch.setattr(image_pairs, "HELD", 3)
    apart = image_pairs.near_hashes(spark.createDataFrame([(h,) for h in hashes], "dhash string"), 12, block=20)
    assert sorted(tuple(r) for r in apart.collect()) == [(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if bits(a, b) <= 12]


def test_planted_image_candidates_at_every_distance(spark, tmp_path):
    """Copies 3, 8 and 12 bits away are found, those 13 away not, and the query makes no rows of neighbour values."""
    from affinis.plans import queries

    hashes = [f"{t:x}" + f"{random.Random(t).getrandbits(60):015x}" for t in range(16)]
    spark.createDataFrame([(f"d{i}", h) for i, h in enumerate(hashes)], "documentId string, dhash string").write.parquet(str(tmp_path / "images.parquet"))
    got = queries.planted_image_candidates(spark, str(tmp_path))
    assert not re.search("Generate|explode", got._jdf.queryExecution().toString())
    flipped = lambda h: f"{int(h, 16) ^ (0x0421, 0x0F33, 0x0FFF, 0x1FFF)[int(h[0], 16) % 4]:016x}"
    want = {tuple(sorted((h, flipped(h)))) for h in hashes if int(h[0], 16) % 4 < 3}
    rows = got.collect()
    assert {(r["dhash_a"], r["dhash_b"]) for r in rows} == want and {r["distance"] for r in rows} == {3, 8, 12}


def test_document_pairs_by_images(spark):
    """Every two documents with an image that best_of counts, also far ones, hot ones and those without a text."""
    from affinis.operators import multimodal as M

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    hashes = [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 0, 12, 14, 16, 17)]
    rows = [(f"i{i}", f"d{i % 31:02}", f"{h:016X}", f"S{i % 17}" if i % 3 else None) for i, h in enumerate(hashes)] + [("n", "z", None, "s1"), ("m", None, None, "s1"), ("bad", "y", "zz", None)]
    df = spark.createDataFrame(rows, "imageId string, documentId string, dhash string, sha256 string")
    near = lambda x, y: bool(x and y and len(x) == len(y) == 16 and (int(x, 16) ^ int(y, 16)).bit_count() <= 16)
    want = {(p[1], q[1]) for p in rows for q in rows if p[1] and q[1] and p[1] < q[1] and (near(p[2], q[2]) or (p[3] and q[3] and p[3].lower() == q[3].lower()))}
    assert {tuple(r) for r in image_pairs.document_pairs(df).collect()} == want
    few = image_pairs.near_hashes(df.where("length(dhash) = 16").select(F.lower("dhash").alias("dhash")).distinct(), 16, block=7)
    distinct = sorted({f"{h:016x}" for h in hashes})
    assert sorted(tuple(r) for r in few.collect()) == [(x, y) for i, x in enumerate(distinct) for y in distinct[i + 1 :] if near(x, y)]

    texts = M.documents(df, spark.createDataFrame([("d00", "some words"), ("only text", "other words")], "documentId string, text string"))
    assert {r["documentId"] for r in texts.collect()} == {r[1] for r in rows if r[1]} | {"only text"}
    got = M.compare(M.candidates(df, C.features(texts, "documentId")), M.contents(df, texts), "documentId").collect()
    assert {(r["a"], r["b"]) for r in got} == want and all(r["image_similarity"] >= 0.5 and r["score"] > 0 for r in got)


def test_insert_if_absent(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "b", 0.5), ("s", "a", "b", 0.7), ("s", "a", None, 0.1)], "scanId string, documentAId string, documentBId string, similarityScore double")
    path = str(tmp_path / "results")
    for _ in range(2):
        sinks.insert_if_absent(spark, rows, path)
    assert sorted(r["similarityScore"] for r in spark.read.parquet(path).collect()) == [0.1, 0.5]


def test_readers(spark, tmp_path):
    doc = "<w:p><w:r><w:t>First</w:t></w:r><w:r><w:t>part</w:t></w:r></w:p><w:p><w:t>Second</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>Cell</w:t></w:p></w:tc></w:tr></w:tbl>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("word/media/image1.png", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (200).to_bytes(4, "big") + (50).to_bytes(4, "big"))
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.txt").write_bytes("héllo".encode() + b"\xff")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r["filename"]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "Firstpart\n\nSecond\n\nCell\n\n\n\n[Table Data]:\nCell" and got["a.docx"]["images"][0]["width"] == 200
    assert got["b.txt"]["text"] == "héllo" and got["b.txt"]["error"] is None
    assert all(got[n]["error"] for n in ("c.pdf", "d.exe", "e.docx"))
    with_pdf = {r["filename"]: r for r in readers.read_documents(spark, str(tmp_path), pdf=lambda b: "pages").collect()}
    assert with_pdf["c.pdf"]["text"] == "pages"
    assert readers.read_texts(spark, str(tmp_path / "b.txt")).count() == 1


def test_streaming(spark, tmp_path):
    from affinis.streaming import ingest

    src, schema = str(tmp_path / "in"), "documentId string, text string"
    text = "one two three four five six seven eight nine ten eleven twelve"
    run = lambda: ingest.start(spark, src, spark.createDataFrame([], schema).schema, str(tmp_path / "f"), str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("a", text), ("b", text + " more")], schema).write.parquet(src)
    run()
    spark.createDataFrame([("c", text), ("d", None)], schema).write.mode("append").parquet(src)
    run()
    got = {(r["documentAId"], r["documentBId"]): r["similarityScore"] for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got[("a", "c")] == 1.0 and ("a", "b") in got and len(got) == 2  # c is tied to a, which stands for it


def test_queries_run_and_have_sql(spark, data):
    from affinis.plans import oracle, queries

    q = queries.queries()
    assert set(oracle.oracle_sql()) <= set(q)
    for name in ("tokenize_stats", "stored_results", "scan_summary"):
        assert q[name](spark, data).count() > 0


def test_boilerplate_lines(spark, tmp_path):
    from affinis.plans import queries

    spark.createDataFrame([(1, "The harbour keeps letters\n\nIntroduction\r\nShips left the harbour early"), (2, "Introduction"), (3, None), (4, " \n")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.queries()["boilerplate_lines"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, False), (1, 3, True), (1, 4, False), (2, 1, True)}


def test_multimodal(spark):
    from affinis.operators import multimodal as M

    table = "array(struct(1 as tableIndex, 1 as rowCount, 2 as colCount, array(array('x', '9.80')) as rows))"
    code = "array(struct('int f(int a) { for (int i = 0; i < a; i++) { if (a) return i; } while (a) break; }' as code, true as isFromOcr))"
    img = "array(struct('i' as imageId, 'S' as sha256, '0f0f0f0f0f0f0f0f' as dhash))"
    content = spark.sql(f"""select * from values ('a', null, 'Same text here', {img}, {table}, {code}), ('b', null, 'same  TEXT here', {img}, {table}, {code}), ('c', 'h', 'x', null, null, null), ('d', 'h', 'y', null, null, null), ('e', null, null, null, null, null),
      ('f', null, 'same text HERE', null, null, null), ('g', null, 'same text here', null, null, null) as t(id, sha, text, images, tables, code)""")
    pairs = spark.createDataFrame([("a", "b", 0.2), ("c", "d", 0.0), ("c", "e", None), ("f", "g", 0.1)], "a string, b string, text_score double")
    got = {(r["a"], r["b"]): r for r in M.compare(pairs, content, "id").collect()}
    assert got[("a", "b")]["score"] == 1.0 and got[("a", "b")]["image_similarity"] == 1.0 and len(got[("a", "b")]["table_matches"]) == 1
    assert got[("c", "d")]["is_exact"] and got[("f", "g")]["is_exact"] and got[("c", "e")]["score"] == 0.0


def test_logs_and_names(spark):
    log = spark.createDataFrame([("s", 1, "queued"), ("s", 3, "done"), ("t", 2, "queued")], "scanId string, at int, state string")
    assert {(r["scanId"], r["state"]) for r in sinks.latest_by(log, "scanId", "at").collect()} == {("s", "done"), ("t", "queued")}
    assert sinks.renamed_fields(log.withColumnRenamed("at", "candidate_pairs")).columns == ["scanId", "candidatePairs", "state"]
    assert readers.scan_rows(log, "s").count() == 2
    d = results.document_averages(docs(spark, "Alpha", "beta"), pairs(spark))
    assert results.search_documents(d, " ALP ").count() == 1 and results.search_documents(d).count() == 2


def test_read_queries_on_empty_tables(spark):
    d, p = docs(spark).limit(0), pairs(spark, ("a", "b", 0.5)).limit(0)
    assert results.document_averages(d, p).count() == 0 and results.duplicate_files(d, p).count() == 0 and results.scan_summary(d, p).count() == 0
    assert results.page(results.evidence_summary(p), results.pair_order()).count() == 0 and results.score_categories(p).count() == 0


def test_clashing_columns_and_nulls(spark):
    rows = [(i, "one two three four five six seven eight" if i < 3 else None, "x") for i in range(5)] + [(None, "one two three four five six", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, sig string").withColumn("shingles", F.lit("s")).withColumn("a", F.lit(1)).withColumn("sha", F.lit("h"))
    assert {(r["a"], r["b"]) for r in pipeline.scan(d).collect()} == {(0, 1), (0, 2)}


def test_staged_tables_are_cleared(spark):
    from affinis.runtime import clear_staged, stage

    kept = stage(spark.range(3), "x")
    assert kept.count() == 3 and clear_staged(spark) >= 1 and clear_staged(spark) == 0


def _png(width, height, tail=b""):
    return b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + width.to_bytes(4, "big") + height.to_bytes(4, "big") + tail


def test_word_processor_text(spark, tmp_path):
    """Runs join without a blank, entities are decoded, cells stand in the text and again as table data, tables apart."""
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    tbl = lambda a, b: f"<w:tbl><w:tr>{cell(a)}{cell(b)}</w:tr><w:tr>{cell('x')}{cell('y')}</w:tr></w:tbl>"
    xml = f'<w:p><w:r><w:t>Broken wo</w:t></w:r><w:r><w:t xml:space="preserve">rd &amp; more</w:t></w:r></w:p>{tbl("a", "b")}{tbl("c", "d")}'
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/notes.bin", b"no image")
        z.writestr("word/media/big.png", _png(200, 50))
        z.writestr("word/media/small.png", _png(90, 50))
    asked = lambda b: ("int main() { int sum = 0; for (int i = 0; i < 3; i++) { sum += i; } return sum; }", 80.0)
    r = readers.read_documents(spark, str(tmp_path), ocr=asked).first()
    assert r["text"] == "Broken word & more\n\na\n\nb\n\nx\n\ny\n\nc\n\nd\n\nx\n\ny\n\n\n\n[Table Data]:\na b\nx y\n\nc d\nx y\n\n[OCR from Screenshot]:\n" + asked(b"")[0]
    assert [(i["imageId"], i["width"], i["ocrText"] is not None) for i in r["images"]] == [("docx_img_1", 200, True), ("docx_img_2", 90, False)]
    assert r["images"][0]["dhash"] == r["images"][0]["sha256"][:16] and r["hasOcr"]
    assert [(c["isFromOcr"], c["sourceImageId"]) for c in r["codeSnippets"]][0] == (True, "docx_img_1") and len(r["tables"]) == 2


def test_pdf_pages_and_gated_recognition(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "shot.png").write_bytes(_png(50, 20))
    (tmp_path / "blur.png").write_bytes(_png(50, 20, b"!"))
    pictures = [(1, _png(130, 60)), (1, _png(119, 60)), (3, _png(130, 60, b"x"))]
    pdf = lambda b: (["one page of text", "", "three"], pictures)
    said = {_png(130, 60): "one page of text and something longer after it", _png(130, 60, b"x"): "too short", _png(50, 20): ("Words  of a\r\npicture", 95.0), _png(50, 20, b"!"): ("a b c", 12.0)}
    got = {r["filename"]: r for r in readers.read_documents(spark, str(tmp_path), pdf=pdf, ocr=lambda b: said[b]).collect()}
    p = got["a.pdf"]
    assert p["text"] == "one page of text\n\nthree\n\n[OCR from Screenshot Page 1]:\none page of text and something longer after it"
    assert [x["text"] for x in p["pages"]] == ["one page of text", "", "three"] and [i["imageId"] for i in p["images"]] == ["p1_img1", "p1_img2", "p3_img1"]
    assert [i["ocrText"] is None for i in p["images"]] == [False, True, True]
    assert got["shot.png"]["text"] == "Words of a\npicture" and got["blur.png"]["text"] == "[Image Document: blur.png]" and got["shot.png"]["pages"][0]["pageNumber"] == 1


def test_pages_of_passages(spark):
    text = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen."
    df = spark.createDataFrame([(1, text, [24, 26, 40]), (2, text + " Other words stand here too.", [200])], "doc_id long, text string, lens array<int>")
    found = pipeline.scan(df, pages="lens").first()["passages"]
    assert sorted((p["offsetA"], p["pageA"], p["pageB"]) for p in found) == [(0, 1, 1), (24, 1, 1), (50, 2, 1)]


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.9])
def test_prefix_join(spark, threshold):
    rng = random.Random(3)
    sets = {i: {rng.randrange(30) for _ in range(rng.randrange(1, 12))} for i in range(50)}
    df = spark.createDataFrame([(i, sorted(v)) for i, v in sets.items()], "cls long, vals array<long>")
    want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold - 1e-9}
    assert {tuple(r)[:3] for r in prefix_join.similar_sets(df, threshold, block=5).collect()} == want
    assert prefix_join.similar_sets(df.limit(0), 0.5).count() == 0


def test_spread_starts_no_job(spark, data):
    t = table(spark, data, "documents")
    joined = t.join(t.groupBy("doc_id").count().hint("shuffle_hash"), "doc_id")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert runtime.spread(joined) is joined and runtime.scan_tasks(t.select("doc_id")) == 1 and runtime.spread(t) is not t
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_checkpoint_folders(spark, tmp_path):
    """The folder named in the session comes first, then the one set on the context."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert runtime.staging_root(spark).startswith(named.rstrip("/") if named else f"file:{tmp_path}")


def test_contents_hold_tables_and_code_read_from_images(spark):
    from affinis.operators import multimodal as M

    source = "int main() { int sum = 0; for (int i = 0; i < 3; i++) { sum += i; } return sum; }"
    images = spark.createDataFrame([("i1", "a", "s1", None, source), ("i2", "b", "s2", None, source), ("i3", "b", "s3", None, "a caption")], "imageId string, documentId string, sha256 string, dhash string, ocrText string")
    rows = "array(named_struct('tableIndex', 1, 'rowCount', 1, 'colCount', 2, 'rows', array(array('left', 'right'))))"
    texts = spark.sql(f"select d as documentId, 'some words here' as text, {rows} as tables from values ('a'), ('b'), ('c') as t(d)")
    content = M.contents(images, texts)
    assert {r["documentId"]: [c["isFromOcr"] for c in r["code"]] for r in content.collect()} == {"a": [True], "b": [True], "c": []}
    r = M.compare(spark.createDataFrame([("a", "b", 1.0)], "a string, b string, text_score double"), content, "documentId").first()
    assert r["code_similarity"] == 1.0 and r["table_similarity"] == 1.0 and r["image_similarity"] == 0.0


def test_pairs_carry_keys_not_texts(spark):
    """Code is cut into tokens and hashes are read once a document, not for every pair it is in; results as of the pair."""
    from affinis.functions import code
    from affinis.operators import multimodal as M

    loop = "int main() {{ int {0} = 0; for (int i = 0; i < 3; i++) {{ {0} += i; }} return {0}; }}"
    texts = {"a": loop.format("sum"), "b": loop.format("all") + " // other names", "c": "plain words, no code", "d": "Plain  WORDS; no code", "e": None, "f": ""}
    images = spark.createDataFrame([("i1", "a", "X", "0F0F0F0F0F0F0F0F"), ("i2", "b", "x", None), ("i3", "c", "y", "0f0f0f0f0f0f0f01"), ("i4", "d", None, "bad"), ("i5", "d", "z", "ffffffffffffffff"), ("i6", "f", None, None)], "imageId string, documentId string, sha256 string, dhash string")
    content = M.contents(images, spark.createDataFrame(list(texts.items()), "documentId string, text string"))
    pairs = [(x, y, 0.25) for x in texts for y in texts if x < y]
    got = M.compare(spark.createDataFrame(pairs, "a string, b string, text_score double"), content, "documentId")
    assert not re.search("regexp|split|nfkc", got.select("a", "b", "image_similarity", "code_similarity")._jdf.queryExecution().optimizedPlan().toString())
    rows = {(r["a"], r["b"]): r for r in got.collect()}
    assert len(rows) == len(pairs)
    want = spark.createDataFrame([(texts["a"], texts["b"])], "x string, y string").select(code.comparison(F.col("x"), F.col("y")).alias("c")).first()["c"]
    ab, cd = rows["a", "b"], rows["c", "d"]
    assert ab["code_similarity"] == want["similarity"] > 0.5 and ab["code_lines"] == want["matching_lines"] and ab["image_similarity"] == 1.0
    assert rows["a", "c"]["image_similarity"] == 0.9063 and rows["a", "c"]["code_similarity"] == 0.0 and rows["a", "c"]["code_lines"] == []
    assert cd["image_similarity"] == 0.0 and cd["image_matches"] == [] and cd["table_similarity"] == 0.0 and cd["table_matches"] == []
    assert cd["score"] == round(4 / (4 + 225), 4) and not cd["is_exact"] and rows["e", "f"]["score"] == 0.0


def test_multimodal_pairs_of_texts_are_all_that_reach_the_floor(spark):
    """Copies are compared like all others, and low similarities too, which bands of a signature often miss."""
    from affinis.operators import multimodal as M
    from affinis.operators import set_pairs

    rng = random.Random(11)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        # the first words of the base, then words of its own: similarities from 0.05 to 0.9
        texts |= {f"g{g:02}-{k:02}": " ".join(base[:k] + [f"o{rng.randrange(10**6)}" for _ in range(60 - k)]) for k in (60, 55, 45, 36, 28, 22, 18, 12)}
    texts |= {f"copy-{i}": texts["g00-60"] for i in range(3)} | {f"cyrillic-{i}": "Привет мир" for i in range(3)} | {"few": "one two", "none": None, "blank": " "}
    words = {i: (t or "").split() for i, t in texts.items() if not i.startswith("cyrillic")}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in alike.items() if j >= 0.15}
    assert min(want.values()) < 0.25 and len(want) < len([j for j in alike.values() if j > 0])
    same = {(f"cyrillic-{i}", f"cyrillic-{k}"): 1.0 for i in range(3) for k in range(i + 1, 3)}

    items = spark.createDataFrame(list(texts.items()), "documentId string, text string")
    images = spark.createDataFrame([], "imageId string, documentId string, sha256 string, dhash string")
    got = {(r["a"], r["b"]): r["text_score"] for r in M.candidates(images, C.features(items, "documentId")).collect()}
    assert got.keys() >= want.keys() | same.keys() and all(abs(got[p] - j) < 1e-12 for p, j in (want | same).items())
    assert {p for p in got if p not in alike} == same.keys() and all(got[p] == j for p, j in alike.items() if p in got and j in (0.0, 1.0))

    numbers = {i: n for n, i in enumerate(sets)}
    rows = spark.createDataFrame([(numbers[i], [" ".join(x) for x in v]) for i, v in sets.items()] + [(-1, [])], "n long, vals array<string>")
    exact = sorted(tuple(sorted((numbers[a], numbers[b]))) for a, b in want)
    for tile, most in ((16384, 1 << 21), (9, 1 << 21), (16384, 700)):
        assert sorted(tuple(sorted(r)) for r in set_pairs.overlapping(rows, "n", "vals", 0.15, tile, most).collect()) == exact
    assert set_pairs.overlapping(rows.limit(0), "n", "vals", 0.15).count() == 0
    with pytest.raises(ValueError):
        set_pairs.overlapping(rows, "n", "vals", 0.0)


def test_steps_of_set_pairs_are_bounded(monkeypatch):
    """Whatever the counters and the values met of a step, the pairs are the same."""
    import pyarrow as pa

    from affinis.operators import set_pairs

    rng = random.Random(3)
    kind = pa.list_(pa.struct([("i", pa.int64()), ("v", pa.list_(pa.int32()))]))
    sets = [set(rng.sample(range(40), rng.randrange(1, 20))) for _ in range(50)]
    tiles = pa.array([[{"i": i, "v": list(s)} for i, s in enumerate(sets) if i % 2 == side] for side in (0, 1)], kind)
    for x, y in ((0, 0), (0, 1), (1, 1)):
        want = sorted((i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i % 2 == x and j % 2 == y and (x != y or i < j) and len(s & t) >= 0.3 * len(s | t))
        for counters, met in ((1 << 20, 1 << 22), (60, 1 << 22), (1 << 20, 1)):
            monkeypatch.setattr(set_pairs, "COUNTERS", counters)
            monkeypatch.setattr(set_pairs, "MET", met)
            assert sorted((int(a), int(b)) for i, j in set_pairs._alike(tiles[x], tiles[y], x == y, 0.3) for a, b in zip(i, j)) == want
