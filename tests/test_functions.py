import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.functions import code, hashing, images, passages, scoring, tables, text
from affinis.functions.words import BOILERPLATE, CODE_KEYWORDS, STOP_WORDS


def one(spark, column, **values):
    kinds = {str: "string", float: "double", bytes: "binary", int: "int", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


def test_word_lists():
    assert (len(STOP_WORDS), len(BOILERPLATE), len(CODE_KEYWORDS)) == (175, 32, 78)


def test_shingles(spark):
    t = spark.createDataFrame([("the quick brown fox jumps over the lazy dog",), ("hello world",), ("a b c a b c",), ("",), (None,)], "t string").select(text.tokens(F.col("t")).alias("k"))
    got = [r[0] for r in t.select(text.shingles(F.col("k"), 3)).collect()]
    assert len(got[0]) == 7 and got[0][0] == "the quick brown" and got[0][-1] == "the lazy dog"
    assert len(got[2]) == 3 and got[3] == [] and got[4] == []
    assert [r[0] for r in t.select(text.shingles(F.col("k"), 5)).collect()][1] == ["hello world"]
    assert [r[0] for r in t.select(text.shingles(F.col("k"), 5, False)).collect()][1] == []


def test_normalisation(spark):
    a, b = "Résumé  of\r\nwork ​", "résumé of\nWORK"
    assert one(spark, text.normalized(F.col("t")), t=a) == "résumé of\nwork"
    assert one(spark, text.texts_identical(F.col("a"), F.col("b")), a=a, b=b)
    assert not one(spark, text.texts_identical(F.col("a"), F.col("b")), a="", b="")
    assert one(spark, text.normalized(F.col("t")), t=None) == ""
    assert one(spark, text.tokens(F.col("t")), t="Résumé X2") == ["r", "sum", "x2"]


def test_scalars(spark):
    for v, want in (("1.0", True), ("100", True), ("0.99985", False), ("99.995", True), ("x", False), (None, False)):
        assert one(spark, text.is_exact_score(F.col("v")), v=v) is want
    assert one(spark, text.html_escaped(F.col("v")), v="<a b=\"c\">'&") == "&lt;a b=&quot;c&quot;&gt;&#039;&amp;"
    assert one(spark, text.cell_value(F.col("v")), v=" 9.80 ") == "9.8"
    assert one(spark, text.cell_value(F.col("v")), v="-0.00001") == "0"
    assert one(spark, text.cell_value(F.col("v")), v="A  b") == "a b"
    assert one(spark, text.cell_value(F.col("v")), v=None) == ""
    assert one(spark, text.rounded(F.col("v"), 2), v=1.005) == 1.0
    assert one(spark, text.safe_filename(F.col("v")), v="a b/ü.txt") == "a_b__.txt"
    assert one(spark, text.printable(F.col("v")), v="\x01 ") == "--"
    assert one(spark, text.ocr_accepted(F.col("v"), F.lit(20)), v="one two") is False
    assert one(spark, text.contains_literal(F.col("v"), "report(final)[v1.0]"), v="My Report(Final)[v1.0].pdf")


def test_highlight():
    got = text.highlight_text("<script> the Quantum field", ["quantum", "the"])
    assert got == '&lt;script&gt; the <mark class="passage-highlight">Quantum</mark> field'
    assert text.highlight_text(None, None) == ""


def fnv(s):
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    assert one(spark, hashing.fnv1a32(F.col("v")), v="hello world") == 3582672807 == fnv("hello world")
    assert one(spark, hashing.fnv1a32(F.col("v")), v="") == fnv("")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8))
def test_fnv_batch(words):
    assert list(hashing.fnv_batch(words)) == [fnv(w) for w in words]


def test_minhash(spark):
    a, b = hashing.coefficients(128)
    assert a[0] == 2615562135 | 1 and b[0] == 1610518372
    words = ["a b c", "b c d", "é"]
    want = [min(min((x * fnv(w) + y) % 4294967311 for w in words), 0xFFFFFFFF) for x, y in zip(a, b)]
    df = spark.createDataFrame([(words,), ([],), (None,)], "s array<string>").select(hashing.minhash(F.col("s")).alias("m"))
    got = [r[0] for r in df.collect()]
    assert got[0] == want and set(got[1]) == set(got[2]) == {0xFFFFFFFF}


def test_estimates(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9]), ([], [1]), (None, [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(hashing.estimated_similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 0.0, 0.0]
    assert one(spark, hashing.candidate_probability(F.col("s")), s=0.8) > 0.95 and one(spark, hashing.candidate_probability(F.col("s")), s=0.1) < 0.01


PARAGRAPHS = ("Photosynthesis converts solar light energy into chemical bonds.", "Mitochondria release stored energy through cellular respiration steps.", "Enzymes lower activation barriers for metabolic reactions.")


def test_passages_reordered():
    found = passages.align("\n\n".join(PARAGRAPHS), "\n\n".join(reversed(PARAGRAPHS)))
    assert [m["similarity"] for m in found] == [100.0] * 3 and {m["matchType"] for m in found} == {"exact"}


def test_passages_noise():
    assert passages.align("It was what it was and so on.", "They were what they were and so on.") == []
    heads = "Introduction\nTable of contents\nReferences\nResults and discussion\nConclusion and future work"
    assert passages.align(heads, heads) == []
    assert passages.align(None, "x") == [] and passages.align("", "") == []


def brute_align(a, b, least, most):
    """The greedy alignment sentence by sentence, without an index."""
    right, used, out = passages.split_sentences(b), set(), []
    for s, off, _ in passages.split_sentences(a):
        toks, content, generic = passages._terms(s)
        if len(toks) < 3 or generic:
            continue
        best, pick = 0.0, None
        for j, (t, _, _) in enumerate(right):
            tt, tc, tg = passages._terms(t)
            if j in used or len(tt) < 3 or tg:
                continue
            if s.lower() == t.lower():
                best, pick = 100.0, j
                break
            got = passages.overlap(content, tc)[0]
            if got >= least and got > best:
                best, pick = got, j
        if pick is not None:
            used.add(pick)
            out.append((off, right[pick][1], best))
    return sorted(out, key=lambda x: -x[2])[:most]


SENTENCE = st.lists(st.sampled_from("alpha beta gamma delta epsilon zeta the of".split()), min_size=3, max_size=6).map(lambda w: " ".join(w) + ".")


@settings(max_examples=60, deadline=None)
@given(st.lists(SENTENCE, max_size=6).map(" ".join), st.lists(SENTENCE, max_size=6).map(" ".join))
def test_align_equals_brute_force(a, b):
    assert [(m["offsetA"], m["offsetB"], m["similarity"]) for m in passages.align(a, b, 35, 15)] == brute_align(a, b, 35, 15)


def test_offsets_and_pages():
    got = passages.split_sentences("One two three.\r\nFour five six seven. Eight nine ten.", [15, 40])
    assert [(s, o, p) for s, o, p in got] == [("One two three.", 0, 1), ("Four five six seven.", 15, 1), ("Eight nine ten.", 35, 2)]


def test_overlap_in_engine(spark):
    a, b = "We compared viral biopsies with clinics", "We compared viral clinics with surgeons"
    tok = lambda c: text.sentence_tokens(F.col(c))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(tok("a").alias("x"), tok("b").alias("y"))
    got = df.select(passages.overlap_scores(F.col("x"), F.col("y")).alias("o")).first()["o"]
    want = passages.overlap(passages._terms(a)[1], passages._terms(b)[1])
    assert got["score"] == want[0] and got["shared"] == len(want[1])


SNIPPET = "int average(int xs[], int n) {\n int total = 0; // sum\n for (int i = 0; i < n; i++) { total += xs[i]; }\n return total / n;\n}"


def test_code(spark):
    renamed = SNIPPET.replace("total", "acc").replace("xs", "vals")
    df = spark.createDataFrame([(SNIPPET, renamed), ("#include <x>\nint main() {\n}", SNIPPET), (None, "")], "a string, b string")
    got = [r[0] for r in df.select(code.comparison(F.col("a"), F.col("b"))).collect()]
    assert got[0]["similarity"] >= 0.70 and got[1]["similarity"] == 0.0 and got[2]["similarity"] == 0.0
    assert one(spark, code.detection(F.col("t")), t=SNIPPET)["is_code"] and not one(spark, code.detection(F.col("t")), t="A plain sentence.")["is_code"]
    assert one(spark, code.normalized_lines(F.col("t")), t="/* x\ny */ a = 1  # note\n#include <v> # kept\n#define Q") == ["a = 1", "#include <v> # kept", "#define Q"]


XML = "<w:tbl><w:tr><w:tc><w:t>Name</w:t></w:tc><w:tc><w:t>Mark</w:t></w:tc></w:tr><w:tr><w:tc><w:t>Ann</w:t></w:tc><w:tc><w:t>9.80</w:t></w:tc></w:tr></w:tbl>"


def test_tables(spark):
    df = spark.createDataFrame([(XML, XML.replace("9.80", "9.8")), (XML, XML.replace("Ann", "Bob").replace("9.80", "1")), ("", XML), (None, None)], "a string, b string").select(tables.from_markup(F.col("a")).alias("a"), tables.from_markup(F.col("b")).alias("b"))
    got = df.select("a", tables.best_of(F.col("a"), F.col("b")).alias("c")).collect()
    assert len(got[0]["a"]) == 1 and got[0]["a"][0]["rowCount"] == 2 and got[0]["a"][0]["colCount"] == 2
    assert got[0]["c"]["similarity"] == 1.0 and 0.3 < got[1]["c"]["similarity"] < 1 and got[2]["c"]["similarity"] == 0.0 and got[3]["c"]["similarity"] == 0.0


def test_images(spark):
    d = lambda a, b: one(spark, images.hamming(F.col("a"), F.col("b")), a=a, b=b)
    assert d("ffffffffffffffff", "fffffffffffffffe") == 1 and d("0" * 16, "f" * 16) == 64 and d("0" * 16, "0" * 15) == 64 and d(None, "0" * 16) == 64 and d("zz" * 8, "0" * 16) == 64
    assert one(spark, images.distance_similarity(F.col("x")), x=1) > 0.95 and one(spark, images.distance_similarity(F.col("x")), x=64) == 0.0
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (120).to_bytes(4, "big") + (45).to_bytes(4, "big")
    assert images.size_of(png) == (120, 45) and images.size_of(b"x") is None and images.size_of(None) is None
    assert images.size_of(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x40" + b"\0" * 12) == (64, 32)
    assert images.size_of(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (63).to_bytes(3, "little") + (31).to_bytes(3, "little")) == (64, 32)
    assert one(spark, images.kind(F.col("b")), b=png) == "png" and one(spark, images.kind(F.col("b")), b=b"no") is None


def score(spark, exact=False, t=0.0, tn=0, i=0.0, n=0, c=0.0, cn=0, b=0.0, bn=0, o=False):
    lit = F.lit
    return spark.range(1).select(scoring.overall_score(lit(exact), lit(t), (lit(tn), lit(tn)), lit(i), (lit(n), lit(n)), lit(c), (lit(cn), lit(cn)), lit(b), (lit(bn), lit(bn)), lit(o)).alias("s")).first()["s"]


def test_fusion(spark):
    assert score(spark, t=0.9, tn=2000, i=0.1, n=1)["percentage"] >= 80
    assert score(spark, t=0.1, tn=20, i=0.95, n=4)["percentage"] >= 85
    assert score(spark, t=0.5, tn=200, i=0.95, n=1, c=0.95, cn=200, o=True)["percentage"] < 90
    assert score(spark, t=0.75, tn=300)["percentage"] == 75.0 and score(spark)["percentage"] == 0.0
    assert score(spark, exact=True)["is_exact"] and score(spark, t=1.0, tn=5, b=1.0, bn=2)["score"] == 1.0
    assert score(spark, t=float("nan"), tn=5)["score"] == 0.0


def test_text_of_tables(spark):
    t = spark.sql("select array(named_struct('tableIndex', 1, 'rowCount', 1, 'colCount', 2, 'rows', array(array('a', 'b'))), named_struct('tableIndex', 2, 'rowCount', 2, 'colCount', 1, 'rows', array(array('c'), array('d')))) as t")
    assert t.select(tables.as_text(F.col("t"))).first()[0] == "\n\n[Table Data]:\na b\n\nc\nd"


def test_hash_variants(spark):
    words = ["plain", "größe", "", None, "日本"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(hashing.fnv1a32(F.col("w")))
    assert [r[0] for r in df.collect()] == [None if w is None else int(hashing.fnv_batch([w])[0]) for w in words]
    sets = [["a", "b"], []]
    free = hashing.signatures_of(sets, 128, clamped=False)
    assert (hashing.signatures_of(sets, 128) == free.clip(max=hashing.EMPTY)).all()
    sig = spark.sql("select array(1L, 2L) as a, array(1L) as b")
    assert sig.select(hashing.estimated_similarity(F.col("a"), F.col("b")), hashing.estimated_similarity(F.col("a"), F.col("b"), True)).first()[:] == (1.0, 0.0)


def test_minhash_of_many_sets(spark):
    """More sets than are signed at once, null, empty and non-ASCII ones among them, from columns cut at any row."""
    rng = random.Random(4)
    sets = [None if i % 97 == 5 else [] if i % 89 == 3 else [rng.choice(["a", "é", "", "日本", "long " * 9]) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 9))] for i in range(1300)]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, s array<string>").where("i > 6").select("i", hashing.minhash(F.col("s"), 16).alias("m"))
    got = {r["i"]: r["m"] for r in df.collect()}
    want = hashing.signatures_of(sets, 16).astype("int64").tolist()
    assert got == {i: want[i] for i in range(7, 1300)}
