import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.llm import common, components, copies, leakage, mixing, near_duplicates, ocr_repair, set_join, shared_spans, subjects
from affinis.runtime import table

RNG = random.Random(11)
WORDS = [f"word{i}" for i in range(40)]


def rows(df):
    return {tuple(r) for r in df.collect()}


# ---------------------------------------------------------------- 1


def tidy_set(values):
    return {" ".join(v.lower().split()) for v in values or [] if v is not None and v.strip()}


def set_brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_set_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    data = []
    for i in range(60):
        vals = [rng.choice(WORDS[:18]) for _ in range(rng.randrange(1, 10))]
        data.append((i, [rng.choice((v, v.upper(), f"  {v} ", None, "")) for v in vals] + [None, " "]))
    data += [(100, None), (101, []), (102, [None, " "]), (103, data[0][1]), (None, ["a"])]
    data.append(data[1])
    df = spark.createDataFrame(data, "request_id long, shingles array<string>").withColumn("vals", F.lit(1)).withColumn("cls", F.lit(2)).withColumn("k", F.lit(3))
    want = set_brute({i: tidy_set(v) for i, v in data if i is not None}, threshold)
    found = set_join.similar_set_pairs(df, "request_id", "shingles", threshold)
    assert rows(found) == want and found.count() == len(want)
    links = Counter(x for p in want for x in p)
    got = {r["request_id"]: r["links"] for r in set_join.set_link_counts(df, "request_id", "shingles", threshold).collect()}
    assert got == {i: links[i] for i, v in data if i is not None and tidy_set(v)}


def test_set_pairs_hot_token_in_blocks(spark):
    data = [(i, ["all", f"x{i}", f"y{i % 3}"]) for i in range(30)]
    df = spark.createDataFrame(data, "request_id long, shingles array<string>")
    _, classes = set_join.set_classes(df, "request_id", "shingles")
    head = {r["cls"]: r["head"] for r in classes.collect()}
    got = {tuple(sorted((head[r["cls_a"]], head[r["cls_b"]]))) for r in set_join.similar_classes(classes, 0.3, block=4).collect()}
    assert got == set_brute({i: set(v) for i, v in data}, 0.3)


def test_one_ident_with_several_sets(spark):
    """Classes are told by their sets: an ident that is smallest in two of them names both, and neither loses links."""
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["x", "y"]), (2, ["a", "b"]), (3, ["x", "y"])], "request_id long, shingles array<string>")
    assert rows(set_join.similar_set_pairs(df, "request_id", "shingles", 0.9)) == {(1, 2), (1, 3)}


def test_set_join_between_tables(spark):
    rng = random.Random(4)
    a = {i: {rng.choice(WORDS[:10]) for _ in range(rng.randrange(1, 6))} for i in range(20)}
    b = {i: {rng.choice(WORDS[:10]) for _ in range(rng.randrange(1, 6))} for i in range(25)}
    frame = lambda s: spark.createDataFrame([(i, sorted(v)) for i, v in s.items()], "id long, v array<string>")
    want = {(i, j) for i in a for j in b if len(a[i] & b[j]) / len(a[i] | b[j]) >= 0.5}
    assert {(r["left_id"], r["right_id"]) for r in set_join.similar_between(frame(a), frame(b), "id", "v", 0.5).collect()} == want
    assert set_join.similar_between(frame(a).limit(0), frame(b), "id", "v", 0.5).count() == 0


# ---------------------------------------------------------------- 2


def span_brute(texts, width):
    seen = {}
    for i, t in texts.items():
        for o in range(len(t) - width + 1):
            seen.setdefault(t[o : o + width], set()).add(i)
    out = set()
    for i, t in texts.items():
        mark = np.zeros(len(t) + 1, bool)
        for o in range(len(t) - width + 1):
            if len(seen[t[o : o + width]]) > 1:
                mark[o : o + width] = True
        f = np.diff(np.concatenate(([False], mark)).astype(int))
        out |= {(i, int(a), int(b)) for a, b in zip(np.flatnonzero(f == 1), np.flatnonzero(f == -1))}
    return out


def span_texts():
    rng = random.Random(8)
    blocks = ["".join(rng.choice("abcdé😀 \n") for _ in range(rng.randrange(50, 160))) for _ in range(6)]
    texts = {i: "".join(rng.choice(blocks) if rng.random() < 0.6 else "".join(rng.choice("efgh") for _ in range(40)) for _ in range(5)) for i in range(14)}
    return texts | {50: "a" * 400, 51: "a" * 300 + "b", 52: "", 53: "short", 54: texts[0]}


@pytest.mark.parametrize("bucket", [shared_spans.BUCKET_CHARS, 200])
def test_spans(spark, monkeypatch, bucket):
    monkeypatch.setattr(shared_spans, "BUCKET_CHARS", bucket)
    texts = span_texts()
    df = spark.createDataFrame([*texts.items(), (60, None), (None, texts[0])], "item_id long, text string").withColumn("k", F.lit(1)).withColumn("start", F.lit(2))
    assert rows(shared_spans.shared_spans(df, width=64)) == span_brute(texts, 64)


def test_span_amounts(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "x" * 10 + "y"), (3, None), (4, "")], "item_id long, text string")
    got = {r["item_id"]: (r["spans"], r["shared_chars"], r["shared_share"]) for r in shared_spans.shared_amounts(df, width=40).collect()}
    assert got == {i: (0, 0, 0.0) for i in (1, 2, 3, 4)}
    assert shared_spans.shared_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 20, 33])
def test_short_windows(spark, width):
    texts = {i: "".join(RNG.choice("abcdefgh") for _ in range(80)) for i in range(4)} | {9: "xyz" * 12}
    texts[7] = texts[1][10:55]
    df = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    assert rows(shared_spans.shared_spans(df, width=width)) == span_brute(texts, width)


def test_window_width_is_checked(spark):
    with pytest.raises(ValueError):
        shared_spans.shared_spans(spark.createDataFrame([(1, "a")], "item_id long, text string"), width=1)


def test_super_kmers_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(shared_spans, "CHUNK", 300)
    text = "".join(RNG.choice("abc") for _ in range(1500)) + "z" * 700
    seen = Counter(s + j for s, _, p in shared_spans.super_kmers(text, 64) for j in range(len(p) - 63))
    assert seen == Counter(range(len(text) - 63)) and all(text[s : s + len(p)] == p for s, _, p in shared_spans.super_kmers(text, 64))


def test_equal_hashes_are_settled(monkeypatch):
    monkeypatch.setattr(shared_spans, "rolling", lambda cp, width: np.zeros(max(0, len(cp) - width + 1), np.uint64))
    got = shared_spans.shared_windows(["abcd", "bcde", "xbcd"], np.array([0, 1, 2]), np.array([0, 1, 2]), 3)
    assert got == [[(1, 2)], [(0, 1)], [(1, 2)]]


# ---------------------------------------------------------------- 3


def page_table(spark, pages, images=()):
    p = spark.createDataFrame([(f"p{f}{n}", "s", f, n, t) for f, n, t in pages], "pageId string, scanId string, documentId string, pageNumber int, text string")
    i = spark.createDataFrame([(f"i{f}{n}", "s", f, n, w, w, t) for f, n, w, t in images], "imageId string, scanId string, documentId string, pageNumber int, width int, height int, ocrText string")
    return p, i


def ocr_pages():
    filler = "the careful archive keeps several interesting letters and long-term records about the harbour"
    body = "the first letter of page {n} says that the careful archive keeps several inter-\nesting letters about the harb0ur and long-\nterm records\nwhile the last of page {n} names the {a}, it is said, of year {n}"
    out = [("F", n, "OLD HARB0UR NOTES\n\n" + body.format(n=w, a=a) + f"\n\n- {n + 4} -") for n, w, a in ((1, "one", "archivc"), (2, "two", "orchive"), (3, "three", "arcbive"))]
    return out + [("G", n, f"start of {w}\n{filler}\n1752\n59\n{filler}\nend of {w}") for n, w in ((1, "one"), (2, "two"))]


def test_ocr_findings(spark):
    got = rows(ocr_repair.findings(*page_table(spark, [*ocr_pages(), ("F", 4, None), ("F", 5, " "), ("H", 1, None), ("H", 2, " \n ")], [("H", 3, 2000, "Figure 2 Old"), ("F", 4, 1000, "Old harbour notes\n\nthe archive end-\n\n- 8 -"), ("F", 5, 1000, "Old harbour nofes\ning here is the careful archive\n- 9 -"), ("F", 5, 90, "Figure 1 Old")])))
    for n in (1, 2, 3):
        r = f"pF{n}"
        assert {k for k in got if k[0] == r} == {(r, 1, "running", ""), (r, 3, "hyphen", "interesting"), (r, 4, "misread", "harbour"), (r, 4, "hyphen", "long-term"), (r, 6, "misread", "archive"), (r, 8, "page_number", "")}
    assert ("iF4", 1, "running", "") in got and ("iF4", 5, "page_number", "") in got and ("iF4", 3, "hyphen", "ending") in got and ("iF5", 1, "running", "") in got
    assert not {k for k in got if k[0].startswith(("pG", "pH", "iH"))}


@pytest.mark.parametrize("block", [2, 512])
def test_ocr_paragraphs(spark, monkeypatch, block):
    monkeypatch.setattr(ocr_repair, "PAGE_BLOCK", block)
    told = "the first letter of page {n} says that the careful archive keeps several interesting letters about the harbour and long-term records while the last of page {n} names the archive, it is said, of year {n}"
    more = [("K", 1, "1. Some Letters\n\nThe careful archive keeps several letters\nabout the harb0ur, (harb0ur) — and the sea.\n\nMany careful records and several letters of the"), ("K", 2, "Harbour.\n\n2. Heading"), ("K", 3, "Another archive keeps the records\nand stops!\n  It is said at last.\n    Long records are inter-"), ("K", 4, "esting,"), ("K", 5, "Words of the Archive name it.")]
    got = ocr_repair.paragraphs(*page_table(spark, [*ocr_pages(), *more, ("F", 4, None), ("F", 5, None)], [("F", 4, 1000, "Old harbour notes\n\nthe archive end-\n\n- 8 -"), ("F", 5, 1000, "Old harbour nofes\ning here is the careful archive\n- 9 -")])).collect()
    assert [r["text"] for r in got if r["file"] == "F"] == [" ".join(told.format(n=n) for n in ("one", "two", "three")) + " the archive ending here is the careful archive"]
    assert [(r["first_page"], r["last_page"], r["text"]) for r in sorted(got, key=lambda r: (r["first_page"], r["record_id"], r["piece"])) if r["file"] == "K"] == [
        (1, 1, "1. Some Letters"), (1, 1, "The careful archive keeps several letters about the harbour, (harbour) — and the sea."), (1, 2, "Many careful records and several letters of the Harbour."), (2, 2, "2. Heading"),
        (3, 3, "Another archive keeps the records and stops!"), (3, 3, "It is said at last."), (3, 5, "Long records are interesting, Words of the Archive name it."),
    ]


def test_ocr_empty(spark):
    assert ocr_repair.findings(*page_table(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinlmorsuthgw", min_size=1, max_size=9), st.randoms())
def test_confusions_keep_the_shape(word, rng):
    pairs = [p for p in ocr_repair.CONFUSIONS if p[0] in word]
    for right, read in rng.sample(pairs, min(2, len(pairs))):
        at = word.find(right)
        if at >= 0:
            changed = word[:at] + read + word[at + len(right) :]
            assert ocr_repair.delete_keys(word) & ocr_repair.delete_keys(changed)
            assert ocr_repair.misreading_cost(word, changed) <= ocr_repair.CONFUSED


def test_skeleton_in_engine(spark):
    words = ["Harbour", "rnodern", "ﬁve|1", "Ünïcode 59"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(ocr_repair.skeleton_col(F.col("w")))
    assert [r[0] for r in df.collect()] == [ocr_repair.skeleton(w) for w in words]


def test_letter_case(spark):
    cases = [("because", "8ecause", True, "Because"), ("belberg", "BEL6ERG", False, "BELBERG"), ("seen", "5een", False, "seen"), ("seen", "Secn", None, "Seen")]
    df = spark.createDataFrame(cases, "fix string, read string, up boolean, want string").select(ocr_repair.in_case_of(F.col("fix"), F.col("read"), F.col("up")), "want")
    assert all(a == b for a, b in df.collect())
    words = [("harb0ur", "harbour"), ("1752", None), ("a|l", "all"), ("h-2", None), ("word", None), ("59th5", None), ("pl4n", None)]
    df = spark.createDataFrame(words, "w string, want string").select(ocr_repair.unread(F.col("w")), "want")
    assert all(a == b for a, b in df.collect() if b is not None)


def test_index_keys_in_engine(spark):
    words = ["archive", "höhe", "16de", "the", "mcdern"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(F.concat(ocr_repair.shape_keys(F.col("w")), ocr_repair.spelled_keys(F.col("w"))))
    assert [set(r[0]) for r in df.collect()] == [ocr_repair.delete_keys(w) for w in words]
    assert ocr_repair.delete_keys("höb") & ocr_repair.delete_keys("h6b")


def test_prices():
    cost = ocr_repair.misreading_cost
    assert [cost("paper", x) for x in ("paper", "papcr", "papr", "paperr", "pader")] == [0.0, 0.25, 0.75, 0.75, 0.75]
    assert cost("paper", "pxpr") > ocr_repair.MOST and cost("paper", "papc") > ocr_repair.MOST


def test_inserted_lost_and_replaced_letters(spark):
    """An edit that is no confusion is mended where the corpus has the correction between the same two words."""
    lines = "\n".join("the careful archive keeps letters" for _ in range(60))
    odd = ["the careful archve keeps letters", "the careful archixe keeps letters", "the careful archiive keeps letters", "the lonely archixo stands apart"]
    found = ocr_repair.findings(*page_table(spark, [("M", 1, f"head\n{lines}\n" + "\n".join(odd) + "\ntail")]))
    assert {(k[1], k[3]) for k in rows(found)} == {(62, "archive"), (63, "archive"), (64, "archive")}


def test_roman_numbers(spark):
    pages = [("R", n, f"some text of the page number {w} stands here\n\n{r}") for n, w, r in ((1, "one", "xxxxv"), (2, "two", "xxxxvi"), (3, "three", "xxxxvll"))]
    got = rows(ocr_repair.findings(*page_table(spark, pages)))
    assert {k[:3] for k in got if k[2] == "page_number"} == {(f"pR{n}", 3, "page_number") for n in (1, 2, 3)}


# ---------------------------------------------------------------- 4


def component_brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(70)] + [("hub", f"h{i}") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("loop", "loop"), ("c03", "c02")]
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string").withColumn("src", F.lit(1)).withColumn("v", F.lit(1))
    got = components.connected_components(df, "a", "b")
    assert {(r["node"], r["component"]) for r in got.collect()} == component_brute(edges)
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_record_groups(spark):
    res = spark.createDataFrame([("A ", "b", 0.9), ("b", "c", 84.0), ("c", "D", 85.0), ("x", None, 1.0), ("q", "r", None), ("a", "a", 1.0)], "documentAId string, documentBId string, similarityScore double")
    docs = spark.createDataFrame([("d", "H1"), ("E", "h1"), ("f", None), (None, "h1"), ("g", ""), ("h", "")], "documentId string, sha256Hash string")
    got = {r["document_id"]: r["group_id"] for r in components.record_groups(res, docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "g": "g", "h": "h", "x": "x", "q": "q", "r": "r"}


# ---------------------------------------------------------------- 5


COPIES = ["Title: One Two\nTerm: 2020\n\nBody text, here!", "term :  2020 \nTITLE: one  two\n  \nbody TEXT here", "Title: Other\n\nBody text, here!", "ﬁne words", "Fine   words.", "", "  ", "?!", None, "no fields: two words name: x\n\nb", "Title: One Two"]


def test_copies(spark):
    df = spark.createDataFrame(list(enumerate(COPIES)), "item_id long, text string").withColumn("key", F.lit("z")).withColumn("k1", F.lit("z"))
    got = {r["item_id"]: (r["kept_item_id"], r["copies"]) for r in copies.copy_groups(df).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 2), 4: (3, 2), 9: (9, 1), 10: (10, 1)}
    assert copies.copy_groups(df.limit(0)).count() == 0


def test_copies_with_and_without_fields_are_united(spark):
    texts = ["Title: A\nTerm: B\n\nrest", "Term: B\nTitle: A\n\nrest", "title a term b rest", "TERM B - TITLE A - REST"]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert {r["kept_item_id"] for r in copies.copy_groups(df).collect()} == {0}


# ---------------------------------------------------------------- 6


def shingle_set(t):
    w = re.findall("[a-z0-9]+", unicodedata.normalize("NFKC", t or "").lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_texts():
    rng = random.Random(6)
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(3, 70))] for _ in range(12)]
    out = []
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return [*out, out[0], out[0].upper(), "", None, "?!", "one", "One."]


def test_near_duplicates(spark):
    texts = near_texts()
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "item_id long, text string").withColumn("cls", F.lit(1)).withColumn("n", F.lit(1))
    want = set_brute({i: shingle_set(t) for i, t in enumerate(texts)}, 0.7)
    found = near_duplicates.near_duplicate_pairs(df, threshold=0.7)
    assert rows(found) == want and found.count() == len(want)
    got = {r["item_id"]: r for r in near_duplicates.near_duplicate_groups(df, threshold=0.7).collect()}
    assert {(i, r["group_id"]) for i, r in got.items() if r["copies"] > 1 or r["links"]} == component_brute(want)
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0


def test_estimate_is_close(spark):
    rng = random.Random(1)
    a, b = [np.unique(common.mix64(np.arange(s, s + 900, dtype=np.uint64))) for s in (0, 150)]
    sig = near_duplicates._pack(near_duplicates._minima([a, b]))
    df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist())], "a array<long>, b array<long>")
    got = df.select(near_duplicates.estimated(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - 750 / 1050) < near_duplicates.slack(0.7) and rng


# ---------------------------------------------------------------- 7


def test_leaks(spark):
    rng = random.Random(9)
    items = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (30, 20, 12, 7, 5)] + [None, "", "Item, one: two three"]
    docs = []
    for i in range(40):
        w = [rng.choice(WORDS) for _ in range(60)]
        if i % 3 == 0:
            src = items[i % 5].split()
            s = rng.randrange(max(1, len(src) - 11))
            part = src[s : s + 12]
            if i % 6 == 0 and len(part) == 12:
                part[5] = "changed"
            w[10:10] = part
        docs.append(" ".join(w))
    docs += [None, "", "ITEM one, two; three!", docs[0]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("ident", F.lit(1)).withColumn("item", F.lit(1))
    e = spark.createDataFrame(list(enumerate(items)), "eval_id long, text string")
    word = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower())
    want, near = set(), set()
    for i, t in enumerate(docs):
        a = word(t)
        for j, u in enumerate(items):
            b = word(u)
            n = min(12, len(b))
            for x in range(len(a) - n + 1) if n else ():
                for y in range(len(b) - n + 1):
                    miss = sum(p != q for p, q in zip(a[x : x + n], b[y : y + n]))
                    if miss == 0:
                        want.add((i, j))
                    if miss <= min(1, n // 4):
                        near.add((i, j))
    got = leakage.leaked_items(d, e).collect()
    assert {(r["doc_id"], r["eval_id"]) for r in got if r["edits"] == 0} == want
    found = {(r["doc_id"], r["eval_id"]) for r in got}
    assert found <= near and len(found) >= 0.9 * len(near)
    assert Counter(leakage.leaked_items(d, e, index_chars=150).collect()) == Counter(got)
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0


def test_repeated_windows_count_alike_in_any_block(spark):
    item = "a b c d e f g h i j k l " * 2
    d = spark.createDataFrame([(1, "x " + item + "y")], "doc_id long, text string")
    e = spark.createDataFrame([(1, item), (2, "some other words that fill a block of their own here and there")], "eval_id long, text string")
    got = [leakage.leaked_items(d, e, index_chars=n).collect() for n in (10**6, 40)]
    assert got[0] == got[1] and got[0][0]["windows"] > 13


def test_recall_out_of_reach_is_refused(monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WALKS", 1)
    with pytest.raises(ValueError):
        leakage.walks_needed(12, 4, 0.99, 11)


def edit_brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=6, max_size=6), st.lists(st.integers(0, 4), min_size=6, max_size=6), st.integers(0, 3))
def test_edit_distance_and_sieve(a, b, k):
    x, y = np.array([a], np.uint64), np.array([b], np.uint64)
    d = int(leakage.edit_distance(x, y)[0])
    assert d == edit_brute(a, b)
    assert d > k or leakage.may_be_close(x, y, k)[0]


@pytest.mark.parametrize("kind", ["replaced", "lost", "added"])
@pytest.mark.parametrize("edits", [1, 2])
def test_leak_recall(edits, kind):
    walks = leakage.walks_needed(12, edits, 0.95, 11)
    rng = np.random.default_rng(99)
    a = rng.integers(1, 1 << 62, (600, 12)).astype(np.uint64)
    b = a.copy()
    for i in range(600):
        row, fresh = list(a[i]), [np.uint64(x) for x in rng.integers(1, 1 << 62, 12)]
        for _ in range(edits):
            p = int(rng.integers(len(row)))
            row[p : p + (kind != "added")] = [] if kind == "lost" else [fresh.pop()]
        b[i] = (row + fresh)[:12]
    start, met = np.arange(600) * 12, np.zeros(600, bool)
    for w in range(walks):
        keys = [leakage.embed_keys(v.ravel(), leakage.walk_bits(v.ravel(), w, 11), start, 12, w, 11) for v in (a, b)]
        met |= np.logical_or.reduce([p == q for p, q in zip(*keys)])
    assert met.mean() >= 0.9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=5))
def test_words(texts):
    low = [common.folded(t) for t in texts]
    h, owner, start, end = common.word_hashes(low)
    want = [(i, m.group()) for i, t in enumerate(low) for m in re.finditer(r"[^\W_]+", t)]
    joined = "\n".join(low)
    assert [(int(o), joined[s:e]) for o, s, e in zip(owner, start, end)] == want
    assert len({(int(x), w) for x, (_, w) in zip(h, want)}) == len({w for _, w in want}) == len(set(h.tolist()))


# ---------------------------------------------------------------- 8


def test_tokens_are_counted_as_the_tokenizer_does():
    encode = mixing._encoding(mixing.TOKENIZERS, mixing.RANKS).encode_ordinary
    texts = ["Hello world, it's 2020!", "a  b", " lead", "trail ", "x\n\ny z", "x \n y", "ünï cödé 漢字 😀", "", None, "a\tb c"]
    assert mixing.count_tokens(texts) == [len(encode(t)) if t else 0 for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,'\n\té1_", max_size=25))
def test_token_pieces(t):
    assert mixing.count_tokens([t]) == [len(mixing._encoding(mixing.TOKENIZERS, mixing.RANKS).encode_ordinary(t)) if t else 0]


def mix_tables(spark):
    docs = [(i, f"text number {i} " * (1 + i % 5), ("big", "mid", "tiny", None, "other")[0 if i < 500 else 1 if i < 700 else 2 if i < 720 else 3 if i < 740 else 4]) for i in range(760)] + [(900, None, "big"), (None, "x", "big")]
    targets = [("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("none", 0.1, 2), (None, 0.0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("u", F.lit(1)).withColumn("copies", F.lit(1)), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixture(spark):
    d, t = mix_tables(spark)
    got = mixing.mixture(d, t).collect()
    assert {r["source"] for r in got} == {"big", "mid", "tiny"}
    per = Counter((r["doc_id"], r["source"]) for r in got)
    assert all(n <= {"big": 1, "mid": 3, "tiny": 4}[s] for (_, s), n in per.items()) and len({(r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["tokens"]
    whole = sum(tokens.values())
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(tokens[s] / whole - share / 0.9) < 0.02
    shares = {r["source"]: r for r in mixing.mixture_shares(d, t).collect()}
    assert shares["none"]["mixed_tokens"] == 0 and {s: shares[s]["mixed_tokens"] for s in tokens} == dict(tokens)
    assert [r["doc_id"] for r in mixing.mixture(d, t).collect()] == [r["doc_id"] for r in got]
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3, 2.5, 90.0, 900.0])
def test_poisson_inverse(spark, rate):
    """At a high cap the expression is no longer, and agrees with sums of the distribution."""
    from math import exp, lgamma, log

    units = [0.001, 0.2, 0.5, 0.9, 0.9999]
    df = spark.createDataFrame([(u, rate) for u in units], "u double, r double").select(mixing.poisson_copies(F.col("u"), F.col("r"), F.lit(1000)))
    cdf = np.cumsum([exp(-rate + k * log(rate) - lgamma(k + 1)) for k in range(1000)]) if rate else np.ones(1000)
    assert [r[0] for r in df.collect()] == [int((cdf <= u).sum()) for u in units]


def test_shares_at_a_high_cap(spark):
    """Shares come within a hundredth of the target, with a source of a third of all tokens and a cap of 100."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word " * 20), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2950, "mid").otherwise("tiny").alias("source"))
    targets = spark.createDataFrame([("hot", 0.2, 1), ("mid", 0.3, 2), ("tiny", 0.5, 100)], "source string, target_share double, max_repeats int")
    for r in mixing.mixture_shares(docs, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) <= 0.01 and r["most_repeats"] <= r["max_repeats"]


def test_tasks_of_the_shuffle():
    assert [mixing.shuffle_tasks(n) for n in (0, 1, 100 << 20, 1 << 40, 100 << 40)] == [1, 1, 7, 65536, 204800]


def test_given_total_beyond_the_caps(spark):
    d, t = mix_tables(spark)
    shares = {r["source"]: r for r in mixing.mixture_shares(d, t, total=1e9).collect()}
    assert shares["tiny"]["copies"] == 80 and shares["big"]["copies"] == 500


# ---------------------------------------------------------------- 9


def test_subjects_held_out(spark, data):
    """Two thirds of the samples label, the documents and the other third are judged."""
    s = table(spark, "/root/testdata/sf0.01", "subject_samples")
    train, test = s.where("sample_id % 3 <> 0"), s.where("sample_id % 3 = 0")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(test.select((F.col("sample_id") + 10**9).alias("doc_id"), "text"))
    got = subjects.subject_counts(docs, train).where("doc_id >= 1000000000").collect()
    best = {}
    for r in got:
        best.setdefault(r["doc_id"] - 10**9, []).append((r["about"], r["weight"], r["subject"]))
    truth = {r["sample_id"]: r["subject"] for r in test.collect()}
    right = sum(max(best.get(i, [(0, 0, "")]))[2] == x for i, x in truth.items())
    assert right >= 0.9 * len(truth)


def test_subjects_edges(spark):
    samples = spark.createDataFrame([("law", "The court heard the judge."), ("sport", "The team won the match."), (None, "x y z"), ("law", None)], "subject string, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["The court and the judge met again.", "The team played the match well.", None, "", "1 2 3", "Hi."] * 5)], "doc_id long, text string").withColumn("ident", F.lit(0)).withColumn("terms", F.lit(0))
    got = rows(subjects.subjects_of(docs, samples))
    assert got == {(i, "law") for i in range(0, 30, 6)} | {(i, "sport") for i in range(1, 30, 6)}
    assert subjects.subjects_of(docs.limit(0), samples).count() == 0 and subjects.subjects_of(docs, samples.limit(0)).count() == 0


def test_sentences():
    h, owner, s = subjects.sentences(["One two 3.5 three. \"Four five six!\" Heading x\n\nSeven eight nine; ten", "a b c"])
    assert list(s) == [0] * 5 + [1] * 3 + [-1] * 2 + [2] * 3 + [-1] + [3] * 3 and list(owner) == [0] * 14 + [1] * 3 and h[2] == 0


def test_queries_of_every_problem():
    from affinis.llm import oracle, queries

    q = list(queries.queries())
    assert {n.split("_")[0] for n in q} == {f"p{i}" for i in range(1, 10)} and set(oracle.oracle_sql()) <= set(q)


def test_two_series_of_page_numbers(spark):
    pages = [("S", n, f"{w} words of a page that stands alone\n\n{r}") for n, w, r in ((1, "some", "iii"), (2, "other", "iv"), (3, "more", "1"), (4, "few", "2"), (5, "last", "3"))]
    got = rows(ocr_repair.findings(*page_table(spark, pages)))
    assert {(k[0], k[2]) for k in got} == {(f"pS{n}", "page_number") for n in range(1, 6)}


def test_files_in_blocks_of_pages(spark, monkeypatch):
    monkeypatch.setattr(ocr_repair, "PAGE_BLOCK", 2)
    outline = spark.createDataFrame([(f"r{n}", "F", n, f"head{n}", n % 2 == 0) for n in (1, 2, 3, 7, 8, 9)] + [("s1", "G", 1, "g", True)], "record_id string, file string, page int, head string, open boolean")
    got = {r["record_id"]: (r["next_head"], r["was_open"]) for r in ocr_repair._neighbours(outline).collect()}
    assert got == {"r1": ("head2", False), "r2": ("head3", False), "r3": ("head7", True), "r7": ("head8", False), "r8": ("head9", False), "r9": (None, True), "s1": (None, False)}
