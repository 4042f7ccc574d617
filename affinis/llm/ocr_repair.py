"""Problem 3: page furniture, broken words and misread letters in text from scanned pages.

Lines at the top or bottom that stand on several pages of a file and bare page numbers are taken off; words broken at line
ends are joined; words are held against a lexicon of corpus frequencies. A symmetric-delete index over spellings and over the
shapes that confusable letters leave alike generates corrections, a weighted edit distance with confusion pairs prices them,
and the counts of neighbouring words decide. The findings are listed, or applied: paragraphs() gives the flowing text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from affinis.runtime import spread, stage

#: Misreadings of printed letters: what stands on paper, and what recognition makes of it.
CONFUSIONS = (
    ("e", "c"), ("s", "5"), ("t", "f"), ("a", "o"), ("n", "ri"), ("i", "l"), ("o", "0"), ("l", "|"), ("d", "cl"), ("l", "1"), ("i", "1"), ("u", "ii"), ("m", "rn"),
    ("h", "b"), ("g", "9"), ("b", "6"), ("b", "8"), ("ö", "6"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("rn", "m"), ("cl", "d"), ("ü", "ii"), ("z", "2"),
    ("é", "e"), ("è", "e"), ("ê", "e"), ("ä", "a"), ("á", "a"), ("à", "a"), ("â", "a"), ("ö", "o"), ("ó", "o"), ("ô", "o"), ("ü", "u"), ("ú", "u"), ("í", "i"), ("î", "i"), ("ñ", "n"), ("ç", "c"),
)
#: Price of a confusion, of any other edit, and the most a correction may cost: up to three confusions, or one other edit.
CONFUSED, EDIT, MOST = 0.25, 0.75, 0.8
#: Times that a correction must be more frequent than the word it replaces: for words of up to three letters, for longer
#: ones, and for an edit that is no confusion, which also takes a word of LETTERS letters and known words on both sides.
RATIO_SHORT, RATIO, RATIO_EDIT, LETTERS = 30, 4, 50, 5
#: Lines from either end of a page that can be furniture.
EDGE_LINES = 3
#: Pages of a file that are put in order by one task.
PAGE_BLOCK = 512
#: Distinct tokens, and rows, that a worker holds before it hands them on.
HELD_TOKENS, HELD_ROWS = 200_000, 40_000
#: Bits of the sieves that tell workers which words or pairs of words to hand on; what passes by chance is joined away.
SIEVE_BITS = 23

# Every shape that confusions make alike becomes one spelling: similar letters one letter, wide letters their strokes.
def _alike() -> tuple[str, str]:
    """Letters and what each folds to; the second text has a letter for each of the first."""
    groups = {"o": "0aàáâäöóôø", "e": "éèêëcç", "s": "5", "q": "9g", "b": "6h8", "l": "|i1ìíîï", "t": "f", "z": "2", "u": "ùúûü", "n": "ñ"}
    return "".join(groups.values()), "".join(k * len(v) for k, v in groups.items())


_FROM, _TO = _alike()
_WIDE = (("ﬁ", "tl"), ("ﬂ", "tl"), ("d", "el"), ("u", "ll"), ("w", "vv"), ("m", "rn"), ("n", "rl"))
_FOLD = str.maketrans(_FROM, _TO)


def skeleton(word: str) -> str:
    """The shape of a word: any two words that confusions can turn into each other have the same."""
    s = word.lower().translate(_FOLD)
    for a, b in _WIDE:
        s = s.replace(a, b)
    return s


def skeleton_col(c: Column) -> Column:
    s = F.translate(F.lower(c), _FROM, _TO)
    for a, b in _WIDE:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


@cache
def _pairs() -> dict[tuple[str, str], float]:
    return {p: CONFUSED for p in CONFUSIONS}


def misreading_cost(right: str, read: str) -> float:
    """Least price of edits that turn the right word into what was read, above MOST for anything dearer."""
    pairs, n, m = _pairs(), len(right), len(read)
    far = MOST + 1
    if abs(n - m) > 4:
        return far
    cost = [[far] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c > MOST:
                continue
            if i < n and j < m:
                step = 0.0 if right[i] == read[j] else EDIT
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c + step)
            if i < n:
                cost[i + 1][j] = min(cost[i + 1][j], c + EDIT)
            if j < m:
                cost[i][j + 1] = min(cost[i][j + 1], c + EDIT)
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m and (right[i : i + a], read[j : j + b]) in pairs:
                        cost[i + a][j + b] = min(cost[i + a][j + b], c + pairs[right[i : i + a], read[j : j + b]])
    return cost[n][m]


def delete_keys(word: str) -> set[str]:
    """Keys of the index: the word's shape, its coarse shape where ö and 6 may stand for each other, and for longer words
    the spelling, whole and with any one letter left out."""
    s = skeleton(word)
    keys = {"s" + s} | ({"c" + s.replace("b", "o")} if "ö" in word or "6" in word else set())
    return keys | ({"d" + word} | {"d" + word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= LETTERS - 1 else set())


def shape_keys(c: Column) -> Column:
    s = skeleton_col(c)
    return F.when(c.rlike("[ö6]"), F.array(F.concat(F.lit("s"), s), F.concat(F.lit("c"), F.replace(s, F.lit("b"), F.lit("o"))))).otherwise(F.array(F.concat(F.lit("s"), s)))


def spelled_keys(c: Column) -> Column:
    left_out = F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.concat(F.lit("d"), F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.length(c))))
    return F.when(F.length(c) >= LETTERS - 1, F.array_distinct(F.concat(F.array(F.concat(F.lit("d"), c)), left_out))).otherwise(F.array().cast("array<string>"))


_UNREAD = {"0": "o", "5": "s", "6": "b", "8": "b", "9": "g", "1": "l", "|": "l", "2": "z"}
_MIXED = r"^(?:\p{L}*(?:[0-9|]\p{L}+)+[0-9|]?|\p{L}{2,}[0-9|])$"


def unread(word: Column) -> Column:
    """A word with digits among its letters, the digits read as the letters they look like; null for other words."""
    return F.when(word.rlike(_MIXED) & word.rlike(r"\p{L}.*\p{L}"), F.translate(word, "".join(_UNREAD), "".join(_UNREAD.values())))


def in_case_of(fix: Column, read: Column, upper_start: Column) -> Column:
    """fix in the letter case of what was read; upper_start settles a first letter that was read as a digit."""
    first = F.substring(read, 1, 1)
    capital = first.rlike(r"^\p{Lu}") | (~first.rlike(r"^\p{L}") & F.coalesce(upper_start, F.lit(False)))
    shouted = F.regexp_replace(read, r"[^\p{L}]+", "").rlike(r"^\p{Lu}{2,}$")
    return F.when(shouted, F.upper(fix)).when(capital, F.concat(F.upper(F.substring(fix, 1, 1)), F.substring(fix, F.lit(2), F.length(fix)))).otherwise(fix)


_EDGES = re.compile(r"^[^\w|]+|[^\w|]+$")


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return _EDGES.sub("", token)


# ---------------------------------------------------------------- furniture


_BREAK = r"[\p{L}\p{N}][-\u00AD\u2010]\s*$|\|[-\u2010]\s*$"


def records(pages: DataFrame, images: DataFrame) -> DataFrame:
    """record_id, file, page, area (null for rows of pages), text and a hash of it; null and blank texts, and records
    without an id, file or page, are left out."""
    p = pages.select(F.col("pageId").alias("record_id"), F.col("documentId").alias("file"), F.col("pageNumber").alias("page"), F.lit(None).cast("long").alias("area"), "text")
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0).cast("long"))
    i = images.select(F.col("imageId").alias("record_id"), F.col("documentId").alias("file"), F.col("pageNumber").alias("page"), area.alias("area"), F.col("ocrText").alias("text"))
    filled = p.unionByName(i).where("record_id is not null and file is not null and page is not null").where(F.col("text").rlike(r"\S"))
    return filled.withColumn("rh", F.xxhash64("text"))


def outlines(recs: DataFrame, pages: DataFrame) -> DataFrame:
    """record_id, rh, file, page, top and end: the outer lines of each record that is a page.

    An image is a page where the table of pages lists its page without text, and of several such images the largest; others
    are figures, whose captions are no running text. Of several rows of one record the one of the least hash counts. One
    line more than can be furniture is kept at either end, so the first and last line of the text proper are among them.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(F.replace(x, F.lit("\t"), F.lit("  "))).alias("s")))
    filled = F.filter(lines, lambda x: x.s != "")
    own = recs.select("record_id", "rh", "file", "page", "area", filled.alias("f"))
    own = own.select("record_id", F.struct("rh", "file", "page", "area", F.slice("f", 1, EDGE_LINES + 1).alias("top"), F.slice(F.reverse("f"), 1, EDGE_LINES + 1).alias("end")).alias("o"))
    one = stage(own.groupBy("record_id").agg(F.min_by("o", "o.rh").alias("o")).select("record_id", "o.*"), "ocr-outlines")
    listed = pages.groupBy(F.col("documentId").alias("file"), F.col("pageNumber").alias("page")).agg(F.max(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("filled"))
    seen = one.where("area is not null").join(listed.where("not filled"), ["file", "page"])
    largest = seen.groupBy("file", "page").agg(F.max(F.struct("area", "record_id")).alias("s")).select(F.col("s.record_id").alias("record_id"))
    kept = one.where("area is null").unionByName(one.where("area is not null").join(largest, "record_id", "left_semi"))
    return kept.drop("area")


_NUM = r"([0-9lIO|o]*[0-9][0-9lIO|o]*|[lIO|]{1,3})"
_STYLES = {"page": rf"^(?i:page|seite|página|pagina)\s+{_NUM}$", "p": rf"^[pPsS]\.\s*{_NUM}$", "of": rf"^{_NUM}\s*/\s*[0-9lIO|o]+$", "dash": rf"^[-–—]\s*{_NUM}\s*[-–—]$", "square": rf"^[\[(]\s*{_NUM}\s*[\])]$", "bare": rf"^{_NUM}$", "roman": r"^(?i:([ivxlcdm1|]{1,14}))$"}


def edge_lines(outlined: DataFrame) -> DataFrame:
    """record_id, file, page, line_no, line, rank (from 0 at the nearer end) and last: the outer lines of each record."""
    side = lambda c, last: F.transform(F.slice(c, 1, EDGE_LINES), lambda x, i: F.struct(x.n.alias("n"), x.s.alias("s"), i.alias("rank"), F.lit(last).alias("last")))
    e = outlined.select("record_id", "file", "page", F.explode(F.concat(side("top", False), side("end", True))).alias("e"))
    return e.select("record_id", "file", "page", F.col("e.n").alias("line_no"), F.col("e.s").alias("line"), F.col("e.rank").alias("rank"), F.col("e.last").alias("last"))


#: Longest line that is looked at as a page number.
NUMBER_CHARS = 60


def _roman(c: Column) -> Column:
    """Value of a roman number, additive (xviiii) or with smaller letters before greater ones (xix): both readings."""
    count = lambda x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) / F.lit(len(x))
    value = sum(F.lit(v) * count(x) for x, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)))
    less = sum(F.lit(2 * v) * count(x) for x, v in (("iv", 1), ("ix", 1), ("xl", 10), ("xc", 10), ("cd", 100), ("cm", 100)))
    return F.array(value.cast("long"), (value - less).cast("long"))


def _readings(style: Column, c: Column) -> Column:
    """Numbers that a page number may stand for, given its misread digits."""
    low = F.lower(c)
    roman = F.concat(_roman(F.translate(low, "1|", "ll")), _roman(F.translate(low, "1|l", "iii")))
    return F.array_distinct(F.when(style == "roman", roman).otherwise(F.array(F.translate(c, "lI|Oo", "11100").try_cast("long"))))


def page_numbers(edges: DataFrame) -> DataFrame:
    """record_id, line_no of lines with nothing but the number of the page.

    Numbers of one style whose distance to the page's place agrees on two pages of a file are page numbers; on a page with
    numbers of several such series the one of most pages is. Without any agreement in the file, a number that is marked as
    one (p. 7, [7], - 7 -, 7 / 9, Page 7) counts, and so does a bare one that equals the page's place at its very edge.
    """
    short = edges.where((F.length("line") <= NUMBER_CHARS) & F.col("line").rlike("^(?:[^A-Za-z]|[ivxlcdmoIVXLCDMO])*$|^(?i:page|seite|página|pagina|p|s)[^A-Za-z]"))
    read = short.select("*", *[F.regexp_extract("line", pattern, 1).alias(f"_{name}") for name, pattern in _STYLES.items()])
    style = F.coalesce(*[F.when(F.col(f"_{name}") != "", F.lit(name)) for name in _STYLES])
    number = F.coalesce(*[F.when(F.col(f"_{name}") != "", F.col(f"_{name}")) for name in _STYLES])
    found = read.select("record_id", "file", "page", "line_no", "rank", style.alias("style"), number.alias("s")).where("style is not null")
    found = found.withColumn("n", F.explode(_readings(F.col("style"), F.col("s")))).where("n is not null")
    found = found.groupBy("record_id", "file", "page", "line_no", "style", "s", "n").agg(F.min("rank").alias("rank")).withColumn("shift", F.col("n") - F.col("page"))
    found = stage(found, "ocr-numbered")
    marked = ~F.col("style").isin("bare", "roman")
    series = found.groupBy("file", "style", "shift").agg(F.count_distinct("page").alias("pages"))
    series = series.select("file", "style", "shift", F.struct("pages", marked.alias("marked"), "style", "shift").alias("support"))
    judged = found.join(series, ["file", "style", "shift"])
    agreed = judged.where("support.pages >= 2")
    best = agreed.groupBy("file", "page").agg(F.max("support").alias("best"))
    taken = agreed.join(best, ["file", "page"]).where("support = best")
    lone = judged.join(agreed.select("file").distinct(), "file", "left_anti")
    lone = lone.where(marked | ((F.col("rank") == 0) & ((F.col("shift") == 0) | ((F.col("style") == "roman") & (F.length("s") > 2)))))
    return taken.select("record_id", "line_no").unionByName(lone.select("record_id", "line_no")).distinct()


def running_lines(outlined: DataFrame, numbers: DataFrame) -> DataFrame:
    """record_id, line_no of first and last lines, page numbers aside, that stand on two pages of their file or more,
    apart from shapes and numbers."""
    taken = numbers.groupBy("record_id").agg(F.collect_set("line_no").alias("nos"))
    first = lambda c: F.try_element_at(F.filter(F.slice(c, 1, EDGE_LINES), lambda x: ~F.array_contains(F.col("nos"), x.n)), F.lit(1))
    rest = outlined.join(taken, "record_id", "left").withColumn("nos", F.coalesce("nos", F.array().cast("array<int>")))
    ends = F.filter(F.array(first("top"), first("end")), lambda x: x.isNotNull())
    own = rest.select("record_id", "file", "page", F.explode(F.array_distinct(ends)).alias("l")).select("record_id", "file", "page", F.col("l.n").alias("line_no"), F.col("l.s").alias("line"))
    digits = r"(^|\s)[0-9lIO|o]*[0-9][0-9lIO|o]*(?=\s|$)|^[lIO|]{1,3}\s|\s[lIO|]{1,3}$"
    roman = r"(?i)^[ivxlcdm1|]{1,14}\s\s+|\s\s+[ivxlcdm1|]{1,14}$"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", digits, " "), roman, " "), r"[\s\p{Punct}&&[^|]]+", "")
    # staged, so that the shapes are made once
    keyed = stage(own.select("record_id", "file", "page", "line_no", skeleton_col(bare).alias("key")), "ocr-edges").where(F.length("key") >= 4)
    often = keyed.groupBy("file", "key").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last")
    return keyed.join(often, ["file", "key"]).select("record_id", "line_no").distinct()


# ---------------------------------------------------------------- words


def _proper(text: str, drop) -> list[tuple[int, str]]:
    out = set() if drop is None else set(int(x) for x in drop)
    return [(i, x) for i, x in enumerate(text.split("\n"), 1) if i not in out and x.strip()]


_STOPS = (".", "?", "!")
_HYPHENS = "-\u00AD\u2010"
_OPEN_END = re.compile(r"[^\W_][-\u00AD\u2010]\s*$|\|[-\u2010]\s*$")


def _walk(text: str, drop, after: str | None, joined: bool) -> Iterator[tuple[int, list[str], str | None, bool | None]]:
    """Lines of a record's text proper: line_no, tokens, the first token of the next line where the last token breaks off
    inside a word (that token is then left out of its own line), and whether a sentence starts with the line, if known."""
    lines = _proper(text, drop)
    skip, last_no = bool(joined), None
    for k, (no, line) in enumerate(lines):
        parts = line.split()
        start = None if last_no is not None else False
        if skip:
            parts, start = parts[1:], False
        if last_no is not None and no > last_no + 1:
            start = True
        last_no, second = no, None
        if line.rstrip()[-1:] in _HYPHENS and _OPEN_END.search(line):
            nxt = lines[k + 1][1].split()[0] if k + 1 < len(lines) else after
            c = core(nxt) if nxt is not None else None
            if c is not None and (c[:1].islower() or not c[:1].isalpha() or c.isupper()):
                second = nxt
        skip = second is not None and bool(parts)
        yield no, parts, second if parts else None, start


class _Ends(dict):
    """Whether a sentence ends with a token."""

    def __missing__(self, tok: str) -> bool:
        if len(self) > HELD_TOKENS:
            self.clear()
        v = self[tok] = tok.rstrip("\"'”’)").endswith(_STOPS)
        return v


class _Cores(dict):
    """A token without the punctuation around it, and that in small letters."""

    def __missing__(self, tok: str) -> tuple[str, str]:
        if len(self) > HELD_TOKENS:
            self.clear()
        c = core(tok)
        v = self[tok] = (c, c.lower())
        return v


def _tokens(text: str, drop, after: str | None, joined: bool, ends: dict, cores: dict) -> list[tuple]:
    """Tokens of a record's text proper: line_no, word, rest (second half of a broken word), start of a sentence, the token
    as it stands and that of the second half. Tokens of punctuation only have an empty word."""
    toks, start = [], False
    for no, parts, second, begins in _walk(text, drop, after, joined):
        start = start if begins is None else begins
        for tok in parts[:-1] if second is not None else parts:
            toks.append((no, cores[tok][0], None, start, tok, None))
            start = ends[tok]
        if second is not None:
            toks.append((no, core(parts[-1][:-1]), core(second), start, parts[-1], second))
    return toks


_FLOW = ("record_id", "text", "drop", "next_head", "joined")


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n, upper (capitals inside sentences), lower: words of the text proper, combined by the worker. The two forms of
    a broken word are listed with n = 0."""
    ends, cores = _Ends(), _Cores()
    total, begin, broken = Counter(), Counter(), set()

    def out() -> pd.DataFrame:
        rows: dict[str, list[int]] = {w: [0, 0, 0] for w in broken}
        for tok, n in total.items():
            c, w = cores[tok]
            if c:
                row = rows.setdefault(w, [0, 0, 0])
                row[0] += n
                row[1] += n - begin[tok] if c[0].isupper() else 0
                row[2] += n if c[0].islower() else 0
        total.clear(), begin.clear(), broken.clear()
        return pd.DataFrame([(w, *r) for w, r in rows.items()], columns=["word", "n", "upper", "lower"])

    for pdf in batches:
        toks: list[str] = []
        known: dict[int, bool] = {}
        for text, drop, after, joined in zip(*(pdf[c] for c in _FLOW[1:])):
            known[len(toks)] = False
            for _, parts, second, begins in _walk(text, drop, after, joined):
                if begins is not None:
                    known[len(toks)] = begins
                if second is not None:
                    one, rest = core(parts[-1][:-1]), core(second)
                    broken.update(((one + rest).lower(), (one + "-" + rest).lower()))
                    parts = parts[:-1]
                toks += parts
        total.update(toks)
        begin.update([toks[i] for i in (i for i, t in enumerate(toks[:-1], 1) if ends[t]) if i not in known])
        begin.update([toks[i] for i, b in known.items() if b and i < len(toks)])
        if len(total) + len(broken) > HELD_TOKENS:
            yield out()
    yield out()


def sieve(texts: DataFrame) -> np.ndarray:
    """Bits set at the CRC-32 of every text in a one-column DataFrame; SIEVE_BITS bound what reaches the driver."""
    at = F.pmod(F.crc32(F.col(texts.columns[0]).cast("binary")), F.lit(1 << SIEVE_BITS))
    words = texts.select(at.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v"))
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    got = words.toPandas()
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out


def _passes(bits: np.ndarray, text: str) -> bool:
    b = zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << SIEVE_BITS) - 1)
    return bool(int(bits[b >> 6]) >> (b & 63) & 1)


_HITS = "record_id string, line_no int, pos int, word string, read string, rest string, begins boolean, prev string, next string"
_DIGITS = re.compile(r"[^\W\d_].*[^\W\d_]")


def _hits(bits: np.ndarray):
    """Broken words, words with digits among their letters and words that pass the sieve, with the words beside them."""

    class Words(dict):
        """Word of a token in small letters, and whether it is handed on."""

        def __missing__(self, tok: str) -> tuple[str, bool]:
            if len(self) > HELD_TOKENS:
                self.clear()
            w = core(tok).lower()
            v = self[tok] = (w, bool(w) and (_passes(bits, w) or (any(c in "|0123456789" for c in w) and bool(_DIGITS.search(w)))))
            return v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, words = _Ends(), Words()
        names = [x.split()[0] for x in _HITS.split(", ")]
        rows: list[tuple] = []
        for pdf in batches:
            for r, text, drop, after, joined in zip(*(pdf[c] for c in _FLOW)):
                toks: list[str] = []
                lines, starts, broken = [], {}, {}
                for no, parts, second, begins in _walk(text, drop, after, joined):
                    if begins is not None:
                        starts[len(toks)] = begins
                    lines.append((len(toks), no))
                    toks += parts
                    if second is not None:
                        broken[len(toks) - 1] = (core(parts[-1][:-1]), core(second))
                seen = [words[t] for t in toks]
                hits = [i for i, w in enumerate(seen) if w[1] and i not in broken]
                if not hits and not broken:
                    continue
                low = [w for w, _ in seen]
                for i, (read, _) in broken.items():
                    low[i] = read
                filled = [i for i, w in enumerate(low) if w]
                place = dict(zip(filled, range(len(filled))))
                first = [a for a, _ in lines]
                beside = lambda k: low[filled[k]] if 0 <= k < len(filled) and filled[k] not in broken else ""
                for i in (*hits, *broken):
                    pos = place.get(i)
                    if pos is None:
                        continue
                    read, rest = broken.get(i) or (core(toks[i]), None)
                    begins = starts[i] if i in starts else ends[toks[i - 1]] if i else False
                    rows.append((r, lines[bisect_right(first, i) - 1][1], pos, low[i] if rest is None else "", read, rest, begins, beside(pos - 1), beside(pos + 1)))
            if len(rows) > HELD_ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    return run


def _bigrams(rights: np.ndarray, pairs: np.ndarray):
    """one, two, n: neighbouring words of the text proper that pass the sieve of pairs, combined by the worker."""

    class Words(dict):
        """Word of a token in small letters, and whether it passes the sieve of corrections."""

        def __missing__(self, tok: str) -> tuple[str, bool]:
            if len(self) > HELD_TOKENS:
                self.clear()
            w = core(tok).lower()
            v = self[tok] = (w, bool(w) and _passes(rights, w))
            return v

    class Pair(dict):
        def __missing__(self, p: tuple[str, str]) -> bool:
            if len(self) > HELD_TOKENS:
                self.clear()
            v = self[p] = _passes(pairs, " ".join(p))
            return v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pair = Words(), Pair()
        seen: Counter = Counter()
        gap = ("", False)

        def out() -> pd.DataFrame:
            rows = [(*p, n) for p, n in seen.items() if pair[p]]
            seen.clear()
            return pd.DataFrame(rows, columns=["one", "two", "n"])

        for pdf in batches:
            for text, drop, after, joined in zip(*(pdf[c] for c in _FLOW[1:])):
                low: list[tuple[str, bool]] = []
                for _, parts, second, _ in _walk(text, drop, after, joined):
                    low += [w for w in [words[t] for t in (parts if second is None else parts[:-1])] if w[0]]
                    if second is not None:
                        low.append(gap)
                seen.update([(a[0], b[0]) for a, b in zip(low, low[1:]) if (a[1] or b[1]) and a[0] and b[0]])
            if len(seen) > HELD_TOKENS:
                yield out()
        yield out()

    return run


def _neighbours(outline: DataFrame) -> DataFrame:
    """record_id, head, head of the next record of the file, and whether the record before breaks off inside a word.

    A file is taken in blocks of pages, each sorted on its own, and the blocks' ends are tied together, so that a file
    with a large share of all pages is no single task.
    """
    rows = outline.withColumn("block", F.floor(F.col("page") / PAGE_BLOCK).cast("int"))
    at = F.struct("page", "record_id")
    ends = rows.groupBy("file", "block").agg(F.min_by("head", at).alias("first_head"), F.max_by("open", at).alias("last_open"))
    along = Window.partitionBy("file").orderBy("block")
    ends = ends.select("file", "block", F.lead("first_head").over(along).alias("after"), F.lag("last_open").over(along).alias("before"))
    order = Window.partitionBy("file", "block").orderBy("page", "record_id")
    own = rows.select("record_id", "file", "block", "head", F.lead("head").over(order).alias("next"), F.lag("open").over(order).alias("prev"))
    tied = own.join(ends, ["file", "block"])
    return tied.select("record_id", "head", F.coalesce("next", "after").alias("next_head"), F.coalesce("prev", "before", F.lit(False)).alias("was_open"))


@F.pandas_udf(T.DoubleType())
def _cost(right: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([misreading_cost(a, b) for a, b in zip(right, read)], dtype=float)


def corrections(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, right, cost, freq): lexicon words each form may stand for, not dearer than MOST.

    forms: word, n (its own frequency). Forms and index meet on shapes, which confusions leave alike, and on spellings with
    a letter left out on either side, which any one other edit leaves alike. A price within MOST is either one of
    confusions alone, so the shapes are equal, or of one other edit; only such meetings are priced.
    """
    own, n = F.col("word"), F.greatest(F.lit(1), F.col("n"))
    index = lexicon.where("n >= 2").select(F.col("word").alias("right"), F.col("n").alias("freq"))
    enough = F.when(F.length(own) <= 3, RATIO_SHORT).when(own.rlike(r"[0-9|ﬁﬂ]"), 1).otherwise(RATIO)
    asked = forms.where(F.length(own) > 1)
    differs = (own != F.col("right")) & (F.col("freq") >= n * enough)
    alike = asked.select("word", "n", F.explode(shape_keys(own)).alias("key")).join(index.select("right", "freq", F.explode(shape_keys(F.col("right"))).alias("key")), "key").where(differs).select("word", "right", "freq")
    frequent = index.where(F.col("freq") >= RATIO_EDIT).select("right", "freq", F.explode(spelled_keys(F.col("right"))).alias("key"))
    edited = asked.where(F.length(own) >= LETTERS).select("word", "n", F.explode(spelled_keys(own)).alias("key")).join(frequent, "key")
    edited = edited.where((F.col("freq") >= n * RATIO_EDIT) & (own != F.col("right"))).select("word", "right", "freq").where(F.levenshtein("word", "right", 1) == 1)
    met = alike.unionByName(edited).distinct()
    return met.withColumn("cost", _cost("right", "word")).where(F.col("cost") <= MOST)


def repairs(pages: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Furniture (record_id, line_no, kind), words with their fix (record_id, line_no, pos, kind, fix), and the records they
    belong to with what their neighbours in the file give (file, page, text, drop, next_head, joined).

    kind is running, page_number, hyphen or misread. A broken word keeps its hyphen if the corpus writes it so elsewhere
    more often than as one word. Files of one page have no running line. Repeated rows of one record count once.
    """
    recs = spread(records(pages, images))
    outlined = stage(outlines(recs, pages), "ocr-pages")
    edges = edge_lines(outlined)
    numbers = stage(page_numbers(edges), "ocr-numbers")
    running = stage(running_lines(outlined, numbers), "ocr-running")
    furniture = numbers.withColumn("kind", F.lit("page_number")).unionByName(running.withColumn("kind", F.lit("running")))
    drop = furniture.groupBy("record_id").agg(F.collect_set("line_no").alias("drop"))
    own = outlined.join(drop, "record_id", "left").withColumn("_d", F.coalesce("drop", F.array().cast("array<int>")))
    inner = F.filter(F.concat("top", "end"), lambda x: ~F.array_contains(F.col("_d"), x.n))
    own = own.withColumn("_in", inner).where(F.size("_in") > 0)
    head, last = F.regexp_extract(F.array_min("_in").s, r"(\S+)", 1), F.array_max("_in").s
    own = stage(own.select("record_id", "rh", "file", "page", "drop", head.alias("head"), last.rlike(_BREAK).alias("open")), "ocr-own")
    turns = _neighbours(own)
    lower = F.regexp_replace("head", r"^[^\p{L}\p{N}|]+", "")
    joined = F.col("was_open") & (lower.rlike(r"^[\p{Ll}0-9|]") | (F.upper(lower) == lower))
    info = own.select("record_id", "rh", "file", "page", "drop").join(turns.select("record_id", "next_head", joined.alias("joined")), "record_id")
    flow = recs.select("record_id", "rh", "text").join(info, ["record_id", "rh"]).dropDuplicates(["record_id", "rh"])
    flow = stage(flow.select("record_id", "file", "page", "text", "drop", "next_head", "joined"), "ocr-flow")

    read = spread(flow.select(*_FLOW))
    counted = read.mapInPandas(_count_words, "word string, n bigint, upper bigint, lower bigint").groupBy("word")
    counts = stage(counted.agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower")), "ocr-counts")
    spelled = F.col("word").rlike(r"^[\p{L}][\p{L}'’\-]*$")
    lexicon = counts.where(spelled & (F.col("n") > 0))
    letters = F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^\p{L}-[0-9]+$")
    known = stage(corrections(counts.select("word", F.when(spelled, F.col("n")).otherwise(0).alias("n")).where(letters), lexicon), "ocr-corrections")
    words = stage(read.mapInPandas(_hits(sieve(known.select("word"))), _HITS), "ocr-words")
    plain, broken = words.where("rest is null"), words.where("rest is not null").withColumn("one", F.lower(F.concat("read", "rest"))).withColumn("two", F.lower(F.concat("read", F.lit("-"), "rest")))

    # misread words: where there is a choice, the cheapest correction, then wording around it, then frequency
    many = known.groupBy("word").agg(((F.count(F.lit(1)) > 1) | (F.max("cost") >= EDIT)).alias("choice"))
    options = plain.join(known.join(many, "word"), "word").select("record_id", "line_no", "pos", "read", "begins", "prev", "next", "right", "cost", "freq", "choice")
    options = stage(options, "ocr-options")
    chosen = options.where("choice")
    sides = chosen.where("prev <> ''").select(F.col("prev").alias("one"), F.col("right").alias("two")).unionByName(chosen.where("next <> ''").select(F.col("right").alias("one"), F.col("next").alias("two")))
    asked = sieve(chosen.select("right")), sieve(sides.select(F.concat_ws(" ", "one", "two").alias("p")))
    pairs = stage(read.mapInPandas(_bigrams(*asked), "one string, two string, n bigint").groupBy("one", "two").agg(F.sum("n").alias("n")), "ocr-bigrams")
    scored = chosen.join(pairs.select(F.col("one").alias("prev"), F.col("two").alias("right"), F.col("n").alias("m1")), ["prev", "right"], "left")
    scored = scored.join(pairs.select(F.col("one").alias("right"), F.col("two").alias("next"), F.col("n").alias("m2")), ["right", "next"], "left")
    told = lambda m: F.when(F.col(m) > 1, F.log1p(m)).otherwise(0.0)
    # an edit that is no confusion stands only where the corpus has the correction between these two words
    scored = scored.where((F.col("cost") < EDIT) | ((F.col("m1") > 1) & (F.col("m2") > 1)))
    score = -8.0 * F.col("cost") + told("m1") + told("m2") + 0.5 * F.log(F.col("freq").cast("double"))
    spot = ["record_id", "line_no", "pos"]
    best = scored.groupBy(*spot).agg(F.max_by(F.struct("read", "right", "begins"), F.struct(score, "right")).alias("b")).select(*spot, "b.read", "b.right", "b.begins")
    best = best.unionByName(options.where("not choice").select(*spot, "read", "right", "begins"))
    mended = best.join(lexicon.select(F.col("word").alias("right"), (F.col("upper") > F.col("lower")).alias("name")), "right", "left")
    mended = mended.select(*spot, in_case_of(F.col("right"), F.col("read"), F.col("begins") | F.coalesce("name", F.lit(False))).alias("fix"))
    # words with digits among their letters that no lexicon word explains
    rest = plain.where(F.col("word").rlike(r"[0-9|]")).join(many.select("word"), "word", "left_anti").withColumn("right", unread(F.col("word")))
    spelt = rest.where("right is not null").select(*spot, in_case_of(F.col("right"), F.col("read"), F.col("begins")).alias("fix"))
    misread = mended.unionByName(spelt).select(*spot, F.lit("misread").alias("kind"), "fix")

    # broken words: as written elsewhere, each form possibly misread
    sure = known.where(F.col("cost") < EDIT)
    top = sure.groupBy("word").agg(F.max_by(F.struct("right", "freq"), F.struct(-F.col("cost"), "freq", "right")).alias("t")).select("word", F.col("t.right").alias("right"), F.col("t.freq").alias("freq"))
    halves = broken
    for form in ("one", "two"):
        count = lexicon.select(F.col("word").alias(form), F.col("n").alias(f"{form}_n"))
        repair = top.select(F.col("word").alias(form), F.col("right").alias(f"{form}_right"), F.col("freq").alias(f"{form}_freq"))
        halves = halves.join(count, form, "left").join(repair, form, "left")
    weight = lambda f: F.coalesce(f"{f}_freq", f"{f}_n", F.lit(0))
    hyphened = weight("two") > weight("one")
    fix = F.when(hyphened, F.coalesce("two_right", "two")).otherwise(F.coalesce(F.col("one_right"), unread(F.col("one")), F.col("one")))
    as_read = F.when(hyphened, F.concat("read", F.lit("-"), "rest")).otherwise(F.concat("read", "rest"))
    hyphen = halves.select(*spot, F.lit("hyphen").alias("kind"), in_case_of(fix, as_read, F.col("begins")).alias("fix"))
    return furniture, hyphen.unionByName(misread), flow


def findings(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(record_id, line_no, kind, fix) for running lines, page numbers, broken words and misread words."""
    furniture, fixes, _ = repairs(pages, images)
    found = furniture.select("record_id", "line_no", "kind", F.lit("").alias("fix")).unionByName(fixes.drop("pos"))
    return found.distinct()


# ---------------------------------------------------------------- paragraphs

#: How a piece of a paragraph ends: with a sentence, inside one, or as a heading.
CLOSED, OPEN, HEADING = 1, 2, 3
#: A single line without a sentence's end is a heading if numbered or shorter than this share of its page's longest line.
SHORT_LINE = 0.6
_NUMBERED = re.compile(r"(\d+\.)+\d*\s+\S")


def mended(read: str, rest: str | None, token: str, second: str | None, fix: str | None) -> str:
    """A token with its word replaced by the fix, the punctuation around it kept; a broken word is put together."""
    if second is None:
        return token if fix is None else token.replace(read, fix, 1)
    at = token.find(read)
    return token[:at] + (read + rest if fix is None else fix) + second[second.rfind(rest) + len(rest) :]


def record_pieces(text: str, drop, after: str | None, joined: bool, fixes: dict[int, str]) -> list[tuple[str, int, bool]]:
    """(text, how it ends, begins in lower case) of each piece of a paragraph in one record.

    Pieces part at blank lines, and at a line set in further than the one before it where a sentence ends; never inside a
    broken word.
    """
    lines, kept = text.split("\n"), dict(_proper(text, drop))
    longest = max((len(x.strip()) for x in kept.values()), default=0)
    pieces: list[tuple[list[str], set[int]]] = []
    pos, last, broken = 0, None, False
    for no, read, rest, _, token, second in _tokens(text, drop, after, joined, _Ends(), _Cores()):
        part = last is None
        if last is not None and no > last and not broken:
            dent = [len(lines[n - 1].expandtabs()) - len(lines[n - 1].expandtabs().lstrip()) for n in (last, no)]
            blank = any(not x.strip() for x in lines[last : no - 1])
            part = blank or (dent[1] > dent[0] and pieces[-1][0][-1].rstrip("\"'”’)»").endswith(_STOPS))
        if part:
            pieces.append(([], set()))
        last, broken = no, second is not None
        pieces[-1][0].append(mended(read, rest, token, second, fixes.get(pos)) if read else token)
        pieces[-1][1].add(no)
        pos += bool(read)
    out = []
    for words, at in pieces:
        end = CLOSED if words[-1].rstrip("\"'”’)»").endswith((*_STOPS, ":")) else OPEN
        line = kept[min(at)].strip()
        if end == OPEN and len(at) == 1 and (_NUMBERED.match(line) or len(line) < SHORT_LINE * longest):
            end = HEADING
        out.append((" ".join(words), end, core(words[0])[:1].islower()))
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["record_id", "file", "page", "piece", "text", "ends", "small", "joined"]
    for pdf in batches:
        rows = []
        for r, f, p, text, drop, after, joined, fixes in zip(*(pdf[c] for c in ("record_id", "file", "page", "text", "drop", "next_head", "joined", "fixes"))):
            known = {} if fixes is None else {x["pos"]: x["fix"] for x in fixes}
            for k, (t, ends, small) in enumerate(record_pieces(text, drop, after, bool(joined), known), 1):
                rows.append((r, f, p, k, t, ends, small, bool(joined)))
        yield pd.DataFrame(rows, columns=names)


def tied_pieces(pieces: DataFrame) -> DataFrame:
    """pieces with `start`: page, record and number of the piece that their paragraph starts with.

    The first piece of a record goes on with the last one before it in the file where that one breaks off inside a word or
    a sentence, or where it begins in lower case; headings stand alone. A file is taken in blocks of pages and the blocks'
    ends are tied together.
    """
    rows = pieces.withColumn("block", F.floor(F.col("page") / PAGE_BLOCK).cast("int")).withColumn("at", F.struct("page", "record_id", "piece"))
    along = Window.partitionBy("file").orderBy("block")
    ends = rows.groupBy("file", "block").agg(F.max_by("ends", "at").alias("e")).select("file", "block", F.lag("e").over(along).alias("before"))
    order = Window.partitionBy("file", "block").orderBy("at")
    own = rows.withColumn("prev", F.lag("ends").over(order)).join(ends, ["file", "block"]).withColumn("prev", F.coalesce("prev", "before"))
    goes_on = (F.col("piece") == 1) & F.col("prev").isNotNull() & (F.col("joined") | ((F.col("prev") == OPEN) & (F.col("ends") != HEADING)) | ((F.col("prev") != HEADING) & F.col("small")))
    own = own.withColumn("own_start", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("at")))
    starts = own.groupBy("file", "block").agg(F.max("own_start").alias("s"))
    starts = starts.select("file", "block", F.last("s", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("start_before"))
    within = F.last("own_start", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tied = own.withColumn("w", within).join(starts, ["file", "block"])
    return tied.select("file", "page", "record_id", "piece", "text", F.coalesce("w", "start_before").alias("start"))


def paragraphs(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(file, first_page, record_id, piece, last_page, text): the paragraphs of each file without furniture, with broken
    words joined and misread words mended, over all pages. record_id and piece tell where a paragraph starts; in the order
    of first_page, record_id, piece they are the file's text.
    """
    _, fixes, flow = repairs(pages, images)
    by_record = fixes.groupBy("record_id").agg(F.collect_list(F.struct("pos", "fix")).alias("fixes"))
    own = spread(flow.join(by_record, "record_id", "left")).select("record_id", "file", "page", "text", "drop", "next_head", "joined", "fixes")
    pieces = own.mapInPandas(_pieces, "record_id string, file string, page int, piece int, text string, ends int, small boolean, joined boolean")
    tied = tied_pieces(stage(pieces, "ocr-pieces"))
    flowing = tied.groupBy("file", "start").agg(F.max("page").alias("last_page"), F.sort_array(F.collect_list(F.struct("page", "record_id", "piece", "text"))).alias("p"))
    return flowing.select("file", F.col("start.page").alias("first_page"), F.col("start.record_id").alias("record_id"), F.col("start.piece").alias("piece"), "last_page", F.array_join(F.transform("p", lambda x: x.text), " ").alias("text"))
