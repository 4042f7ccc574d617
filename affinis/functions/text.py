"""Normalisation, tokens, shingles and other scalar functions on text columns.

Every function takes and gives a Column; a null or empty text gives an empty string, array or zero, as stated.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.words import BOILERPLATE, STOP_WORDS

_NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC form. Only texts with non-ASCII characters reach Python; the others are their own form."""
    return F.coalesce(_nfkc(F.when(c.rlike(_NON_ASCII), c)), c)


def normalized(c: Column, compatible: bool = True) -> Column:
    """Canonical text for comparison: NFKC, lower case, LF line ends, no zero-width characters, blanks squeezed, lines
    trimmed, at most one empty line in a row. Null gives ''. compatible=False leaves out NFKC."""
    t = F.lower(nfkc(c) if compatible else c)
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[​-‍﻿]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t\f\x0B]+|[ \t\f\x0B]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.coalesce(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def normalized_hash(c: Column, compatible: bool = True) -> Column:
    return F.sha2(normalized(c, compatible), 256)


def tokens(c: Column, compatible: bool = True) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; other characters, accented letters included, separate."""
    t = F.lower(nfkc(c) if compatible else c)
    return F.coalesce(F.filter(F.split(t, "[^a-z0-9]+"), lambda x: x != ""), F.array().cast("array<string>"))


def sentence_tokens(c: Column, compatible: bool = True) -> Column:
    """Tokens longer than one character."""
    return F.filter(tokens(c, compatible), lambda x: F.length(x) > 1)


def shingles(toks: Column, k: int = 5, short_as_one: bool = True) -> Column:
    """Distinct runs of k tokens; fewer tokens give one run of all, or none with short_as_one=False."""
    n = F.size(toks)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(toks, i, k), " "))
    short = F.array(F.array_join(toks, " ")) if short_as_one else F.array().cast("array<string>")
    out = F.when(n >= k, F.array_distinct(runs)).when(n > 0, short)
    return F.coalesce(out, F.array().cast("array<string>")) if k > 0 else F.array().cast("array<string>")


def texts_identical(a: Column, b: Column) -> Column:
    """Neither text empty, and equal in canonical form or in the sequence of tokens."""
    na, nb = normalized(a), normalized(b)
    ta, tb = F.array_join(tokens(a), " "), F.array_join(tokens(b), " ")
    return (na != "") & (nb != "") & ((na == nb) | ((ta == tb) & (ta != "")))


def content_tokens(toks: Column) -> Column:
    """Tokens that are no stop words, repeats kept."""
    return F.filter(toks, lambda x: ~x.isin(*STOP_WORDS))


def is_boilerplate(sentence: Column) -> Column:
    """A generic heading: known as a whole, or up to three content words that are each known headings.

    A sentence of stop words alone has no content word and counts as a heading.
    """
    clean = F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s]", ""))
    content = content_tokens(sentence_tokens(sentence))
    joined = (F.size(content) <= 2) & F.array_join(content, " ").isin(*BOILERPLATE)
    each = (F.size(content) <= 3) & F.forall(content, lambda x: x.isin(*BOILERPLATE))
    return F.coalesce(clean.isin(*BOILERPLATE) | joined | each, F.lit(False))


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding on the binary value."""
    m = float(10**digits)
    return F.floor(x * F.lit(m) + F.lit(0.5)).cast("double") / F.lit(m)


def score01(c: Column) -> Column:
    """Score on the scale 0..1; values above 1.001 are percentages."""
    return F.when(c > 1.001, c / 100.0).otherwise(c)


def is_exact_score(c: Column) -> Column:
    """Number or text within .0001 of 1, or within .01 of 100; anything else, null included, is false."""
    x = c.cast("string").try_cast("double")
    return F.coalesce(x.between(0.9999, 1.0001) | x.between(99.99, 100.01), F.lit(False))


def classification(average: Column) -> Column:
    return F.when(average.isNull(), "No Data").when(average >= 70, "High Similarity").when(average >= 40, "Moderate Similarity").otherwise("Low Similarity")


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.coalesce(c, F.lit(""))


_WORD = re.compile(r"(\b[a-zA-Z0-9]+\b)")


def highlight_text(text: str | None, words: list[str] | None) -> str:
    """HTML of a passage, its matched words marked; stop words and everything else only escaped."""
    wanted = {w.lower() for w in words or [] if w and w.lower() not in STOP_WORDS}
    safe = lambda s: html.escape(s).replace("&#x27;", "&#039;")
    parts = _WORD.split(text or "")
    return "".join(f'<mark class="passage-highlight">{safe(p)}</mark>' if p.lower() in wanted else safe(p) for p in parts)


@F.pandas_udf(T.StringType())
def highlighted(text: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([highlight_text(t, None if w is None else list(w)) for t, w in zip(text, words)])


def contains_literal(c: Column, query: str) -> Column:
    """Case-insensitive literal search; a blank query matches everything."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))


def printable(c: Column) -> Column:
    """Text without control characters, '--' if nothing is left."""
    t = F.trim(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.when(t != "", t).otherwise("--")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_")


def cell_value(c: Column) -> Column:
    """Canonical table cell: lower case, squeezed blanks, numbers to four decimals without trailing zeros."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    number = F.when(t.rlike(r"^[-+]?[0-9]*\.?[0-9]+(e[-+]?[0-9]+)?$"), t.try_cast("double"))
    tidy = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.floor(F.abs(number) * 10000.0 + 0.5) / 10000.0), r"0+$", ""), r"\.$", "")
    return F.when(number.isNotNull(), F.concat(F.when((number < 0) & (tidy != "0"), "-").otherwise(""), tidy)).otherwise(t)


def ocr_text(c: Column) -> Column:
    """Recognised text with LF line ends, blanks squeezed, at most one empty line in a row."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def ocr_accepted(text: Column, confidence: Column) -> Column:
    """Recognised text is dropped when its confidence is below 30 and it has fewer than 5 words."""
    words = F.size(F.filter(F.split(ocr_text(text), r"\s+"), lambda x: x != ""))
    return ~((confidence < 30) & (words < 5))


def white_space_tokens(c: Column) -> Column:
    """Pieces between runs of white space; leading or trailing white space adds an empty piece."""
    return F.coalesce(F.size(F.split(c, r"\s+", -1)), F.lit(0))
