"""Detection, normalisation and comparison of program code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinis.functions.text import rounded
from affinis.functions.words import CODE_KEYWORDS

# Lines that every assignment has.
_GIVEN = (
    r"#include\s*<.*>", r"using\s+namespace\s+std\s*;?", r"int\s+main\s*\([^)]*\)\s*\{?", r"return\s+0\s*;?", r"public\s+class\s+\w+\s*\{?",
    r"public\s+static\s+void\s+main\s*\([^)]*\)\s*\{?", r"from\s+\w+\s+import\s+\w+", r"import\s+\w+",
)
_GIVEN_LINE = "(?i)^(?:" + "|".join(_GIVEN) + ")$"
_NO_STRINGS = "array<string>"


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def detection(c: Column) -> Column:
    """STRUCT<is_code, confidence, keywords>: points for keywords, semicolons, brackets and operators, 45 make code."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![a-z0-9_])[a-z_][a-z0-9_]*(?![a-z0-9_])"), F.lit(0))
    known = F.size(F.array_distinct(F.filter(words, lambda w: w.isin(*CODE_KEYWORDS))))
    semicolons, brackets, operators = _count(c, ";"), _count(c, r"[{}\[\]()]"), _count(c, r"[=+\-*/<>!&|]=?")
    point = lambda test, n: F.when(test, n).otherwise(0)
    score = point(known >= 3, 35) + point(known >= 6, 25) + point(semicolons >= 2, 15) + point(brackets >= 4, 15) + point(operators >= 3, 10)
    filled = c.isNotNull() & c.rlike(r"\S")
    is_code = filled & ((score >= 45) | ((known >= 4) & (brackets >= 2)))
    return F.struct(F.coalesce(is_code, F.lit(False)).alias("is_code"), F.when(filled, score).otherwise(0).alias("confidence"), F.when(filled, known).otherwise(0).cast("long").alias("keywords"))


def normalized_lines(c: Column) -> Column:
    """Lines of code without comments and given lines, white space squeezed; none if only brackets are left.

    A # begins a comment unless a letter follows it or #include stands before it on the line.
    """
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"/\*[\s\S]*?\*/", "")
    lines = F.transform(F.split(F.regexp_replace(t, r"//[^\n]*", ""), "\n"), lambda x: F.when(F.contains(x, F.lit("#include")), _before_include(x)).otherwise(F.regexp_replace(x, r"#(?![a-zA-Z]).*", "")))
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    kept = F.filter(tidy, lambda x: (x != "") & ~x.rlike(_GIVEN_LINE))
    return F.when(F.exists(kept, lambda x: ~x.rlike(r"^[{}();,\s]+$")), kept).otherwise(F.array().cast(_NO_STRINGS))


def _before_include(x: Column) -> Column:
    """A line with #include: only what stands before it can be cut as a comment, and then #include goes as well."""
    head = F.regexp_extract(x, r"^(.*?)#include", 1)
    return F.when(head.rlike(r"#(?![a-zA-Z])"), F.regexp_replace(head, r"#(?![a-zA-Z]).*", "")).otherwise(x)


def code_tokens(lines: Column, abstract: bool = False) -> Column:
    """Tokens of normalised lines, symbols apart; abstract turns names into ID."""
    t = F.regexp_replace(F.array_join(lines, "\n"), r"([{}()\[\];,.=+\-*/<>!&|])", " $1 ")
    toks = F.filter(F.split(F.lower(t), r"\s+"), lambda x: x != "")
    if not abstract:
        return toks
    return F.transform(toks, lambda x: F.when(x.isin(*CODE_KEYWORDS) | x.rlike(r"^[0-9]+$") | x.rlike(r"^[^\w\s]$"), x).otherwise("ID"))


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def score_of(ta: Column, tb: Column, xa: Column, xb: Column) -> Column:
    """0.6 of the similarity is that of the tokens, 0.4 that of the tokens with names abstracted; not rounded."""
    return 0.6 * _jaccard(ta, tb) + 0.4 * _jaccard(xa, xb)


def similarity_of(ta: Column, tb: Column, score: Column) -> Column:
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), rounded(F.least(score, F.lit(1.0)), 4)).otherwise(0.0)


def matching_lines(la: Column, lb: Column, ta: Column, tb: Column, score: Column) -> Column:
    """Evidence: the first 10 lines longer than 5 characters that both have, or, if none and the similarity is 0.5 or more,
    lines of a with a line of equal abstract tokens, three or more, in b."""
    shape = lambda line: code_tokens(F.array(line), True)
    equal = F.filter(la, lambda x: (F.length(x) > 5) & F.array_contains(lb, x))
    shapes = F.transform(lb, lambda y: F.array_join(shape(y), " "))
    alike = F.filter(la, lambda x: (F.size(shape(x)) >= 3) & F.array_contains(shapes, F.array_join(shape(x), " ")))
    none = F.array().cast(_NO_STRINGS)
    lines = F.when(F.size(equal) > 0, equal).when(score >= 0.5, alike).otherwise(none)
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.slice(lines, 1, 10)).otherwise(none)


def comparison(a: Column, b: Column) -> Column:
    """STRUCT<similarity, matching_lines, tokens_a, tokens_b> of two code columns."""
    la, lb = normalized_lines(a), normalized_lines(b)
    ta, tb = code_tokens(la), code_tokens(lb)
    both = (F.size(ta) > 0) & (F.size(tb) > 0)
    score = score_of(ta, tb, code_tokens(la, True), code_tokens(lb, True))
    return F.struct(similarity_of(ta, tb, score).alias("similarity"), matching_lines(la, lb, ta, tb, score).alias("matching_lines"), F.when(both, F.size(ta)).otherwise(0).alias("tokens_a"), F.when(both, F.size(tb)).otherwise(0).alias("tokens_b"))
