"""Tables: reading them from word-processor markup and comparing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinis.functions.text import cell_value, rounded


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def from_markup(xml: Column) -> Column:
    """ARRAY<STRUCT<tableIndex, rowCount, colCount, rows>> of the tables in WordprocessingML.

    Rows of empty cells are dropped and tables without a row left out; tableIndex counts the dropped ones too.
    """
    text = lambda cell: F.trim(F.array_join(F.transform(_all(cell, r"<w:t(?:\s[^>]*)?>[\s\S]*?</w:t>"), lambda t: F.regexp_replace(t, r"<[^>]+>", "")), " "))
    cells = lambda row: F.transform(_all(row, r"<w:tc[\s>][\s\S]*?</w:tc>"), text)
    rows = lambda tbl: F.filter(F.transform(_all(tbl, r"<w:tr[\s>][\s\S]*?</w:tr>"), cells), lambda r: F.exists(r, lambda c: c != ""))
    found = F.transform(_all(F.coalesce(xml, F.lit("")), r"<w:tbl[\s>][\s\S]*?</w:tbl>"), lambda t, i: F.struct((i + 1).alias("i"), rows(t).alias("r")))
    shaped = F.transform(found, lambda x: F.struct(x.i.alias("tableIndex"), F.size(x.r).alias("rowCount"), F.array_max(F.transform(x.r, lambda r: F.size(r))).alias("colCount"), x.r.alias("rows")))
    return F.filter(shaped, lambda t: t.rowCount > 0)


def as_text(tables: Column) -> Column:
    """Tables as text after a heading: a line for each row, cells apart by a blank, tables by an empty line; '' without any."""
    lines = F.transform(tables, lambda t: F.array_join(F.transform(t.rows, lambda r: F.array_join(r, " ")), "\n"))
    return F.when(F.size(tables) > 0, F.concat(F.lit("\n\n[Table Data]:\n"), F.array_join(lines, "\n\n"))).otherwise("")


def comparison(a: Column, b: Column) -> Column:
    """STRUCT<similarity, matching_cells, matching_rows> of two tables: 0.3 shape, 0.7 shared distinct cells.

    matching_rows are the first five rows of a, longer than 3 characters when joined, that b has too.
    """
    ratio = lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(1.0)
    values = lambda t: F.array_distinct(F.filter(F.transform(F.flatten(t.rows), cell_value), lambda c: c != ""))
    joined = lambda r: F.array_join(F.transform(r, cell_value), " | ")
    va, vb = values(a), values(b)
    shared = F.size(F.array_intersect(va, vb))
    shape = (ratio(a.rowCount, b.rowCount) + ratio(a.colCount, b.colCount)) / 2
    theirs = F.transform(b.rows, joined)
    rows = F.slice(F.filter(a.rows, lambda r: (F.length(joined(r)) > 3) & F.array_contains(theirs, joined(r))), 1, 5)
    both = (F.size(va) > 0) & (F.size(vb) > 0)
    score = rounded(F.least(F.lit(1.0), 0.3 * shape + 0.7 * shared / F.size(F.array_union(va, vb))), 4)
    return F.struct(F.when(both, score).otherwise(0.0).alias("similarity"), F.when(both, shared).otherwise(0).alias("matching_cells"), F.when(both, rows).alias("matching_rows"))


def best_of(tables_a: Column, tables_b: Column, least: float = 0.35) -> Column:
    """STRUCT<similarity, matches>: the highest similarity of any two tables, and the pairs at `least` or above."""
    pairs = F.flatten(F.transform(tables_a, lambda x: F.transform(tables_b, lambda y: F.struct(x.tableIndex.alias("tableAIndex"), y.tableIndex.alias("tableBIndex"), comparison(x, y).alias("c")))))
    top = F.coalesce(F.array_max(F.transform(pairs, lambda p: p.c.similarity)), F.lit(0.0))
    kept = F.transform(F.filter(pairs, lambda p: p.c.similarity >= least), lambda p: F.struct(p.tableAIndex, p.tableBIndex, p.c.similarity.alias("similarity")))
    return F.struct(top.alias("similarity"), kept.alias("matches"))
