"""Every two sets that overlap above a threshold too low for prefixes to tell sets apart, counted in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.runtime import stage

#: Sets of a tile and their values, on average; two tiles are compared whole.
TILE, VALUES = 16384, 1 << 21
#: Counters, and values met, of one step.
COUNTERS, MET = 1 << 20, 1 << 22
#: Pairs that a task holds before it hands them on.
HELD = 1 << 18


def _tile(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Idents, sizes and values of the sets of a tile."""
    lists = rows.values.field(1)
    return rows.values.field(0).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()


def _alike(x: pa.ListScalar, y: pa.ListScalar, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Idents of every two sets, one of each tile, whose counted overlap reaches the threshold; of one tile, each two once."""
    (ia, na, va), (ib, nb, vb) = _tile(x), _tile(y)
    order = np.argsort(vb)
    rows, vb, width = np.repeat(np.arange(len(nb)), nb)[order], vb[order], len(nb)
    low = np.searchsorted(vb, va, "left")
    runs = np.searchsorted(vb, va, "right") - low
    ends = np.concatenate([[0], np.cumsum(na)])
    met = np.concatenate([[0], np.cumsum(runs)])[ends]
    first = 0
    while first < len(na):
        # as many sets of the left tile as the counters and the values met allow, one at least
        last = min(first + max(1, COUNTERS // width), int(np.searchsorted(met, met[first] + MET, "right")) - 1)
        last = max(first + 1, last)
        at, size = slice(ends[first], ends[last]), na[first:last]
        run = runs[at]
        places = np.repeat(low[at] - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        counters = np.repeat(np.repeat(np.arange(last - first) * width, size), run) + rows[places]
        shared = np.bincount(counters, minlength=(last - first) * width).reshape(-1, width)
        # an overlap is the threshold's share of the larger set at least
        i, j = np.nonzero(shared >= np.maximum(np.ceil(size * threshold - 1e-9), 1)[:, None])
        both = shared[i, j]
        kept = both >= (size[i] + nb[j] - both) * threshold - 1e-9
        if same:
            kept &= i + first < j
        yield ia[first:last][i[kept]], ib[j[kept]]
        first = last


def _counted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, x, y in zip(batch.column("same"), batch.column("x"), batch.column("y")):
                held, n = [], 0
                for found in _alike(x, y, same.as_py(), threshold):
                    held.append(found)
                    n += len(found[0])
                    if n >= HELD:
                        yield _pairs(held)
                        held, n = [], 0
                if n:
                    yield _pairs(held)

    return run


def _pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(side), pa.int64()) for side in zip(*held)], ["x", "y"])


def overlapping(sets: DataFrame, ident: str, values: str, threshold: float, tile: int = TILE, most: int = VALUES) -> DataFrame:
    """(x, y): every two idents whose sets have intersection / union >= threshold > 0, each two once, in either order.

    ident: long, unique; values: arrays of distinct values. Copies are pairs like all others. At a low threshold prefixes
    hold most of a set, so whole sets are counted: their values as 32-bit hashes, two of which may be equal by chance. Such
    a chance adds to an overlap and never takes from it, so no pair is missed, and who needs the similarity itself
    judges the pair by its sets. The time grows with the values that every two sets share and, by a counter for every
    two sets, with their square; what moves is a copy of each tile for every other.
    """
    if not threshold > 0:
        raise ValueError(f"a threshold of {threshold} would pair every two sets")
    own = sets.where(F.size(values) > 0).select(F.col(ident).alias("i"), F.transform(values, lambda v: F.hash(v)).alias("v"))
    held = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()
    n = max(1, -(-held["n"] // tile), -(-held["values"] // most))
    tiles = stage(own.groupBy(F.pmod(F.xxhash64("i"), F.lit(n)).cast("int").alias("_b")).agg(F.collect_list(F.struct("i", "v")).alias("x")), "set-tiles")
    met = tiles.join(tiles.select(F.col("_b").alias("_c"), F.col("x").alias("y")), F.col("_b") <= F.col("_c"))
    # a task for every few pairs of tiles, since a batch holds all of a task's
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism * 2, n * (n + 1) // 4)
    return met.select((F.col("_b") == F.col("_c")).alias("same"), "x", "y").repartition(tasks).mapInArrow(_counted(threshold), "x long, y long")
