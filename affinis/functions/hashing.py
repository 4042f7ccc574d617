"""FNV-1a hashes, permutation coefficients and MinHash signatures."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a constants, the prime above 2**32, the seed of the coefficients and the largest 32-bit number.
FNV_OFFSET, FNV_PRIME, MODULUS, SEED, EMPTY = 2166136261, 16777619, 4294967311, 0x5A17C0DE, 0xFFFFFFFF


def fnv1a32(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes of a text, 32 bits; null for null. ASCII texts are hashed inside the engine."""
    plain = F.aggregate(F.split(c, ""), F.lit(FNV_OFFSET), lambda h, x: F.when(x == "", h).otherwise((h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(EMPTY))))
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _fnv_texts(F.when(wide, c))).otherwise(plain)


@F.pandas_udf(T.LongType())
def _fnv_texts(texts: pd.Series) -> pd.Series:
    known = texts.notna().to_numpy()
    out = pd.Series([None] * len(texts), index=texts.index, dtype="Int64")
    out[known] = fnv_batch(list(texts[known])).astype(np.int64)
    return out


def _mulberry32(seed: int):
    """The public Mulberry32 generator, as 32-bit integers."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        z = ((state ^ (state >> 15)) * (state | 1)) & mask
        z = (z ^ (z + (((z ^ (z >> 7)) * (z | 61)) & mask))) & mask
        yield z ^ (z >> 14)


@cache
def coefficients(permutations: int, seed: int = SEED) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Multipliers, made odd, and offsets of the permutations."""
    draw = _mulberry32(seed)
    pairs = [(next(draw) | 1, next(draw)) for _ in range(permutations)]
    return tuple(a for a, _ in pairs), tuple(b for _, b in pairs)


def fnv_batch(words: list[str]) -> np.ndarray:
    """FNV-1a of many UTF-8 texts."""
    raw = [w.encode() for w in words]
    return fnv_runs(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))


def fnv_runs(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a of runs of bytes that lie one after the other, column by column over runs sorted by length."""
    h = np.full(len(size), FNV_OFFSET, np.uint64)
    order = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[order]
    live = size[order]
    for i in range(int(live[0]) if len(live) else 0):
        n = int(np.searchsorted(-live, -i, side="left"))
        o = order[:n]
        h[o] = ((h[o] ^ data[first[:n] + i].astype(np.uint64)) * np.uint64(FNV_PRIME)) & np.uint64(EMPTY)
    return h


def signatures_of(sets: list[list[str] | None], permutations: int, clamped: bool = True) -> np.ndarray:
    """A row of minima for each set of texts; an empty or null set has EMPTY everywhere. clamped=False leaves minima above
    EMPTY as they are."""
    known = [s if s is not None else [] for s in sets]
    return _minima(fnv_batch([w for s in known for w in s]), np.array([len(s) for s in known], np.int64), permutations, clamped)


def _minima(hashes: np.ndarray, sizes: np.ndarray, permutations: int, clamped: bool) -> np.ndarray:
    a, b = (np.array(x, np.uint64) for x in coefficients(permutations))
    out = np.full((len(sizes), permutations), EMPTY, np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    starts = (np.cumsum(sizes) - sizes)[filled]
    for p in range(permutations):
        least = np.minimum.reduceat((hashes * a[p] + b[p]) % np.uint64(MODULUS), starts)
        out[filled, p] = np.minimum(least, np.uint64(EMPTY)) if clamped else least
    return out


def minhash(c: Column, permutations: int = 128, clamped: bool = True) -> Column:
    """MinHash signature of an array of shingles, ARRAY<BIGINT>; clamped to 32 bits or not."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sign(sets: pa.Array) -> pa.Array:
        # straight from the batch's bytes: as Python texts, a batch of long sets takes several times its size
        out = [np.empty((0, permutations), np.int64)]
        for lo in range(0, len(sets), 512):
            part = sets.slice(lo, 512)
            words = part.flatten().cast(pa.large_binary())
            if words.null_count:
                raise ValueError("a shingle is null")
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
            data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
            sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out.append(_minima(fnv_runs(data, np.diff(ends)), sizes, permutations, clamped).astype(np.int64))
        flat = np.concatenate(out).ravel()
        return pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * permutations, pa.array(flat))

    return sign(c)


def estimated_similarity(a: Column, b: Column, equal_lengths: bool = False) -> Column:
    """Share of equal values over the shorter signature; 0.0 where either is null or empty, and with equal_lengths where
    they differ in length."""
    usable = a.isNotNull() & b.isNotNull() & ((F.size(a) == F.size(b)) if equal_lengths else F.lit(True))
    n = F.when(usable, F.least(F.size(a), F.size(b))).otherwise(0)
    same = F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), lambda x: x))
    return F.when(n > 0, same / n).otherwise(F.lit(0.0))


def candidate_probability(s: Column, bands: int = 32, rows: int = 4) -> Column:
    """Chance that two sets of similarity s share a band."""
    x = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return 1 - F.pow(1 - F.pow(x, F.lit(float(rows))), F.lit(float(bands)))
