"""Helpers of the training-data operators: hashing, segment arithmetic and pair generation inside buckets."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.runtime import stage

#: Members of a bucket that one task pairs with the bucket's rest; larger buckets are split into blocks of this size.
BLOCK_ROWS = 2000

#: White space for Java's regular expressions, which leave out the non-ASCII kinds.
WHITE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def folded(text: str) -> str:
    """NFKC and lower case; ASCII needs only the latter."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _alnum_table() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), dtype=np.bool_)


_ALNUM: np.ndarray | None = None


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many folded texts: (hashes, owner of each word, start, end in the joined text).

    A word is a run of letters and digits. The hash of a word is a polynomial of its code points modulo 2**64, taken
    from prefix sums, and mixed; equal words have equal hashes everywhere.
    """
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = _alnum_table()
    joined = "\n".join(texts)
    cp = code_points(joined)
    if not len(cp):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    inside = _ALNUM[cp]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, start, side="right")
    return _run_hashes(cp, start, end), owner, start, end


def _run_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of code points: sum of mixed (code point, place in the run) pairs, and the length."""
    length = end - start
    if not len(start):
        return np.zeros(0, np.uint64)
    total = int(length.sum())
    first = np.cumsum(length) - length
    idx = np.arange(total) - np.repeat(first - start, length)
    place = (np.arange(total) - np.repeat(first, length)).astype(np.uint64)
    part = cp[idx].astype(np.uint64)
    part += place << np.uint64(21)
    part *= np.uint64(0x9E3779B97F4A7C15)
    part ^= part >> np.uint64(29)
    part *= _M2
    part ^= part >> np.uint64(32)
    return mix64(np.add.reduceat(part, first) + length.astype(np.uint64))


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bucket_pairs(rows: DataFrame, keys: list[str], ident: str, extra: list[str] = [], block: int = BLOCK_ROWS, where: Column | None = None) -> DataFrame:
    """Every two rows of a bucket once, as a_<col>, b_<col> with a_ident < b_ident.

    A bucket of n rows is cut into ceil(n / block) blocks of the left side, each joined with a copy of the right side
    in its own task, so a hot bucket is spread over the cluster and nothing is dropped. Buckets of one row vanish
    before the join, and the rest is staged. where filters on the a_ and b_ columns inside the join.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = rows.select(*keys, ident, *extra).join(counts, keys).withColumn("_nb", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    sized = stage(sized, "bucket-rows")
    cols = [ident, *extra]
    left = sized.select(*keys, F.pmod(F.xxhash64(ident), F.col("_nb").cast("long")).cast("int").alias("_blk"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = sized.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_blk"), *[F.col(c).alias(f"b_{c}") for c in cols])
    on = F.col(f"a_{ident}") < F.col(f"b_{ident}")
    out = left.join(right, [*keys, "_blk"]).where(on if where is None else on & where)
    return out.select(*[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols])
