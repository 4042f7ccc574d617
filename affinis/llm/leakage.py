"""Problem 7: passages of evaluation items inside corpus texts, by CGK embedding and bit-sampling LSH.

Texts are sequences of hashed words. Every window of the corpus that has the size of an item's window (`width` words, or
the whole of a shorter item) walks through a CGK embedding: in step j the word under the pointer is written out and a
random bit of (j, word) tells whether the pointer moves on. Few edits between two windows leave the outputs equal in
most places. Each table samples some places of an output as its key; tables are repeated until windows at `edits` word
edits meet in one with the wanted recall (equal windows always meet), and meetings are verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import folded, mix64, word_hashes
from affinis.runtime import spread, stage

#: Places sampled for one key, and tables that share a walk.
SAMPLE, PER_WALK = 6, 4
#: Items are taken in blocks of so many characters; each block is indexed, held by every task and searched for in the whole
#: corpus. Walks after which a recall that is not reached is refused.
INDEX_CHARS, MAX_WALKS = 1_000_000, 64
#: Windows embedded at once, and characters of text tokenised at once.
SLICE, BATCH_CHARS = 1 << 16, 1_500_000


def _positions(steps: int, tables: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(steps, SAMPLE, replace=False)) for _ in range(tables)]


def embed_keys(words: np.ndarray, bits: np.ndarray, start: np.ndarray, width: int, walk: int, seed: int) -> list[np.ndarray]:
    """Keys of PER_WALK tables for the windows of words that begin at start; bits are the words' random bits of this walk."""
    steps = 2 * width
    places = _positions(steps, PER_WALK, seed * 1009 + walk)
    use = [[k for k, p in enumerate(places) if j in p] for j in range(steps)]
    acc = [np.full(len(start), np.uint64(k + 1 + PER_WALK * walk), np.uint64) for k in range(PER_WALK)]
    at = start.astype(np.int32)
    end = at + np.int32(width)
    for j in range(max(j for j in range(steps) if use[j]) + 1):
        live = at < end
        held = np.minimum(at, end - 1)
        if use[j]:
            out = np.where(live, words[held], np.uint64(0))
            for k in use[j]:
                acc[k] = acc[k] * np.uint64(0x9E3779B97F4A7C15) + out
                acc[k] ^= acc[k] >> np.uint64(32)
        at = at + (((bits[held] >> np.uint64(j)) & np.uint64(1)).astype(np.int32) & live)
    return [mix64(a) for a in acc]


def walk_bits(words: np.ndarray, walk: int, seed: int) -> np.ndarray:
    return mix64(words ^ mix64(np.array([seed * 7919 + walk + 1], np.uint64))[0])


def walks_needed(width: int, edits: int, recall: float, seed: int, trials: int = 1500) -> int:
    """Fewest walks, found by simulation, after which two windows at `edits` word edits have met with the wanted recall.

    A recall that MAX_WALKS do not reach is refused.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 62, (trials, width)).astype(np.uint64)
    b = a.copy()
    for i in range(trials):
        row = list(b[i])
        for _ in range(edits):
            kind, p = rng.integers(3), int(rng.integers(len(row)))
            fresh = np.uint64(rng.integers(1, 1 << 62))
            row = [*row[:p], fresh, *row[p + 1 :]] if kind == 0 else [*row[:p], *row[p + 1 :]] if kind == 1 else [*row[:p], fresh, *row[p:]]
        row = (row + [np.uint64(x) for x in rng.integers(1, 1 << 62, width)])[:width]
        b[i] = row
    start = np.arange(trials) * width
    met = np.zeros(trials, bool)
    for walk in range(MAX_WALKS):
        ka, kb = (embed_keys(x.ravel(), walk_bits(x.ravel(), walk, seed), start, width, walk, seed) for x in (a, b))
        met |= np.logical_or.reduce([x == y for x, y in zip(ka, kb)])
        if met.mean() >= recall:
            return walk + 1
    raise ValueError(f"{MAX_WALKS} walks find {met.mean():.2f} of the windows of {width} words at {edits} edits, not {recall}")


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of a to the same row of b."""
    n, m = a.shape[1], b.shape[1]
    row = np.repeat(np.arange(m + 1)[None, :], len(a), 0)
    for i in range(n):
        prev, row = row, np.empty_like(row)
        row[:, 0] = i + 1
        differs = (a[:, i : i + 1] != b).astype(row.dtype)
        for j in range(m):
            row[:, j + 1] = np.minimum(np.minimum(prev[:, j + 1], row[:, j]) + 1, prev[:, j] + differs[:, j])
    return row[:, m]


@dataclass
class Index:
    """Item windows of one width: words (n, width), item of each, and the sorted keys of every table."""

    width: int
    edits: int
    walks: int
    words: np.ndarray
    item: np.ndarray
    keys: list[np.ndarray]
    order: list[np.ndarray]
    sieve: list[np.ndarray]
    vocabulary: np.ndarray


_SIEVE = 18


def _index(width: int, windows: np.ndarray, items: np.ndarray, edits: int, recall: float, seed: int) -> Index:
    e = min(edits, max(0, width // 4))
    walks = walks_needed(width, e, recall, seed)
    flat, start = windows.ravel(), np.arange(len(windows)) * width
    keys = [k for w in range(walks) for k in embed_keys(flat, walk_bits(flat, w, seed), start, width, w, seed)]
    order = [np.argsort(k, kind="stable") for k in keys]
    sieve = []
    for k in keys:
        s = np.zeros(1 << _SIEVE, bool)
        s[(k >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
        sieve.append(s)
    return Index(width, e, walks, windows, items, [k[o] for k, o in zip(keys, order)], order, sieve, np.unique(flat))


def item_windows(texts: list[str], idents: np.ndarray, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> (windows, item of each): all windows of the items, whole items where they have fewer words."""
    h, owner, _, _ = word_hashes([folded(t) for t in texts])
    out: dict[int, tuple[list, list]] = {}
    for i in range(len(texts)):
        w = h[owner == i]
        n = min(width, len(w))
        if n:
            rows = out.setdefault(n, ([], []))
            for s in range(len(w) - n + 1):
                rows[0].append(w[s : s + n])
                rows[1].append(idents[i])
    return {n: (np.array(a, np.uint64), np.array(b)) for n, (a, b) in out.items()}


def _near_vocabulary(h: np.ndarray, owner: np.ndarray, width: int, edits: int, vocabulary: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Starts of the windows inside one text with at least width - edits words that some item has: no other can be close."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    known = sieve[(h >> np.uint64(44)).astype(np.int64)]
    sure = np.flatnonzero(known)
    at = np.searchsorted(vocabulary, h[sure])
    known[sure] = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h[sure]
    total = np.concatenate(([0], np.cumsum(known, dtype=np.int32)))
    return np.flatnonzero((total[width:] - total[:-width] >= width - edits) & (owner[width - 1 :] == owner[:n]))


def _meetings(h: np.ndarray, start: np.ndarray, ix: Index, bits: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, item window, edits) for the windows that meet an item window in a table and are within the edits."""
    starts, theirs = [], []
    for c in range(0, len(start), SLICE):
        part = start[c : c + SLICE]
        for w in range(ix.walks):
            for k, key in enumerate(embed_keys(h, bits[w], part, ix.width, w, seed)):
                t = w * PER_WALK + k
                maybe = np.flatnonzero(ix.sieve[t][(key >> np.uint64(64 - _SIEVE)).astype(np.int64)])
                lo = np.searchsorted(ix.keys[t], key[maybe], "left")
                n = np.searchsorted(ix.keys[t], key[maybe], "right") - lo
                if n.sum():
                    s, o = np.repeat(part[maybe], n), ix.order[t][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    for g in range(0, len(s), SLICE):
                        near = may_be_close(h[s[g : g + SLICE, None] + np.arange(ix.width)], ix.words[o[g : g + SLICE]], ix.edits)
                        starts.append(s[g : g + SLICE][near])
                        theirs.append(o[g : g + SLICE][near])
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, z
    pair = np.unique(np.concatenate(starts) * len(ix.words) + np.concatenate(theirs))
    s, o = np.divmod(pair, len(ix.words))
    dist = edit_distance(h[s[:, None] + np.arange(ix.width)], ix.words[o])
    ok = dist <= ix.edits
    return s[ok], o[ok], dist[ok]


def may_be_close(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether enough words of each row of a stand in the same row of b, at most `edits` places away: no close pair fails."""
    n = a.shape[1]
    found = a == b
    for d in range(1, edits + 1):
        found[:, d:] |= a[:, d:] == b[:, : n - d]
        found[:, : n - d] |= a[:, : n - d] == b[:, d:]
    return found.sum(1, dtype=np.int8) >= n - edits


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for pdf in batches:
        ids, texts, lo, held = pdf["ident"].to_numpy(), list(pdf["t"]), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > BATCH_CHARS or i == len(texts) - 1:
                yield ids[lo : i + 1], texts[lo : i + 1]
                lo, held = i + 1, 0


def _search(indexes: list[Index], seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieves = []
        for ix in indexes:
            s = np.zeros(1 << 20, bool)
            s[(ix.vocabulary >> np.uint64(44)).astype(np.int64)] = True
            sieves.append(s)
        for ids, texts in _batches(batches):
            h, owner, _, _ = word_hashes([folded(t) for t in texts])
            bits: list[np.ndarray] = []
            for ix, sieve in zip(indexes, sieves):
                start = _near_vocabulary(h, owner, ix.width, ix.edits, ix.vocabulary, sieve)
                if not len(start):
                    continue
                while len(bits) < ix.walks:
                    bits.append(walk_bits(h, len(bits), seed))
                s, o, dist = _meetings(h, start, ix, bits, seed)
                if len(s):
                    rows = pd.DataFrame({"ident": ids[owner[s]], "item": ix.item[o], "edits": dist})
                    yield rows.groupby(["ident", "item"], sort=False).agg(edits=("edits", "min"), windows=("edits", "size")).reset_index()

    return run


def leaked_items(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "eval_id", text: str = "text", width: int = 12, edits: int = 1, recall: float = 0.95, seed: int = 11, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc, item, edits, windows): documents that hold a window of an item within `edits` word edits.

    edits is the least found, 0 for wording in common; an item window of fewer than 12 words allows a quarter of them.
    Windows of 0 edits are found always, others with the given recall. windows counts the matching window pairs. The items
    are the query set: however many there are, every block of them is held against the whole corpus, and the result does
    not depend on the blocks.
    Null or wordless texts on either side are in no row; texts are used whole; copies of a document each have their row.
    """
    kinds = dict(corpus.dtypes)[doc], dict(items.dtypes)[item]
    wanted = spread(items.select(F.col(item).alias("ident"), F.col(text).alias("t")).where("ident is not null and t is not null")).distinct()
    texts = spread(corpus.select(F.col(doc).alias("ident"), F.col(text).alias("t"))).where("ident is not null and t is not null")
    chars = wanted.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // max(1, index_chars)))
    rows = None
    for block in range(blocks):
        held = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("ident", "t"), F.lit(blocks)) == block)).toPandas()
        grouped = item_windows(list(held["t"]), held["ident"].to_numpy(), width)
        indexes = [_index(n, w, i, edits, recall, seed) for n, (w, i) in sorted(grouped.items())]
        found = texts.mapInPandas(_search(indexes, seed), f"ident {kinds[0]}, item {kinds[1]}, edits int, windows bigint")
        if blocks > 1:  # else the plan would grow with the blocks
            found = stage(found, "leaks")
        rows = found if rows is None else rows.unionByName(found)
    out = rows.groupBy("ident", "item").agg(F.min("edits").alias("edits"), F.sum("windows").alias("windows"))
    return out.select(F.col("ident").alias(doc), F.col("item").alias(item), "edits", "windows")


def expected_tables(width: int, edits: int, recall: float, seed: int = 11) -> int:
    """Tables that leaked_items uses for a width."""
    return PER_WALK * walks_needed(width, edits, recall, seed)


def collision_bound(width: int, hamming: float) -> float:
    """Chance that one table's sampled places all agree when a share of the outputs differs."""
    return math.pow(1 - hamming / (2 * width), SAMPLE)
