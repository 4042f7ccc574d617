"""Problem 6: records that share most of their content but for small edits, by b-bit MinHash."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import bucket_pairs, folded, mix64
from affinis.llm.components import connected_components
from affinis.runtime import broadcast_if, spread, stage

_TOKEN = re.compile(r"[a-z0-9]+")
#: Values of a packed signature and low bits kept of each minimum.
PERMUTATIONS, BITS = 128, 2
#: Share of the pairs at the threshold that bands must find.
BAND_RECALL = 0.99
#: Standard deviations that an estimate may fall short of the threshold before a candidate is given up.
SLACK = 6.0


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return x[:PERMUTATIONS, None] | np.uint32(1), x[PERMUTATIONS:, None]


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows of a band): as many rows as BAND_RECALL allows at the threshold, so that buckets stay small; at 0.7 they
    are 32 bands of 4, which miss a pair with probability 1.5e-4. A threshold no banding serves is refused."""
    for rows in range(16, 0, -1):
        bands = PERMUTATIONS // rows
        if 1 - (1 - threshold**rows) ** bands >= BAND_RECALL:
            return bands, rows
    raise ValueError(f"{PERMUTATIONS} permutations can't find {BAND_RECALL:.0%} of the pairs at a similarity of {threshold}")


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width tokens; all tokens as one run if fewer."""
    return _batch_shingles([text], width)[0]


class _WordHashes(dict):
    """64-bit hash of a word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return v


_HASHED = _WordHashes()


def _batch_shingles(texts: list[str], width: int) -> list[np.ndarray]:
    get = _HASHED.__getitem__
    docs = [_TOKEN.findall(folded(t)) for t in texts]
    sizes = np.array([len(d) for d in docs])
    h = np.fromiter((get(w) for d in docs for w in d), np.uint64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    out = [np.zeros(0, np.uint64)] * len(docs)
    # runs of width tokens over all texts at once; those that reach into the next text are left out
    for k in range(1, width + 1):
        own = np.flatnonzero(sizes >= width if k == width else sizes == k)
        if not len(own):
            continue
        t, starts = (h, first) if k == width else (np.concatenate([h[first[i] : first[i] + k] for i in own]), None)
        acc = np.full(len(t) - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            acc = mix64(acc + t[j : len(t) - k + 1 + j] * np.uint64(2 * j + 0x9E3779B97F4A7C15))
        for n, i in enumerate(own):
            out[i] = np.unique(acc[starts[i] : starts[i] + sizes[i] - k + 1]) if k == width else acc[n * k : n * k + 1]
    return out


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least permuted value of each set under each permutation of 32-bit numbers, mixed; sets must not be empty."""
    a, b = _coefficients()
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    for i, s in enumerate(sets):
        h = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), 4096):
            x = h[at : at + 4096] * a
            x += b
            least = x.min(axis=1)
            out[i] = np.minimum(out[i], least) if at else least
    return mix64(out.ravel().astype(np.uint64)).reshape(out.shape)


def _pack(minima: np.ndarray) -> np.ndarray:
    """BITS planes of PERMUTATIONS bits, plane by plane, as signed 64-bit words."""
    planes = []
    for p in range(BITS):
        bit = ((minima >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        planes.append(np.packbits(bit, axis=1).view(np.int64))
    return np.concatenate(planes, axis=1)


def _band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band, the band's place mixed in."""
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), 1))
    grouped = minima[:, : bands * rows].reshape(len(minima), bands, rows)
    for r in range(rows):
        acc = mix64((acc + grouped[:, :, r] * np.uint64(0x9E3779B97F4A7C15 + 2 * r)).ravel()).reshape(acc.shape)
    return acc.view(np.int64)


def _set_key(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _set_rows(width: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sets = _batch_shingles(list(part["t"]), width)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                minima = _minima([sets[i] for i in keep])
                yield pd.DataFrame({"ident": part["ident"].iloc[keep].to_numpy(), "k": [_set_key(sets[i]) for i in keep], "n": [len(sets[i]) for i in keep], "sig": list(_pack(minima)), "bands": list(_band_keys(minima, bands, rows))})

    return run


def content_classes(items: DataFrame, ident: str, text: str, threshold: float, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """members (ident, cls, copies) and classes (cls, head, k, copies, n, sig, bands): records of equal shingle sets share a
    class, named by a number; head is its smallest ident.

    Null texts and texts without a token are in no class. Sizes and signatures are staged, the sets are not: they are made
    again for the few records that candidates name.
    """
    rows = spread(items.select(F.col(ident).alias("ident"), F.col(text).alias("t"))).where("t is not null and ident is not null")
    kind = dict(items.dtypes)[ident]
    made = rows.mapInPandas(_set_rows(width, *banding(threshold)), f"ident {kind}, k binary, n int, sig array<bigint>, bands array<bigint>")
    keyed = stage(made.withColumn("row", F.monotonically_increasing_id()), "shingles")
    own = keyed.groupBy("k", "ident").agg(F.min("row").alias("row"))
    least = own.groupBy("k").agg(F.min(F.struct("ident", "row")).alias("h"), F.count(F.lit(1)).alias("copies"))
    members = stage(own.join(least, "k").select(F.col("ident").alias(ident), "row", F.col("h.row").alias("cls"), "copies"), "nd-members")
    heads = members.where("row = cls").select("row", F.col(ident).alias("head"), "copies")
    classes = keyed.drop("ident").join(heads, "row").withColumnRenamed("row", "cls")
    return members.select(ident, "cls", "copies"), stage(classes, "nd-classes")


def estimated(sig_a: Column, sig_b: Column) -> Column:
    """Similarity from two packed signatures: bit counts of differing positions, corrected for chance agreement."""
    words = PERMUTATIONS // 64
    differing = None
    for w in range(words):
        bits = None
        for p in range(BITS):
            x = sig_a[p * words + w].bitwiseXOR(sig_b[p * words + w])
            bits = x if bits is None else bits.bitwiseOR(x)
        n = F.bit_count(bits)
        differing = n if differing is None else differing + n
    chance = 2.0**-BITS
    return (F.lit(1.0) - differing / F.lit(float(PERMUTATIONS)) - chance) / (1.0 - chance)


def slack(threshold: float) -> float:
    """SLACK standard deviations of the corrected estimate at the threshold."""
    c = 2.0**-BITS
    p = c + (1 - c) * threshold
    return SLACK * math.sqrt(p * (1 - p) / PERMUTATIONS) / (1 - c)


def _overlaps(width: int):
    """Sizes of intersection and union of two texts' sets; a text that has not the class's set is of another row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[bytes, np.ndarray]] = {}
        for pdf in batches:
            rows = []
            for c in zip(*(pdf[x] for x in ("cls_a", "cls_b", "ka", "kb", "ta", "tb"))):
                both = []
                for k, t in ((c[2], c[4]), (c[3], c[5])):
                    if t not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held)))
                        s = shingle_hashes(t, width)
                        held[t] = _set_key(s), s
                    both.append(held[t] if held[t][0] == bytes(k) else None)
                if None not in both:
                    x, y = both[0][1], both[1][1]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    rows.append((c[0], c[1], shared, len(x) + len(y) - shared))
            yield pd.DataFrame(rows, columns=["cls_a", "cls_b", "o", "u"])

    return run


def similar_content(classes: DataFrame, items: DataFrame, ident: str, text: str, threshold: float, width: int = 5) -> DataFrame:
    """(cls_a, cls_b, similarity) for different classes with intersection / union >= threshold, cls_a < cls_b.

    Buckets of equal band minima propose pairs; a hot bucket is split into blocks. A proposal whose b-bit estimate lies
    far below the threshold is dropped, the rest is verified on the whole sets of the heads' texts.
    """
    rows = classes.select("cls", "n", F.explode("bands").alias("key"))
    shorter, longer = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    met = bucket_pairs(rows, ["key"], "cls", ["n"], where=shorter >= longer * F.lit(threshold) - 1e-9).select(F.col("a_cls").alias("cls_a"), F.col("b_cls").alias("cls_b")).distinct()
    sa, sb = classes.select(F.col("cls").alias("cls_a"), F.col("sig").alias("sa")), classes.select(F.col("cls").alias("cls_b"), F.col("sig").alias("sb"))
    close = estimated(F.col("sa"), F.col("sb")) >= threshold - slack(threshold)
    found = stage(met.join(sa, "cls_a").join(sb, "cls_b").where(close).select("cls_a", "cls_b"), "nd-candidates")
    need = found.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    heads = stage(classes.select("cls", "k", "head").join(need, "cls"), "nd-heads")
    told = items.select(F.col(ident).alias("head"), F.col(text).alias("t")).join(broadcast_if(heads, 500_000), "head")
    a = told.select(F.col("cls").alias("cls_a"), F.col("k").alias("ka"), F.col("t").alias("ta"))
    b = told.select(F.col("cls").alias("cls_b"), F.col("k").alias("kb"), F.col("t").alias("tb"))
    checked = found.join(a, "cls_a").join(b, "cls_b").mapInPandas(_overlaps(width), "cls_a bigint, cls_b bigint, o int, u int")
    near = checked.where(F.col("o") >= F.col("u") * F.lit(float(threshold)) - 1e-9)
    return near.groupBy("cls_a", "cls_b").agg(F.max(F.col("o") / F.col("u")).alias("similarity"))


def near_duplicate_pairs(items: DataFrame, ident: str = "item_id", text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(<ident>_a, <ident>_b) for every two records of similarity >= threshold, copies included.

    Null texts and texts without tokens are in no pair; a repeated row counts once.
    """
    members, classes = content_classes(items, ident, text, threshold, width)
    found = similar_content(classes, items, ident, text, threshold, width)
    same = bucket_pairs(members.where("copies > 1").select("cls", ident), ["cls"], ident).select(F.col(f"a_{ident}").alias(f"{ident}_a"), F.col(f"b_{ident}").alias(f"{ident}_b"))
    a = members.select(F.col("cls").alias("cls_a"), F.col(ident).alias("x"))
    b = members.select(F.col("cls").alias("cls_b"), F.col(ident).alias("y"))
    cross = found.join(a, "cls_a").join(b, "cls_b").where("x <> y").select(F.least("x", "y").alias(f"{ident}_a"), F.greatest("x", "y").alias(f"{ident}_b"))
    return same.unionByName(cross)


def near_duplicate_groups(items: DataFrame, ident: str = "item_id", text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row for each record with tokens: ident, class_id (equal sets), group_id (linked directly or through others),
    copies in its class and links to records of other classes."""
    members, classes = content_classes(items, ident, text, threshold, width)
    found = stage(similar_content(classes, items, ident, text, threshold, width).select("cls_a", "cls_b"), "nd-links")
    kind = dict(items.dtypes)[ident]
    named = classes.select(F.col("cls").alias("node"), "head")
    groups = connected_components(found, "cls_a", "cls_b").join(named, "node")
    groups = groups.join(groups.groupBy("component").agg(F.min("head").cast(kind).alias("g")), "component").select(F.col("node").alias("cls"), "g")
    ways = found.select(F.explode(F.array(F.struct(F.col("cls_a").alias("cls"), F.col("cls_b").alias("o")), F.struct(F.col("cls_b").alias("cls"), F.col("cls_a").alias("o")))).alias("e")).select("e.cls", "e.o")
    far = ways.join(classes.select(F.col("cls").alias("o"), "copies"), "o").groupBy("cls").agg(F.sum("copies").alias("links"))
    per = classes.select("cls", "head", "copies").join(groups, "cls", "left").join(far, "cls", "left")
    per = per.select("cls", "copies", F.col("head").alias("class_id"), F.coalesce("g", "head").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return members.select(ident, "cls").join(per, "cls").select(ident, "class_id", "group_id", "copies", "links")
