"""Problem 2: long spans that stand word for word in more than one record, by super-k-mer partitioning.

A window is `width` code points. Consecutive windows of a text with the same minimiser (least hashed m-mer) form one string
that belongs to the bucket of that minimiser. A string met in two records is shared whole; only where a minimiser has
different strings from different records do they travel, packed, to its bucket, where sorting brings equal windows together,
and a window counts as shared when its occurrences belong to two records or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from affinis.llm.common import code_points, mix64
from affinis.runtime import spread, stage

#: Length of a minimiser, code points of text handled at once, and the packed code points that a bucket should hold.
MINIMISER, CHUNK, BUCKET_CHARS = 32, 400_000, 2_000_000
_BASE = np.uint64(0x2545F4914F6CDD1D)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def rolling(cp: np.ndarray, width: int) -> np.ndarray:
    """Hashes modulo 2**64 of all runs of width code points."""
    n = len(cp) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = np.full(len(cp) + 1, inverse, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mix64(cp) | np.uint64(1)) * _powers(len(cp)), dtype=np.uint64)))
    return mix64((prefix[width:] - prefix[:-width]) * down[: n])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones, from prefix and suffix minima of blocks of w."""
    n = len(h) - w + 1
    padded = np.concatenate((h, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def minimiser_size(width: int) -> int:
    """Code points of a minimiser: MINIMISER, or half a window that is shorter than two of them."""
    if width < 2:
        raise ValueError(f"windows of {width} code points have no minimiser")
    return min(MINIMISER, width // 2)


def packed_runs(texts: list[str], width: int) -> Iterator[tuple[int, int, int, str]]:
    """(text, start, minimiser hash, string) covering each window of the texts once."""
    held: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - width + 1, CHUNK):
            held.append((i, at, text[at : at + CHUNK + width - 1]))
            size += len(held[-1][2])
            if size > CHUNK:
                yield from _runs(held, width)
                held, size = [], 0
    if held:
        yield from _runs(held, width)


def _runs(pieces: list[tuple[int, int, str]], width: int) -> Iterator[tuple[int, int, int, str]]:
    m = minimiser_size(width)
    least = window_minima(rolling(code_points("".join(p for _, _, p in pieces)), m), width - m + 1)
    sizes = np.array([len(p) for _, _, p in pieces])
    first = np.cumsum(sizes) - sizes
    own = np.zeros(len(least), bool)
    for a, n in zip(first.tolist(), sizes.tolist()):
        own[a : a + n - width + 1] = True
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[first] = True
    ends = np.concatenate((new[1:] | ~own[1:], [True])) & own
    lo, hi = np.flatnonzero(new & own), np.flatnonzero(ends) + 1
    at = np.searchsorted(first, lo, side="right") - 1
    for p, x, y, key in zip(at.tolist(), (lo - first[at]).tolist(), (hi - first[at]).tolist(), least[lo].view(np.int64).tolist()):
        i, offset, piece = pieces[p]
        for part in range(x, y, 4 * width):  # a long run of one minimiser is cut: repetitive texts give equal pieces
            yield i, offset + part, key, piece[part : min(y, part + 4 * width) + width - 1]


def super_kmers(text: str, width: int) -> Iterator[tuple[int, int, str]]:
    """(start, minimiser hash, string) covering each window of one text once."""
    return ((start, key, s) for _, start, key, s in packed_runs([text], width))


def _key(s: str) -> bytes:
    return blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _pack(width: int):
    """Places of the strings, their lengths and 128-bit keys; the strings themselves stay behind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys = pdf["ident"].to_numpy(), list(pdf["tk"])
            found = [(i, start, mini, _key(s), len(s)) for i, start, mini, s in packed_runs(list(pdf["t"]), width)]
            if found:
                i, start, mini, k, n = zip(*found)
                yield pd.DataFrame({"ident": ids[list(i)], "tk": [keys[x] for x in i], "start": start, "mini": mini, "k": k, "len": n})

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The strings at the given places of each text; a text without them only shares the hash of the one that has them."""
    names = ["mini", "k", "chars", "lo", "hi", "s"]
    for pdf in batches:
        rows, held = [], 0
        for text, places in zip(pdf["t"], pdf["places"]):
            for p in places:
                s, k = text[p["start"] : p["start"] + p["len"]], bytes(p["k"])
                if _key(s) == k:
                    rows.append((p["mini"], k, p["chars"], p["lo"], p["hi"], s))
                    held += p["len"]
            if held > 4_000_000:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)


def equal_windows(cp: np.ndarray, at: np.ndarray, heads: np.ndarray, width: int) -> bool:
    """Whether the window at each place equals that at its head, code point by code point.

    at is sorted. A window one further than the one before it, with a head one further as well, is equal if its last code
    point is; only the others are compared whole.
    """
    if not len(at):
        return True
    follows = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (heads[1:] == heads[:-1] + 1)))
    if not (cp[at[follows] + width - 1] == cp[heads[follows] + width - 1]).all():
        return False
    a, b = at[~follows], heads[~follows]
    views = np.lib.stride_tricks.sliding_window_view(cp, width)
    return all((views[a[c : c + 20_000]] == views[b[c : c + 20_000]]).all() for c in range(0, len(a), 20_000))


def shared_windows(strings: list[str], lo: np.ndarray, hi: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """For each string, runs (first, end) of its windows that occur in two records or more.

    lo and hi are the numbers of the least and greatest record that hold a string. Windows are sorted by hash; equal
    hashes are confirmed code point by code point before they count.
    """
    cp = code_points("".join(strings))
    lengths = np.array([len(s) for s in strings])
    sizes = lengths - width + 1
    first = np.cumsum(lengths) - lengths
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(strings)), sizes)
    pos = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes) + first[owner]
    h = rolling(cp, width)[pos]
    order = np.argsort(h, kind="stable")
    hs = h[order]
    heads = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(hs))))
    least, most = np.minimum.reduceat(lo[owner[order]], heads), np.maximum.reduceat(hi[owner[order]], heads)
    flag, head = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    flag[order] = (least != most)[group]
    head[order] = pos[order[heads]][group]
    if not equal_windows(cp, pos[flag], head[flag], width):  # a hash shared by different windows: settled on the windows
        views = np.lib.stride_tricks.sliding_window_view(cp, width)
        by: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(flag).tolist():
            by.setdefault(views[pos[i]].tobytes(), []).append(i)
        for same in by.values():
            o = owner[same]
            flag[same] = lo[o].min() != hi[o].max()
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8)))
    # runs end with their string
    cuts = np.unique(np.concatenate((edge, ends[:-1], [0])))
    cuts = cuts[cuts < len(flag)]
    runs: list[list[tuple[int, int]]] = [[] for _ in strings]
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(flag)).tolist()):
        if flag[a]:
            k = int(owner[a])
            base = int(ends[k] - sizes[k])
            runs[k].append((a - base, b - base))
    return runs


def _count_bucket(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pdf = pdf.sort_values("mini", kind="stable")
        lo, hi = pd.factorize(pd.concat([pdf["lo"], pdf["hi"]]), sort=True)[0].reshape(2, -1)
        found = shared_windows(list(pdf["s"]), lo, hi, width)
        for key, runs in zip(pdf["k"], found):
            rows += [(key, a, b) for a, b in runs]
        return pd.DataFrame(rows, columns=["k", "first", "end"])

    return run


def shared_spans(items: DataFrame, ident: str = "item_id", text: str = "text", width: int = 240) -> DataFrame:
    """(ident, span_start, span_end): maximal runs of characters inside windows that also occur in another record.

    Characters are code points compared as stored. Null texts and texts shorter than width have no span; records of
    equal ident count as one record. The different strings of a minimiser whose text exceeds half a bucket are taken apart
    into whole windows, which the engine groups by a 256-bit hash instead of in one task.
    """
    minimiser_size(width)
    kind = dict(items.dtypes)[ident]
    told = items.select(F.col(ident).alias("ident"), F.col(text).alias("t")).where(F.col("ident").isNotNull() & (F.length("t") >= width))
    texts = spread(told).select("ident", F.xxhash64("t").alias("tk"), "t")
    packed = texts.mapInPandas(_pack(width), f"ident {kind}, tk bigint, start bigint, mini bigint, k binary, len int")
    packed = stage(packed.withColumn("row", F.monotonically_increasing_id()), "super-kmers")
    strings = stage(packed.groupBy("mini", "k").agg(F.min("ident").alias("lo"), F.max("ident").alias("hi"), F.min("row").alias("row"), F.max("len").alias("len")), "strings")
    # minimisers met in one record only hold no shared window; one string in two records is shared whole
    load = strings.groupBy("mini").agg(F.sum("len").alias("chars"), F.min("lo").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    load = stage(load.select("mini", "chars", "n"), "loads")
    whole = strings.join(load.where("n = 1").select("mini"), "mini", "left_semi").select("k", F.lit(0).cast("bigint").alias("first"), (F.col("len") - width + 1).cast("bigint").alias("end"))
    total, most = load.where("n > 1").agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.max("chars"), F.lit(0))).first()
    buckets = max(1, -(-total // BUCKET_CHARS))
    asked = strings.join(load.where("n > 1").select("mini", "chars"), "mini").select("row", "mini", "k", "chars", "lo", "hi")
    places = packed.select("row", "ident", "tk", "start", "len").join(asked, "row")
    places = places.groupBy("ident", "tk").agg(F.collect_list(F.struct("start", "len", "mini", "k", "chars", "lo", "hi")).alias("places"))
    live = texts.join(places, ["ident", "tk"]).select("t", "places").mapInPandas(_cut, f"mini bigint, k binary, chars bigint, lo {kind}, hi {kind}, s string")
    if most > BUCKET_CHARS // 2:
        live = stage(live, "live-strings")
    cool = live.where(F.col("chars") <= BUCKET_CHARS // 2)
    counted = cool.select("k", "s", "lo", "hi", "mini", F.pmod(F.xxhash64("mini"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(_count_bucket(width), "k binary, first bigint, end bigint")
    runs = whole.unionByName(counted)
    if most > BUCKET_CHARS // 2:
        hot = live.where(F.col("chars") > BUCKET_CHARS // 2)
        split = hot.select("k", "lo", "hi", "s", F.explode(F.sequence(F.lit(1), F.length("s") - width + 1)).alias("p"))
        windows = split.select("k", "p", "lo", "hi", F.sha2(F.substring("s", F.col("p"), F.lit(width)), 256).alias("w"))
        twice = windows.groupBy("w").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y").select("w")
        runs = runs.unionByName(windows.join(twice, "w").select("k", (F.col("p") - 1).cast("bigint").alias("first"), F.col("p").cast("bigint").alias("end")))
    spans = packed.select("k", "ident", "start").join(runs.distinct(), "k").select("ident", (F.col("start") + F.col("first")).alias("b"), (F.col("start") + F.col("end") - 1 + width).alias("e"))
    order = Window.partitionBy("ident").orderBy("b", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (reach.isNull() | (F.col("b") > reach)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("ident", "island").agg(F.min("b").alias("span_start"), F.max("e").alias("span_end")).select(F.col("ident").alias(ident), "span_start", "span_end")


def shared_amounts(items: DataFrame, ident: str = "item_id", text: str = "text", width: int = 240) -> DataFrame:
    """One row for each record with an ident: its length, spans, characters shared elsewhere and their share.

    Null and empty texts have length 0 and share 0.0.
    """
    spans = shared_spans(items, ident, text, width).groupBy(ident).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    base = items.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n_chars"))
    out = base.join(spans, ident, "left").select(ident, "n_chars", F.coalesce("spans", F.lit(0)).cast("long").alias("spans"), F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
