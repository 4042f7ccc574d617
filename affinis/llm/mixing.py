"""Problem 8: mixing sources to target shares by Poisson replication."""

from __future__ import annotations

import base64
import importlib.util
import math
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.runtime import broadcast_if, spread, stage

#: Folder and file of the public tokenizer whose tokens measure size.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
_SPACED = re.compile(r"\s | \s|\A\s|\s\Z")
#: Points of each calibration pass and number of passes: rates are resolved to 1 / POINTS ** PASSES of their range.
POINTS, PASSES = 256, 3
#: Least and greatest bytes of text in a task of the global shuffle, and the tasks kept to while the size lies between.
TASK_BYTES, TASK_BYTES_MOST, TASKS = 16 << 20, 512 << 20, 100_000


@cache
def _encoding(folder: str, ranks: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=table, special_tokens={})


class _Counts(dict):
    """Tokens of a piece that follows a blank, computed once."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[piece] = len(self.encode(" " + piece))
        return n


def count_tokens(texts: list[str | None], folder: str = TOKENIZERS, ranks: str = RANKS) -> list[int]:
    """Tokens of each text, 0 for null.

    The tokenizer never merges across a single blank between two other characters, so such texts are counted piece by
    piece from a cache; texts with wider white space are encoded whole.
    """
    encode = _encoding(folder, ranks).encode_ordinary
    counts = _counts(folder, ranks)
    get, out = counts.__getitem__, []
    for t in texts:
        if not t:
            out.append(0)
        elif _SPACED.search(t):
            out.append(len(encode(t)))
        else:
            head, *rest = t.split(" ")
            out.append(len(encode(head)) + sum(map(get, rest)))
    return out


@cache
def _counts(folder: str, ranks: str) -> _Counts:
    return _Counts(_encoding(folder, ranks).encode_ordinary)


def token_counts(docs: DataFrame, ident: str, text: str, keep: list[str], folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """ident, the kept columns, tokens, and the bytes of the text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(count_tokens(list(b), folder, ranks))

    return spread(docs.select(ident, *keep, F.col(text).alias("_t"))).select(ident, *keep, count("_t").alias("tokens"), F.octet_length("_t").cast("long").alias("_bytes"))


def poisson_copies(unit: Column, rate: Column, cap: Column) -> Column:
    """Inverse of the Poisson distribution at unit, cut at cap: the number of k < cap with CDF(k) <= unit.

    The expression is as long for any cap; terms are summed from their logarithms, so high rates do not vanish.
    """
    start = F.struct((-rate).alias("log"), F.lit(0.0).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        cdf = acc.cdf + F.exp(acc.log)
        return F.struct((acc.log + F.log(rate / (k + 1))).alias("log"), cdf.alias("cdf"), (acc.n + F.when(cdf <= unit, 1).otherwise(0)).alias("n"))

    return F.when((rate > 0) & (cap > 0), F.aggregate(F.sequence(F.lit(0), cap - 1), start, step, lambda acc: acc.n)).otherwise(0)


def _cdfs(grid: np.ndarray, cap: int) -> Iterator[np.ndarray]:
    """CDF(k) of every rate of the grid for k = 0 .. cap - 1."""
    with np.errstate(divide="ignore"):
        rates = np.log(grid)
    log, total = -grid, np.zeros(len(grid))
    for k in range(cap):
        total = total + np.exp(log)
        yield total
        log = log + rates - math.log(k + 1)


def _grid(lo: float, hi: float) -> np.ndarray:
    return lo + (hi - lo) * np.arange(POINTS + 1) / POINTS


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source, bin, tokens: what documents add to their source at each point of its grid of rates.

    A document has one copy more from the least rate on at which CDF(k) falls to its draw.
    """
    for pdf in batches:
        for source, own in pdf.groupby("source", sort=False):
            u, tokens = own["u"].to_numpy(), own["tokens"].to_numpy(float)
            sums = np.zeros(POINTS + 2)
            for cdf in _cdfs(_grid(own["lo"].iloc[0], own["hi"].iloc[0]), int(own["cap"].iloc[0])):
                at = POINTS + 1 - np.searchsorted(cdf[::-1], u, side="right")
                sums += np.bincount(at, weights=tokens, minlength=POINTS + 2)
            filled = np.flatnonzero(sums[: POINTS + 1])
            yield pd.DataFrame({"source": source, "bin": filled.astype(np.int32), "tokens": sums[filled]})


_STATE = "source string, cap int, want double, lo double, hi double, below double, above double"


def _narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The step of each source's grid on which its tokens reach what is wanted, and its tokens before and after."""
    names = [x.split()[0] for x in _STATE.split(", ")]
    for pdf in batches:
        rows = []
        for source, cap, want, lo, hi, bins in zip(*(pdf[c] for c in (*names[:5], "bins"))):
            sums = np.zeros(POINTS + 1)
            for x in bins if bins is not None else ():
                sums[x["bin"]] += x["tokens"]
            sums, grid = np.cumsum(sums), _grid(lo, hi)
            i = max(1, min(POINTS, int(np.searchsorted(sums, want, side="left"))))
            rows.append((source, cap, want, grid[i - 1], grid[i], sums[i - 1], sums[i]))
        yield pd.DataFrame(rows, columns=names).astype({"cap": "int32"})


def _unit(ident: str, seed: int) -> Column:
    return (F.shiftright(F.xxhash64(ident, F.lit(seed)), 11).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))


def mixing_plan(sized: DataFrame, targets: DataFrame, ident: str, total: float | None = None, seed: int = 3) -> DataFrame:
    """(source, cap, want, rate): the calibrated rate of every target source that has tokens.

    sized: ident, source, tokens. Without total, the mixture is as large as it can be with every source that has tokens
    filling its share within its cap. A document's copies never fall as the rate rises, so the realised tokens of a
    source are a rising step function of its rate; passes over a grid of rates narrow each rate down to the step that
    is nearest to the target. Workers add up steps by source; sources stay distributed, only the total is read.
    """
    goals = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").cast("int").alias("cap"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have")).where("have > 0")
    plan = stage(goals.join(have, "source"), "mix-plan")
    if total is None:
        total = plan.agg(F.min(F.col("cap") * F.col("have") / F.col("share"))).first()[0] or 0.0
    highest = F.col("cap") + 12.0 * F.sqrt("cap") + 40.0
    state = plan.select("source", "cap", (F.col("share") * F.lit(float(total))).alias("want"), F.lit(0.0).alias("lo"), highest.alias("hi"), F.lit(0.0).alias("below"), F.lit(0.0).alias("above"))
    draws = sized.select("source", "tokens", _unit(ident, seed).alias("u"))
    for _ in range(PASSES):
        steps = draws.join(broadcast_if(state.select("source", "cap", "lo", "hi"), 100_000), "source").mapInPandas(_steps, "source string, bin int, tokens double")
        bins = steps.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens")).groupBy("source").agg(F.collect_list(F.struct("bin", "tokens")).alias("bins"))
        state = stage(state.join(bins, "source", "left").mapInPandas(_narrowed, _STATE), "mix-rates")
    nearer = F.abs(F.col("below") - F.col("want")) < F.abs(F.col("above") - F.col("want"))
    return state.select("source", "cap", "want", F.when(nearer, F.col("lo")).otherwise(F.col("hi")).alias("rate"))


def shuffle_tasks(size: int) -> int:
    """Tasks for so many bytes of mixed text: by the data alone, so that equal data give equal corpora on any cluster."""
    return max(1, -(-size // min(max(size // TASKS, TASK_BYTES), TASK_BYTES_MOST)))


def mixture(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", total: float | None = None, seed: int = 3, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """The mixed corpus: ident, source, copy_no (from 1), tokens, text, shuffled globally.

    A document's copies are drawn from a Poisson distribution with its source's rate, inverted at a hash of its ident
    and the seed, and never exceed max_repeats. Documents without tokens (null or empty texts), and those of null or unnamed
    sources, give no rows; repeated rows of one ident are documents that draw alike. Rows land in a task by hash and are
    ordered within it by another hash, so equal seeds give equal corpora.
    """
    drawn = _drawn(_sized(docs, ident, text, [text], folder, ranks), targets, ident, total, seed)
    size = drawn.agg(F.coalesce(F.sum(F.col("_bytes") * F.col("copies")), F.lit(0))).first()[0]
    mixed = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    spot = lambda k: F.xxhash64(ident, "copy_no", F.lit(seed + k))
    return mixed.repartition(shuffle_tasks(size), spot(1)).sortWithinPartitions(spot(2), ident, "copy_no").select(ident, "source", "copy_no", "tokens", text)


def _sized(docs: DataFrame, ident: str, text: str, keep: list[str], folder: str, ranks: str) -> DataFrame:
    """ident, source, tokens and the kept columns of documents with tokens and a source, staged."""
    known = docs.where(F.col(ident).isNotNull() & F.col("source").isNotNull())
    return stage(token_counts(known, ident, text, ["source", *keep], folder, ranks), "tokens").where("tokens > 0")


def _drawn(sized: DataFrame, targets: DataFrame, ident: str, total: float | None, seed: int) -> DataFrame:
    """Documents with their number of copies, those with none left out."""
    rates = mixing_plan(sized, targets, ident, total, seed).select("source", "cap", "rate")
    return sized.join(broadcast_if(rates, 100_000), "source").withColumn("copies", poisson_copies(_unit(ident, seed), F.col("rate"), F.col("cap"))).where("copies > 0")


def mixture_shares(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", total: float | None = None, seed: int = 3, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """For each target source: target_share, max_repeats, available and mixed tokens, documents, copies, actual_share."""
    sized = _sized(docs, ident, text, [], folder, ranks)
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    got = _drawn(sized, targets, ident, total, seed)
    got = got.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    whole = got.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0))).first()[0]
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = goals.join(have, "source", "left").join(got, "source", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("available_tokens", "documents", "copies", "most_repeats", "mixed_tokens")]
    return out.select("source", "target_share", "max_repeats", *zero, (F.coalesce("mixed_tokens", F.lit(0)) / F.lit(float(max(whole, 1)))).alias("actual_share"))
