"""Problem 9: subject areas of documents by seeded non-negative factorisation of the document-term matrix.

The matrix X (documents by terms) is factored into W (documents by components) and H (components by terms) with
alternating multiplicative updates of the Kullback-Leibler objective. One component for each subject is anchored on the
terms of labelled samples, one more takes up wording common to all subjects. A document's row of W is its mixture; the
responsibilities of the components for a document's terms, summed over a sentence, say what the sentence is about.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import code_points, folded, to_signed, word_hashes
from affinis.runtime import spread, stage

#: Labelled samples used at most, least share of all words that makes a word a term (so there are at most its inverse
#: terms), and least count.
MAX_SAMPLES, TERM_SHARE, TERM_COUNT = 20_000, 2e-6, 4
#: Alternations over the corpus, updates of W in each, and weight of the anchors in H.
ROUNDS, INNER, ANCHOR = 4, 3, 0.15
#: Least words of a sentence, and responsibility a subject needs in a sentence that is about it.
MIN_WORDS, MIN_STRENGTH = 3, 0.5
BATCH_CHARS, SLICE = 1_000_000, 100_000

_ENDS = np.array([ord(c) for c in ".!?;…"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]”’»"], np.uint32)


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, text of the word, sentence of the word) over all texts; sentences are numbered from 0, -1 for scraps.

    A sentence ends at . ! ? ; or … before white space, or at a blank line. Runs of fewer than MIN_WORDS words, such as
    short headings, are scraps. Words that begin with a digit have hash 0.
    """
    low = [folded(t) for t in texts]
    h, owner, start, _ = word_hashes(low)
    if not len(h):
        return h, owner, owner
    cp = np.concatenate((code_points("\n".join(low)), np.full(2, 10, np.uint32)))
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 160)
    mark = np.isin(cp, _ENDS)[:-2] & (blank[1:-1] | (np.isin(cp, _CLOSERS)[1:-1] & blank[2:]))
    mark |= (cp[:-2] == 10) & (cp[1:-1] == 10)
    h = np.where((cp[start] >= 48) & (cp[start] <= 57), np.uint64(0), h)
    part = np.searchsorted(np.flatnonzero(mark), start)
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))
    run = np.cumsum(new) - 1
    long = np.bincount(run) >= MIN_WORDS
    number = np.where(long, np.cumsum(long) - 1, -1)
    return h, owner, number[run]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for pdf in batches:
        ids, texts, lo, held = pdf["ident"].to_numpy(), list(pdf["t"]), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > BATCH_CHARS or i == len(texts) - 1:
                yield ids[lo : i + 1], texts[lo : i + 1]
                lo, held = i + 1, 0


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, texts in _parts(batches):
        h, _, s = sentences(texts)
        term, n = np.unique(h[(s >= 0) & (h != 0)], return_counts=True)
        yield pd.DataFrame({"term": to_signed(term), "n": n})


def _lookup(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of each hash in the sorted vocabulary, -1 for others."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def _encode(vocabulary: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _parts(batches):
            h, owner, s = sentences(texts)
            ok = s >= 0
            owner, s, t = owner[ok], s[ok], _lookup(vocabulary, h[ok])
            of_text = np.searchsorted(owner, np.arange(len(ids) + 1))
            total = np.array([len(np.unique(s[a:b])) for a, b in zip(of_text[:-1], of_text[1:])], np.int32)
            known = t >= 0
            first = np.zeros(len(ids), np.int64)
            filled = of_text[:-1] < of_text[1:]
            first[filled] = s[of_text[:-1][filled]]
            terms, place, cut = t[known].astype(np.int32), (s - first[owner])[known].astype(np.int32), np.searchsorted(owner[known], np.arange(len(ids) + 1))
            yield pd.DataFrame({"ident": ids, "sentences": total, "terms": np.split(terms, cut[1:-1]), "place": np.split(place, cut[1:-1])})

    return run


def _slices(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum([len(x) for x in pdf["terms"]])
    lo = 0
    while lo < len(pdf):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
        yield lo, hi
        lo = hi


def responsibilities(h: np.ndarray, terms: np.ndarray, starts: np.ndarray, owner: np.ndarray, rounds: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(Q, W): components' responsibilities for each term and the documents' mixtures, h being terms by components."""
    p = h[terms]
    w = np.full((len(starts), h.shape[1]), 1.0 / h.shape[1], np.float32)
    q = p
    for _ in range(rounds):
        q = p * w[owner]
        q /= np.maximum(q.sum(1, keepdims=True), 1e-30)
        w = np.add.reduceat(q, starts) + np.float32(0.05)
        w /= w.sum(1, keepdims=True)
    return q, w


def _update(h: np.ndarray):
    k = h.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((k, len(h)))
        for pdf in batches:
            pdf = pdf[pdf["terms"].map(len) > 0]
            for lo, hi in _slices(pdf):
                rows = list(pdf["terms"].iloc[lo:hi])
                n = np.array([len(x) for x in rows])
                terms = np.concatenate(rows)
                q, _ = responsibilities(h, terms, np.cumsum(n) - n, np.repeat(np.arange(len(n)), n))
                for c in range(k):
                    acc[c] += np.bincount(terms, weights=q[:, c], minlength=len(h))
        seen = np.flatnonzero(acc.sum(0))
        yield pd.DataFrame({"term": seen.astype(np.int32)} | {f"q{c}": acc[c][seen] for c in range(k)})

    return run


def _judge(h: np.ndarray, names: list[str], least_weight: float):
    k = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["terms"].map(len) > 0]
            for lo, hi in _slices(pdf):
                part = pdf.iloc[lo:hi]
                rows = list(part["terms"])
                n = np.array([len(x) for x in rows])
                owner = np.repeat(np.arange(len(n)), n)
                q, w = responsibilities(h, np.concatenate(rows), np.cumsum(n) - n, owner, 6)
                place = np.concatenate(list(part["place"]))
                cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
                strength = np.add.reduceat(q[:, :k], cut)
                best = strength.argmax(1)
                about = strength[np.arange(len(best)), best] >= MIN_STRENGTH
                hits = np.zeros((len(n), k), np.int32)
                np.add.at(hits, (owner[cut][about], best[about]), 1)
                d, c = np.nonzero((hits > 0) | (w[:, :k] > least_weight))
                yield pd.DataFrame({"ident": part["ident"].to_numpy()[d], "subject": [names[i] for i in c], "about": hits[d, c], "sentences": part["sentences"].to_numpy()[d], "weight": w[d, c].astype(float)})

    return run


def _anchors(samples: pd.DataFrame, vocabulary: np.ndarray, names: list[str]) -> np.ndarray:
    """Counts of the terms (rows) in the samples of each subject (columns)."""
    h, owner, s = sentences(list(samples["t"]))
    number = samples["subject"].map({x: i for i, x in enumerate(names)}).to_numpy()
    t = _lookup(vocabulary, h)
    ok = (t >= 0) & (s >= 0)
    out = np.zeros((len(vocabulary), len(names)))
    np.add.at(out, (t[ok], number[owner[ok]]), 1.0)
    return out


def subject_counts(docs: DataFrame, samples: DataFrame, ident: str = "doc_id", text: str = "text", subject: str = "subject", least_weight: float = 0.01) -> DataFrame:
    """(ident, subject, about, sentences, weight): sentences of a document about a subject, all its sentences, and the
    subject's weight in its mixture; pairs without such a sentence and of no more than least_weight are left out.

    Samples with a null subject or text are skipped. Documents that are null, empty or without a known term are in no
    row. At most MAX_SAMPLES labelled rows are read; the matrix covers all documents and whole texts.
    """
    kind = dict(docs.dtypes)[ident]
    labelled = samples.select(F.col(subject).alias("subject"), F.col(text).alias("t")).where("subject is not null and t is not null").orderBy(F.xxhash64("subject", "t")).limit(MAX_SAMPLES).toPandas()
    names = sorted(labelled["subject"].unique())
    spec = f"ident {kind}, subject string, about int, sentences int, weight double"
    rows = spread(docs.select(F.col(ident).alias("ident"), F.col(text).alias("t"))).where("t is not null and ident is not null")
    counts = stage(rows.mapInPandas(_count_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("n") >= max(TERM_COUNT, TERM_SHARE * total)).toPandas()
    vocabulary = np.sort(frequent["term"].to_numpy(np.int64).view(np.uint64))
    anchors = _anchors(labelled, vocabulary, names) if names and len(vocabulary) else np.zeros((len(vocabulary), len(names)))
    # wording found under many subjects says nothing about any
    per = anchors / np.maximum(anchors.sum(0), 1)
    share = per.max(1) / np.maximum(per.sum(1), 1e-12) if len(names) else np.zeros(0)
    keep = ~((anchors.sum(1) >= 4) & (share < 0.5)) if len(names) else np.zeros(0, bool)
    vocabulary, anchors = vocabulary[keep], anchors[keep]
    if not names or not len(vocabulary):
        return docs.sparkSession.createDataFrame([], spec).withColumnRenamed("ident", ident)
    known = frequent["n"].to_numpy(float)[np.argsort(frequent["term"].to_numpy(np.int64).view(np.uint64))][keep]
    common = known / known.sum()
    anchors /= np.maximum(anchors.sum(0), 1)
    h = np.concatenate((0.9 * anchors + 0.1 * common[:, None], common[:, None]), 1)
    encoded = stage(rows.mapInPandas(_encode(vocabulary), f"ident {kind}, sentences int, terms array<int>, place array<int>"), "encoded")
    cols = [f"q{c}" for c in range(len(names) + 1)]
    for _ in range(ROUNDS):
        got = encoded.select("terms").mapInPandas(_update(h.astype(np.float32)), "term int, " + ", ".join(f"{c} double" for c in cols)).groupBy("term").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
        fresh = np.full_like(h, 1e-9)
        fresh[got["term"].to_numpy()] += got[cols].to_numpy()
        fresh /= fresh.sum(0)
        fresh[:, : len(names)] = (1 - ANCHOR) * fresh[:, : len(names)] + ANCHOR * anchors
        h = fresh
    return encoded.mapInPandas(_judge(h.astype(np.float32), names, least_weight), spec).withColumnRenamed("ident", ident)


def subjects_of(docs: DataFrame, samples: DataFrame, ident: str = "doc_id", text: str = "text", least: float = 0.25) -> DataFrame:
    """(ident, subject) where at least a quarter of the document's sentences are about the subject."""
    return subject_counts(docs, samples, ident, text).where(F.col("about") >= F.col("sentences") * F.lit(least) - 1e-9).where("about > 0").select(ident, "subject").distinct()


def composition(docs: DataFrame, samples: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """For each subject: documents it is a quarter of, sentences about it, and its summed weight in all mixtures. What the
    weights lack of the number of documents with a known term is the weight of wording common to all subjects."""
    c = subject_counts(docs, samples, ident, text, least_weight=0.0)
    quarter = (F.col("about") >= F.col("sentences") * 0.25 - 1e-9) & (F.col("about") > 0)
    return c.groupBy("subject").agg(F.count_if(quarter).alias("documents"), F.sum("about").alias("sentences"), F.sum("weight").alias("weight"))
