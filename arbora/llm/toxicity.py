"""Toxicity by a classifier chain over word and word-start features.

Categories are predicted one after the other; each linear model also gets the
probabilities of the categories before it. In training these are out-of-fold
predictions, so that a later model sees inputs as good as at scoring time.

The chain is fitted on a bounded sample of labelled documents (TRAIN_ROWS, by hash of
the id). Spark counts the features of the sample by category; the features with the
strongest association (TOP_FEATURES a category) are kept, which also bounds what the
driver fits: a list of kept features for each sampled document. Scoring covers the
whole text of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from arbora.llm.common import written

#: Names of the categories in the chain's order, each with its label as SQL over the label table.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0"))
#: About so many labelled documents are used for training, and so many features a category.
TRAIN_ROWS, TOP_FEATURES, FOLDS = 20_000, 512, 5
STARTS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
CACHE = 1 << 17


class Features(dict):
    """Feature hashes of a word: itself and its starts."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        starts = [word[:n] + "*" for n in STARTS if len(word) > n]
        f = self[word] = tuple(xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in (word, *starts))
        return f


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words of a text."""
    return set(WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """Weights of the kept features, one vector for each category; ``links`` weigh earlier probabilities."""
    names: list[str]
    index: dict[int, int]
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, kept: list[np.ndarray]) -> np.ndarray:
        """Rows: documents given as lists of kept features; columns: categories."""
        p = np.zeros((len(kept), len(self.names)))
        flat = np.concatenate([*kept, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
        for c in range(len(self.names)):
            z = np.bincount(row, weights=self.weights[c][flat], minlength=len(kept)) + self.bias[c]
            p[:, c] = _sigmoid(z + p[:, :c] @ self.links[c, :c])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(row, flat, n, dense, y, features, steps=300, rate=0.2, ridge=1e-4):
    """Logistic regression on sparse presence features and a few dense columns (Adam, full batches)."""
    w = np.zeros(features + dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    if not len(y) or y.min() == y.max():
        w[-1] = 30.0 if len(y) and y[0] else -30.0
        return w
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[flat], minlength=n) + dense @ w[features:-1] + w[-1]
        r = (_sigmoid(z) - y) / n
        g = np.r_[np.bincount(flat, weights=r[row], minlength=features), dense.T @ r, r.sum()]
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _scores(w, row, flat, n, dense, features):
    return _sigmoid(np.bincount(row, weights=w[flat], minlength=n) + dense @ w[features:-1] + w[-1])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold predictions; 0.5 is kept where it is as good."""
    best, cut = -1.0, 0.5
    for t in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
        f1 = 2 * np.sum((p >= t) & (y > 0)) / max(1, np.sum(p >= t) + np.sum(y > 0))
        if f1 > best + 1e-9:
            best, cut = f1, t
    return cut


def fit_chain(kept: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, names: list[str], features: list[int]) -> Chain:
    """Fits the chain. ``labels`` is documents x categories, NaN where unknown; ``folds`` numbers a fold for each document."""
    n, f, c = len(kept), len(features), len(names)
    chain = Chain(names, {h: k for k, h in enumerate(features)}, np.zeros((c, f)), np.zeros((c, c)), np.full(c, -30.0), np.full(c, 0.5))
    oof = np.zeros((n, c))
    lengths = np.array([len(k) for k in kept], dtype=np.int64)

    def part(rows):
        return (np.repeat(np.arange(len(rows)), lengths[rows]),
                np.concatenate([*[kept[i] for i in rows], np.zeros(0, dtype=np.int64)]).astype(np.int64), len(rows), oof[rows][:, :k])

    for k in range(c):
        known = np.flatnonzero(~np.isnan(labels[:, k]))
        column = np.zeros(n)
        for fold in range(FOLDS):
            rows = known[folds[known] != fold]
            w = _fit(*part(rows), labels[rows, k], f)
            out = np.flatnonzero(folds == fold)
            column[out] = _scores(w, *part(out), f)
        w = _fit(*part(known), labels[known, k], f)
        chain.weights[k], chain.links[k, :k], chain.bias[k] = w[:f], w[f:f + k], w[-1]
        oof[:, k] = column
        chain.thresholds[k] = _threshold(column[known], labels[known, k])
    return chain


def training_sample(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y): labelled documents below a hash that about ``rows`` of the labels have."""
    y = labels.groupBy("doc_id").agg(*[F.max(F.expr(f"cast({sql} as double)")).alias(name) for name, sql in categories])
    y = y.where("doc_id is not null").select("doc_id", F.array(*[n for n, _ in categories]).alias("y"))
    share = min(1.0, rows / max(1, labels.count()))
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.join(y, "doc_id").select("doc_id", "text", "y")


def _feature_counts(sample: DataFrame, c: int) -> DataFrame:
    """(feature, positive, total arrays by category), counted by batch and then summed."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Features()
        for batch in it:
            hashes, ys = [], []
            for text, y in zip(batch.column("text"), batch.column("y")):
                f = {h for w in words(text.as_py()) for h in cache[w]}
                hashes.append(np.fromiter(f, dtype=np.int64, count=len(f)))
                ys.append([np.nan if v is None else v for v in y.as_py()])
            y = np.repeat(np.array(ys, dtype=float).reshape(-1, c), [len(h) for h in hashes], axis=0)
            found, where = np.unique(np.concatenate([*hashes, np.zeros(0, dtype=np.int64)]), return_inverse=True)
            out = [pa.array(found, pa.int64())]
            for k in range(c):
                out.append(pa.array(np.bincount(where, weights=np.nan_to_num(y[:, k]), minlength=len(found)).astype(np.int64)))
                out.append(pa.array(np.bincount(where, weights=~np.isnan(y[:, k]), minlength=len(found)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(out, names=["feature", *[f"{x}{k}" for k in range(c) for x in "pn"]])

    schema = "feature long, " + ", ".join(f"{x}{k} long" for k in range(c) for x in "pn")
    parts = sample.mapInArrow(batches, schema)
    return parts.groupBy("feature").agg(*[F.sum(f"{x}{k}").alias(f"{x}{k}") for k in range(c) for x in "pn"])


def _kept_features(docs: DataFrame, index: dict[int, int], columns: list[str], schema: str) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Kept(index)
        for batch in it:
            kept = [cache.of(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in columns], pa.array(kept, pa.list_(pa.int64()))], names=[*columns, "kept"])

    return docs.mapInArrow(batches, f"{schema}, kept array<long>")


class _Kept(dict):
    """Kept features of a word."""

    def __init__(self, index: dict[int, int]):
        self.index, self.features = index, Features()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        f = self[word] = tuple(self.index[h] for h in self.features[word] if h in self.index)
        return f

    def of(self, text: str | None) -> np.ndarray:
        return np.array(sorted({k for w in words(text) for k in self[w]}), dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = TRAIN_ROWS) -> Chain:
    """The chain fitted on a sample of the documents (doc_id, text) that have labels."""
    names = [n for n, _ in categories]
    c = len(names)
    sample = written(training_sample(docs.select("doc_id", "text"), labels, categories, rows), "toxicity-sample")
    counts = written(_feature_counts(sample, c), "toxicity-features")
    sums = sample.agg(*[F.sum(F.col("y")[k]).alias(f"P{k}") for k in range(c)], *[F.count(F.col("y")[k]).alias(f"N{k}") for k in range(c)]).first()
    chosen: set[int] = set()
    for k in range(c):
        positive, total = float(sums[f"P{k}"] or 0), float(sums[f"N{k}"] or 0)
        if not 0 < positive < total:
            continue
        expected = F.col(f"n{k}") * (positive / total)
        z = (F.col(f"p{k}") - expected) / F.sqrt(expected * (1 - positive / total) + 1)
        top = counts.where(f"p{k} >= 2").select("feature", z.alias("z")).where("z > 2").orderBy(F.desc("z"), "feature").limit(TOP_FEATURES)
        chosen.update(r["feature"] for r in top.collect())  # at most TOP_FEATURES
    features = sorted(chosen)
    kept = _kept_features(sample, {h: k for k, h in enumerate(features)}, ["doc_id", "y"], "doc_id long, y array<double>")
    got = kept.orderBy("doc_id").toArrow()  # about TRAIN_ROWS short lists
    y = np.array([[np.nan if v is None else v for v in r] for r in got["y"].to_pylist()], dtype=float).reshape(-1, c)
    lists = [np.array(x, dtype=np.int64) for x in got["kept"].to_pylist()]
    folds = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % FOLDS for i in got["doc_id"].to_pylist()], dtype=np.int64)
    return fit_chain(lists, y, folds, names, features)


def score(df: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., rejected): probabilities of the whole text; rejected by the category `toxic`.

    One row for each input row, null and empty texts and repeated rows included: a text
    without words has the probabilities of no features. An empty table gives an empty result.
    """
    names = chain.names
    cut = names.index("toxic") if "toxic" in names else len(names) - 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Kept(chain.index)
        for batch in it:
            p = chain.probabilities([cache.of(x.as_py()) for x in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, cut] >= chain.thresholds[cut])],
                names=["doc_id", *[f"p_{n}" for n in names], "rejected"])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", rejected boolean"
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, schema)


def without_toxic(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Rows of ``df`` that the chain doesn't reject, with all their columns."""
    cut = chain.names.index("toxic")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Kept(chain.index)
        for batch in it:
            p = chain.probabilities([cache.of(x.as_py()) for x in batch.column(text)])
            yield batch.filter(pa.array(p[:, cut] < chain.thresholds[cut]))

    return df.mapInArrow(batches, df.schema)
