"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other; each model sees word features and the probabilities of the categories
before it, which in training come from models that did not see the row (folds). Models are fitted on a bounded sample:
of the `sample` labels whose ids hash lowest. Everything else covers all rows: every whole text is scored.

Defined cases: a null text is empty and gets the prior; null labels are not used; without labelled rows of both values
of a category its probability is the prior (0 without rows) and nothing is rejected; repeated rows are scored each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import _LOWER, chunks, few_rows, hash_spans, row_key, text_bytes, tidy, trim, word_spans

BITS = 20
SAMPLE = 6_000
FOLDS = 5
#: Least z-score between the classes of a word that a model uses.
SCREEN = 5.0
STEM = 5
_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words and of their first letters, with repeats."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = _LOWER[buf]
    starts, ends = word_spans(buf, offsets, _BREAK)
    row = np.searchsorted(offsets, starts, "right") - 1
    whole = hash_spans(buf, starts, ends)
    long = np.flatnonzero(ends - starts > STEM)
    stem = ~hash_spans(buf, starts[long], starts[long] + STEM)
    shift = np.uint64(64 - BITS)
    return np.concatenate([row, row[long]]), np.concatenate([whole >> shift, stem >> shift]).astype(np.int64)


@dataclass
class Linear:
    words: np.ndarray  # features that count
    weights: np.ndarray
    chain: np.ndarray  # weights of the categories before
    bias: float

    def scores(self, rows: np.ndarray, feats: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(self.words):
            at = np.searchsorted(self.words, feats)
            at[at == len(self.words)] = 0
            hit = self.words[at] == feats
            pairs = np.unique(rows[hit] * len(self.words) + at[hit])  # a word counts once
            np.add.at(out, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(out + before @ self.chain, -40, 40)))


def fit_linear(rows: np.ndarray, feats: np.ndarray, y: np.ndarray, before: np.ndarray, steps: int = 120, l2: float = 1e-3) -> Linear:
    """Logistic regression on words that differ between the classes, by accelerated gradient steps. rows, feats: distinct pairs."""
    n, pos = len(y), int(y.sum())
    if not 0 < pos < n:
        p = min(max(pos / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(np.log(p / (1 - p))))
    one = np.bincount(feats[y[rows] == 1], minlength=1 << BITS)
    every = np.bincount(feats, minlength=1 << BITS)
    p = every / n
    z = (one / pos - (every - one) / (n - pos)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / (n - pos)))
    words = np.flatnonzero((np.abs(z) > SCREEN) & (every > 2))
    at = np.searchsorted(words, feats)
    at[at == len(words)] = 0
    hit = words[at] == feats if len(words) else np.zeros(len(feats), bool)
    r, c, k = rows[hit], at[hit], len(words)
    w = v = np.zeros(k + before.shape[1] + 1)
    row_sizes = np.bincount(r, minlength=n)
    rate, t = 4.0 / (row_sizes.mean() + (row_sizes**2).mean() / max(row_sizes.mean(), 1) + before.shape[1] + 1), 1.0
    for _ in range(steps):
        s = np.bincount(r, v[c], n) + before @ v[k:-1] + v[-1]
        g = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y
        grad = np.concatenate([np.bincount(c, g[r], k), g @ before, [g.sum()]]) / n + l2 * np.append(v[:-1], 0)
        new, t2 = v - rate * grad * 1.0, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return Linear(words, w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    threshold: float  # of the last category

    def probabilities(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack([out, m.scores(rows, feats, n, out)])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap where the F1 value of `p > threshold` is best; 1 if nothing is positive."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
    last = np.flatnonzero(np.append(p[order][1:] != p[order][:-1], True))  # ties go together
    k = last[np.argmax(f1[last])]
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """categories: names with SQL conditions over the columns of labels, in the chain's order; the last is the verdict."""
    marks = labels.select("doc_id", *[F.expr(c).cast("int").alias(k) for k, c in categories.items()]).dropna()
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    marks = marks.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in categories]).withColumn("h", order).orderBy("h").limit(sample)
    # at most `sample` rows of a few numbers go to the texts, not the texts to them
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    with few_rows(docs.sparkSession):
        picked = _feature_rows(rows, [*categories, "h"]).orderBy("h").limit(sample).toArrow()
    n = picked.num_rows
    y = np.column_stack([picked.column(k).to_numpy() for k in categories]) if n else np.zeros((0, len(categories)), int)
    sets = picked.column("feats").combine_chunks() if n else None
    feats = sets.flatten().to_numpy() if n else np.zeros(0, np.int32)
    at = np.repeat(np.arange(n, dtype=np.int32), sets.value_lengths().to_numpy()) if n else np.zeros(0, np.int64)
    fold = np.arange(n) % folds
    outside, models = np.zeros((n, 0)), []
    for j in range(len(categories)):
        own = np.zeros(n)
        for f in range(folds):
            rest, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(held):
                continue
            where = np.full(n, -1)
            where[rest] = np.arange(len(rest))
            used = where[at] >= 0
            m = fit_linear(where[at[used]], feats[used], y[rest, j], outside[rest])
            where[:] = -1
            where[held] = np.arange(len(held))
            used = where[at] >= 0
            own[held] = m.scores(where[at[used]], feats[used], len(held), outside[held])
        models.append(fit_linear(at, feats, y[:, j], outside))
        outside = np.column_stack([outside, own])
    chain = Chain(list(categories), models, best_threshold(outside[:, -1], y[:, -1]))
    del picked, sets, feats, at, outside, y
    trim()
    return chain


def _feature_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(0))
            sets = []
            for i, j in chunks(off):
                r, f = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                pairs = np.unique((r << BITS) | f)
                ends = np.searchsorted(pairs >> BITS, np.arange(j - i + 1))
                pairs &= (1 << BITS) - 1
                sets += [pairs[ends[k] : ends[k + 1]].astype(np.int32) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*[b.column(1 + k) for k in range(len(names))], pa.array(sets, pa.list_(pa.int32()))], [*names, "feats"])

    return rows.select("text", *names).mapInArrow(tidy(run), ", ".join(f"{k} {'long' if k == 'h' else 'int'}" for k in names) + ", feats array<int>")


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Rows (doc_id, key, a probability per category, toxic) for all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{k}" for k in chain.categories]

    def run(batches):
        c = sent.value
        for b in batches:
            buf, off = text_bytes(b.column(2))
            made = [np.zeros((0, len(names)))]
            for i, j in chunks(off):
                made.append(c.probabilities(*features(buf[off[i] : off[j]], off[i : j + 1] - off[i]), j - i))
            p = np.concatenate(made)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] > c.threshold)], ["doc_id", "key", *names, "toxic"])

    return docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, key long, " + ", ".join(f"{k} double" for k in names) + ", toxic boolean"
    )


def reject(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs without the rows whose last category is found; the text is scored where it lies, nothing is shuffled. All columns stay, whatever
    their names; null texts are scored as empty ones and stay null; repeated rows are judged alike; an empty table stays empty."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(chain), docs.schema
    at = docs.columns.index("text")

    def run(batches):
        c = sent.value
        for b in batches:
            buf, off = text_bytes(b.column(at).cast(pa.string()))
            keep = [np.zeros(0, bool)]
            for i, j in chunks(off):
                keep.append(c.probabilities(*features(buf[off[i] : off[j]], off[i : j + 1] - off[i]), j - i)[:, -1] <= c.threshold)
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidy(run), schema)
