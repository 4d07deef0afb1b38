"""Quality classifier by positive-unlabelled learning with non-negative unbiased risk.

Every text becomes a few dozen shares and rates (letters, case, symbols, repeats, lines) and
its words' counts, hashed with signs into ``BUCKETS``. Trusted positives P (label 1) and
unlabelled texts U (all of them, whatever their label) train a linear model on these, and on
squares and random cosines of the rates, by gradient descent on the non-negative risk

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

with the sigmoid loss l; where the second term falls below 0, its gradient is reversed.
Labels 0 are never read as such. The class prior is estimated from P and U alone: a score
that ranks by the ratio of their densities is fitted on one half and counted on the other,
and the share of U beyond a threshold over the share of P beyond it bounds the prior.

Features of all documents are computed once, where the texts are, and written; only they
are joined with labels. Nothing is sampled: every pass sums over all rows where they are,
and a vector of sums comes to the driver.

Defined cases: null and empty texts have the features of a text without words and get a
score. Repeated rows are kept. A document with labels of both kinds isn't trusted; rows of
labels with nulls aren't read. Without trusted documents the score is 0.5 for every text.
A null doc_id has no label. Other columns of docs are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .shingles import chunks, distinct, word_hashes

COSINES, BINS = 64, 1024
STEPS, RATE, DECAY = 40, 0.05, 1e-3

_UPPER, _LOWER, _DIGIT, _POINT, _SYMBOL, _SPACE, _LINE, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[32:127] = _SYMBOL
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = _POINT
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = _SPACE, _LINE
_LINES = re.compile(rb"\n+")
#: Rates, buckets of hashed words, and both.
RATES, BUCKETS = 24, 64
FEATURES = RATES + BUCKETS
#: The model's inputs: rates, their squares, cosines, words, one.
WIDTH = 2 * RATES + COSINES + BUCKETS + 1


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    parts = [np.empty((0, FEATURES), np.float32)]
    for _, run in chunks(texts):
        out = []
        words, bounds = word_hashes(run)
        follow = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)
        for raw, lo, hi in zip(run, bounds[:-1].tolist(), bounds[1:].tolist()):
            n, size = hi - lo, len(raw)
            kind = _CLASS[np.frombuffer(raw, np.uint8)]
            share = np.bincount(kind, minlength=8)[:8] / max(1, size)
            row = [np.log1p(n) / 5, np.log1p(size / max(1, n)), *share]
            w = words[lo:hi]
            if n:
                _, count = np.unique(w, return_counts=True)
                top = np.sort(count)[-10:]
                row += [len(count) / n, len(count) / n**0.8, top[-1] / n, top.sum() / n, np.sum(w[1:] == w[:-1]) / n, np.sum(w[2:] == w[:-2]) / n, np.sum(count == 1) / n]
            else:
                row += [0.0] * 7
            row.append(len(distinct(follow[lo : hi - 2])) / (n - 2) if n > 4 else 1.0)
            lines = [x for x in _LINES.split(raw) if x]
            row += [len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))) / 10]
            turns = np.count_nonzero(kind[1:] != kind[:-1]) if size > 1 else 0
            row += [turns / max(1, size), np.count_nonzero((kind[:-1] == _SYMBOL) & (kind[1:] == _SYMBOL)) / max(1, size) if size > 1 else 0.0, np.count_nonzero((kind[:-1] == _UPPER) & (kind[1:] == _UPPER)) / max(1, size) if size > 1 else 0.0]
            top_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=1)
            row.append(top_byte.max() / max(1, size) if size else 0.0)
            sign = np.where((w >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
            out.append(row + (np.bincount((w % np.uint64(BUCKETS)).astype(np.int64), sign, BUCKETS) / max(1.0, np.sqrt(n))).tolist())
        parts.append(np.array(out, np.float32))
    return np.concatenate(parts)


@released
def _features(batches):
    for batch in batches:
        x = features(batch.column(0).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*batch.schema.names[1:], "features"])


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs (not the text) with features, array<float>."""
    rows = docs.select("text", *keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:]) + "features array<float>"
    return rows.mapInArrow(_features, schema)


class PUModel:
    """A linear model on standardised features, squares of the rates among them, and random cosines of these."""

    def __init__(self, prior: float = 0.5, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.prior = prior
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.angle, self.phase = rng.normal(0, 0.3, (RATES, COSINES)), rng.uniform(0, 2 * np.pi, COSINES)
        self.weight = None

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        rates, words = z[:, :RATES], z[:, RATES:] / 3
        return np.concatenate((rates, rates * rates / 3, np.cos(rates @ self.angle + self.phase), words, np.ones((len(z), 1))), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self.expand(x) @ self.weight)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(rows: DataFrame, part) -> np.ndarray:
    """The sum over all rows (features, trusted, fold) of part(features, trusted, fold), a vector: each task sums its own rows."""

    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)
                total = total + part(x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy())
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

    got = rows.select("features", "trusted", "fold").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    return got.sort_values("i")["x"].to_numpy()


def _moments(x, trusted, fold):
    return np.concatenate(([len(x), trusted.sum()], x.sum(0), (x * x).sum(0)))


def _products(model):
    """By fold: sums of the products of all rows' inputs, and of the trusted rows' inputs."""

    def part(x, trusted, fold):
        phi = model.expand(x)
        return np.concatenate([y for f in (0, 1) for y in ((phi[fold == f].T @ phi[fold == f]).ravel(), phi[trusted & (fold == f)].sum(0))])

    return part


def _ratio(products: np.ndarray, positive: np.ndarray, more: float = 30.0) -> np.ndarray:
    """Weights of the ratio of the positives' density to that of all rows, by least squares (closed form)."""
    ridge = np.full(len(positive), 1 + more / max(1.0, positive[-1]))
    ridge[-1] = 1e-6
    return np.linalg.solve(products / max(1.0, products[-1, -1]) + np.diag(ridge), positive / max(1.0, positive[-1]))


def _binned(model, weights):
    """Rows, and trusted ones, by bins of the ratio; a fold's by weights of the other one."""

    def part(x, trusted, fold):
        r = np.where(fold == 0, *(model.expand(x) @ weights[1 - f] for f in (0, 1)))
        at = np.clip((r + 1) / 9 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at[trusted], minlength=BINS))).astype(float)

    return part


def estimated_prior(every: np.ndarray, positive: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among all rows, from both's counts by bins of a score, ascending.

    Beyond any threshold, positives of all rows are at most all rows there: the share is at most the
    quotient of both tails. It is taken where its upper bound (with probability 1 - doubt) is least.
    """
    n, m = every.sum(), positive.sum()
    tails = [np.cumsum(c[::-1]) / c.sum() for c in (every, positive)]
    spread = np.sqrt(np.log(4 / doubt) / 2 / n) + np.sqrt(np.log(4 / doubt) / 2 / m)
    bound = np.where(tails[1] > 0, (tails[0] + (1 + doubt) * spread) / np.maximum(tails[1], 1e-12), np.inf)
    k = int(np.argmin(bound))
    return float(min(1.0, tails[0][k] / tails[1][k]))


def _slopes(model):
    """Sums of the scores and of their slopes by the weights, of trusted rows and of all."""
    weight = model.weight

    def part(x, trusted, fold):
        phi = model.expand(x)
        s = _sigmoid(phi @ weight)
        d = s * (1 - s)  # the sigmoid loss: l(+) = 1-s, l(-) = s
        return np.concatenate(([s[trusted].sum(), s.sum()], d[trusted] @ phi[trusted], d @ phi))

    return part


def fit(rows: DataFrame, steps: int = STEPS) -> PUModel:
    """A model of rows (features, trusted boolean, fold 0 or 1); each step is a pass over all of them."""
    model, start = PUModel(), _summed(rows, _moments)
    if not len(start) or not start[1]:
        return model
    n, known = start[:2]
    model.mean = start[2 : 2 + FEATURES] / n
    model.scale = np.sqrt(np.maximum(0, start[2 + FEATURES :] / n - model.mean**2)) + 1e-6
    products, positive = [], []
    for half in np.split(_summed(rows, _products(model)), 2):
        products.append(half[: WIDTH * WIDTH].reshape(WIDTH, WIDTH))
        positive.append(half[WIDTH * WIDTH :])
    every, trusted = np.split(_summed(rows, _binned(model, [_ratio(p, q) for p, q in zip(products, positive)])), 2)
    model.prior = prior = estimated_prior(every, trusted)
    # The squared loss has a closed form, 2 * prior * ratio - 1: where the descent starts.
    w = 6 * prior * _ratio(sum(products), sum(positive))
    w[-1] -= 3
    first, second = np.zeros(WIDTH), np.zeros(WIDTH)
    for t in range(1, steps + 1):
        model.weight = w
        got = _summed(rows, _slopes(model))
        up = prior * got[2 : 2 + WIDTH] / known
        down = got[2 + WIDTH :] / n - up
        g = down - up if got[1] / n >= prior * got[0] / known else -down
        g += DECAY * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model.weight = w
    return model


def learn(features: DataFrame, labels: DataFrame) -> PUModel:
    """A model from features (doc_id, features) and labels (doc_id, quality); neither holds held-out rows."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    good = marked.where("low = 1 and high = 1").select("doc_id", F.lit(True).alias("trusted"))
    rows = features.select("doc_id", "features", F.pmod(F.xxhash64("doc_id", "features"), F.lit(2)).cast("int").alias("fold"))
    named = rows.where("doc_id is not null").join(good, "doc_id", "left")
    joined = named.select("features", F.coalesce("trusted", F.lit(False)).alias("trusted"), "fold").union(rows.where("doc_id is null").select("features", F.lit(False), "fold"))
    return fit(written(joined, "quality-rows"))


def scored(features: DataFrame, model: PUModel) -> DataFrame:
    """features' other columns with score (0 to 1) and predicted (1 if score >= 0.5)."""
    others = [f for f in features.schema.fields if f.name != "features"]

    def run(batches):
        for batch in batches:
            x = batch.column(0)
            s = model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others) + "score double, predicted int"
    return features.select("features", *[f.name for f in others]).mapInArrow(run, schema)


def kept(docs: DataFrame, model: PUModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (with a column text) whose score reaches the threshold."""

    @released
    def run(batches):
        for batch in batches:
            s = model.score(features(batch.column("text").to_pylist()).astype(np.float64))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
