"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs; an n-gram's vector is the product of its letters'
vectors, each permuted (rotated) by its distance to the n-gram's end. A text is the sum of
its n-grams' vectors, a language the sum of the texts known to be in it, and a text's
language is the one whose prototype has the largest cosine with it.

Letters are in lower case; a run of other characters is one gap, which has a vector too.

Defined cases: a null text, or one without letters, is ``und`` with the score 0. Ties go to
the language first by name. Rows with a null lang aren't learned from. Without anything to
learn from, every text is ``und``. Repeated rows are kept and count as often as they
appear. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_literal, released

#: Signs in a vector, letters in an n-gram.
DIM, N = 1024, 3
#: Letters of their own; code points from there on share 128 vectors by their lowest bits. 0 is the gap.
OWN = 0x250
_LETTERS = OWN + 129
#: Characters, texts, and distinct n-grams that are taken together.
CHUNK_CHARS, CHUNK_TEXTS, CHUNK_GRAMS = 200_000, 512, 2048


@lru_cache(maxsize=1)
def _tables():
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    signs = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (_LETTERS, DIM)).astype(np.float32) * 2 - 1
    return letter, [np.roll(signs, N - 1 - k, axis=1) for k in range(N)]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, code of the n-gram) of every n-gram with a letter; a text's ends are gaps."""
    letter, _ = _tables()
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") if t else np.full(2, 32, "<u4") for t in texts]
    c = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    is_letter = letter[c]
    code = np.where(is_letter, np.where(c < OWN, c + 1, OWN + 1 + (c & 127)), 0).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (owner[1:] != owner[:-1])
    keep[0] = True
    code, owner = code[keep], owner[keep]
    gram, m = np.zeros(max(0, len(code) - N + 1), np.int64), len(code)
    for k in range(N):
        gram = gram * _LETTERS + code[k : m - N + 1 + k]
    inside = (owner[: m - N + 1] == owner[N - 1 :]) & (gram > 0)
    return owner[: m - N + 1][inside], gram[inside]


def vectors(grams: np.ndarray) -> np.ndarray:
    """The vector of each n-gram code."""
    _, rolled = _tables()
    out = None
    for k in range(N - 1, -1, -1):
        grams, letters = np.divmod(grams, _LETTERS)
        if out is None:
            out = rolled[k][letters]
        else:
            out *= rolled[k][letters]
    return out


def _counts(owner, gram):
    """(owner, gram, count) of the distinct pairs."""
    key = np.sort((owner << 32) | gram)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))


def bundles(owner, gram, n: int) -> np.ndarray:
    """The sum of n-gram vectors of each of n texts."""
    owner, gram, count = _counts(owner, gram)
    distinct, at = np.unique(gram, return_inverse=True)
    out = np.zeros((n, DIM), np.float32)
    for lo in range(0, len(distinct), CHUNK_GRAMS):  # some thousand vectors at a time, however long a text is
        inside = (at >= lo) & (at < lo + CHUNK_GRAMS)
        weight = np.zeros((n, min(CHUNK_GRAMS, len(distinct) - lo)), np.float32)
        weight[owner[inside], at[inside] - lo] = count[inside]
        out += weight @ vectors(distinct[lo : lo + CHUNK_GRAMS])
    return out


def _slices(texts):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= CHUNK_CHARS or i + 1 - start >= CHUNK_TEXTS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@released
def _sums(batches):
    held: dict[str, list] = {}

    def merged(rows):
        gram = np.concatenate([r[0] for r in rows])
        distinct, at = np.unique(gram, return_inverse=True)
        return distinct, np.bincount(at, np.concatenate([r[1] for r in rows]), len(distinct))

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in _slices(texts):
            owner, gram = ngrams(texts[lo:hi])
            names = sorted(set(langs[lo:hi]))
            of = np.array([names.index(x) for x in langs[lo:hi]])
            k, gram, count = _counts(of[owner], gram)
            for j, name in enumerate(names):
                rows = held.setdefault(name, [])
                rows.append((gram[k == j], count[k == j]))
                if len(rows) > 200:
                    held[name] = [merged(rows)]
    out = []
    for name, rows in held.items():
        gram, count = merged(rows)
        total = np.zeros(DIM)
        for lo in range(0, len(gram), CHUNK_GRAMS):
            total += count[lo : lo + CHUNK_GRAMS] @ vectors(gram[lo : lo + CHUNK_GRAMS]).astype(np.float64)
        out.append((name, total))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.float64()))], names=["lang", "total"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language from docs (text, lang); one vector of DIM numbers for each language comes to the driver."""
    sums = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_sums, "lang string, total array<double>")
    rows = sums.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("total")).collect()
    return {r["lang"]: np.array([p["x"] for p in r["total"]]) for r in sorted(rows, key=lambda r: r["lang"])}


def _predict(names, prototypes, first):
    @released
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score, n_grams = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for lo, hi in _slices(texts) if names else ():
                owner, gram = ngrams(texts[lo:hi])
                x = bundles(owner, gram, hi - lo)
                norm = np.linalg.norm(x, axis=1)
                cosine = x @ prototypes.T / np.maximum(norm, 1e-9)[:, None]
                best = np.argmax(cosine, 1)
                n_grams[lo:hi] = np.bincount(owner, minlength=hi - lo)
                for i in np.flatnonzero(n_grams[lo:hi]):
                    lang[lo + i], score[lo + i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(lang, pa.string()), pa.array(score), pa.array(n_grams)], names=[*batch.schema.names[first:], "lang_pred", "score", "n_grams"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *keep: Column | str, with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred, score (the cosine, from 0 to 1) and n_grams (0 where lang_pred is und).

    with_text: text comes first; as one of ``keep`` it would go to the workers twice.
    """
    names = list(prototypes)
    table = np.array([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()], np.float32).reshape(-1, DIM)
    rows = docs.select("text", *keep)
    first = 0 if with_text else 1
    kept = rows.schema.fields[first:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, n_grams long"
    return rows.mapInArrow(_predict(names, table, first), schema)


def least_cosines(docs: DataFrame, prototypes: dict[str, np.ndarray], doubt: float = 0.001) -> list[float]:
    """By binary logarithm of the number of n-grams, the least cosine of a text in one of the languages.

    It is what all but a share ``doubt`` of docs (text, lang; not learned from) of that length reach, less a tenth, but
    no more than what a text in none of the languages exceeds with odds of ``doubt``: its cosines are sums of
    random signs, with deviations of 1 / sqrt(DIM). Lengths without a document have the value of the next shorter ones, 0 without any.
    """
    size = F.floor(F.log2("n_grams")).cast("int")
    known = predict(docs.where("lang is not null"), prototypes, "lang").where("lang = lang_pred and n_grams > 0")
    low = {r["size"]: r["low"] for r in known.groupBy(size.alias("size")).agg(F.percentile_approx("score", doubt, 10_000).alias("low")).collect()}
    chance = NormalDist().inv_cdf((1 - doubt) ** (1 / max(1, len(prototypes)))) / math.sqrt(DIM)
    out, held = [], 0.0
    for k in range(64):
        held = low.get(k, held)
        out.append(max(0.0, min(chance, 0.9 * held)))
    return out


def reaches(least: list[float]) -> Column:
    """Whether a row of predict() has the cosine that least_cosines() asks for."""
    return F.col("score") >= F.get(array_literal(least, "array<double>"), F.floor(F.log2(F.greatest("n_grams", F.lit(1)))).cast("int"))
