"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed character n-grams (one to three characters) of the lower-cased whole text, with
``1 + log(count)`` times an inverse document frequency counted over *all* training documents, scaled
to unit length.  Weights are learned with follow-the-regularised-leader (per-coordinate rates, elastic net), so
most stay exactly zero; a temperature fitted on separate labelled documents calibrates the scores.

Bounds (parameters): weights are fitted on at most about ``per_label`` documents of each label and the
temperature on a quarter as many, both picked by a hash of the id.  Every label is learned, so the model and its sample on the driver grow with the number of labels.  Document frequencies and predictions cover every row.

A text that is null or holds no letter is ``und`` with score 0.  Without any training document
every prediction is ``und``.  Repeated rows are predicted alike; the inputs of a prediction are the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import returned

UNDETERMINED = "und"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray  # float32, one per bucket
    weights: np.ndarray  # float32, bucket x label, mostly zero
    bias: np.ndarray
    temperature: float


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    shift, grams = np.uint64(64 - bits), [c * _M[0]]
    for n in (2, 3):
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ c[i : len(c) - n + 1 + i]) * _M[i]
                h ^= h >> np.uint64(29)
            grams.append(h * _M[0])
    found = np.bincount((np.concatenate(grams) >> shift).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text, int(np.log2(len(idf))))
    v = (1 + np.log(n)).astype(np.float32) * idf[at]
    norm = float(np.sqrt((v * v).sum()))
    return at, v / norm if norm else v


def document_frequencies(texts: DataFrame, text: str, bits: int) -> tuple[int, np.ndarray]:
    """Number of texts and, per bucket, how many hold it; summed on the executors."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << bits, dtype=np.int64), 0
        for b in batches:
            for t in b.iloc[:, 0]:
                df[counts(t, bits)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield returned(pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)}))

    rows = texts.select(F.col(text)).mapInPandas(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(1 << bits, dtype=np.int64), 0
    for r in rows:  # at most one row per bucket
        if r.bucket < 0:
            n = r.n
        else:
            out[r.bucket] = r.n
    return n, out


def learn_weights(
    rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, labels: int, epochs: int, alpha: float, beta: float, l1: float, l2: float
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net, softmax loss; the bias (last row) is not penalised."""
    z, n = np.zeros((buckets + 1, labels)), np.zeros((buckets + 1, labels))
    rng = np.random.default_rng(7)

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        pen = np.where(at == buckets, 0.0, l1)[:, None]
        return np.where(np.abs(zz) <= pen, 0.0, -(zz - np.sign(zz) * pen) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, v, y = rows[k]
            at, v = np.append(at, buckets), np.append(v, 1.0)
            w = weight(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    w = weight(np.arange(buckets + 1))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search on a grid of its logarithm that narrows."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi = np.log(0.02), np.log(50.0)
    for _ in range(4):
        grid = np.linspace(lo, hi, 21)
        k = int(np.argmin([loss(float(np.exp(g))) for g in grid]))
        lo, hi = grid[max(0, k - 1)], grid[min(20, k + 1)]
    return float(np.exp((lo + hi) / 2))


def train(
    docs: DataFrame, text: str, label: str, key: str, *, per_label: int = 400, bits: int = 15, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5,
) -> LanguageModel | None:
    """Learn from the rows of ``docs`` whose text and label are not null."""
    rows = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    rows = rows.where("t IS NOT NULL AND y IS NOT NULL AND t != ''")
    found = rows.groupBy("y").agg(F.count("*").alias("n")).collect()
    if not found:
        return None
    labels = sorted(r.y for r in found)
    docs_n, df = document_frequencies(rows, "t", bits)
    idf = (np.log((1 + docs_n) / (1 + df)) + 1).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((idf, {y: i for i, y in enumerate(labels)}))
    # one scan picks an expected per_label * 1.25 rows of each label by a hash of the id
    most, parts = per_label * 5 // 4, 1 << 30
    pick = F.lit(False)
    for r in found:
        pick = pick | ((F.col("y") == r.y) & (F.pmod("h", F.lit(parts)) < min(parts, parts * most // r.n + 1)))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, of = shared.value
        for b in batches:
            got = [vector(t, idf) for t in b.t]
            yield pd.DataFrame({
                "h": b.h, "y": [of[y] for y in b.y],
                "at": [a.astype("<u4").tobytes() for a, _ in got], "v": [v.astype("<f4").tobytes() for _, v in got],
            })

    sample = rows.where(pick).mapInPandas(features, "h long, y int, at binary, v binary").orderBy("h").limit(2 * most * len(labels)).collect()
    held = [k % 5 == 0 and len(sample) > 20 for k in range(len(sample))]
    read = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["v"], "<f4"), r["y"]) for r in sample]
    fit = [x for x, h in zip(read, held, strict=True) if not h]
    w, bias = learn_weights(fit, 1 << bits, len(labels), epochs, alpha, beta, l1, l2)
    check = [x for x, h in zip(read, held, strict=True) if h] or fit
    logits = np.array([v @ w[at] + bias for at, v, _ in check])
    return LanguageModel(labels, idf, w, bias, fit_temperature(logits, np.array([y for *_, y in check])))


def predict_text(model: LanguageModel | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return UNDETERMINED, 0.0
    at, v = vector(text, model.idf)
    s = (v @ model.weights[at] + model.bias).astype(np.float64) / model.temperature
    p = np.exp(s - s.max())
    p /= p.sum()
    k = int(np.argmax(p))
    return model.labels[k], float(p[k])


def predict(docs: DataFrame, text: str, model: LanguageModel | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus the predicted label and its calibrated probability; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p string, s double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in texts:
            yield returned(pd.DataFrame([predict_text(shared.value, t) for t in b], columns=["p", "s"]))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (pred, score)]
    both = docs.select(*kept, run(F.col(f"`{text}`")).alias("__lang"))
    return both.select(*kept, F.col("__lang.p").alias(pred), F.col("__lang.s").alias(score))
