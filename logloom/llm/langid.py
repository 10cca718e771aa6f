"""Operator 2: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the byte n-grams (1 to 4 bytes) of the lower-cased text, hashed to ``DIM`` columns. A text's
value of a feature is its share among the text's n-grams times the inverse document frequency over all
training texts. The weights are trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2)
on a bounded sample of labelled texts, and a temperature, fitted on sampled texts that the training left out,
calibrates the probabilities. As values are shares, the score of a text is a mean over its positions, so
scoring is one pass of table lookups over whole texts.

Bound: ``TRAIN_ROWS`` labelled texts at most (those with the least hash of their id), an eighth of which fit
the temperature. Document frequencies cover all training texts. Training texts are those with a language and
crc32(doc_id) mod 4 <> 2; of a row only its text and language are learnt from.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled text every text
is ``und``; a repeated text gets the same answer; ties go to the language first in order; other columns pass
through ``identify``, those named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, release, table, text_bytes

DIM, ORDERS, TRAIN_ROWS, CHUNK = 1 << 16, (1, 2, 3, 4), 6_000, 250_000
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 1e-4, 1e-6, 3, 30.0
OUTPUTS = ("lang_pred", "score")


def features(data: np.ndarray, bounds: np.ndarray):
    """(n, positions, columns) for each n-gram length: ``positions`` begin n-grams that lie within one text."""
    if not len(data):
        return
    lower = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    rolled, room = np.zeros(len(data), np.uint32), np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    for n in ORDERS:
        # the hash of n bytes from the hash of the n - 1 before the last
        if n > 1:
            rolled = rolled[:len(data) - n + 1]
        rolled = (rolled * np.uint32(0x01000193)) ^ lower[n - 1:len(data)] ^ np.uint32(n << 24)
        mixed = rolled * np.uint32(0x9E3779B1)
        at = np.flatnonzero(room[:len(rolled)] >= n)
        yield n, at, (mixed >> np.uint32(16)).astype(np.int32)[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _frequencies(docs: DataFrame) -> np.ndarray:
    """Texts that have each feature. A task sends DIM counts, whatever its rows."""

    def run(batches):
        release()
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for i in range(len(bounds) - 1):
                seen = np.zeros(DIM, np.uint8)
                lo, hi = bounds[i], bounds[i + 1]
                for _, _, columns in features(data[lo:hi], np.array([0, hi - lo])):
                    seen[columns] = 1
                total += seen
            n += len(bounds) - 1
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(DIM + 1), pa.int32()), "n": pa.array([*total, n], pa.int64())})

    found = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM + 1, np.int64)
    out[found["slot"]] = found["n"]
    return out


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often each), as narrow as they may be: thousands of texts are held at once."""
    data = np.frombuffer(text, np.uint8)
    columns = [c for _, _, c in features(data, np.array([0, len(data)]))]
    if not columns:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    found, counts = np.unique(np.concatenate(columns), return_counts=True)
    return found.astype(np.uint16), counts.astype(np.uint32)


def _vector(row: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = row[0].astype(np.int64), row[1].astype(np.int64)
    return found, counts * idf[found] * (SCALE / counts.sum() if len(counts) else 0.0)


class Model:
    """Languages, a weight for each feature and language (idf and temperature included) and the biases."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.weights, self.bias = langs, weights, bias

    def probabilities(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n, k = len(bounds) - 1, len(self.langs)
        sums, grams = np.zeros((n, k)), np.zeros(n)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        for _, at, columns in features(data, bounds):
            of = doc[at]
            grams += np.bincount(of, minlength=n)
            for j in range(k):
                sums[:, j] += np.bincount(of, self.weights[j][columns], minlength=n)
        z = sums * (SCALE / np.maximum(grams, 1))[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], frequencies: np.ndarray) -> Model:
    """Follow the regularised leader over the texts in their order, then the temperature."""
    langs = sorted(set(labels))
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    k, y = len(langs), np.searchsorted(langs, labels)
    rows = [_counted(t) for t in texts]
    held = np.arange(len(rows)) % 8 == 7 if len(rows) >= 16 else np.zeros(len(rows), bool)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))  # the last row is the bias

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0, w)

    for _ in range(EPOCHS):
        for i in np.flatnonzero(~held):
            at, x = _vector(rows[i], idf)
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    fit = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    vectors = (_vector(rows[i], idf) for i in fit)
    scores = np.array([x @ w[at] + w[DIM] for at, x in vectors])

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(fit)), y[fit]]).mean()

    heat = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    t = float(heat[np.argmin([loss(h) for h in heat])])
    return Model(langs, np.ascontiguousarray((w[:DIM] * idf[:, None] / t).T), w[DIM] / t)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang): training texts only, see above."""
    usable = docs.filter("lang is not null and text is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    border = usable.select(order.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    if border is None:
        return None
    sample = usable.filter(order <= border).select("doc_id", "text", "lang").limit(2 * rows)
    frequencies = _frequencies(usable)

    def run(batches):
        release()
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).sort_by("doc_id")
        model = train([t.encode() for t in whole.column("text").to_pylist()], whole.column("lang").to_pylist(), frequencies)
        yield pa.RecordBatch.from_pydict({"langs": pa.array([model.langs], pa.list_(pa.string())), "weights": [model.weights.astype("<f8").tobytes()],
                                          "bias": pa.array([model.bias.tolist()], pa.list_(pa.float64()))})

    # the bounded sample trains in one task
    got = sample.repartition(1).mapInArrow(run, "langs array<string>, weights binary, bias array<double>").collect()
    if not got:
        return None
    langs = list(got[0]["langs"])
    return Model(langs, np.frombuffer(bytes(got[0]["weights"]), "<f8").reshape(len(langs), DIM), np.array(got[0]["bias"]))


def identify(df: DataFrame, model: Model | None) -> DataFrame:
    """``df`` with lang_pred and score."""
    df = df.drop(*OUTPUTS)
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM weights for each language

    def run(batches):
        release()
        m = shared.value
        for batch in batches:
            column = batch.column("text")
            n = batch.num_rows
            langs, scores = ["und"] * n, np.zeros(n)
            if m is not None and n:
                data, bounds = text_bytes(column)
                for i, j in chunks(bounds, CHUNK):
                    texts = column.slice(i, j - i).to_pylist()
                    p = m.probabilities(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                    for r, (lang, score) in enumerate(zip(p.argmax(axis=1), p.max(axis=1), strict=True), i):
                        if texts[r - i] and has_letter(texts[r - i]):
                            langs[r], scores[r] = m.langs[lang], score
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores)],
                                             [*names, *OUTPUTS])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField(
        "score", T.DoubleType())]))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_langid": op2_langid}
ORACLES: dict[str, str] = {}
