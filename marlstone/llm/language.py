"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters over lower-cased letters (anything else is a space) are
hashed to a fixed number of features for each order. Document frequencies come from every
training document. The weights are trained with follow-the-regularised-leader and
elastic-net penalties on about SAMPLE documents a language at most (fewer where there are over
ROWS / SAMPLE languages), chosen by a hash of doc_id; a fifth of them is set aside to calibrate
the temperature of the softmax.

Defined results: a text that is null or has no letter gets `und` and score 0; without
training documents every text gets `und`; repeated rows each get their prediction; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import batch, crc_mod, hash_sample, small_batches, table, text_bytes

ORDERS, BITS = 3, 14
FEATURES = ORDERS << BITS
#: The bounds on the training sample: documents a language, documents and distinct n-grams of documents in
#: all. Every language has its share of either, and one document at least, however many there are.
SAMPLE, ROWS, ENTRIES = 800, 40_000, 20_000_000
UNKNOWN = "und"
#: A filtering stage keeps documents of mixed languages: two halves score about one half each.
REJECT = 0.4
#: Characters counted at once.
SLICE = 1 << 20
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> np.ndarray:
    """How often each feature occurs; all zero if there is no letter."""
    found = np.zeros(FEATURES, np.int64)
    seen, tail = False, np.array([32, 32], np.uint32)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "replace"), np.uint32)
        alpha = letters()[codes]
        seen |= bool(alpha.any())
        codes = np.concatenate([tail, np.where(alpha, codes, 32)]).astype(np.uint32)
        tail = codes[-2:]
        key = codes * MIX[0]
        grams = [key[2:]]
        for k in (1, 2):
            key = (key[:-1] * MIX[1]) ^ (codes[k:] * MIX[k])
            grams.append((key * MIX[2])[2 - k :])
        for k, g in enumerate(grams):
            found[k << BITS : (k + 1) << BITS] += np.bincount(g >> np.uint32(32 - BITS), minlength=1 << BITS)
    return found if seen else np.zeros(FEATURES, np.int64)


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the TF-IDF vector, of length one, of a document with n of the features at."""
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text or "")
        if not self.labels or not found.any():
            return UNKNOWN, 0.0
        at = np.flatnonzero(found)
        at, x = vector(at, found[at], self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Follow the regularised leader, per coordinate: features x classes."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search."""

    def loss(log_t: float) -> float:
        return -np.log(np.maximum(softmax(logits / math.exp(log_t))[np.arange(len(y)), y], 1e-12)).mean()

    low, high, g = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(found: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray) -> Model:
    labels = sorted(set(langs))
    if not labels:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)
    y = np.array([labels.index(x) for x in langs])
    rows = [vector(at, n, idf) for at, n in found]
    aside = np.arange(len(rows)) % 5 == 4
    trained = np.flatnonzero(~aside)
    weights = ftrl([rows[i] for i in trained], y[trained], len(labels))
    held = np.flatnonzero(aside)
    logits = np.array([rows[i][1] @ weights[rows[i][0]] for i in held]).reshape(len(held), len(labels))
    return Model(labels, idf, weights, calibrate(logits, y[held]) if len(held) else 1.0)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """feature, df over all rows of docs; feature -1 counts the documents."""
    schema = pa.schema([("feature", pa.int32()), ("df", pa.int64())])

    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0):
                total += counts(t.as_py().decode()) > 0
                n += 1
        at = np.flatnonzero(total)
        yield batch(schema, pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n)))

    small_batches(docs.sparkSession)
    rows = docs.select(text_bytes(text)).mapInArrow(run, "feature int, df long")
    return rows.groupBy("feature").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, rows: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from the rows of docs with a language for which the condition rows holds."""
    known = docs.where("lang is not null and text is not null").where(F.lit(True) if rows is None else rows).select("doc_id", "text", "lang")
    found = {r.feature: r.df for r in document_frequencies(known).collect()}  # one row a feature at most
    df = np.zeros(FEATURES)
    for f, n in found.items():
        if f >= 0:
            df[f] = n
    idf = np.log((1 + found.get(-1, 0)) / (1 + df)) + 1
    # each language at its own rate, so that no window over a language is needed, and its first row, so that none is left out
    known_ids = known.where("doc_id is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(1, sizes.count())
    each = max(1, min(sample, ROWS // languages))
    share = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = known_ids.select("doc_id", "lang").join(sizes, "lang").where(share < each / F.col("n"))
    first = known_ids.groupBy("lang").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("f")).select("f.doc_id")
    chosen = hash_sample(near.select("doc_id", "lang"), "doc_id", each * languages).select("doc_id").unionByName(first).distinct()
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            vectors = [counts(t.as_py().decode()) for t in b.column(2)]
            at = [np.flatnonzero(v) for v in vectors]
            yield batch(schema, b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([v[a] for v, a in zip(vectors, at, strict=True)], pa.list_(pa.int64())))

    # with more languages than ROWS the ids are no longer few for certain; rows with one id and language count once
    taken = known.join(F.broadcast(chosen) if languages <= ROWS else chosen, "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    taken = taken.select("doc_id", "lang", text_bytes()).mapInArrow(run, "doc_id long, lang string, at array<int>, n array<long>").where(F.size("at") > 0)
    # about 800 rows a language at most, so the window's groups are small
    own = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("before", F.sum(F.size("at")).over(own)).where(F.col("before").isNull() | (F.col("before") + F.size("at") <= ENTRIES // languages))
    sparse, langs = [], []
    for r in taken.drop("before").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").toLocalIterator():
        sparse.append((np.array(r.at, np.int32), np.array(r.n, np.int64)))
        langs.append(r.lang)
    return fit(sparse, langs, idf)


def predictor(model: Model):
    """A column function: text to struct<lang_pred, score>."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict


def accepted(model: Model, least: float = REJECT):
    """A column function: whether a text has a known language with at least that score."""

    @F.pandas_udf("boolean")
    def accept(text: pd.Series) -> pd.Series:
        return text.map(lambda t: model.predict(t)[1] >= least).astype(bool)

    return accept


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_mod("doc_id", 5)
    predict = predictor(train(docs, remainder != 0))
    small_batches(spark)
    found = docs.select("doc_id", (remainder == 0).alias("held_out"), predict(F.coalesce("text", F.lit(""))).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


QUERIES = {"op8_language": op8_language}
SQL: dict[str, str] = {}
