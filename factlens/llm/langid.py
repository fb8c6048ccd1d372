"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features: n-grams of 1 to ``MAX_GRAM`` lower-cased characters hashed into
``BUCKETS`` columns; 1 + log(tf) times the inverse document frequency, rows
of unit length.  Document frequencies and labels are counted over all
training documents.  The weights are fitted by follow-the-regularised-leader
(FTRL-proximal, per-coordinate rates, elastic net) on a sample of at most
``per_lang`` documents of each label, chosen by a hash of their key; a fifth
of the sample is held back to calibrate one temperature.  Every label is
learnt: with more than ``max_labels`` of them ``per_lang`` is lowered, so that
the sample stays bounded; more than ``MOST_LABELS`` (the weights wouldn't fit)
are an error.

Results: text that is null or has no letter is ``und`` with score 0; without
any training document every text is ``und``; with one label all texts get it
with score 1.  Whole texts are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from factlens.llm.common import slices, struct_udf, without

BUCKETS = 1 << 14
MAX_GRAM = 3
PER_LANG = 400
MAX_LABELS = 200
MOST_LABELS = 1000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text, one number a bucket."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    run = np.zeros(len(chars), np.uint32)
    for n in range(min(MAX_GRAM, len(chars))):
        run = (run[:len(chars) - n] + chars[n:]) * _FACTORS[n]
        run ^= run >> np.uint32(15)
        total += np.bincount((run * _FACTORS[-1]) >> shift, minlength=BUCKETS)
    return total


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of one document."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / (np.sqrt((value ** 2).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (buckets x labels)."""
    z = np.zeros((BUCKETS, n_labels))
    n = np.zeros((BUCKETS, n_labels))
    order = np.random.default_rng(0)

    def weights(at):
        za, rate = z[at], (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(za) > L1, -(za - np.sign(za) * L1) / rate, 0.0)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from 0.37 to 20 (golden section on
    its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(t):
        return -np.log(softmax(logits / math.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    a, b, r = -1.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = tf_idf(gram_counts(text), self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _document_frequency(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Documents, and for each bucket the documents that have it."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch.column(0)):
                for t in part.to_pylist():
                    df += gram_counts(t) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    rows = docs.select(F.col(text)).mapInArrow(count, "bucket long, n long")
    total, out = 0, np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows at most
        if r["bucket"] < 0:
            total = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return total, out


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: Column | None = None,
          per_lang: int = PER_LANG, max_labels: int = MAX_LABELS) -> LanguageModel:
    """A model from the rows of ``docs`` whose text and label are not null.
    The sample has at most ``per_lang * max_labels`` rows."""
    key = F.xxhash64(text) if key is None else key
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"),
                       F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("at")) \
        .filter(F.col("text").isNotNull() & F.col("label").isNotNull())
    sizes = rows.groupBy("label").count().limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}: a model of them doesn't fit")
    labels = sorted(r["label"] for r in sizes)
    number = {name: k for k, name in enumerate(labels)}
    if len(labels) > max_labels:
        per_lang = max(1, per_lang * max_labels // len(labels))
    if not labels:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    total, df = _document_frequency(rows.select("text"), "text")
    idf = np.log((1 + total) / (1 + df)) + 1
    # a share of each label by hash, somewhat more than wanted; then exactly the first by hash
    shares = rows.sparkSession.createDataFrame(
        [(r["label"], int(min(1.0, 1.3 * (per_lang + 20) / r["count"]) * (1 << 40))) for r in sizes], "label string, below long")
    wanted = rows.join(F.broadcast(shares), "label").filter(F.col("at") < F.col("below"))  # MOST_LABELS rows at most
    schema = StructType([StructField("bucket", BinaryType()), StructField("count", BinaryType())])

    def pack(texts):
        counts = [gram_counts(t) for t in texts]
        at = [np.flatnonzero(c) for c in counts]
        return [[a.tobytes() for a in at], [c[a].tobytes() for a, c in zip(at, counts, strict=True)]]

    sample = wanted.withColumn("f", struct_udf(schema, lambda: pack)(F.col("text"))) \
        .select("label", "at", F.col("f.bucket").alias("bucket"), F.col("f.count").alias("count"))
    taken: dict[str, int] = {}
    fit, held = [], []
    for r in sorted(sample.collect(), key=lambda r: (r["at"], r["label"], r["bucket"], r["count"])):
        k = taken[r["label"]] = taken.get(r["label"], 0) + 1
        if k > per_lang or not r["bucket"]:
            continue
        counts = np.zeros(BUCKETS, np.int64)
        counts[np.frombuffer(r["bucket"], np.int64)] = np.frombuffer(r["count"], np.int64)
        (held if k % 5 == 0 else fit).append((*tf_idf(counts, idf), number[r["label"]]))
    weights = fit_ftrl(fit, len(labels))
    logits = np.array([x @ weights[at] for at, x, _ in held]).reshape(-1, len(labels))
    return LanguageModel(labels, idf, weights, fit_temperature(logits, np.array([y for *_, y in held], int)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the calibrated probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x MOST_LABELS numbers
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def make():
        m = shared.value
        return lambda texts: list(zip(*[m.predict(t) for t in texts], strict=True)) or [[], []]

    done = docs.withColumn("_lid", struct_udf(schema, make)(F.col(text)))
    return without(done, "lang_pred", "score").select("*", "_lid.lang_pred", "_lid.score").drop("_lid")


def has_letter(text: str = "text") -> Column:
    """True where a text isn't null and has a letter, labels or not."""
    return F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
