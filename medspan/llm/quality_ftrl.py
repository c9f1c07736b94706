"""Quality scores by hashed word n-gram logistic regression, trained with FTRL-proximal.

Features of a text: hashed unigrams and bigrams of its words, and n-grams of
one to three word shapes (classes of a word's bytes, and whether the word came
just before), all in one hashed space. A feature's value is its count's share
of the text, damped by a square root. Scores are sparse dot products for a
whole batch at once.

Defined results: a null or empty text has only the bias, and so one fixed
score; repeated rows score alike; an empty table gives no rows. Without any
labelled row of both classes the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspan.llm import _text as T
from medspan.llm._spark import sampled_rows

U = np.uint64
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[128:] = 1
for _i, _b in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SHAPE[_b] = 4 + _i


@dataclass(frozen=True)
class Ftrl:
    """bits: log2 of the hashed space. sample: most labelled texts to fit on, taken in
    the order of a hash of their ids. sample_bytes: most bytes of these together."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    epochs: int = 3
    sample: int = 4000
    sample_bytes: int = 24 << 20


def features(parts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature number, text number, value) of all texts, each pair once."""
    buffer, starts, _ = T.flat(parts, b" ")
    a, b = T.word_spans(buffer)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lower = T.mix(T.span_hash(T.prefix_hash(T.LOWER[buffer]), a, b))
    doc = np.searchsorted(starts, a, "right") - 1
    # a word's shape: its bytes' classes with runs as one, and if it repeats the word before
    kind = _SHAPE[buffer]
    first = np.ones(len(buffer), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[a] = True
    kept = np.flatnonzero(first)
    shape_text = kind[kept]
    sa, sb = np.searchsorted(kept, a), np.searchsorted(kept, b)
    shape = T.mix(T.span_hash(T.prefix_hash(shape_text), sa, sb))
    again = np.zeros(len(a), bool)
    again[1:] = (lower[1:] == lower[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(again, shape ^ U(0x5BD1E995), shape)
    keys, docs = [lower], [doc]
    for values, widths, seed in ((lower, (2,), 11), (shape, (1, 2, 3), 101)):
        for w in widths:
            if len(values) >= w:
                h = T.window_hash(values ^ U(seed * 7919), w)
                same = doc[: len(h)] == doc[w - 1 :]
                keys.append(h[same] + U(w))
                docs.append(doc[: len(h)][same])
    key = (np.concatenate(keys) >> U(64 - bits)).astype(np.int64)
    both = (np.concatenate(docs) << bits) | key
    both, count = np.unique(both, return_counts=True)
    of, feature = both >> bits, both & ((1 << bits) - 1)
    total = np.bincount(of, count, len(parts))
    return feature, of, np.sqrt(count / total[of])


def train(parts: list[bytes], labels: np.ndarray, model: Ftrl = Ftrl()) -> np.ndarray:
    """Weights (the last is the bias): one FTRL-proximal step per text, in a fixed shuffled order."""
    size = 1 << model.bits
    y = np.asarray(labels, float)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        w = np.zeros(size + 1)
        w[-1] = np.log(share / (1 - share))
        return w
    rows = []
    for i, j in T.blocks(parts, 4 << 20):
        feature, of, value = features(parts[i:j], model.bits)
        cut = np.searchsorted(of, np.arange(j - i + 1))
        rows += [(np.append(feature[cut[k] : cut[k + 1]], size), np.append(value[cut[k] : cut[k + 1]], 1.0)) for k in range(j - i)]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    z[-1] = -np.log(share / (1 - share)) * (model.beta / model.alpha + model.l2)
    rng = np.random.default_rng(7)
    for _ in range(model.epochs):
        for k in rng.permutation(len(rows)):
            idx, x = rows[k]
            w = _weights(z[idx], n[idx], model)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y[k]) * x
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / model.alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    return _weights(z, n, model)


def _weights(z: np.ndarray, n: np.ndarray, model: Ftrl) -> np.ndarray:
    return np.where(np.abs(z) <= model.l1, 0.0, -(z - np.sign(z) * model.l1) / ((model.beta + np.sqrt(n)) / model.alpha + model.l2))


def score(parts: list[bytes], weights: np.ndarray, bits: int) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.full(len(parts), weights[-1])
    for i, j in T.blocks(parts, 2 << 20):
        feature, of, value = features(parts[i:j], bits)
        out[i:j] += np.bincount(of, weights[feature] * value, j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def labelled_sample(documents: DataFrame, labels: DataFrame, where, label: str = "quality", model: Ftrl = Ftrl()):
    """(texts, labels) to fit on: rows under where, at most model.sample ids and
    model.sample_bytes, in the order of a hash of the id; one row of each id.

    A doc_id with several labels takes the largest; null texts and labels don't
    take part. The order by hash keeps the sample free of the table's order."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).where(where)
    rows = sampled_rows(known, documents.select("doc_id", "text").where(F.col("text").isNotNull()), model.sample, model.sample_bytes)
    return [r["text"].encode("utf-8", "replace") for r in rows], np.array([int(r["label"] == 1) for r in rows])


def score_quality(documents: DataFrame, weights: np.ndarray, bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and score (0 to 1)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        for batch in batches:
            parts = T.encode(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(parts, shared.value, bits), pa.float64())], ["doc_id", "score"])

    kind = documents.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
