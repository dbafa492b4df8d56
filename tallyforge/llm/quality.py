"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

A text becomes a sparse vector: word unigrams and bigrams, and uni- to trigrams of word shapes
(runs of lower case, upper case, digits, letters beyond ASCII and each sign of punctuation, a
word that repeats its predecessor, and how long a word is), all hashed into 2**bits buckets. The weight
of a bucket is the square root of its count, and the vector is scaled to length one. A score is one
sparse dot product.

Defined results: a null or empty text, and one without words, is scored from the bias alone; repeated rows score alike;
extra columns pass through; labels that are null are not learnt from, and of several labels of one document the
lowest counts. With no labels, or an empty table, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.textcore import SPACE, free_name, in_fold, lean, mix, ngram_hashes, seeds, span_hashes, text_chunks, within_rows, word_spans

_SHAPE = np.zeros(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x30:0x3A] = 3
_SHAPE[0x80:] = 4
for _b in range(0x21, 0x7F):
    if _SHAPE[_b] == 0:
        _SHAPE[_b] = _b
_SALT = seeds(6, 7)


@dataclass(frozen=True)
class QualityParams:
    """bits: log2 of the buckets. sample_rows: bound on the labelled rows that are learnt from."""

    bits: int = 18
    sample_rows: int = 6000
    epochs: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.0
    threshold: float = 0.7


def _shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's runs of character classes, and whether it is long."""
    kinds = _SHAPE[data]
    new = np.ones(len(kinds), dtype=bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    at = np.flatnonzero(new & ~SPACE[data])
    runs = kinds[at]
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    hashes = span_hashes(runs, first, last)
    return mix(hashes + np.minimum((ends - starts) // 8, 4).astype(np.uint64))


def feature_rows(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, where each row's entries begin, buckets, values)."""
    mask = np.uint64((1 << bits) - 1)
    for at, to, data, offsets in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        shapes = _shape_hashes(data, starts, ends)
        repeated = np.zeros(len(words), dtype=bool)
        repeated[1:] = words[1:] == words[:-1]
        shapes = np.where(repeated, shapes ^ _SALT[5], shapes)
        keys, rows = [], []
        row = np.repeat(np.arange(to - at), np.diff(bounds))
        for salt, (source, n) in zip(_SALT, ((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3)), strict=False):
            ok = within_rows(bounds, n, len(source))
            keys.append((mix(ngram_hashes(source, n)[ok] ^ salt) & mask))
            rows.append(row[: len(ok)][ok])
        key = np.concatenate(keys) | (np.concatenate(rows).astype(np.uint64) << np.uint64(bits))
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        row = (key >> np.uint64(bits)).astype(np.int64)
        value = np.sqrt(count.astype(np.float64))
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=to - at))
        value /= np.maximum(norm[row], 1e-12)
        yield at, to, np.searchsorted(row, np.arange(to - at + 1)), (key & mask).astype(np.int64), value


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, params: QualityParams) -> np.ndarray:
    """Weights by bucket with the bias behind them, after params.epochs passes in the given order."""
    size = (1 << params.bits) + 1
    z, n, bias = np.zeros(size), np.zeros(size), size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * params.l1) / ((params.beta + np.sqrt(ni)) / params.alpha + params.l2)
        return np.where(np.abs(zi) <= params.l1, 0.0, w)

    for _ in range(params.epochs):
        for (at, value), label in zip(examples, labels, strict=True):
            at, value = np.append(at, bias), np.append(value, 1.0)
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(value @ w, -35, 35))) - label) * value
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / params.alpha * w
            n[at] = grown
    return weights(np.arange(size))


def fit(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """Weights learnt from at most params.sample_rows labelled documents outside the held-out fold.

    The rows with the lowest hash of their id are taken, so the sample does not depend on the layout of the tables. The model is
    trained in one task on that bounded sample and comes back as 2**bits + 1 numbers.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column(0), batch.column(2)
            for at, to, bounds, buckets, values in feature_rows(batch.column(1), params.bits):
                part = [
                    pa.array(ids[at:to]), pa.array(label[at:to]),
                    pa.array([buckets[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([values[a:b].astype("<f4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(part, names=["doc_id", "_label", "_at", "_value"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("doc_id")
        group = group.iloc[np.argsort(mix(group["doc_id"].to_numpy(np.int64).astype(np.uint64)), kind="stable")]
        examples = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for a, v in zip(group["_at"], group["_value"])]
        w = ftrl(examples, (group["_label"].to_numpy() > 0).astype(float), params)
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()]})

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("_label", T.LongType()),
        T.StructField("_at", T.BinaryType()), T.StructField("_value", T.BinaryType()),
    ])
    rows = texts.select(F.col("doc_id").cast("long"), "text", F.col("_label").cast("long")).mapInArrow(lean(featurise), schema)
    model = rows.groupBy(F.lit(1).alias("_one")).applyInPandas(train, "weights binary").collect()
    if not model:
        return np.zeros((1 << params.bits) + 1, dtype=np.float32)
    return np.frombuffer(model[0]["weights"], "<f4")


def score(documents: DataFrame, weights: np.ndarray, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows with quality_score, in [0, 1], and quality_pred, 1 where the score reaches the threshold."""
    model = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for at, to, bounds, buckets, values in feature_rows(batch.column("text"), params.bits):
                row = np.repeat(np.arange(to - at), np.diff(bounds))
                out[at:to] = np.bincount(row, weights=values * w[buckets], minlength=to - at)
            scores = 1.0 / (1.0 + np.exp(-np.clip(out + float(w[-1]), -35, 35)))
            cols = [*batch.columns, pa.array(scores), pa.array((scores >= params.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "quality_score", "quality_pred"])

    documents = documents.drop("quality_score", "quality_pred")
    schema = T.StructType([*documents.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_pred", T.IntegerType())])
    return documents.mapInArrow(lean(run), schema)


def reject(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with, also such as have the names of its own."""
    away = {c: free_name(c + "_", documents.columns) for c in ("quality_score", "quality_pred") if c in documents.columns}
    kept = score(documents.withColumnsRenamed(away), fit(documents, labels, params), params).where(F.col("quality_pred") == 1)
    return kept.drop("quality_score", "quality_pred").withColumnsRenamed({v: k for k, v in away.items()}).select(*documents.columns)
