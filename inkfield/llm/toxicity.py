"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so what is sent to
the executors is the few buckets that matter. A feature is present or absent in a text; length has no
influence. Labels are learned only from documents of the training folds; the sample is bounded. Scoring
needs no shuffle and reads whole texts.

doc_id may have any type; its text decides the fold. Null texts score like empty ones: the intercept alone. Labels of one document that disagree are not used.
Without labels every score is 0. A null doc_id is held out. Repeated rows score alike; empty tables give
empty tables; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import LOWER, buffers, give_back_memory, prefix_hash, small_batches, span_hash, text_slices, word_spans
from inkfield.llm.ngrams import collect_features, gram, labelled_sample, word_grams

#: Bound of the sample, size of the hash space, folds and the one that is never learned from.
TRAIN_ROWS, BITS, FOLDS, HELD_OUT = 6000, 20, 3, 1
#: FTRL: learning rate, its offset, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 6.0, 0.01, 12
#: A toxic row counts as so many: few rows are toxic, and most of their words are not.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7
#: Places of the words of a feature: unigram, bigram, skip-grams over one and two words.
SHAPES = ((0,), (0, 1), (0, 2), (0, 3))
#: Lengths in bytes of the stems of a word that are unigrams too: inflected forms share them.
STEMS = (5, 6, 7, 8)
#: Bytes of a word: letters, digits and whatever is not ASCII; all else separates, so marks don't hide a word.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x80:] = True
WORD_BYTE[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789'"]] = True


def presence(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), distinct and sorted: the features each text of a slice has; only the wanted buckets."""
    data, off = buffers(texts)
    data = LOWER[data]
    start, stop, row = word_spans(np.where(WORD_BYTE[data], data, 0x20).astype(np.uint8), off)
    p = prefix_hash(data)
    h = span_hash(p, start, stop)
    found = [word_grams(h, row, offsets, 11 + k) for k, offsets in enumerate(SHAPES)]
    for k in STEMS:
        long = stop - start > k
        found.append((gram([span_hash(p, start[long], start[long] + k)], 31 + k), row[long]))
    keys = []
    for g, r in found:
        bucket = (g >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            hit = np.flatnonzero(wanted[bucket])
            r, bucket = r[hit], bucket[hit]
        keys.append((r.astype(np.int64) << BITS) | bucket)
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, bucket = presence(texts)
    return row, bucket, np.ones(0, np.float32)


def fit(rows: list[tuple], seed: int = 3) -> dict[int, float]:
    """Bucket to weight, zeros left out; bucket -1 is the intercept, which L1 spares."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)
    l1 = np.full((1 << BITS) + 1, L1)
    l1[-1] = 0.0

    def weight(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, (np.sign(z[i]) * l1[i] - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES if rows else 0):
        for k in rng.permutation(len(rows)):
            i = np.append(rows[k][2].astype(np.int64), 1 << BITS)
            w = weight(i)
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, w.sum()))))
            g = (p - rows[k][1]) * (TOXIC_WEIGHT if rows[k][1] else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    hit = np.flatnonzero(w)
    return {(-1 if i == 1 << BITS else int(i)): float(w[i]) for i in hit}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def score(docs: DataFrame, weights: dict[int, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    small_batches(docs.sparkSession)
    base = weights.get(-1)
    sparse = docs.sparkSession.sparkContext.broadcast({k: v for k, v in weights.items() if k >= 0})
    kind = dict(docs.dtypes)[doc_id]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[list(sparse.value)] = list(sparse.value.values())
        for b in text_slices(batches, "text"):
            row, bucket = presence(b.column("text"), w != 0)
            x = np.bincount(row, weights=w[bucket], minlength=b.num_rows) + (base or 0.0)
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30))) if base is not None else np.zeros(b.num_rows)
            ids = b.column("doc_id")
            held = [v is None or zlib.crc32(str(v).encode()) % FOLDS == HELD_OUT for v in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(task, f"doc_id {kind}, held_out boolean, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict[int, float]:
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, TRAIN_ROWS, ~held_out(F.col("id")))
    weights = fit(collect_features(sample, features))
    give_back_memory()
    return weights


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs.select("doc_id", "text"), labels))
