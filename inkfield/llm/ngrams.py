"""Hashed n-gram features of Arrow slices of text, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import mix, text_slices

#: Texts of more bytes are scored like all others, but are not used to fit a classifier.
TRAIN_TEXT_BYTES = 1 << 15
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def gram(hashes: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash for each tuple of hashes, by position."""
    h = np.full(len(hashes[0]), salt * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for x in hashes:
        h = mix(h ^ x)
    return h


def word_grams(h: np.ndarray, row: np.ndarray, offsets: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words at i + offsets (ascending, from 0), wherever all are in one row."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = gram([h[o : o + n] for o in offsets], salt)
    same = row[:n] == row[offsets[-1] :]
    return g[same], row[:n][same]


def char_grams(data: np.ndarray, off: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of characters (code points) of each row. data: UTF-8."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if len(start) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a code point's own bytes, packed: no two of them look alike
    size = np.diff(np.append(start, len(data)))
    point = np.zeros(len(start), np.uint64)
    for k in range(4):
        at = np.minimum(start + k, len(data) - 1)
        point |= np.where(size > k, data[at], 0).astype(np.uint64) << np.uint64(8 * k)
    row = np.searchsorted(off, start, "right") - 1
    h = np.full(len(start) - n + 1, salt * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(n):
        h = (h ^ point[k : k + len(h)]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    same = row[: len(h)] == row[n - 1 :]
    return mix(h[same]), row[: len(h)][same]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """id, label and text of at most `rows` documents: the first by a hash of doc_id (as text, of whatever type) among
    those labelled with one value; of rows that repeat a doc_id the least text. Only this many ids are broadcast, and
    only texts of the sample move."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("int").alias("label"))
    if where is not None:
        ids = ids.filter(where)
    ids = ids.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(rows)
    short = docs.filter(F.octet_length("text") <= TRAIN_TEXT_BYTES).select(F.col("doc_id").cast("string").alias("id"), "text")
    return short.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def collect_features(sample: DataFrame, features: Callable) -> list[tuple]:
    """(id, label, buckets, values) of the sample's rows in order of id; features: slice of texts to (row, bucket, value)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            row, bucket, value = features(b.column("text"))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), b.column("label"),
                    pa.array([bucket[i:j].astype("<u4").tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                    pa.array([value[i:j].astype("<f4").tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                ],
                names=["id", "label", "bucket", "value"],
            )

    got = sample.select("id", "label", "text").mapInArrow(task, "id string, label int, bucket binary, value binary").toArrow()
    out = [(r["id"], r["label"], np.frombuffer(r["bucket"], "<u4"), np.frombuffer(r["value"], "<f4")) for r in got.to_pylist()]
    return sorted(out, key=lambda r: r[0])
