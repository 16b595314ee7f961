"""Quality rules: fixed base rules, then a calibrated logistic regression over hashed n-grams.

The regression sees hashed word unigrams and bigrams and hashed n-grams of 2 and 4 characters (code points), each group as shares of its
own total, so that length has no influence. It is fitted on a bounded sample of labelled rows, its
probability is calibrated on a part of the sample that was held out, and documents are scored in Arrow
slices against a fixed threshold. Scoring needs no shuffle.

Null texts have no words and fail the base rules, as do empty ones. Repeated rows are judged alike. Without
labels of both kinds the regression keeps everything. Empty tables give empty tables; the input's other
columns pass through `quality_stage` unchanged and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkfield.llm.common import IS_SPACE, buffers, give_back_memory, mix, prefix_hash, segment_sum, small_batches, span_hash, text_slices, word_spans
from inkfield.llm.ngrams import char_grams, collect_features, labelled_sample, word_grams

#: Bound of the sample, share of it that calibrates, and size of the hash space.
TRAIN_ROWS, CALIBRATE, BITS = 2500, 5, 18
#: A document is kept from this probability of being good.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first of its kind) for each key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    later = np.zeros(len(k), bool)
    later[1:] = k[1:] == k[:-1]
    many = later.copy()
    many[:-1] |= later[1:]
    a, b = np.empty_like(many), np.empty_like(later)
    a[order], b[order] = many, later
    return a, b


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the contract for each text of a slice."""
    data, off = buffers(texts)
    n = len(off) - 1
    start, stop, row = word_spans(data, off)
    of_byte = np.repeat(np.arange(n), np.diff(off))
    lead = ~IS_SPACE[data] & ((data & 0xC0) != 0x80)
    p = prefix_hash(data)
    # lines with a word, by content; a line ends before a line feed or where its text ends
    feed = np.flatnonzero(data == 0x0A)
    begin = np.union1d(off[:-1][off[:-1] < off[1:]], feed + 1)
    begin = begin[begin < len(data)]
    end = np.minimum(np.append(begin[1:], len(data)), len(data)) if len(begin) else begin
    if len(begin):
        ends_with_feed = data[end - 1] == 0x0A
        end = end - ends_with_feed
        keep = np.searchsorted(start, end, "left") > np.searchsorted(start, begin, "left")
        begin, end = begin[keep], end[keep]
    line_row = np.searchsorted(off, begin, "right") - 1
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    _, later = _twice(mix(span_hash(p, begin, end) ^ salt[line_row])) if len(begin) else (None, np.zeros(0, bool))
    h = span_hash(p, start, stop)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        same = row[:-2] == row[2:]
        w = np.flatnonzero(same)
        key = mix(mix(mix(h[w]) ^ h[w + 1]) ^ h[w + 2])
        many, _ = _twice(mix(key ^ salt[row[w]]))
        for k in range(3):
            covered[w[many] + k] = True
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": segment_sum(lead, of_byte, n),
        "n_symbols": segment_sum(SYMBOL[data], of_byte, n),
        "n_dup_lines": segment_sum(later, line_row, n),
        "n_repeat_words": segment_sum(covered, row, n),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def _groups(texts: pa.Array):
    data, off = buffers(texts)
    start, stop, row = word_spans(data, off)
    h = span_hash(prefix_hash(data), start, stop)
    yield word_grams(h, row, (0,), 1)
    yield word_grams(h, row, (0, 1), 2)
    yield char_grams(data, off, 2, 3)
    yield char_grams(data, off, 4, 4)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value), sorted by row: the share of each group's grams in a bucket."""
    n, keys, values = len(texts), [], []
    for h, row in _groups(texts):
        total = np.bincount(row, minlength=n)
        key, count = np.unique((row.astype(np.int64) << BITS) | _buckets(h), return_counts=True)
        keys.append(key)
        values.append(count / np.maximum(total, 1)[key >> BITS])
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return key >> BITS, key & ((1 << BITS) - 1), value


def score(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Log odds without the intercept."""
    out = np.zeros(len(texts))
    for h, row in _groups(texts):
        total = np.bincount(row, minlength=len(out))
        out += np.bincount(row, weights=weights[_buckets(h)], minlength=len(out)) / np.maximum(total, 1)
    return out


def fit(rows: list[tuple], steps: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float, float] | None:
    """(weights, slope, intercept): probability = sigmoid(slope * score + intercept). Both kinds weigh the same
    while the weights are fitted (Adam on the whole sample); calibration restores their true shares."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return None
    held = np.arange(len(rows)) % CALIBRATE == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    idx = np.concatenate([rows[k][2] for k in train]).astype(np.int32)
    val = np.concatenate([rows[k][3] for k in train])
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(rows[k][2]) for k in train])
    each = np.where(y[train] > 0, 0.5 / max(1, (y[train] > 0).sum()), 0.5 / max(1, (y[train] == 0).sum()))
    w, m, v, b = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[idx] * val, minlength=len(train)) + b
        g = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[train])
        grad = np.bincount(idx, weights=g[row] * val, minlength=1 << BITS) + ridge * w * 1e-3
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        b -= rate * g.sum()
    fold = np.flatnonzero(held) if held.any() else train
    z = np.array([(w[rows[k][2].astype(np.int64)] * rows[k][3]).sum() for k in fold])
    return w.astype(np.float32), *platt(z, y[fold])


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept of the calibration, by Newton's method on softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, dev = z.mean(), z.std() or 1.0
    x = np.column_stack([(z - mean) / dev, np.ones(len(z))])
    a = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * np.array([a[0], 0]))
        a -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0] / dev), float(a[1] - a[0] * mean / dev)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    small_batches(docs.sparkSession)
    model = fit(collect_features(labelled_sample(docs, labels, label, TRAIN_ROWS), features))
    give_back_memory()
    return model


def judged(texts: pa.Array, model) -> dict[str, np.ndarray]:
    """Counts, base_failed, quality (probability of being good) and kept for each text of a slice."""
    c = base_counts(texts)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    if model is None:
        p = np.ones(len(texts))
    else:
        p = 1 / (1 + np.exp(-np.clip(model[1] * score(texts, model[0]) + model[2], -30, 30)))
    return c | {"base_failed": failed, "quality": p, "kept": ~failed & (p >= THRESHOLD)}


def rules(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and quality of every document."""
    small_batches(docs.sparkSession)
    named = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    model = docs.sparkSession.sparkContext.broadcast(train(named, labels) if labels is not None else None)
    names = ("doc_id", *COUNTS, "base_failed", "kept", "quality")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            j = judged(b.column("text"), model.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(j[k]) for k in names[1:]]], names=list(names))

    kind = dict(named.dtypes)["doc_id"]
    return named.mapInArrow(task, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, quality double")


def kept_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The input's rows and columns without the rejected documents, in one pass."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels) if labels is not None else None)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield b.filter(pa.array(judged(b.column("text"), model.value)["kept"]))

    return docs.mapInArrow(task, T.StructType(docs.schema.fields))


