"""Packing by an order-preserving dynamic program.

The documents of a partition, in their order, are one stream of tokens, cut into windows of at most
`length`. A window costs its padding, plus a penalty where it ends: none at the end of a document, a
small one at the end of a sentence, a larger one inside a sentence. With dp over the allowed cuts,
padding is linear in the distance, so the best start of a window is the minimum of dp[i] + i over a
sliding range: a monotone queue gives it in constant time. A second queue holds the starts from which
one hard cut (a full window that ends inside a sentence) leads to here, and windows whose length is a
power of two need no padding and are looked up one by one.

Partitions are packed on their own, so nothing moves between executors; each adds at most one
unfilled window. A program covers whole documents, BLOCK tokens or more, and the next begins at the end of
a document: no document is cut but at the program's price, however long it is. Memory follows one document or BLOCK.
Nulls are empty texts: the end token alone. Repeated rows are separate documents. Empty tables give
empty tables; other columns are ignored, whatever their names. doc_id may have any type.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import quoted, small_batches, text_slices

LENGTH = 1024
#: Price of a cut in tokens of padding.
SENTENCE_CUT, HARD_CUT = 1, 12
#: Tokens that one dynamic program covers at least, the last of a partition apart; it ends with a document.
BLOCK = 1 << 17
#: Pieces of text whose ids are kept between calls.
CACHE = 400_000
#: Where a text may be cut: before a space that follows a character other than white space in Unicode's sense.
CUT = re.compile(r"(?<=\S)(?= )")

NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

_tokenizers: dict[str, tuple] = {}


def _ranks(t) -> dict[bytes, int] | None:
    """Bytes of each token to its id, if the ids are the order of the merges; else null. Byte-level alphabets
    write printable bytes as themselves and the others as the characters from U+0100 on."""
    model, vocabulary = json.loads(t.to_str())["model"], t.get_vocab(with_added_tokens=False)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
    ordered = model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    ordered = ordered and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
    if not ordered or any(c not in byte for w in vocabulary for c in w):
        return None
    return {bytes(byte[c] for c in w): k for w, k in vocabulary.items()}


def tokenizer(path: str):
    """(function from text to ids as bytes, ids after which a sentence may end); one for each process.

    The tokenizer's pattern starts a new match at a space that follows a character other than white space, and
    nothing is merged across matches, so a text is cut there and the ids of its pieces are kept. Behind white
    space there is no cut: a run of it, no-break spaces and line feeds included, can be one token. New pieces are
    merged by the same ranks in a second, faster implementation, where the file's ids are the order of its merges;
    texts with added tokens or three spaces in a row are encoded by the tokenizer itself."""
    if path not in _tokenizers:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        ends = np.zeros(t.get_vocab_size(), bool)
        for s, k in t.get_vocab().items():
            ends[k] = s[-1:] in (".", "!", "?", "Ċ")  # the last: a line feed in byte-level alphabets
        ranks = _ranks(t)
        merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        pieces: dict[str, bytes] = {}  # 4 bytes an id

        def whole(text: str) -> bytes:
            return array("I", t.encode(text, add_special_tokens=False).ids).tobytes()

        def ids(text: str) -> bytes:
            if not text:
                return b""
            if merge is None or "   " in text or any(a in text for a in added):
                return whole(text)
            if len(pieces) > CACHE:
                pieces.clear()
            parts, tail = text.replace(" ", "\0 ").split("\0"), b""
            if not parts[0]:
                del parts[0]
            new = set(parts).difference(pieces)
            # cut behind white space, or at a zero of the text: no such piece is ever kept, so it is always new
            if "\0" in text or any(p[-1].isspace() for p in new):
                *parts, last = CUT.split(text)
                new, tail = set(parts).difference(pieces), array("I", merge(last)).tobytes()
            for p in new:
                pieces[p] = array("I", merge(p)).tobytes()
            return b"".join([pieces[p] for p in parts]) + tail

        _tokenizers[path] = ids, ends
    return _tokenizers[path]


def best_cuts(at: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """at: allowed cuts, ascending, from 0 to the end of the stream; price: of ending a window there.
    Returns the ends of the windows. Between two cuts further apart than `length`, windows are full."""
    n, pos, cost = len(at), at.tolist(), price.tolist()
    dp, back = [0.0] * n, [0] * n
    soft: deque[int] = deque()  # starts at most `length` away, ascending dp + position
    hard: deque[int] = deque()  # starts from which one full window and a second reach
    # starts a power of two before a cut, by cut, shortest first
    even: dict[int, list[int]] = {}
    for k in range(length.bit_length()):
        if 1 << k < length:
            start = np.searchsorted(at, at - (1 << k))
            met = np.flatnonzero(at[start] == at - (1 << k))
            for j, i in zip(met.tolist(), start[met].tolist()):
                even.setdefault(j, []).append(i)
    late = 0
    for j in range(1, n):
        p = pos[j]
        k = j - 1
        v = dp[k] + pos[k]
        while soft and dp[soft[-1]] + pos[soft[-1]] >= v:
            soft.pop()
        soft.append(k)
        while soft and pos[soft[0]] < p - length:
            soft.popleft()
        while late < j and pos[late] < p - length:
            v = dp[late] + pos[late]
            while hard and dp[hard[-1]] + pos[hard[-1]] >= v:
                hard.pop()
            hard.append(late)
            late += 1
        while hard and pos[hard[0]] < p - 2 * length:
            hard.popleft()
        best, arg = float("inf"), 0
        if soft:
            i = soft[0]
            best, arg = dp[i] + pos[i] + length - p, i
        if hard:
            i = hard[0]
            x = dp[i] + pos[i] + 2 * length - p + HARD_CUT
            if x < best:
                best, arg = x, i
        if best == float("inf"):  # a stretch without cuts: full windows, and a last one
            i = j - 1
            d = p - pos[i]
            best, arg = dp[i] + -d % length + (d - 1) // length * HARD_CUT, i
        for i in even.get(j, ()):
            if dp[i] < best:
                best, arg = dp[i], i
        dp[j], back[j] = best + cost[j], arg
    ends, j = [], n - 1
    while j:
        i = back[j]
        stops = [pos[j]]
        while stops[-1] - pos[i] > length:  # hard cuts: full windows from the start
            stops.append(pos[i] + (stops[-1] - pos[i] - 1) // length * length)
        ends += stops
        j = i
    return ends[::-1]


def _pack(docs: list[tuple], ends: np.ndarray, sequence: int, length: int) -> tuple[list[tuple], int]:
    """docs: (doc_id, ids) in order. Rows of the result and the next sequence."""
    stream = np.concatenate([d[1] for d in docs])
    total = len(stream)
    stops = np.cumsum([len(d[1]) for d in docs])
    price = np.full(total + 1, -1, np.int64)
    price[np.flatnonzero(ends[stream]) + 1] = SENTENCE_CUT
    price[stops] = 0
    price[0] = 0
    at = np.flatnonzero(price >= 0)
    rows, d, begin, doc_begin = [], 0, 0, 0
    raw = stream.astype("<u4").tobytes()
    for stop in best_cuts(at, price[at], length):
        offset = 0
        while begin < stop:
            until = min(stop, int(stops[d]))
            doc, ids = docs[d]
            rows.append((doc, begin - doc_begin, until - begin, zlib.crc32(raw[4 * begin : 4 * until]), len(ids), sequence, offset))
            offset += until - begin
            begin = until
            if begin == stops[d]:
                d, doc_begin = d + 1, int(stops[d])
        sequence += 1
    return rows, sequence


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and NUMBERS, one row for each piece. path: of the tokenizer's file."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    kind = named.schema["doc_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, ends = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 33
        held, n = [], 0

        def out():
            nonlocal held, n, sequence
            rows, sequence = _pack(held, ends, sequence, length)
            held, n = [], 0
            ids, *numbers = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, pa.int64()) for c in numbers]], names=["doc_id", *NUMBERS])

        last = np.array([end_id], "<u4").tobytes()
        id_type = None
        for b in text_slices(batches, "text"):
            id_type = b.column("doc_id").type
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.frombuffer(ids_of(t or "") + last, "<u4")
                held.append((doc, ids))
                n += len(ids)
                if n >= BLOCK:
                    yield out()
        if held:
            yield out()

    return named.mapInArrow(task, f"doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in NUMBERS)}")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path(vocabulary))
