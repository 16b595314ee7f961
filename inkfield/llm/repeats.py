"""Removal of repeated byte strings with a sparse enhanced suffix array and its common-prefix interval tree.

Every string of `length` bytes contains an *anchor*: the least hash among its `gram`-byte substrings
(leftmost of equals). Equal strings have their anchors at equal places, so suffixes that start at anchors are
enough, and only anchors whose gram occurs again can matter. Suffixes with one gram are sorted into a
suffix array; its common-prefix intervals are visited from the deepest outwards, joining the sets of their
members, while each set is kept in the order of its members' left contexts. Where a member enters a set,
its neighbours there tell the longest left extension it shares at this depth: an interval whose members
differ further left is a maximal repeat, and all its occurrences are marked, not just neighbours in the array.
An occurrence is covered from its left to its right extension where both together reach `length`.

Suffixes with the same whole context cover each other, and one of them goes on for all. Groups of more than
MEMBERS suffixes are not held in one task. They are split by where a string lies around its anchor: each half of
the places shares more bytes, which become the new grouping key, and suffixes that now agree are merged again;
so a passage shared by a third of all texts costs a few rows an occurrence. A gram that one task sees at more than HOT
places is known to occur again: its rows are dealt over SALTS groups, and one of them stands for all where tasks meet.

Equal texts are one text here. Texts are named by 64-bit hashes; SHA-256 proves that no name stands for two texts,
else others are drawn. Contexts are compared by their bytes in groups and by 128 bits of SHA-256 where a group is split.
repeat_groups() gives the maximal repeats themselves, each with all its occurrences.

Nulls are empty texts. Matches never cross texts; what is repeated within a text counts. Repeated rows are
copies. Empty tables give empty tables; other columns are ignored. Memory follows one text or one group.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import buffers, join_counted, materialise, mix, prefix_hash, quoted, release, sieve, small_batches, span_hash, text_slices

LENGTH, GRAM = 200, 64
#: Suffixes of one group that a task holds.
MEMBERS = 2048
SEEN = 200_000
#: Anchors that a task holds to find the grams at more than HOT places, and the groups that such a gram is dealt over.
ANCHOR_ROWS, HOT, SALTS = 1 << 19, 64, 1024


# ---------------------------------------------------------------- anchors


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i : i + w] for each i, in linear time (running minima from both ends of blocks of w)."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in its row) of the anchors of all strings of `length` bytes in each row."""
    m, w = len(data) - gram + 1, length - gram + 1
    rows = np.flatnonzero(np.diff(off) >= length)
    if m < w or not len(rows):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    start = np.arange(m)
    h = span_hash(prefix_hash(data), start, start + gram)
    place_bits = np.uint64(max(20, int(m).bit_length()))
    best = sliding_min((h >> place_bits << place_bits) | start.astype(np.uint64), w)
    inside = np.zeros(len(best) + 1, np.int64)
    np.add.at(inside, off[rows], 1)
    np.add.at(inside, off[rows + 1] - length + 1, -1)
    at = np.unique(best[np.cumsum(inside)[:-1] > 0] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(off, at, "right") - 1
    return h[at], row, at - off[row]


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """token (hash of the gram), salt, tid, pos of each anchor. texts: tid, text. Salt is 0 but for grams at more than HOT
    places of what a task holds; the first of these comes a second time, with salt 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[tuple] = []

        def out():
            t, d, p = (np.concatenate(c) for c in zip(*found))
            found.clear()
            order = np.lexsort((p, d, t))
            t, d, p = t[order], d[order], p[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
            t, d, p = t[new], d[new], p[new]
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1]
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(t)))
            salt = np.where(size[np.cumsum(head) - 1] > HOT, 1 + (mix(d.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), 0).astype(np.int32)
            more = at[size > HOT]
            cols = (np.append(t, t[more]), np.append(salt, np.zeros(len(more), np.int32)), np.append(d, d[more]), np.append(p, p[more]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "salt", "tid", "pos"])

        held = 0
        for b in text_slices(batches, "text"):
            tid = np.asarray(b.column("tid"))
            new = np.zeros(len(tid), bool)
            for k, t in enumerate(tid.tolist()):
                if t not in seen:
                    new[k] = True
                    seen.add(t)
            if len(seen) > SEEN:
                seen.clear()
            data, off = buffers(b.column("text").filter(pa.array(new)))
            h, row, pos = anchors(data, off, length, gram)
            found.append((h.view(np.int64), tid[new][row], pos))
            held += len(h)
            if held >= ANCHOR_ROWS:
                yield out()
                held = 0
        if held:
            yield out()

    return texts.mapInArrow(task, "token long, salt int, tid long, pos long")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """token, tid, pos of the anchors whose gram occurs at two places or more, read as a sorted stream. The few rows that
    stand for salted ones can come twice."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row; given out already or not
        given = False
        for b in batches:
            cols = [np.asarray(b.column(c)) for c in ("token", "salt", "tid", "pos")]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(held, cols)]
            t, salt, d, p = cols
            same = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            new = np.ones(len(t), bool)
            new[1:] = ~same | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
            t, salt, d, p = t[new], salt[new], d[new], p[new]
            same = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            many = salt > 0
            many[1:] |= same
            many[:-1] |= same
            last = bool(many[-1]) or (given and len(t) == 1)
            if held and given:
                many[0] = False
            held, given = (t[-1], salt[-1], d[-1], p[-1]), last
            yield pa.RecordBatch.from_arrays([pa.array(t[many]), pa.array(d[many]), pa.array(p[many])], names=["token", "tid", "pos"])

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "tid", "pos").mapInArrow(task, "token long, tid long, pos long")


# ---------------------------------------------------------------- suffix groups


def group_extents(left: list[bytes], right: list[bytes], lo: int, hi: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """For each suffix of a group how far it is covered to the left and right of its anchor; (0, 0): not at all.
    left, right: contexts before and from the anchor. Only strings that start lo to hi bytes before it count."""
    n = len(right)
    wide_l, wide_r = max(map(len, left), default=0), max(map(len, right))
    before = [int.from_bytes(x, "little") << 8 * (wide_l - len(x)) for x in left]
    after = [int.from_bytes(x, "big") << 8 * (wide_r - len(x)) for x in right]
    best_l, best_r = [0] * n, [0] * n

    def meet(x: int, y: int, r: int) -> None:
        bits = (before[x] ^ before[y]).bit_length()
        ext = min(wide_l - (bits + 7) // 8, len(left[x]), len(left[y]), hi)
        if max(lo, length - r) <= ext:
            reach = min(r, length - lo)
            for z in (x, y):
                best_l[z] = max(best_l[z], ext)
                best_r[z] = max(best_r[z], reach)

    array = sorted(range(n), key=after.__getitem__)
    depth = []
    for k in range(n - 1):
        x, y = array[k], array[k + 1]
        depth.append(min(wide_r - ((after[x] ^ after[y]).bit_length() + 7) // 8, len(right[x]), len(right[y])))
    if n == 2:
        meet(array[0], array[1], depth[0])
        return list(zip(best_l, best_r))
    # the interval tree, deepest intervals first; a set is its members in the order of their left contexts
    rank = {x: k for k, x in enumerate(sorted(range(n), key=before.__getitem__))}
    member = sorted(range(n), key=before.__getitem__)
    sets: list[list[int]] = [[rank[array[k]]] for k in range(n)]
    of = list(range(n))

    def find(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    for k in sorted(range(n - 1), key=lambda k: -depth[k]):
        r = depth[k]
        if r + hi < length:
            break
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big = sets[a]
        for x in sets[b]:
            i = bisect_left(big, x)
            if i:
                meet(member[x], member[big[i - 1]], r)
            if i < len(big):
                meet(member[x], member[big[i]], r)
            big.insert(i, x)
        sets[b] = []
        of[b] = a
    return list(zip(best_l, best_r))


def _grouped(groups: DataFrame, columns: Sequence[str], solve, names: Sequence[str], kinds: Sequence[pa.DataType], schema: str) -> DataFrame:
    """solve(rows of one gkey, of bounded number) for each gkey: rows of `schema`."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*[b.column(c).to_pylist() for c in columns]):
                if held and row[0] != held[0][0]:
                    if len(held) > 1:
                        out += solve(held)
                    held = []
                held.append(row)
            yield batch(out)
        yield batch(solve(held) if len(held) > 1 else [])

    return groups.select(*columns).repartition("gkey").sortWithinPartitions("gkey").mapInArrow(task, schema)


def _flat(groups: DataFrame, length: int) -> DataFrame:
    """tid, start, stop of what groups of bounded size cover. groups: gkey, tid, pos, ctx, nl, lo, hi."""

    def solve(rows: list[tuple]) -> list[tuple[int, int, int]]:
        _, _, _, _, _, lo, hi = rows[0]
        got = group_extents([r[3][: r[4]] for r in rows], [r[3][r[4] :] for r in rows], lo, hi, length)
        return [(r[1], r[2] - a, r[2] + b) for r, (a, b) in zip(rows, got) if b]

    columns = ("gkey", "tid", "pos", "ctx", "nl", "lo", "hi")
    return _grouped(groups, columns, solve, ("tid", "start", "stop"), [pa.int64()] * 3, "tid long, start long, stop long")


def contexts(found: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """gkey, tid, pos, ctx, nl, lo, hi of anchors. found: tid, token, pos. texts: tid, text, one row for each tid."""
    width = length - gram
    lists = found.groupBy("tid").agg(F.collect_set(F.struct("token", "pos")).alias("at"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", 1 << 18):
            rows = []
            for tid, text, at in zip(b.column("tid").to_pylist(), b.column("text"), b.column("at").to_pylist()):
                raw = memoryview(text.as_buffer())
                for x in at:
                    p = x["pos"]
                    ctx = bytes(raw[max(0, p - width) : p + length])
                    nl = min(p, width)
                    lo, hi = max(0, length - (len(ctx) - nl)), nl
                    if lo <= hi:
                        rows.append((x["token"], tid, p, ctx, nl, 0, width))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["gkey", "tid", "pos", "ctx", "nl", "lo", "hi"])

    return texts.join(lists, "tid").select("tid", "text", "at").mapInArrow(task, "gkey long, tid long, pos long, ctx binary, nl int, lo int, hi int")


def _piece(a: Column, b: Column) -> Column:
    """Bytes of the context from a bytes before the anchor to b bytes after its start."""
    return F.substring("ctx", (F.col("nl") - a + 1).cast("int"), (a + b).cast("int"))


def _eight(c: str) -> Column:
    """The bytes of a long."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _digest(c: Column) -> Column:
    """Half of SHA-256: 128 bits, which no two contexts of any corpus share."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def levels(groups: DataFrame, length: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """(level, kinds, small): rows with `all`, what the strings of a row's places cover together, or its own place where
    the context is too short; the number m of rows of each gkey and all; and one row of each kind of the groups of bounded
    size. What the others hold comes again in the next level, split by where strings lie."""
    level, before = groups.withColumn("gkey", _eight("gkey")), ()
    while True:
        # rows that agree on all that their strings cover are covered by each other
        whole = (F.col("nl") >= F.col("hi")) & (F.length("ctx") - F.col("nl") >= length - F.col("lo"))
        place = F.concat(_eight("tid"), _eight("pos"), F.lit(b"@"))  # 17 bytes, a digest has 16
        content = F.when(whole, _digest(_piece(F.col("hi"), length - F.col("lo")))).otherwise(place)
        level = materialise(level.withColumns({"all": content, "whole": whole}), "suffixes", clean=True)
        kinds = materialise(level.groupBy("gkey", "all").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("tid", "pos")).alias("rep")), "suffix-kinds")
        sizes = materialise(kinds.groupBy("gkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-groups")
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        # one row stands for all of its kind from here on
        reps = materialise(join_counted(kinds.select("gkey", "all", "rep.tid", "rep.pos"), sizes, ["gkey"], "n", total or 0), "suffix-reps")
        which = F.xxhash64("tid", "pos", "gkey")
        kept = sieve(level.drop("whole"), which, reps.select(which.alias("which"))).join(reps, ["tid", "pos", "gkey", "all"])
        if before:  # this level is written
            release(*before)
        if (most or 0) <= MEMBERS:
            yield level, kinds, kept
            return
        kept = materialise(kept, "suffix-contexts", clean=True)
        yield level, kinds, kept.filter(F.col("n") <= MEMBERS)
        before = level, kinds, sizes, reps, kept
        hot = kept.filter(F.col("n") > MEMBERS).filter("lo < hi")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        split = hot.withColumn("part", F.explode(halves)).select("gkey", "tid", "pos", "ctx", "nl", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"))
        # strings that the text is long enough for
        split = split.filter((F.greatest(F.col("lo"), length - (F.length("ctx") - F.col("nl"))) <= F.least("hi", "nl")))
        level = split.withColumn("gkey", _digest(F.concat(F.col("gkey"), F.concat_ws(":", F.lit(""), "lo", "hi", F.lit("")).cast("binary"), _piece(F.col("lo"), length - F.col("hi")))))


def _alike(level: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows whose whole context another row shares."""
    many = kinds.filter("m > 1").select("gkey", "all", "m")
    total = many.agg(F.sum("m")).first()[0] or 0
    return join_counted(level.filter("whole"), many, ["gkey", "all"], "m", total)


def covered(groups: DataFrame, length: int) -> DataFrame:
    """tid, start, stop of all that repeats; spans may overlap. groups as contexts() returns them."""
    out = []
    for level, kinds, small in levels(groups, length):
        equal = _alike(level.select("gkey", "all", "whole", "tid", "pos", "lo", "hi"), kinds)
        out.append(materialise(equal.select("tid", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") + length - F.col("lo")).alias("stop")), "spans"))
        out.append(materialise(_flat(small, length), "spans"))
    return reduce(DataFrame.unionByName, out)


# ---------------------------------------------------------------- texts


def cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """tid, kept (binary), n_removed, n_spans of the texts that have spans. texts: tid, text."""
    lists = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("at"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            rows = []
            for tid, text, at in zip(b.column("tid").to_pylist(), b.column("text"), b.column("at").to_pylist()):
                raw = memoryview(text.as_buffer())
                kept, end, n = [], 0, 0
                for start, stop in sorted((x["start"], x["stop"]) for x in at):
                    if start > end or not n:
                        kept.append(raw[end:start])
                        n += 1
                    end = max(end, stop)
                kept.append(raw[end:])
                left = b"".join(kept)
                rows.append((tid, left, len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tid", "kept", "n_removed", "n_spans", "sha"])

    return texts.join(lists, "tid").select("tid", "text", "at").mapInArrow(task, "tid long, kept binary, n_removed long, n_spans long, sha string")


def named(docs: DataFrame, length: int, doc_id: str | None, text: str) -> tuple[DataFrame, int]:
    """(doc_id, n_bytes, tid, own) of every document, own being the text's SHA-256, and the seed of the names tid, under
    which no name stands for two texts."""
    filled = F.coalesce(F.col(quoted(text)), F.lit(""))
    own = F.unhex(F.sha2(filled, 256))
    who = F.col(quoted(doc_id)) if doc_id else F.lit(None)
    seed = 0
    while True:
        thin = materialise(docs.select(who.alias("doc_id"), F.octet_length(filled).cast("long").alias("n_bytes"), F.xxhash64(F.lit(seed), filled).alias("tid"), own.alias("own")), "bytes")
        if thin.filter(F.col("n_bytes") >= length).groupBy("tid").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a != b").isEmpty():
            return thin, seed
        seed += 1


def shared_texts(docs: DataFrame, seed: int, length: int, gram: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(texts, groups): the distinct texts with an anchor that occurs again, tid and text; and the contexts of these."""
    filled = docs.select(F.col(quoted(text)).alias("text")).filter(F.octet_length("text") >= length).select(F.xxhash64(F.lit(seed), F.col("text")).alias("tid"), "text")
    found = materialise(shared_anchors(anchor_rows(filled, length, gram)), "anchors", clean=True)
    tids = found.select("tid").distinct()
    texts = sieve(filled, F.col("tid"), tids).join(tids, "tid", "left_semi").dropDuplicates(["tid"])
    texts = materialise(texts, "texts", clean=True)
    return texts, contexts(found, texts, length, gram)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    small_batches(docs.sparkSession)
    thin, seed = named(docs, length, doc_id, text)
    texts, groups = shared_texts(docs, seed, length, gram, text)
    changed = materialise(cut(texts, covered(groups, length)).drop("kept"), "cut")
    copies = thin.filter(F.col("n_bytes") >= length).groupBy("tid").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("tid", F.lit(True).alias("copied"))
    of_text = changed.join(copies, "tid", "full")
    d = thin.join(of_text, "tid", "left")
    gone = F.coalesce("copied", F.lit(False))
    return d.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", F.lower(F.hex("own")))).alias("kept_sha256"),
    )


# ---------------------------------------------------------------- the groups themselves


def interval_groups(left: list[bytes], right: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it, members) of every maximal repeat of two suffixes or more of a group.

    The common-prefix intervals of the sorted suffixes are found by a stack scan; in each, the members sorted by their
    left contexts form intervals of a common left extension, by a second scan. A string is maximal to the right by the
    first, and to the left, as its members differ before it or one begins there, by the second."""

    def intervals(keys: list[bytes]) -> list[tuple[int, int, int]]:
        """(depth, first, last) of the common-prefix intervals of ascending keys, that of all included."""
        depth = []
        for x, y in zip(keys, keys[1:]):
            n = min(len(x), len(y))
            depth.append(next((k for k in range(n) if x[k] != y[k]), n) if x[:n] != y[:n] else n)
        out, stack = [], [(0, 0)]
        for k, d in enumerate([*depth, -1]):
            first = k
            while stack and stack[-1][0] > d:
                e, first = stack.pop()
                if first < k and (not out or out[-1][1:] != (first, k)):
                    out.append((e, first, k))
            if d >= 0 and (not stack or stack[-1][0] < d):
                stack.append((d, first))
        return out

    order = sorted(range(len(right)), key=right.__getitem__)
    back = [x[::-1] for x in left]
    out = []
    for r, i, j in intervals([right[k] for k in order]):
        inside = sorted(order[i : j + 1], key=back.__getitem__)
        for e, a, b in intervals([back[k] for k in inside]):
            members = inside[a : b + 1]
            ends = {right[k][r : r + 1] for k in members}
            # with fewer members, or only those of a longer common prefix, the interval is another one's
            if e + r >= length and (len(ends) > 1 or b"" in ends):
                out.append((e, r, sorted(members)))
    return out


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """group (128 bits of the string's SHA-256), n_bytes, doc_id, start (in bytes) of every occurrence of every maximal repeat of at
    least `length` bytes. Repeats are followed as far as the contexts of an anchor reach, length - gram bytes before it
    and length from it: a longer one appears as pieces of that size, and whole texts that are equal as themselves. Where
    a group is split, each half reports the pieces that begin at its places."""
    small_batches(docs.sparkSession)
    thin, seed = named(docs, length, doc_id, text)
    _, groups = shared_texts(docs, seed, length, gram, text)

    def solve(rows: list[tuple]) -> list[tuple]:
        lo, hi = rows[0][4:]
        left, right = [r[2][max(0, r[3] - hi) : r[3]] for r in rows], [r[2][r[3] : r[3] + length - lo] for r in rows]
        out = []
        for e, r, members in interval_groups(left, right, length):
            m = members[0]
            name = hashlib.sha256(left[m][len(left[m]) - e :] + right[m][:r]).hexdigest()[:32]
            out += [(rows[m][0], rows[m][1], name, e, e + r) for m in members if e >= lo]
        return out

    found = []
    kinds_of = (pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64())
    for level, kinds, small in levels(groups, length):
        got = _grouped(small, ("gkey", "all", "ctx", "nl", "lo", "hi"), solve, ("gkey", "all", "group", "before", "n_bytes"), kinds_of, "gkey binary, all binary, group string, before long, n_bytes long")
        at = level.select("gkey", "all", "tid", "pos").join(got, ["gkey", "all"])
        same = _alike(level.select("gkey", "all", "whole", "tid", "pos", "lo", "hi"), kinds)
        same = same.select("tid", "pos", F.lower(F.hex("all")).alias("group"), F.col("hi").cast("long").alias("before"), (F.col("hi") + length - F.col("lo")).cast("long").alias("n_bytes"))
        for part in (at.select(*same.columns), same):
            found.append(materialise(part.select("group", "n_bytes", "tid", (F.col("pos") - F.col("before")).alias("start")), "repeats"))
    copies = thin.filter(F.col("n_bytes") >= length).groupBy("tid").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("tid")
    equal = thin.join(copies, "tid", "left_semi").select(F.lower(F.hex(F.substring("own", 1, 16))).alias("group"), "n_bytes", "doc_id", F.lit(0).cast("long").alias("start"))
    inner = reduce(DataFrame.unionByName, found).distinct().join(thin.select("tid", "doc_id"), "tid")
    return inner.select("group", "n_bytes", "doc_id", "start").unionByName(equal)
