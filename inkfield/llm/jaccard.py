"""N-gram Jaccard self-join and its components, by filtering under several global token orders.

A document is its set of word shingles, as 64-bit hashes. For a threshold t, two sets of which neither has
more than n tokens share at least ceil(t * n); so under *any* global order of tokens they share one token
among the first n - ceil(t * n) + 1 of each, and l tokens among the first l - 1 more. The orders here are
independent hash permutations, and each is used with l = a quarter of its prefix:

1. Order A generates candidates: an inverted index over the A-regions, streamed in sorted runs. A run
   names its first set as leader and pairs the others with it.
2. Orders B and C drop pairs whose B-regions or C-regions share fewer than l tokens, from 16-bit fingerprints (with
   their multiplicity, so no true pair is lost). The filters are intersected before any set is fetched.
3. What is left is verified on whole sets, by the full intersection.

Verified links make components. A second round tests what the leaders left open: pairs of one run that are
still in different components. Tokens in more than HOT sets are not paired at all: sets that share no rarer token share l
hot ones, so a prefix filter over their hot tokens, rarest first, finds which sets can. These are fetched whole; linked
ones share need(n) of all their tokens, so a prefix filter over whole sets, tokens in fewest of these sets first, leaves
out whoever has too many of its own, and connects the others to families. A family is compared in
blocks of bounded size: where many sets are outside its largest component, first with some of its sets in every block,
round by round while that halves them; and then these with all. In a block, too, a pair must pass orders B and C before its sets are
intersected. Nothing is capped: every pair that could link is tested or already connected. The blocks of a family grow
with the product of its size and the number of its sets outside its largest component.

A token that one task sees in more than HOT sets is dealt over SALTS groups by set; each group has a leader, and few of
its sets meet the leader of the whole token, so no task gets a third of all rows. Equal sets are one node (copies cost
nothing). Sets are named by 64-bit hashes; a second name proves that none stands for two sets, else others are drawn.

Null and empty texts have an empty set and are linked with nothing, not even with each other. A null doc_id
never names a component that has another member. Repeated rows are equal sets. doc_id may have any type with an order.
Empty tables give empty tables; other columns are ignored. Memory follows one text, one block, or INDEX_ROWS tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import LOWER, buffers, join_counted, materialise, mix, prefix_hash, quoted, release, sieve, small_batches, span_hash, text_slices, whole_row, word_spans
from inkfield.llm.components import components

WORDS, PERCENT = 5, 80
#: A token in more sets than this is hot. Blocks in which sets of hot runs are compared.
HOT, BLOCK = 64, 256
#: Sets of a family that stand in each of its blocks at first.
LEADERS = 8
#: Sets outside the largest component of a family, in blocks and on the mean of sets, that meet all others at once.
FEW = 4
#: Sets that a task remembers, so that copies in one partition are indexed once.
SEEN = 200_000
#: Tokens that a task holds to find those in many of its sets, and the groups that such a token is dealt over.
INDEX_ROWS, INDEX_BATCH, SALTS = 1 << 18, 1 << 16, 64
#: Seed of the name that proves the others.
PROOF = 1 << 40
ORDER_B, ORDER_C = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C2B2AE35)


# ---------------------------------------------------------------- sets


def need(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n must share with any set of at most n that it links with."""
    return -(-n * percent // 100)


def share(n: int, percent: int = PERCENT) -> int:
    """l: tokens that two linked sets, the smaller of n tokens, share in their regions."""
    return (n - need(n, percent) + 1) // 4 + 1


def region(n: int, percent: int = PERCENT) -> int:
    """Length of a region: the prefix, and l - 1 more."""
    return min(n, n - need(n, percent) + share(n, percent))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    data, off = buffers(texts)
    data = LOWER[data]
    start, stop, row = word_spans(data, off)
    h = span_hash(prefix_hash(data), start, stop)
    n = len(off) - 1
    at = np.searchsorted(row, np.arange(n + 1))
    g = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        g = mix(g ^ h[k : k + len(g)]) + np.uint64(k)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(g[a : b - words + 1]))
        elif b > a:  # a short text is one shingle of its own kind
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x ^ w]))[0] + np.uint64(1 << 40)
            out.append(np.array([x], np.uint64))
        else:
            out.append(h[:0])
    return out


def set_name(s: np.ndarray, seed: int = 0) -> int:
    """64 bits that name a set, whatever order its tokens came in; 0 for the empty one."""
    if not len(s):
        return 0
    h = mix(s ^ mix(np.array([seed], np.uint64))[0]).sum(dtype=np.uint64)
    return int(mix(np.array([h ^ np.uint64(len(s))]))[0].view(np.int64))


def fingerprints(s: np.ndarray, order: np.uint64, percent: int) -> np.ndarray:
    """16 bits of each token of the set's region under an order, ascending, with multiplicity."""
    r = region(len(s), percent)
    h = mix(s ^ order)
    if r < len(h):
        h = np.partition(h, r - 1)[:r]
    return np.sort((h & np.uint64(0xFFFF)).astype("<u2"))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays, with multiplicity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    left = np.searchsorted(b, a, "left")
    right = np.searchsorted(b, a, "right")
    first = np.searchsorted(a, a, "left")
    return int(((np.arange(len(a)) - first) < (right - left)).sum())


def _task(of_slice, schema):
    """mapInArrow function that yields of_slice(slice) for each slice of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(of_slice(b), names=schema)

    return task


def signatures(docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """doc_id, key, n, sid, proof and the fingerprints under orders B and C of every document."""

    def of_slice(b):
        sets = shingle_sets(b.column("text"), words)
        prints = [pa.array([fingerprints(s, o, percent).tobytes() for s in sets], pa.binary()) for o in (ORDER_B, ORDER_C)]
        names = [pa.array([set_name(s, x) for s in sets], pa.int64()) for x in (seed, PROOF)]
        return [b.column("doc_id"), b.column("key"), pa.array(map(len, sets), pa.int64()), *names, *prints]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_task(of_slice, ["doc_id", "key", "n", "sid", "proof", "fb", "fc"]), f"doc_id {kind}, key binary, n long, sid long, proof long, fb binary, fc binary")


def index_rows(docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """token, salt, sid, again for each token of each set's A-region; order A is that of the hashes themselves. Salt is 0,
    but for tokens in more than HOT sets of what a task holds; of each of their groups one row comes again with salt 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, names, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t, s = np.concatenate(tokens).view(np.int64), np.concatenate(names)
            order = np.lexsort((s, t))
            x, y = t[order], s[order]
            head = np.ones(len(x), bool)
            head[1:] = x[1:] != x[:-1]
            at = np.flatnonzero(head)
            hot = np.flatnonzero(np.repeat((size := np.diff(np.append(at, len(x)))) > HOT, size))
            salt = np.zeros(len(t), np.int32)
            if len(hot):
                x, y = x[hot], y[hot]
                group = (1 + SALTS // 2 + (y >> 65 - SALTS.bit_length())).astype(np.int32)  # ascending, as y is
                salt[order[hot]] = group
                first = np.ones(len(x), bool)
                first[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1])
                x, y = x[first], y[first]
                yield _index_batch(x, np.zeros(len(x), np.int32), y, np.ones(len(x), bool))
            for k in range(0, len(t), INDEX_BATCH):  # in the order of sets, which packs better than that of tokens
                part = slice(k, k + INDEX_BATCH)
                yield _index_batch(t[part], salt[part], s[part], np.zeros(len(t[part]), bool))

        for b in text_slices(batches, "text"):
            for s in shingle_sets(b.column("text"), words):
                name = set_name(s, seed)
                if name and name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    r = region(len(s), percent)
                    tokens.append(s[:r])
                    names.append(np.full(r, name, np.int64))
                    held += r
                    if held >= INDEX_ROWS:
                        yield from out()
                        tokens, names, held = [], [], 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(task, "token long, salt int, sid long, again boolean")


def _index_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "salt", "sid", "again"])


def full_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """sid and tokens (8 bytes each, ascending) of documents."""

    def of_slice(b):
        sets = shingle_sets(b.column("text"), words)
        return [pa.array([set_name(s, seed) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

    return docs.select("text").mapInArrow(_task(of_slice, ["sid", "tokens"]), "sid long, tokens binary")


# ---------------------------------------------------------------- candidates


def shared_rows(index: DataFrame) -> DataFrame:
    """token, sid, leader, again for the tokens of two sets or more; leader is the least sid of the token and salt.
    Reads sorted rows as a stream: what is kept between batches is one token and two names."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # token, salt, sid and again of the row before, which may be alone so far
        lead, open_ = 0, False  # its leader; whether it has been given out
        for b in batches:
            cols = [np.asarray(b.column(c)) if c != "again" else b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "sid", "again")]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(last, cols)]
            t, salt, s, again = cols
            head = np.ones(len(t), bool)
            head[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
            new = head.copy()
            new[1:] |= s[1:] != s[:-1]
            t, salt, s, again, head = t[new], salt[new], s[new], again[new], head[new]
            at = np.flatnonzero(head)
            run = np.cumsum(head) - 1
            leader = s[at][run]
            if last is not None:
                leader[run == 0] = lead
            many = np.diff(np.append(at, len(t))) > 1
            give = many[run] | (salt > 0)
            if last is not None and open_:
                give[0] = False  # given out before
                give[1:] |= (run == 0)[1:]
            open_ = bool(give[-1]) or bool(len(t) == 1 and last is not None and open_)
            last, lead = (t[-1], salt[-1], s[-1], again[-1]), leader[-1]
            yield pa.RecordBatch.from_arrays([pa.array(t[give]), pa.array(s[give]), pa.array(leader[give]), pa.array(again[give])], names=["token", "sid", "leader", "again"])

    return index.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid", "again").mapInArrow(task, "token long, sid long, leader long, again boolean")


def by_order(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and regions under one order allow a link. prints: sid, n, fp."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [share(min(n, m), percent) for n, m in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())]
            both = zip(batch.column("fa"), batch.column("fb"), least)
            keep = [common(np.frombuffer(x.as_buffer(), "<u2"), np.frombuffer(y.as_buffer(), "<u2")) >= k for x, y, k in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (prints.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("fp").alias(f"f{x}")) for x in ("a", "b"))
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.join(right, "b").join(left, "a").filter(sized).mapInArrow(task, "a long, b long")


def by_orders(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that orders B and C both allow; only the fingerprints of sets in pairs move, those of order C for what
    order B leaves. documents: sid, n, fb, fc."""
    for order in ("fb", "fc"):
        sids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "pair-sets")
        prints = sieve(documents.select("sid", "n", F.col(order).alias("fp")), F.col("sid"), sids).join(sids, "sid", "left_semi").dropDuplicates(["sid"])
        pairs = materialise(by_order(pairs, prints, percent), "filtered", clean=True)
        release(sids)
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by the full intersection. sets: sid, tokens."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        both = common(x, y)
        return 100 * both >= percent * (len(x) + len(y) - both)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("ta"), b.column("tb"))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("sid").alias(x), F.col("tokens").alias(f"t{x}")) for x in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(task, "a long, b long")


def shared_least(n, percent: int):
    """share() as a column."""
    return F.floor((n - F.ceil(n * percent / 100) + 1) / 4) + 1


def open_pairs(rows: DataFrame, group: DataFrame, sets: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that share enough tokens of their A-regions for a link, without the
    leaders' pairs, which have been tested. rows: token, sid, leader, at most HOT for a token; hot: sid, k, the
    number of hot tokens in a set's region, which may be shared as well."""
    known = rows.join(group, "sid", "left").join(sets.select("sid", "n"), "sid").join(hot, "sid", "left")
    known = known.withColumns({"c": F.coalesce("component", "sid"), "k": F.coalesce("k", F.lit(0))})
    lists = known.groupBy("token").agg(F.collect_list(F.struct("sid", "c", "n", "k")).alias("x"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.first("leader").alias("leader"))
    lists = lists.filter((F.col("lo") != F.col("hi")) & (F.size("x") > 2))
    sized = lambda s, o: F.least(s["n"], o["n"]) * 100 >= F.greatest(s["n"], o["n"]) * percent
    pairs = F.flatten(
        F.transform(
            F.filter("x", lambda s: s["sid"] != F.col("leader")),
            lambda s: F.transform(
                F.filter("x", lambda o: (o["sid"] > s["sid"]) & (o["c"] != s["c"]) & (o["sid"] != F.col("leader")) & sized(s, o)),
                lambda o: F.struct(s["sid"].alias("a"), o["sid"].alias("b"), (shared_least(F.least(s["n"], o["n"]), percent) - F.least(s["k"], o["k"])).alias("need")),
            ),
        )
    )
    counted = lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("m"), F.first("p.need").alias("need"))
    return counted.filter("m >= need").select("a", "b")


def hot_rows(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """token, sid, length: for sets that can link by hot tokens alone, the rarest of these, as many as a prefix
    filter needs. rows: token, sid, length of hot tokens."""
    from pyspark.sql import Window

    hot = rows.join(sets.select("sid", "n"), "sid")
    # the least l of any set that may link with one of n tokens
    least = shared_least(F.ceil(F.col("n") * percent / 100), percent)
    w = Window.partitionBy("sid")  # a set's own tokens: bounded by its region
    k = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy("length", "token"))
    return hot.withColumn("k", k).withColumn("rank", rank).filter((F.col("k") >= least) & (F.col("rank") <= F.col("k") - least + 1)).select("token", "sid", "length")


def rarest_rows(sets: DataFrame, percent: int) -> DataFrame:
    """token, sid: of whole sets (sid, tokens) the tokens that a prefix filter needs, those in fewest of these sets first.
    Two that link share one. A token in one set only comes before all others and is left out: a set of which less than
    need(n) tokens are in others has no row."""
    from pyspark.sql import Window

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("tokens")]
            n = np.array([len(t) for t in each], np.int64)
            t = np.concatenate([np.zeros(0, np.int64), *each])
            sid, n = np.repeat(np.asarray(b.column("sid")), n), np.repeat(n, n)
            for k in range(0, len(t), INDEX_BATCH):
                part = slice(k, k + INDEX_BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(t[part]), pa.array(sid[part]), pa.array(n[part])], names=["token", "sid", "n"])

    rows = sets.select("sid", "tokens").mapInArrow(task, "token long, sid long, n long")
    lengths = materialise(rows.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1"), "lengths", clean=True)
    total = lengths.agg(F.sum("length")).first()[0] or 0
    w = Window.partitionBy("sid")  # a set's own tokens
    shared = join_counted(rows, lengths, ["token"], "length", total).withColumn("k", F.count(F.lit(1)).over(w))
    shared = shared.withColumn("least", F.ceil(F.col("n") * percent / 100)).filter("k >= least")
    return shared.withColumn("rank", F.row_number().over(w.orderBy("length", "token"))).filter("rank <= k - least + 1").select("token", "sid")


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the left and right members of each block, as many as join what is still apart there.
    members: block, sid, c (its component so far), left, right; a block has a bounded number of rows. Sizes and
    orders B and C say which pairs may link; shared tokens of all pairs come from products of incidence matrices."""

    def counts(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Size of the intersection of each left with each right member."""
        both = np.zeros((len(left), len(right)), np.float32)
        every, where, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        place = np.cumsum(times > 1) - 1  # only tokens of two sets or more count
        shared = times[where] > 1
        owner, column = owner[shared], place[where[shared]]
        for k in range(0, int((times > 1).sum()), 4096):
            part = (column >= k) & (column < k + 4096)
            m = np.zeros((len(tokens), 4096), np.float32)
            m[owner[part], column[part] - k] = 1
            both += m[left] @ m[right].T
        return both

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        sid, group = [r[1] for r in rows], np.array([r[2] for r in rows])
        tokens = [np.frombuffer(r[5], np.uint64) for r in rows]
        size = np.array([len(t) for t in tokens])
        left, right = np.flatnonzero([r[3] for r in rows]), np.flatnonzero([r[4] for r in rows])
        if not len(left) or not len(right):
            return []
        small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
        able = (100 * small >= percent * large) & (group[left][:, None] != group[right][None, :])
        least = np.array([share(n, percent) for n in range(int(size.max()) + 1)])[small]
        for order in (ORDER_B, ORDER_C):
            if not able.any():
                return []
            able &= counts([t[np.argpartition(mix(t ^ order), region(len(t), percent) - 1)[: region(len(t), percent)]] for t in tokens], left, right) >= least
        if not able.any():
            return []
        both = counts(tokens, left, right)
        x, y = np.nonzero(able & (100 * both >= percent * (small + large - both)))
        root: dict = {}

        def find(k):
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for u, v in zip(left[x].tolist(), right[y].tolist()):
            a, b = find(rows[u][2]), find(rows[v][2])
            if a != b:
                root[a] = b
                out.append((sid[u], sid[v]))
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give(rows):
            got = solve(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("block", "sid", "c", "left", "right", "tokens")]):
                if held and row[0] != held[0][0]:
                    yield give(held)
                    held = []
                held.append(row)
        yield give(held)

    with_tokens = members.join(sets.select("sid", "tokens"), "sid").select("block", "sid", "c", "left", "right", "tokens")
    return with_tokens.repartition("block").sortWithinPartitions("block").mapInArrow(task, "a long, b long")


def families(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """family, sid: sets that hot tokens connect and whose sizes allow a link. Sizes are cut into classes so wide that
    linked sets are in the same or the next; a set is in the family of its class and in that of the class above."""
    nodes = components(rows.select("sid", "token"), "sid", "token").withColumnRenamed("node", "sid").withColumnRenamed("component", "tied")
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.01))
    d = rows.select("sid").distinct().join(nodes, "sid").join(sets.select("sid", "n"), "sid").withColumn("k", F.explode(F.array(size, size + 1)))
    return d.select(F.xxhash64("tied", "k").alias("family"), "sid")


def in_components(members: DataFrame, group: DataFrame) -> DataFrame:
    """family, sid, c and the number of the family's sets and of those outside its largest component, for families
    that are in more than one."""
    d = members.join(group, "sid", "left").select("family", "sid", F.coalesce("component", "sid").alias("c"))
    parts = d.groupBy("family", "c").agg(F.count(F.lit(1)).alias("m"))
    most = parts.groupBy("family").agg(F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return d.join(most, "family").select("family", "sid", "c", "m", (F.col("m") - F.col("top.m")).alias("minor_m"), (F.col("c") != F.col("top.c")).alias("minor"))


def first_blocks(d: DataFrame, turn: int = 0) -> DataFrame:
    """A family in blocks by a hash; its LEADERS first sets by another hash stand in every block and so connect them.
    In later turns only sets outside the largest component lead and fill the blocks."""
    if turn:
        d = d.filter("minor").withColumn("m", F.col("minor_m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    order = F.xxhash64(F.lit(1 + 10 * turn), "sid")
    leader = d.groupBy("family").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(order, F.greatest(F.col("m") / LEADERS, F.lit(1)).cast("long")) == 0, F.struct(order.alias("o"), F.col("sid"), F.col("c"))))), 1, LEADERS).alias("x"), F.first(blocks).alias("n"))
    many = leader.withColumn("l", F.explode("x")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("family", F.col("l.sid").alias("sid"), F.col("l.c").alias("c"), "k")
    own = d.select("family", "sid", "c", F.pmod(F.xxhash64(F.lit(2 + 10 * turn), "sid"), blocks).cast("int").alias("k"))
    both = own.unionByName(many).distinct()
    return both.select(F.xxhash64("family", "k").alias("block"), "sid", "c", F.lit(True).alias("left"), F.lit(True).alias("right"))


def last_blocks(d: DataFrame) -> DataFrame:
    """Every set outside the largest component of its family meets every set of the family in one block."""
    nb, mb = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("minor_m") / BLOCK).cast("int")
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "sid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = d.filter("minor").select("family", "sid", "c", place(3, mb).alias("i"), every(nb).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = d.select("family", "sid", "c", every(mb).alias("i"), place(4, nb).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    return left.unionByName(right).select(F.xxhash64("family", "i", "j").alias("block"), "sid", "c", "left", "right")


def named(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """The signatures of documents and the seed of their names, under which no name stands for two sets."""
    seed = 0
    while True:
        documents = materialise(signatures(docs, words, percent, seed), "signatures")
        twice = documents.filter("n > 0").groupBy("sid").agg(F.min("proof").alias("a"), F.max("proof").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"))
        if twice.filter("a != b or c != d").isEmpty():
            return documents, seed
        seed += 1


def classes_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): doc_id, key, n, sid of every document; and for each set that isn't empty sid, rep (its least
    doc_id) and c, which sets that links join have in common. docs: doc_id, key (passed through), text."""
    documents, seed = named(docs, words, percent)
    classes = documents.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    shared = materialise(shared_rows(index_rows(docs, words, percent, seed)), "shared", clean=True)
    paired = materialise(shared.select(F.col("leader").alias("a"), F.col("sid").alias("b")).filter("a != b").distinct(), "pairs", clean=True)
    touched = materialise(shared.select("sid").distinct().join(classes, "sid"), "touched")
    tried = by_orders(paired, documents, percent)
    release(paired)

    def sets_of(pairs: DataFrame) -> DataFrame:
        # one document of each class brings the text; a null doc_id cannot be looked up, so it is matched null-safely
        sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        ids = materialise(sids.join(touched.select("sid", "rep"), "sid").select("rep"), "reps")
        some = sieve(docs, F.col("doc_id"), ids).join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        return materialise(full_sets(some, words, seed).dropDuplicates(["sid"]), "sets", clean=True)

    def linked(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs)
        out = materialise(verified(pairs, sets, percent), "links", clean=True)
        release(pairs, sets)
        return out

    links = linked(tried)
    group = materialise(components(links, "a", "b").withColumnRenamed("node", "sid"), "groups")
    once = shared.filter("not again").drop("again")
    lengths = materialise(once.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 2"), "lengths")
    total = lengths.agg(F.sum("length")).first()[0] or 0
    hot = materialise(join_counted(once.select("token", "sid"), lengths.filter(F.col("length") > HOT), ["token"], "length", total), "hot-tokens", clean=True)
    in_hot = hot.groupBy("sid").agg(F.count(F.lit(1)).alias("k"))
    rest = open_pairs(once.join(lengths.filter(F.col("length") <= HOT).select("token"), "token"), group, touched, in_hot, percent)
    rest = materialise(rest, "open-pairs", clean=True)
    tried = by_orders(rest, documents, percent)
    release(rest)
    found = links
    if not tried.isEmpty():
        found = found.unionByName(linked(tried))
        group = materialise(components(found, "a", "b").withColumnRenamed("node", "sid"), "groups")
    if not hot.isEmpty():
        sets = sets_of(hot_rows(hot, touched, percent).select(F.col("sid").alias("a"), F.col("sid").alias("b")))
        family = materialise(families(materialise(rarest_rows(sets, percent), "rarest", clean=True), touched, percent), "families")
        turn, before = 0, None
        while turn is not None:
            apart = materialise(in_components(family, group), "apart")
            outside, each = apart.agg(F.sum(F.col("minor").cast("long")), F.avg("minor_m")).first()
            if not outside:
                break
            # all pairs cost no more than some rounds of leaders, or leaders don't help any more
            if each <= FEW * BLOCK or (turn and 2 * outside > before):
                blocks, turn = last_blocks(apart), None
            else:
                blocks, turn, before = first_blocks(apart, turn), turn + 1, outside
            found = found.unionByName(materialise(block_links(blocks, sets, percent), "links"))
            group = materialise(components(found, "a", "b").withColumnRenamed("node", "sid"), "groups")
    return documents, classes.select("sid", "rep").join(group, "sid", "left").select("sid", "rep", F.coalesce("component", "sid").alias("c"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id that links reach."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.lit(None).cast("binary").alias("key"), F.col(quoted(text)).alias("text"))
    documents, least = classes_of(docs, words, percent)
    names = least.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_class = materialise(least.select("sid", "c").join(names, "c").select("sid", "component_id"), "classes")
    known = documents.filter("n > 0").select("doc_id", "n", "sid").join(of_class, "sid")
    return known.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        documents.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that name their component: one row of each group of near-duplicates stays, that of the least
    doc_id (nulls last). Every text without words is a group of its own; rows repeated in full are one document."""
    small_batches(docs.sparkSession)
    key = F.unhex(F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256))
    documents, least = classes_of(docs.select(F.col(quoted(doc_id)).alias("doc_id"), key.alias("key"), F.col(quoted(text)).alias("text")))
    # in a component, the document of least doc_id; of rows under this doc_id one
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("key").alias("sha"))
    top = documents.filter("n > 0").select("doc_id", "key", "sid").join(least.select("sid", "c"), "sid").groupBy("c").agg(F.min(rank).alias("top"))
    kept = materialise(top.select("top.id", "top.sha").unionByName(documents.filter("n = 0").select(F.col("doc_id").alias("id"), F.col("key").alias("sha"))).distinct(), "kept")
    marked = docs.select(whole_row(docs), F.col(quoted(doc_id)).alias("doc_id"), key.alias("key"))
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("sha")), "left_semi").dropDuplicates(["doc_id", "key"]).select("row.*")
