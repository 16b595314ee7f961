"""K-d tree sharding [native]: recursive weighted medians along the widest metadata dimension.

Every document has three metadata coordinates (source, language, size), each completed by the hash of
its text, so that any coordinate puts all texts in one total order. The coordinate of a source or language is its
rank among the distinct values, that of a size its logarithm. A node is split at the weighted median of its widest
coordinate (span in the node over span in the table) until leaves reach the target. Medians are found by histograms
of bounded size, for all nodes of a level at once; the table itself is only ever summed.

Equal texts share all coordinates, so they stay together, unless they outweigh DIVIDE of a node, more than a balanced
split can bear: then a hash of the row divides them at the very share that is missing. Rows repeated in full are counted
and numbered, so the shards depend on the rows alone, not on how they lie in files.

Law: `bytes`. Nulls: no text has size 1; a null source or language sorts last. Repeated rows are separate
rows. An empty table gives an empty table; other columns are ignored. doc_id may have any type with an order.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm.common import join_counted, materialise, quoted, ranks

DIMS = ("k_source", "k_lang", "k_size")
#: Bits of a coordinate, of the text hash that completes it, and of the row hash that divides equal texts.
COORD_BITS, TIE_BITS, ROW_BITS = 20, 36, 40
KEY_BITS = COORD_BITS + TIE_BITS
#: Rows of one histogram that may come to the driver.
MAX_BINS = 1 << 15
#: A median is good enough when the bin it falls in holds less than this share of its node.
TOLERANCE = 0.0005
#: Equal texts with more than this share of a node may be divided.
DIVIDE = 0.02
#: Rows of one shard, or equal rows, that are numbered together.
SLOT_ROWS = 20_000


def _unsigned(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def thin_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, h, source, lang and r, a hash of the row and of its number among rows equal to it."""
    filled = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        (F.octet_length(filled) + 1).cast("long").alias("size"),
        F.crc32(filled.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(filled).alias("h"),
        F.col(quoted(source)).alias("source"),
        F.col(quoted(lang)).alias("lang"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    # equal rows are numbered in stretches, so that no task gives out more than one
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SLOT_ROWS}"))).alias("part")
    some = counted.select("*", stretches).repartition("doc_id", "h", "part")
    inside = F.sequence(F.lit(1).cast("long"), F.least(F.lit(SLOT_ROWS).cast("long"), F.col("n") - F.col("part") * SLOT_ROWS))
    every = some.select(*rows.columns, "part", F.explode(inside).alias("k"))
    return every.select(*rows.columns, _unsigned(F.xxhash64(F.lit(5), "doc_id", "h", "source", "lang", "part", "k"), ROW_BITS).alias("r"))


def with_keys(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows with the coordinates as order keys, number of rows). Equal texts take the least source and language among
    them. rows: materialised."""
    total = rows.count()
    groups = rows.groupBy("h", "size").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"))
    groups = materialise(groups, "shard-texts")
    for c in ("source", "lang"):
        rank = materialise(ranks(groups, f"g_{c}", f"c_{c}"), "shard-ranks")
        groups = groups.join(rank, groups[f"g_{c}"].eqNullSafe(rank[f"g_{c}"])).drop(f"g_{c}")
    groups = materialise(groups.withColumn("c_size", F.log(F.col("size").cast("double"))), "shard-texts")
    ends = groups.agg(*[f(f"c_{c}").cast("double").alias(f"{n}_{c}") for c in ("source", "lang", "size") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top, tie = (1 << COORD_BITS) - 1, _unsigned(F.col("h"), TIE_BITS)

    def key(c: str) -> Column:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        place = F.lit(0) if lo is None or hi == lo else F.floor((F.col(f"c_{c}") - F.lit(lo)) / F.lit(hi - lo) * top)
        return (F.shiftleft(place.cast("long"), TIE_BITS) + tie).alias(f"k_{c}")

    keys = groups.select("h", "size", "n", *map(key, ("source", "lang", "size")))
    return join_counted(rows.drop("source", "lang"), keys, ["h", "size"], "n", total).select("doc_id", "size", "text_crc32", "r", *DIMS), total


def _by_node(spark: SparkSession, values: dict[int, tuple], ddl: str) -> DataFrame:
    """A few rows for each node of one level, as literals: small by construction."""
    fields = [f.split() for f in f"node int, {ddl}".split(", ")]
    rows = [F.struct(*[F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip((n, *v), fields)]) for n, v in values.items()]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def _median(rows: DataFrame, key: Column, bits: int, goal: dict[int, float], weight: dict[int, int]) -> dict[int, tuple[int, float, int]]:
    """For each node the start of the bin in which the running weight passes its goal, the weight before it
    and in it. The bin is a single key, or holds less than TOLERANCE of its node."""
    spark, shift = rows.sparkSession, bits
    low, held, crossing = {n: 0 for n in goal}, {n: 0.0 for n in goal}, {n: 0 for n in goal}
    width = {n: bits for n in goal}
    open_ = set(goal)
    while open_ and shift:
        step = min(shift, max(4, (MAX_BINS // len(open_)).bit_length() - 1))
        place = key - F.col("low")
        got = (
            rows.join(_by_node(spark, {n: (low[n],) for n in open_}, "low long"), "node")
            .filter((place >= 0) & (F.shiftright(place, shift) == 0))
            .groupBy("node", F.shiftright(place, shift - step).alias("bin"))
            .agg(F.sum("size").alias("w"))
            .collect()
        )
        shift -= step
        bins: dict[int, list] = defaultdict(list)
        for x in got:
            bins[x.node].append((x.bin, x.w))
        for n in list(open_):
            for b, w in sorted(bins[n]):
                if held[n] + w > goal[n]:
                    low[n] += b << shift
                    crossing[n], width[n] = w, shift
                    break
                held[n] += w
            else:
                low[n] += 1 << (shift + step)
                crossing[n] = 0
            if crossing[n] <= TOLERANCE * weight[n]:
                open_.discard(n)
    return {n: (low[n], held[n], crossing[n], width[n]) for n in goal}


def kd_shards(rows: DataFrame, depth: int) -> tuple[DataFrame, list[dict]]:
    """rows with a column `shard` of 0 to 2 ** depth - 1, and the splits."""
    d = rows.withColumn("node", F.lit(0))
    spans, splits = {}, []
    for level in range(depth):
        ends = d.groupBy("node").agg(F.sum("size").alias("w"), *[f(k).alias(f"{n}_{k}") for k in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        if not ends:
            break
        span = lambda x, k: (x[f"hi_{k}"] >> TIE_BITS) - (x[f"lo_{k}"] >> TIE_BITS)
        spans = spans or {k: max(1, span(ends[0], k)) for k in DIMS}
        widest = {x.node: max(DIMS, key=lambda k: (span(x, k) / spans[k], -DIMS.index(k))) for x in ends}
        weight = {x.node: x.w for x in ends}
        dim = _by_node(d.sparkSession, {n: (DIMS.index(k),) for n, k in widest.items()}, "dim int")
        keyed = d.join(dim, "node").withColumn("key", F.when(F.col("dim") == 0, F.col(DIMS[0])).when(F.col("dim") == 1, F.col(DIMS[1])).otherwise(F.col(DIMS[2])))
        goal = {n: w / 2 for n, w in weight.items()}
        cut, part = {}, {}
        for n, (at, held, w, width) in _median(keyed, F.col("key"), KEY_BITS, goal, weight).items():
            stop = at + (1 << width)
            if w > DIVIDE * weight[n]:  # one key that outweighs a balanced split: the row hash divides it
                cut[n], part[n] = (at, stop, 0), (goal[n] - held, w)
            else:
                near = stop if goal[n] - held > w / 2 else at
                cut[n] = (near, near, 0)
        if part:
            inner = keyed.join(_by_node(d.sparkSession, {n: cut[n][:2] for n in part}, "a long, b long"), "node").filter((F.col("key") >= F.col("a")) & (F.col("key") < F.col("b")))
            for n, (r, _, _, _) in _median(inner, F.col("r"), ROW_BITS, {n: g for n, (g, _) in part.items()}, {n: w for n, (_, w) in part.items()}).items():
                cut[n] = (*cut[n][:2], r)
        splits += [{"level": level, "node": n, "dim": widest[n], "below": cut[n][0], "divided_below": cut[n][1], "row_below": cut[n][2]} for n in cut]
        table = _by_node(d.sparkSession, cut, "a long, b long, c long")
        right = ~((F.col("key") < F.col("a")) | ((F.col("key") < F.col("b")) & (F.col("r") < F.col("c"))))
        d = keyed.join(table, "node").withColumn("node", F.col("node") * 2 + right.cast("int")).drop("a", "b", "c", "dim", "key")
    return d.withColumnRenamed("node", "shard"), splits


def slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Numbers the rows of each shard without gaps. Rows are numbered within buckets of bounded size;
    a bucket starts where those before it end."""
    from pyspark.sql import Window

    n = max(1, -(-n_rows // SLOT_ROWS))
    d = rows.withColumn("bucket", (F.col("r") % n).cast("int"))
    at = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(at), F.lit(0))).drop("n")
    inner = Window.partitionBy("shard", "bucket").orderBy("r", "doc_id", "text_crc32")
    return d.withColumn("k", F.row_number().over(inner)).join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("first") + F.col("k") - 1).cast("long"))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """n_shards: a power of two. One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    depth = n_shards.bit_length() - 1
    if n_shards != 1 << depth:
        raise ValueError("a tree of binary splits has 2 ** k leaves")
    keyed, total = with_keys(materialise(thin_rows(docs), "shard-rows"))
    d, _ = kd_shards(materialise(keyed, "shard-keys"), depth)
    return slots(d, total).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shards_of_bytes(docs: DataFrame, target_bytes: int) -> DataFrame:
    """As shard_documents, with as many splits as bring the mean leaf to target_bytes."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1)).first()[0] or 1
    return shard_documents(docs, 1 << max(0, (-(-total // target_bytes) - 1).bit_length()))
