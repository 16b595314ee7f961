"""Mixing overlapping sources to target weights, as a min-cost flow.

Documents with the same set of sources form one *membership pattern*; a pattern's words flow to the
quotas of its sources. The first pass over a pattern is free, each further pass costs more (convex),
so repetition is spread before it is piled up. Sources that share no pattern, even through others, are
networks of their own: each is solved by one task, and its size depends on the sources that overlap,
never on the documents. A pattern that is to yield q whole passes and a rest repeats every document q
times and then takes whole documents in the order of a seeded hash, up to a threshold found by histograms,
and fills what is left with ever smaller documents until none of those left fits.

Sources, patterns, targets and thresholds are tables: nothing of them is collected but single numbers, and
there is no bound on their count.

A null source is a source of its own (it sorts last); null texts have size 0 and are never taken;
repeated rows are separate documents (where rows are equal in all that is carried, it does not matter which of them are
taken); empty tables give empty tables; other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.llm.common import materialise, quoted, ranks, word_count
from inkfield.llm.components import components
from inkfield.llm.flow import max_flow

MAX_REPEAT = 3
#: Bits of the hash that orders the documents of a pattern, and of one histogram.
BITS, STEP = 60, 12
#: Steps of selection: one by thresholds, then this many that take the largest document that fits, and again.
FITS = 2


def water_fill(sources: DataFrame, repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds target: all sizes shared by weight, none above `repeat` times its source; what is cut off is shared again.
    sources: source_size, weight. Each round sums the table once; the level only rises, so it alone is kept."""
    share, most = F.col("weight"), F.col("source_size").cast("double") * repeat
    total, weight, closed = sources.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    total, weight = float(total or 0), float(weight or 1)
    left, open_weight, above, before = total, weight, F.lit(False), -1
    while True:
        above = F.lit(left) * share / F.lit(open_weight) > most
        got = sources.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, share)), F.count(F.when(above, 1))).first()
        if got[2] == before or not got[1]:
            break
        left, open_weight, before = total - repeat * float(got[0] or 0), float(got[1]), got[2]
    return sources.withColumn("target", F.when(above, most).otherwise(F.lit(left) * share / F.lit(open_weight)))


def route(supply: dict[object, int], members: dict[object, list], quota: dict[object, int], repeat: int = MAX_REPEAT) -> dict[object, int]:
    """Words to take from each pattern: min-cost max-flow, pass k of a pattern at cost k * (k + 1) / 2. The cheapest
    path that uses a new pass costs what this pass costs, so successive shortest paths come pass by pass, and all paths of
    one pass are one maximum flow."""
    node = {p: k for k, p in enumerate([*supply, *quota])}  # patterns and sources have different names
    free = [0.0] * len(supply) + [-float(q) for q in quota.values()]
    near: list[list[int]] = [[] for _ in node]
    head: list[int] = []
    room: list[float] = []
    for p, sources in members.items():
        for s in sources:
            near[node[p]].append(len(head))
            near[node[s]].append(len(head) + 1)
            head += (node[s], node[p])
            room += (float(repeat * supply[p]), 0.0)
    for _ in range(repeat):
        for p, w in supply.items():
            free[node[p]] += w
        max_flow(free, near, head, room)
    return {p: round(repeat * w - free[node[p]]) for p, w in supply.items()}


def _flows(ends: DataFrame, repeat: int) -> DataFrame:
    """pid, flow. ends: net, pattern, pid, sid, w, quota, one row for each source of each pattern."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            supply = {("p", r[1]): r[3] for r in held}
            members = defaultdict(list)
            for r in held:
                members["p", r[1]].append(("s", r[2]))
            flow = route(supply, members, {("s", r[2]): r[4] for r in held}, repeat)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for _, p in flow], pa.int64()), pa.array(flow.values(), pa.int64())], names=["pid", "flow"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("net", "pid", "sid", "w", "quota")]):
                if held and held[0][0] != row[0]:
                    yield out()
                held.append(row)
        if held:
            yield out()

    rows = ends.repartition("net").sortWithinPartitions("net", "pattern", "sid").select("net", "pid", "sid", "w", "quota")
    return rows.mapInArrow(task, "pid long, flow long")


def plan_of(patterns: DataFrame, weights: Sequence[float], repeat: int = MAX_REPEAT) -> DataFrame:
    """patterns (pattern, pid, w) with whole passes, room for more, and the first member's source_size and target."""
    ends = patterns.select("pattern", "pid", "w", F.explode("pattern").alias("source"))
    sizes = materialise(ends.groupBy("source").agg(F.sum("w").alias("source_size")), "mix-sources")
    rank = ranks(sizes, "source", "sid").withColumnRenamed("source", "name")
    by_rank = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sizes.join(rank, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("weight", by_rank)
    sources = materialise(water_fill(materialise(sources, "mix-ranks"), repeat), "mix-targets")
    named = sources.select(F.col("source").alias("name"), "sid", "source_size", "target")
    ends = materialise(ends.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name"), "mix-members")
    first = ends.groupBy("pid").agg(F.min(F.struct("sid", "source_size", "target")).alias("first"))
    # sources are joined by patterns that hold both
    net = components(ends.join(first, "pid").select("sid", F.col("first.sid").alias("other")), "sid", "other")
    of_net = ends.join(net, F.col("sid") == F.col("node"), "left").withColumn("net", F.coalesce("component", "sid"))
    flow = materialise(_flows(of_net.withColumn("quota", F.round("target").cast("long")), repeat), "mix-flows")
    whole = F.when(F.col("w") > 0, F.least(F.lit(repeat).cast("long"), F.expr("flow div w"))).otherwise(0).cast("long")
    plan = patterns.join(flow, "pid", "left").withColumn("flow", F.coalesce("flow", F.lit(0))).join(first, "pid", "left").withColumn("whole", F.coalesce(whole, F.lit(0).cast("long")))
    return plan.select(
        "pattern", "pid", "whole", F.when(F.col("whole") < repeat, F.col("flow") - F.col("whole") * F.col("w")).otherwise(0).cast("long").alias("room"),
        F.coalesce("first.source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("first.target", F.lit(0.0)).alias("target"),
    )


# ---------------------------------------------------------------- whole documents


#: Documents that one step takes: of a size from least to most, and before (cu, cv) in the order of (u, v).
CUT = "least long, most long, cu long, cv long"


def taken_by(cuts: Column) -> Column:
    before = lambda c: (F.col("u") < c["cu"]) | ((F.col("u") == c["cu"]) & (F.col("v") < c["cv"]))
    return F.exists(cuts, lambda c: F.col("size").between(c["least"], c["most"]) & before(c))


def threshold(rows: DataFrame, room: DataFrame) -> DataFrame:
    """pid, cu, cv, held: the place in the order of (u, v) up to which the documents of each pattern fit in its room, and
    what they hold. rows: pid, size, u, v; room: pid, room. One histogram bin of each pattern is refined until it is a
    single document; only documents with equal u are told apart by v."""
    state = room.select("pid", "room", F.lit(0).cast("long").alias("cu"), F.lit(0).cast("long").alias("cv"), F.lit(0).cast("long").alias("held"), F.lit(True).alias("open"))
    for place, at in (("u", "cu"), ("v", "cv")):
        for shift in range(BITS, 0, -STEP):
            live = state.filter("open")
            d = rows.join(live.select("pid", "room", "cu", "cv", "held"), "pid")
            if place == "v":
                d = d.filter("u = cu")
            bin_ = F.shiftright(F.col(place) - F.col(at), shift - STEP)
            bins = d.filter((F.col(place) >= F.col(at)) & (F.shiftright(F.col(place) - F.col(at), shift) == 0)).groupBy("pid", bin_.alias("bin")).agg(
                F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.first("held").alias("had"), F.first("room").alias("most")
            )
            run = F.sum("w").over(Window.partitionBy("pid").orderBy("bin")) + F.col("had")
            fits = F.col("run") <= F.col("most")
            found = bins.withColumn("run", run).groupBy("pid").agg(
                F.sum(F.when(fits, F.col("w")).otherwise(0)).alias("more"), F.min(F.when(~fits, F.struct("bin", "n"))).alias("over")
            )
            # past the last bin where all fits; else at the start of the first that doesn't
            move = F.shiftleft(F.coalesce(F.col("over.bin"), F.lit(1 << STEP).cast("long")), shift - STEP)
            state = state.join(found, "pid", "left").select(
                "pid", "room", *[(F.col(c) + F.when(F.col("open"), F.coalesce(move, F.lit(0))).otherwise(0) if c == at else F.col(c)).cast("long").alias(c) for c in ("cu", "cv")],
                (F.col("held") + F.coalesce("more", F.lit(0))).alias("held"), (F.col("open") & F.coalesce(F.col("over.n") > 1, F.lit(False))).alias("open"),
            )
            state = materialise(state, "mix-cuts")
            if state.filter("open").isEmpty():
                return state.select("pid", "cu", "cv", "held")
    return state.select("pid", "cu", "cv", "held")


def largest(rows: DataFrame) -> DataFrame:
    """pid and of its largest document the size and place."""
    top = F.max(F.struct("size", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))).alias("top")
    return rows.groupBy("pid").agg(top).select("pid", F.col("top.size").alias("held"), (-F.col("top.u")).alias("cu"), (-F.col("top.v") + 1).alias("cv"))


def cuts_of(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """pid, cuts: what each pattern takes beyond its whole passes. documents: pid, size, u, v."""
    parts: list[DataFrame] = []
    room = materialise(plan.filter("room > 0").select("pid", "room"), "mix-room")
    while not room.isEmpty():
        step = len(parts)
        left = documents.join(room, "pid").filter("size > 0 and size <= room")
        if parts:
            left = left.join(_listed(parts), "pid", "left").filter(~F.coalesce(taken_by(F.col("cuts")), F.lit(False)))
        if step % (FITS + 1) == 0:
            got = threshold(left.select("pid", "size", "u", "v"), room)
            cut = got.filter("held > 0").join(room, "pid").select("pid", "held", F.lit(1).cast("long").alias("least"), F.col("room").alias("most"), "cu", "cv")
        else:
            cut = largest(left).select("pid", "held", F.col("held").alias("least"), F.col("held").alias("most"), "cu", "cv")
        cut = materialise(cut, "mix-step")
        parts.append(cut)
        # a pattern none of whose documents fits has no cut, and is done
        room = materialise(room.join(cut.select("pid", "held"), "pid").select("pid", (F.col("room") - F.col("held")).alias("room")).filter("room > 0"), "mix-room")
    return _listed(parts) if parts else documents.sparkSession.createDataFrame([], f"pid long, cuts array<struct<{CUT.replace(' long', ': long')}>>")


def _listed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("pid").agg(F.collect_list(F.struct("least", "most", "cu", "cv")).alias("cuts"))


def mix(
    docs: DataFrame,
    members: Column,
    size: Column,
    weights: Sequence[float],
    carry: Sequence[str] = ("doc_id",),
    repeat: int = MAX_REPEAT,
    seed: int = 17,
) -> DataFrame:
    """row (a struct of the columns named in carry), pattern, size, source_size and target (of the first member),
    times (0 to `repeat`), taken.
    members: array of source names, null for the source without a name; weights repeat over the sorted sources."""
    pattern = F.array_sort(F.array_distinct(members), lambda a, b: F.when(a.eqNullSafe(b), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).otherwise(1))
    row = F.struct(*[F.col(quoted(c)) for c in carry])
    # the order of documents follows what is carried; v tells rows apart that are equal in it
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 64 - BITS)
    thin = materialise(
        docs.select(row.alias("row"), pattern.alias("pattern"), size.cast("long").alias("size"), hashed(*[F.col(quoted(c)) for c in carry]).alias("u"), hashed(F.monotonically_increasing_id()).alias("v")),
        "mix",
    )
    patterns = materialise(thin.groupBy("pattern").agg(F.sum("size").alias("w")).withColumn("pid", F.monotonically_increasing_id()), "mix-patterns")
    plan = materialise(plan_of(patterns, weights, repeat), "mix-plan")
    # arrays with nulls compare as equal in a null-safe join; one row for each pattern
    d = thin.join(plan.withColumnRenamed("pattern", "same"), F.col("pattern").eqNullSafe(F.col("same"))).drop("same")
    cuts = materialise(cuts_of(d.select("pid", "size", "u", "v"), plan), "mix-taken")
    chosen = F.coalesce(taken_by(F.col("cuts")), F.lit(False)).cast("int")
    times = F.when(F.col("size") > 0, F.col("whole") + chosen).otherwise(F.lit(0)).cast("long")
    d = d.join(cuts, "pid", "left")
    return d.select("row", "pattern", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


#: Contract of the query: weights of the sources in order of code points.
WEIGHTS = (5, 2, 1)


def mix_documents(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    return mix(docs, F.array("source"), word_count(F.col("text")), WEIGHTS, carry)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: the input's rows and columns, each as often as the mix takes it."""
    often = mix_documents(docs, docs.columns).filter("times > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
