"""Distributed connected components by alternating large and small stars.

Every round is a grouped minimum and a join on the same key; the edge table is written to the shared
folder after each round, so lineage stays short and lost executors cost one round at most. The least
neighbour of a hub is sent to its edges; nothing is collected but two numbers a round. Once a round
leaves at most LOCAL_EDGES edges, one task joins what is left: contraction makes that the end of large graphs too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import join_counted, materialise, release, small_batches

#: Edges that one task joins: 16 bytes each.
LOCAL_EDGES = 200_000


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges to (u, least node of its component) of every node but that one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    pairs = [(x, find(x)) for x in list(root)]
    out = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reachable.
    Null ends and loops are no edges. No edges: an empty table."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((a.isNotNull()) & (b.isNotNull()) & (F.col("u") != F.col("v")))
    e = materialise(e.distinct(), "edges")
    state = _state(e)
    small_batches(e.sparkSession, 10_000)
    while state[0]:
        if state[0] <= LOCAL_EDGES:
            last, e = e, materialise(e.coalesce(1).mapInArrow(_local, "u long, v long"), "edges")
            release(last)
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        # what a hub knows goes to its edges, not they to one task
        large = join_counted(both, least, ["u"], "n", 2 * state[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, e = e, materialise(small.select("e.u", "e.v").filter("u != v").distinct(), "edges")
        release(last, least)
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
