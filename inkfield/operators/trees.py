"""Trees as flat node tables: walks, depths, folds and edges without recursion in Python.

A node table has keys of its tree, node_id, parent_id (null at the root) and payload. Each level is one join on the same
key. The number of levels that is expected is planned ahead; deeper trees are followed as long as there are any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def with_depth(nodes: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """Adds depth (root 0) and path (ids from the root) to all nodes below a root; levels: how many are expected."""
    roots = nodes.filter("parent_id is null").withColumns({"depth": F.lit(0), "path": F.array("node_id")})
    out = layer = roots
    k = 1
    while k < levels or not layer.join(nodes.select(*keys, F.col("parent_id").alias("node_id")), [*keys, "node_id"], "left_semi").isEmpty():
        up = layer.select(*keys, F.col("node_id").alias("parent_id"), F.col("path").alias("up"))
        layer = nodes.join(up, [*keys, "parent_id"]).withColumns({"depth": F.lit(k), "path": F.concat("up", F.array("node_id"))}).drop("up").select(*roots.columns)
        out = out.unionByName(layer)
        k += 1
    return out


def edges(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, parent_id, parent_kind, node_id, kind of every parent and child."""
    up = nodes.select(*keys, F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    return nodes.filter("parent_id is not null").select(*keys, "parent_id", "node_id", "kind").join(up, [*keys, "parent_id"])


def fold_up(nodes: DataFrame, keys: Sequence[str], leaf: Column, combine, order: str, levels: int, name: str) -> DataFrame:
    """Values of all nodes from the bottom: leaf for nodes without children; combine(array of child values in
    order) above. One grouped join for each level, from the deepest."""
    d = with_depth(nodes, keys, levels)
    deepest = d.agg(F.max("depth")).first()[0] or 0
    done = None
    for k in range(deepest, -1, -1):
        here = d.filter(F.col("depth") == k)
        if done is None:
            value = here.withColumn(name, leaf)
        else:
            kids = done.filter(F.col("depth") == k + 1).groupBy(*keys, F.col("parent_id").alias("node_id")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(name)))), lambda s: s[name]).alias("__kids")
            )
            value = here.join(kids, [*keys, "node_id"], "left").withColumn(name, F.when(F.col("__kids").isNull(), leaf).otherwise(combine(F.col("__kids")))).drop("__kids")
        done = value.select(*d.columns, name) if done is None else done.unionByName(value.select(*d.columns, name))
    return done
