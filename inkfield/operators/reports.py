"""Aggregates, set operations and comparisons behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """The commonest value of each key; of equals the least."""
    counts = rows.select(*keys, value.alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(name).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(name))


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted values: an aggregate."""
    a = F.sort_array(F.collect_list(values))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def min_confidence(nodes: DataFrame, keys: Sequence[str], kinds: Column, name: str) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.coalesce(F.min(F.when(kinds, F.col("confidence"))), F.lit(1.0)).alias(name))


def merged_ids(ids: Column) -> Column:
    """Sorted distinct union of arrays: an aggregate."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids))))


def bag_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Size of the multiset intersection for each key, with both sizes: keys, common, n_a, n_b."""
    x = a.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("x"))
    y = b.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("y"))
    both = x.join(y, [*keys, item], "full").fillna(0, ["x", "y"])
    return both.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("common"), F.sum("x").alias("n_a"), F.sum("y").alias("n_b"))


def f1(common: Column, n_a: Column, n_b: Column) -> Column:
    """2PR / (P + R) of counts; 1 where both are empty."""
    return F.when(n_a + n_b == 0, 1.0).otherwise(2.0 * common / (n_a + n_b))


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(empty))


def missing(all_ids: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return all_ids.join(found, list(keys), "left_anti")


def weakest(rows: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k rows of least confidence: a bounded top-k, not a global sort."""
    return rows.orderBy("confidence", *tie).limit(k)


def positional(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pairs the n-th row of a with the n-th of b in each key; rows without a partner stay."""
    w = Window.partitionBy(*keys).orderBy(*order)

    def numbered(d: DataFrame, p: str) -> DataFrame:
        return d.withColumn("rn", F.row_number().over(w)).select(*keys, "rn", *[F.col(c).alias(f"{p}{c}") for c in d.columns if c not in keys])

    return numbered(a, "a_").join(numbered(b, "b_"), [*keys, "rn"], "full")


def verdict(worst: Column, same_count: Column, same_glyphs: Column, rules_match: Column, tol: float = 0.02) -> Column:
    """Of a rebuilt page against its original."""
    return (
        F.when(~same_count, "incomplete")
        .when(~same_glyphs, "different")
        .when((worst <= tol) & rules_match, "exact")
        .otherwise("shifted")
    )


def totals(rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """One row for each key and one for all, where the key is null."""
    return rows.rollup(key).agg(*aggregates)
