"""Exact deduplication by content-defined chunk recipes [native].

A text loses its white space, is cut into chunks at places its own characters choose, and becomes
its *recipe*: the ordered list of its chunks' identifiers. Chunk bytes are moved once, to verify that
an identifier names one chunk only; texts are then compared by recipes, a few bytes for each KB.

Nulls count as empty texts; empty texts are equal to each other; a null doc_id loses every tie; of
repeated rows (same text, same doc_id) one stays. An empty table gives an empty table; columns of
the input other than the two named are ignored, whatever their names, and passed through by exact_dedup.
doc_id may have any type with an order. Recipes shared by many rows are joined without moving the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import SPACE, join_counted, materialise, quoted, whole_row

#: A chunk ends at the first mark after MIN_CHUNK characters, at MAX_CHUNK at the latest.
MIN_CHUNK, MAX_CHUNK, MARKS = 512, 4096, ".!?;:,"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def chunks(norm: Column) -> Column:
    """Content-defined chunks: the same passage is cut alike wherever it stands, after its first cut."""
    pattern = f"(?s).{{{MIN_CHUNK - 1},{MAX_CHUNK - 1}}}?[{MARKS}]|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


#: Ever stronger names for a chunk; the last is the chunk itself and needs no proof.
IDENTIFIERS = (lambda c: F.unhex(F.md5(c)), lambda c: F.unhex(F.sha2(c, 512)), lambda c: c.cast("binary"))


def recipes(docs: DataFrame, identify, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    norm = squeezed(F.col(quoted(text)))
    return docs.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        F.length(F.coalesce(F.col(quoted(text)), F.lit(""))).cast("long").alias("n_points"),
        F.sha2(norm, 256).alias("text_sha256"),
        F.transform(chunks(norm), identify).alias("recipe"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def conflicts(docs: DataFrame, identify, text: str = "text") -> DataFrame:
    """Identifiers that name more than one chunk. Copies of a chunk meet before the shuffle."""
    c = docs.select(F.explode(chunks(squeezed(F.col(quoted(text))))).alias("chunk"))
    return (
        c.groupBy(identify(F.col("chunk")).alias("id"))
        .agg((F.min("chunk") != F.max("chunk")).alias("bad"))
        .filter("bad")
        .select("id")
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    for k, identify in enumerate(IDENTIFIERS):
        if k == len(IDENTIFIERS) - 1 or materialise(conflicts(docs, identify, text), "chunk-conflicts").isEmpty():
            break
    r = materialise(recipes(docs, identify, doc_id, text), "recipes")
    rank = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"))
    groups = materialise(r.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("top")), "recipe-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return join_counted(r, groups, ["recipe"], "group_size", total).select(
        "doc_id",
        F.col("top.keep_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("top.keep_row")).alias("kept"),
        "text_sha256",
        "n_points",
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns, one row for each class of equal texts."""
    kept = exact_groups(docs, doc_id, text).filter("kept").select(
        F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"), F.col("n_points").alias("keep_n")
    )
    marked = docs.select(
        whole_row(docs),
        F.col(quoted(doc_id)).alias("id"),
        F.sha2(squeezed(F.col(quoted(text))), 256).alias("sha"),
        F.length(F.coalesce(F.col(quoted(text)), F.lit(""))).cast("long").alias("n"),
    )
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")) & (F.col("n") == F.col("keep_n"))
    # the keys of the join are those of the last step: rows repeated in full meet without a second shuffle
    return marked.join(kept, same, "left_semi").dropDuplicates(["id", "sha", "n"]).select("row.*")
