"""Deterministic typesetting views: relations of glyphs, rules, boxes and trees over the star-schema tables.

Each view has a DataFrame form and the same relation as SQL text for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page (the label), id and a box from the first four components of each embedding."""
    e = [F.element_at("embedding", k + 1).cast("double") for k in range(4)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("page"), F.col("vec_id").alias("id"), (e[0] * 100).alias("x0"), (e[1] * 100).alias("y0"),
        (e[0] * 100 + F.abs(e[2]) * 20).alias("x1"), (e[1] * 100 + F.abs(e[3]) * 20).alias("y1"),
    )


BOXES = """boxes AS (
    SELECT label AS page, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x0, CAST(embedding[2] AS DOUBLE) * 100 AS y0,
           CAST(embedding[1] AS DOUBLE) * 100 + abs(CAST(embedding[3] AS DOUBLE)) * 20 AS x1,
           CAST(embedding[2] AS DOUBLE) * 100 + abs(CAST(embedding[4] AS DOUBLE)) * 20 AS y1
    FROM embeddings)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document as boxes of a fixed-pitch page, twelve on a line; every seventh is set in math
    italic, every fifth of these as a smaller, raised script."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    math, script = F.col("p") % 7 == 6, F.col("p") % 35 == 34
    line, column = F.floor(F.col("p") / 12), F.col("p") % 12
    size = F.when(script, 7.0).otherwise(10.0)
    x0 = F.lit(72.0) + column * 38
    width = F.least(F.length("word"), F.lit(12)) * size * 0.25
    y = F.lit(700.0) - line * 12 + F.when(script, 4.0).otherwise(0.0)
    return d.select(
        "doc_id", F.col("p").cast("long").alias("id"), "word", F.when(math, "ABCDEF+CMMI10").otherwise("CMR10").alias("font"), math.alias("math"),
        size.alias("size"), x0.alias("x0"), (x0 + width).alias("x1"), y.alias("y"),
    )


WORDS = """split_words AS (
    SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS p FROM documents
), words AS (
    SELECT doc_id, CAST(p AS BIGINT) AS id, word,
           CASE WHEN p % 7 = 6 THEN 'ABCDEF+CMMI10' ELSE 'CMR10' END AS font, p % 7 = 6 AS math,
           CASE WHEN p % 35 = 34 THEN 7e0 ELSE 10e0 END AS size,
           72e0 + (p % 12) * 38 AS x0,
           72e0 + (p % 12) * 38 + least(length(word), 12) * (CASE WHEN p % 35 = 34 THEN 7e0 ELSE 10e0 END) * 0.25e0 AS x1,
           700e0 - CAST(floor(p / 12) AS BIGINT) * 12 + CASE WHEN p % 35 = 34 THEN 4e0 ELSE 0e0 END AS y
    FROM split_words)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part: length from its size, pen from its price."""
    p = table(spark, sf_dir, "part")
    x0, y0 = F.col("p_size") * 3.0, F.col("p_retailprice") / 4
    long, pen = F.col("p_partkey") % 40 * 0.7, F.col("p_partkey") % 9 * 0.25
    flat = F.col("p_partkey") % 3 != 0
    return p.select(
        F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.when(flat, long).otherwise(pen)).alias("x1"), (y0 + F.when(flat, pen).otherwise(long)).alias("y1"), pen.alias("thickness"),
    )


RULES = """rules AS (
    SELECT p_brand AS page, p_partkey AS id, p_size * 3e0 AS x0, p_retailprice / 4 AS y0,
           p_size * 3e0 + CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 40 * 0.7e0 ELSE p_partkey % 9 * 0.25e0 END AS x1,
           p_retailprice / 4 + CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 9 * 0.25e0 ELSE p_partkey % 40 * 0.7e0 END AS y1,
           p_partkey % 9 * 0.25e0 AS thickness
    FROM part)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a tree of three levels with a confidence at the leaves."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("Row").alias("kind"), F.col("r_name").alias("text"), F.lit(1.0).alias("confidence"), F.col("r_regionkey").cast("long").alias("tree"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.lit("Fraction").alias("kind"), F.col("n_name").alias("text"), F.lit(0.99).alias("confidence"), F.col("n_regionkey").cast("long").alias("tree"), F.col("n_nationkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n.select("n_nationkey", "tree")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select((F.col("c_custkey") + 100000).cast("long").alias("node_id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent_id"), F.when(F.col("c_custkey") % 11 == 0, "Space").otherwise("Identifier").alias("kind"), F.col("c_mktsegment").alias("text"), (F.lit(1.0) / (F.lit(1) + F.abs(F.col("c_acctbal")) / 1000)).alias("confidence"), "tree")
    return r.unionByName(n.drop("n_nationkey")).unionByName(c)


TREE = """nodes AS (
    SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'Row' AS kind, r_name AS text, 1e0 AS confidence, CAST(r_regionkey AS BIGINT) AS tree FROM region
    UNION ALL SELECT n_nationkey + 1000, n_regionkey, 'Fraction', n_name, 0.99e0, n_regionkey FROM nation
    UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000, CASE WHEN c_custkey % 11 = 0 THEN 'Space' ELSE 'Identifier' END, c_mktsegment,
                     1e0 / (1 + abs(c_acctbal) / 1000), n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


#: Spaces between atoms, written out for SQL on their own: 1 thin (3 mu), 2 medium (4), 3 thick (5), t, m and k the same in
#: display and text styles only, x never met.
GLUE = """glue AS (
    SELECT l, r, CASE lower(cell) WHEN 'x' THEN NULL WHEN '0' THEN 0e0 WHEN '1' THEN 3e0 WHEN 't' THEN 3e0 WHEN 'm' THEN 4e0 ELSE 5e0 END AS mu, cell IN ('0', '1', 'x') AS always
    FROM (
        SELECT l, unnest(['Ord', 'Op', 'Bin', 'Rel', 'Open', 'Close', 'Punct', 'Inner']) AS r, unnest(string_split(cells, '')) AS cell
        FROM (VALUES ('Ord', '01mk000t'), ('Op', '11xk000t'), ('Bin', 'mmxxmxxm'), ('Rel', 'kkx0k00k'), ('Open', '00x00000'), ('Close', '01mk000t'), ('Punct', 'ttxttttt'), ('Inner', 't1mkt0tt')) AS t(l, cells)
    ))"""
