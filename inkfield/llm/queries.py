"""The queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm import exact, html_cut, jaccard, mixing, packing, quality, repeats, sharding, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs).select("row.doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_url_filters": op5_url_filters,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents
        ), g AS (
            SELECT norm, count(*) AS group_size, sha256(norm) AS text_sha256,
                   first(doc_id ORDER BY n DESC, doc_id) AS keep_id
            FROM t GROUP BY norm
        )
        SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
               t.doc_id = g.keep_id AS kept, g.text_sha256
        FROM t JOIN g USING (norm)
    """,
    # aliases are spellings of one address here: the tables' pages name no other address of themselves
    "op5_url_filters": rf"""
        WITH rules(rule, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                             ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        u AS (
            SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
            FROM pages
        ), m AS (
            SELECT u.*, rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC) AS rn
            FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ), a AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || CASE path WHEN '' THEN '/' ELSE path END || query END AS address
            FROM m WHERE rn = 1
        ), said AS (
            SELECT address, bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false) AS bad FROM a WHERE address IS NOT NULL GROUP BY address
        )
        SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM a LEFT JOIN said USING (address)
    """,
    "op6_suffix_repeats": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        chunks AS (
            SELECT rid, c * 1024 AS base, substr(h, CAST(c * 2048 + 1 AS BIGINT), 2446) AS piece
            FROM (SELECT rid, h, unnest(range(0, CAST(ceil(length(h) / 2048) AS BIGINT))) AS c FROM d)
        ), strings AS (
            SELECT rid, base + i AS p, md5_number(substr(piece, CAST(2 * i + 1 AS BIGINT), 400)) AS k
            FROM (SELECT rid, base, piece, unnest(range(0, CAST(least(1024, length(piece) / 2 - 199) AS BIGINT))) AS i FROM chunks WHERE length(piece) >= 400)
        ), starts AS (SELECT rid, p FROM strings JOIN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1) USING (k)),
        marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM starts),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS island FROM marked),
        spans AS (SELECT rid, island, min(p) AS lo, max(p) + 200 AS hi FROM numbered GROUP BY rid, island),
        gaps AS (
            SELECT rid, lo, hi, coalesce(lag(hi) OVER w, 0) AS was, row_number() OVER (PARTITION BY rid ORDER BY lo DESC) = 1 AS last
            FROM spans WINDOW w AS (PARTITION BY rid ORDER BY lo)
        ), cut AS (
            SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans,
                   string_agg(substr(h, CAST(2 * was + 1 AS BIGINT), CAST(2 * (lo - was) AS BIGINT)) || CASE WHEN last THEN substr(h, CAST(2 * hi + 1 AS BIGINT)) ELSE '' END, '' ORDER BY lo) AS kept
            FROM gaps JOIN d USING (rid) GROUP BY rid
        )
        SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (rid)
    """,
    "op7_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh
            FROM w
        ), named AS (SELECT doc_id, len(sh) AS n, sh, md5(array_to_string(sh, chr(10))) AS k FROM s),
        sets AS (SELECT k, any_value(sh) AS sh, any_value(n) AS n, min(doc_id) AS rep FROM named WHERE n > 0 GROUP BY k),
        tokens AS (SELECT k, n, unnest(sh) AS t FROM sets),
        pairs AS (SELECT a.k AS x, b.k AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.k < b.k GROUP BY ALL),
        links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT k, k FROM sets UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
        smallest AS (SELECT x AS k, min(rep) AS component_id FROM reach JOIN sets ON y = sets.k GROUP BY x)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id FROM named LEFT JOIN smallest USING (k)
    """,
}
