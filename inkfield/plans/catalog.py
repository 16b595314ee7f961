"""Queries over the driver's tables, each beside SQL that computes the same rows in an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfield.functions import typography as ty
from inkfield.functions.boxes import Box, bp_to_pt, long_enough, parse_bbox, pt_to_bp, round_to_sp, rule_orientation, union_all
from inkfield.operators import reports, spatial, trees
from inkfield.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- scalar geometry


@query(
    "p1_p2_units",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 72.27e0 / 72e0 AS pt, l_extendedprice * 72e0 / 72.27e0 AS bp,
              round_even(l_extendedprice * 65536, 0) / 65536 AS sp FROM lineitem""",
)
def _(spark, d):
    v = F.col("l_extendedprice")
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bp_to_pt(v).alias("pt"), pt_to_bp(v).alias("bp"), round_to_sp(v).alias("sp"))


@query(
    "p3_p4_p8_boxes",
    f"""WITH {views.BOXES} SELECT page, id, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
        greatest(x1 - x0, 0e0) * greatest(y1 - y0, 0e0) AS area, x0 - 2 AS ex0, y0 - 3 AS ey0, x1 + 2 AS ex1, y1 + 3 AS ey1,
        (x0 + 5) - x0 AS bw, least(x0, -1e0) AS ux0, greatest(y1, 1e0) AS uy1 FROM boxes""",
)
def _(spark, d):
    b = Box.of()
    grown, base = b.expand(2.0, 3.0), Box.from_baseline(b.x0, b.y0, F.lit(5.0), F.lit(7.0), F.lit(2.0))
    both = b.union(Box(F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0)))
    return views.boxes(spark, d).select(
        "page", "id", b.width.alias("width"), b.height.alias("height"), b.cx.alias("cx"), b.cy.alias("cy"), b.area.alias("area"),
        *grown.columns("e"), base.width.alias("bw"), both.x0.alias("ux0"), both.y1.alias("uy1"),
    )


@query(
    "p5_p7_predicates",
    f"""WITH {views.BOXES} SELECT a.page, a.id AS l_id, b.id AS r_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy,
        a.x0 <= b.x0 AND b.x1 <= a.x1 AS cx, a.x0 <= b.x0 AND b.x1 <= a.x1 AND a.y0 <= b.y0 AND b.y1 <= a.y1 AS c
        FROM boxes a JOIN boxes b ON a.page = b.page AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def _(spark, d):
    b = views.boxes(spark, d)
    pairs = spatial.range_join(b, b, ["page"], spatial.INTERSECTING).filter("l_id < r_id")
    left, right = Box.of("l_"), Box.of("r_")
    return pairs.select("page", "l_id", "r_id", left.overlap_x(right).alias("ox"), left.overlap_y(right).alias("oy"), left.contains_x(right).alias("cx"), left.contains(right).alias("c"))


@query("p9_union_all", f"WITH {views.BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page")
def _(spark, d):
    return views.boxes(spark, d).groupBy("page").agg(*union_all(Box.of()))


@query(
    "s5_p11_rules",
    f"""WITH {views.RULES} SELECT page, id, CASE WHEN abs(x1 - x0) >= 2 * greatest(abs(y1 - y0), thickness) THEN 'horizontal'
        WHEN abs(y1 - y0) >= 2 * greatest(abs(x1 - x0), thickness) THEN 'vertical' ELSE 'neither' END AS orientation, (y0 + y1) / 2 AS cy
        FROM rules WHERE greatest(abs(x1 - x0), abs(y1 - y0)) >= 0.5e0""",
)
def _(spark, d):
    b = Box.of()
    return views.rules(spark, d).filter(long_enough(b)).select("page", "id", rule_orientation(b, F.col("thickness")).alias("orientation"), b.cy.alias("cy"))


@query(
    "s9_bbox_text",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS w FROM events""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit(" 1 x 2"))).otherwise(F.concat_ws(" ", F.col("value").cast("string"), F.lit("1"), F.col("user_id").cast("string"), F.lit("2.5")))
    x, _, w, _ = parse_bbox(text)
    return e.select("event_id", x.alias("x"), w.alias("w"))


# ---------------------------------------------------------------- joins


@query(
    "j2_p10_region_members",
    f"""WITH {views.BOXES} SELECT r.page, r.id AS l_id, b.id AS r_id,
        r.x0 - 0.1e0 <= b.x0 AND b.x1 <= r.x1 + 0.1e0 AND r.y0 - 0.1e0 <= b.y0 AND b.y1 <= r.y1 + 0.1e0 AS wholly FROM boxes r JOIN boxes b ON r.page = b.page AND r.id <> b.id
        AND r.x0 - 0.1e0 <= (b.x0 + b.x1) / 2 AND (b.x0 + b.x1) / 2 <= r.x1 + 0.1e0 AND r.y0 - 0.1e0 <= (b.y0 + b.y1) / 2 AND (b.y0 + b.y1) / 2 <= r.y1 + 0.1e0""",
)
def _(spark, d):
    b = views.boxes(spark, d)
    got = spatial.range_join(b, b, ["page"], lambda r, g: r.contains_point(g.cx, g.cy, 0.1)).filter("l_id <> r_id")
    return got.select("page", "l_id", "r_id", Box.of("l_").contains(Box.of("r_"), 0.1).alias("wholly"))


@query(
    "j2_grid_intersections",
    f"""WITH {views.BOXES} SELECT a.page, a.id AS l_id, b.id AS r_id FROM boxes a JOIN boxes b ON a.page = b.page AND a.id <> b.id
        AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def _(spark, d):
    b = views.boxes(spark, d)
    return spatial.range_join(b, b, ["page"], spatial.INTERSECTING, cell=10.0).filter("l_id <> r_id").select("page", "l_id", "r_id")


@query(
    "j3_above_below",
    f"""WITH {views.BOXES} SELECT a.page, a.id AS l_id, count(*) FILTER (WHERE (b.y0 + b.y1) / 2 > a.y1) AS above, count(*) FILTER (WHERE (b.y0 + b.y1) / 2 < a.y0) AS below
        FROM boxes a JOIN boxes b ON a.page = b.page AND a.x0 <= (b.x0 + b.x1) / 2 AND (b.x0 + b.x1) / 2 <= a.x1
        AND ((b.y0 + b.y1) / 2 > a.y1 OR (b.y0 + b.y1) / 2 < a.y0) GROUP BY a.page, a.id""",
)
def _(spark, d):
    b = views.boxes(spark, d)
    got = spatial.range_join(b, b, ["page"], lambda x, y: spatial.ABOVE(x, y) | spatial.BELOW(x, y))
    up = spatial.ABOVE(Box.of("l_"), Box.of("r_"))
    return got.groupBy("page", "l_id").agg(F.sum(up.cast("long")).alias("above"), F.sum((~up).cast("long")).alias("below"))


def _beside_sql(side: str) -> str:
    ahead, gap = ("b.x0 >= a.x1", "b.x0 - a.x1") if side == "right" else ("b.x1 <= a.x0", "a.x0 - b.x1")
    return f"""WITH {views.BOXES}, p AS (SELECT a.page, a.id AS l_id, b.id AS r_id, {gap} AS gap FROM boxes a JOIN boxes b ON a.page = b.page AND a.id <> b.id
        AND {ahead} AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 4)
        SELECT page, l_id, r_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY page, l_id ORDER BY gap, r_id) AS rn FROM p) WHERE rn = 1"""


for _side in ("left", "right"):
    query(f"j4_nearest_{_side}", _beside_sql(_side))(lambda spark, d, side=_side: spatial.nearest_beside(views.boxes(spark, d), ["page"], "id", 4.0, side))


@query(
    "j5_rule_to_line",
    f"""WITH {views.RULES}, lines AS (SELECT DISTINCT page, floor(y0 / 12) * 12 AS y FROM rules), p AS (
        SELECT r.page, r.id AS l_id, l.y, abs(l.y - (r.y0 + r.y1) / 2) AS distance FROM rules r JOIN lines l ON l.page = r.page)
        SELECT page, l_id, y AS r_y, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, l_id ORDER BY distance, y) AS rn FROM p) WHERE rn = 1""",
)
def _(spark, d):
    r = views.rules(spark, d)
    lines = r.select("page", (F.floor(F.col("y0") / 12) * 12).cast("double").alias("y")).distinct()
    got = spatial.nearest_in_order(r.select("page", "id", ((F.col("y0") + F.col("y1")) / 2).alias("at")), lines, ["page"], "at", "y")
    return got.select("page", F.col("id").alias("l_id"), F.col("y").alias("r_y"), F.abs(F.col("y") - F.col("at")).alias("distance"))


@query(
    "j7_j8_semi_anti",
    f"""WITH {views.BOXES} SELECT page, id, EXISTS (SELECT 1 FROM boxes r WHERE r.page = b.page AND r.y0 < b.y1 AND b.y0 < r.y1 AND r.id <> b.id) AS beside FROM boxes b
        WHERE NOT EXISTS (SELECT 1 FROM boxes r WHERE r.page = b.page AND r.id <> b.id
        AND r.x0 <= (b.x0 + b.x1) / 2 AND (b.x0 + b.x1) / 2 <= r.x1 AND r.y0 <= (b.y0 + b.y1) / 2 AND (b.y0 + b.y1) / 2 <= r.y1)""",
)
def _(spark, d):
    b, other = views.boxes(spark, d), F.col("l_id") != F.col("r_id")
    outside = spatial.range_join(b, b, ["page"], lambda g, r: r.contains_point(g.cx, g.cy) & other, "left_anti")
    outside = outside.select("page", *[F.col(f"l_{c}").alias(c) for c in ("id", "x0", "y0", "x1", "y1")])
    beside = spatial.range_join(outside, b, ["page"], lambda g, r: g.overlaps_y(r) & other, "left_semi").select("page", F.col("l_id").alias("id"), F.lit(True).alias("beside"))
    return outside.join(beside, ["page", "id"], "left").select("page", "id", F.coalesce("beside", F.lit(False)).alias("beside"))


@query(
    "j9_not_covered",
    f"""WITH {views.BOXES} SELECT page, id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes r WHERE r.page = b.page AND r.id <> b.id
        AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0e0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0e0)
        > 0.6e0 * (greatest(b.x1 - b.x0, 0e0) * greatest(b.y1 - b.y0, 0e0)))""",
)
def _(spark, d):
    b = views.boxes(spark, d)
    return spatial.covered_by(b, b, ["page"], but="id").select("page", "id")


@query(
    "j17_fences",
    """WITH t AS (SELECT user_id AS page, event_id AS pos, CASE WHEN event_id % 4 IN (0, 1) THEN 1 WHEN event_id % 4 = 2 THEN -1 END AS s FROM events WHERE event_id % 4 < 3),
        r AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY pos) + CASE WHEN s = -1 THEN 1 ELSE 0 END AS depth FROM t),
        n AS (SELECT *, lead(pos) OVER (PARTITION BY page, depth ORDER BY pos) AS close_at, lead(s) OVER (PARTITION BY page, depth ORDER BY pos) AS next_s FROM r)
        SELECT page, pos AS open_at, close_at FROM n WHERE s = 1 AND next_s = -1""",
)
def _(spark, d):
    k = F.col("event_id") % 4
    t = views.table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.when(k < 2, "open").when(k == 2, "close").otherwise("other").alias("kind"))
    return spatial.pair_fences(t, ["page"], "pos", "kind")


@query(
    "j18_neutral_fences",
    """WITH t AS (SELECT user_id AS page, event_type AS base, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn,
        count(*) OVER (PARTITION BY user_id, event_type) AS n, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS close_at FROM events)
        SELECT page, base, pos AS open_at, close_at FROM t WHERE n % 2 = 0 AND rn % 2 = 1""",
)
def _(spark, d):
    t = views.table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("base"), F.col("event_id").alias("pos"))
    return spatial.pair_neutral(t, ["page"], "pos", "base")


@query(
    "j21_positional",
    """WITH a AS (SELECT l_returnflag AS page, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_quantity) AS rn, l_extendedprice AS x FROM lineitem WHERE l_linenumber = 1),
        b AS (SELECT l_returnflag AS page, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_quantity) AS rn, l_extendedprice AS x FROM lineitem WHERE l_linenumber = 2)
        SELECT coalesce(a.page, b.page) AS page, coalesce(a.rn, b.rn) AS rn, a.x AS a_x, b.x AS b_x FROM a FULL JOIN b ON a.page = b.page AND a.rn = b.rn""",
)
def _(spark, d):
    t = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("page"), F.col("l_extendedprice").alias("x"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    got = reports.positional(t.filter("l_linenumber = 1"), t.filter("l_linenumber = 2"), ["page"], ["x", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])
    return got.select("page", F.col("rn").cast("long").alias("rn"), "a_x", "b_x")


# ---------------------------------------------------------------- windows


@query(
    "w1_baseline_clusters",
    f"""WITH {views.WORDS}, g AS (SELECT doc_id, id, y, CASE WHEN lag(y) OVER w - y > 5 THEN 1 ELSE 0 END AS s FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY y DESC, id)),
        c AS (SELECT doc_id, y, sum(s) OVER (PARTITION BY doc_id ORDER BY y DESC, id ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
        SELECT doc_id, CAST(cluster AS INT) AS cluster, count(*) AS n, min(y) AS low, max(y) AS high FROM c GROUP BY doc_id, cluster""",
)
def _(spark, d):
    c = spatial.baseline_clusters(views.words(spark, d), ["doc_id"], "y", 5, "id")
    return c.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))


@query(
    "w2_vertical_bands",
    f"""WITH {views.BOXES}, g AS (SELECT *, CASE WHEN y1 < min(y0) OVER (PARTITION BY page ORDER BY y1 DESC, y0 DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.5e0 THEN 1 ELSE 0 END AS s FROM boxes)
        SELECT page, id, CAST(sum(s) OVER (PARTITION BY page ORDER BY y1 DESC, y0 DESC, id ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM g""",
)
def _(spark, d):
    return spatial.vertical_bands(views.boxes(spark, d), ["page"], 0.5, "id").select("page", "id", "band")


@query(
    "w3_horizontal_bands",
    f"""WITH {views.BOXES}, g AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.25e0 THEN 1 ELSE 0 END AS s FROM boxes)
        SELECT page, id, CAST(sum(s) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM g""",
)
def _(spark, d):
    return spatial.horizontal_bands(views.boxes(spark, d), ["page"], 0.25, "id").select("page", "id", "band")


@query(
    "w9_p29_gaps",
    f"""WITH {views.WORDS}, g AS (SELECT doc_id, id, (x0 - lag(x1) OVER (PARTITION BY doc_id, y ORDER BY x0, id)) / (10e0 / 18) AS mu FROM words)
        SELECT doc_id, id, mu, CASE WHEN abs(0e0 - mu) <= abs(3e0 - mu) AND abs(0e0 - mu) <= abs(4e0 - mu) AND abs(0e0 - mu) <= abs(5e0 - mu) THEN 0
        WHEN abs(3e0 - mu) <= abs(4e0 - mu) AND abs(3e0 - mu) <= abs(5e0 - mu) THEN 1 WHEN abs(4e0 - mu) <= abs(5e0 - mu) THEN 2 ELSE 3 END AS glue,
        abs(mu - round_even(mu, 0)) <= 1e0 / 3 AS integral FROM g WHERE mu IS NOT NULL""",
)
def _(spark, d):
    w = Window.partitionBy("doc_id", "y").orderBy("x0", "id")
    g = views.words(spark, d).withColumn("mu", ty.gap_mu(F.col("x0") - F.lag("x1").over(w), F.lit(10.0))).filter("mu is not null")
    return g.select("doc_id", "id", "mu", ty.nearest_glue(F.col("mu")).alias("glue"), ty.is_integral(F.col("mu")).alias("integral"))


@query(
    "w14_merge_spans",
    f"""WITH {views.BOXES}, g AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s FROM boxes),
        h AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT page, min(x0) AS lo, max(x1) AS hi FROM h GROUP BY page, k""",
)
def _(spark, d):
    return spatial.merge_spans(views.boxes(spark, d).select("page", F.col("x0").alias("lo"), F.col("x1").alias("hi")), ["page"])


# ---------------------------------------------------------------- aggregates and sets


@query(
    "a1_body_size",
    f"""WITH {views.WORDS}, c AS (SELECT doc_id, size, count(*) AS n FROM words GROUP BY ALL)
        SELECT doc_id, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS rn FROM c) WHERE rn = 1""",
)
def _(spark, d):
    return reports.modal(views.words(spark, d), ["doc_id"], F.col("size"), "size")


@query(
    "a2_a3_lines",
    f"""WITH {views.WORDS}, l AS (SELECT doc_id, CAST(floor(id / 12) AS BIGINT) AS line, min(x0) AS x0, max(x1) AS x1, count(*) FILTER (WHERE math) AS m, count(*) AS n FROM words GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN m * 100 < 45 * n AND n > 5 THEN 0 ELSE 1 END, x1 - x0 DESC, line) AS rn FROM l)
        SELECT doc_id, line, x0, x1, m, n FROM p WHERE rn = 1""",
)
def _(spark, d):
    lines = views.words(spark, d).groupBy("doc_id", F.floor(F.col("id") / 12).alias("line")).agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(F.col("math").cast("long")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    prose = (F.col("m") * 100 < 45 * F.col("n")) & (F.col("n") > 5)
    best = F.min(F.struct((~prose).alias("p"), (-(F.col("x1") - F.col("x0"))).alias("w"), "line", "x0", "x1", "m", "n"))
    return lines.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.line", "b.x0", "b.x1", "b.m", "b.n")


@query(
    "a4_leading",
    f"""WITH {views.WORDS}, y AS (SELECT DISTINCT doc_id, y FROM words), g AS (SELECT doc_id, lag(y) OVER (PARTITION BY doc_id ORDER BY y DESC) - y AS gap FROM y)
        SELECT doc_id, list_sort(list(gap))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, median(gap) AS median FROM g WHERE gap > 0.5e0 GROUP BY doc_id""",
)
def _(spark, d):
    y = views.words(spark, d).select("doc_id", "y").distinct()
    g = y.withColumn("gap", F.lag("y").over(Window.partitionBy("doc_id").orderBy(F.col("y").desc())) - F.col("y")).filter("gap > 0.5")
    return g.groupBy("doc_id").agg(reports.upper_median(F.col("gap")).alias("upper_median"), F.median("gap").alias("median"))


@query(
    "a5_interword",
    f"""WITH {views.WORDS}, g AS (SELECT doc_id, math, lag(math) OVER w AS was, x0 - lag(x1) OVER w AS gap FROM words WINDOW w AS (PARTITION BY doc_id, y ORDER BY x0, id))
        SELECT doc_id, median(gap) AS interword FROM g WHERE NOT math AND NOT was AND gap > 0.8e0 GROUP BY doc_id HAVING count(*) >= 3""",
)
def _(spark, d):
    w = Window.partitionBy("doc_id", "y").orderBy("x0", "id")
    g = views.words(spark, d).select("doc_id", "math", F.lag("math").over(w).alias("was"), (F.col("x0") - F.lag("x1").over(w)).alias("gap"))
    return g.filter("not math and not was and gap > 0.8").groupBy("doc_id").agg(F.median("gap").alias("interword"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("n")


@query(
    "a7_a9_survey",
    f"""WITH {views.TREE} SELECT tree, coalesce(min(confidence) FILTER (WHERE kind <> 'Space'), 1) AS structural, coalesce(min(confidence) FILTER (WHERE kind = 'Space'), 1) AS spacing,
        count(*) AS n, count(*) FILTER (WHERE confidence < 0.9) AS weak FROM nodes GROUP BY GROUPING SETS ((tree), ())""",
)
def _(spark, d):
    low = lambda c: F.coalesce(F.min(F.when(c, F.col("confidence"))), F.lit(1.0))
    space = F.col("kind") == "Space"
    return reports.totals(views.tree(spark, d), "tree", low(~space).alias("structural"), low(space).alias("spacing"), F.count(F.lit(1)).alias("n"), F.sum((F.col("confidence") < 0.9).cast("long")).alias("weak"))


@query("a10_weak_by_kind", f"WITH {views.TREE} SELECT kind, count(*) AS n FROM nodes WHERE confidence < 0.9 GROUP BY kind ORDER BY n DESC")
def _(spark, d):
    return views.tree(spark, d).filter("confidence < 0.9").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


@query(
    "a11_a12_bag_f1",
    """WITH a AS (SELECT l_returnflag AS k, l_linenumber AS item, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
        b AS (SELECT l_returnflag AS k, l_linenumber AS item, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
        j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.k = b.k AND a.item = b.item)
        SELECT k, CAST(sum(least(x, y)) AS BIGINT) AS common, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b, 2e0 * sum(least(x, y)) / (sum(x) + sum(y)) AS f1 FROM j GROUP BY k""",
)
def _(spark, d):
    t = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("item"), "l_linestatus")
    bags = reports.bag_intersection(t.filter("l_linestatus = 'O'"), t.filter("l_linestatus = 'F'"), ["k"], "item")
    return bags.withColumn("f1", reports.f1(F.col("common"), F.col("n_a"), F.col("n_b")))


@query(
    "u2_intersect_all",
    "SELECT k, item, count(*) AS n FROM (SELECT l_returnflag AS k, l_linenumber AS item FROM lineitem WHERE l_linestatus = 'O' INTERSECT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'F') GROUP BY ALL",
)
def _(spark, d):
    t = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("item"), "l_linestatus")
    return t.filter("l_linestatus = 'O'").drop("l_linestatus").intersectAll(t.filter("l_linestatus = 'F'").drop("l_linestatus")).groupBy("k", "item").agg(F.count(F.lit(1)).alias("n"))


@query("u1_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def _(spark, d):
    return reports.missing(views.table(spark, d, "orders").select("o_orderkey"), views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("o2_weakest", f"WITH {views.TREE} SELECT node_id, kind, confidence FROM nodes ORDER BY confidence, node_id LIMIT 8")
def _(spark, d):
    return reports.weakest(views.tree(spark, d), 8, "node_id").select("node_id", "kind", "confidence")


@query(
    "a19_multi_size",
    f"WITH {views.WORDS} SELECT doc_id, count(DISTINCT size) > 1 AS multi_size, min(size) AS least, max(size) AS most FROM words GROUP BY doc_id",
)
def _(spark, d):
    return views.words(spark, d).groupBy("doc_id").agg((F.count_distinct("size") > 1).alias("multi_size"), F.min("size").alias("least"), F.max("size").alias("most"))


# ---------------------------------------------------------------- trees


@query(
    "r5_r11_depth",
    f"""WITH RECURSIVE {views.TREE}, w AS (SELECT node_id, tree, 0 AS depth FROM nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.node_id, n.tree, w.depth + 1 FROM nodes n JOIN w ON n.parent_id = w.node_id AND n.tree = w.tree) SELECT tree, node_id, depth FROM w""",
)
def _(spark, d):
    return trees.with_depth(views.tree(spark, d), ["tree"], 4).select("tree", "node_id", "depth")


@query(
    "r7_edges",
    f"WITH {views.TREE} SELECT p.tree, p.kind AS parent_kind, c.kind AS kind, count(*) AS n FROM nodes p JOIN nodes c ON c.parent_id = p.node_id AND c.tree = p.tree GROUP BY ALL",
)
def _(spark, d):
    return trees.edges(views.tree(spark, d), ["tree"]).groupBy("tree", "parent_kind", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r6_signatures",
    f"""WITH {views.TREE}, leaves AS (SELECT tree, parent_id, string_agg('(' || kind || ' ' || text || ')', ' ' ORDER BY node_id) AS s FROM nodes WHERE node_id >= 100000 GROUP BY ALL),
        mid AS (SELECT n.tree, n.parent_id, string_agg('(Fraction ' || coalesce(l.s, n.text) || ')', ' ' ORDER BY n.node_id) AS s FROM nodes n LEFT JOIN leaves l ON l.parent_id = n.node_id WHERE n.kind = 'Fraction' GROUP BY ALL)
        SELECT n.tree, '(Row ' || m.s || ')' AS signature FROM nodes n JOIN mid m ON m.parent_id = n.node_id WHERE n.kind = 'Row'""",
)
def _(spark, d):
    n = views.tree(spark, d)
    leaf = F.concat(F.lit("("), F.col("kind"), F.lit(" "), F.col("text"), F.lit(")"))
    got = trees.fold_up(n, ["tree"], leaf, lambda kids: F.concat(F.lit("("), F.col("kind"), F.lit(" "), F.concat_ws(" ", kids), F.lit(")")), "node_id", 3, "signature")
    return got.filter("parent_id is null").select("tree", "signature")


# ---------------------------------------------------------------- typography


@query(
    "p14_p15_fonts",
    f"""WITH {views.WORDS} SELECT doc_id, regexp_replace(font, '^[A-Z]{{6}}\\+', '') AS base, lower(regexp_extract(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), '^([A-Za-z]+?)([0-9]+)$', 1)) AS family,
        CAST(regexp_extract(font, '([0-9]+)$', 1) AS DOUBLE) AS design, count(*) AS n FROM words GROUP BY ALL""",
)
def _(spark, d):
    f = F.col("font")
    return views.words(spark, d).select("doc_id", ty.strip_subset(f).alias("base"), ty.font_family(f).alias("family"), ty.design_size(f).alias("design")).groupBy("doc_id", "base", "family", "design").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p22_p23_styles",
    """WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS s, 5e0 + o_orderkey % 60 / 10e0 AS size FROM orders),
        n AS (SELECT *, CASE WHEN s < 4 THEN 4 ELSE 6 END + (s & 1) AS sup, CASE WHEN s < 6 THEN greatest(2, (s & -2) + 2) + (s & 1) ELSE s END AS num FROM s)
        SELECT o_orderkey, sup, sup | 1 AS sub, num, num | 1 AS den, CASE WHEN s < 4 THEN 1e0 WHEN s < 6 THEN 0.7e0 ELSE 0.5e0 END AS ratio, (s & 1) = 1 AS cramped,
        CASE WHEN size < 6 THEN 5e0 WHEN size < 8 THEN 7e0 ELSE 10e0 END AS cmsy, CASE WHEN size < 7.5 THEN 7e0 WHEN size < 8.5 THEN 8e0 WHEN size < 9.5 THEN 9e0 ELSE 10e0 END AS cmex FROM n""",
)
def _(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).cast("int").alias("s"), (F.lit(5.0) + F.col("o_orderkey") % 60 / 10.0).alias("size"))
    return o.select("o_orderkey", ty.sup_style("s").alias("sup"), ty.sub_style("s").alias("sub"), ty.num_style("s").alias("num"), ty.den_style("s").alias("den"), ty.size_ratio("s").alias("ratio"), ty.is_cramped("s").alias("cramped"), ty.nearest_design_size("cmsy", "size").alias("cmsy"), ty.nearest_design_size("cmex", "size").alias("cmex"))


@query(
    "p27_t9_nearest_size",
    """SELECT o_orderkey, CASE WHEN abs(10e0 - s) <= abs(10.95e0 - s) AND abs(10e0 - s) <= abs(12e0 - s) THEN '10pt' WHEN abs(10.95e0 - s) <= abs(12e0 - s) THEN '11pt' ELSE '12pt' END AS opt,
        greatest(0.05e0, 0.005e0 * s) AS tol, greatest(0.1e0, 0.02e0 * s) AS xtol FROM (SELECT o_orderkey, 8e0 + o_totalprice / 100000 AS s FROM orders)""",
)
def _(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", (F.lit(8.0) + F.col("o_totalprice") / 100000).alias("s"))
    return o.select("o_orderkey", ty.size_option("s").alias("opt"), ty.baseline_tolerance("s").alias("tol"), ty.x_tolerance("s").alias("xtol"))


_GLUE_SQL = f"""WITH {views.GLUE}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
        ['Ord', 'Op', 'Bin', 'Rel', 'Open', 'Close', 'Punct', 'Inner'][l_partkey % 8 + 1] AS l, ['Ord', 'Op', 'Bin', 'Rel', 'Open', 'Close', 'Punct', 'Inner'][l_suppkey % 8 + 1] AS r, l_linenumber > 3 AS script FROM lineitem)
        SELECT l, r, script, count(*) AS n, CASE WHEN mu IS NULL THEN NULL WHEN script AND NOT always THEN 0e0 ELSE mu END AS mu FROM p JOIN glue USING (l, r) GROUP BY l, r, script, mu, always"""


@query("p28_glue", _GLUE_SQL)
def _(spark, d):
    atom = lambda c: F.element_at(F.array(*map(F.lit, ty.ATOMS)), (F.col(c) % 8 + 1).cast("int"))
    glue = F.broadcast(spark.createDataFrame(ty.glue_rows(), "l string, r string, mu double, always boolean"))
    p = views.table(spark, d, "lineitem").select(atom("l_partkey").alias("l"), atom("l_suppkey").alias("r"), (F.col("l_linenumber") > 3).alias("script"))
    got = p.groupBy("l", "r", "script").agg(F.count(F.lit(1)).alias("n")).join(glue, ["l", "r"])
    return got.select("l", "r", "script", "n", F.when(F.col("mu").isNull(), None).when(F.col("script") & ~F.col("always"), 0.0).otherwise(F.col("mu")).alias("mu"))


@query(
    "p31_reclassify",
    """WITH RECURSIVE a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS p,
        ['Ord', 'Op', 'Bin', 'Rel', 'Open', 'Close', 'Punct', 'Inner'][l_partkey % 8 + 1] AS c FROM lineitem),
        f AS (SELECT k, p, CASE WHEN c = 'Bin' THEN 'Ord' ELSE c END AS c FROM a WHERE p = 1
              UNION ALL SELECT a.k, a.p, CASE WHEN a.c = 'Bin' AND f.c IN ('Bin', 'Op', 'Rel', 'Open', 'Punct') THEN 'Ord' ELSE a.c END FROM a JOIN f ON a.k = f.k AND a.p = f.p + 1),
        s AS (SELECT k, p, CASE WHEN c = 'Bin' AND lead(c) OVER (PARTITION BY k ORDER BY p) IN ('Rel', 'Close', 'Punct') THEN 'Ord' ELSE c END AS c FROM f)
        SELECT k, string_agg(c, ' ' ORDER BY p) AS classes FROM s GROUP BY k""",
)
def _(spark, d):
    key = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")]
    atom = F.element_at(F.array(*map(F.lit, ty.ATOMS)), (F.col("l_partkey") % 8 + 1).cast("int"))
    lists = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*key, atom.alias("c")))), lambda s: s["c"]).alias("a"))
    return lists.select("k", F.concat_ws(" ", ty.reclassify(F.col("a"))).alias("classes"))


# ---------------------------------------------------------------- residuals of the forward rules


@query(
    "k7_script_residual",
    """WITH s AS (SELECT o_orderkey, o_custkey, 3.6e0 + (o_orderkey % 100) / 1000e0 AS shift, (o_custkey % 40) / 10e0 AS depth FROM orders),
        r AS (SELECT *, shift - greatest(0e0, 0.412892e0 * 10e0, depth + 0.430555e0 * 10e0 / 4) AS residual FROM s)
        SELECT o_orderkey, residual, 1e0 / (1e0 + (10e0 * residual / 10e0) * (10e0 * residual / 10e0)) AS confidence FROM r""",
)
def _(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", (F.lit(3.6) + F.col("o_orderkey") % 100 / 1000.0).alias("shift"), (F.col("o_custkey") % 40 / 10.0).alias("depth"))
    r = o.withColumn("residual", F.col("shift") - ty.sup_shift(F.lit(10.0), "depth"))
    return r.select("o_orderkey", "residual", ty.trust(F.col("residual"), F.lit(10.0)).alias("confidence"))


@query(
    "k2_fraction_residual",
    """WITH s AS (SELECT o_orderkey, 6.7e0 + (o_orderkey % 50) / 100e0 AS n, 6.8e0 + (o_custkey % 50) / 100e0 AS d FROM orders),
        r AS (SELECT *, greatest(abs(n - 0.676508e0 * 10e0), abs(d - 0.685951e0 * 10e0)) AS disp, greatest(abs(n - 0.393732e0 * 10e0), abs(d - 0.344841e0 * 10e0)) AS txt FROM s)
        SELECT o_orderkey, disp, txt, 1e0 / (1e0 + (10e0 * least(disp, txt) / 10e0) * (10e0 * least(disp, txt) / 10e0)) AS confidence FROM r""",
)
def _(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", (F.lit(6.7) + F.col("o_orderkey") % 50 / 100.0).alias("n"), (F.lit(6.8) + F.col("o_custkey") % 50 / 100.0).alias("d"))
    r = o.withColumns({"disp": ty.fraction_residual("n", "d", F.lit(10.0), True), "txt": ty.fraction_residual("n", "d", F.lit(10.0), False)})
    return r.select("o_orderkey", "disp", "txt", ty.trust(F.least("disp", "txt"), F.lit(10.0)).alias("confidence"))


@query(
    "k1_bar_kinds",
    f"""WITH {views.RULES} SELECT id, CASE WHEN thickness > 4 * (0.04e0 * 10e0) THEN 'unclassified' WHEN id % 2 = 0 AND id % 5 <> 0 THEN 'fraction' WHEN id % 5 <> 0 THEN 'overline'
        WHEN id % 2 = 0 THEN 'underline' ELSE 'unclassified' END AS kind FROM rules""",
)
def _(spark, d):
    return views.rules(spark, d).select("id", ty.bar_kind(F.col("thickness"), F.lit(10.0), F.col("id") % 2 == 0, F.col("id") % 5 != 0).alias("kind"))


@query(
    "k4_k9_k10_predictions",
    """WITH s AS (SELECT p_partkey, 4e0 + p_size / 10e0 AS h, p_size / 25e0 AS d FROM part)
        SELECT p_partkey, CASE WHEN 9.6e0 - (h + d + (0.04e0 * 10e0 + 0.430555e0 * 10e0 / 4)) > 0 THEN 0.04e0 * 10e0 + 0.430555e0 * 10e0 / 4 + (9.6e0 - (h + d + (0.04e0 * 10e0 + 0.430555e0 * 10e0 / 4))) / 2
        ELSE 0.04e0 * 10e0 + 0.430555e0 * 10e0 / 4 END AS clearance, greatest(0.2e0 * 10e0 - d, 0.111111e0 * 10e0) AS up, greatest(0.6e0 * 10e0 - h, 0.166667e0 * 10e0) AS down,
        700e0 + h - least(h, 0.430555e0 * 10e0) AS accent, (h - d) / 2 - 0.25e0 * 10e0 AS axis FROM s""",
)
def _(spark, d):
    s = views.table(spark, d, "part").select("p_partkey", (F.lit(4.0) + F.col("p_size") / 10.0).alias("h"), (F.col("p_size") / 25.0).alias("d"))
    ten = F.lit(10.0)
    return s.select("p_partkey", ty.radical_clearance(ten, "h", "d", 9.6, True).alias("clearance"), ty.limit_gap(ten, True, "d").alias("up"), ty.limit_gap(ten, False, "h").alias("down"), ty.accent_baseline(700.0, "h", ten).alias("accent"), ty.axis_shift("h", "d", ten).alias("axis"))
