"""Further queries: dimensions, runs, orders, unions and report arithmetic, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfield.core.symbols import slots
from inkfield.functions import typography as ty
from inkfield.operators import reports, spatial
from inkfield.plans import views
from inkfield.plans.catalog import query


def symbol_dimension(spark: SparkSession) -> DataFrame:
    """family, code, name, text, atom, role, width, height, depth of every slot: a few hundred rows, broadcast."""
    seen, rows = set(), []
    for s in slots().values():
        if (s.font, s.code) not in seen:
            seen.add((s.font, s.code))
            rows.append((s.font, s.code, s.name, s.text, s.atom, s.role, s.width, s.height, s.depth))
    return spark.createDataFrame(rows, "family string, code int, name string, text string, atom string, role string, width double, height double, depth double")


def resolve(glyphs: DataFrame, size: str = "size") -> DataFrame:
    """Glyphs (font_name, char_code, size, pdf_width) with name, text, atom, width, height, depth and the source of the
    metrics: the font's own, else the file's widths with heights by rule, else nothing. No glyph is dropped."""
    dim = F.broadcast(symbol_dimension(glyphs.sparkSession).withColumnRenamed("family", "of"))
    g = glyphs.withColumn("family", ty.font_family(F.col("font_name"))).join(dim, (F.col("family") == F.col("of")) & (F.col("char_code") == F.col("code")), "left")
    z, known, pdf = F.col(size), F.col("name").isNotNull(), F.col("pdf_width").isNotNull()
    return g.select(
        *glyphs.columns, "name", "text", F.coalesce("atom", F.lit("Ord")).alias("atom"),
        F.when(known, F.col("width") * z).when(pdf, F.col("pdf_width")).otherwise(0.0).alias("w"), F.when(known, F.col("height") * z).when(pdf, 0.7 * z).otherwise(0.0).alias("h"),
        F.when(known, F.col("depth") * z).when(pdf, 0.2 * z).otherwise(0.0).alias("d"), F.when(known, "font").when(pdf, "pdf-widths").otherwise("unknown").alias("metrics"),
    )


def _dim_sql() -> str:
    rows, seen = [], set()
    for s in slots().values():
        if (s.font, s.code) not in seen:
            seen.add((s.font, s.code))
            rows.append(f"('{s.font}', {s.code}, '{s.name}', '{s.atom}', {s.width!r}e0, {s.height!r}e0, {s.depth!r}e0)")
    return ", ".join(rows)


@query(
    "p16_p18_j1_resolve",
    f"""WITH dim(family, code, name, atom, width, height, depth) AS (VALUES {_dim_sql()}),
        g AS (SELECT o_orderkey, ['cmmi', 'cmr', 'cmsy', 'cmex', 'helvetica'][o_custkey % 5 + 1] AS family, CAST(o_orderkey % 128 AS INT) AS code, 5e0 + o_custkey % 7 AS size,
              CASE WHEN o_custkey % 2 = 0 THEN 4.5e0 END AS pdf_width FROM orders)
        SELECT o_orderkey, name, coalesce(atom, 'Ord') AS atom, CASE WHEN name IS NOT NULL THEN width * size WHEN pdf_width IS NOT NULL THEN pdf_width ELSE 0e0 END AS w,
        CASE WHEN name IS NOT NULL THEN height * size WHEN pdf_width IS NOT NULL THEN 0.7e0 * size ELSE 0e0 END AS h, CASE WHEN name IS NOT NULL THEN depth * size WHEN pdf_width IS NOT NULL THEN 0.2e0 * size ELSE 0e0 END AS d,
        CASE WHEN name IS NOT NULL THEN 'font' WHEN pdf_width IS NOT NULL THEN 'pdf-widths' ELSE 'unknown' END AS metrics FROM g LEFT JOIN dim USING (family, code)""",
)
def _(spark, d):
    families = F.array(*map(F.lit, ("CMMI10", "XYZABC+CMR7", "CMSY10", "CMEX10", "Helvetica")))
    g = views.table(spark, d, "orders").select(
        "o_orderkey", F.element_at(families, (F.col("o_custkey") % 5 + 1).cast("int")).alias("font_name"), (F.col("o_orderkey") % 128).cast("int").alias("char_code"),
        (F.lit(5.0) + F.col("o_custkey") % 7).alias("size"), F.when(F.col("o_custkey") % 2 == 0, 4.5).alias("pdf_width"),
    )
    return resolve(g).select("o_orderkey", "name", "atom", "w", "h", "d", "metrics")


@query(
    "p30_consistent_classes",
    f"""WITH {views.GLUE}, o AS (SELECT DISTINCT CAST(l_quantity % 7 AS DOUBLE) AS gap FROM lineitem)
        SELECT gap, string_agg(l || '-' || r, ' ' ORDER BY l, r) AS pairs FROM o JOIN glue ON mu IS NOT NULL AND abs(mu - gap) <= 0.25e0 GROUP BY gap""",
)
def _(spark, d):
    glue = spark.createDataFrame([(a, b, m) for a, b, m, _ in ty.glue_rows() if m is not None], "l string, r string, mu double")
    gaps = views.table(spark, d, "lineitem").select((F.col("l_quantity") % 7).cast("double").alias("gap")).distinct().withColumn("near", F.explode(F.array(F.floor("gap"), F.floor("gap") + 1)))
    near = gaps.join(F.broadcast(glue), F.col("near") == F.floor("mu")).filter(F.abs(F.col("mu") - F.col("gap")) <= 0.25)
    return near.groupBy("gap").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_set(F.struct("l", "r"))), lambda s: F.concat(s["l"], F.lit("-"), s["r"]))).alias("pairs"))


@query(
    "p25_math_sizes",
    """WITH s AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS s FROM lineitem), o AS (SELECT l_orderkey, max(s) AS one FROM s GROUP BY l_orderkey),
        t AS (SELECT s.l_orderkey, max(s) AS two FROM s JOIN o USING (l_orderkey) WHERE s < 0.95e0 * one GROUP BY s.l_orderkey),
        h AS (SELECT s.l_orderkey, max(s) AS three FROM s JOIN t USING (l_orderkey) WHERE s < 0.95e0 * two GROUP BY s.l_orderkey)
        SELECT l_orderkey, one, coalesce(two, one * 0.7e0) AS two, coalesce(three, coalesce(two, one * 0.7e0) * 5 / 7) AS three FROM o LEFT JOIN t USING (l_orderkey) LEFT JOIN h USING (l_orderkey)""",
)
def _(spark, d):
    a = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("double")).alias("s")).withColumn("m", ty.math_sizes(F.col("s")))
    return a.select("l_orderkey", *[F.element_at("m", k + 1).alias(n) for k, n in enumerate(("one", "two", "three"))])


@query(
    "j10_band_argmin",
    f"""WITH {views.RULES}, p AS (SELECT a.page, a.id AS l_id, b.id AS r_id, abs(a.x1 - b.x0) + abs(a.y1 - b.y1) AS err FROM rules a JOIN rules b ON a.page = b.page AND a.id <> b.id AND abs(a.x1 - b.x0) <= 3 AND abs(a.y1 - b.y1) <= 3)
        SELECT page, l_id, r_id, err FROM (SELECT *, row_number() OVER (PARTITION BY page, l_id ORDER BY err, r_id) AS rn FROM p) WHERE rn = 1""",
)
def _(spark, d):
    return spatial.nearest_corner(views.rules(spark, d), ["page"], "id", 3.0)


@query(
    "w8_runs",
    """WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events),
        r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
        SELECT user_id, CAST(run AS INT) AS run, event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids FROM r GROUP BY ALL""",
)
def _(spark, d):
    e = views.table(spark, d, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = spatial.islands(e, ["user_id"], [F.col("event_id").asc()], ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), "run")
    ids = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")))
    return r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query("a8_provenance_merge", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ' ') AS ids, min(l_discount) AS confidence FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    ids = reports.merged_ids(F.array("l_partkey"))
    t = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids"), F.min("l_discount").alias("confidence"))
    return t.select("l_orderkey", F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string"))).alias("ids"), "confidence")


@query(
    "a16_displacement",
    """WITH m AS (SELECT l_returnflag AS k, median(l_extendedprice) AS m FROM lineitem GROUP BY k)
        SELECT l_returnflag AS k, any_value(m) AS median, max(abs(l_extendedprice - m)) AS worst FROM lineitem JOIN m ON m.k = l_returnflag GROUP BY l_returnflag""",
)
def _(spark, d):
    t = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_extendedprice")
    m = t.groupBy("k").agg(F.median("l_extendedprice").alias("median"))
    return t.join(m, "k").groupBy("k").agg(F.first("median").alias("median"), F.max(F.abs(F.col("l_extendedprice") - F.col("median"))).alias("worst"))


@query(
    "a13_a17_paper_totals",
    """SELECT o_orderpriority AS paper, count(*) AS displays, count(*) FILTER (WHERE o_orderstatus = 'F') AS agreed, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS accuracy,
        coalesce(count(*) FILTER (WHERE o_orderkey % 3 = 0) / nullif(count(*) FILTER (WHERE o_orderkey % 1000000007 < 0), 0), 1) AS recovery FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""",
)
def _(spark, d):
    o = views.table(spark, d, "orders").withColumn("paper", F.col("o_orderpriority"))
    n, yes = F.count(F.lit(1)), F.sum((F.col("o_orderstatus") == "F").cast("long"))
    return reports.totals(o, "paper", n.alias("displays"), yes.alias("agreed"), reports.ratio(yes, n).alias("accuracy"), reports.ratio(F.sum((F.col("o_orderkey") % 3 == 0).cast("long")), F.sum((F.col("o_orderkey") % 1000000007 < 0).cast("long"))).alias("recovery"))


@query(
    "a15_verdicts",
    """SELECT CASE WHEN o_custkey % 11 = 0 THEN 'incomplete' WHEN o_custkey % 7 = 0 THEN 'different' WHEN o_totalprice / 1e7 <= 0.02e0 AND o_orderkey % 5 <> 0 THEN 'exact' ELSE 'shifted' END AS verdict, count(*) AS n FROM orders GROUP BY verdict""",
)
def _(spark, d):
    v = reports.verdict(F.col("o_totalprice") / 1e7, F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 7 != 0, F.col("o_orderkey") % 5 != 0)
    return views.table(spark, d, "orders").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "o1_reading_order",
    f"WITH {views.BOXES} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY floor(x0 * 10 + 0.5e0), -floor(y0 * 10 + 0.5e0), id) AS place FROM boxes",
)
def _(spark, d):
    w = Window.partitionBy("page").orderBy(F.floor(F.col("x0") * 10 + 0.5), -F.floor(F.col("y0") * 10 + 0.5), "id")
    return views.boxes(spark, d).select("page", "id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "o3_o5_extremes",
    f"""WITH {views.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS big, row_number() OVER (PARTITION BY page ORDER BY x1 - x0, id) AS small FROM boxes)
        SELECT page, max(id) FILTER (WHERE big = 1) AS outermost, max(id) FILTER (WHERE small = 1) AS narrowest FROM r GROUP BY page""",
)
def _(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = F.min(F.struct((-(w * h)).alias("a"), "id")), F.min(F.struct(w.alias("w"), "id"))
    return views.boxes(spark, d).groupBy("page").agg(out[0].alias("o"), out[1].alias("n")).select("page", F.col("o.id").alias("outermost"), F.col("n.id").alias("narrowest"))


@query(
    "u3_u5_ordered_union",
    """SELECT user_id, event_id, min(place) AS place FROM (SELECT user_id, event_id, 0 AS place FROM events WHERE value > 50 UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_id % 2 = 0) GROUP BY ALL""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    both = e.filter("value > 50").select("user_id", "event_id", F.lit(0).alias("place")).unionByName(e.filter("event_id % 2 = 0").select("user_id", "event_id", F.lit(1).alias("place")))
    return both.groupBy("user_id", "event_id").agg(F.min("place").alias("place"))


@query(
    "p36_p14_text",
    r"SELECT item_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS text, length(text) AS n FROM benchmark",
)
def _(spark, d):
    return views.table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"), F.length("text").cast("long").alias("n"))


@query(
    "w6_stacked_pieces",
    f"""WITH {views.BOXES}, c AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, id) > 2 THEN 1 ELSE 0 END AS s FROM boxes), d AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS col FROM c),
        e AS (SELECT *, CASE WHEN lag(y0) OVER (PARTITION BY page, col ORDER BY y1 DESC, id) - y1 > 5 THEN 1 ELSE 0 END AS t FROM d), f AS (SELECT *, sum(t) OVER (PARTITION BY page, col ORDER BY y1 DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM e)
        SELECT page, CAST(col AS INT) AS col, CAST(run AS INT) AS run, count(*) AS n, min(id) AS head, min(y0) AS y0, max(y1) AS y1 FROM f GROUP BY page, col, run""",
)
def _(spark, d):
    across = Window.partitionBy("page").orderBy("x0", "id")
    c = spatial.islands(views.boxes(spark, d), ["page"], [F.col("x0").asc(), F.col("id").asc()], F.col("x0") - F.lag("x0").over(across) > 2, "col")
    down = Window.partitionBy("page", "col").orderBy(F.col("y1").desc(), "id")
    r = spatial.islands(c, ["page", "col"], [F.col("y1").desc(), F.col("id").asc()], F.lag("y0").over(down) - F.col("y1") > 5, "run")
    return r.groupBy("page", "col", "run").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
