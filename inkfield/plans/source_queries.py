"""Queries of the sources and sinks. The files they read are made from the driver's tables, byte by byte, by column
expressions; the SQL says what must be found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.operators import detection
from inkfield.plans import views
from inkfield.plans.catalog import query
from inkfield.sources import pdf, sinks, tables

# ---------------------------------------------------------------- PDF pages


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    """A PDF file of three pages for each customer: a word and a raised word, a line and boxes, and a broken page."""
    c = views.table(spark, d, "customer")
    x, y = F.col("c_custkey") % 300 + 72, F.lit(700) - F.col("c_custkey") % 500
    words = _text("BT /F1 10 Tf ", x, " ", y, " Td (", F.col("c_mktsegment"), ") Tj 3 Ts [(A) -500 (B)] TJ ET")
    lines = _text("q 2 0 0 2 0 0 cm 0.5 w ", x, " ", y, " m ", x + 40, " ", y, " l S Q ", x, " ", y, " 30 2 re f 5 5 0.25 0.25 re f")
    stream = lambda t: _text("<< /Length ", F.length(t), " >>\nstream\n", t, "\nendstream")
    widths = " ".join(["500"] * 26)
    page = lambda k: f"<< /Type /Page /Parent 2 0 R /Contents {k} 0 R /Resources << /Font << /F1 9 0 R >> >> >>"
    parts = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 /MediaBox [0 0 612 792] >>", page(6), page(7), page(8),
        stream(words), stream(lines), "<< /Filter /NoSuchFilter /Length 3 >>\nstream\nabc\nendstream", f"<< /Type /Font /BaseFont /ABCDEF+CMMI10 /FirstChar 65 /Widths [{widths}] >>",
    ]
    file = _text("%PDF-1.4\n", *[x for k, p in enumerate(parts, 1) for x in (f"{k} 0 obj\n", p, "\nendobj\n")], "trailer << /Root 1 0 R >>\n%%EOF")
    return c.select(F.col("c_custkey").alias("doc_id"), file.cast("binary").alias("content"))


_PT = "(72.27e0 / 72e0)"


@query(
    "s1_s3_s6_pdf_glyphs",
    f"""WITH c AS (SELECT c_custkey, c_mktsegment AS w, c_custkey % 300 + 72 AS x, 700 - c_custkey % 500 AS y FROM customer),
        g AS (SELECT c_custkey, unnest(range(0, length(w))) AS k, w, x, y FROM c UNION ALL SELECT c_custkey, length(w), 'A', x, y FROM c UNION ALL SELECT c_custkey, length(w) + 1, 'B', x, y FROM c)
        SELECT c_custkey AS doc_id, 1 AS page, CAST(k AS BIGINT) AS glyph_id, CASE WHEN length(w) > 1 THEN ascii(substr(w, CAST(k + 1 AS BIGINT), 1)) ELSE ascii(w) END AS char_code,
        (x + 5 * k + CASE WHEN w = 'B' THEN 5 ELSE 0 END) * {_PT} AS x, (y + CASE WHEN length(w) = 1 THEN 3 ELSE 0 END) * {_PT} AS y, 10 * {_PT} AS size,
        'ABCDEF+CMMI10' AS font_name, 'F1' AS font_resource, 5 * {_PT} AS pdf_width FROM g""",
)
def _(spark, d):
    found = pdf.glyphs(pdf.pages_of(customer_files(spark, d)))
    return found.select("doc_id", "page", "glyph_id", "char_code", "x", "y", "size", "font_name", "font_resource", "pdf_width")


@query(
    "s4_pdf_rules",
    f"""WITH c AS (SELECT c_custkey, c_custkey % 300 + 72 AS x, 700 - c_custkey % 500 AS y FROM customer)
        SELECT c_custkey AS doc_id, 2 AS page, CAST(0 AS BIGINT) AS rule_id, 2 * x * {_PT} AS x0, (2 * y - 0.5e0) * {_PT} AS y0, 2 * (x + 40) * {_PT} AS x1, (2 * y + 0.5e0) * {_PT} AS y1, 1 * {_PT} AS thickness, 'stroke' AS kind FROM c
        UNION ALL SELECT c_custkey, 2, 1, x * {_PT}, y * {_PT}, (x + 30) * {_PT}, (y + 2) * {_PT}, 2 * {_PT}, 'fill' FROM c""",
)
def _(spark, d):
    return pdf.rules(pdf.pages_of(customer_files(spark, d))).select("doc_id", "page", "rule_id", "x0", "y0", "x1", "y1", "thickness", "kind")


@query("s2_pdf_one_page", f"SELECT c_custkey AS doc_id, 2 AS page, 612 * {_PT} AS width, 792 * {_PT} AS height, 0 AS n_glyphs, 2 AS n_rules FROM customer")
def _(spark, d):
    p = pdf.pages_of(customer_files(spark, d), [2])
    return p.select("doc_id", "page", "width", "height", F.size("glyphs").alias("n_glyphs"), F.size("rules").alias("n_rules"))


@query("s1_pdf_warnings", "SELECT c_custkey AS doc_id, p AS page, p = 3 AS warned FROM customer, (VALUES (1), (2), (3)) AS t(p)")
def _(spark, d):
    return pdf.pages_of(customer_files(spark, d)).select("doc_id", "page", (F.size("warnings") > 0).alias("warned"))


# ---------------------------------------------------------------- other extractors


def _chars(word: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: make(i, F.substring(word, i, F.lit(1))))


_BOXES = """WITH c AS (SELECT p_partkey, p_size, p_brand AS w, unnest(range(1, length(p_brand) + 1)) AS i FROM part)
    SELECT p_partkey AS doc_id, {page} AS page, CAST(i - 1 AS BIGINT) AS id, 'char' AS kind, substr(w, CAST(i AS BIGINT), 1) AS text, CAST(i * 10 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, 5e0 AS width, 7.5e0 AS height FROM c"""


@query("s7_s9_xml_boxes", _BOXES.format(page=1) + " UNION ALL SELECT p_partkey, 1, length(p_brand), 'graphic', NULL, 0, 0, 1, 2 FROM part")
def _(spark, d):
    p = views.table(spark, d, "part")
    box = lambda i, c: _text('<Char BBOX="', i * 10, " ", F.col("p_size"), ' 5 7.5">', c, "</Char>")
    xml = _text("<Pages><Page>", F.concat_ws("", _chars(F.col("p_brand"), box)), '<Graphic BBOX="0 0 1 2"/><Char BBOX="1 2 x 4">z</Char></Page></Pages>')
    return tables.extracted(p.select(F.col("p_partkey").alias("doc_id"), xml.alias("value"))).select("doc_id", "page", "id", "kind", "text", "x", "y", "width", "height")


@query("s8_json_boxes", _BOXES.format(page=3))
def _(spark, d):
    p = views.table(spark, d, "part")
    box = lambda i, c: _text('{"any":{"BBOX":[', i * 10, ",", F.col("p_size"), ',5,7.5],"value":"', c, '"}}')
    text = _text('{"page":"3","BBOX":"no box","things":[', F.concat_ws(",", _chars(F.col("p_brand"), box)), "]}")
    return tables.extracted(p.select(F.col("p_partkey").alias("doc_id"), text.alias("value")), form="json").select("doc_id", "page", "id", "kind", "text", "x", "y", "width", "height")


# ---------------------------------------------------------------- font metrics


def supplier_fonts(spark: SparkSession, d: str) -> DataFrame:
    """A font metric file for each supplier: A is followed by B, B by C, and C is built of pieces."""
    s = views.table(spark, d, "supplier")
    word = lambda c: F.format_string("%08x", c.cast("long"))
    lengths = "".join(f"{n:04x}" for n in (22, 2, 65, 67, 4, 2, 2, 1, 0, 0, 1, 1))
    step = F.lit(1 << 16)
    widths = [word((F.col("s_suppkey") % 50 + k) * step) for k in (1, 2, 3)]
    file = _text(
        lengths, "0000000000a00000", "01110242", "02100243", "03110300", "00000000", *widths, "00000000", word((F.col("s_suppkey") % 9) * step), "00000000", word((F.col("s_suppkey") % 5) * step),
        "00000000", "30004042", "00040000",
    )
    return s.select(F.col("s_suppkey").alias("font"), F.unhex(file).alias("content"))


@query(
    "s10_p21_font_metrics",
    """SELECT s_suppkey AS font, code, (s_suppkey % 50 + code - 64) / 16e0 AS width, (s_suppkey % 9) / 16e0 AS height, CASE WHEN code = 66 THEN 0e0 ELSE (s_suppkey % 5) / 16e0 END AS depth,
        0e0 AS italic, CASE WHEN code = 67 THEN 3 ELSE 2 END AS tag, CASE code WHEN 65 THEN 66 WHEN 66 THEN 67 ELSE 0 END AS remainder FROM supplier, (VALUES (65), (66), (67)) AS t(code)""",
)
def _(spark, d):
    return tables.metrics(supplier_fonts(spark, d))


@query("p20_charlists", "SELECT s_suppkey AS font, code, next, step FROM supplier, (VALUES (65, 66, 1), (65, 67, 2), (66, 67, 1)) AS t(code, next, step)")
def _(spark, d):
    return tables.charlists(tables.metrics(supplier_fonts(spark, d))).select("font", "code", "next", "step")


@query(
    "s11_locate_metrics",
    """SELECT o_orderkey, o_custkey AS font, CASE WHEN s_suppkey IS NOT NULL THEN (s_suppkey % 50 + 1) / 16e0 END AS width FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""",
)
def _(spark, d):
    asked = views.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("font"), F.lit(65).alias("code"))
    return tables.locate(asked, tables.metrics(supplier_fonts(spark, d))).select("o_orderkey", "font", "width")


# ---------------------------------------------------------------- LaTeX sources


def order_papers(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    n = F.col("o_custkey")
    text = _text(
        "\\documentclass{article} % \\[ no \\]\n\\newcommand{\\a}{\\[ b \\]}\n\\begin{document}\n\\begin{equation}\\label{e} x_{", n, "} \\end{equation}\n% \\[ hidden \\]\n",
        "\\begin{align} a &= ", n, " \\\\ b &= 1 \\nonumber\\end{align} text \\[ y^{", n, "} \\] and $$ z 100\\% $$\n\\begin{gather} \\[ inner \\] \\end{gather}\\end{document}",
    )
    return o.select(F.col("o_orderkey").alias("identifier"), text.cast("binary").alias("content"))


_DISPLAYS = r"""displays AS (SELECT o_orderkey AS identifier, unnest(['single', 'single', 'single', 'multi', 'multi']) AS kind, unnest([0, 1, 2, 0, 1]) AS ord,
    unnest(['x_{' || o_custkey || '}', 'y^{' || o_custkey || '}', 'z 100\%', 'a &= ' || o_custkey || ' \\ b &= 1', '\[ inner \]']) AS latex FROM orders)"""


@query("s12_s13_displays", f"WITH {_DISPLAYS} SELECT * FROM displays")
def _(spark, d):
    return tables.papers(order_papers(spark, d))


@query(
    "s21_one_per_page",
    f"""WITH {_DISPLAYS} SELECT identifier, '\\documentclass{{article}}' || chr(10) || '\\pagestyle{{empty}}' || chr(10) || '\\begin{{document}}' || chr(10)
        || string_agg('\\[ ' || latex || ' \\]', chr(10) || '\\newpage' || chr(10) ORDER BY ord) || chr(10) || '\\end{{document}}' || chr(10) AS tex
        FROM displays WHERE kind = 'single' GROUP BY identifier""",
)
def _(spark, d):
    t = tables.papers(order_papers(spark, d)).filter("kind = 'single'")
    return t.groupBy("identifier").agg(tables.one_per_page(F.col("latex")).alias("tex"))


# ---------------------------------------------------------------- sinks


@query("s15_json_rows", """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","third":' || CAST(o_custkey % 8 AS VARCHAR) || '.3333}' AS value FROM orders""")
def _(spark, d):
    third = F.col("o_custkey") % 8 + F.lit(1.0) / 3
    return sinks.json_rows(views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", third.alias("third")), 4)


@query(
    "s19_c2_svg_layers",
    """WITH l AS (SELECT o_orderkey AS k, o_custkey % 500 AS x, o_custkey % 700 AS y FROM orders)
        SELECT k, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 600.000 800.000">' || '<g id="page"><rect x="0.000" y="0.000" width="600.000" height="800.000"/></g>'
        || '<g id="regions"><rect x="' || x || '.000" y="' || (780 - y) || '.000" width="30.000" height="20.000"/></g>'
        || '<g id="baselines"><line x1="0.000" x2="600.000" y1="' || (800 - y) || '.000" y2="' || (800 - y) || '.000"/></g>'
        || '<g id="boxes"><rect x="' || x || '.000" y="' || (793 - y) || '.000" width="5.000" height="7.000"/></g>'
        || '<g id="rules"><rect x="' || x || '.000" y="' || (799 - y) || '.500" width="10.000" height="0.500"/></g>'
        || '<g id="glyphs"><text x="' || x || '.000" y="' || (800 - y) || '.000" font-size="10.000">&lt;</text></g>'
        || '<g id="labels"><text x="' || x || '.000" y="' || (780 - y) || '.000" class="label">Row .95</text></g></svg>' AS svg FROM l""",
)
def _(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 500).cast("double").alias("x"), (F.col("o_custkey") % 700).cast("double").alias("y"))
    box = lambda w, h: o.select("k", F.lit(0).alias("n"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + w).alias("x1"), (F.col("y") + h).alias("y1"))
    glyphs = o.select("k", F.lit(0).alias("glyph_id"), "x", "y", F.lit(10.0).alias("size"), F.lit("<").alias("text"))
    regions = box(30.0, 20.0).withColumn("label", F.lit("Row .95"))
    rules = box(10.0, 0.5).withColumnRenamed("n", "rule_id")
    return sinks.svg(glyphs, rules, ["k"], 800.0, 600.0, regions=regions, boxes=box(5.0, 7.0), baselines=o.select("k", "y"))


@query("s18_docx_parts", "SELECT p_partkey AS id, 3 AS parts, 1 AS paragraphs FROM part")
def _(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("<m:oMath/>").alias("omml"))
    made = sinks.docx_files(p.groupBy("id").agg(F.collect_list("omml").alias("omml")), ["id"])
    return sinks.docx_summary(made, ["id"])


# ---------------------------------------------------------------- small operators without a query so far


@query("p35_math_fonts", f"""SELECT s_suppkey, name, regexp_replace(lower(name), '^.*[+]|[0-9]+$', '', 'g') IN ({", ".join(f"'{f}'" for f in detection.MATH_FAMILIES)}) AS math
        FROM supplier, (VALUES ('ABCDEF+CMMI10'), ('CMR10'), ('CMSY7'), ('MSBM10'), ('Helvetica'), ('CMEX10'), ('CMBX12')) AS t(name)""")
def _(spark, d):
    names = F.explode(F.array(*map(F.lit, ("ABCDEF+CMMI10", "CMR10", "CMSY7", "MSBM10", "Helvetica", "CMEX10", "CMBX12"))))
    return views.table(spark, d, "supplier").select("s_suppkey", names.alias("name")).withColumn("math", detection.is_math(F.col("name")))


@query(
    "p12_p13_unicode_source",
    """SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'file' WHEN l_partkey % 3 = 1 THEN 'font' ELSE 'none' END AS source,
        CASE WHEN l_partkey % 3 = 0 THEN 'é' WHEN l_partkey % 3 = 1 THEN 'x' END AS text FROM lineitem""",
)
def _(spark, d):
    k = F.col("l_partkey") % 3
    given, named = F.when(k == 0, "é"), F.when(k == 1, "x").when(k == 0, "e")
    t = views.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", given.alias("unicode_from_pdf"), named.alias("named"))
    source, text = pdf.unicode_of(F.col("unicode_from_pdf"), F.col("named"))
    return t.select("l_orderkey", "l_partkey", "l_suppkey", source.alias("source"), text.alias("text"))
