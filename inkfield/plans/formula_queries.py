"""Queries that set, read and write whole formulas. The SQL computes what a row was set from; only the page reaches
the decompiler, so equality checks setting, resolving, reading and writing together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfield.operators import detection, formulas
from inkfield.plans import views
from inkfield.plans.catalog import query

#: Template of each kind of row: expression in JSON with Q and N for two numbers.
KINDS = (
    '["sup", ["id", "q"], ["num", "N"]]',
    '["frac", ["num", "Q"], ["num", "N"]]',
    '["sub", ["id", "x"], ["num", "N"]]',
    '["sqrt", ["seq", ["id", "x"], ["op", "+"], ["num", "Q"]]]',
    '["subsup", ["id", "x"], ["num", "Q"], ["num", "N"]]',
    '["frac", ["seq", ["id", "x"], ["op", "−"], ["num", "Q"]], ["sqrt", ["num", "N"]]]',
    '["bigop", "\\\\sum", ["seq", ["id", "i"], ["op", "="], ["num", "Q"]], ["num", "N"], ["sub", ["id", "x"], ["id", "i"]]]',
    '["delim", "paren", ["frac", ["num", "Q"], ["num", "N"]]]',
    '["mat", "pmatrix", [[["num", "Q"], ["id", "a"]], [["id", "b"], ["num", "N"]]]]',
    '["over", ["seq", ["id", "x"], ["op", "+"], ["num", "N"]]]',
    '["acc", "\\\\hat", ["id", "x"]]',
)


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and the page of one formula for each order."""
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(KINDS)).cast("int").alias("k"), (F.col("o_custkey") % 100).alias("q"), (F.col("o_orderkey") % 50).alias("n"))
    text = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    expr = F.replace(F.replace(text, F.lit("Q"), F.col("q").cast("string")), F.lit('"N"'), F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('"')))
    return formulas.typeset(o.select("o_orderkey", expr.alias("expr")), ["o_orderkey"])


_BASE = "WITH o AS (SELECT o_orderkey, o_orderkey % 11 AS k, o_custkey % 100 AS q, o_orderkey % 50 AS n FROM orders)"


def _case(*texts: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


def _f(template: str) -> str:
    """A SQL concatenation from text with Q and N in angle quotes."""
    parts = template.replace("«Q»", "\0q\0").replace("«N»", "\0n\0").split("\0")
    return " || ".join(p if p in ("q", "n") else "'" + p.replace("'", "''") + "'" for p in parts if p)


LATEX = (
    "q^{«N»}", r"\frac{«Q»}{«N»}", "x_{«N»}", r"\sqrt{x + «Q»}", "x_{«Q»}^{«N»}", r"\frac{x - «Q»}{\sqrt{«N»}}", r"\sum\limits_{i = «Q»}^{«N»} x_{i}",
    r"\left( \frac{«Q»}{«N»} \right)", r"\left( \begin{matrix} «Q» & a \\ b & «N» \end{matrix} \right)", r"\overline{x + «N»}", r"\hat{x}",
)
ASCIIMATH = ("q^«N»", "(«Q»)/(«N»)", "x_«N»", "sqrt(x + «Q»)", "x_«Q»^«N»", "(x - «Q»)/(sqrt(«N»))", "sum_(i = «Q»)^«N» x_i", "((«Q»)/(«N»))", "((«Q»,a),(b,«N»))", "bar(x + «N»)", "hat(x)")
SIGNATURE = (
    "(Superscript (Identifier q) (Number «N»))", "(Fraction (Number «Q») (Number «N»))", "(Subscript (Identifier x) (Number «N»))", "(Radical (Row (Identifier x) (Operator +) (Number «Q»)))",
    "(SubSup (Identifier x) (Number «Q») (Number «N»))", "(Fraction (Row (Identifier x) (Operator −) (Number «Q»)) (Radical (Number «N»)))",
    "(Row (UnderOver 11 (LargeOperator ∑) (Row (Identifier i) (Operator =) (Number «Q»)) (Number «N»)) (Subscript (Identifier x) (Identifier i)))",
    "(Delimited ( ) (Fraction (Number «Q») (Number «N»)))",
    "(Delimited ( ) (Matrix (MatrixRow (MatrixCell (Number «Q»)) (MatrixCell (Identifier a))) (MatrixRow (MatrixCell (Identifier b)) (MatrixCell (Number «N»)))))",
    "(Overline (Row (Identifier x) (Operator +) (Number «N»)))", "(Accent ^ (Identifier x))",
)


@query("c3_extract_latex", f"{_BASE} SELECT o_orderkey, {_case(*map(_f, LATEX))} AS latex FROM o")
def _(spark, d):
    return formulas.extract(order_pages(spark, d), ["o_orderkey"], ["latex"]).select("o_orderkey", "latex")


@query("f3_extract_asciimath", f"{_BASE} SELECT o_orderkey, {_case(*map(_f, ASCIIMATH))} AS asciimath FROM o")
def _(spark, d):
    return formulas.extract(order_pages(spark, d), ["o_orderkey"], ["asciimath"]).select("o_orderkey", "asciimath")


@query("f8_signatures", f"{_BASE} SELECT o_orderkey, {_case(*map(_f, SIGNATURE))} AS signature FROM o")
def _(spark, d):
    return formulas.extract(order_pages(spark, d), ["o_orderkey"], ["signature"]).select("o_orderkey", "signature")


@query("u1_glyph_recovery", "SELECT o_orderkey, 0 AS missing, 0 AS unknown FROM orders")
def _(spark, d):
    got = formulas.extract(order_pages(spark, d), ["o_orderkey"], ["signature"])
    return got.select("o_orderkey", (F.col("n_glyphs") - F.col("n_in_tree")).alias("missing"), F.col("n_unknown").alias("unknown"))


@query("c8_survey", f"{_BASE} SELECT count(*) AS equations, 1e0 AS glyph_recovery, 0 AS unknown FROM o")
def _(spark, d):
    return formulas.survey(formulas.extract(order_pages(spark, d), ["o_orderkey"], [])).select("equations", "glyph_recovery", "unknown")


@query("c7_roundtrip", "SELECT 'exact' AS verdict, count(*) AS n FROM orders")
def _(spark, d):
    return formulas.roundtrip(order_pages(spark, d), ["o_orderkey"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("f6_label_relations", f"""{_BASE} SELECT relation, count(*) AS n FROM (SELECT unnest(CASE k WHEN 0 THEN ['Sup'] WHEN 1 THEN ['Above', 'Below'] WHEN 2 THEN ['Sub'] WHEN 3 THEN ['Inside', 'Right', 'Right']
        WHEN 4 THEN ['Sub', 'Sup'] WHEN 5 THEN ['Above', 'Below', 'Right', 'Right', 'Inside'] WHEN 6 THEN ['Below', 'Above', 'Right', 'Right', 'Right', 'Sub'] WHEN 7 THEN ['Above', 'Below', 'Right', 'Right']
        WHEN 8 THEN ['Right', 'Right', 'Below', 'Right', 'Right'] WHEN 9 THEN ['Above', 'Right', 'Right'] ELSE ['Above'] END) AS relation FROM o) GROUP BY relation""")
def _(spark, d):
    _, e = formulas.label_objects(order_pages(spark, d), ["o_orderkey"])
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("c6_benchmark_suites", "SELECT * FROM (VALUES ('milestone', 17, 1e0, 1e0), ('extended', 58, 1e0, 1e0)) AS t(suite, n, exact_rate, recovery)")
def _(spark, d):
    both = formulas.cases(spark, "milestone").unionByName(formulas.cases(spark, "extended"))
    return formulas.report(formulas.benchmark(both)).select("suite", F.col("n").cast("int").alias("n"), "exact_rate", "recovery")


@query("t8_reader_agreement", "SELECT count(*) AS n, count(*) AS mathml, count(*) AS omml, count(*) AS asciimath FROM orders")
def _(spark, d):
    got = formulas.agreement(order_pages(spark, d), ["o_orderkey"])
    return got.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("mathml", "omml", "asciimath")])


@query("a14_by_construct")
def _(spark, d):
    return formulas.by_construct(formulas.benchmark(formulas.cases(spark, "random", 7, 300)))


#: Nodes of the rows whose decisions are below .995: the denominator with a root, and the grid.
@query(
    "c5_explain",
    f"""{_BASE} SELECT o_orderkey, unnest(CASE k WHEN 5 THEN [1] ELSE [2, 3, 4, 6, 8, 9, 11] END) AS node_id, unnest(CASE k WHEN 5 THEN ['Fraction'] ELSE
        ['Matrix', 'MatrixRow', 'MatrixCell', 'MatrixCell', 'MatrixRow', 'MatrixCell', 'MatrixCell'] END) AS kind, unnest(CASE k WHEN 5 THEN ['fraction']
        ELSE ['matrix', 'row', 'cell', 'cell', 'row', 'cell', 'cell'] END) AS rule_name FROM o WHERE k IN (5, 8)""",
)
def _(spark, d):
    weak = formulas.explain(formulas.nodes(order_pages(spark, d), ["o_orderkey"]), ["o_orderkey"], 0.995)
    return weak.select("o_orderkey", "node_id", "kind", "rule_name")


# ---------------------------------------------------------------- fixed values: what each template is in other formats

_ROOT = '<math xmlns="http://www.w3.org/1998/Math/MathML" display="block"><mrow>'
_FENCED = '<mrow><mo fence="true" stretchy="true">(</mo>{}<mo fence="true" stretchy="true">)</mo></mrow>'
MATHML = (
    "<msup><mi>q</mi><mn>«N»</mn></msup>",
    "<mfrac><mn>«Q»</mn><mn>«N»</mn></mfrac>",
    "<msub><mi>x</mi><mn>«N»</mn></msub>",
    "<msqrt><mrow><mi>x</mi><mo>+</mo><mn>«Q»</mn></mrow></msqrt>",
    "<msubsup><mi>x</mi><mn>«Q»</mn><mn>«N»</mn></msubsup>",
    "<mfrac><mrow><mi>x</mi><mo>−</mo><mn>«Q»</mn></mrow><msqrt><mn>«N»</mn></msqrt></mfrac>",
    "<munderover><mo>∑</mo><mrow><mi>i</mi><mo>=</mo><mn>«Q»</mn></mrow><mn>«N»</mn></munderover><msub><mi>x</mi><mi>i</mi></msub>",
    _FENCED.format("<mfrac><mn>«Q»</mn><mn>«N»</mn></mfrac>"),
    _FENCED.format("<mtable><mtr><mtd><mn>«Q»</mn></mtd><mtd><mi>a</mi></mtd></mtr><mtr><mtd><mi>b</mi></mtd><mtd><mn>«N»</mn></mtd></mtr></mtable>"),
    '<mover accent="true"><mrow><mi>x</mi><mo>+</mo><mn>«N»</mn></mrow><mo stretchy="true">¯</mo></mover>',
    '<mover accent="true"><mi>x</mi><mo stretchy="false">^</mo></mover>',
)
WORDPERFECT = (
    "q sup «N»", "{«Q»} over {«N»}", "x sub «N»", "sqrt {x + «Q»}", "x sub «Q» sup «N»", "{x - «Q»} over {sqrt {«N»}}", "sum from {i = «Q»} to «N» x sub i",
    "left ( {«Q»} over {«N»} right )", "left ( matrix {«Q» & a # b & «N»} right )", "overline {x + «N»}", "hat {x}",
)


def _run(text: str) -> str:
    return f'<m:r><m:t xml:space="preserve">{text}</m:t></m:r>'


def _runs(*texts: str) -> str:
    return "".join(map(_run, texts))


_RAD = '<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg></m:deg><m:e>{}</m:e></m:rad>'
_FRAC = '<m:f><m:fPr><m:type m:val="bar"/></m:fPr><m:num>{}</m:num><m:den>{}</m:den></m:f>'
_PAREN = '<m:d><m:dPr><m:begChr m:val="("/><m:endChr m:val=")"/></m:dPr><m:e>{}</m:e></m:d>'
OMML = (
    f"<m:sSup><m:e>{_run('q')}</m:e><m:sup>{_run('«N»')}</m:sup></m:sSup>",
    _FRAC.format(_run("«Q»"), _run("«N»")),
    f"<m:sSub><m:e>{_run('x')}</m:e><m:sub>{_run('«N»')}</m:sub></m:sSub>",
    _RAD.format(_runs("x", "+", "«Q»")),
    f"<m:sSubSup><m:e>{_run('x')}</m:e><m:sub>{_run('«Q»')}</m:sub><m:sup>{_run('«N»')}</m:sup></m:sSubSup>",
    _FRAC.format(_runs("x", "−", "«Q»"), _RAD.format(_run("«N»"))),
    '<m:nary><m:naryPr><m:chr m:val="∑"/><m:limLoc m:val="undOvr"/><m:subHide m:val="0"/><m:supHide m:val="0"/></m:naryPr>'
    + f"<m:sub>{_runs('i', '=', '«Q»')}</m:sub><m:sup>{_run('«N»')}</m:sup><m:e/></m:nary><m:sSub><m:e>{_run('x')}</m:e><m:sub>{_run('i')}</m:sub></m:sSub>",
    _PAREN.format(_FRAC.format(_run("«Q»"), _run("«N»"))),
    _PAREN.format(
        '<m:m><m:mPr><m:mcs><m:mc><m:mcPr><m:count m:val="2"/><m:mcJc m:val="center"/></m:mcPr></m:mc></m:mcs></m:mPr>'
        + f"<m:mr><m:e>{_run('«Q»')}</m:e><m:e>{_run('a')}</m:e></m:mr><m:mr><m:e>{_run('b')}</m:e><m:e>{_run('«N»')}</m:e></m:mr></m:m>"
    ),
    f'<m:bar><m:barPr><m:pos m:val="top"/></m:barPr><m:e>{_runs("x", "+", "«N»")}</m:e></m:bar>',
    f'<m:acc><m:accPr><m:chr m:val="^"/></m:accPr><m:e>{_run("x")}</m:e></m:acc>',
)
_OMATH = '<m:oMathPara xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:oMath>'
# ----------------------------------------------------------------


def _framed(head: str, texts: tuple[str, ...], tail: str) -> str:
    return _case(*(_f(head + t + tail) for t in texts))


@query("f1_extract_mathml", f"{_BASE} SELECT o_orderkey, {_framed(_ROOT, MATHML, '</mrow></math>')} AS mathml FROM o")
def _(spark, d):
    return formulas.extract(order_pages(spark, d), ["o_orderkey"], ["mathml"]).select("o_orderkey", "mathml")


@query("f4_f5_f7_formats", f"""{_BASE} SELECT o_orderkey, {_framed(_OMATH, OMML, '</m:oMath></m:oMathPara>')} AS omml, {_case(*map(_f, WORDPERFECT))} AS wordperfect,
        {_framed(_ROOT, MATHML, '</mrow></math>')} AS speech_mathml FROM o""")
def _(spark, d):
    return formulas.extract(order_pages(spark, d), ["o_orderkey"], ["omml", "wordperfect", "speech_mathml"]).select("o_orderkey", "omml", "wordperfect", "speech_mathml")


@query("s16_tree_json", f"""{_BASE} SELECT o_orderkey, CASE k WHEN 0 THEN 'Superscript' WHEN 1 THEN 'Fraction' WHEN 2 THEN 'Subscript' WHEN 3 THEN 'Radical' WHEN 4 THEN 'SubSup' WHEN 5 THEN 'Fraction'
        WHEN 6 THEN 'UnderOver' WHEN 7 THEN 'Delimited' WHEN 8 THEN 'Delimited' WHEN 9 THEN 'Overline' ELSE 'Accent' END AS head,
        CASE k WHEN 0 THEN 'q' WHEN 1 THEN CAST(q AS VARCHAR) WHEN 2 THEN 'x' WHEN 4 THEN 'x' WHEN 6 THEN '∑' WHEN 10 THEN 'x' END AS first,
        CASE k WHEN 7 THEN '(' WHEN 8 THEN '(' END AS open, CASE WHEN k = 10 THEN '^' END AS accent, k = 6 AS under FROM o""")
def _(spark, d):
    j = formulas.extract(order_pages(spark, d), ["o_orderkey"], ["json"])
    at = lambda path: F.get_json_object("json", f"$.children[0].{path}")
    return j.select("o_orderkey", at("kind").alias("head"), at("children[0].text").alias("first"), at("open").alias("open"), at("accent").alias("accent"), F.coalesce(at("has_under") == "true", F.lit(False)).alias("under"))


@query("s16_f_formats")
def _(spark, d):
    return formulas.extract(order_pages(spark, d), ["o_orderkey"], ["mathml", "omml", "wordperfect", "label_graph", "speech_mathml", "json"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's formula read back from its page, with the least confidence of its decisions."""
    return formulas.extract(order_pages(spark, sf_dir), ["o_orderkey"], ["latex", "signature"]).select("o_orderkey", "latex", "signature", "confidence")


# ---------------------------------------------------------------- detection and windows over the driver's tables


def _glyph_words(spark: SparkSession, d: str) -> DataFrame:
    w = views.words(spark, d)
    return w.select("doc_id", F.lit(1).alias("page"), F.col("id").alias("glyph_id"), F.col("font").alias("font_name"), F.col("word").alias("text"), "size", "x0", "x1", "y")


def _list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


#: Lines of words: full-size words of one height, and each script with the nearest of these.
_LINES = f"""{views.WORDS}, full_lines AS (SELECT doc_id, y AS base, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC) - 1 AS line FROM (SELECT DISTINCT doc_id, y FROM words WHERE size = 10)),
    near AS (SELECT w.*, line, row_number() OVER (PARTITION BY w.doc_id, id ORDER BY abs(base - y), base) AS k FROM words w JOIN full_lines USING (doc_id) WHERE size = 7),
    lined AS (SELECT w.*, line FROM words w JOIN full_lines f ON f.doc_id = w.doc_id AND base = y AND size = 10 UNION ALL SELECT * EXCLUDE (k) FROM near WHERE k = 1)"""


@query(
    "j6_w5_lines",
    f"WITH {_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, count(*) AS n, min(x0) AS x0, max(x1) AS x1, median(y) FILTER (WHERE size = 10) AS base FROM lined GROUP BY doc_id, line",
)
def _(spark, d):
    t = detection.line_table(detection.prose_lines(_glyph_words(spark, d)))
    return t.select("doc_id", "line", "n", "x0", "x1", "base")


@query(
    "k17_inline_spans",
    f"""WITH {_LINES}, o AS (SELECT *, row_number() OVER w - 1 AS place, lag(x1) OVER w AS before, lag(NOT math AND regexp_matches(word, '^[A-Za-z]')) OVER w AS was FROM lined WINDOW w AS (PARTITION BY doc_id, line ORDER BY x0, id)),
        gaps AS (SELECT doc_id, median(x0 - before) AS word FROM o WHERE NOT math AND regexp_matches(word, '^[A-Za-z]') AND was AND x0 - before > 0.8e0 GROUP BY doc_id HAVING count(*) >= 3),
        fit AS (SELECT o.* EXCLUDE (word), o.word AS t, g.word AS space, math AND o.word NOT IN {_list(detection.NOT_SEEDS)} AS seed, (math AND o.word NOT IN {_list(detection.NOT_SEEDS)}) OR size = 7 OR o.word IN {_list(detection.ABSORBED)} AS fits,
            x0 - max(x1) OVER (PARTITION BY doc_id, line ORDER BY x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= coalesce(g.word - 0.2e0, 5.8e0 / 18 * 10) AS close FROM o LEFT JOIN gaps g USING (doc_id)),
        run AS (SELECT *, sum(CASE WHEN fits AND was_fit AND coalesce(close, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line ORDER BY x0, id) AS span
            FROM (SELECT *, coalesce(lag(fits) OVER (PARTITION BY doc_id, line ORDER BY x0, id), false) AS was_fit FROM fit)),
        ends AS (SELECT *, min(x0) FILTER (WHERE t NOT IN {_list(detection.EDGE)}) OVER w AS a, max(x0) FILTER (WHERE t NOT IN {_list(detection.EDGE)}) OVER w AS b FROM run WHERE fits WINDOW w AS (PARTITION BY doc_id, line, span))
        SELECT doc_id, 1 AS page, CAST(line AS INTEGER) AS line, CAST(span AS INTEGER) AS span, min(x0) AS x0, max(x1) AS x1, CAST(count(*) AS INTEGER) AS n, greatest(0.05e0, least(0.99e0, 0.6e0 + 0.35e0 * sum(CAST(seed AS BIGINT)) / count(*)
        + CASE WHEN bool_or(size = 7) THEN 0.03e0 ELSE 0e0 END - CASE WHEN any_value(space) IS NULL THEN 0.15e0 ELSE 0e0 END)) AS confidence
        FROM ends WHERE x0 BETWEEN a AND b GROUP BY doc_id, line, span HAVING bool_or(seed)""",
)
def _(spark, d):
    got = detection.inline_spans(detection.prose_lines(_glyph_words(spark, d)))
    return got.select("doc_id", "page", "line", "span", "x0", "x1", F.size("glyph_ids").alias("n"), "confidence")


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer: its orders from the top, open ones as prose over the column, finished ones as formulas set
    in from it; ten glyphs each, the last of a formula a script."""
    o = views.table(spark, d, "orders")
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.select(F.col("o_custkey").alias("doc_id"), rn.alias("rn"), (F.col("o_orderstatus") == "F").alias("formula"))
    o = o.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    script = F.col("formula") & (F.col("k") == 9)
    x0 = F.when(F.col("formula"), F.lit(200.0) + F.col("k") * 6).otherwise(F.lit(72.0) + F.col("k") * 40)
    return o.select(
        "doc_id", F.lit(1).alias("page"), (F.col("rn") * 10 + F.col("k")).cast("long").alias("glyph_id"), F.when(F.col("formula"), "CMMI10").otherwise("CMR10").alias("font_name"), F.lit("a").alias("text"),
        F.when(script, 7.0).otherwise(10.0).alias("size"), x0.alias("x0"), (x0 + 5).alias("x1"), (F.lit(700.0) - F.col("rn") * 12 + F.when(script, 3.0).otherwise(0.0)).alias("y"),
    )


_STATEMENTS = """lines AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_orderstatus = 'F' AS formula FROM orders),
    prose AS (SELECT DISTINCT doc_id FROM lines WHERE NOT formula),
    runs AS (SELECT *, sum(CASE WHEN NOT formula OR NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS run
             FROM (SELECT *, lag(formula) OVER (PARTITION BY doc_id ORDER BY rn) AS was FROM lines)),
    shown AS (SELECT doc_id, run, min(rn) AS a, max(rn) AS b FROM runs JOIN prose USING (doc_id) WHERE formula GROUP BY doc_id, run)"""


@query("k16_displays", f"WITH {_STATEMENTS} SELECT doc_id, 200e0 AS x0, 259e0 AS x1, 700e0 - a * 12 AS top, 700e0 - b * 12 AS low, CAST((b - a + 1) * 10 AS INTEGER) AS n FROM shown")
def _(spark, d):
    got = detection.displays(detection.prose_lines(statement_lines(spark, d)))
    return got.select("doc_id", "x0", "x1", "top", "low", F.size("glyph_ids").alias("n"))


@query("k18_find", f"""WITH {_STATEMENTS}, spans AS (SELECT doc_id, rn FROM lines WHERE formula AND doc_id NOT IN (SELECT doc_id FROM prose))
    SELECT doc_id, 'display' AS style, 200e0 AS x0, CAST((b - a + 1) * 10 AS INTEGER) AS n FROM shown UNION ALL SELECT doc_id, 'text', 200e0, 10 FROM spans""")
def _(spark, d):
    return detection.find(statement_lines(spark, d)).select("doc_id", "style", "x0", F.size("glyph_ids").alias("n"))


@query(
    "x_tumbling_events",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL",
)
def _(spark, d):
    from inkfield.streaming import glyph_stream

    got = glyph_stream.tumbling(views.table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "most")
