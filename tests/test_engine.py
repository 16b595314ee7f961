"""Operators on DataFrames, and every query with SQL against an independent engine."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkfield.core import suites
from inkfield.functions import typography as ty
from inkfield.operators import detection, formulas, spatial
from inkfield.plans import catalog, formula_queries, more_queries, source_queries  # noqa: F401
from inkfield.sources import pdf, sinks, tables
from inkfield.streaming import glyph_stream
from tests.test_core import STREAM, small_pdf, small_tfm

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    text = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[n]) for n in names) for r in table.to_pylist()), names


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toArrow()) == rows(duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nearest_corner(spark):
    r = [(k % 2, k % 70, k * 7 % 11 - 5.0, k * 5 % 13 - 6.0, k * 7 % 11 - 5 + k % 5 * 0.7, k * 5 % 13 - 6 + k % 3 * 0.25) for k in range(90)]  # ids come twice
    r += [(2, 0, -5.0, 0.0, -1e-300, 1.0), (2, 1, 3.0, 0.0, 9.0, 1.0), (None, 5, 0.0, 0.0, 1.0, 1.0), (3, 9, 0.0, 0.0, 1.0, 1.0), (3, 9, 0.0, 0.0, 1.0, 1.0), *[(4, k, 0.0, 0.0, 0.0, 0.0) for k in range(9)]]
    want = {}
    for p, a, _, _, x1, y1 in r:
        for q, b, x0, _, _, z1 in r:
            if p is not None and p == q and a != b and abs(x1 - x0) <= 3 and abs(y1 - z1) <= 3:
                want[p, a] = min(want.get((p, a), (9, 0)), (abs(x1 - x0) + abs(y1 - z1), b))
    got = spatial.nearest_corner(spark.createDataFrame(r, "page int, id int, x0 double, y0 double, x1 double, y1 double"), ["page"], "id", 3.0)
    assert sorted((x.page, x.l_id, x.err, x.r_id) for x in got.collect()) == sorted((*k, *v) for k, v in want.items()) and (2, 0) in want


@needs_data
def test_band_argmin_meets_columns_not_pages(spark, tmp_path):
    # 40,000 equal rules on one page: 1.6e9 pairs of a page
    part = spark.range(40_000).selectExpr("id * 360 AS p_partkey", "'b' AS p_brand", "1 AS p_size", "900D AS p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES["j10_band_argmin"](spark, str(tmp_path))
    assert df.filter("r_id = IF(l_id = 0, 360, 0) AND err = 0").count() == 40_000
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("cell" in x for x in joins)


def test_reclassify_and_notes(spark):
    df = spark.createDataFrame([(["Bin", "Ord", "Bin", "Bin", "Rel"],), (["Ord", "Bin", "Close"],), ([],)], "a array<string>")
    got = [tuple(r.x) for r in df.select(ty.reclassify(F.col("a")).alias("x")).collect()]
    assert got == [("Ord", "Ord", "Bin", "Ord", "Rel"), ("Ord", "Ord", "Close"), ()]
    assert df.select(ty.rewrites(F.col("a"), ty.reclassify(F.col("a"))).alias("n")).first().n == ["atom 0: Bin to Ord", "atom 3: Bin to Ord"]


def test_math_sizes(spark):
    df = spark.createDataFrame([([10.0, 7.0, 9.9, 5.0],), ([10.0],), ([],)], "a array<double>")
    got = [r.x for r in df.select(ty.math_sizes(F.col("a")).alias("x")).collect()]
    assert got[0] == [10.0, 7.0, 5.0] and got[1] == [10.0, 7.0, 5.0] and got[2] == [10.0, 7.0, 5.0]


def test_both_scripts_are_kept_apart(spark):
    u, v = ty.both_shifts(F.lit(10.0), F.lit(4.0), F.lit(1.5), F.lit(1.9), F.lit(5.0))
    r = spark.range(1).select(u.alias("u"), v.alias("v")).first()
    assert (r.u - 1.9) - (5.0 - r.v) == pytest.approx(1.6)


def test_grid_join_equals_plain_join(spark):
    b = spark.range(300).select((F.col("id") % 3).alias("page"), "id", ((F.col("id") * 37) % 101).cast("double").alias("x0"), ((F.col("id") * 17) % 53).cast("double").alias("y0"))
    b = b.withColumns({"x1": F.col("x0") + F.col("id") % 7 + 9, "y1": F.col("y0") + 12})
    plain, grid = (sorted(map(tuple, spatial.range_join(b, b, ["page"], spatial.INTERSECTING, cell=c).select("l_id", "r_id").collect())) for c in (None, 5.0))
    assert plain == grid and len(plain) > 300
    plan = spatial.range_join(b, b, ["page"], spatial.INTERSECTING)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pack_extract_explain_survey(spark):
    cases = formulas.cases(spark, "milestone")
    pages = formulas.typeset(cases, ["case_id"])
    glyphs, rules = pages.select("case_id", F.inline("glyphs")), pages.select("case_id", F.inline("rules"))
    packed = formulas.pack(glyphs, rules, ["case_id"])
    assert {(r.case_id, r.signature) for r in formulas.extract(packed, ["case_id"], ["signature"]).collect()} == {(r.case_id, r.expected) for r in cases.collect()}
    nodes = formulas.nodes(packed, ["case_id"])
    s = formulas.survey(formulas.extract(packed, ["case_id"], [])).first()
    assert s.equations == 17 and s.glyph_recovery == 1.0 and s.unknown == 0
    assert formulas.explain(nodes, ["case_id"], 0.5).count() == 0
    assert {r.verdict for r in formulas.roundtrip(packed, ["case_id"]).collect()} == {"exact"}


def test_a_region_that_cannot_be_solved_is_one_row(spark, monkeypatch):
    df = spark.createDataFrame([(1, [(0, "CMMI10", 120, 10.0, None, 0.0)], [])], f"k int, {formulas.PACKED}")
    r = formulas.extract(df, ["k"], ["signature"]).first()
    assert r.n_unknown == 1 and r.n_in_tree == 1 and r.confidence == 0.0


def test_pack_carries_characters_of_the_file(spark):
    glyphs = spark.createDataFrame([(1, 0, "Helvetica", 200, 10.0, 0.0, 0.0, "é", 5.0)], "k int, glyph_id bigint, font_name string, char_code int, size double, x double, y double, unicode_from_pdf string, pdf_width double")
    rules = spark.createDataFrame([], "k int, rule_id bigint, x0 double, y0 double, x1 double, y1 double")
    assert formulas.extract(formulas.pack(glyphs, rules, ["k"]), ["k"], ["latex"]).first().latex == r"\text{é}"


def test_recovery_leaves_out_unsolved_regions(spark):
    df = spark.createDataFrame([(1, [(0, "CMMI10", 120, 10.0, None, 0.0)], []), (2, [(0, "CMMI10", 120, 10.0, 0.0, 0.0)], [])], f"k int, {formulas.PACKED}")
    s = formulas.survey(formulas.extract(df, ["k"], [])).first()
    assert (s.equations, s.glyphs, s.glyphs_in_tree, s.glyph_recovery, s.unknown) == (2, 2, 1, 0.5, 1)


def test_large_regions_are_solved(spark):
    x = ["id", "x"]
    exprs = ["seq", *[x, ["op", "+"]] * 3000, ["frac", x, ["id", "y"]]], ["seq", *[["frac", x, ["id", "y"]], ["op", "+"]] * 60, x]
    r = formulas.extract(formulas.typeset(spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(exprs)], "k int, expr string"), ["k"]), ["k"], ["signature"]).orderBy("k").collect()
    assert [(a.n_glyphs, a.n_in_tree, a.n_unknown) for a in r] == [(6002, 6002, 0), (181, 181, 0)]
    assert [a.signature for a in r] == [suites.expected(formulas._tuple(e)) for e in exprs]


def test_roundtrip_verdicts(spark):
    pages = formulas.typeset(spark.createDataFrame([(1, json.dumps(suites.EXTENDED[9]))], "k int, expr string"), ["k"])
    moved = pages.withColumn("glyphs", F.transform("glyphs", lambda g, i: g.withField("y", F.when(i == 0, g["y"] + 0.3).otherwise(g["y"]))))
    assert formulas.roundtrip(pages, ["k"]).first().verdict == "exact" and formulas.roundtrip(moved, ["k"]).first().verdict == "shifted"


def text_page(lines):
    """Glyph rows of (x, y, [(text, font, size)]) lines; a blank is a space."""
    out = []
    for x, y, items in lines:
        for text, font, size, dy in items:
            for ch in text:
                if ch != " ":
                    out.append(("d", 1, len(out), font, ch, size, x, x + 0.5 * size, y + dy))
                x += 0.5 * size if ch != " " else 3.3
    return out


GLYPHS = "doc_id string, page int, glyph_id long, font_name string, text string, size double, x0 double, x1 double, y double"


def test_detection(spark):
    prose = "the quick brown fox jumps over the lazy dog and so on and on"
    r, m = "CMR10", "CMMI10"
    lines = [(72.0, 700.0 - 12 * k, [(prose, r, 10.0, 0.0)]) for k in range(4)]
    lines += [(180.0, 630.0, [("x", m, 10.0, 0.0), ("2", "CMR7", 7.0, 3.6), ("+", r, 10.0, 0.0), ("yz", m, 10.0, 0.0)])]
    lines += [(72.0, 606.0, [("we see that ", r, 10.0, 0.0), ("x", m, 10.0, 0.0), ("+1, ", r, 10.0, 0.0), ("holds for the rest of all lines here", r, 10.0, 0.0)])]
    lines += [(72.0, 594.0, [(prose, r, 10.0, 0.0)])]
    g = spark.createDataFrame(text_page(lines), GLYPHS)
    got = detection.find(g).collect()
    text = {r.glyph_id: r.text for r in g.collect()}
    read = lambda r: "".join(text[i] for i in r.glyph_ids)
    shown = [r for r in got if r.style == "display"]
    assert len(shown) == 1 and sorted(read(shown[0])) == sorted("x2+yz")
    assert [read(r) for r in got if r.style == "text"] == ["x+1"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(small_pdf(STREAM))
    (tmp_path / "b.pdf").write_bytes(b"%PDF broken")
    pages = pdf.scan(spark, f"{tmp_path}/*.pdf")
    assert pdf.glyphs(pages).count() == 3 and pdf.rules(pages).count() == 1
    m = tables.metrics(spark.createDataFrame([("f", small_tfm())], "font string, content binary"))
    assert {r.code for r in m.collect()} == {65, 66} and [(r.code, r.next, r.step) for r in tables.charlists(m).collect()] == [(65, 66, 1)]
    x = tables.extracted(spark.createDataFrame([("d", '<P><Page><Char BBOX="1 2 3 4">x</Char></Page></P>'), ("e", "<broken")], "doc_id string, value string"))
    assert {r.kind for r in x.collect()} == {"char", "warning"} and tables.as_glyphs(x).count() == 1
    t = tables.papers(spark.createDataFrame([("p", b"\\begin{document}\\[ a \\]\\[ b \\]")], "identifier string, content binary"))
    made = t.groupBy("identifier").agg(tables.one_per_page(F.col("latex")).alias("tex")).first().tex
    assert made.count("\\newpage") == 1 and made.index("a") < made.index("b")
    drawing = sinks.svg(pdf.glyphs(pages).withColumn("text", F.lit("<")), pdf.rules(pages), ["doc_id", "page"]).first().svg
    assert drawing.count("<text") == 3 and drawing.count("<rect") == 2 and "&lt;" in drawing
    assert json.loads(sinks.json_rows(pdf.rules(pages)).first().value)["kind"] == "stroke"
    assert sinks.docx(["<m/>"])[:2] == b"PK"


@needs_data
def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    got = glyph_stream.tumbling(glyph_stream.arrivals(spark, f"{tmp_path}/in", e.schema), "ts", "1 hour", "10 minutes", "event_type")
    q = got.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == e.count()


def test_formula_views_do_not_carry_their_source(spark):
    if os.path.isdir(DATA):
        assert formula_queries.order_pages(spark, DATA).columns == ["o_orderkey", "glyphs", "rules"]


def test_trees_and_chains_deeper_than_planned(spark):
    from inkfield.operators import trees

    n = spark.createDataFrame([(1, k, k - 1 if k else None, "Row") for k in range(7)], "t int, node_id int, parent_id int, kind string")
    assert {r.node_id: r.depth for r in trees.with_depth(n, ["t"], 2).collect()} == {k: k for k in range(7)}
    m = spark.createDataFrame([("f", k, 2, k + 1) for k in range(9)] + [("g", 1, 2, 2), ("g", 2, 2, 1)], "font string, code int, tag int, remainder int")
    got = tables.charlists(m).collect()
    assert max(r.step for r in got if r.font == "f") == 9 and sum(r.font == "f" for r in got) == 45 and sum(r.font == "g" for r in got) == 2


def test_a_page_that_is_not_there(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(small_pdf(STREAM))
    assert pdf.one_page(spark, f"{tmp_path}/a.pdf", 1).count() == 1
    with pytest.raises(IndexError):
        pdf.one_page(spark, f"{tmp_path}/a.pdf", 2)


def test_equal_regions_are_read_once(spark):
    x = json.dumps(["sup", ["id", "x"], ["num", "2"]])
    rows = [(k, x) for k in range(50)]
    got = formulas.extract(formulas.typeset(spark.createDataFrame(rows, "k int, expr string"), ["k"]), ["k"], ["latex", "json"]).collect()
    assert sorted(r.k for r in got) == list(range(50)) and {r.latex for r in got} == {"x^{2}"}
    assert json.loads(got[0].json)["children"][0]["kind"] == "Superscript"


def test_page_filters_reach_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    from inkfield.sources import pdf_source

    three = small_pdf(STREAM).replace(b"/Kids [3 0 R] /Count 1", b"/Kids [3 0 R 3 0 R 3 0 R] /Count 3")
    (tmp_path / "a.pdf").write_bytes(three)
    (tmp_path / "note.txt").write_bytes(b"no page")
    reader = pdf_source.PdfReader(str(tmp_path), 2)
    rest = [GreaterThan(("width",), 1.0)]
    assert list(reader.pushFilters([EqualTo(("page",), 2), *rest])) == rest
    assert [row[1] for p in reader.partitions() for row in reader.read(p)] == [2]
    pdf_source.register(spark)
    pages = spark.read.format("pdf_pages").option("splits", 2).load(str(tmp_path))
    assert sorted(r.page for r in pages.select("page").collect()) == [1, 2, 3]
    got = pages.filter("page = 2").collect()
    assert [r.page for r in got] == [2] and len(got[0].glyphs) == 3 and got[0].rules[0].kind == "stroke"
    assert pages.filter("page = 9").count() == 0
