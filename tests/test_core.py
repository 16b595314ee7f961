"""The pure cores: suites, page golden, writers, readers of files."""

import io
import json
import struct
import tarfile
import zlib

import pytest

from inkfield.core import readers, suites, tree, writers
from inkfield.core.decompile import Region, decompile
from inkfield.core.symbols import by_code, slots
from inkfield.core.tree import Node
from inkfield.core.typeset import page
from inkfield.sources import pdf, tables


@pytest.mark.parametrize("e", suites.EXTENDED, ids=repr)
def test_suite_is_read_back(e):
    glyphs, rules = page(e)
    t = decompile(glyphs, rules)
    assert tree.signature(t) == suites.expected(e)
    assert {g["glyph_id"] for g in glyphs} == {i for n in t.walk() for i in n.glyph_ids}
    assert tree.structural_confidence(t) > 0.9


@pytest.mark.parametrize("e", suites.EXTENDED, ids=repr)
def test_independent_readers_agree(e):
    t = decompile(*page(e))
    want = readers.relaxed(t)
    assert readers.from_mathml(writers.to_mathml(t)) == want
    assert readers.from_omml(writers.to_omml(t).text) == want
    assert readers.from_asciimath(writers.to_asciimath(t).text) == want


@pytest.mark.parametrize("seed", [7, 11, 23])
def test_random_suite(seed):
    exact = 0
    for e in suites.random_suite(seed, 300):
        glyphs, rules = page(e)
        t = decompile(glyphs, rules)
        assert {g["glyph_id"] for g in glyphs} == {i for n in t.walk() for i in n.glyph_ids}
        exact += tree.signature(t) == suites.expected(e)
    assert exact >= 288


@pytest.mark.parametrize("seed", [7, 11, 23])
def test_wide_random_suite(seed):
    exact = 0
    for e in suites.random_suite(seed, 300, wide=True):
        glyphs, rules = page(e)
        t = decompile(glyphs, rules)
        assert {g["glyph_id"] for g in glyphs} == {i for n in t.walk() for i in n.glyph_ids}
        exact += tree.signature(t) == suites.expected(e)
    assert exact >= 285


def test_digits_are_one_number_below_accents_and_scripts():
    for e in (("acc", r"\hat", ("num", "42")), ("sup", ("num", "42"), ("id", "x")), ("bigop", r"\bigcap", None, ("id", "N"), None), ("mat", "matrix", ((("id", "a"),), (("id", "b"),)))):
        assert tree.signature(decompile(*page(e))) == suites.expected(e)


@pytest.mark.parametrize(
    "font, code, text, kind, variant, latex",
    [
        ("CMSY10", 17, "≡", "Operator", "normal", r"\equiv"), ("CMSY10", 41, "⇒", "Operator", "normal", r"\Rightarrow"), ("CMSY10", 94, "∧", "Operator", "normal", r"\land"),
        ("CMSY10", 59, "∅", "Identifier", "normal", r"\emptyset"), ("LMMathSymbols10-Regular", 18, "⊆", "Operator", "normal", r"\subseteq"), ("ABCDEF+LMMathItalic10-Regular", 11, "α", "Identifier", "italic", r"\alpha"),
        ("MSBM10", 82, "R", "Identifier", "double-struck", r"\mathbb{R}"), ("EUFM10", 103, "g", "Identifier", "fraktur", None), ("MSAM10", 60, "≽", "Operator", "normal", r"\succcurlyeq"),
        ("CMMIB10", 120, "x", "Identifier", "bold-italic", None), ("CMEX10", 77, "⨁", "LargeOperator", "normal", r"\bigoplus"), ("CMTT10", 97, "a", "Identifier", "monospace", None), ("LASY10", 50, "□", "Identifier", "normal", r"\square"),
    ],
)
def test_slots_of_all_encodings(font, code, text, kind, variant, latex):
    t = decompile([{"glyph_id": 0, "font_name": font, "char_code": code, "size": 10.0, "x": 0.0, "y": 0.0}], [])
    (n,) = t.kids
    assert (n.text, n.kind, n.variant) == (text, kind, variant)
    assert latex is None or writers.to_latex(t).text == latex


def test_double_bars_are_fences():
    g = [{"glyph_id": k, "font_name": f, "char_code": c, "size": 10.0, "x": x, "y": 0.0} for k, (f, c, x) in enumerate([("CMSY10", 107, 0.0), ("CMMI10", 120, 5.0), ("CMSY10", 107, 10.7)])]
    assert tree.signature(decompile(g, [])) == "(Delimited ‖ ‖ (Identifier x))"


def test_node_table_round_trip():
    t = decompile(*page(suites.EXTENDED[-1]))
    rows = tree.flatten(t)
    assert tree.signature(tree.unflatten(rows[::-1])) == tree.signature(t)
    assert [r["node_id"] for r in rows] == list(range(len(rows)))


def test_page_golden():
    """The published content stream of a fraction over a radical: coordinates in big points."""
    bp = lambda *v: [x * 72.27 / 72 for x in v]
    marks = [("CMMI10", "x", 9.9626, 300.542, 638.167), ("CMR7", "two", 6.9738, 306.236, 641.782), ("CMMI7", "i", 6.9738, 306.236, 635.574), ("CMSY10", "radical", 9.9626, 298.852, 630.800), ("CMMI10", "y", 9.9626, 307.154, 624.593)]
    family = lambda f: f.lower().rstrip("0123456789")
    glyphs = [{"glyph_id": k, "font_name": f, "char_code": slots()[family(f), n].code, "size": bp(z)[0], "x": bp(x)[0], "y": bp(y)[0]} for k, (f, n, z, x, y) in enumerate(marks)]
    rules = []
    for k, (x0, x1, y) in enumerate([(298.852, 312.396, 633.918), (307.154, 312.396, 631.000)]):
        a, b, c = bp(x0, x1, y)
        rules.append({"rule_id": k, "x0": a, "y0": c - 0.2, "x1": b, "y1": c + 0.2})
    t = decompile(glyphs, rules)
    assert tree.signature(t) == "(Fraction (SubSup (Identifier x) (Identifier i) (Number 2)) (Radical (Identifier y)))"
    up, down = bp(641.782 - 638.167, 638.167 - 635.574)
    assert up == pytest.approx(3.62856, abs=1e-4) and down == pytest.approx(2.60272, abs=1e-4)


def test_unknown_glyphs_and_rules_are_kept():
    t = decompile([{"glyph_id": 4, "font_name": "ABCDEF+Helvetica", "char_code": 65, "size": 10.0, "x": 0.0, "y": 0.0}], [{"rule_id": 1, "x0": 50.0, "y0": 0.0, "x1": 60.0, "y1": 0.4}])
    kinds = {n.kind for n in t.walk()}
    assert "Unknown" in kinds and {i for n in t.walk() for i in n.glyph_ids} == {4} and {i for n in t.walk() for i in n.rule_ids} == {1}
    assert decompile([], []).kind == "Row"
    assert Region([], []).text_size == 10.0 and ("cmmi", 11) in by_code()


def it(t, **k):
    return Node("Identifier", text=t, variant="italic", font="CMMI10", **k)


def nn(t):
    return Node("Number", text=t)


def oo(t, **k):
    return Node("Operator", text=t, font="CMR10", **k)


X, Y = it("x"), it("y")


def test_latex_goldens():
    la = lambda n: writers.to_latex(n).text
    assert la(Node("Row", [X, oo("+"), Y])) == "x + y"
    assert la(it("α")) == r"\alpha" and la(it("ϵ")) == r"\epsilon" and la(it("ε")) == r"\varepsilon"
    assert la(Node("Identifier", text="R", font="MSBM10")) == r"\mathbb{R}"
    assert la(Node("Fraction", [X, Y])) == r"\frac{x}{y}" and la(Node("Radical", [X, it("n")])) == r"\sqrt[n]{x}"
    assert la(Node("Subscript", [Node("Superscript", [X, nn("2")]), it("i")])) == "{{}x^{2}}_{i}"
    s = Node("LargeOperator", text="∑", display=True)
    assert la(Node("UnderOver", [s, it("i"), it("n")], has_under=True, has_over=True)) == r"\sum\limits_{i}^{n}"
    assert la(Node("SubSup", [Node("LargeOperator", text="∫"), nn("0"), nn("1")])) == r"\intop\nolimits_{0}^{1}"
    assert la(Node("Delimited", [X], open="(", close=")", stretchy=True)) == r"\left( x \right)" and la(Node("Delimited", [X], open="(", close=")")) == "( x )"
    assert r"\mskip 3.000mu" in la(Node("Row", [X, Node("Space", width_em=3 / 18), it("d")]))
    assert la(oo("…")) == r"\ldots"
    got = writers.to_latex(Node("Row", [X, Node("Unknown", reason="rule with no material")]))
    assert got.unreproducible == ["rule with no material"]


def test_asciimath_goldens():
    am = lambda n: writers.to_asciimath(n).text
    assert am(Node("Row", [X, oo("+"), Y])) == "x + y" and am(oo("≤")) == "<=" and am(oo("∞")) == "oo" and am(oo("−")) == "-"
    assert am(Node("Fraction", [Node("Row", [X, oo("+"), nn("1")]), Y])) == "(x + 1)/(y)"
    assert am(Node("SubSup", [X, it("i"), nn("2")])) == "x_i^2" and am(Node("Superscript", [X, Node("Superscript", [Y, nn("2")])])) == "x^(y^2)"
    assert am(Node("Subscript", [Node("Superscript", [X, nn("2")]), it("i")])) == "{:x^2:}_i"
    assert am(Node("Fraction", [Node("Delimited", [X], open="(", close=")"), Y])) == "((x))/(y)"
    assert am(Node("Radical", [X, it("n")])) == "root(n)(x)" and am(Node("Delimited", [X], open="", close=")")) == "{:x)" and am(Node("Delimited", [X], open="⟨", close="⟩")) == "(:x:)"
    assert am(Node("Accent", [X], accent="⃗")) == "vec(x)" and am(Node("Underline", [X])) == "ul(x)" and am(Node("Fraction", [it("n"), it("k")], thickness=0.0)) == "((n),(k))"
    assert am(Node("Row", [X, oo(","), Y])) == "x, y" and am(Node("Identifier", text="sin", variant="normal")) == "sin" and am(Node("Identifier", text="Ric", variant="normal")) == "text(Ric)"


def matrix():
    return Node("Matrix", [Node("MatrixRow", [Node("MatrixCell", [it(c)]) for c in r]) for r in ("ab", "cd")])


def test_matrix_goldens():
    assert writers.to_latex(matrix()).text == r"\begin{matrix} a & b \\ c & d \end{matrix}"
    assert writers.to_asciimath(Node("Delimited", [matrix()], open="[", close="]")).text == "[(a,b),(c,d)]"
    assert writers.to_wordperfect(Node("Delimited", [matrix()], open="(", close=")", stretchy=True)).text == "left ( matrix {a & b # c & d} right )"
    xml = writers.to_mathml(matrix())
    assert xml.count("<mtr>") == 2 and xml.count("<mtd>") == 4
    assert '<m:count m:val="2"/>' in writers.to_omml(matrix()).text


def test_wordperfect_goldens():
    wp = lambda n: writers.to_wordperfect(n).text
    assert wp(Node("Fraction", [Node("Fraction", [it("a"), it("b")]), it("c")])) == "{{a} over {b}} over {c}" and wp(Node("Superscript", [X, nn("2")])) == "x sup 2"
    assert wp(Node("Superscript", [X, Node("Superscript", [Y, nn("2")])])) == "x sup {y sup 2}" and wp(Node("Subscript", [Node("Superscript", [X, nn("2")]), it("i")])) == "{x sup 2} sub i"
    s = Node("UnderOver", [Node("LargeOperator", text="∑"), Node("Row", [it("i"), oo("="), nn("0")]), it("n")], has_under=True, has_over=True)
    assert wp(s) == "sum from {i = 0} to n" and wp(Node("Delimited", [X], open="|", close="|", stretchy=True)) == "left LINE x right LINE"
    assert wp(Node("Fraction", [it("n"), it("k")], thickness=0.0)) == "stack {n # k}" and wp(Node("Space", width_em=1.0)) == "~" and wp(it("Γ")) == "GAMMA"
    assert writers.to_wordperfect(Node("Accent", [X], accent="⃗")).unverified == ["vec"]


def test_mathml_and_omml_facts():
    ml = writers.to_mathml
    assert "mathvariant" not in ml(X) and 'mathvariant="normal"' in ml(Node("Identifier", text="x", variant="normal")) and "mathvariant" not in ml(Node("Identifier", text="sin", variant="normal"))
    assert 'stretchy="true"' in ml(Node("Delimited", [X], open="(", close=")", stretchy=True)) and "□" in ml(Node("Unknown", reason="no name"))
    assert 'data-glyphs="3 4"' in ml(Node("Row", [X], glyph_ids=(3, 4), confidence=0.98), provenance=True)
    om = lambda n: writers.to_omml(n).text
    assert '<m:type m:val="noBar"/>' in om(Node("Fraction", [X, Y], thickness=0.0)) and '<m:limLoc m:val="subSup"/>' in om(Node("Subscript", [Node("LargeOperator", text="∫"), nn("0")]))
    assert '<m:sty m:val="p"/>' in om(Node("Identifier", text="Γ", variant="normal")) and '<m:scr m:val="double-struck"/>' in om(Node("Identifier", text="R", variant="double-struck"))
    speech = writers.speech_mathml(Node("Row", [X, Node("Space", width_em=1.0), Node("Unknown")]))
    assert "unrecognised symbol" in speech and "mspace" not in speech


def test_label_graph_relations():
    rel = lambda n: {m for _, _, m in writers.label_graph(n)[1]}
    assert rel(Node("SubSup", [X, it("i"), nn("2")])) == {"Sub", "Sup"} and rel(Node("Fraction", [X, Y])) == {"Above", "Below"} and rel(Node("Radical", [Y])) == {"Inside"}
    assert writers.to_label_graph(Node("Row", [it("a"), oo("+"), it("b")])).count("R,") == 2
    assert "7, 9" in writers.to_label_graph(Node("Row", [it("x", glyph_ids=(7, 9))]))


def test_shrinker_finds_a_small_failure():
    e = ("frac", ("seq", ("id", "a"), ("op", "+"), ("sqrt", ("id", "y"))), ("id", "b"))
    assert suites.shrink(e, lambda c: any(x[0] == "sqrt" for x in suites.walk(c))) == ("sqrt", ("id", "y"))


# ---------------------------------------------------------------- files


def small_pdf(content: bytes, compress: bool = True) -> bytes:
    body = zlib.compress(content) if compress else content
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if compress else b"") + body + b"\nendstream",
        b"<< /Type /Font /BaseFont /ABCDEF+CMMI10 /FirstChar 120 /Widths [571.5 490.3] >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, p) for k, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


STREAM = b"q 1 0 0 1 72 700 cm [] 0 d 0.398 w 0 5 m 20 5 l S Q BT /F1 9.9626 Tf 72 690 Td [(x)-100(y)] TJ 0 -12 Td (\\170) Tj ET 10 10 0.3 0.2 re f"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_page(compress):
    ((k, w, h, glyphs, rules, warnings),) = pdf.read_pages(small_pdf(STREAM, compress))
    assert (k, warnings) == (1, []) and w == pytest.approx(612 * 72.27 / 72)
    assert [g["char_code"] for g in glyphs] == [120, 121, 120] and glyphs[0]["font_name"] == "ABCDEF+CMMI10"
    assert glyphs[0]["size"] == pytest.approx(10.0, abs=1e-3) and glyphs[2]["y"] == pytest.approx(678 * 72.27 / 72)
    assert glyphs[1]["x"] - glyphs[0]["x"] == pytest.approx((0.5715 + 0.1) * 9.9626 * 72.27 / 72)
    assert len(rules) == 1 and rules[0]["kind"] == "stroke" and rules[0]["thickness"] == pytest.approx(0.398 * 72.27 / 72)


def test_broken_pdf_is_a_warning():
    ((_, _, _, glyphs, _, warnings),) = pdf.read_pages(small_pdf(b"").replace(b"/FlateDecode", b"/OtherDecode"))
    assert not glyphs and warnings
    assert list(pdf.read_pages(b"not a pdf")) == []


def small_tfm() -> bytes:
    words = [struct.pack(">I", 0), struct.pack(">i", 10 << 20)]  # header: checksum, design size
    chars = [bytes([1, 0x10, 2, 66]), bytes([1, 0x11, 3, 0])]  # 65: chain to 66; 66: extensible
    tables_ = [struct.pack(">i", int(v * (1 << 20))) for v in (0.0, 0.5)] + [struct.pack(">i", int(v * (1 << 20))) for v in (0.0, 0.7)] + [struct.pack(">i", int(v * (1 << 20))) for v in (0.0, 0.2)] + [struct.pack(">i", 0)]
    exten, params = [bytes([48, 0, 64, 66])], [struct.pack(">i", int(0.25 * (1 << 20)))]
    rest = b"".join(words + chars + tables_ + exten + params)
    lf = 6 + len(rest) // 4
    return struct.pack(">12H", lf, 2, 65, 66, 2, 2, 2, 1, 0, 0, 1, 1) + rest


def test_tfm():
    t = tables.parse_tfm(small_tfm())
    assert t["design_size"] == 10.0 and t["chars"][65][1:4] == [0.5, pytest.approx(0.7, abs=1e-5), 0.0] and t["chars"][66][3] == pytest.approx(0.2, abs=1e-5)
    assert t["extensible"] == {66: (48, 0, 64, 66)} and t["params"] == [0.25] and tables.charlist(t["chars"], 65) == [65, 66]
    with pytest.raises(ValueError):
        tables.parse_tfm(small_tfm()[:-4])


def test_extractor_files():
    xml = '<Pages><Page><Char BBOX="1 2 3 4">x</Char><Char BBOX="bad">y</Char><Graphic BBOX="0 0 9 1"/></Page></Pages>'
    assert list(tables.boxes_from_xml(xml)) == [[1, "char", 0, "x", 1.0, 2.0, 3.0, 4.0], [1, "graphic", 1, None, 0.0, 0.0, 9.0, 1.0]]
    nested = json.dumps({"a": [{"BBOX": "1 2 3 4", "value": "q"}, {"deep": {"BBOX": [5, 6, 7, 8], "charID": 3}}]})
    assert [r[4:] for r in tables.boxes_from_json(nested)] == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_latex_sources():
    text = "\\documentclass{a} % c\n\\begin{document} \\[ x \\] $$y$$ \\begin{equation} z \\label{e} $$no$$ \\end{equation} \\begin{align} a &= b \\end{align} \\end{document}"
    assert tables.displays(text)[:2] == (["x", "y", "z  $$no$$"], ["a &= b"])
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, body in (("big.tex", b"x" * 500), ("main.tex", b"\\documentclass{a}")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert tables.main_tex(buffer.getvalue()) == "\\documentclass{a}" and tables.main_tex(b"plain") == "plain" and tables.main_tex(zlib.compress(b"squeezed")) == "squeezed"
