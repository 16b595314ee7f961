"""Sinks: JSON, layered SVG and HTML, docx packages and label-graph files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Drawing layers from the back.
LAYERS = ("page", "regions", "baselines", "boxes", "rules", "glyphs", "labels")


def json_rows(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Rows as JSON text; doubles are rounded here and nowhere before."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cols)).alias("value"))


def _fmt(c: Column) -> Column:
    return F.format_string("%.3f", c)


def _rect(x0: Column, y0: Column, x1: Column, y1: Column, height: float) -> Column:
    return F.concat(F.lit('<rect x="'), _fmt(x0), F.lit('" y="'), _fmt(F.lit(height) - y1), F.lit('" width="'), _fmt(x1 - x0), F.lit('" height="'), _fmt(y1 - y0), F.lit('"/>'))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("?")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def svg(
    glyphs: DataFrame, rules: DataFrame, keys: list[str], height: float = 800.0, width: float = 600.0, regions: DataFrame | None = None, boxes: DataFrame | None = None,
    baselines: DataFrame | None = None,
) -> DataFrame:
    """keys, svg: one drawing for each key, y turned downwards, in LAYERS. glyphs: glyph_id, x, y, size, text; rules:
    rule_id and a box; regions and boxes: n and a box, regions with a label; baselines: y."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    text = lambda x, y, more, t: F.concat(F.lit('<text x="'), _fmt(x), F.lit('" y="'), _fmt(F.lit(height) - y), F.lit('" '), more, F.lit(">"), _escaped(t), F.lit("</text>"))
    size = F.concat(F.lit('font-size="'), _fmt(F.col("size")), F.lit('"'))
    layers = [
        (glyphs, 0, F.lit(0), _rect(F.lit(0.0), F.lit(0.0), F.lit(width), F.lit(height), height)), (regions, 1, F.col("n"), _rect(*box, height)),
        (baselines, 2, -F.col("y"), F.concat(F.lit('<line x1="0.000" x2="'), _fmt(F.lit(width)), F.lit('" y1="'), _fmt(F.lit(height) - F.col("y")), F.lit('" y2="'), _fmt(F.lit(height) - F.col("y")), F.lit('"/>'))),
        (boxes, 3, F.col("n"), _rect(*box, height)), (rules, 4, F.col("rule_id"), _rect(*box, height)), (glyphs, 5, F.col("glyph_id"), text(F.col("x"), F.col("y"), size, F.col("text"))),
        (regions, 6, F.col("n"), text(F.col("x0"), F.col("y1"), F.lit('class="label"'), F.col("label"))),
    ]
    parts = None
    for rows, layer, n, part in layers:
        if rows is not None and (layer != 6 or "label" in rows.columns):
            one = rows.select(*keys, F.lit(layer).alias("layer"), n.cast("double").alias("n"), part.alias("part"))
            one = one.distinct() if layer == 0 else one
            parts = one if parts is None else parts.unionByName(one)
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]))
    names = F.element_at(F.array(*map(F.lit, LAYERS)), F.col("layer") + 1)
    drawn = parts.groupBy(*keys, "layer").agg(body.alias("body")).select(*keys, F.struct("layer", F.concat(F.lit('<g id="'), names, F.lit('">'), F.col("body"), F.lit("</g>")).alias("x")).alias("s"))
    whole = drawn.groupBy(*keys).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"])).alias("body"))
    return whole.select(*keys, F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:.3f} {height:.3f}">'), F.col("body"), F.lit("</svg>")).alias("svg"))


def html_page(drawing: Column, title: str = "page") -> Column:
    return F.concat(F.lit(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body>"), drawing, F.lit("</body></html>"))


def docx(omml: list[str]) -> bytes:
    """A word-processor package with one paragraph for each formula (OMML paragraphs)."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{m}</w:p>" for m in omml)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def docx_files(formulas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docx: a package for each row of keys and omml, an array of formulas."""
    from inkfield.operators.formulas import _map

    return _map(formulas.select(*keys, "omml"), keys, "docx binary", lambda r: [[docx(r["omml"] or [])]])


def docx_summary(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the number of parts of each package and of paragraphs in its document."""
    from inkfield.operators.formulas import _map

    def rows(r: dict):
        with zipfile.ZipFile(io.BytesIO(r["docx"])) as z:
            yield [len(z.namelist()), z.read("word/document.xml").count(b"<w:p>")]

    return _map(files.select(*keys, "docx"), keys, "parts int, paragraphs int", rows)


def write_label_graphs(graphs: DataFrame, path: str, text: str = "label_graph", by: str = "suite") -> None:
    """One text file set for each value of `by`."""
    graphs.select(by, F.col(text).alias("value")).write.partitionBy(by).mode("overwrite").text(path)
