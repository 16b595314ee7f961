"""Glyph and rule tables from other extractors, font metrics, and LaTeX sources."""

from __future__ import annotations

import io
import json
import re
import tarfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.operators.formulas import _map

BOXES = "page int, kind string, id bigint, text string, x double, y double, width double, height double"
METRIC = "code int, width double, height double, depth double, italic double, tag int, remainder int"


def bbox(text: str | None) -> tuple[float, float, float, float] | None:
    """'x y w h', or null when malformed."""
    try:
        x, y, w, h = map(float, (text or "").split())
        return x, y, w, h
    except ValueError:
        return None


def boxes_from_xml(text: str) -> Iterator[list]:
    """Characters and graphics of an extractor's XML: pages that hold elements with a BBOX."""
    root = ElementTree.fromstring(text)
    for p, page in enumerate(root.iter("Page"), 1):
        n = 0
        for e in page.iter():
            b = bbox(e.get("BBOX"))
            if b and e.tag in ("Char", "Graphic", "char", "graphic"):
                yield [p, e.tag.lower(), n, (e.text or "").strip() or e.get("value"), *b]
                n += 1


def boxes_from_json(text: str) -> Iterator[list]:
    """Any object with a BBOX and a value or charID, wherever it stands."""
    n = 0

    def walk(x, page: int):
        nonlocal n
        if isinstance(x, dict):
            page = int(x.get("page", page)) if str(x.get("page", page)).isdigit() else page
            b = x.get("BBOX")
            b = bbox(b) if isinstance(b, str) else tuple(map(float, b)) if isinstance(b, list) and len(b) == 4 else None
            if b and ("value" in x or "charID" in x):
                yield [page, "char", n, str(x.get("value", "")), *b]
                n += 1
            for v in x.values():
                yield from walk(v, page)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v, page)

    yield from walk(json.loads(text), 1)


def extracted(files: DataFrame, text: str = "value", form: str = "xml") -> DataFrame:
    """doc_id and BOXES; a file that cannot be read gives one row of kind 'warning'."""

    def rows(r: dict):
        try:
            yield from list((boxes_from_xml if form == "xml" else boxes_from_json)(r[text]))
        except Exception as e:
            yield [0, "warning", 0, f"{type(e).__name__}: {e}"[:200], None, None, None, None]

    return _map(files.select("doc_id", text), ["doc_id"], BOXES, rows)


def as_glyphs(boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """Extracted characters as glyph rows: no code, the baseline is the bottom of the box."""
    return boxes.filter("kind = 'char'").select(
        "doc_id", "page", F.col("id").alias("glyph_id"), F.lit(-1).alias("char_code"), "x", "y", F.lit(size).alias("size"), F.col("text").alias("unicode_from_pdf"), F.col("width").alias("pdf_width")
    )


# ---------------------------------------------------------------- font metrics


def parse_tfm(data: bytes) -> dict:
    """design_size, chars (code to metric row), extensible (code to top, middle, bottom, repeated) and params of a
    TeX font metric file. Lengths are in design sizes. ValueError if the file's lengths do not add up."""
    if len(data) < 24:
        raise ValueError("too short for a font metric file")
    lf, lh, bc, ec, nw, nh, nd, ni, nl, nk, ne, np_ = (int.from_bytes(data[k : k + 2], "big") for k in range(0, 24, 2))
    if lf * 4 != len(data) or lf != 6 + lh + (ec - bc + 1) + nw + nh + nd + ni + nl + nk + ne + np_:
        raise ValueError("the lengths of the font metric file do not add up")

    def fix(at: int) -> float:
        return int.from_bytes(data[4 * at : 4 * at + 4], "big", signed=True) / (1 << 20)

    at = 6 + lh
    info, at = at, at + ec - bc + 1
    widths, heights, depths, italics = at, at + nw, at + nw + nh, at + nw + nh + nd
    exten = italics + ni + nl + nk
    chars = {}
    for code in range(bc, ec + 1):
        b = data[4 * (info + code - bc) : 4 * (info + code - bc) + 4]
        if b[0]:
            chars[code] = [code, fix(widths + b[0]), fix(heights + (b[1] >> 4)), fix(depths + (b[1] & 15)), fix(italics + (b[2] >> 2)), b[2] & 3, b[3]]
    recipes = {c: tuple(data[4 * (exten + m[6]) : 4 * (exten + m[6]) + 4]) for c, m in chars.items() if m[5] == 3 and m[6] < ne}
    return {"design_size": fix(7), "chars": chars, "extensible": recipes, "params": [fix(exten + ne + k) for k in range(np_)]}


def charlist(chars: dict, code: int, limit: int = 32) -> list[int]:
    """The ever larger characters that follow a character; cycles end the list."""
    out = [code]
    while chars.get(out[-1], [0] * 7)[5] == 2 and len(out) < limit:
        following = chars[out[-1]][6]
        if following in out:
            break
        out.append(following)
    return out


def metrics(files: DataFrame) -> DataFrame:
    """font, METRIC of every character of font metric files (columns font, content)."""
    return _map(files.select("font", "content"), ["font"], METRIC, lambda r: parse_tfm(r["content"])["chars"].values())


def locate(asked: DataFrame, metric: DataFrame) -> DataFrame:
    """asked (font, code, ...) with METRIC where the font is known, nulls where it is not."""
    return asked.join(metric, ["font", "code"], "left")


def charlists(metric: DataFrame) -> DataFrame:
    """font, code, next, step: the successor chains as relations, one join a step, followed to their ends or into cycles."""
    links = metric.filter("tag = 2").select("font", F.col("code").alias("at"), F.col("remainder").alias("next"))
    out = layer = links.select("font", F.col("at").alias("code"), "next", F.lit(1).alias("step"), F.array("at", "next").alias("seen"))
    k = 1
    while k < 4 or not layer.isEmpty():  # size chains of real fonts end by then
        k += 1
        layer = (
            layer.join(links.withColumnRenamed("next", "more"), (layer["font"] == links["font"]) & (layer["next"] == links["at"]))
            .filter(~F.array_contains("seen", F.col("more"))).select(layer["font"], "code", F.col("more").alias("next"), F.lit(k).alias("step"), F.concat("seen", F.array("more")).alias("seen"))
        )
        out = out.unionByName(layer)
    return out.drop("seen")


# ---------------------------------------------------------------- LaTeX sources

SINGLE = ("equation", "equation*", "displaymath", "math")
MULTIPLE = ("align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "alignat", "flalign")


def main_tex(data: bytes) -> str:
    """The main source of an e-print: of a tar the file with a document class, else the largest; else gzip or text."""
    for unpack in (lambda d: zlib.decompress(d, 47), lambda d: d):
        try:
            data = unpack(data)
            break
        except zlib.error:
            continue
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            found = [(m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in tar.getmembers() if m.isfile() and m.name.endswith((".tex", ".ltx"))]
    except tarfile.TarError:
        return data.decode("utf-8", "replace")
    return max((t for _, t in found), key=lambda t: ("\\documentclass" in t, len(t)), default="")


def displays(text: str) -> tuple[list[str], list[str], str]:
    """(single displays, multi-line displays, preamble) of a LaTeX source without its comments."""
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    preamble, _, body = text.partition("\\begin{document}")
    body = body or preamble
    taken: list[tuple[int, int]] = []
    out: dict[str, list[tuple[int, str]]] = {"single": [], "multi": []}
    for kind, names in (("multi", MULTIPLE), ("single", SINGLE)):
        for m in re.finditer(rf"\\begin\{{({'|'.join(map(re.escape, names))})\}}(.*?)\\end\{{\1\}}", body, re.S):
            taken.append(m.span())
            out[kind].append((m.start(), m[2].strip()))
    for m in re.finditer(r"\\\[(.*?)\\\]|(?<!\\)\$\$(.*?)\$\$", body, re.S):
        if not any(a <= m.start() < b for a, b in taken):
            out["single"].append((m.start(), (m[1] or m[2] or "").strip()))
    clean = lambda xs: [re.sub(r"\\label\{[^}]*\}|\\nonumber", "", t).strip() for _, t in sorted(xs)]
    return clean(out["single"]), clean(out["multi"]), preamble


def papers(files: DataFrame) -> DataFrame:
    """identifier, kind, ord, latex of every display of e-prints (columns identifier, content)."""

    def rows(r: dict):
        single, multi, _ = displays(main_tex(r["content"]))
        yield from (["single", k, t] for k, t in enumerate(single))
        yield from (["multi", k, t] for k, t in enumerate(multi))

    return _map(files.select("identifier", "content"), ["identifier"], "kind string, ord int, latex string", rows)


def one_per_page(latex: Column, preamble: str = r"\documentclass{article}") -> Column:
    """An aggregate: a document that sets each display of a group on a page of its own, in order."""
    pages = F.concat_ws("\n\\newpage\n", F.transform(F.array_sort(F.collect_list(F.struct("ord", latex.alias("t")))), lambda s: F.concat(F.lit("\\[ "), s["t"], F.lit(" \\]"))))
    return F.concat(F.lit(preamble + "\n\\pagestyle{empty}\n\\begin{document}\n"), pages, F.lit("\n\\end{document}\n"))
