"""A reader of born-digital PDF pages: glyphs at their baseline origins and ruled lines, in TeX points.

Pages are found through the page tree; objects come from the file itself or from object streams; streams may be
Flate-compressed. Simple fonts only: one byte is one code. A broken page becomes a warning, not a failure.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Container, Iterator
from math import hypot

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PT = 72.27 / 72
MIN_RULE, DEFAULT_PEN = 0.5, 0.4
GLYPH = "struct<glyph_id:bigint,char_code:int,x:double,y:double,size:double,font_name:string,font_resource:string,matrix:array<double>,unicode_from_pdf:string,pdf_width:double>"
RULE = "struct<rule_id:bigint,x0:double,y0:double,x1:double,y1:double,thickness:double,kind:string,source:string>"
PAGE = f"page int, width double, height double, glyphs array<{GLYPH}>, rules array<{RULE}>, warnings array<string>"

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|/[^\s<>\[\]()/%]*|<[0-9A-Fa-f\s]*>|\(|[-+]?\d*\.?\d+|[^\s<>\[\]()/%]+")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name."""


class Ref(tuple):
    """(object number, generation)."""


class Word(str):
    """A bare word: an operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from just behind its opening bracket."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            m = re.compile(rb"[0-7]{1,3}").match(data, at)
            if m:
                out.append(int(m[0], 8) & 255)
                at = m.end()
            else:
                out += ESCAPES.get(e, b"" if e in b"\r\n" else e)
                at += 1
        elif c == b"(":
            depth += 1
            out += c
        elif c == b")":
            depth -= 1
            if not depth:
                break
            out += c
        else:
            out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, end): numbers, names, strings, bare words and brackets."""
    while m := TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t[:1] == b"%":
            continue
        if t == b"(":
            s, at = _string(data, at)
            yield s, at
        elif t in (b"<<", b">>", b"[", b"]"):
            yield Word(t.decode()), at
        elif t[:1] == b"<":
            h = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), at
        elif t[:1] == b"/":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1")), at
        else:
            try:
                yield (float(t) if b"." in t else int(t)), at
            except ValueError:
                yield Word(t.decode("latin-1")), at


def value(data: bytes, at: int = 0) -> tuple[object, int]:
    """One object, with references resolved to Ref, and where it ends."""
    stack: list[list] = [[]]
    for t, end in tokens(data, at):
        top = stack[-1]
        if t in ("[", "<<") and isinstance(t, Word):
            stack.append([])
            continue
        if t == "]" and isinstance(t, Word):
            top = stack.pop()
            stack[-1].append(top)
        elif t == ">>" and isinstance(t, Word):
            top = stack.pop()
            stack[-1].append({k: v for k, v in zip(top[::2], top[1::2])})
        elif t == "R" and isinstance(t, Word) and len(top) >= 2:
            top[-2:] = [Ref(top[-2:])]
        elif isinstance(t, Word) and t in ("true", "false", "null"):
            top.append({"true": True, "false": False, "null": None}[t])
        elif isinstance(t, Word):
            return (stack[0][0] if stack[0] else None), end
        else:
            top.append(t)
        if len(stack) == 1 and len(stack[0]) == 1 and not (isinstance(stack[0][0], int) and re.compile(rb"\s+\d+\s+R\b").match(data, end)):
            return stack[0][0], end
    return (stack[0][0] if stack[0] else None), len(data)


class Document:
    def __init__(self, data: bytes):
        self.data, self.objects, self.streams = data, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", data):
            self.objects[int(m[1])] = ("at", m.end())
        for n in list(self.objects):
            v = self.get(Ref((n, 0)))
            if isinstance(v, dict) and v.get("Type") == "ObjStm":
                body = self.stream(Ref((n, 0)))
                head = [t for t, _ in tokens(body[: v["First"]])]
                for k, off in zip(head[::2], head[1::2]):
                    self.objects.setdefault(k, ("in", body, v["First"] + off))

    def get(self, x):
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            where = self.objects.get(x[0])
            if where is None:
                return None
            x = value(self.data, where[1])[0] if where[0] == "at" else value(where[1], where[2])[0]
        return None

    def stream(self, ref) -> bytes:
        where = self.objects[ref[0]]
        head, end = value(self.data, where[1])
        m = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if not m:
            return b""
        n = self.get(head.get("Length")) if isinstance(head, dict) else None
        body = self.data[m.end() : m.end() + n] if isinstance(n, int) else self.data[m.end() : self.data.find(b"endstream", m.end())]
        filters = self.get(head.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                body = zlib.decompressobj().decompress(body)
            elif f is not None:
                raise ValueError(f"filter {f}")
        return body

    def pages(self) -> Iterator[dict]:
        root = next((self.get(Ref((n, 0))) for n in self.objects if isinstance(self.get(Ref((n, 0))), dict) and self.get(Ref((n, 0))).get("Type") == "Catalog"), None)

        def walk(node, inherited, depth=0):
            node = self.get(node)
            if not isinstance(node, dict) or depth > 50:
                return
            own = inherited | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                for kid in self.get(node.get("Kids")) or []:
                    yield from walk(kid, own, depth + 1)
            else:
                yield own | node

        if root:
            yield from walk(root.get("Pages"), {})


def _mul(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def interpret(content: bytes, fonts: dict[str, dict]) -> tuple[list[dict], list[dict], list[str]]:
    """Glyphs, rules and warnings of a content stream. fonts: resource to name, first code and widths."""
    glyphs, rules, warnings = [], [], []
    state = {"ctm": (1, 0, 0, 1, 0, 0), "pen": None, "font": "", "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0, "lead": 0.0}
    saved, operands, path, start = [], [], [], None
    tm = tlm = (1, 0, 0, 1, 0, 0)

    def show(text: bytes) -> None:
        nonlocal tm
        f = fonts.get(state["font"], {})
        for code in text:
            w = f.get("widths", {}).get(code, 0.0) / 1000
            m = _mul((1, 0, 0, 1, 0, state["rise"]), _mul(tm, state["ctm"]))
            glyphs.append(
                {
                    "glyph_id": len(glyphs), "char_code": code, "x": m[4] * PT, "y": m[5] * PT, "size": state["size"] * hypot(m[2], m[3]) * PT, "font_name": f.get("name", state["font"]),
                    "font_resource": state["font"], "matrix": [float(v) for v in m], "unicode_from_pdf": None, "pdf_width": w * state["size"] * state["scale"] * hypot(m[0], m[1]) * PT or None,
                }
            )
            tx = (w * state["size"] + state["char"] + (state["word"] if code == 32 else 0.0)) * state["scale"]
            tm = _mul((1, 0, 0, 1, tx, 0), tm)

    def paint(kind: str) -> None:
        for sub in path:
            pts = [_mul((1, 0, 0, 1, x, y), state["ctm"])[4:] for x, y in sub["points"]]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            box = len({round(x, 4) for x in xs}) <= 2 and len({round(y, 4) for y in ys}) <= 2
            scale = hypot(state["ctm"][0], state["ctm"][1])
            pen = (state["pen"] if state["pen"] is not None else DEFAULT_PEN) * scale
            if not box or sub["curved"]:
                warnings.append("a path that is neither a line nor a box")
            x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
            if kind == "stroke":
                if x1 - x0 >= y1 - y0:
                    y0, y1 = y0 - pen / 2, y1 + pen / 2
                else:
                    x0, x1 = x0 - pen / 2, x1 + pen / 2
            if max(x1 - x0, y1 - y0) * PT >= MIN_RULE:
                rules.append({"rule_id": len(rules), "x0": x0 * PT, "y0": y0 * PT, "x1": x1 * PT, "y1": y1 * PT, "thickness": min(x1 - x0, y1 - y0) * PT, "kind": kind, "source": "path"})
        path.clear()

    for t, _ in tokens(content):
        if not isinstance(t, Word) or t in ("[", "]", "<<", ">>"):
            operands.append(t)
            continue
        o = [x for x in operands if not (isinstance(x, Word) and x in ("[", "]"))]
        operands.clear()
        try:
            if t == "q":
                saved.append(dict(state))
            elif t == "Q":
                state = saved.pop() if saved else state
            elif t == "cm":
                state["ctm"] = _mul(tuple(map(float, o[-6:])), state["ctm"])
            elif t == "w":
                state["pen"] = float(o[-1])
            elif t == "BT":
                tm = tlm = (1, 0, 0, 1, 0, 0)
            elif t == "Tf":
                state["font"], state["size"] = str(o[-2]), float(o[-1])
            elif t in ("Td", "TD"):
                if t == "TD":
                    state["lead"] = -float(o[-1])
                tm = tlm = _mul((1, 0, 0, 1, float(o[-2]), float(o[-1])), tlm)
            elif t == "Tm":
                tm = tlm = tuple(map(float, o[-6:]))
            elif t in ("Tc", "Tw", "Ts", "TL"):
                state[{"Tc": "char", "Tw": "word", "Ts": "rise", "TL": "lead"}[t]] = float(o[-1])
            elif t == "Tz":
                state["scale"] = float(o[-1]) / 100
            elif t in ("T*", "'", '"'):
                if t == '"':
                    state["word"], state["char"] = float(o[-3]), float(o[-2])
                tm = tlm = _mul((1, 0, 0, 1, 0, -state["lead"]), tlm)
                if t != "T*":
                    show(o[-1])
            elif t == "Tj":
                show(o[-1])
            elif t == "TJ":
                for x in o:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        tm = _mul((1, 0, 0, 1, -float(x) / 1000 * state["size"] * state["scale"], 0), tm)
            elif t == "m":
                start = (float(o[-2]), float(o[-1]))
                path.append({"points": [start], "curved": False})
            elif t == "l" and path:
                path[-1]["points"].append((float(o[-2]), float(o[-1])))
            elif t in ("c", "v", "y") and path:
                path[-1]["points"].append((float(o[-2]), float(o[-1])))
                path[-1]["curved"] = True
            elif t == "re":
                x, y, w, h = map(float, o[-4:])
                path.append({"points": [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], "curved": False})
            elif t == "h" and path:
                path[-1]["points"].append(path[-1]["points"][0])
            elif t in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
                paint("stroke" if t in ("S", "s") else "fill")
            elif t == "n":
                path.clear()
        except (IndexError, ValueError, TypeError) as e:
            warnings.append(f"operator {t}: {e}")
    return glyphs, rules, warnings


def read_pages(data: bytes, page_numbers: Container[int] | None = None) -> Iterator[tuple]:
    """(page, width, height, glyphs, rules, warnings) of a file; page numbers from 1. Other pages than those named are not
    interpreted; none named: all."""
    try:
        doc = Document(data)
        found = list(doc.pages())
    except Exception as e:
        yield 0, 612.0 * PT, 792.0 * PT, [], [], [f"{type(e).__name__}: {e}"]
        return
    for k, p in enumerate(found, 1):
        if page_numbers is not None and k not in page_numbers:
            continue
        box = doc.get(p.get("MediaBox")) or [0, 0, 612, 792]
        try:
            fonts = {}
            for name, ref in (doc.get((doc.get(p.get("Resources")) or {}).get("Font")) or {}).items():
                f = doc.get(ref) or {}
                first = doc.get(f.get("FirstChar")) or 0
                fonts[str(name)] = {"name": str(f.get("BaseFont", name)), "widths": {first + i: float(doc.get(w) or 0) for i, w in enumerate(doc.get(f.get("Widths")) or [])}}
            parts = p.get("Contents")
            parts = [parts] if isinstance(parts, Ref) and not isinstance(doc.get(parts), list) else doc.get(parts) or []
            glyphs, rules, warnings = interpret(b"\n".join(doc.stream(r) for r in parts), fonts)
        except Exception as e:
            glyphs, rules, warnings = [], [], [f"{type(e).__name__}: {e}"]
        yield k, float(box[2] - box[0]) * PT, float(box[3] - box[1]) * PT, glyphs, rules, warnings


def pages_of(files: DataFrame, page_numbers: Container[int] | None = None) -> DataFrame:
    """doc_id and PAGE for every page of files in a table (doc_id, content). page_numbers: other pages are not interpreted."""
    from inkfield.operators.formulas import _map

    return _map(files.select("doc_id", "content"), ["doc_id"], PAGE, lambda r: map(list, read_pages(r["content"], page_numbers)))


def scan(spark: SparkSession, path: str, page_numbers: list[int] | None = None) -> DataFrame:
    """doc_id (the path) and PAGE for every page under a path or glob."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    return pages_of(files, page_numbers)


def one_page(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The page of that number of a file; IndexError if there is none."""
    page = scan(spark, path, [number]).filter(F.col("page") == number)
    if page.isEmpty():
        raise IndexError(f"no page {number} in {path}")
    return page


def unicode_of(given: Column, named: Column) -> tuple[Column, Column]:
    """(source, text) of a glyph: what the file says of it, else its name in the font's encoding."""
    source = F.when(given.isNotNull() & (given != ""), "file").when(named.isNotNull(), "font").otherwise("none")
    return source, F.when(source == "file", given).when(source == "font", named)


def glyphs(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.inline("glyphs"))


def rules(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.inline("rules"))
