"""A forward typesetter: formula expressions to glyphs and rules, by the published rules of mathematical typesetting.

Expressions are tuples: ("id", text), ("num", text), ("op", text), ("seq", e, ...), ("frac", n, d), ("sup", b, s),
("sub", b, s), ("subsup", b, sub, sup), ("sqrt", e[, index]), ("delim", kind, e[, big]), ("bigop", name, lower,
upper, body), ("acc", name, e), ("over", e), ("mat", env, rows), ("thin",). The result keeps no trace of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from inkfield.core.symbols import Slot, by_text, slots
from inkfield.functions.typography import SIGMA, XI, glue_rows

DELIMS = {"paren": ("paren", "paren", "(", ")"), "bracket": ("bracket", "bracket", "[", "]"), "brace": ("brace", "brace", "{", "}"), "angle": ("angbracket", "angbracket", "⟨", "⟩"), "vert": ("bar", "bar", "|", "|"), "floor": ("floor", "floor", "⌊", "⌋"), "ceil": ("ceiling", "ceiling", "⌈", "⌉")}
ENVIRONMENTS = {"pmatrix": "paren", "bmatrix": "bracket", "Bmatrix": "brace", "vmatrix": "vert", "matrix": ""}
OPERATOR_TEX = {r"\sum": "summation", r"\prod": "product", r"\int": "integral", r"\coprod": "coproduct", r"\bigcup": "union", r"\bigcap": "intersection", r"\oint": "contintegral"}
LIMITS = frozenset(("summation", "product", "coproduct", "union", "intersection"))
ACCENT_SLOT = {r"\hat": "circumflex", r"\bar": "macron", r"\vec": "vector", r"\dot": "dotaccent", r"\ddot": "dieresis", r"\tilde": "tilde", r"\check": "caron", r"\breve": "breve", r"\acute": "acute", r"\grave": "grave"}
NULL_SPACE, SCRIPT_SPACE, ROW_SKIP, COLUMN_SEP = 1.2, 0.5, 12.0, 10.0
_GLUE = {(a, b): (m, s) for a, b, m, s in glue_rows()}
D, DC, T, TC, S, SC, SS, SSC = range(8)


@dataclass
class Box:
    w: float = 0.0
    h: float = 0.0
    d: float = 0.0
    glyphs: list[tuple[Slot, float, float, float]] = field(default_factory=list)  # slot, size, x, y
    rules: list[tuple[float, float, float, float]] = field(default_factory=list)
    atom: str = "Ord"
    char: bool = False
    italic: float = 0.0

    def put(self, o: Box, x: float, y: float) -> Box:
        self.glyphs += [(s, z, gx + x, gy + y) for s, z, gx, gy in o.glyphs]
        self.rules += [(a + x, b + y, c + x, e + y) for a, b, c, e in o.rules]
        self.h, self.d = max(self.h, o.h + y), max(self.d, o.d - y)
        return self


class Setter:
    def __init__(self, text_size: float = 10.0):
        self.text = text_size

    def size(self, style: int) -> float:
        return self.text * (1.0 if style < S else 0.7 if style < SS else 0.5)

    def p(self, name: str, style: int) -> float:
        """Family-2 parameters at the style's size; the extension font is always loaded at text size."""
        return XI[name] * self.text if name in XI else SIGMA[name] * self.size(style)

    def glyph(self, s: Slot, style: int) -> Box:
        z = self.text if s.font == "cmex" else self.size(style)
        return Box(s.width * z, s.height * z, s.depth * z, [(s, z, 0.0, 0.0)], [], s.atom, True, s.italic * z)

    def centred(self, b: Box, style: int) -> Box:
        """On the axis."""
        up = self.p("axis_height", style) - (b.h - b.d) / 2
        return Box(b.w, 0.0, 0.0, [], [], b.atom, False, b.italic).put(b, 0.0, up)

    def fence(self, base: str, side: str, need: float, style: int, big: bool) -> Box:
        """A fence of at least `need` in all, or of text size."""
        atom = "Open" if side == "left" else "Close"
        name = "bar" if base == "bar" else base + side
        font = "cmr" if base in ("paren", "bracket") else "cmsy"
        plain = self.glyph(slots()[font, name], style)
        plain.atom = atom
        if not big:
            return plain
        if plain.h + plain.d >= need:
            return self.centred(plain, style)
        if base == "bar":
            piece, n = self.glyph(slots()["cmex", "vextendsingle"], style), 1
            while n * piece.d < need:
                n += 1
            return self.centred(self._stack([piece] * n, atom), style)
        for suffix in ("big", "Big", "bigg", "Bigg"):
            g = self.glyph(slots()["cmex", name + suffix], style)
            if g.h + g.d >= need or ("cmex", name + "tp") not in slots() and suffix == "Bigg":
                g.atom = atom
                return self.centred(g, style)
        top, end, more = (self.glyph(slots()["cmex", name + x], style) for x in ("tp", "bt", "ex"))
        parts, middle = [top], [self.glyph(slots()["cmex", name + "mid"], style)] if base == "brace" else []
        fixed, n = sum(g.h + g.d for g in (top, end, *middle)), 0
        while fixed + n * (more.h + more.d) * (2 if middle else 1) < need:
            n += 1
        parts += [more] * n + middle + [more] * (n if middle else 0) + [end]
        return self.centred(self._stack(parts, atom), style)

    @staticmethod
    def _stack(parts: list[Box], atom: str) -> Box:
        out, y = Box(parts[0].w, 0.0, 0.0, atom=atom), 0.0
        for g in parts:
            out.put(g, 0.0, y - g.h)
            y -= g.h + g.d
        out.h, out.d = 0.0, -y
        return out

    def row(self, boxes: list[Box], style: int) -> Box:
        """Boxes with the glue of their classes; an explicit space is a box without glyphs."""
        kinds = [b.atom for b in boxes if b.atom != "Space"]
        for k, a in enumerate(kinds):
            if a == "Bin" and (k == 0 or kinds[k - 1] in ("Bin", "Op", "Rel", "Open", "Punct")):
                kinds[k] = "Ord"
            if k and a in ("Rel", "Close", "Punct") and kinds[k - 1] == "Bin":
                kinds[k - 1] = "Ord"
        if kinds and kinds[-1] == "Bin":
            kinds[-1] = "Ord"
        out, last, k = Box(), None, 0
        for b in boxes:
            if b.atom == "Space":
                out.w += b.w
                continue
            a = kinds[k]
            k += 1
            if last is not None:
                mu, always = _GLUE[last, a]
                if mu and (always or style < S):
                    out.w += mu / 18 * self.p("quad", style)
            out.put(b, out.w, 0.0)
            out.w += b.w + (b.italic if b.char and b.atom != "Op" else 0.0)
            last = a
        return out

    def scripts(self, base: Box, style: int, sub: Box | None, sup: Box | None) -> Box:
        theta, xh = self.p("rule", style), self.p("x_height", style)
        small = S if style < S else SS
        u = 0.0 if base.char else base.h - self.p("sup_drop", small)
        v = 0.0 if base.char else base.d + self.p("sub_drop", small)
        slant = base.italic if base.char else 0.0
        out = Box(base.w, 0.0, 0.0, atom=base.atom).put(base, 0.0, 0.0)
        if sup is None and sub is not None:
            v = max(v, self.p("sub1", style), sub.h - 0.8 * xh)
        if sup is not None:
            u = max(u, self.p("sup3" if style & 1 else "sup1" if style < T else "sup2", style), sup.d + xh / 4)
        if sup is not None and sub is not None:
            v = max(v, self.p("sub2", style))
            short = 4 * theta - ((u - sup.d) - (sub.h - v))
            if short > 0:
                v += short
                psi = 0.8 * xh - (u - sup.d)
                if psi > 0:
                    u, v = u + psi, v - psi
        wide = 0.0
        if sup is not None:
            out.put(sup, base.w + slant, u)
            wide = slant + sup.w
        if sub is not None:
            out.put(sub, base.w, -v)
            wide = max(wide, sub.w)
        out.w += wide + SCRIPT_SPACE
        return out

    def limits(self, base: Box, style: int, lower: Box | None, upper: Box | None) -> Box:
        w = max(x.w for x in (base, lower, upper) if x)
        out = Box(w, 0.0, 0.0, atom="Op").put(base, (w - base.w) / 2, 0.0)
        h, d, half = base.h, base.d, base.italic / 2
        if upper:
            gap = max(self.p("big_op3", style) - upper.d, self.p("big_op1", style))
            out.put(upper, (w - upper.w) / 2 + half, h + gap + upper.d)
        if lower:
            gap = max(self.p("big_op4", style) - lower.h, self.p("big_op2", style))
            out.put(lower, (w - lower.w) / 2 - half, -(d + gap + lower.h))
        return out

    def fraction(self, num: Box, den: Box, style: int) -> Box:
        theta, axis, w = self.p("rule", style), self.p("axis_height", style), max(num.w, den.w)
        u, v = (self.p("num1", style), self.p("denom1", style)) if style < T else (self.p("num2", style), self.p("denom2", style))
        clear = 3 * theta if style < T else theta
        u += max(0.0, clear - ((u - num.d) - (axis + theta / 2)))
        v += max(0.0, clear - ((axis - theta / 2) - (den.h - v)))
        out = Box(w + 2 * NULL_SPACE, 0.0, 0.0, atom="Inner")
        out.put(num, NULL_SPACE + (w - num.w) / 2, u).put(den, NULL_SPACE + (w - den.w) / 2, -v)
        out.rules.append((NULL_SPACE, axis - theta / 2, NULL_SPACE + w, axis + theta / 2))
        return out

    def radical(self, body: Box, style: int, index: Box | None) -> Box:
        theta = self.p("rule", style)
        clear = theta + self.p("x_height", style) / 4 if style < T else 1.25 * theta
        need = body.h + body.d + clear + theta
        surd = self.glyph(slots()["cmsy", "radical"], style)
        if surd.h + surd.d < need:
            for suffix in ("big", "Big", "bigg", "Bigg"):
                surd = self.glyph(slots()["cmex", "radical" + suffix], style)
                if surd.h + surd.d >= need:
                    break
        excess = surd.d - (body.h + body.d + clear)
        if excess > 0:
            clear += excess / 2
        out, x, top = Box(), 0.0, body.h + clear + theta
        if index:
            out.put(index, 5 / 18 * self.p("quad", style), 0.6 * (top - max(body.d, surd.h + surd.d - top)))
            x = max(0.0, 5 / 18 * self.p("quad", style) + index.w - 10 / 18 * self.p("quad", style))
        out.put(surd, x, top - surd.h)
        out.put(body, x + surd.w, 0.0)
        out.rules.append((x + surd.w, top - theta, x + surd.w + body.w, top))
        out.h, out.w, out.atom = max(out.h, top + theta), x + surd.w + body.w, "Ord"
        return out

    def set(self, e: tuple, style: int = D) -> Box:
        kind = e[0]
        if kind in ("id", "op"):
            return self.glyph(by_text()[e[1]], style)
        if kind == "num":
            out = Box()
            for ch in e[1]:
                g = self.glyph(by_text()[ch], style)
                out.put(g, out.w, 0.0)
                out.w += g.w
            out.char = len(e[1]) == 1
            return out
        if kind == "thin":
            return Box(3 / 18 * self.p("quad", style), atom="Space")
        if kind == "seq":
            return self.row([self.set(x, style) for x in e[1:]], style)
        cramped = style | 1
        up = (S if style < S else SS) + (style & 1)
        if kind in ("sup", "sub", "subsup"):
            base = self.set(e[1], style)
            sub = self.set(e[2], up | 1) if kind != "sup" else None
            sup = self.set(e[-1], up) if kind != "sub" else None
            return self.scripts(base, style, sub, sup)
        if kind == "frac":
            n = T + (style & 1) if style < T else up if style < SS else style
            return self.fraction(self.set(e[1], n), self.set(e[2], n | 1), style)
        if kind == "sqrt":
            index = self.set(e[2], SS) if len(e) > 2 and e[2] else None
            return self.radical(self.set(e[1], cramped), style, index)
        if kind == "delim":
            big = len(e) < 4 or e[3]
            return self.fenced(self.set(e[2], style), DELIMS[e[1]][0], style, big)
        if kind == "bigop":
            return self.big_operator(e, style, up)
        if kind == "acc":
            body, g = self.set(e[2], cramped), self.glyph(slots()[("cmmi" if ACCENT_SLOT[e[1]] == "vector" else "cmr"), ACCENT_SLOT[e[1]]], style)
            out = Box(body.w, 0.0, 0.0, atom="Ord", char=body.char).put(body, 0.0, 0.0)
            return out.put(g, (body.w - g.w) / 2, body.h - min(body.h, self.p("x_height", style)))
        if kind == "over":
            body, theta = self.set(e[1], cramped), self.p("rule", style)
            out = Box(body.w).put(body, 0.0, 0.0)
            out.rules.append((0.0, body.h + 3 * theta, body.w, body.h + 4 * theta))
            out.h = body.h + 5 * theta
            return out
        if kind == "mat":
            return self.matrix(e, style)
        raise ValueError(f"no such expression: {kind}")

    def fenced(self, body: Box, base: str, style: int, big: bool) -> Box:
        axis = self.p("axis_height", style)
        reach = 2 * max(body.h - axis, body.d + axis)
        need = max(reach * 0.901, reach - 5.0)
        left, right = (self.fence(base, side, need, style, big) for side in ("left", "right"))
        if not big:
            return self.row([left, body, right], style)
        out = Box(atom="Inner")
        for b in (left, body, right):
            out.put(b, out.w, 0.0)
            out.w += b.w
        return out

    def big_operator(self, e: tuple, style: int, up: int) -> Box:
        _, tex, lower, upper, body = e
        name = OPERATOR_TEX[tex]
        op = self.centred(self.glyph(slots()["cmex", name + ("display" if style < T else "text")], style), style)
        op.atom, op.char = "Op", True
        sub, sup = (self.set(x, st) if x else None for x, st in ((lower, up | 1), (upper, up)))
        if not sub and not sup:
            core = op
        elif style < T and name in LIMITS:
            core = self.limits(op, style, sub, sup)
        else:
            op.char = False  # shifts follow the box, as for any nucleus that is not a character
            core = self.scripts(op, style, sub, sup)
        core.atom = "Op"
        return core if body is None else self.row([core, self.set(body, style)], style)

    def matrix(self, e: tuple, style: int) -> Box:
        _, env, rows = e
        cells = [[self.set(c, T) for c in r] for r in rows]
        widths = [max(r[k].w for r in cells) for k in range(len(cells[0]))]
        table, y = Box(sum(widths) + COLUMN_SEP * (len(widths) - 1)), 0.0
        base = []
        for k, r in enumerate(cells):
            if k:
                above, below = max(c.d for c in cells[k - 1]), max(c.h for c in r)
                y -= max(ROW_SKIP * self.text / 10, max(above, 3.6 * self.text / 10) + max(below, 8.4 * self.text / 10))
            base.append(y)
        for y, r in zip(base, cells):
            x = 0.0
            for c, w in zip(r, widths):
                table.put(c, x + (w - c.w) / 2, y)
                x += w + COLUMN_SEP
        table = self.centred(table, style)
        table.w = sum(widths) + COLUMN_SEP * (len(widths) - 1)
        table.atom = "Inner"
        fence = ENVIRONMENTS[env]
        return self.fenced(table, DELIMS[fence][0], style, True) if fence else table


def page(e: tuple, x: float = 72.0, y: float = 700.0, text_size: float = 10.0, style: int = D) -> tuple[list[dict], list[dict]]:
    """(glyph rows, rule rows) of an expression set with its origin at x, y."""
    b = Setter(text_size).set(e, style)
    glyphs = [
        {"glyph_id": k, "font_name": f"{s.font.upper()}{10 if z >= 9 else 7 if z >= 6 else 5}" if s.font != "cmex" else "CMEX10", "char_code": s.code, "name": s.name, "size": z, "x": gx + x, "y": gy + y}
        for k, (s, z, gx, gy) in enumerate(b.glyphs)
    ]
    rules = [{"rule_id": k, "x0": a + x, "y0": c + y, "x1": d + x, "y1": f + y} for k, (a, c, d, f) in enumerate(b.rules)]
    return glyphs, rules
