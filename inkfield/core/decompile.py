"""From positioned glyphs and rules back to the layout tree that set them.

A region is solved from its structures inwards: stacked pieces become one symbol; bars, widest first, claim a
radicand, a numerator and denominator, or what they cross over or under; fences claim what stands between them, and
grids inside become matrices; accents and limits find their nucleus; what is left of a line is main row and
scripts. Each decision predicts where the forward rules would have put its parts and keeps the residual.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from inkfield.core.encodings import FAMILIES
from inkfield.core.symbols import ACCENTS, NEUTRAL, Slot, by_code, family
from inkfield.core.tree import Node
from inkfield.functions.typography import SIGMA, XI

CAPS_FAMILIES = ("cmsy", "cmbsy", "lmsy", "lmbsy")
VARIANTS = {f: variant for f, (_, variant) in FAMILIES.items()}


@dataclass
class Unit:
    """Something placed: a glyph, or a structure already solved."""

    node: Node
    x0: float
    x1: float
    y: float  # baseline
    h: float
    d: float
    size: float
    slot: Slot | None = None
    char: bool = False
    italic: float = 0.0
    ids: list[int] = field(default_factory=list)
    rules: list[int] = field(default_factory=list)

    @property
    def top(self) -> float:
        return self.y + self.h

    @property
    def low(self) -> float:
        return self.y - self.d

    @property
    def cx(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> float:
        return (self.top + self.low) / 2

    def role(self) -> str:
        return self.slot.role if self.slot else ""


@dataclass
class Rule:
    id: int
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def cy(self) -> float:
        return (self.y0 + self.y1) / 2


def trust(residual: float, size: float) -> float:
    """What a decision is worth whose place misses the rule's by a residual: 1 where it fits, a half where it is off by
    a tenth of the size, falling with the square beyond. All rules share this scale."""
    return 1 / (1 + (10 * residual / size) ** 2)


def _structure(kind: str, parts: list[Unit], node_kids: list[Node], y: float, size: float, **more) -> Unit:
    rules = more.pop("rules", [])
    own = more.pop("own", [])
    every = parts + own
    ids = sorted({i for u in every for i in u.ids})
    rids = sorted({i for u in every for i in u.rules} | {r.id for r in rules})
    x0 = min([u.x0 for u in every] + [r.x0 for r in rules])
    x1 = max([u.x1 for u in every] + [r.x1 for r in rules])
    top = max([u.top for u in every] + [r.y1 for r in rules])
    low = min([u.low for u in every] + [r.y0 for r in rules])
    node = Node(kind, node_kids, glyph_ids=tuple(ids), rule_ids=tuple(rids), box=(x0, low, x1, top), **more)
    return Unit(node, x0, x1, y, top - y, y - low, size, ids=ids, rules=rids)


class Region:
    def __init__(self, glyphs: list[dict], rules: list[dict], text_size: float | None = None):
        self.theta = XI["rule"]
        self.units = [u for u in map(self.leaf, glyphs)]
        self.rules = [Rule(r["rule_id"], min(r["x0"], r["x1"]), min(r["y0"], r["y1"]), max(r["x0"], r["x1"]), max(r["y0"], r["y1"])) for r in rules]
        # the extension font is set in the text's size even in scripts, so an operator alone with its limits tells it too
        self.text_size = text_size or max((u.size for u in self.units), default=10.0)

    # ------------------------------------------------------------ leaves

    def leaf(self, g: dict) -> Unit:
        fam = family(g["font_name"])
        s = by_code().get((fam, g["char_code"]))
        z, gid = g["size"], g["glyph_id"]
        if s is None:
            n = Node("Unknown", text=g.get("unicode_from_pdf") or "", font=g["font_name"], reason=f"no name for code {g['char_code']} of {g['font_name']}", glyph_ids=(gid,), confidence=0.3)
            w = g.get("pdf_width") or 0.5 * z
            return Unit(n, g["x"], g["x"] + w, g["y"], 0.7 * z, 0.2 * z, z, None, True, 0.0, [gid])
        variant = "script" if fam in CAPS_FAMILIES and s.name.isupper() and len(s.name) == 1 else VARIANTS.get(fam, "normal")
        kind = "LargeOperator" if s.role == "largeop" else "Number" if s.text.isdigit() else "Operator" if s.atom in ("Bin", "Rel", "Open", "Close", "Punct") or s.role in ("fence", "radical") or s.name in ("prime", "period", "slash") else "Identifier"
        n = Node(kind, text=s.text, glyph=s.name, font=g["font_name"], variant=variant, atom=s.atom, glyph_ids=(gid,), display=s.rank > 0 and s.role == "largeop", confidence=0.999, rule="leaf")
        u = Unit(n, g["x"], g["x"] + (g.get("pdf_width") or s.width * z), g["y"], s.height * z, s.depth * z, z, s, True, s.italic * z, [gid])
        n.box = (u.x0, u.low, u.x1, u.top)
        return u

    def p(self, name: str, size: float) -> float:
        return XI[name] * self.text_size if name in XI else SIGMA[name] * size

    # ------------------------------------------------------------ stacked pieces

    def merge_pieces(self, units: list[Unit]) -> list[Unit]:
        pieces = sorted((u for u in units if u.slot and u.slot.piece), key=lambda u: (round(u.x0, 2), -u.top))
        rest = [u for u in units if not (u.slot and u.slot.piece)]
        run: list[Unit] = []

        def close() -> None:
            if run:
                head = next((u for u in run if u.slot.piece in ("tp", "bt")), run[0])
                text = head.slot.text
                if head.slot.base.startswith("arrow") and {"tp", "bt"} <= {u.slot.piece for u in run}:
                    text = "⇕" if "dbl" in head.slot.base else "↕"
                x = _structure("Operator", run, [], 0.0, self.text_size, text=text, glyph=head.slot.name, font=head.node.font, atom=head.slot.atom, confidence=0.999, rule="pieces")
                x.slot, x.char = head.slot, False
                rest.append(x)

        for u in pieces:
            if run and (abs(u.x0 - run[-1].x0) > 0.1 * u.size or abs(u.top - run[-1].low) > 0.1 * u.size):
                close()
                run = []
            run.append(u)
        close()
        return rest

    # ------------------------------------------------------------ bars

    def block(self, seed: list[Unit], pool: list[Unit], bars: list[Rule], lo: float, hi: float) -> tuple[list[Unit], list[Rule]]:
        """Everything of the pool that hangs together with the seed vertically, with the bars between."""
        eps = 0.02 * self.text_size
        got, used = list(seed), []
        left, right = [u for u in pool if u not in seed], list(bars)
        grown = True
        while grown:
            grown = False
            top, low = max([u.top for u in got] + [r.y1 for r in used]), min([u.low for u in got] + [r.y0 for r in used])
            reach = 0.45 * min(u.size for u in got)
            for u in list(left):
                if u.low <= top + reach and u.top >= low - reach and lo - eps <= u.low and u.top <= hi + eps:
                    got.append(u)
                    left.remove(u)
                    grown = True
            for r in list(right):
                if low - reach <= r.cy <= top + reach and lo <= r.cy <= hi:
                    used.append(r)
                    right.remove(r)
                    grown = True
        return got, used

    def solve_bars(self, units: list[Unit], rules: list[Rule]) -> list[Unit]:
        rules = sorted(rules, key=lambda r: (r.x0 - r.x1, r.id))
        eps = max(0.1, 0.02 * self.text_size)
        while rules:
            # of bars of one width, one that lies over its content as an overline does is solved before a fraction's
            equal = [q for q in rules if abs((q.x1 - q.x0) - (rules[0].x1 - rules[0].x0)) < 0.05]
            r = rules[0]
            if len(equal) > 1:
                column = sorted(units, key=lambda u: u.cx)
                at = [u.cx for u in column]
                r = next((q for q in equal if self.lies_over(q, column[bisect_left(at, q.x0 - eps) : bisect_right(at, q.x1 + eps)])), r)
            rules.remove(r)
            surd = min((u for u in units if u.role() == "radical" and abs(u.x1 - r.x0) <= 3 * eps and abs(u.top - r.y1) <= 3 * eps), key=lambda u: abs(u.x1 - r.x0) + abs(u.top - r.y1), default=None)
            span = [u for u in units if u is not surd and r.x0 - 2 * eps <= u.cx <= r.x1 + 2 * eps and u.x0 >= r.x0 - 4 * eps and u.x1 <= r.x1 + 4 * eps + u.italic]
            inner = [q for q in rules if q.x0 >= r.x0 - 2 * eps and q.x1 <= r.x1 + 2 * eps]
            if surd:
                body = [u for u in span if u.cy < r.cy and u.cy > surd.low - eps]
                bars = [q for q in inner if surd.low - eps < q.cy < r.cy]
                units, rules = self.radical(units, rules, r, surd, body, bars)
                continue
            axis_reach = 1.4 * self.text_size
            over = [u for u in span if u.low >= r.cy - eps and u.low - r.cy < axis_reach]
            under = [u for u in span if u.top <= r.cy + eps and r.cy - u.top < axis_reach]
            up, up_bars = self.nearest_block(over, span, inner, r, True)
            down, down_bars = self.nearest_block(under, span, inner, r, False)
            if up and all(u.role() == "accent" for u in up):
                up, up_bars = [], []
            if up and down:
                units, rules = self.fraction(units, rules, r, up, up_bars, down, down_bars)
            elif down or up:
                units, rules = self.line(units, rules, r, down or up, down_bars if down else up_bars, bool(down))
            else:
                n = Node("Unknown", text="", reason="rule with no material", rule_ids=(r.id,), box=(r.x0, r.y0, r.x1, r.y1), confidence=0.3)
                units = units + [Unit(n, r.x0, r.x1, r.cy, r.y1 - r.cy, r.cy - r.y0, self.text_size, rules=[r.id])]
        return units

    def lies_over(self, r: Rule, units: list[Unit]) -> bool:
        """Whether the nearest thing under a bar is three pens below it, as rule 9 has it."""
        eps = 0.02 * self.text_size
        tops = [u.top for u in units if r.x0 - eps <= u.cx <= r.x1 + eps and u.top <= r.y0 + eps]
        return bool(tops) and abs(r.y0 - max(tops) - 3 * (r.y1 - r.y0)) < 0.03

    def nearest_block(self, side: list[Unit], span: list[Unit], bars: list[Rule], r: Rule, above: bool) -> tuple[list[Unit], list[Rule]]:
        if not side:
            return [], []
        gap = (lambda u: u.low - r.cy) if above else (lambda u: r.cy - u.top)
        first = min(side, key=gap)
        seed = [u for u in side if gap(u) <= gap(first) + 0.05 * self.text_size]
        lo, hi = (r.cy, 1e9) if above else (-1e9, r.cy)
        # a nested bar nearer than any glyph starts the block as well
        near = [q for q in bars if q is not r and (lo < q.cy < hi)]
        return self.block(seed, [u for u in span if (u.cy > r.cy) == above], near, lo, hi)

    def radical(self, units, rules, r, surd, body, bars):
        size = self.size_of_row(body) if body else surd.size
        quad = self.p("quad", size)
        mark = surd.x0 + 10 / 18 * quad
        index = [u for u in units if u not in body and u is not surd and u.size < 0.85 * size and u.low > surd.low + 0.3 * (surd.top - surd.low) and u.x1 <= mark + 0.25 * quad and u.x0 >= surd.x0 - 1.6 * quad and u.cy > surd.cy - 0.1 * size]
        if index and abs(max(u.x1 + u.italic for u in index) - mark) > 0.2 * quad:
            index = []
        if index:  # contiguous, ending at the mark
            index.sort(key=lambda u: u.x0)
        gone = set(map(id, body + index + [surd]))
        inner = self.parse(body, bars)
        kids = [inner.node] + ([self.parse(index, []).node] if index else [])
        theta = r.y1 - r.y0
        clear = r.y0 - inner.top
        expected = max((theta + SIGMA["x_height"] * size / 4, 1.25 * theta), key=lambda c: -abs(c + max(0.0, (surd.top - surd.low) - theta - (inner.h + inner.d + c)) / 2 - clear))
        want = expected + max(0.0, (surd.top - surd.low - theta) - (inner.h + inner.d + expected)) / 2
        res = clear - want
        u = _structure("Radical", body + index + [surd], kids, inner.y, size, rules=[r, *bars], confidence=trust(res, size), rule="radical", residual=res)
        return [x for x in units if id(x) not in gone] + [u], [q for q in rules if q not in bars]

    def fraction(self, units, rules, r, up, up_bars, down, down_bars):
        num, den = self.parse(up, up_bars), self.parse(down, down_bars)
        gone = set(map(id, up + down))
        best = None
        small = max(num.size, den.size)
        for size, display in ((small, True), (small, False), (small / 0.7, False), (small * 1.4, False)):
            base = r.cy - SIGMA["axis_height"] * size
            n, d = ("num1", "denom1") if display else ("num2", "denom2")
            theta = r.y1 - r.y0
            clear = 3 * theta if display else theta
            axis = SIGMA["axis_height"] * size
            u = SIGMA[n] * size
            u += max(0.0, clear - ((u - num.d) - (axis + theta / 2)))
            v = SIGMA[d] * size
            v += max(0.0, clear - ((axis - theta / 2) - (den.h - v)))
            res = max(abs(num.y - base - u), abs(base - den.y - v))
            if best is None or res < best[0] - 1e-9:
                best = (res, size, base)
        res, size, base = best
        if res > 0.1 * small and self.lies_over(r, down):
            return self.line(units, rules, r, down, down_bars, True)
        size = min((s for s in (self.text_size, 0.7 * self.text_size, 0.5 * self.text_size)), key=lambda s: abs(s - size))
        u = _structure("Fraction", up + down, [num.node, den.node], base, size, rules=[r, *up_bars, *down_bars], thickness=r.y1 - r.y0, confidence=trust(res, size), rule="fraction", residual=res, atom="Inner")
        u.x0, u.x1 = u.x0 - 1.2, u.x1 + 1.2
        return [x for x in units if id(x) not in gone] + [u], [q for q in rules if q not in up_bars and q not in down_bars]

    def line(self, units, rules, r, body, bars, over: bool):
        gone = set(map(id, body))
        inner = self.parse(body, bars)
        res = (r.y0 - inner.top if over else inner.low - r.y1) - 3 * (r.y1 - r.y0)
        u = _structure("Overline" if over else "Underline", body, [inner.node], inner.y, inner.size, rules=[r, *bars], confidence=trust(res, inner.size), rule="line", residual=res)
        return [x for x in units if id(x) not in gone] + [u], [q for q in rules if q not in bars]

    # ------------------------------------------------------------ fences and grids

    def solve_fences(self, units: list[Unit]) -> list[Unit]:
        """Innermost pairs first; a fence pairs with the next that closes its depth and stands at its height."""
        units = sorted(units, key=lambda u: (u.x0, -u.y))
        while True:
            pair = self.fence_pair(units)
            if not pair:
                return units
            a, b = pair
            tol = 0.05 * self.text_size
            between = [u for u in units if u is not a and u is not b and a.x1 - tol <= u.cx <= b.x0 + tol and u.low < max(a.top, b.top) and u.top > min(a.low, b.low)]
            size = a.size if a.slot.rank == 0 else self.size_of_row(between) if between else a.size
            inner = self.contents(between)
            big = a.slot.rank > 0 or b.slot.rank > 0
            if big:
                y = inner.y if inner else a.cy - SIGMA["axis_height"] * size
                if inner and inner.node.kind == "Matrix":
                    y = a.cy - SIGMA["axis_height"] * size
            else:
                y = a.y
            node_kids = [inner.node] if inner else [Node("Row")]
            u = _structure("Delimited", [a, b, *between], node_kids, y, size, open=a.slot.text, close=b.slot.text, stretchy=big, confidence=0.999 if a.slot.rank == b.slot.rank else 0.85, rule="fences", atom="Inner" if big else "Ord", glyph=a.slot.name)
            gone = set(map(id, [a, b, *between]))
            units = sorted([x for x in units if id(x) not in gone] + [u], key=lambda u: (u.x0, -u.y))

    def fence_pair(self, units: list[Unit]) -> tuple[Unit, Unit] | None:
        fences = [u for u in units if u.role() == "fence" and u.node.kind == "Operator"]
        tol = lambda a, b: abs(a.cy - b.cy) <= 0.2 * max(a.size, b.size) and abs(a.size - b.size) <= 0.05 * a.size or (a.slot.rank > 0 and b.slot.rank > 0 and abs(a.cy - b.cy) < 0.3 * a.size)
        open_: list[Unit] = []
        for u in fences:
            if u.slot.base in NEUTRAL:
                continue
            if u.slot.side == "left":
                open_.append(u)
            else:
                mate = next((o for o in reversed(open_) if tol(o, u)), None)
                if mate:
                    return mate, u
        for level in {(round(u.cy, 1), u.slot.base): u for u in fences if u.slot.base in NEUTRAL}.values():
            bars = [u for u in fences if u.slot.base == level.slot.base and tol(u, level)]
            if len(bars) % 2 == 0:
                for a, b in zip(bars[::2], bars[1::2]):
                    if any(a.x1 <= u.cx <= b.x0 for u in units):
                        return a, b
        return None

    def contents(self, units: list[Unit]) -> Unit | None:
        if not units:
            return None
        return self.grid(units) or self.parse(units, [])

    def grid(self, units: list[Unit]) -> Unit | None:
        """Rows of cells, where two baselines or more are further apart than any script."""
        full = max(u.size for u in units)
        rows: list[list[Unit]] = []
        for u in sorted((u for u in units if u.size >= 0.85 * full), key=lambda u: -u.y):
            if rows and rows[-1][-1].y - u.y <= 0.5 * full:
                rows[-1].append(u)
            else:
                rows.append([u])
        if len(rows) < 2 or any(rows[k][-1].y - rows[k + 1][0].y < full for k in range(len(rows) - 1)):
            return None
        base = [sum(u.y for u in r) / len(r) for r in rows]
        for u in units:
            if u.size < 0.85 * full:
                rows[min(range(len(rows)), key=lambda k: abs(base[k] - u.y))].append(u)
        quad = self.p("quad", full)
        cells = []
        for r in rows:
            r.sort(key=lambda u: u.x0)
            row, edge = [[r[0]]], r[0].x1
            for u in r[1:]:
                if u.x0 - edge > 0.7 * quad:
                    row.append([])
                row[-1].append(u)
                edge = max(edge, u.x1)
            cells.append(row)
        if len({len(r) for r in cells}) > 1:
            return self.columns_by_overlap(rows, units, full)
        return self.matrix(cells, units, full)

    def columns_by_overlap(self, rows, units, full):
        """Columns from gaps that all rows share."""
        spans: list[list[float]] = []
        for u in sorted(units, key=lambda u: u.x0):
            if spans and u.x0 - spans[-1][1] <= 0.7 * self.p("quad", full):
                spans[-1][1] = max(spans[-1][1], u.x1)
            else:
                spans.append([u.x0, u.x1])
        cells = [[[u for u in r if a - 0.01 <= u.cx <= b + 0.01] for a, b in spans] for r in rows]
        if any(not c for r in cells for c in r):
            parts = [self.parse(r, []) for r in rows]
            return _structure("Lines", units, [p.node for p in parts], units[0].y, full, confidence=0.9, rule="lines")
        return self.matrix(cells, units, full)

    def matrix(self, cells, units, full):
        nodes = []
        for r in cells:
            kids = []
            for c in r:
                x = self.parse(c, [])
                kids.append(Node("MatrixCell", [x.node], glyph_ids=tuple(sorted(x.ids)), confidence=0.99, rule="cell"))
            nodes.append(Node("MatrixRow", kids, confidence=0.99, rule="row"))
        top, low = max(u.top for u in units), min(u.low for u in units)
        return _structure("Matrix", units, nodes, (top + low) / 2 - SIGMA["axis_height"] * full, full, confidence=0.98, rule="matrix")

    # ------------------------------------------------------------ accents, limits, scripts

    def solve_accents(self, units: list[Unit]) -> list[Unit]:
        for a in sorted((u for u in units if u.role() == "accent"), key=lambda u: u.y):
            def miss(b: Unit) -> float:
                return abs(a.y - (b.y + b.h - min(b.h, SIGMA["x_height"] * a.size))) + abs(a.cx - b.cx) / 4

            near = [b for b in units if b is not a and b.role() != "accent" and b.x0 - 0.3 * a.size <= a.cx <= b.x1 + 0.3 * a.size and b.low < a.low + a.h]
            base = min(near, key=miss, default=None)
            if base is None or miss(base) > 0.5 * a.size:
                continue
            res = a.y - (base.y + base.h - min(base.h, SIGMA["x_height"] * a.size))
            u = _structure("Accent", [base], [base.node], base.y, base.size, own=[a], accent=ACCENTS[a.slot.name], glyph=a.slot.name, confidence=trust(res, a.size), rule="accent", residual=res)
            u.x0, u.x1, u.char, u.italic = base.x0, base.x1, base.char, base.italic
            units = [x for x in units if x is not a and x is not base] + [u]
        return units

    def solve_limits(self, units: list[Unit]) -> list[Unit]:
        for op in sorted((u for u in units if u.role() == "largeop"), key=lambda u: u.x0):
            size = self.op_size(op, units)
            op.y, op.h, op.d = op.cy - SIGMA["axis_height"] * size, op.top - (op.cy - SIGMA["axis_height"] * size), (op.cy - SIGMA["axis_height"] * size) - op.low
            op.size = size
            if not op.slot.rank or "integral" in op.slot.base:
                continue
            found = {}
            for where in ("under", "over"):
                side = [u for u in units if u is not op and u.size < 0.85 * size and (u.top <= op.low + 0.02 * size if where == "under" else u.low >= op.top - 0.02 * size)]
                seed = [u for u in side if u.x1 > op.x0 - 0.1 * size and u.x0 < op.x1 + 0.1 * size]
                got = list(seed)
                grown = bool(got)
                while grown:
                    grown = False
                    lo, hi = min(u.x0 for u in got), max(u.x1 + u.italic for u in got)
                    for u in side:
                        if u not in got and u.x0 <= hi + 0.35 * u.size and u.x1 >= lo - 0.35 * u.size:
                            got.append(u)
                            grown = True
                if got and abs((min(u.x0 for u in got) + max(u.x1 for u in got)) / 2 - op.cx) <= 0.5 * size:
                    found[where] = got
            if not found:
                continue
            kids, residual = [op.node], 0.0
            parts = [op]
            for where in ("under", "over"):
                if where in found:
                    x = self.parse(found[where], [])
                    kids.append(x.node)
                    parts += found[where]
                    if where == "over":
                        residual = max(residual, abs(x.low - op.top - max(self.p("big_op3", size) - x.d, self.p("big_op1", size))), key=abs)
                    else:
                        residual = max(residual, abs(op.low - x.top - max(self.p("big_op4", size) - x.h, self.p("big_op2", size))), key=abs)
            u = _structure("UnderOver", parts, kids, op.y, size, has_under="under" in found, has_over="over" in found, confidence=trust(residual, size), rule="limits", residual=residual, atom="Op")
            gone = set(map(id, parts))
            units = [x for x in units if id(x) not in gone] + [u]
        return units

    def op_size(self, op: Unit, units: list[Unit]) -> float:
        """Operators come from one font whatever the style: the size is that of the line they centre on."""
        for z in (self.text_size, 0.7 * self.text_size, 0.5 * self.text_size):
            if any(u is not op and abs(u.y + SIGMA["axis_height"] * z - op.cy) < 0.03 * z and abs(u.size - z) < 0.05 * z for u in units):
                return z
        return self.text_size

    def size_of_row(self, units: list[Unit]) -> float:
        return max((u.size for u in units if not (u.slot and u.slot.font == "cmex")), default=max((u.size for u in units), default=self.text_size))

    def main_baseline(self, units: list[Unit], size: float) -> float:
        """Width-weighted baseline of the heaviest cluster of full-size units; of equals that of the leftmost."""
        clusters: list[list[Unit]] = []
        for u in sorted((u for u in units if u.size >= 0.85 * size), key=lambda u: -u.y):
            if clusters and clusters[-1][-1].y - u.y <= max(0.05, 0.02 * size):
                clusters[-1].append(u)
            else:
                clusters.append([u])
        best = max(clusters, key=lambda c: (round(sum(u.x1 - u.x0 for u in c), 3), -min(u.x0 for u in c)))
        return sum(u.y * (u.x1 - u.x0 + 1e-6) for u in best) / sum(u.x1 - u.x0 + 1e-6 for u in best)

    def attach_scripts(self, units: list[Unit]) -> list[Unit]:
        size = self.size_of_row(units)
        units = sorted(units, key=lambda u: (u.x0, -u.y))
        base_y = self.main_baseline(units, size)
        near = lambda u: abs(u.y - base_y) <= max(0.06, 0.03 * size)
        full = lambda u: u.size >= 0.85 * size and near(u)
        main, loose = [u for u in units if full(u)], [u for u in units if not full(u)]
        if not loose:
            return main
        out, at = [], [u.x0 for u in loose]
        for k, b in enumerate(main):
            right = main[k + 1].x0 if k + 1 < len(main) else float("inf")
            left = b.x0 if k else float("-inf")
            mine = [u for u in loose[bisect_left(at, left) : bisect_left(at, right - 1e-6)] if u.x0 >= b.cx or not k]
            out.append(self.scripted(b, mine, size, base_y) if mine else b)
        return out

    def scripted(self, b: Unit, mine: list[Unit], size: float, base_y: float) -> Unit:
        largest = max(u.size for u in mine)
        up, down = [], []
        for u in sorted(mine, key=lambda u: u.x0):
            if u.size >= 0.85 * largest:
                (up if u.y > base_y else down).append(u)
        for u in mine:
            if u.size >= 0.85 * largest:
                continue
            has = [(abs(u.y - side[0].y), k) for k, side in enumerate((up, down)) if side and any(v.x0 <= u.x0 + 0.01 for v in side)]
            (up if has and min(has)[1] == 0 or not has and u.y > base_y else down).append(u)
        # a script that starts after the end of the other belongs to both together
        for late, early in ((down, up), (up, down)):
            if late and early and min(u.x0 for u in late) >= max(u.x1 for u in early) - 0.02 * size:
                whole = self.scripted(b, early, size, base_y)
                whole.char = False
                return self.scripted(whole, late, size, base_y)
        sup, sub = (self.parse(x, []) if x else None for x in (up, down))
        res = 0.0
        nucleus = 0.0 if b.char else None
        if sup:
            u0 = 0.0 if nucleus == 0.0 else b.h - SIGMA["sup_drop"] * 0.7 * size
            options = [max(u0, SIGMA[s] * size, sup.d + SIGMA["x_height"] * size / 4) for s in ("sup1", "sup2", "sup3")]
            res = min((sup.y - b.y - o for o in options), key=abs)
            if sub:
                res = min(res, 0.0, key=abs) if abs(res) > 0.5 else res
        elif sub:
            v0 = 0.0 if nucleus == 0.0 else b.d + SIGMA["sub_drop"] * 0.7 * size
            res = (b.y - sub.y) - max(v0, SIGMA["sub1"] * size, sub.h - 0.8 * SIGMA["x_height"] * size)
        kind = "SubSup" if sup and sub else "Superscript" if sup else "Subscript"
        kids = [b.node, *([sub.node] if sub else []), *([sup.node] if sup else [])]
        x = _structure(kind, [b, *up, *down], kids, b.y, b.size, confidence=trust(res, size), rule="scripts", residual=res, atom=b.node.atom)
        x.x1 += 0.5
        return x

    # ------------------------------------------------------------ rows

    def merge_leaves(self, units: list[Unit]) -> list[Unit]:
        """Digits that touch are one number, dots in a row an ellipsis, upright letters that touch a name."""
        again = True
        while again:
            units, again = self.merge_once(units)
        return units

    def merge_digits(self, units: list[Unit]) -> list[Unit]:
        """Digits that touch on one baseline are one number before anything is put over or beside them."""
        digits = sorted((u for u in units if u.char and u.node.kind == "Number"), key=lambda u: (round(u.y, 2), round(u.size, 2), u.x0))
        runs: list[list[Unit]] = []
        for u in digits:
            p = runs[-1][-1] if runs else None
            if p and abs(u.y - p.y) < 0.05 and abs(u.size - p.size) < 0.01 and abs(u.x0 - p.x1) <= 0.02 * u.size:
                runs[-1].append(u)
            else:
                runs.append([u])
        gone = {id(u) for r in runs if len(r) > 1 for u in r}
        if not gone:
            return units
        out = [u for u in units if id(u) not in gone]
        for r in runs:
            if len(r) > 1:
                m = _structure("Number", r, [], r[0].y, r[0].size, text="".join(u.node.text for u in r), font=r[0].node.font, variant=r[0].node.variant, confidence=0.999, rule="run")
                m.char = False
                out.append(m)
        return out

    def merge_once(self, units: list[Unit]) -> tuple[list[Unit], bool]:
        """Runs merged up to the first ellipsis, and whether there was one."""
        out: list[Unit] = []
        for u in units:
            p = out[-1] if out else None
            if p and u.char and p.node.kind in ("Number", "Identifier", "Operator") and abs(u.y - p.y) < 0.05 and abs(u.size - p.size) < 0.01:
                touch = -0.3 * u.size <= u.x0 - p.x1 <= 0.02 * u.size
                number = p.node.kind == "Number" and u.node.kind == "Number"
                name = p.node.variant == u.node.variant == "normal" and p.node.kind == u.node.kind == "Identifier" and p.node.text.isalpha() and u.node.text.isalpha()
                if touch and (number or name):
                    m = _structure(p.node.kind, [p, u], [], p.y, p.size, text=p.node.text + u.node.text, font=p.node.font, variant=p.node.variant, atom="Op" if name else "Ord", confidence=0.999, rule="run")
                    m.char = False
                    out[-1] = m
                    continue
            out.append(u)
        dots = []
        for u in out:
            if u.node.text == "." and dots and u.x0 - dots[-1].x1 <= 0.45 * u.size:
                dots.append(u)
            else:
                dots = [u] if u.node.text == "." else []
            if len(dots) == 3:
                k = out.index(dots[0])
                out[k : k + 3] = [_structure("Operator", dots, [], u.y, u.size, text="…", font=u.node.font, atom="Inner", confidence=0.99, rule="ellipsis")]
                return out, True
        return out, False

    def spaces(self, units: list[Unit], size: float) -> list[Node]:
        from inkfield.core.typeset import _GLUE

        kinds = [u.node.atom if u.node.kind != "Delimited" else "Inner" if u.node.stretchy else "Ord" for u in units]
        for k, a in enumerate(kinds):
            if a == "Bin" and (k == 0 or kinds[k - 1] in ("Bin", "Op", "Rel", "Open", "Punct")):
                kinds[k] = "Ord"
            if k and a in ("Rel", "Close", "Punct") and kinds[k - 1] == "Bin":
                kinds[k - 1] = "Ord"
        mu = self.p("quad", size) / 18
        out: list[Node] = []
        for k, u in enumerate(units):
            if k:
                gap = (u.x0 - units[k - 1].x1 - (units[k - 1].italic if units[k - 1].char and kinds[k - 1] != "Op" else 0.0)) / mu
                want = _GLUE[kinds[k - 1], kinds[k]][0] or 0.0
                if size < 0.85 * self.text_size and not _GLUE[kinds[k - 1], kinds[k]][1]:
                    want = 0.0
                extra = gap - want
                if extra > 1.5 and min(abs(gap - m) for m in (0.0, 3.0, 4.0, 5.0)) == abs(gap - min((3.0, 4.0, 5.0), key=lambda m: abs(gap - m))) or extra > 6:
                    clean = abs(extra - round(extra)) <= 1 / 3
                    out.append(Node("Space", width_em=extra / 18, confidence=0.99 if clean else 0.8, rule="space"))
            out.append(u.node)
        return out

    def parse(self, units: list[Unit], rules: list[Rule]) -> Unit:
        units = self.merge_digits(self.merge_pieces(list(units)))
        units = self.solve_bars(units, list(rules))
        units = self.solve_accents(units)
        units = self.solve_limits(units)
        units = self.solve_fences(units)
        if len(units) > 1:
            table = self.grid(units)  # without fences, or lines of one region
            if table:
                return table
            units = self.attach_scripts(units)
        units = self.merge_leaves(sorted(units, key=lambda u: (u.x0, -u.y)))
        if len(units) == 1:
            return units[0]
        size = self.size_of_row(units)
        y = self.main_baseline(units, size)
        row = _structure("Row", units, self.spaces(units, size), y, size, confidence=0.999, rule="row")
        return row


def decompile(glyphs: list[dict], rules: list[dict], text_size: float | None = None) -> Node:
    """The tree of a region. Glyphs that no structure claimed are kept at its end as unknown."""
    if not glyphs and not rules:
        return Node("Row")
    r = Region(glyphs, rules, text_size)
    if not r.units:
        return r.solve_bars([], r.rules)[0].node
    n = r.parse(r.units, r.rules).node
    if n.kind != "Row":
        n = Node("Row", [n], glyph_ids=n.glyph_ids, rule_ids=n.rule_ids, box=n.box, confidence=0.999, rule="row")
    have = {i for x in n.walk() for i in x.glyph_ids}
    for u in r.units:
        if not have.issuperset(u.ids):
            u.node.kind, u.node.reason, u.node.confidence = "Unknown", "not part of any structure", 0.2
            n.kids.append(u.node)
    return n
