"""Readers that share nothing with the writers: MathML, Office MathML and AsciiMath to relaxed signatures.

A relaxed signature drops what formats cannot agree on: whether a symbol is an identifier or an operator, rows within
rows, display and stretch. Two texts agree when their relaxed signatures are equal.
"""

from __future__ import annotations

import re
import unicodedata
from xml.etree import ElementTree

from inkfield.core.tree import LEAVES, Node
from inkfield.core.writers import _A, _F, _S

INVISIBLE = dict.fromkeys(map(ord, "⁡⁢⁣⁤​﻿"))
PAIRS = {o: c for o, c in zip("([{⟨|⌊⌈", ")]}⟩|⌋⌉")}
#: Spellings of one mark in the formats.
SAME = {"-": "−", "\u0302": "^", "ˆ": "^", "‾": "¯", "\u0304": "¯", "˜": "~"}


def normalise_text(t: str | None) -> str:
    t = unicodedata.normalize("NFKC", (t or "").translate(INVISIBLE)).strip()
    return SAME.get(t, t)


def row(parts: list[str]) -> str:
    """Rows within rows are dissolved; a row of one is that one. Digits that stand together are one number."""
    flat: list[str] = []
    for p in parts:
        if p.startswith("(Row "):
            flat += split(p[5:-1])
        elif p:
            flat.append(p)
    out: list[str] = []
    for p in flat:
        if out and re.fullmatch(r"\(Leaf \d\)", p) and re.fullmatch(r"\(Leaf \d+\)", out[-1]):
            out[-1] = out[-1][:-1] + p[6:]
        else:
            out.append(p)
    return out[0] if len(out) == 1 else f"(Row {' '.join(out)})"


def split(s: str) -> list[str]:
    """The expressions of a list, by nesting depth. Leaves that are brackets themselves are kept whole."""
    out, depth, start, k = [], 0, None, 0
    while k < len(s):
        m = re.compile(r"\(Leaf [^ ]\)").match(s, k)
        if m and depth == 0:
            out.append(m[0])
            k = m.end()
            continue
        if m:
            k = m.end()
            continue
        if s[k] == "(" and (s[k + 1 : k + 2].isalpha()):
            if depth == 0:
                start = k
            depth += 1
        elif s[k] == ")" and depth:
            if not re.compile(r"Delimited [^ ]* ?$").search(s[:k][-14:]):
                depth -= 1
                if depth == 0:
                    out.append(s[start : k + 1])
        k += 1
    return out


def leaf(t: str) -> str:
    return f"(Leaf {normalise_text(t)})"


def relaxed(n: Node) -> str:
    """Of a tree."""
    if n.kind in LEAVES:
        return leaf(n.text) if len(n.text) == 1 or n.text.isdigit() or n.text.isalpha() else row([leaf(c) for c in n.text])
    kids = [relaxed(k) for k in n.kids if k.kind != "Space"]
    if n.kind == "Row":
        return row(kids)
    if n.kind == "Delimited":
        return f"(Delimited {normalise_text(n.open)} {normalise_text(n.close)} {row(kids)})"
    head = {"Accent": f" {normalise_text(n.accent)}", "UnderOver": f" {int(n.has_under)}{int(n.has_over)}"}.get(n.kind, "")
    kind = "Accent" if n.kind in ("Overline", "Underline") else n.kind
    head = {"Overline": " ¯", "Underline": " _"}.get(n.kind, head)
    return f"({kind}{head} {' '.join(kids)})"


def from_mathml(xml: str) -> str:
    def name(e):
        return e.tag.rsplit("}", 1)[-1]

    def fenced(es, parts):
        """A row of marks at both ends is fenced."""
        if len(es) >= 2 and name(es[0]) == name(es[-1]) == "mo" and es[0].get("fence") == "true":
            return f"(Delimited {normalise_text(es[0].text)} {normalise_text(es[-1].text)} {row(parts[1:-1])})"
        return row(parts)

    def read(e) -> str:
        k, es = name(e), list(e)
        if k in ("mi", "mn", "mo", "mtext"):
            t = normalise_text(e.text)
            return leaf(t) if len(t) == 1 or t.isdigit() or t.isalpha() else row([leaf(c) for c in t])
        if k == "mspace":
            return ""
        parts = [read(x) for x in es]
        if k in ("math", "mrow", "mstyle"):
            return fenced(es, parts)
        if k == "mtd":
            return f"(MatrixCell {row(parts)})"
        if k in ("mtr", "mtable"):
            return f"({'MatrixRow' if k == 'mtr' else 'Matrix'} {' '.join(parts)})"
        if k == "msqrt":
            return f"(Radical {row(parts)})"
        if k in ("mover", "munder") and (e.get("accent") or e.get("accentunder")) == "true":
            return f"(Accent {normalise_text(es[1].text)} {parts[0]})"
        kind = {"mfrac": "Fraction", "msup": "Superscript", "msub": "Subscript", "msubsup": "SubSup", "mroot": "Radical", "munderover": "UnderOver 11", "munder": "UnderOver 10", "mover": "UnderOver 01"}[k]
        return f"({kind} {' '.join(parts)})"

    return read(ElementTree.fromstring(xml))


def from_omml(xml: str) -> str:
    def name(e):
        return e.tag.rsplit("}", 1)[-1]

    def val(e, path, default=""):
        x = e
        for p in path.split("/"):
            x = next((c for c in x if name(c) == p), None)
            if x is None:
                return default
        return next((v for k, v in x.attrib.items() if k.endswith("val")), default)

    def part(e, tag) -> str:
        x = next((c for c in e if name(c) == tag), None)
        return row([read(c) for c in x]) if x is not None and len(x) else ""

    def read(e) -> str:
        k = name(e)
        if k == "r":
            t = normalise_text("".join(c.text or "" for c in e if name(c) == "t"))
            return (leaf(t) if len(t) == 1 or t.isdigit() or t.isalpha() else row([leaf(c) for c in t])) if t else ""
        if k in ("oMath", "oMathPara"):
            return row([read(c) for c in e])
        if k == "f":
            return f"(Fraction {part(e, 'num')} {part(e, 'den')})"
        if k in ("sSup", "sSub", "sSubSup"):
            kind = {"sSup": "Superscript", "sSub": "Subscript", "sSubSup": "SubSup"}[k]
            return f"({kind} {' '.join(x for x in (part(e, 'e'), part(e, 'sub'), part(e, 'sup')) if x)})"
        if k == "nary":
            op, sub, sup = leaf(val(e, "naryPr/chr", "∫")), part(e, "sub"), part(e, "sup")
            parts = " ".join(x for x in (op, sub, sup) if x)
            if not sub and not sup:
                return op
            if val(e, "naryPr/limLoc") == "undOvr":
                return f"(UnderOver {int(bool(sub))}{int(bool(sup))} {parts})"
            return f"({'SubSup' if sub and sup else 'Subscript' if sub else 'Superscript'} {parts})"
        if k == "rad":
            deg = part(e, "deg")
            return f"(Radical {part(e, 'e')}{' ' + deg if deg else ''})"
        if k == "d":
            return f"(Delimited {normalise_text(val(e, 'dPr/begChr', '('))} {normalise_text(val(e, 'dPr/endChr', ')'))} {part(e, 'e')})"
        if k == "acc":
            return f"(Accent {normalise_text(val(e, 'accPr/chr', '̂'))} {part(e, 'e')})"
        if k == "bar":
            return f"(Accent {'¯' if val(e, 'barPr/pos') == 'top' else '_'} {part(e, 'e')})"
        if k == "m":
            rows = [[f"(MatrixCell {row([read(c) for c in x])})" for x in r if name(x) == "e"] for r in e if name(r) == "mr"]
            return "(Matrix " + " ".join(f"(MatrixRow {' '.join(r)})" for r in rows) + ")"
        return ""

    return read(ElementTree.fromstring(xml))


_ASCII = {v[1]: k for k, v in _S.items() if len(v[1]) > 1 or v[1] == "-"} | {"<=": "≤", ">=": "≥", "!=": "≠"}
_ACC = {v[1]: k for k, v in _A.items()} | {"ul": "_"}
_OPEN = {v[1]: k for k, v in _F.items() if k in PAIRS} | {"{:": ""}
_CLOSE = {v[2]: k for k, v in _F.items() if k in PAIRS.values()} | {":}": ""}
_TOKEN = re.compile("|".join(sorted(map(re.escape, {*_ASCII, *_ACC, *_OPEN, *_CLOSE, "sqrt", "root", "text", "quad"}), key=len, reverse=True)) + r"|\d+|\S")


def from_asciimath(text: str) -> str:
    toks, at = _TOKEN.findall(text), 0

    def peek():
        return toks[at] if at < len(toks) else ""

    def take():
        nonlocal at
        at += 1
        return toks[at - 1]

    def group(closers) -> list[str]:
        parts = []
        while peek() and peek() not in closers:
            parts.append(expression())
        return parts

    def bracketed() -> tuple[str, str, list[str]]:
        """(open, close, parts separated by commas) from an opening bracket."""
        o = take()
        parts, cells = [], []
        while peek() and peek() not in _CLOSE and not (o == "|" and peek() == "|"):
            if peek() == "," and o in _OPEN and matrix[-1]:
                take()
                cells.append(row(parts))
                parts = []
                continue
            parts.append(expression())
        c = take() if peek() else ""
        return _OPEN[o], _CLOSE.get(c, PAIRS.get(_OPEN[o], "")), [*cells, row(parts)]

    matrix = [False]

    def is_matrix() -> bool:
        """Whether the bracket at hand holds bracketed rows parted by commas."""
        depth, k, rows = 0, at, 0
        while k < len(toks):
            if toks[k] in _OPEN and toks[k] != "|":
                depth += 1
                rows += depth == 2
            elif toks[k] in _CLOSE and toks[k] != "|":
                depth -= 1
                if depth == 0:
                    break
            elif depth == 1 and toks[k] != ",":
                return False
            k += 1
        return rows >= 2

    def unit() -> str:
        t = peek()
        if t == "sqrt" or t in _ACC and t not in ("~",):
            take()
            _, _, x = bracketed()
            return f"(Radical {x[0]})" if t == "sqrt" else f"(Accent {normalise_text(_ACC[t])} {x[0]})"
        if t == "root":
            take()
            _, _, index = bracketed()
            _, _, body = bracketed()
            return f"(Radical {body[0]} {index[0]})"
        if t in _OPEN:
            if t != "|" and is_matrix():
                o = take()
                rows = []
                while peek() and peek() not in _CLOSE:
                    if peek() == ",":
                        take()
                        continue
                    matrix.append(True)
                    _, _, cells = bracketed()
                    matrix.pop()
                    rows.append("(MatrixRow " + " ".join(f"(MatrixCell {c})" for c in cells) + ")")
                c = take()
                table = f"(Matrix {' '.join(rows)})"
                return f"(Delimited {_OPEN[o]} {_CLOSE[c]} {table})" if _OPEN[o] or _CLOSE[c] else table
            o, c, parts = bracketed()
            return "\0" + parts[0] if not o and not c else f"(Delimited {o} {c} {parts[0]})"
        take()
        return leaf(_ASCII.get(t, t))

    def bare(x: str) -> str:
        """Brackets that only group are not on the page."""
        if x.startswith("\0"):
            return x[1:]
        m = re.match(r"\(Delimited \( \) (.*)\)$", x)
        return m[1] if m else x

    def expression() -> str:
        base = unit()
        low = high = None
        while peek() in ("_", "^"):
            mark = take()
            x = bare(unit())
            low, high = (x, high) if mark == "_" else (low, x)
        if low or high:
            b = base.lstrip("\0")
            op = b in [leaf(c) for c in "∑∏∐⋃⋂"]
            kids = " ".join(x for x in (b, low, high) if x)
            base = f"(UnderOver {int(bool(low))}{int(bool(high))} {kids})" if op else f"({'SubSup' if low and high else 'Subscript' if low else 'Superscript'} {kids})"
        if peek() == "/":
            take()
            return f"(Fraction {bare(base)} {bare(unit())})"
        return base.lstrip("\0")

    return row(group(()))
