"""Layout trees as Presentation MathML, LaTeX, AsciiMath, Office MathML, WordPerfect equations and label graphs.

A writer never invents: what a format cannot say is reported beside the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from inkfield.core.encodings import LATEX
from inkfield.core.symbols import family
from inkfield.core.tree import Node


@dataclass
class Written:
    text: str
    unreproducible: list[str] = field(default_factory=list)
    unverified: list[str] = field(default_factory=list)


# ---------------------------------------------------------------- fixed values: spellings
#: Character: LaTeX, AsciiMath (- where it is spelt as itself), WordPerfect.
SPELLINGS = (
    "α \\alpha alpha alpha, β \\beta beta beta, γ \\gamma gamma gamma, δ \\delta delta delta, ϵ \\epsilon epsilon epsilon, ε \\varepsilon varepsilon varepsilon, "
    "ζ \\zeta zeta zeta, η \\eta eta eta, θ \\theta theta theta, ι \\iota iota iota, κ \\kappa kappa kappa, λ \\lambda lambda lambda, μ \\mu mu mu, ν \\nu nu nu, "
    "ξ \\xi xi xi, π \\pi pi pi, ρ \\rho rho rho, σ \\sigma sigma sigma, τ \\tau tau tau, υ \\upsilon upsilon upsilon, ϕ \\phi phi phi, χ \\chi chi chi, "
    "ψ \\psi psi psi, ω \\omega omega omega, Γ \\Gamma Gamma GAMMA, Δ \\Delta Delta DELTA, Ω \\Omega Omega OMEGA, ∂ \\partial del partial, ℓ \\ell ell ell, "
    "∞ \\infty oo inf, ∇ \\nabla grad grad, ≤ \\le <= <=, ≥ \\ge >= >=, ≠ \\ne != !=, ≈ \\approx ~~ approx, ∼ \\sim ~ sim, ∈ \\in in in, ⊂ \\subset sub subset, "
    "∀ \\forall AA forall, ∃ \\exists EE exists, × \\times xx times, · \\cdot * cdot, ∗ \\ast ** ast, ± \\pm +- +-, ∪ \\cup uu union, ∩ \\cap nn inter, "
    "→ \\rightarrow -> rightarrow, ← \\leftarrow larr leftarrow, − - - -, … \\ldots ... dotslow, ∑ \\sum sum sum, ∏ \\prod prod prod, ∫ \\intop int int, "
    "∐ \\coprod coprod coprod, ⋃ \\bigcup uuu union, ⋂ \\bigcap nnn inter, ∮ \\ointop oint oint, ′ \\prime ' prime"
)
#: Accent character: LaTeX, AsciiMath, WordPerfect.
ACCENT_SPELLINGS = "^ \\hat hat hat, ¯ \\bar bar bar, ⃗ \\vec vec vec, ˙ \\dot dot dot, ¨ \\ddot ddot dyad, ~ \\tilde tilde tilde, ˇ \\check check check, ˘ \\breve breve breve, ´ \\acute acute acute, ` \\grave grave grave"
#: Fence: LaTeX, AsciiMath open and close.
FENCE_SPELLINGS = "( ( ( (, ) ) ) ), [ [ [ [, ] ] ] ], { \\{ { {, } \\} } }, ⟨ \\langle (: (:, ⟩ \\rangle :) :), | | | |, ⌊ \\lfloor |__ |__, ⌋ \\rfloor __| __|, ⌈ \\lceil |~ |~, ⌉ \\rceil ~| ~|"
FUNCTIONS = frozenset("sin cos tan sec csc cot log ln exp lim max min sup inf det dim ker gcd arg deg hom mod sinh cosh tanh".split())
# ----------------------------------------------------------------
_S = {i.split(" ")[0]: i.split(" ")[1:] for i in SPELLINGS.split(", ")}
_A = {i.split(" ")[0]: i.split(" ")[1:] for i in ACCENT_SPELLINGS.split(", ")}
_F = {i.split(" ")[0]: i.split(" ")[1:] for i in FENCE_SPELLINGS.split(", ")}
BOX = "□"




# ---------------------------------------------------------------- MathML


def to_mathml(root: Node, display: bool = True, namespace: bool = True, provenance: bool = False) -> str:
    def attrs(n: Node, **more: str) -> str:
        if provenance and n.glyph_ids:
            more |= {"data_glyphs": " ".join(map(str, n.glyph_ids)), "data_confidence": f"{n.confidence:.4f}"}
        return "".join(f" {k.replace('_', '-')}={quoteattr(v)}" for k, v in more.items())

    def group(ns: list[Node]) -> str:
        body = "".join(map(write, ns))
        return body if len(ns) == 1 else f"<mrow>{body}</mrow>"

    def write(n: Node) -> str:
        k = n.kind
        if k == "Identifier":
            default = "italic" if len(n.text) == 1 else "normal"
            more = {} if n.variant in ("", default) else {"mathvariant": n.variant}
            return f"<mi{attrs(n, **more)}>{escape(n.text)}</mi>"
        if k == "Number":
            return f"<mn{attrs(n)}>{escape(n.text)}</mn>"
        if k in ("Operator", "LargeOperator"):
            return f"<mo{attrs(n)}>{escape(n.text)}</mo>"
        if k == "Text":
            return f"<mtext{attrs(n)}>{escape(n.text)}</mtext>"
        if k == "Unknown":
            more = {"class": "unknown"} | ({"title": n.reason} if n.reason else {})
            return f"<mtext{attrs(n, **more)}>{escape(n.text or BOX)}</mtext>"
        if k == "Space":
            return f'<mspace{attrs(n, width=f"{n.width_em:.3f}em")}/>'
        if k == "Row":
            return f"<mrow{attrs(n)}>{''.join(map(write, n.kids))}</mrow>"
        if k == "Fraction":
            more = {"linethickness": "0"} if n.thickness <= 0 else {}
            return f"<mfrac{attrs(n, **more)}>{''.join(map(write, n.kids))}</mfrac>"
        if k == "UnderOver":
            tag = "munderover" if n.has_under and n.has_over else "munder" if n.has_under else "mover"
            return f"<{tag}{attrs(n)}>{''.join(map(write, n.kids))}</{tag}>"
        if k == "Radical":
            tag = "mroot" if len(n.kids) > 1 else "msqrt"
            return f"<{tag}{attrs(n)}>{''.join(map(write, n.kids))}</{tag}>"
        if k == "Delimited":
            more = {"stretchy": "true" if n.stretchy else "false"}
            mo = lambda t: f"<mo{attrs(Node(''), fence='true', **more)}>{escape(t)}</mo>" if t else ""
            return f"<mrow{attrs(n)}>{mo(n.open)}{group(n.kids)}{mo(n.close)}</mrow>"
        if k == "Accent":
            return f'<mover{attrs(n, accent="true")}>{write(n.kids[0])}<mo stretchy="{"true" if n.stretchy else "false"}">{escape(n.accent)}</mo></mover>'
        if k in ("Overline", "Underline"):
            tag, line, name = ("mover", "¯", "accent") if k == "Overline" else ("munder", "_", "accentunder")
            return f'<{tag}{attrs(n, **{name: "true"})}>{write(n.kids[0])}<mo stretchy="true">{line}</mo></{tag}>'
        tag = {"Superscript": "msup", "Subscript": "msub", "SubSup": "msubsup", "Matrix": "mtable", "Lines": "mtable", "MatrixRow": "mtr", "MatrixCell": "mtd"}[k]
        if k == "Lines":
            return f"<mtable{attrs(n)}>{''.join(f'<mtr><mtd>{write(x)}</mtd></mtr>' for x in n.kids)}</mtable>"
        return f"<{tag}{attrs(n)}>{''.join(map(write, n.kids))}</{tag}>"

    space = ' xmlns="http://www.w3.org/1998/Math/MathML"' if namespace else ""
    return f'<math{space} display="{"block" if display else "inline"}">{write(root)}</math>'


# ---------------------------------------------------------------- LaTeX


def to_latex(root: Node) -> Written:
    lost: list[str] = []

    def leaf(n: Node) -> str:
        t = n.text
        if n.kind == "Unknown":
            lost.append(n.reason or "unknown glyph")
            return r"\square" if not t else rf"\text{{{t}}}"
        if n.kind == "Text":
            return rf"\text{{{t}}}"
        fam = family(n.font) if n.font else ""
        if fam == "msbm" and len(t) == 1:
            return rf"\mathbb{{{t}}}"
        if n.variant == "script":
            return rf"\mathcal{{{t}}}"
        if n.kind == "LargeOperator" or t in _S:
            return _S[t][0] if t in _S else LATEX.get(t, t)
        if n.kind == "Identifier" and n.variant == "normal" and t.isalpha():
            return rf"\{t}" if t in FUNCTIONS else rf"\mathrm{{{t}}}"
        if n.variant == "bold":
            return rf"\mathbf{{{t}}}"
        return _F[t][0] if t in _F else LATEX.get(t, t)

    def base(n: Node) -> str:
        s = write(n)
        if n.kind in ("Identifier", "Number", "Operator", "Delimited", "Radical", "Accent", "LargeOperator"):
            return s if len(n.text) <= 1 or n.kind == "Number" and len(n.text) == 1 or s.startswith("\\") else f"{{{s}}}"
        return f"{{{{}}{s}}}" if n.kind in ("Superscript", "Subscript", "SubSup") else f"{{{s}}}"

    def write(n: Node) -> str:
        k = n.kind
        if k in ("Identifier", "Number", "Operator", "LargeOperator", "Unknown", "Text"):
            return leaf(n)
        if k == "Space":
            return rf"\mskip {n.width_em * 18:.3f}mu"
        if k == "Row":
            return " ".join(map(write, n.kids))
        if k == "Fraction":
            a, b = map(write, n.kids)
            return rf"\frac{{{a}}}{{{b}}}" if n.thickness > 0 else rf"\genfrac{{}}{{}}{{0pt}}{{}}{{{a}}}{{{b}}}"
        if k in ("Superscript", "Subscript", "SubSup"):
            head = base(n.kids[0]) + (r"\nolimits" if n.kids[0].kind == "LargeOperator" else "")
            marks = {"Superscript": "^", "Subscript": "_", "SubSup": "_^"}[k]
            return head + "".join(f"{m}{{{write(x)}}}" for m, x in zip(marks, n.kids[1:]))
        if k == "UnderOver":
            marks = "_" * n.has_under + "^" * n.has_over
            if n.kids[0].kind == "LargeOperator":
                return leaf(n.kids[0]) + r"\limits" + "".join(f"{m}{{{write(x)}}}" for m, x in zip(marks, n.kids[1:]))
            return rf"\mathop{{{write(n.kids[0])}}}\limits" + "".join(f"{m}{{{write(x)}}}" for m, x in zip(marks, n.kids[1:]))
        if k == "Radical":
            return rf"\sqrt{{{write(n.kids[0])}}}" if len(n.kids) == 1 else rf"\sqrt[{write(n.kids[1])}]{{{write(n.kids[0])}}}"
        if k == "Delimited":
            o, c = (_F[x][0] if x in _F else "." if not x else LATEX.get(x, x) for x in (n.open, n.close))
            body = write(n.kids[0]) if n.kids else ""
            return rf"\left{o} {body} \right{c}" if n.stretchy or "." in (o, c) else f"{o} {body} {c}"
        if k == "Accent":
            if n.accent not in _A:
                lost.append(f"accent {n.accent}")
                return write(n.kids[0])
            return f"{_A[n.accent][0]}{{{write(n.kids[0])}}}"
        if k in ("Overline", "Underline"):
            return rf"\{k.lower()}{{{write(n.kids[0])}}}"
        if k in ("Matrix", "Lines"):
            return r"\begin{matrix} " + r" \\ ".join(map(write, n.kids)) + r" \end{matrix}"
        if k == "MatrixRow":
            return " & ".join(map(write, n.kids))
        if k == "MatrixCell":
            return " ".join(map(write, n.kids))
        raise ValueError(k)

    return Written(write(root), lost)


# ---------------------------------------------------------------- AsciiMath


def to_asciimath(root: Node) -> Written:
    lost: list[str] = []

    def leaf(n: Node) -> str:
        t = n.text
        if n.kind == "Unknown":
            lost.append(n.reason or "unknown glyph")
            return t or BOX
        if n.kind == "Text":
            return f"text({t})"
        if n.kind == "Identifier" and len(t) > 1 and t.isalpha() and t not in _S:
            return t if t in FUNCTIONS else f"text({t})"
        return _S[t][1] if t in _S else t

    def single(s: str) -> bool:
        return len(s) == 1 or s.isalpha() and s.isascii() or s.isdigit()

    def script(n: Node) -> str:
        s = write(n)
        return s if single(s) else f"({s})"

    def base(n: Node) -> str:
        s = write(n)
        return s if n.kind in ("Identifier", "Number", "Operator", "LargeOperator", "Delimited", "Radical", "Accent", "Overline") else f"{{:{s}:}}"

    def rows(m: Node) -> list[str]:
        return ["(" + ",".join(write(c) for c in r.kids) + ")" if r.kind == "MatrixRow" else f"({write(r)})" for r in m.kids]

    def write(n: Node) -> str:
        k = n.kind
        if k in ("Identifier", "Number", "Operator", "LargeOperator", "Unknown", "Text"):
            return leaf(n)
        if k == "Space":
            return "quad" if n.width_em >= 0.5 else ""
        if k == "Row":
            s = " ".join(x for x in map(write, n.kids) if x)
            return re.sub(r" +([,;.!])", r"\1", s)
        if k == "Fraction":
            a, b = map(write, n.kids)
            return f"({a})/({b})" if n.thickness > 0 else f"(({a}),({b}))"
        if k in ("Superscript", "Subscript", "SubSup"):
            marks = {"Superscript": "^", "Subscript": "_", "SubSup": "_^"}[k]
            return base(n.kids[0]) + "".join(m + script(x) for m, x in zip(marks, n.kids[1:]))
        if k == "UnderOver":
            marks = "_" * n.has_under + "^" * n.has_over
            return base(n.kids[0]) + "".join(m + script(x) for m, x in zip(marks, n.kids[1:]))
        if k == "Radical":
            return f"sqrt({write(n.kids[0])})" if len(n.kids) == 1 else f"root({write(n.kids[1])})({write(n.kids[0])})"
        if k == "Delimited":
            o = _F[n.open][1] if n.open in _F else "{:" if not n.open else n.open
            c = _F[n.close][2] if n.close in _F else ":}" if not n.close else n.close
            inner = n.kids[0] if n.kids else Node("Row")
            if inner.kind in ("Matrix", "Lines"):
                return o + ",".join(rows(inner)) + c
            return o + write(inner) + c
        if k == "Accent":
            if n.accent not in _A:
                lost.append(f"accent {n.accent}")
                return write(n.kids[0])
            return f"{_A[n.accent][1]}({write(n.kids[0])})"
        if k in ("Overline", "Underline"):
            return f"{'bar' if k == 'Overline' else 'ul'}({write(n.kids[0])})"
        if k in ("Matrix", "Lines"):
            return "{:" + ",".join(rows(n)) + ":}"
        if k in ("MatrixCell", "MatrixRow"):
            return " ".join(map(write, n.kids))
        raise ValueError(k)

    return Written(write(root), lost)


# ---------------------------------------------------------------- Office MathML


def to_omml(root: Node, display: bool = True, namespace: bool = True) -> Written:
    lost: list[str] = []

    def run(t: str, n: Node) -> str:
        plain = n.kind in ("Number", "Text", "Unknown") or n.variant == "normal" and n.kind == "Identifier"
        script = n.variant if n.variant in ("double-struck", "script", "fraktur", "sans-serif", "monospace") else ""
        pr = f'<m:rPr><m:scr m:val="{script}"/></m:rPr>' if script else '<m:rPr><m:sty m:val="p"/></m:rPr>' if plain and n.kind == "Identifier" else '<m:rPr><m:nor/></m:rPr>' if n.kind in ("Text", "Unknown") else ""
        return f'<m:r>{pr}<m:t xml:space="preserve">{escape(t)}</m:t></m:r>'

    def e(tag: str, *ns: Node) -> str:
        return f"<m:{tag}>{''.join(map(write, ns))}</m:{tag}>"

    def write(n: Node) -> str:
        k, x = n.kind, n.kids
        if k in ("Identifier", "Number", "Operator", "Text"):
            return run(n.text, n)
        if k == "Unknown":
            lost.append(n.reason or "unknown glyph")
            return run(n.text or BOX, n)
        if k == "LargeOperator":
            return f'<m:nary><m:naryPr><m:chr m:val={quoteattr(n.text)}/><m:subHide m:val="1"/><m:supHide m:val="1"/></m:naryPr><m:sub/><m:sup/><m:e/></m:nary>'
        if k == "Space":
            return run(" " if n.width_em < 0.5 else " ", Node("Text"))
        if k in ("Row", "MatrixCell"):
            return "".join(map(write, x))
        if k == "Fraction":
            pr = f'<m:fPr><m:type m:val="{"bar" if n.thickness > 0 else "noBar"}"/></m:fPr>'
            return f"<m:f>{pr}{e('num', x[0])}{e('den', x[1])}</m:f>"
        if k in ("Superscript", "Subscript", "SubSup", "UnderOver") and x[0].kind == "LargeOperator":
            under = k in ("Subscript", "SubSup") or n.has_under
            over = k in ("Superscript", "SubSup") or n.has_over
            parts = x[1:]
            sub = parts.pop(0) if under else None
            sup = parts.pop(0) if over and parts else None
            loc = "undOvr" if k == "UnderOver" else "subSup"
            hide = f'<m:subHide m:val="{0 if sub else 1}"/><m:supHide m:val="{0 if sup else 1}"/>'
            return f'<m:nary><m:naryPr><m:chr m:val={quoteattr(x[0].text)}/><m:limLoc m:val="{loc}"/>{hide}</m:naryPr>{e("sub", *([sub] if sub else []))}{e("sup", *([sup] if sup else []))}<m:e/></m:nary>'
        if k == "Superscript":
            return f"<m:sSup>{e('e', x[0])}{e('sup', x[1])}</m:sSup>"
        if k == "Subscript":
            return f"<m:sSub>{e('e', x[0])}{e('sub', x[1])}</m:sSub>"
        if k == "SubSup":
            return f"<m:sSubSup>{e('e', x[0])}{e('sub', x[1])}{e('sup', x[2])}</m:sSubSup>"
        if k == "UnderOver":
            inner = write(x[0])
            if n.has_under:
                inner = f"<m:limLow><m:e>{inner}</m:e>{e('lim', x[1])}</m:limLow>"
            return f"<m:limUpp><m:e>{inner}</m:e>{e('lim', x[-1])}</m:limUpp>" if n.has_over else inner
        if k == "Radical":
            return f'<m:rad><m:radPr><m:degHide m:val="{0 if len(x) > 1 else 1}"/></m:radPr>{e("deg", *x[1:])}{e("e", x[0])}</m:rad>'
        if k == "Delimited":
            return f"<m:d><m:dPr><m:begChr m:val={quoteattr(n.open)}/><m:endChr m:val={quoteattr(n.close)}/></m:dPr>{e('e', *x)}</m:d>"
        if k == "Accent":
            return f"<m:acc><m:accPr><m:chr m:val={quoteattr(n.accent)}/></m:accPr>{e('e', x[0])}</m:acc>"
        if k in ("Overline", "Underline"):
            return f'<m:bar><m:barPr><m:pos m:val="{"top" if k == "Overline" else "bot"}"/></m:barPr>{e("e", x[0])}</m:bar>'
        if k == "Matrix":
            columns = max((len(r.kids) for r in x), default=1)
            pr = f'<m:mPr><m:mcs><m:mc><m:mcPr><m:count m:val="{columns}"/><m:mcJc m:val="center"/></m:mcPr></m:mc></m:mcs></m:mPr>'
            return f"<m:m>{pr}{''.join('<m:mr>' + ''.join(e('e', c) for c in r.kids) + '</m:mr>' for r in x)}</m:m>"
        if k == "Lines":
            return f"<m:eqArr>{''.join(e('e', r) for r in x)}</m:eqArr>"
        raise ValueError(k)

    ns = ' xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"' if namespace else ""
    body = f"<m:oMath{'' if display else ns}>{write(root)}</m:oMath>"
    return Written(f"<m:oMathPara{ns}>{body}</m:oMathPara>" if display else body, lost)


# ---------------------------------------------------------------- WordPerfect


def to_wordperfect(root: Node) -> Written:
    lost: list[str] = []
    unsure: list[str] = []

    def leaf(n: Node) -> str:
        if n.kind == "Unknown":
            lost.append(n.reason or "unknown glyph")
            return n.text or BOX
        if n.kind == "Text" or n.kind == "Identifier" and len(n.text) > 1 and n.text not in _S and n.text not in FUNCTIONS:
            return f"func {n.text}"
        return _S[n.text][2] if n.text in _S else n.text

    def braced(n: Node) -> str:
        return f"{{{write(n)}}}"

    def script(n: Node) -> str:
        s = write(n)
        return s if len(s) == 1 or s.isalnum() and s.isascii() else f"{{{s}}}"

    def write(n: Node) -> str:
        k, x = n.kind, n.kids
        if k in ("Identifier", "Number", "Operator", "LargeOperator", "Unknown", "Text"):
            return leaf(n)
        if k == "Space":
            return "~" if n.width_em >= 0.5 else "`"
        if k in ("Row", "MatrixCell"):
            return " ".join(map(write, x))
        if k == "Fraction":
            return f"{braced(x[0])} over {braced(x[1])}" if n.thickness > 0 else f"stack {{{write(x[0])} # {write(x[1])}}}"
        if k in ("Superscript", "Subscript", "SubSup"):
            names = {"Superscript": ("sup",), "Subscript": ("sub",), "SubSup": ("sub", "sup")}[k]
            head = write(x[0]) if x[0].kind in ("Identifier", "Number", "LargeOperator") else braced(x[0])
            return head + "".join(f" {m} {script(s)}" for m, s in zip(names, x[1:]))
        if k == "UnderOver":
            names = ("from",) * n.has_under + ("to",) * n.has_over
            return write(x[0]) + "".join(f" {m} {script(s)}" for m, s in zip(names, x[1:]))
        if k == "Radical":
            return f"sqrt {braced(x[0])}" if len(x) == 1 else f"nroot {braced(x[1])} {braced(x[0])}"
        if k == "Delimited":
            body = " ".join(map(write, x))
            names = {"⟨": "LANGLE", "⟩": "RANGLE", "{": "LBRACE", "}": "RBRACE", "|": "LINE", "⌊": "LFLOOR", "⌋": "RFLOOR", "⌈": "LCEIL", "⌉": "RCEIL"}
            o, c = (names.get(f, f) or "." for f in (n.open, n.close))
            return f"left {o} {body} right {c}" if n.stretchy or "." in (o, c) else f"{o} {body} {c}"
        if k == "Accent":
            if n.accent not in _A:
                lost.append(f"accent {n.accent}")
                return write(x[0])
            unsure.append(_A[n.accent][2])
            return f"{_A[n.accent][2]} {braced(x[0])}"
        if k in ("Overline", "Underline"):
            return f"{k.lower()} {braced(x[0])}"
        if k == "Matrix":
            return "matrix {" + " # ".join(map(write, x)) + "}"
        if k == "MatrixRow":
            return " & ".join(map(write, x))
        if k == "Lines":
            return "stack {" + " # ".join(map(write, x)) + "}"
        raise ValueError(k)

    return Written(write(root), lost, unsure)


# ---------------------------------------------------------------- label graphs


def label_graph(root: Node) -> tuple[list[tuple[str, str, tuple[int, ...]]], list[tuple[str, str, str]]]:
    """(objects: id, label, glyph or rule ids; relations: parent id, child id, label). Spaces are not objects."""
    objects: list[tuple[str, str, tuple[int, ...]]] = []
    relations: list[tuple[str, str, str]] = []

    def new(label: str, ids: tuple[int, ...] = ()) -> str:
        objects.append((f"s{len(objects)}", label, ids))
        return objects[-1][0]

    def link(a: str | None, b: str | None, label: str) -> None:
        if a and b:
            relations.append((a, b, label))

    def emit(n: Node) -> tuple[str | None, str | None]:
        """First and last object of the node's main line."""
        k, x = n.kind, n.kids
        if k == "Space":
            return None, None
        if k in ("Identifier", "Number", "Operator", "LargeOperator", "Unknown", "Text"):
            s = new(n.text or "unknown", n.glyph_ids)
            return s, s
        if k in ("Superscript", "Subscript", "SubSup", "UnderOver"):
            first, last = emit(x[0])
            names = {"Superscript": ("Sup",), "Subscript": ("Sub",), "SubSup": ("Sub", "Sup")}.get(k, ("Below",) * n.has_under + ("Above",) * n.has_over)
            for m, s in zip(names, x[1:]):
                link(last, emit(s)[0], m)
            return first, last
        if k == "Fraction":
            bar = new("-", n.rule_ids)
            link(bar, emit(x[0])[0], "Above")
            link(bar, emit(x[1])[0], "Below")
            return bar, bar
        if k == "Radical":
            s = new("sqrt", n.rule_ids)
            link(s, emit(x[0])[0], "Inside")
            if len(x) > 1:
                link(s, emit(x[1])[0], "PreAbove")
            return s, s
        if k in ("Accent", "Overline", "Underline"):
            first, last = emit(x[0])
            link(first, new(n.accent or "-", n.rule_ids), "Below" if k == "Underline" else "Above")
            return first, last
        if k == "Delimited":
            ends = [new(t) if t else None for t in (n.open, n.close)]
            inner = [emit(c) for c in x]
            return chain([(ends[0], ends[0]), *inner, (ends[1], ends[1])])
        if k in ("Matrix", "Lines"):
            heads = [emit(r) for r in x]
            for a, b in zip(heads, heads[1:]):
                link(a[0], b[0], "Below")
            return heads[0][0], heads[0][1]
        return chain([emit(c) for c in x])

    def chain(parts: list[tuple[str | None, str | None]]) -> tuple[str | None, str | None]:
        real = [p for p in parts if p[0]]
        for a, b in zip(real, real[1:]):
            link(a[1], b[0], "Right")
        return (real[0][0], real[-1][1]) if real else (None, None)

    emit(root)
    return objects, relations


def to_label_graph(root: Node) -> str:
    objects, relations = label_graph(root)
    lines = [f"O, {i}, {t}, 1.0, {', '.join(map(str, ids)) or i}" for i, t, ids in objects]
    return "\n".join(lines + [f"R, {a}, {b}, {m}, 1.0" for a, b, m in relations]) + "\n"


def speech_mathml(root: Node) -> str:
    """MathML for a speech engine: no spaces, no boxes, single upright letters without a mark."""

    def prepared(n: Node) -> Node:
        kids = [prepared(k) for k in n.kids if k.kind != "Space"]
        more = dict(n.__dict__, kids=kids)
        if n.kind == "Unknown" and not n.text:
            more |= {"kind": "Text", "text": "unrecognised symbol"}
        if n.kind == "Identifier" and n.variant == "normal" and len(n.text) == 1:
            more |= {"variant": ""}
        return Node(**more)

    return to_mathml(prepared(root))
