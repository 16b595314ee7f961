"""Formula expressions with known answers: fixed suites, a seeded generator, expected signatures and a shrinker.

Expressions are the tuples of inkfield.core.typeset.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from inkfield.core.tree import Node
from inkfield.core.typeset import ACCENT_SLOT, DELIMS, ENVIRONMENTS, LIMITS, OPERATOR_TEX
from inkfield.core.symbols import ACCENTS, slots


def ident(t: str) -> tuple:
    return ("id", t)


def num(t: str) -> tuple:
    return ("num", t)


def op(t: str) -> tuple:
    return ("op", t)


def seq(*parts: tuple) -> tuple:
    return ("seq", *parts)


_a, _b, _c, _d, _i, _n, _x, _y, _z = map(ident, "abcdinxyz")
_xy = seq(_x, op("+"), _y)
_thin = ("thin",)

# ---------------------------------------------------------------- fixed values: the two hand-written suites
#: The first suite: one expression for each construct.
MILESTONE = [
    _x, _xy, ("sup", _x, num("2")), ("sub", _x, _i), ("subsup", _x, _i, num("2")), ("sup", _x, ("sup", _y, num("2"))), ("frac", _x, _y),
    ("frac", seq(_x, op("+"), num("1")), seq(_y, op("+"), num("1"))), ("frac", ("sup", _x, num("2")), ("sub", _y, _i)), ("frac", ("frac", _a, _b), _c),
    ("sqrt", _x), ("sqrt", _xy), ("sqrt", ("frac", _x, _y)), ("bigop", r"\sum", seq(_i, op("="), num("0")), _n, ("sub", _x, _i)),
    ("bigop", r"\int", num("0"), num("1"), seq(("sup", _x, num("2")), _thin, _d, _x)), ("delim", "paren", ("frac", _x, _y)), ("mat", "pmatrix", ((_a, _b), (_c, _d))),
]
#: The second contains the first.
EXTENDED = [
    *MILESTONE, ident("α"), ident("β"), num("42"), seq(_x, op("−"), _y), seq(_x, op("="), _y), seq(_x, op("≤"), _y), seq(_x, op(","), _y),
    ("sup", _x, ("sub", _y, _i)), ("sub", ("sup", _x, num("2")), _i), ("frac", ("sqrt", _x), ("sqrt", _y)), ("frac", ("sup", _x, num("2")), ("sqrt", seq(_y, op("+"), num("1")))),
    ("sqrt", ("sqrt", _x)), ("sqrt", _x, _n), ("sqrt", _xy, num("3")), ("delim", "bracket", _xy), ("delim", "brace", ("frac", _a, _b)), ("delim", "angle", _x),
    ("delim", "vert", _xy), ("delim", "paren", ("sqrt", ("frac", _x, _y))), ("delim", "paren", _x, False), ("bigop", r"\sum", _i, None, ("sub", _x, _i)),
    ("bigop", r"\prod", seq(_i, op("="), num("1")), _n, ("sub", _x, _i)), ("bigop", r"\int", None, None, seq(ident("f"), ("delim", "paren", _x, False))),
    ("bigop", r"\int", num("0"), ident("∞"), ("sup", ident("e"), _x)), ("bigop", r"\bigcup", seq(_i, op("="), num("1")), _n, ("sub", ident("A"), _i)),
    *[("acc", k, _x) for k in (r"\hat", r"\bar", r"\vec", r"\dot", r"\ddot", r"\tilde")], ("over", _xy), ("mat", "bmatrix", ((_a, _b), (_c, _d))),
    ("mat", "pmatrix", ((_a, _b, _c), (_d, _x, _y))), ("mat", "pmatrix", ((("sup", _a, num("2")), _b), (_c, ("frac", _x, _y)))), ("mat", "pmatrix", ((_a,), (_b,))),
    seq(ident("f"), ("delim", "paren", _x, False)), ("frac", ("frac", ("frac", _a, _b), _c), _d), ("sup", _x, ("frac", _a, _b)), ("sub", ("frac", _a, _b), _i),
    seq(("sqrt", _x), op("+"), ("frac", _y, _z), op("="), ("sup", _z, num("2"))),
]
# ----------------------------------------------------------------

CONSTRUCT = {"id": "identifier", "num": "number", "op": "operator", "seq": "row", "frac": "fraction", "sup": "script", "sub": "script", "subsup": "script", "sqrt": "radical", "delim": "delimiter", "bigop": "largeop", "acc": "accent", "over": "accent", "mat": "matrix", "thin": "space"}


def children(e: tuple) -> list[tuple]:
    k = e[0]
    if k in ("id", "num", "op", "thin"):
        return []
    if k == "mat":
        return [c for r in e[2] for c in r]
    return [x for x in e[1:] if isinstance(x, tuple)]


def walk(e: tuple) -> Iterator[tuple]:
    yield e
    for c in children(e):
        yield from walk(c)


def size(e: tuple) -> int:
    return sum(1 for _ in walk(e))


def constructs(e: tuple) -> list[str]:
    return sorted({CONSTRUCT[x[0]] for x in walk(e)})


def expected(e: tuple, display: bool = True) -> str:
    """The signature that the page of an expression should be read as."""

    def row(parts: list[str]) -> str:
        flat = [p for p in parts if p]
        return flat[0] if len(flat) == 1 else f"(Row {' '.join(flat)})"

    def inner(x: tuple, disp: bool) -> list[str]:
        """The parts of a row, rows within rows dissolved: nothing on the page tells them apart."""
        if x[0] == "seq":
            return [p for y in x[1:] for p in inner(y, disp)]
        if x[0] == "bigop" and x[4] is not None:
            return [sig((*x[:4], None), disp), *inner(x[4], disp)]
        return [sig(x, disp)]

    def sig(x: tuple, disp: bool) -> str:
        k = x[0]
        if k in ("id", "num", "op"):
            return f"({ {'id': 'Identifier', 'num': 'Number', 'op': 'Operator'}[k]} {x[1]})"
        if k == "thin":
            return ""
        if k == "seq" or k == "bigop" and x[4] is not None:
            return row(inner(x, disp))
        if k == "frac":
            return f"(Fraction {sig(x[1], False)} {sig(x[2], False)})"
        if k in ("sup", "sub", "subsup"):
            name = {"sup": "Superscript", "sub": "Subscript", "subsup": "SubSup"}[k]
            return f"({name} {sig(x[1], disp)} {' '.join(sig(y, False) for y in x[2:])})"
        if k == "sqrt":
            return f"(Radical {sig(x[1], disp)}{' ' + sig(x[2], False) if len(x) > 2 and x[2] else ''})"
        if k == "delim":
            _, _, o, c = DELIMS[x[1]]
            return f"(Delimited {o} {c} {sig(x[2], disp)})"
        if k == "bigop":
            name = OPERATOR_TEX[x[1]]
            o = f"(LargeOperator {slots()['cmex', name + 'text'].text})"
            parts = [sig(y, False) for y in x[2:4] if y is not None]
            if not parts:
                return o
            if disp and name in LIMITS:
                return f"(UnderOver {int(x[2] is not None)}{int(x[3] is not None)} {o} {' '.join(parts)})"
            return f"({'SubSup' if len(parts) == 2 else 'Subscript' if x[2] is not None else 'Superscript'} {o} {' '.join(parts)})"
        if k == "acc":
            return f"(Accent {ACCENTS[ACCENT_SLOT[x[1]]]} {sig(x[2], disp)})"
        if k == "over":
            return f"(Overline {sig(x[1], disp)})"
        table = "(Matrix " + " ".join("(MatrixRow " + " ".join(f"(MatrixCell {sig(c, False)})" for c in r) + ")" for r in x[2]) + ")"
        fence = ENVIRONMENTS[x[1]]
        return f"(Delimited {DELIMS[fence][2]} {DELIMS[fence][3]} {table})" if fence else table

    return sig(e, display)


def from_tree(n: Node) -> tuple:
    """An expression that sets a tree again; raises ValueError where the grammar has none."""
    k, x = n.kind, n.kids
    if k in ("Identifier", "Number", "Operator"):
        if k == "Identifier" and len(n.text) > 1 or n.text == "…":
            raise ValueError(f"no expression for {n.text}")
        return ({"Identifier": "id", "Number": "num", "Operator": "op"}[k], n.text)
    if k in ("Row", "MatrixCell"):
        parts = []
        for c in x:
            if c.kind == "Space":
                if abs(c.width_em - 3 / 18) > 0.02:
                    raise ValueError("only thin spaces are set")
                parts.append(_thin)
            else:
                parts.append(from_tree(c))
        return parts[0] if len(parts) == 1 else ("seq", *parts)
    if k == "LargeOperator":
        return ("bigop", _tex(n), None, None, None)
    if k in ("UnderOver", "SubSup", "Subscript", "Superscript") and x[0].kind == "LargeOperator":
        parts = [from_tree(c) for c in x[1:]]
        lower = parts.pop(0) if n.has_under or k in ("SubSup", "Subscript") else None
        return ("bigop", _tex(x[0]), lower, parts[0] if parts else None, None)
    if k in ("Fraction", "Superscript", "Subscript", "SubSup", "Radical"):
        return ({"Fraction": "frac", "Superscript": "sup", "Subscript": "sub", "SubSup": "subsup", "Radical": "sqrt"}[k], *map(from_tree, x))
    if k == "Overline":
        return ("over", from_tree(x[0]))
    if k == "Accent":
        return ("acc", next(t for t, s in ACCENT_SLOT.items() if ACCENTS[s] == n.accent), from_tree(x[0]))
    if k == "Delimited":
        kind = next((d for d, (_, _, o, c) in DELIMS.items() if (o, c) == (n.open, n.close)), None)
        if kind is None:
            raise ValueError(f"no fences {n.open}{n.close}")
        if x[0].kind == "Matrix":
            return ("mat", next(e for e, f in ENVIRONMENTS.items() if f == kind), from_tree(x[0])[2])
        return ("delim", kind, from_tree(x[0]), n.stretchy)
    if k == "Matrix":
        return ("mat", "matrix", tuple(tuple(from_tree(c) for c in r.kids) for r in x))
    raise ValueError(f"no expression for {k}")


def _tex(n: Node) -> str:
    return next(t for t, name in OPERATOR_TEX.items() if slots()["cmex", name + "text"].text == n.text)


# ---------------------------------------------------------------- random expressions


def random_expression(rng: random.Random, depth: int = 3) -> tuple:
    """Of letters and structures, structures rarer with depth; what the page cannot tell apart is left out."""

    def letter() -> tuple:
        return ident(rng.choice("abcdexyzuvwknmpq"))

    def atom() -> tuple:
        return letter() if rng.random() < 0.7 else num(str(rng.randint(0, 9)))

    def go(d: int, script: bool) -> tuple:
        if d <= 0 or rng.random() > 0.55 ** (depth - d):
            return atom()
        kind = rng.choices(("seq", "frac", "sup", "sub", "subsup", "sqrt", "delim", "bigop", "acc", "over"), (6, 4, 4, 3, 2, 3, 2, 0 if script else 2, 1, 1))[0]
        if kind == "seq":
            parts = [go(d - 1, script)]
            for _ in range(rng.randint(1, 2)):
                parts += [op(rng.choice("+−=" if not script else "+−")), go(d - 1, script)]
            return seq(*[y for p in parts for y in (p[1:] if p[0] == "seq" else [p])])
        if kind == "frac":
            return ("frac", go(d - 1, script), go(d - 1, script))
        if kind in ("sup", "sub"):
            return (kind, letter(), go(d - 2, True))
        if kind == "subsup":
            return ("subsup", letter(), go(d - 2, True), go(d - 2, True))
        if kind == "sqrt":
            return ("sqrt", go(d - 1, script))
        if kind == "delim":
            return ("delim", rng.choice(("paren", "bracket", "brace")), go(d - 1, script))
        if kind == "bigop":
            return ("bigop", rng.choice((r"\sum", r"\prod", r"\int")), seq(ident("i"), op("="), num("1")), ident("n"), letter())
        if kind == "acc":
            return ("acc", rng.choice((r"\hat", r"\bar", r"\tilde")), letter())
        return ("over", seq(letter(), op("+"), letter()))

    return go(depth, False)


#: What the wide suite draws from.
GREEK, BINARIES, RELATIONS, MARKS = "αβγδθλμπρστψω", "+−×·±", "=≤≥<>∈⊂→≈", ",;"


def wide_expression(rng: random.Random, depth: int = 3) -> tuple:
    """Of everything the typesetter sets: Greek letters, operators of all classes, punctuation, thin spaces, indices of
    roots, limits of every shape, all fences, accents, grids, and structures as bases of scripts. What one page cannot tell
    apart is left out: rows as bases, two numbers in a row, grids of one row."""

    def leaf() -> tuple:
        r = rng.random()
        return num(str(rng.randint(0, 99))) if r < 0.25 else ident(rng.choice(GREEK if r < 0.4 else "abcdefghkmnpqrstuvwxyzABCDFGKLMNPQRSTXYZ"))

    def row(d: int) -> tuple:
        parts = [go(d - 1)]
        for _ in range(rng.randint(1, 3)):
            r = rng.random()
            if r < 0.9:
                parts.append(op(rng.choice(BINARIES if r < 0.45 else RELATIONS if r < 0.78 else MARKS)))
            elif r < 0.95:
                parts.append(_thin)
            x = go(d - 1)
            parts.append(x if x[0] != "num" or parts[-1][0] != "num" else ident("x"))
        return seq(*[y for p in parts for y in (p[1:] if p[0] == "seq" else [p])])

    def base(d: int) -> tuple:
        x = go(d - 1)
        return x if x[0] not in ("seq", "bigop", "sup", "sub", "subsup") else leaf()

    def limits(d: int) -> tuple:
        lower = go(d - 2) if rng.random() < 0.8 else None
        upper = go(d - 2) if rng.random() < 0.6 else None
        return ("bigop", rng.choice(sorted(OPERATOR_TEX)), lower, upper, go(d - 1) if rng.random() < 0.8 else None)

    def grid(d: int) -> tuple:
        n, m = rng.randint(2, 3), rng.randint(1, 3)
        return ("mat", rng.choice(sorted(ENVIRONMENTS)), tuple(tuple(go(d - 2) for _ in range(m)) for _ in range(n)))

    makes = {
        "row": (30, row), "frac": (12, lambda d: ("frac", go(d - 1), go(d - 1))), "sup": (10, lambda d: ("sup", base(d), go(d - 1))), "sub": (9, lambda d: ("sub", base(d), go(d - 1))),
        "subsup": (5, lambda d: ("subsup", base(d), go(d - 1), go(d - 1))), "sqrt": (6, lambda d: ("sqrt", go(d - 1), *([leaf()] if rng.random() < 0.25 else []))),
        "delim": (7, lambda d: ("delim", rng.choice(sorted(DELIMS)), go(d - 1), rng.random() < 0.75)), "bigop": (6, limits), "acc": (4, lambda d: ("acc", rng.choice(sorted(ACCENT_SLOT)), leaf())),
        "over": (2, lambda d: ("over", go(d - 1))), "grid": (4, grid),
    }

    def go(d: int) -> tuple:
        if d <= 0 or rng.random() < 0.3 + 0.2 * (depth - d):
            return leaf()
        return rng.choices([m for _, m in makes.values()], [w for w, _ in makes.values()])[0](d)

    return go(depth)


def random_suite(seed: int, n: int, depth: int = 3, wide: bool = False) -> list[tuple]:
    rng = random.Random(seed)
    return [(wide_expression if wide else random_expression)(rng, depth) for _ in range(n)]


# ---------------------------------------------------------------- shrinking


def simpler(e: tuple) -> Iterator[tuple]:
    """Smaller expressions: any part instead of the whole, and each part made simpler in place."""
    yield from children(e)
    if e[0] in ("id", "num", "op", "thin"):
        return
    for k, x in enumerate(e):
        if isinstance(x, tuple) and e[0] != "mat":
            for y in (*simpler(x), ident("x")):
                if size(y) < size(x):
                    yield (*e[:k], y, *e[k + 1 :])
            if e[0] == "seq" and len(e) > 4:
                yield (*e[:k], *e[k + 2 :])


def shrink(e: tuple, fails: Callable[[tuple], bool], rounds: int = 40, width: int = 48) -> tuple:
    """The smallest failing expression that greedy steps find; each round tries at most `width` candidates."""
    for _ in range(rounds):
        tried = sorted({repr(c): c for c in simpler(e)}.values(), key=lambda c: (size(c), len(repr(c))))[:width]
        best = next((c for c in tried if fails(c)), None)
        if best is None:
            return e
        e = best
    return e
