"""What is drawn by which slot of a font: names, characters, atom classes and Computer Modern widths."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from inkfield.core.encodings import ENCODINGS, EXTRA_SYMBOLS, FAMILIES, LARGE_OPERATORS, LM_LONG, SYMBOLS

# ---------------------------------------------------------------- fixed values: font slots and metrics
#: font family: slot name, code, Unicode, atom class. Letters and digits follow by rule below.
SLOTS = {
    "cmmi": (
        "alpha 11 α Ord, beta 12 β Ord, gamma 13 γ Ord, delta 14 δ Ord, epsilon1 15 ϵ Ord, zeta 16 ζ Ord, eta 17 η Ord, theta 18 θ Ord, "
        "iota 19 ι Ord, kappa 20 κ Ord, lambda 21 λ Ord, mu 22 μ Ord, nu 23 ν Ord, xi 24 ξ Ord, pi 25 π Ord, rho 26 ρ Ord, sigma 27 σ Ord, "
        "tau 28 τ Ord, upsilon 29 υ Ord, phi 30 ϕ Ord, chi 31 χ Ord, psi 32 ψ Ord, omega 33 ω Ord, epsilon 34 ε Ord, period 58 . Ord, "
        "comma 59 COMMA Punct, less 60 < Rel, slash 61 / Ord, greater 62 > Rel, partialdiff 64 ∂ Ord, lscript 96 ℓ Ord, vector 126 ⃗ Ord"
    ),
    "cmr": (
        "Gamma 0 Γ Ord, Delta 1 Δ Ord, Omega 10 Ω Ord, exclam 33 ! Close, parenleft 40 ( Open, parenright 41 ) Close, plus 43 + Bin, "
        "colon 58 : Rel, semicolon 59 ; Punct, equal 61 = Rel, bracketleft 91 [ Open, dotaccent 95 ˙ Ord, bracketright 93 ] Close, "
        "circumflex 94 ^ Ord, grave 18 ` Ord, acute 19 ´ Ord, caron 20 ˇ Ord, breve 21 ˘ Ord, macron 22 ¯ Ord, tilde 126 ~ Ord, dieresis 127 ¨ Ord"
    ),
    "cmsy": (
        "minus 0 − Bin, periodcentered 1 · Bin, multiply 2 × Bin, asteriskmath 3 ∗ Bin, plusminus 6 ± Bin, lessequal 20 ≤ Rel, greaterequal 21 ≥ Rel, "
        "similar 24 ∼ Rel, approxequal 25 ≈ Rel, arrowleft 32 ← Rel, arrowright 33 → Rel, prime 48 ′ Ord, infinity 49 ∞ Ord, element 50 ∈ Rel, "
        "universal 56 ∀ Ord, existential 57 ∃ Ord, notequal 54 ≠ Rel, union 91 ∪ Bin, intersection 92 ∩ Bin, floorleft 98 ⌊ Open, floorright 99 ⌋ Close, "
        "ceilingleft 100 ⌈ Open, ceilingright 101 ⌉ Close, braceleft 102 { Open, braceright 103 } Close, angbracketleft 104 ⟨ Open, "
        "angbracketright 105 ⟩ Close, bar 106 | Ord, radical 112 √ Ord, nabla 114 ∇ Ord, subset 26 ⊂ Rel"
    ),
}
#: Large operators of the extension font: name, character, code of the text form, of the display form.
OPERATORS = "summation ∑ 80 88, product ∏ 81 89, integral ∫ 82 90, union ⋃ 83 91, intersection ⋂ 84 92, coproduct ∐ 96 97, contintegral ∮ 72 73"
#: Fences of the extension font: base, side, character, codes of the four sizes, codes of the pieces top, middle, bottom, repeated.
FENCES = (
    "paren left ( 0 16 18 32 48 - 64 66, paren right ) 1 17 19 33 49 - 65 67, bracket left [ 2 104 20 34 50 - 52 54, "
    "bracket right ] 3 105 21 35 51 - 53 55, floor left ⌊ 4 106 22 36 - - - -, floor right ⌋ 5 107 23 37 - - - -, ceiling left ⌈ 6 108 24 38 - - - -, "
    "ceiling right ⌉ 7 109 25 39 - - - -, brace left { 8 110 26 40 56 60 58 62, brace right } 9 111 27 41 57 61 59 62, "
    "angbracket left ⟨ 10 68 28 42 - - - -, angbracket right ⟩ 11 69 29 43 - - - -"
)
RADICALS = (112, 113, 114, 115)
#: Names that the surveyed tables give no character: name, character, atom class.
MORE = (
    "germandbls ß Ord, ae æ Ord, oe œ Ord, oslash ø Ord, AE Æ Ord, OE Œ Ord, Oslash Ø Ord, quotedblright ” Ord, quotedblleft “ Ord, asterisk * Ord, exclamdown ¡ Ord, "
    "questiondown ¿ Ord, sterling £ Ord, quotesingle ' Ord, quotedbl \" Ord, asciicircum ^ Ord, asciitilde ~ Ord, underscore _ Ord, visiblespace ␣ Ord, harpoonleftright ⇋ Rel, "
    "squareimage ⊏ Rel, squareoriginal ⊐ Rel, Yen ¥ Ord, check ✓ Ord, angle ∠ Ord, rightanglenw ⌜ Open, rightanglene ⌝ Close, rightanglesw ⌞ Open, rightanglese ⌟ Close, "
    "circleR ® Ord, maltesecross ✠ Ord, Omegainv ℧ Ord, eth ð Ord, planckover2pi1 ℏ Ord, arrowtp ↑ Ord, arrowbt ↓ Ord, arrowvertex | Ord, arrowdbltp ⇑ Ord, arrowdblbt ⇓ Ord, arrowvertexdbl ‖ Ord"
)
#: Widths in thousandths of slots outside SLOTS that are not as wide as a relation.
OTHER_WIDTHS = {
    0: "negationslash mapsto", 278: "wreathproduct", 444: "section dagger daggerdbl", 500: "asteriskmath diamondmath openbullet bullet arrowup arrowdown arrowbothv bardbl backslash emptyset star",
    611: "arrowdblup arrowdbldown arrowdblbothv aleph turnstileleft turnstileright paragraph", 667: "owner unionmulti logicaland logicalor logicalnot unionsq intersectionsq",
    722: "Rfractur Ifractur", 889: "triangle triangleinv",
    1000: "circlecopyrt lessmuch greatermuch arrowboth arrownortheast arrowsoutheast arrownorthwest arrowsouthwest arrowdblleft arrowdblright arrowdblboth "
    "arrowlefttophalf arrowleftbothalf arrowrighttophalf arrowrightbothalf",
}
#: Widths in thousandths of the size: a to z, A to Z.
ITALIC_LOWER = "529 429 433 521 466 490 477 576 345 412 521 298 878 600 485 503 446 451 469 361 573 485 716 572 490 465"
ITALIC_UPPER = "750 759 715 828 738 643 786 831 440 555 849 681 970 803 763 642 791 759 613 584 683 583 944 828 581 683"
ROMAN_LOWER = "500 556 444 556 444 306 500 556 278 306 528 278 833 556 500 556 528 392 394 389 556 528 722 528 528 444"
ROMAN_UPPER = "750 708 722 764 681 653 785 750 361 514 778 625 917 750 778 681 778 736 556 722 750 750 1028 750 750 611"
X_HEIGHT, ASCENDER, CAP, DIGIT, DESCENDER = 0.430555, 0.694444, 0.683333, 0.644444, 0.194444
# ----------------------------------------------------------------


class Slot(NamedTuple):
    font: str  # family
    name: str
    code: int
    text: str
    atom: str
    role: str  # symbol, largeop, fence, radical, accent
    base: str  # identity whatever its size
    rank: int  # 0 text size, above: larger
    side: str
    piece: str
    width: float  # in units of the size, like the next three
    height: float
    depth: float
    italic: float


ACCENTS = {"circumflex": "^", "macron": "¯", "vector": "⃗", "dotaccent": "˙", "dieresis": "¨", "tilde": "~", "caron": "ˇ", "breve": "˘", "acute": "´", "grave": "`"}
ACCENTS |= {"ring": "˚", "hungarumlaut": "˝", "tie": "⁀"} | {f"hat{x}": "^" for x in ("wide", "wider", "widest")} | {f"tilde{x}": "~" for x in ("wide", "wider", "widest")}
#: Fences that are their own mirror.
NEUTRAL = ("bar", "bardbl")


def _letter(font: str, ch: str, width: str) -> Slot:
    h = CAP if ch.isupper() else ASCENDER if ch in "bdfhklt" else X_HEIGHT if ch not in "ij" else 0.659
    d = DESCENDER if ch in "gjpqy" + ("f" if font == "cmmi" else "") else 0.0
    return Slot(font, ch, ord(ch), ch, "Ord", "symbol", ch, 0, "", "", int(width) / 1000, h, d, 0.08 if font == "cmmi" and ch in "fFHIJKMNTUVWXYZ" else 0.0)


def _shape(font: str, name: str, text: str) -> tuple[float, float, float]:
    if name in ACCENTS:
        return 0.5, 0.694, 0.0
    if name in ("comma", "semicolon", "period", "periodcentered", "colon", "exclam"):
        return 0.278, 0.106 if name in ("comma", "period") else 0.431, 0.194 if name in ("comma", "semicolon") else 0.0
    if name in ("parenleft", "parenright", "angbracketleft", "angbracketright"):
        return 0.389, 0.75, 0.25
    if name in ("bracketleft", "bracketright", "bar") or "floor" in name or "ceiling" in name:
        return 0.278 if name[:3] in ("bra", "bar") and "brace" not in name else 0.444, 0.75, 0.25
    if "brace" in name:
        return 0.5, 0.75, 0.25
    if name == "radical":
        return 0.833, 0.04, 0.96
    if name in ("infinity", "similar", "approxequal"):
        return (1.0 if name == "infinity" else 0.778), 0.431, 0.0
    if font == "cmmi":
        return 0.55, X_HEIGHT if name not in ("beta", "delta", "theta", "lambda", "xi", "zeta", "phi", "psi", "partialdiff", "lscript", "slash") else ASCENDER, 0.194 if name in ("beta", "gamma", "zeta", "eta", "mu", "xi", "rho", "phi", "chi", "psi") else 0.0
    if font == "cmr" and text.isalpha():
        return 0.68, CAP, 0.0
    if name == "prime":
        return 0.275, 0.556, 0.0
    return 0.778, 0.583, 0.083


@lru_cache(maxsize=1)
def slots() -> dict[tuple[str, str], Slot]:
    """(family, name) to slot."""
    out: dict[tuple[str, str], Slot] = {}

    def put(s: Slot) -> None:
        out.setdefault((s.font, s.name), s)

    for font, lower, upper in (("cmmi", ITALIC_LOWER, ITALIC_UPPER), ("cmr", ROMAN_LOWER, ROMAN_UPPER)):
        for k, w in enumerate(lower.split()):
            put(_letter(font, chr(97 + k), w))
        for k, w in enumerate(upper.split()):
            put(_letter(font, chr(65 + k), w))
    for k, name in enumerate("zero one two three four five six seven eight nine".split()):
        put(Slot("cmr", name, 48 + k, str(k), "Ord", "symbol", name, 0, "", "", 0.5, DIGIT, 0.0, 0.0))
    for k in range(26):
        put(Slot("cmsy", chr(65 + k), 65 + k, chr(65 + k), "Ord", "symbol", chr(65 + k), 0, "", "", 0.72, CAP, 0.0, 0.0))
    for font, line in SLOTS.items():
        for item in line.split(", "):
            name, code, text, atom = item.split(" ")
            text = "," if text == "COMMA" else text
            w, h, d = _shape(font, name, text)
            role = "accent" if name in ACCENTS else "radical" if name == "radical" else "fence" if atom in ("Open", "Close") and name != "exclam" or name == "bar" else "symbol"
            side = {"Open": "left", "Close": "right"}.get(atom, "") if role == "fence" else ""
            base = name.removesuffix("left").removesuffix("right") if role == "fence" else name
            put(Slot(font, name, int(code), text, atom, role, base, 0, side, "", w, h, d, 0.0))
    for item in OPERATORS.split(", "):
        name, text, small, large = item.split(" ")
        thin = "integral" in name
        put(Slot("cmex", name + "text", int(small), text, "Op", "largeop", name, 0, "", "", 0.472 if thin else 1.056, 0.0, 1.111 if thin else 1.0, 0.194 if thin else 0.0))
        put(Slot("cmex", name + "display", int(large), text, "Op", "largeop", name, 1, "", "", 0.556 if thin else 1.444, 0.0, 2.222 if thin else 1.4, 0.444 if thin else 0.0))
    for item in FENCES.split(", "):
        base, side, text, *codes = item.split(" ")
        atom = "Open" if side == "left" else "Close"
        for rank, (suffix, total) in enumerate((("big", 1.2), ("Big", 1.8), ("bigg", 2.4), ("Bigg", 3.0)), 1):
            put(Slot("cmex", f"{base}{side}{suffix}", int(codes[rank - 1]), text, atom, "fence", base, rank, side, "", 0.36 + 0.14 * rank, 0.04, total - 0.04, 0.0))
        for piece, code, total in (("tp", codes[4], 1.8), ("mid", codes[5], 1.8), ("bt", codes[6], 1.8), ("ex", codes[7], 0.6)):
            if code != "-":
                put(Slot("cmex", f"{base}{side}{piece}", int(code), text, atom, "fence", base, 5, side, piece, 0.875, 0.04 if piece != "ex" else 0.0, total - (0.04 if piece != "ex" else 0.0), 0.0))
    for rank, (suffix, total) in enumerate((("big", 1.2), ("Big", 1.8), ("bigg", 2.4), ("Bigg", 3.0)), 1):
        put(Slot("cmex", "radical" + suffix, RADICALS[rank - 1], "√", "Ord", "radical", "radical", rank, "", "", 1.0, 0.04, total - 0.04, 0.0))
    put(Slot("cmex", "vextendsingle", 12, "|", "Ord", "fence", "bar", 5, "", "ex", 0.333, 0.0, 0.606, 0.0))
    return out


def _other(encoding: str, name: str, code: int) -> Slot | None:
    """A slot outside the typesetter's: by its name; null where nothing is known of it but the name."""
    more = {n: (t, a) for n, t, a in (x.split(" ") for x in MORE.split(", "))}
    widths = {n: w / 1000 for w, names in OTHER_WIDTHS.items() for n in names.split(" ")}
    font = {"OML": "cmmi", "OMS": "cmsy", "OMX": "cmex"}.get(encoding, "cmr")
    if len(name) == 1 and name.isascii() and name.isalpha():
        return _letter("cmr", name, (ROMAN_UPPER if name.isupper() else ROMAN_LOWER).split()[ord(name.lower()) - 97])._replace(code=code)
    if name in ACCENTS:
        w, h = {"wide": (0.556, 0.722), "wider": (1.0, 0.75), "widest": (1.444, 0.75)}.get(name.removeprefix("hat").removeprefix("tilde"), (0.5, 0.694))
        return Slot(font, name, code, ACCENTS[name], "Ord", "accent", name, 0, "", "", w, h, 0.0, 0.0)
    base = name.removesuffix("text").removesuffix("display")
    if base in LARGE_OPERATORS and base != name:
        rank, wide = int(name.endswith("display")), "circle" in base
        return Slot(font, name, code, LARGE_OPERATORS[base], "Op", "largeop", base, rank, "", "", (1.111, 1.511)[rank] if wide else (0.833, 1.111)[rank], 0.0, (1.0, 1.4)[rank], 0.0)
    if name in ("radicaltp", "radicalvertex", "radicalbt"):
        piece, depth = {"radicaltp": ("tp", 0.56), "radicalvertex": ("ex", 0.56), "radicalbt": ("bt", 1.76)}[name]
        return Slot(font, name, code, "√", "Ord", "radical", "radical", 5, "", piece, 1.056, 0.04, depth, 0.0)
    if name == "vextenddouble":
        return Slot(font, name, code, "‖", "Ord", "fence", "bardbl", 5, "", "ex", 0.556, 0.0, 0.606, 0.0)
    for base, text in (("backslash", "∖"), ("slash", "/")):
        if name.startswith(base) and name != base:
            rank = ("big", "Big", "bigg", "Bigg").index(name.removeprefix(base)) + 1
            return Slot(font, name, code, text, "Ord", "symbol", base, rank, "", "", (0.578, 0.811, 1.044, 1.278)[rank - 1], 0.04, 0.6 * rank + 0.56, 0.0)
    text, atom = SYMBOLS.get(name) or EXTRA_SYMBOLS.get((encoding, name)) or more.get(name) or ("", "")
    if not text:
        return None
    if name.startswith("arrow") and encoding == "OMX":
        piece = "tp" if name.endswith("tp") else "bt" if name.endswith("bt") else "ex"
        return Slot(font, name, code, text, atom, "symbol", "arrowdbl" if "dbl" in name else "arrow", 5, "", piece, 0.778 if "dbl" in name else 0.667, 0.0, 0.6, 0.0)
    w, h, d = _shape(font, name, text)
    side = {"Open": "left", "Close": "right"}.get(atom, "") if name not in ("exclam", "question") else ""
    role = "fence" if side or name in NEUTRAL else "symbol"
    if text.isdigit():
        w, h, d = 0.5, DIGIT, 0.0
    if name == "bardbl":
        h, d = 0.75, 0.25
    return Slot(font, name, code, text, atom, role, name.removesuffix("left").removesuffix("right") if side else name, 0, side, "", widths.get(name, w), h, d, 0.0)


@lru_cache(maxsize=1)
def by_code() -> dict[tuple[str, int], Slot]:
    """(family, code) to slot, for all families of the surveyed encodings; one slot may serve two fences, and then
    stands for the left one. Families of one encoding share the slots of Computer Modern's."""
    own: dict[tuple[str, int], Slot] = {}
    for s in slots().values():
        own.setdefault((s.font, s.code), s)
    out = dict(own)
    for encoding, names in ENCODINGS.items():
        font = {"OML": "cmmi", "OT1": "cmr", "OMS": "cmsy", "OMX": "cmex"}.get(encoding)
        for code, name in enumerate(names.split()):
            s = own.get((font, code)) or (_other(encoding, name, code) if name != "-" else None)
            for f in (f for f, (e, _) in FAMILIES.items() if s and e == encoding):
                out.setdefault((f, code), s)
    return out


@lru_cache(maxsize=1)
def by_text() -> dict[str, Slot]:
    """A character of the grammar to the slot that sets it at text size: italic letters, roman digits and signs."""
    out: dict[str, Slot] = {}
    order = {"cmmi": 0, "cmr": 1, "cmsy": 2}
    for s in sorted((s for s in slots().values() if s.font in order), key=lambda s: (order[s.font], s.code)):
        if s.font == "cmmi" or not (s.text.isascii() and s.text.isalpha()):
            out.setdefault(s.text, s)
    return out


def family(font: str) -> str:
    """Of a font as a PDF names it: without subset prefix and design size; of Latin Modern's long names the short form."""
    name, _, shape = font.split("+")[-1].lower().partition("-")
    stem = LM_LONG.get(name.rstrip("0123456789."))
    if stem is None:
        return font.split("+")[-1].lower().rstrip("0123456789.")
    bold, slanted = shape.startswith(("bold", "demi")), shape.endswith(("italic", "oblique"))
    return {"lmr": "lmbx" if bold else "lmri" if slanted else stem, "lmmi": "lmmib" if bold else stem, "lmsy": "lmbsy" if bold else stem}.get(stem, stem)
