"""Typographic scalars as column expressions: fonts, styles, parameters, spacing and the forward rules.

Styles are 0 to 7, display to script-script, odd when cramped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfield.functions.boxes import _c

# ---------------------------------------------------------------- fixed values of the typesetting rules
#: Font parameters in units of the size, from Computer Modern at 10 pt.
SIGMA = {
    "x_height": 0.430555, "quad": 1.0, "num1": 0.676508, "num2": 0.393732, "num3": 0.443731, "denom1": 0.685951, "denom2": 0.344841,
    "sup1": 0.412892, "sup2": 0.362892, "sup3": 0.288889, "sub1": 0.15, "sub2": 0.247217, "sup_drop": 0.386108, "sub_drop": 0.05,
    "delim1": 2.39, "delim2": 1.01, "axis_height": 0.25,
}
XI = {"rule": 0.04, "big_op1": 0.111111, "big_op2": 0.166667, "big_op3": 0.2, "big_op4": 0.6, "big_op5": 0.1}
ATOMS = ("Ord", "Op", "Bin", "Rel", "Open", "Close", "Punct", "Inner")
#: Glue between atoms: rows left, columns right. 0 none, 1 thin, 2 medium, 3 thick, * impossible; in brackets:
#: not in script styles.
GLUE = (
    "0 1 (2) (3) 0 0 0 (1)",
    "1 1 * (3) 0 0 0 (1)",
    "(2) (2) * * (2) * * (2)",
    "(3) (3) * 0 (3) 0 0 (3)",
    "0 0 * 0 0 0 0 0",
    "0 1 (2) (3) 0 0 0 (1)",
    "(1) (1) * (1) (1) (1) (1) (1)",
    "(1) 1 (2) (3) (1) 0 (1) (1)",
)
MU = (0.0, 3.0, 4.0, 5.0)
#: Explicit spaces, in mu.
AUTHOR_SPACES = {-3: r"\!", 3: r"\,", 4: r"\:", 5: r"\;", 18: r"\quad", 36: r"\qquad"}
BIN_AFTER = ("Bin", "Op", "Rel", "Open", "Punct")
BIN_BEFORE = ("Rel", "Close", "Punct")
# ----------------------------------------------------------------


def glue_rows() -> list[tuple[str, str, float, bool]]:
    """(left, right, mu or null, also in script styles) of the 64 pairs."""
    out = []
    for left, line in zip(ATOMS, GLUE):
        for right, cell in zip(ATOMS, line.split()):
            out.append((left, right, None if cell == "*" else MU[int(cell.strip("()"))], "(" not in cell))
    return out


def strip_subset(font: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(font, "^/+", ""), r"^[A-Z]{6}\+", "")


def font_family(font: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(strip_subset(font)), r"^([a-z]+?)(\d+(?:\.\d+)?)?$", 1), F.lit(""))


def design_size(font: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(strip_subset(font)), r"^([a-z]+?)(\d+(?:\.\d+)?)?$", 2), F.lit("")).cast("double")


def nearest_design_size(family: str, size) -> Column:
    """The size of the family that is loaded for a size in points."""
    size = _c(size)
    if family == "cmsy":
        return F.when(size < 6, 5.0).when(size < 8, 7.0).otherwise(10.0)
    if family == "cmex":
        return F.when(size < 7.5, 7.0).when(size < 8.5, 8.0).when(size < 9.5, 9.0).otherwise(10.0)
    return F.lit(10.0)


def is_cramped(style) -> Column:
    return _c(style).bitwiseAND(1) == 1


def sup_style(style) -> Column:
    s = _c(style)
    return F.when(s < 4, 4).otherwise(6) + s.bitwiseAND(1)


def sub_style(style) -> Column:
    return sup_style(style).bitwiseOR(1)


def num_style(style) -> Column:
    s = _c(style)
    return F.when(s < 6, F.greatest(F.lit(2), s.bitwiseAND(-2) + 2) + s.bitwiseAND(1)).otherwise(s)


def den_style(style) -> Column:
    return num_style(style).bitwiseOR(1)


def size_ratio(style) -> Column:
    s = _c(style)
    return F.when(s < 4, 1.0).when(s < 6, 0.7).otherwise(0.5)


def param(name: str, size) -> Column:
    return F.lit(SIGMA.get(name, XI.get(name))) * _c(size)


def baseline_tolerance(size) -> Column:
    return F.greatest(F.lit(0.05), F.lit(0.005) * _c(size))


def x_tolerance(size) -> Column:
    return F.greatest(F.lit(0.1), F.lit(0.02) * _c(size))


def nearest(values: dict[str, Column], target) -> Column:
    """The name of the nearest value; of equals the first named."""
    near = F.array(*[F.struct(F.abs(v - _c(target)).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, v) in enumerate(values.items())])
    return F.array_min(near)["n"]


def math_sizes(sizes: Column) -> Column:
    """The three levels of a formula from an array of sizes: a new level opens below 95 % of the last; absent
    levels follow by ratio, and an empty array means 10, 7 and 5 points."""
    down = F.reverse(F.array_sort(F.array_distinct(sizes)))
    levels = F.aggregate(down, F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x < 0.95 * F.element_at(a, -1)), F.concat(a, F.array(x))).otherwise(a))
    one = F.coalesce(F.try_element_at(levels, F.lit(1)), F.lit(10.0))
    two = F.coalesce(F.try_element_at(levels, F.lit(2)), one * 0.7)
    three = F.coalesce(F.try_element_at(levels, F.lit(3)), F.when(F.size(levels) == 0, F.lit(5.0)).otherwise(two * 5 / 7))
    return F.array(one, two, three)


# ---------------------------------------------------------------- spacing


def gap_mu(gap, quad) -> Column:
    return _c(gap) / (_c(quad) / 18)


def nearest_glue(mu: Column) -> Column:
    """0 to 3; of equals the lower."""
    near = F.array(*[F.struct(F.abs(F.lit(m) - mu).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(MU)])
    return F.array_min(near)["k"]


def glue_residual(mu: Column) -> Column:
    k = nearest_glue(mu)
    return mu - F.element_at(F.array(*map(F.lit, MU)), k + 1)


def is_clean(mu: Column) -> Column:
    return F.abs(glue_residual(mu)) <= 0.25


def is_integral(mu: Column) -> Column:
    return F.abs(mu - F.rint(mu)) <= 1 / 3


def author_space(mu: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in AUTHOR_SPACES.items() for x in kv])
    return F.when(is_integral(mu), F.try_element_at(names, F.rint(mu).cast("int")))


def reclassify(atoms: Column) -> Column:
    """Atom classes of a list with binary operators that cannot be binary made ordinary. The first pass looks at the
    rewritten class before, so it is a fold; the second looks ahead."""
    first = F.aggregate(
        atoms,
        F.array().cast("array<string>"),
        lambda a, x: F.concat(a, F.array(F.when((x == "Bin") & ((F.size(a) == 0) | F.element_at(a, -1).isin(*BIN_AFTER)), "Ord").otherwise(x))),
    )
    after = F.slice(F.concat(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), F.array(F.lit(None).cast("string"))), F.lit(1), F.size(first))
    return F.zip_with(first, after, lambda x, y: F.when((x == "Bin") & F.coalesce(y.isin(*BIN_BEFORE), F.lit(False)), "Ord").otherwise(x))


def rewrites(before: Column, after: Column) -> Column:
    """A note for each atom that was rewritten."""
    marked = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    notes = F.transform(marked, lambda m, k: F.when(m["b"] != m["a"], F.concat(F.lit("atom "), k.cast("string"), F.lit(": "), m["b"], F.lit(" to "), m["a"])))
    return F.filter(notes, lambda n: n.isNotNull())


# ---------------------------------------------------------------- forward rules and their residuals


def axis_shift(height, depth, size) -> Column:
    """What an axis-centred unit's baseline is off by."""
    return (_c(height) - _c(depth)) / 2 - param("axis_height", size)


def sup_shift(size, depth, display: bool = True, cramped: bool = False, nucleus_height=None) -> Column:
    """How far a lone superscript is raised; nucleus_height: of a nucleus that is not a character."""
    u = F.lit(0.0) if nucleus_height is None else _c(nucleus_height) - param("sup_drop", size)
    p = "sup3" if cramped else "sup1" if display else "sup2"
    return F.greatest(u, param(p, size), _c(depth) + param("x_height", size) / 4)


def sub_shift(size, script_height, nucleus_depth=None) -> Column:
    v = F.lit(0.0) if nucleus_depth is None else _c(nucleus_depth) + param("sub_drop", size)
    return F.greatest(v, param("sub1", size), _c(script_height) - F.lit(0.8) * param("x_height", size))


def both_shifts(size, up: Column, down: Column, sup_depth, sub_height) -> tuple[Column, Column]:
    """Shifts of two scripts after they are kept apart by four rule widths, and the upper kept clear."""
    theta = param("rule", size)
    v = F.greatest(down, param("sub2", size))
    short = 4 * theta - ((up - _c(sup_depth)) - (_c(sub_height) - v))
    v2 = F.when(short > 0, v + short).otherwise(v)
    psi = F.lit(0.8) * param("x_height", size) - (up - _c(sup_depth))
    move = F.when((short > 0) & (psi > 0), psi).otherwise(0.0)
    return up + move, v2 - move


def trust(residual: Column, size) -> Column:
    """What a decision is worth whose place misses the rule's by a residual: 1 where it fits, a half where it is off by
    a tenth of the size, falling with the square beyond. All rules share this scale."""
    off = F.lit(10.0) * residual / _c(size)
    return F.lit(1.0) / (F.lit(1.0) + off * off)


def fraction_residual(num_shift, den_shift, size, display: bool) -> Column:
    n, d = ("num1", "denom1") if display else ("num2", "denom2")
    return F.greatest(F.abs(_c(num_shift) - param(n, size)), F.abs(_c(den_shift) - param(d, size)))


def radical_clearance(size, height, depth, surd_depth, display: bool) -> Column:
    """Space between radicand and bar, after the surd's excess is shared."""
    theta = param("rule", size)
    clear = theta + param("x_height", size) / 4 if display else F.lit(1.25) * theta
    excess = _c(surd_depth) - (_c(height) + _c(depth) + clear)
    return F.when(excess > 0, clear + excess / 2).otherwise(clear)


def limit_gap(size, upper: bool, extent) -> Column:
    """Space above (or below) an operator before a limit; extent: the limit's depth (or height)."""
    a, b = ("big_op3", "big_op1") if upper else ("big_op4", "big_op2")
    return F.greatest(param(a, size) - _c(extent), param(b, size))


def accent_baseline(base, height, size) -> Column:
    return _c(base) + _c(height) - F.least(_c(height), param("x_height", size))


def bar_kind(thickness, size, above: Column, below: Column) -> Column:
    """What a rule is from what stands above and below it."""
    return (
        F.when(_c(thickness) > 4 * param("rule", size), "unclassified")
        .when(above & below, "fraction")
        .when(below, "overline")
        .when(above, "underline")
        .otherwise("unclassified")
    )


def size_option(size) -> Column:
    """The class option whose body size is nearest."""
    return nearest({"10pt": F.lit(10.0), "11pt": F.lit(10.95), "12pt": F.lit(12.0)}, size)
