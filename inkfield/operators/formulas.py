"""Formulas in bulk: typeset, pack, decompile, serialise and compare regions.

A region is one row: its key, an array of glyphs and an array of rules. Rows are solved in Arrow batches without a
shuffle, since a packed region is complete; packing itself is one grouped aggregation over glyph and rule tables.
"""

from __future__ import annotations

import json
import marshal
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.core import decompile as core
from inkfield.core import readers, suites, tree, writers
from inkfield.core.typeset import page

GLYPH = "struct<glyph_id:bigint,font_name:string,char_code:int,size:double,x:double,y:double>"
RULE = "struct<rule_id:bigint,x0:double,y0:double,x1:double,y1:double>"
PACKED = f"glyphs array<{GLYPH}>, rules array<{RULE}>"
NODE = (
    "node_id int, parent_id int, ord int, depth int, kind string, text string, glyph string, font string, variant string, atom string, open string, close string, stretchy boolean, "
    "accent string, display boolean, has_under boolean, has_over boolean, thickness double, width_em double, reason string, glyph_ids array<bigint>, rule_ids array<bigint>, "
    "x0 double, y0 double, x1 double, y1 double, confidence double, rule_name string, residual double"
)
FORMATS = {
    "mathml": lambda n: writers.to_mathml(n), "latex": lambda n: writers.to_latex(n).text, "asciimath": lambda n: writers.to_asciimath(n).text, "omml": lambda n: writers.to_omml(n).text,
    "wordperfect": lambda n: writers.to_wordperfect(n).text, "label_graph": writers.to_label_graph, "speech_mathml": writers.speech_mathml, "signature": tree.signature, "json": tree.to_json,
}


#: Decisions below this confidence are weak.
WEAK = 0.9


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, wherever they are started."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


#: Bytes of the records whose results a task remembers, and of the largest: small formulas come again and again.
MEMO, MEMO_RECORD = 16 << 20, 1 << 14


def _map(df: DataFrame, keys: Sequence[str], ddl: str, rows) -> DataFrame:
    """rows(record) yields the values behind the keys of each output row; it sees all columns but the keys, so equal
    records, of which a task remembers some, are worked on once."""
    workers_find_package(df.sparkSession)
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(ddl).fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    work = [c for c in df.columns if c not in keys]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        held = 0
        for b in batches:
            names = [b.column(k).to_pylist() for k in keys]
            inner = b.select(work)
            out: list[list] = [[] for _ in arrow.names]
            for i, r in enumerate(inner.to_pylist()):
                content = marshal.dumps([r[c] for c in work], 2)
                got = known.get(content)
                if got is None:
                    got = list(rows(r))
                    if len(content) <= MEMO_RECORD:
                        held += len(content)
                        if held > MEMO:
                            known, held = {}, len(content)
                        known[content] = got
                for values in got:
                    for column, v in zip(out, [*[k[i] for k in names], *values]):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(task, schema)


def typeset(expressions: DataFrame, keys: Sequence[str], column: str = "expr") -> DataFrame:
    """keys, glyphs, rules of expressions in JSON. Nothing of the expression but its page is passed on."""

    def rows(r: dict):
        glyphs, bars = page(_tuple(json.loads(r[column])))
        yield [{k: g[k] for k in ("glyph_id", "font_name", "char_code", "size", "x", "y")} for g in glyphs], bars

    return _map(expressions.select(*keys, column), keys, PACKED, rows)


def _tuple(x):
    return tuple(map(_tuple, x)) if isinstance(x, list) else x


def pack(glyphs: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each region of glyph and rule tables; regions without rules, or of rules alone, stay. The file's own
    characters and widths (unicode_from_pdf, pdf_width) come along where the table has them."""
    more = [c for c in ("unicode_from_pdf", "pdf_width") if c in glyphs.columns]
    g = glyphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("glyph_id", "font_name", "char_code", "size", "x", "y", *more))).alias("glyphs"))
    r = rules.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rule_id", "x0", "y0", "x1", "y1"))).alias("rules"))
    both = g.join(r, list(keys), "full")
    return both.select(*keys, F.coalesce("glyphs", F.array().cast(g.schema["glyphs"].dataType)).alias("glyphs"), F.coalesce("rules", F.array().cast(f"array<{RULE}>")).alias("rules"))


def solve(r: dict) -> tree.Node:
    """The tree of a packed region, whatever its size; a region that cannot be solved is one unknown node with all its
    glyphs, which do not count as recovered."""
    glyphs, bars = r["glyphs"] or [], r["rules"] or []
    try:
        return core.decompile(glyphs, bars)
    except Exception as e:  # one region must not stop a million others; the row says what happened
        why = f"{type(e).__name__}: {e}"
    return tree.Node("Unknown", reason=why[:200], glyph_ids=tuple(g["glyph_id"] for g in glyphs), rule_ids=tuple(b["rule_id"] for b in bars), confidence=0.0)


def nodes(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The flat node table of every region."""
    names = [f.split(" ")[0] for f in NODE.split(", ")]

    def rows(r: dict):
        for n in tree.flatten(solve(r)):
            yield [n[c] for c in names]

    return _map(packed.select(*keys, "glyphs", "rules"), keys, NODE, rows)


def extract(packed: DataFrame, keys: Sequence[str], formats: Sequence[str] = ("latex",)) -> DataFrame:
    """keys, the formats, structural and spacing confidence, glyphs and glyphs in the tree, unknown nodes, decisions below
    WEAK, and what the LaTeX writer could not say, where LaTeX is asked for. Confidence 0: not solved, all glyphs are in
    the one unknown node."""
    counts = "confidence double, spacing_confidence double, n_glyphs int, n_in_tree int, n_unknown int, n_weak int, unreproducible array<string>"
    ddl = ", ".join([*(f"{f} string" for f in formats), counts])

    def rows(r: dict):
        n = solve(r)
        every = list(n.walk())
        have = {i for x in every for i in x.glyph_ids}
        latex = writers.to_latex(n) if "latex" in formats else None
        yield [
            *(latex.text if f == "latex" else FORMATS[f](n) for f in formats), tree.structural_confidence(n), tree.spacing_confidence(n), len(r["glyphs"] or []),
            sum(g["glyph_id"] in have for g in r["glyphs"] or []), sum(x.kind == "Unknown" for x in every), sum(x.confidence < WEAK for x in every),
            latex.unreproducible if latex else None,
        ]

    return _map(packed.select(*keys, "glyphs", "rules"), keys, ddl, rows)


def label_objects(packed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(objects, relations) of the label graphs, as tables."""
    o = _map(packed.select(*keys, "glyphs", "rules"), keys, "object string, label string, ids array<bigint>", lambda r: writers.label_graph(solve(r))[0])
    e = _map(packed.select(*keys, "glyphs", "rules"), keys, "parent string, child string, relation string", lambda r: writers.label_graph(solve(r))[1])
    return o, e


def explain(node_table: DataFrame, keys: Sequence[str], floor: float = 1.0) -> DataFrame:
    """Decisions below a confidence, leaves left out, weakest first within their region."""
    leaf = F.col("kind").isin(*tree.LEAVES) & (F.col("kind") != "Unknown")
    return node_table.filter((F.col("confidence") < floor) & ~leaf).select(*keys, "node_id", "kind", "rule_name", "confidence", "residual")


def survey(read: DataFrame) -> DataFrame:
    """One row: equations, glyphs, glyphs in trees, recovery, unknown nodes, weak decisions. read: as extract() returns
    it; every region is read once and summed."""
    inside = F.sum(F.when(F.col("confidence") > 0, F.col("n_in_tree")).otherwise(0))  # 0: not solved
    glyphs = F.sum("n_glyphs")
    return read.agg(
        F.count(F.lit(1)).alias("equations"), glyphs.alias("glyphs"), inside.alias("glyphs_in_tree"), F.coalesce(inside / F.nullif(glyphs, F.lit(0)), F.lit(1.0)).alias("glyph_recovery"),
        F.coalesce(F.sum("n_unknown"), F.lit(0)).alias("unknown"), F.coalesce(F.sum("n_weak"), F.lit(0)).alias("low_confidence"),
    )


# ---------------------------------------------------------------- evaluation


def cases(spark: SparkSession, suite: str = "extended", seed: int = 7, n: int = 300) -> DataFrame:
    """case_id, suite, expr, expected, constructs and size of a suite: milestone, extended or random."""
    exprs = {"milestone": suites.MILESTONE, "extended": suites.EXTENDED}.get(suite) or suites.random_suite(seed, n)
    rows = [(k, suite, json.dumps(e), suites.expected(e), suites.constructs(e), suites.size(e)) for k, e in enumerate(exprs)]
    return spark.createDataFrame(rows, "case_id int, suite string, expr string, expected string, constructs array<string>, size int")


def benchmark(case_table: DataFrame) -> DataFrame:
    """case_id, suite, expected, signature, exact, recovery, confidence, constructs; the truth joins after the reading."""
    read = extract(typeset(case_table, ["suite", "case_id"]), ["suite", "case_id"], ["signature", "latex"])
    got = case_table.select("suite", "case_id", "expected", "constructs").join(read, ["suite", "case_id"], "left")
    recovery = F.coalesce(F.when(F.col("confidence") > 0, F.col("n_in_tree")).otherwise(0) / F.nullif(F.col("n_glyphs"), F.lit(0)), F.lit(1.0))
    return got.select("suite", "case_id", "expected", "signature", (F.col("signature") == F.col("expected")).alias("exact"), recovery.alias("recovery"), "confidence", "latex", "constructs")


def report(results: DataFrame) -> DataFrame:
    """Exact rate, recovery and worst confidence of each suite."""
    return results.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("exact").cast("double")).alias("exact_rate"), F.avg("recovery").alias("recovery"), F.min("confidence").alias("least_confidence"))


def by_construct(results: DataFrame) -> DataFrame:
    """A case counts once in each of its constructs."""
    return results.select("suite", F.explode("constructs").alias("construct"), "exact").groupBy("suite", "construct").agg(F.sum(F.col("exact").cast("long")).alias("passed"), F.count(F.lit(1)).alias("total"))


def agreement(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and, for each format with an independent reader, whether what is read back agrees with the tree."""

    def rows(r: dict):
        n = solve(r)
        want = readers.relaxed(n)

        def same(read, text) -> bool:
            try:
                return read(text) == want
            except Exception:  # what cannot be read back does not agree
                return False

        yield same(readers.from_mathml, writers.to_mathml(n)), same(readers.from_omml, writers.to_omml(n).text), same(readers.from_asciimath, writers.to_asciimath(n).text)

    return _map(packed.select(*keys, "glyphs", "rules"), keys, "mathml boolean, omml boolean, asciimath boolean", rows)


def roundtrip(packed: DataFrame, keys: Sequence[str], tol: float = 0.02) -> DataFrame:
    """keys, verdict, worst, rms: each region decompiled, set again and compared glyph by glyph in reading order,
    after both are moved to a common origin."""

    def rows(r: dict):
        try:
            again, bars = page(suites.from_tree(solve(r)))
        except Exception as e:
            yield "uncompilable", None, None, f"{type(e).__name__}: {e}"[:200]
            return
        order = lambda gs: sorted(gs, key=lambda g: (round(g["x"], 3), -round(g["y"], 3)))
        a, b = order(r["glyphs"]), order(again)
        if len(a) != len(b):
            yield "incomplete", None, None, f"{len(a)} glyphs, {len(b)} again"
            return
        if any((x["font_name"], x["char_code"]) != (y["font_name"], y["char_code"]) for x, y in zip(a, b)):
            yield "different", None, None, "other glyphs"
            return
        dx, dy = (sorted(x[c] - y[c] for x, y in zip(a, b))[len(a) // 2] for c in ("x", "y"))
        off = [((x["x"] - y["x"] - dx) ** 2 + (x["y"] - y["y"] - dy) ** 2) ** 0.5 for x, y in zip(a, b)]
        line = lambda q, mx, my: sorted((round(z["x0"] + mx, 1), round(z["y0"] + my, 1), round(z["x1"] + mx, 1)) for z in q)
        rules = len(r["rules"]) == len(bars) and all(max(abs(u - v) for u, v in zip(p, q)) <= 0.2 for p, q in zip(line(r["rules"], 0, 0), line(bars, dx, dy)))
        yield "exact" if max(off) <= tol and rules else "shifted", max(off), (sum(o * o for o in off) / len(off)) ** 0.5, ""

    return _map(packed.select(*keys, "glyphs", "rules"), keys, "verdict string, worst double, rms double, note string", rows)
