"""Layout trees and their canonical signatures."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

LEAVES = ("Identifier", "Number", "Operator", "Text", "Unknown", "LargeOperator")


@dataclass
class Node:
    kind: str
    kids: list[Node] = field(default_factory=list)
    text: str = ""
    glyph: str = ""
    font: str = ""
    variant: str = ""
    atom: str = "Ord"
    open: str = ""
    close: str = ""
    stretchy: bool = False
    accent: str = ""
    display: bool = False
    has_under: bool = False
    has_over: bool = False
    thickness: float = 0.4
    width_em: float = 0.0
    reason: str = ""
    glyph_ids: tuple[int, ...] = ()
    rule_ids: tuple[int, ...] = ()
    box: tuple[float, float, float, float] | None = None
    confidence: float = 1.0
    rule: str = ""
    residual: float | None = None

    def walk(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()


def structural_confidence(n: Node) -> float:
    return min((x.confidence for x in n.walk() if x.kind != "Space"), default=1.0)


def spacing_confidence(n: Node) -> float:
    return min((x.confidence for x in n.walk() if x.kind == "Space"), default=1.0)


def signature(n: Node) -> str:
    """A canonical S-expression without spaces' nodes and provenance; a row of one is that one."""
    if n.kind in LEAVES:
        return f"({n.kind} {n.text})"
    kids = [signature(k) for k in n.kids if k.kind != "Space"]
    if n.kind == "Row":
        return kids[0] if len(kids) == 1 else f"(Row {' '.join(kids)})"
    head = {"Delimited": f" {n.open or '.'} {n.close or '.'}", "Accent": f" {n.accent}", "UnderOver": f" {int(n.has_under)}{int(n.has_over)}"}.get(n.kind, "")
    return f"({n.kind}{head} {' '.join(kids)})"


#: What a node of a kind says of itself in JSON, beside its kind, text and children.
PAYLOAD = {
    "Identifier": ("variant",), "Operator": ("atom",), "LargeOperator": ("display",), "Unknown": ("font", "reason"), "Space": ("width_em",), "Delimited": ("open", "close", "stretchy"),
    "Accent": ("accent",), "UnderOver": ("has_under", "has_over"), "Fraction": ("thickness",),
}


def to_json(n: Node, places: bool = False) -> str:
    """The tree as nested JSON: kind, text of leaves, the payload of its kind and children; with places also glyphs, rules,
    box, confidence, rule and residual. Numbers are rounded to six places."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, tuple) else v

    def node(x: Node) -> dict:
        out = {"kind": x.kind} | ({"text": x.text} if x.text else {}) | {c: plain(getattr(x, c)) for c in PAYLOAD.get(x.kind, ())}
        if places:
            out |= {"glyph_ids": list(x.glyph_ids), "rule_ids": list(x.rule_ids), "box": [round(v, 6) for v in x.box] if x.box else None, "confidence": plain(x.confidence), "rule": x.rule, "residual": plain(x.residual)}
        return out | ({"children": [node(k) for k in x.kids]} if x.kids else {})

    return json.dumps(node(n), ensure_ascii=False, separators=(",", ":"))


def flatten(n: Node) -> list[dict]:
    """Rows of the node table in pre-order: node_id, parent_id, ord, depth and payload."""
    out: list[dict] = []

    def add(x: Node, parent: int | None, ord_: int, depth: int) -> None:
        k = len(out)
        out.append(
            {
                "node_id": k, "parent_id": parent, "ord": ord_, "depth": depth, "kind": x.kind, "text": x.text, "glyph": x.glyph, "font": x.font, "variant": x.variant,
                "atom": x.atom, "open": x.open, "close": x.close, "stretchy": x.stretchy, "accent": x.accent, "display": x.display, "has_under": x.has_under,
                "has_over": x.has_over, "thickness": x.thickness, "width_em": x.width_em, "reason": x.reason, "glyph_ids": list(x.glyph_ids), "rule_ids": list(x.rule_ids),
                "x0": x.box[0] if x.box else None, "y0": x.box[1] if x.box else None, "x1": x.box[2] if x.box else None, "y1": x.box[3] if x.box else None,
                "confidence": x.confidence, "rule_name": x.rule, "residual": x.residual,
            }
        )
        for i, kid in enumerate(x.kids):
            add(kid, k, i, depth + 1)

    add(n, None, 0, 0)
    return out


def unflatten(rows: list[dict]) -> Node:
    """The tree of its node table, in any order."""
    nodes = {}
    for r in sorted(rows, key=lambda r: r["node_id"]):
        fields = {k: r[k] for k in ("kind", "text", "glyph", "font", "variant", "atom", "open", "close", "stretchy", "accent", "display", "has_under", "has_over", "thickness", "width_em", "reason", "confidence", "residual")}
        nodes[r["node_id"]] = n = Node(**fields, glyph_ids=tuple(r["glyph_ids"]), rule_ids=tuple(r["rule_ids"]), rule=r["rule_name"])
        if r["parent_id"] is not None:
            nodes[r["parent_id"]].kids.append(n)
    return nodes[min(nodes)]
