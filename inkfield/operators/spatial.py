"""Joins and clusterings of boxes. Every join has an equi-key (page, region, label): the range predicate is the
residual of a hash join, never a nested loop; large groups are bucketed on a grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.functions.boxes import Box

Predicate = Callable[[Box, Box], Column]


def _sides(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    def named(d: DataFrame, p: str) -> DataFrame:
        return d.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in d.columns if c not in keys])

    return named(left, "l_"), named(right, "r_")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], where: Predicate, how: str = "inner", cell: float | None = None) -> DataFrame:
    """Pairs of one key for which where(left box, right box) holds; columns get l_ and r_ in front. cell: side of a
    grid over x on which both sides are cut as well, for keys with very many boxes; it needs `where` to imply that
    the boxes overlap in x, and takes inner joins only."""
    a, b = _sides(left, right, keys)
    if cell is None:
        on = where(Box.of("l_"), Box.of("r_"))
        return a.join(b, [*[a[k] == b[k] for k in keys], on], how).drop(*[b[k] for k in keys]) if how not in ("left_semi", "left_anti") else a.join(b, [*[a[k] == b[k] for k in keys], on], how)
    if how != "inner":
        raise ValueError("a grid serves inner joins")

    def cut(d: DataFrame, p: str) -> DataFrame:
        lo, hi = F.floor(F.col(f"{p}x0") / cell), F.floor(F.col(f"{p}x1") / cell)
        return d.withColumn("cell", F.explode(F.sequence(lo, hi)))

    both = cut(a, "l_").join(cut(b, "r_"), [*keys, "cell"]).filter(where(Box.of("l_"), Box.of("r_")))
    # a pair meets in every common cell: it counts in the first
    first = F.floor(F.greatest("l_x0", "r_x0") / cell)
    return both.filter(F.col("cell") == first).drop("cell")


INSIDE: Predicate = lambda region, box: region.contains(box)
CENTRE_INSIDE: Predicate = lambda region, box: region.contains_point(box.cx, box.cy)
INTERSECTING: Predicate = lambda a, b: a.overlaps_x(b) & a.overlaps_y(b)
ABOVE: Predicate = lambda a, b: (b.cy > a.y1) & (a.x0 <= b.cx) & (b.cx <= a.x1)
BELOW: Predicate = lambda a, b: (b.cy < a.y0) & (a.x0 <= b.cx) & (b.cx <= a.x1)


def nearest_beside(boxes: DataFrame, keys: Sequence[str], id: str, tol_y: float, side: str = "right") -> DataFrame:
    """For each box the nearest one that begins right (or ends left) of it with its centre within tol_y; of
    equals the lower id. keys, l_id, r_id, gap. Both sides are cut into bands of height tol_y, so a box meets those of
    three bands, not of its page."""
    a, b = _sides(boxes, boxes, keys)
    band = lambda box: F.floor(box.cy / tol_y)
    l, r = Box.of("l_"), Box.of("r_")
    near = a.withColumn("band", F.explode(F.sequence(band(l) - 1, band(l) + 1))).join(b.withColumn("band", band(r)), [*keys, "band"])
    ahead, gap = (r.x0 >= l.x1, r.x0 - l.x1) if side == "right" else (r.x1 <= l.x0, l.x0 - r.x1)
    pairs = near.filter(ahead & (F.abs(l.cy - r.cy) <= tol_y) & (F.col(f"l_{id}") != F.col(f"r_{id}")))
    best = F.min(F.struct(gap.alias("gap"), F.col(f"r_{id}").alias("id")))
    return pairs.groupBy(*keys, f"l_{id}").agg(best.alias("b")).select(*keys, f"l_{id}", F.col("b.id").alias(f"r_{id}"), F.col("b.gap").alias("gap"))


def nearest_corner(boxes: DataFrame, keys: Sequence[str], id: str, tol: float) -> DataFrame:
    """For each box the other one of its key whose corner (x0, y1) is nearest to its (x1, y1), by the sum of both distances,
    none above tol; of equals the lower id. keys, l_id, r_id, err. A box meets the columns (distinct x0) within tol, not
    the boxes of its page; in a column it sees the nearest corner on either side, in order. Corners of one column whose
    sums are equal only by rounding count by their distance."""
    cell = lambda at: F.floor(at / (tol * 1.01))  # noqa: E731  wider than tol, so that rounding skips no cell
    a, b = _sides(boxes, boxes, keys)
    own, other, x, y = F.col(f"l_{id}"), F.col(f"r_{id}"), F.col("r_x0"), F.col("r_y1")
    # of the boxes with one corner only the two least ids can be nearest to any
    least = F.row_number().over(Window.partitionBy(*keys, x, y).orderBy(other))
    b = b.select(*keys, x, y, other).filter(x.isNotNull() & y.isNotNull() & other.isNotNull()).distinct().withColumn("rank", least).filter("rank <= 2")
    b = b.groupBy(*keys, x, y).agg(F.min(other).alias("id"), F.max(other).alias("next"))
    corner = F.struct(y.alias("y"), "id", "next")
    for name, order in (("low", y.asc()), ("high", y.desc())):  # the corner to take instead, where a corner is of its only box
        w = Window.partitionBy(*keys, x).orderBy(order)
        same = (F.col("id") == F.col("next")) & (F.lag("id").over(w) == F.col("id")) & (F.lag("next").over(w) == F.col("id"))
        b = b.withColumn("first", F.when(F.coalesce(same, F.lit(False)), None).otherwise(F.struct(F.lag(corner).over(w).alias("c"))))
        b = b.withColumn(name, F.last("first", True).over(w.rowsBetween(Window.unboundedPreceding, 0))["c"]).drop("first")
    columns = b.select(*keys, x).distinct().withColumn("cell", F.explode(F.sequence(cell(x) - 1, cell(x) + 1)))
    a = a.filter(own.isNotNull()).withColumn("cell", cell(F.col("l_x1"))).join(columns, [*keys, "cell"])
    d = a.withColumn("dx", F.abs(F.col("l_x1") - x)).filter(F.col("dx") <= tol).select(*keys, x, own, "dx", F.col("l_y1").alias("at"))
    d = d.unionByName(b.select(*keys, x, y.alias("at"), F.struct(y.alias("y"), "id", "next", "low", "high").alias("mark")), allowMissingColumns=True)
    sides = []
    for name, order in (("low", F.col("at").asc()), ("high", F.col("at").desc())):
        w = Window.partitionBy(*keys, x).orderBy(order, F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(f"at_{name}", F.last("mark", True).over(w))
        near = F.col(f"at_{name}")
        taken = lambda c: F.when(c["id"] != own, c["id"]).when(c["next"] != own, c["next"])
        dy = F.abs(F.col("at") - F.when(taken(near).isNotNull(), near["y"]).otherwise(near[name]["y"]))
        who = F.coalesce(taken(near), taken(near[name]))
        sides.append(F.when((dy <= tol) & who.isNotNull(), F.struct((F.col("dx") + dy).alias("err"), who.alias("id"))))
    d = d.filter(own.isNotNull()).withColumn("b", F.least(*sides)).filter("b is not null").groupBy(*keys, own).agg(F.min("b").alias("b"))
    return d.select(*keys, own, F.col("b.id").alias(f"r_{id}"), F.col("b.err").alias("err"))


def nearest_in_order(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str) -> DataFrame:
    """rows with the mark of their key nearest to `at`, of equals the lower; rows of keys without marks are left out. Both
    are sorted once: a row sees the last mark not above it and the first above, never all of its key. marks: keys, mark."""
    both = rows.withColumn("__mark", F.lit(None).cast("double")).withColumn("__at", F.col(at).cast("double"))
    more = marks.select(*keys, F.col(mark).cast("double").alias("__mark"), F.col(mark).cast("double").alias("__at")).distinct()
    d = both.unionByName(more, allowMissingColumns=True)
    for name, order in (("__low", F.col("__at").asc()), ("__high", F.col("__at").desc())):
        w = Window.partitionBy(*keys).orderBy(order, F.col("__mark").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(name, F.last("__mark", True).over(w))
    lower = F.col("__high").isNull() | (F.abs(F.col("__low") - F.col("__at")) <= F.abs(F.col("__high") - F.col("__at")))
    d = d.filter(F.col("__mark").isNull()).withColumn(mark, F.when(lower, F.coalesce("__low", "__high")).otherwise(F.coalesce("__high", "__low")))
    return d.filter(F.col(mark).isNotNull()).drop("__mark", "__at", "__low", "__high")


def covered_by(boxes: DataFrame, regions: DataFrame, keys: Sequence[str], share: float = 0.6, how: str = "left_anti", but: str | None = None) -> DataFrame:
    """Boxes of which no region (left_semi: some region) covers more than a share of the area. but: a column in which
    box and region must differ."""

    def mostly(a: Box, b: Box) -> Column:
        common = F.greatest(a.overlap_x(b), F.lit(0.0)) * F.greatest(a.overlap_y(b), F.lit(0.0))
        most = (a.area > 0) & (common > share * a.area)
        return most & (F.col(f"l_{but}") != F.col(f"r_{but}")) if but else most

    out = range_join(boxes, regions, keys, mostly, how)
    return out.select(*[F.col(c if c in keys else f"l_{c}").alias(c) for c in boxes.columns])


# ---------------------------------------------------------------- gaps and islands


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], starts: Column, name: str) -> DataFrame:
    """Numbers the islands of each key from 0; starts: true where a row begins a new one, over the window `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("__new", F.coalesce(starts, F.lit(False)).cast("int"))
    return marked.withColumn(name, (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("__new")


def baseline_clusters(rows: DataFrame, keys: Sequence[str], y: str, tol, tie: str, name: str = "cluster") -> DataFrame:
    """Single-link clusters of baselines, from the top of the page."""
    order = [F.col(y).desc(), F.col(tie).asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(rows, keys, order, F.lag(y).over(w) - F.col(y) > tol, name)


def vertical_bands(boxes: DataFrame, keys: Sequence[str], gap: float, tie: str, name: str = "band") -> DataFrame:
    """Bands of boxes from the top: a box below the floor of all before it opens a new one. The floor over the whole
    page equals that of the band, because a band lies wholly below those before it."""
    order = [F.col("y1").desc(), F.col("y0").desc(), F.col(tie).asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return islands(boxes, keys, order, F.col("y1") < F.min("y0").over(w) - gap, name)


def horizontal_bands(boxes: DataFrame, keys: Sequence[str], gap: float, tie: str, name: str = "band") -> DataFrame:
    order = [F.col("x0").asc(), F.col("x1").asc(), F.col(tie).asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return islands(boxes, keys, order, F.col("x0") > F.max("x1").over(w) + gap, name)


def merge_spans(spans: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Closed spans that touch or overlap become one. keys, lo, hi."""
    order = [F.col(lo).asc(), F.col(hi).asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = islands(spans, keys, order, F.col(lo) > F.max(hi).over(w), "__span")
    return d.groupBy(*keys, "__span").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__span")


def pair_fences(tokens: DataFrame, keys: Sequence[str], at: str, kind: str) -> DataFrame:
    """Open and close fences that match: an opening at depth d pairs with the next closing back to d.
    kind: 'open', 'close' or other. keys, open_at, close_at."""
    w = Window.partitionBy(*keys).orderBy(at)
    step = F.when(F.col(kind) == "open", 1).when(F.col(kind) == "close", -1).otherwise(0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = tokens.filter(F.col(kind).isin("open", "close")).withColumn("depth", F.sum(step).over(run) + F.when(F.col(kind) == "close", 1).otherwise(0))
    nxt = Window.partitionBy(*keys, "depth").orderBy(at)
    d = d.withColumn("close_at", F.lead(at).over(nxt)).withColumn("next_kind", F.lead(kind).over(nxt))
    return d.filter((F.col(kind) == "open") & (F.col("next_kind") == "close")).select(*keys, F.col(at).alias("open_at"), "close_at")


def pair_neutral(tokens: DataFrame, keys: Sequence[str], at: str, base: str) -> DataFrame:
    """Fences that are their own mirror pair 1-2, 3-4, ... where their number is even. keys, base, open_at, close_at."""
    w = Window.partitionBy(*keys, base).orderBy(at)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, base))
    d = tokens.withColumn("rn", F.row_number().over(w)).withColumn("n", n).withColumn("close_at", F.lead(at).over(w))
    return d.filter((F.col("n") % 2 == 0) & (F.col("rn") % 2 == 1)).select(*keys, base, F.col(at).alias("open_at"), "close_at")
