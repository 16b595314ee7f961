"""Main text of HTML pages by minimum-cut labelling.

A page becomes a network. Its nodes are the text blocks in page order and the elements that hold them. A block's
capacities to the terminals are the costs of a classifier, the log odds of a logistic regression on the shape of its text
alone (length, punctuation, links, digits, place); it is trained on a bounded sample of this table's own blocks that lie in
seeds, so features and labels come from different things. Seeds are elements whose name or class leaves no doubt: they are
terminals themselves, as in interactive segmentation. Words that only hint give an element a cost. Blocks are tied to their
seed, blocks and silent elements to the element that holds them (DOM proximity), and blocks to the next in page order
(adjacency). The minimum cut, found by maximum flow over all blocks, is the cheapest labelling: it turns the short paragraph of an article,
and the long sentence of an advert, against their own shape. n_turned counts the blocks that it labels against their own cost.

Null html gives an empty text; a page without content blocks likewise; repeated pages are treated alike;
empty tables give empty tables; other columns are ignored. A page is parsed whole, in linear time: open elements are
found by name, without scans of the stack.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.common import quoted, small_batches, text_slices
from inkfield.llm.flow import EPS, max_flow

#: Bound of the classifier's sample: pages, and blocks of one page (evenly spread over it).
TRAIN_PAGES, TRAIN_BLOCKS = 1500, 60
#: Weights of the ties between neighbours in page order and between a block or silent element and what holds it.
NEXT_TIE, HOLD_TIE = 0.5, 6.0
#: The text shape moves the log odds by so much at most.
SHAPE_LIMIT = 4.0
#: Cost of cutting a seed off its terminal: more than all ties of a page.
SEED = 1e9

RAW = frozenset(("script", "style", "textarea", "template", "noscript", "iframe", "title", "svg", "object", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key ends an open element of the values, as far as the nearest of the limits.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table div article section body main".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Elements that are seeds of content and of boilerplate (header: outside articles), and costs of those that only hint.
GOOD_TAGS = frozenset(("article", "main"))
BAD_TAGS = frozenset("nav footer aside form header menu dialog button select".split())
HINT_TAGS = {"label": -6.0, "address": -3.0}
#: Words of class, id or role that make an element a seed of boilerplate, and those that hint at content.
BAD_WORDS = re.compile(
    r"\b(?:nav\w*|menu\w*|side ?bar\w*|ad|ads|adv\w*|adsense|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay\w*"
    r"|newsletter\w*|subscri\w*|promo\w*|sponsor\w*|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|breadcrumb\w*|pag(?:er|ination)\w*"
    r"|comment\w*|repl(?:y|ies)|disqus\w*|respond|footer\w*|header\w*|masthead\w*|copyright\w*|widget\w*|toolbar\w*|login\w*|signup\w*|search\w*"
    r"|form|toc|skip\w*|hidden|complementary|contentinfo|navigation|dialog)\b"
)
GOOD_WORDS = re.compile(r"\b(?:article\w*|content\w*|main|post|entry|story|body|text)\b")
GOOD_ODDS = 3.0
#: Elements whose class words describe the whole page, not what they hold; and those that hold all of it.
FRAMES = frozenset(("html", "body", "article", "main"))
ROOTS = frozenset(("", "html", "body"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
N_SHAPE = 10


class Element:
    """What holds blocks: up is the element that holds it; seed 1 content, -1 boilerplate, 0 neither; odds of its words."""

    __slots__ = ("tag", "up", "seed", "odds", "within")

    def __init__(self, tag: str, up: "Element | None", seed: int, odds: float):
        self.tag, self.up, self.seed, self.odds = tag, up, seed, odds
        self.within: Element | None = self if seed else up.within if up else None  # the nearest seed

    @property
    def inside(self) -> int:
        return self.within.seed if self.within else 0


class Block:
    __slots__ = ("text", "holder", "linked", "size")

    def __init__(self, text: str, holder: Element, linked: int, size: int):
        self.text, self.holder, self.linked, self.size = text, holder, linked, size


def _evidence(tag: str, attrs: str, in_article: bool) -> tuple[int, float]:
    """(seed, odds) that an element brings by itself."""
    seed = 1 if tag in GOOD_TAGS else -1 if tag in BAD_TAGS and not (tag == "header" and in_article) else 0
    odds = HINT_TAGS.get(tag, 0.0)
    if attrs:
        words = " ".join(a or b or c for _, a, b, c in ATTR.findall(attrs))
        if words and tag in FRAMES:
            if tag == "article" and "comment" in words.lower().split():
                seed = -1
        elif words:
            words = re.sub(r"[^a-z0-9]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", words).lower())
            if BAD_WORDS.search(words):
                seed = -1
            elif GOOD_WORDS.search(words):
                odds += GOOD_ODDS
        if HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: m[0] if ":" in m[0] else '""' if "true" not in m[0] else m[0], attrs)):
            seed = -1
    return seed, odds


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; white space is one space, character references are decoded."""
    out: list[Block] = []
    root = Element("", None, 0, 0.0)
    stack: list[tuple[str, Element]] = [("", root)]  # an open tag, and the block-level element it is or is in
    where: dict[str, list[int]] = defaultdict(list)  # places of each open tag in the stack
    solid = [0]  # places of block-level elements
    parts: list[str] = []
    linked = total = pos = 0
    head = False

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, stack[-1][1], linked, total))
        linked = total = 0

    def pop_to(k: int):
        while len(stack) > k:
            where[stack.pop()[0]].pop()
        while solid[-1] >= k:
            solid.pop()

    search, size, last = TOKEN.search, len(page), page.rfind(">")
    while pos < size:
        m = search(page, pos) if pos <= last else None
        stop = m.start() if m else size
        if m is None:  # no tag ends any more; a comment may still begin
            at = page.find("<!--", pos)
            stop = at if at >= 0 else size
        if stop > pos and not head:
            s = page[pos:stop]
            if "&" in s:
                s = _html.unescape(s)
            parts.append(s)
            n = len(s.strip())
            total += n
            if where["a"]:
                linked += n
        if not m:
            break
        pos = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "head":
                head = False
            open_ = where[tag]
            if tag not in INLINE:
                flush()
                if open_:
                    pop_to(open_[-1])
            elif open_ and open_[-1] > solid[-1]:
                pop_to(open_[-1])
            elif tag == "a" and open_:
                for k in open_:
                    stack[k] = ("", stack[k][1])
                where[""] += open_
                open_.clear()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos) if not attrs.endswith("/") else None
            pos = end.end() if end else pos if attrs.endswith("/") else size
            parts.append(" ")
            continue
        if tag == "head":
            head = True
            continue
        if tag == "body":
            head = False
        if tag == "br" or tag in VOID:
            if tag not in INLINE:
                flush()
            else:
                parts.append(" " if tag != "wbr" else "")
            continue
        if tag in INLINE:
            where[tag].append(len(stack))
            stack.append((tag, stack[-1][1]))
            continue
        flush()
        if tag in ENDS_P and stack[solid[-1]][0] == "p":
            pop_to(solid[-1])
        if tag in CLOSES:
            at = max((where[t][-1] for t in CLOSES[tag] if where[t]), default=0)
            if at > max((where[t][-1] for t in LIMITS if where[t]), default=0):
                pop_to(at)
        up = stack[-1][1]
        seed, odds = _evidence(tag, attrs, bool(where["article"]))
        if up.inside < 0:  # nothing inside boilerplate is content again
            seed, odds = min(seed, 0), min(odds, 0.0)
        where[tag].append(len(stack))
        solid.append(len(stack))
        stack.append((tag, Element(tag, up, seed, odds)))
    flush()
    return out


def shape(b: Block, k: int, n: int) -> list[float]:
    """What the text of a block looks like, whatever holds it, and its place among the n blocks of the page."""
    t, size = b.text, len(b.text)
    words = t.count(" ") + 1
    return [
        1.0, math.log1p(size) / 4 - 1, min(1.0, b.linked / max(1, b.size)), t[-1] in ".!?…。”\"", min(1.0, 10 * sum(map(t.count, ".,;:!?")) / size),
        min(1.0, 5 * sum(map(str.isdigit, t)) / size), words <= 3, min(2.0, size / words / 6), k / n, "©" in t,
    ]


#: Without a sample of both kinds: long, punctuated, unlinked text is content.
DEFAULT_SHAPE = [0.0, 1.5, -4.0, 1.0, 1.0, -1.0, -1.0, 0.0, 0.0, -4.0]


def train(rows: np.ndarray, good: np.ndarray, steps: int = 300) -> list[float]:
    """Logistic regression, both kinds weighing the same, with a small ridge."""
    if not len(good) or good.all() or not good.any():
        return DEFAULT_SHAPE
    each = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
    w, step = np.zeros(rows.shape[1]), 4.0 / max(1e-9, np.linalg.norm(rows * np.sqrt(each)[:, None], 2) ** 2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w -= step * (rows.T @ (each * (p - good)) + 1e-3 * w)
    return w.tolist()


def min_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: odds[i] lost where i isn't content though positive, or is though negative;
    a tie's weight lost where its ends differ. Undecided nodes (equal cost) are content. Seeds are part of the terminals."""
    # capacities: what a node may take from the source, or give to the sink, in one signed number
    free = [0.0 if abs(o) >= SEED else o for o in odds]
    near: list[list[int]] = [[] for _ in odds]  # edges of a node; edge k ends in head[k], and k ^ 1 is its other direction
    head: list[int] = []
    room: list[float] = []
    for a, b, w in ties:
        if abs(odds[a]) >= SEED:
            a, b = b, a
        if abs(odds[a]) >= SEED:
            continue
        if abs(odds[b]) >= SEED:
            free[a] += w if odds[b] > 0 else -w
        else:
            near[a].append(len(head))
            near[b].append(len(head) + 1)
            head += (b, a)
            room += (w, w)
    max_flow(free, near, head, room)
    # content: all from which the sink cannot be reached any more
    back = [i for i, c in enumerate(free) if c < -EPS]
    cut = set(back)
    while back:
        for k in near[back.pop()]:
            if room[k ^ 1] > EPS and head[k] not in cut:
                cut.add(head[k])
                back.append(head[k])
    return [odds[i] > 0 if abs(odds[i]) >= SEED else i not in cut for i in range(len(odds))]


def network(blocks: list[Block], weights: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(odds, ties) of the nodes: the blocks, then the elements that hold them. A block is tied to its seed and to what
    holds it, a silent element to what holds it. One that holds a single node is left out, and so are the frames of the
    page, which say nothing of what they hold."""
    n, ties = len(blocks), [(k - 1, k, NEXT_TIE) for k in range(1, len(blocks))]
    odds = [max(-SHAPE_LIMIT, min(SHAPE_LIMIT, sum(w * f for w, f in zip(weights, shape(b, k, n))))) for k, b in enumerate(blocks)]
    kids: dict[Element, int] = defaultdict(int)
    for b in blocks:
        e: Element | None = b.holder
        while e is not None:
            kids[e] += 1
            e = e.up if kids[e] == 1 and not e.seed else None
    place: dict[Element, int | None] = {}
    todo: list[Element] = []

    def node(e: Element | None) -> int | None:
        """The nearest element that is a node of the network."""
        skipped = []
        while e is not None and e not in place:
            if e.tag in ROOTS and not e.seed:
                place[e] = None
            elif e.seed or e.odds or kids[e] > 1:
                place[e] = len(odds)
                odds.append(SEED * e.seed or e.odds)
                if not e.seed:
                    todo.append(e)
            else:
                skipped.append(e)
                e = e.up
        at = place[e] if e is not None else None
        for x in skipped:
            place[x] = at
        return at

    for k, b in enumerate(blocks):
        for at in {node(b.holder), node(b.holder.within)}:
            if at is not None:
                ties.append((k, at, HOLD_TIE))
    while todo:
        e = todo.pop()
        at = node(e.up)
        if at is not None:
            ties.append((place[e], at, HOLD_TIE))  # type: ignore[arg-type]
    return odds, ties


def content(page: str | None, weights: list[float]) -> tuple[str, int, int, int]:
    """(main text, blocks, blocks kept, blocks that the cut labels against their own cost) of a page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return "", 0, 0, 0
    odds, ties = network(blocks, weights)
    label = min_cut(odds, ties)
    kept = [b.text for b, on in zip(blocks, label) if on]
    return "\n".join(kept), len(blocks), len(kept), sum((o >= 0) != on for o, on in zip(odds[: len(blocks)], label))


def sample_weights(pages: DataFrame, page_id: str, html: str) -> list[float]:
    """Trains the shape classifier on at most TRAIN_BLOCKS blocks in seeds of each of at most TRAIN_PAGES pages, the first by
    a hash of page_id."""
    named = pages.select(F.col(quoted(page_id)).alias("id"), F.col(quoted(html)).alias("html")).filter("id is not null")
    ids = named.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_PAGES)
    # of rows that repeat a page_id one is read
    some = named.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html")).select("html")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            rows, good = [], []
            for page in b.column("html").to_pylist():
                blocks = blocks_of(page) if page else []
                for k in range(0, len(blocks), max(1, -(-len(blocks) // TRAIN_BLOCKS))):
                    if blocks[k].holder.inside:
                        rows.append(np.array(shape(blocks[k], k, len(blocks)), np.float32).tobytes())
                        good.append(blocks[k].holder.inside > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(good, pa.bool_())], names=["x", "good"])

    got = some.mapInArrow(task, "x binary, good boolean").orderBy("x", "good").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_SHAPE).astype(float)
    return train(x, np.array(got.column("good").to_pylist(), bool))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", weights: list[float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept, n_turned of every page."""
    small_batches(pages.sparkSession)
    w = weights or sample_weights(pages, page_id, html)
    counts = ("n_blocks", "n_kept", "n_turned")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            texts, *numbers = zip(*[content(p, w) for p in b.column("html").to_pylist()])
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), *[pa.array(c, pa.int64()) for c in numbers]]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *columns], names=["page_id", "url", "text", "n_chars", *counts])

    named = pages.select(F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).alias("url"), F.col(quoted(html)).alias("html"))
    kind = named.schema["page_id"].dataType.simpleString()
    return named.mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long, {', '.join(f'{c} long' for c in counts)}")
