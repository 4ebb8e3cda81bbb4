"""Main text of web pages by composite text density.

A tolerant one-pass scanner builds the element tree.  Each node gets its
characters per tag, adjusted for link characters and link tags; the node whose
children's densities sum highest holds the main text, and the least density on
its path from the body is the threshold for what else belongs to it.  Elements
that are never main text by their tag, role or class words are left out of it,
but count in the densities of what surrounds them.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

# Elements by kind, and words in class, id and role that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul head".split()
)
NOISE = frozenset("nav header footer aside form script style noscript template button select option input textarea label fieldset iframe object svg canvas audio video dialog menu head title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations pagination pager toolbar login search skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES = {  # a start tag ends these open elements first
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "block", "noise", "weak", "chars", "links", "tags", "link_tags", "free", "density", "total", "kids", "inlink", "kept", "own")

    def __init__(self, tag: str, parent):
        self.tag, self.parent = tag, parent
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.noise = self.weak = self.kept = self.own = False
        self.free = self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.kids: list[Node] = []
        self.inlink = tag == "a" or bool(parent and parent.inlink)
        if parent:
            parent.kids.append(self)


def _marks(node: Node, attributes: str) -> None:
    """Sets noise from an element's attributes."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words = set(WORD.findall(value))
            if words & COMMENT_WORDS:
                node.noise = True
            elif words & NOISE_WORDS and node.tag not in ("html", "body", "article", "main"):
                node.noise = node.weak = True
        elif name == "role" and value in NOISE_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            node.noise = True
        elif name == "hidden" and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes.lower()):
            node.noise = True


def parse(page: str) -> tuple[Node, list[Node], list[tuple[Node, str]]]:
    """Root, nodes in page order, and (node, text) blocks with their white space as one space.

    Where each open element stands is kept by tag, so that the time is linear in the page.
    """
    root = Node("html", None)
    nodes, blocks, stack, at, parts, holder = [root], [], [root], 0, [], [root]
    opened: dict[str, list[int]] = {}

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append((holder[0], text))
            parts.clear()

    def add(raw: str) -> None:
        if not parts:
            holder[0] = stack[-1].block
        parts.append(raw)

    def text(raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = unescape(raw)
            add(raw)
            n = len(raw.strip())
            stack[-1].chars += n
            if stack[-1].inlink:
                stack[-1].links += n

    def push(node: Node) -> None:
        opened.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag].pop()
        del stack[i:]

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(tags, scope=()) -> None:
        if (i := last(tags)) > last(scope):
            cut(i)

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        block = name in BLOCK
        if name == "br":
            add(" ")
            stack[-1].tags += 1
            continue
        if block:
            flush()
        if ends:
            close((name,))
            continue
        if block:
            close(("p",), ("article", "section", "div", "td", "li", "blockquote", "body"))
        if name in CLOSES:
            while len(stack) > 1 and stack[-1].tag in CLOSES[name]:
                cut(len(stack) - 1)
            close(CLOSES[name], SCOPES.get(name, ()))
        if name == "html" or name == "body" and opened.get("body"):
            continue
        node = Node(name, stack[-1])
        nodes.append(node)
        node.noise = name in NOISE
        if attributes:
            _marks(node, attributes)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            node.noise = True
            if end:
                push(node)
        elif name not in VOID and not attributes.endswith("/") or block and name != "hr":
            push(node)
    text(page[at:])
    flush()
    return root, nodes, blocks


def density(n: Node, body_links: float) -> float:
    """Composite text density: characters per tag, raised for text with few links."""
    if not n.chars:
        return 0.0
    tags, links, link_tags = max(n.tags, 1), max(n.links, 1), max(n.link_tags, 1)
    base = log(n.chars / max(n.chars - n.links, 1) * n.links + body_links * n.chars + e)
    ratio = n.chars / links * tags / link_tags
    return n.chars / tags * log(max(ratio, 1.0) + 1) / log(base + 1)  # the ones keep both logarithms off zero


def _settle_noise(nodes: list[Node]) -> None:
    """Noise covers what is inside it; a weak mark doesn't take the page's article with it."""
    holds = set()
    for n in reversed(nodes):
        if n.parent is not None and (id(n) in holds or n.tag in ("article", "main") and not n.noise):
            holds.add(id(n.parent))
    for n in nodes:
        if n.weak and id(n) in holds:
            n.noise = False
        if n.parent is not None and n.parent.noise:
            n.noise = True


def _search_in(nodes: list[Node], body: Node) -> Node:
    """The page's only article or main element with a fourth of its text or more; else the body."""
    inner, found = set(), []
    for n in nodes:
        if id(n.parent) in inner:
            inner.add(id(n))
        elif n.tag in ("article", "main") and not n.noise and n.free:
            inner.add(id(n))
            found.append(n)
    return found[0] if len(found) == 1 and 4 * found[0].free >= body.free else body


def choose(nodes: list[Node], root: Node) -> None:
    """Sets `kept` on the nodes whose whole subtrees, less noise, are the main text, and on headings of these;
    `own` on nodes of the article whose own text, outside their children, belongs to it.

    Every node's density counts its whole subtree, noise included, so that a body full of menus has a low
    one.  A node's density sum adds its children's, noise left out; a node without blocks inside stands
    for itself.  The node of the greatest sum is kept, and the least density on its path up to the body
    is the threshold: wherever all densities from the top down reach it, the greatest sum below is kept too.
    """
    _settle_noise(nodes)
    for n in nodes:
        n.free = 0 if n.noise else n.chars
    for n in reversed(nodes):
        if n.parent is not None and n.tag not in RAW and n.tag != "head":
            p = n.parent
            p.free += n.free
            p.chars += n.chars
            p.links += n.links
            p.tags += n.tags + 1
            p.link_tags += n.link_tags + (n.tag == "a")
    body = next((n for n in nodes if n.tag == "body" and n.chars), root)
    top = _search_in(nodes, body)
    share = body.links / body.chars if body.chars else 0.0
    divided = {id(n.parent) for n in nodes if n.tag in BLOCK}
    for n in nodes:
        n.density = density(n, share)
        n.total = n.density if id(n) not in divided else 0.0
    for n in nodes:
        if not n.noise and n.parent is not None and id(n.parent) in divided:
            n.parent.total += n.density
    best: dict[int, Node] = {}  # of each subtree's blocks the one with the greatest sum, of equals the outermost
    for n in reversed(nodes):
        if n.noise:
            continue
        if n.tag in BLOCK and (id(n) not in best or n.total >= best[id(n)].total):
            best[id(n)] = n
        # siblings come last to first here: an earlier one wins among equals
        if n.parent is not None and id(n) in best and (id(n.parent) not in best or best[id(n)].total >= best[id(n.parent)].total):
            best[id(n.parent)] = best[id(n)]
    if id(top) not in best:
        return
    least, up = best[id(top)].density, best[id(top)]
    while up is not None and up is not body.parent:
        least, up = min(least, up.density), up.parent
    passed, ask = [], [top]
    while ask:
        n = ask.pop()
        if not n.noise and n.chars and n.density >= least and id(n) in best:
            best[id(n)].kept = True
            passed.append(n)
            ask += n.kids
    holds = set()
    for n in reversed(nodes):
        if n.kept:
            holds.add(id(n))
        if id(n) in holds and n.parent is not None:
            holds.add(id(n.parent))
    for n in passed:  # a heading goes with the kept text that follows it
        waiting: list[Node] = []
        for k in n.kids:
            if k.tag in HEADINGS and not k.noise and not k.kept:
                waiting.append(k)
            elif id(k) in holds:
                for h in waiting:
                    h.kept = True
                waiting = []
    if top is not body:
        for n in passed:
            n.own = True


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by empty lines; empty if there are none."""
    if not page:
        return ""
    root, nodes, blocks = parse(page)
    choose(nodes, root)
    inside = set()
    for n in nodes:
        if not n.noise and (n.kept or id(n.parent) in inside):
            inside.add(id(n))
    return "\n\n".join(text for node, text in blocks if id(node) in inside or node.own)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null, empty and blank pages, and pages of noise only, give an empty text.
    Pages of any length are read whole.  Rows are taken one by one: repeats give
    repeats, other columns are not read, an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
            )

    small_batches(df.sparkSession)
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
