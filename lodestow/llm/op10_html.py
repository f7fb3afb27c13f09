"""Main text of web pages by minimum-cut labelling of blocks."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose content is no text of the page.
_SKIP = {
    "script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "select", "noembed", "noframes",
    "xmp", "audio", "video", "datalist",
}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_EMPTY = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements, roles and names that speak against the main text, and names that may.
_AGAINST_TAGS = {"nav", "footer", "aside", "button", "menu", "dialog"}
_AGAINST_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar"}
_AGAINST_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "sidebar", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "popup", "newsletter",
    "subscribe", "subscription", "signup", "login", "comment", "comments", "disqus", "pagination", "pager",
}
_LEAN_NAMES = {
    "banner", "promotion", "side", "rail", "widget", "foot", "toolbar", "notice", "modal", "overlay", "reply", "replies", "respond", "discussion", "share",
    "sharing", "social", "related", "recommended", "recommendations", "tags", "copyright", "disclaimer", "skip", "search", "alert",
}
_FOR_NAMES = {"article", "content", "post", "entry", "main", "story", "body", "text"}
#: The last part of a compound name that only says what holds the first: share-buttons, comment-list, cookie-bar.
_HOLDERS = {
    "area", "bar", "block", "blocks", "box", "button", "buttons", "container", "form", "group", "holder", "icons", "inner", "item", "items", "link", "links",
    "list", "panel", "post", "posts", "row", "section", "slot", "strip", "thread", "title", "unit", "wrap", "wrapper", "zone",
}
#: A compound name that begins so says that something is there or not, elsewhere on the page: no-sidebar, has-menu.
_STATES = {"no", "not", "has", "with", "without", "is", "hide", "show", "hidden"}
_CLOSES_P = _BLOCK - {"button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "head"}
#: Capacities in log odds. An element's is so much, and so much more for each of its own blocks.
_HIDDEN, _AGAINST, _FOR, _NAMED, _LEAN, _FORM = (1000.0, 0.0), (8.0, 6.0), (8.0, 2.0), (2.0, 2.0), (0.0, 3.0), (0.0, 1.0)
#: Edges: a block and the element that speaks for it, such an element and the one around it, blocks in a row (less the farther apart in the tree).
_INSIDE, _AROUND, _ROW = 6.0, 6.0, 1.0


def _names(value: str) -> tuple[bool, bool, bool]:
    """Do the words of a class or id speak against, lean against, speak for the main text?"""
    against = lean = good = False
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = re.findall(r"[a-z]+", token)
        if not parts or parts[0] in _STATES:
            continue
        first, last = parts[0], parts[-1]
        held = last in _HOLDERS
        against |= last in _AGAINST_NAMES or (held and first in _AGAINST_NAMES)
        lean |= last in _LEAN_NAMES or (held and first in _LEAN_NAMES)
        good |= last in _FOR_NAMES
    return against, lean, good


class _Node:
    """An element. weight: what it says of its blocks, (at once, for each); of: the nearest element that says something, itself perhaps."""

    __slots__ = ("name", "parent", "weight", "of", "inside", "bad", "own")

    def __init__(self, name: str, attributes: str, parent: _Node | None) -> None:
        self.name, self.parent, self.own = name, parent, 0
        self.inside, self.bad = bool(parent and parent.inside), bool(parent and parent.bad)
        against, lean, good, hidden, role = name in _AGAINST_TAGS, False, False, False, ""
        if attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                value, key = a or b or c, key.lower()
                if key in ("class", "id"):
                    if name not in ("html", "body"):
                        x, y, z = _names(value)
                        against, lean, good = against or x, lean or y, good or z
                elif key == "role":
                    role = value.strip().lower()
                elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    hidden = True
        against |= role in _AGAINST_ROLES or (name == "header" and not self.inside)
        best = name in ("article", "main") or role == "main"
        if hidden:
            at_once, each = _HIDDEN
            self.weight = (-at_once, each)
        elif against and not (best and name == "main"):
            self.weight = (-_AGAINST[0], -_AGAINST[1])
            self.bad = True
        elif best and not self.bad:
            self.weight, self.inside = _FOR, True
        elif lean:
            self.weight = (-_LEAN[0], -_LEAN[1] / (2 if self.inside else 1))
        elif good and not self.bad:
            self.weight = _NAMED
        elif name in ("form", "fieldset"):
            self.weight = (-_FORM[0], -_FORM[1])
        else:
            self.weight = (0.0, 0.0)
        self.of: _Node | None = self if self.weight != (0.0, 0.0) else parent.of if parent else None


def blocks(page: str) -> list[tuple[str, _Node, int]]:
    """(text, element, letters inside links) of each block, in page order. Unclosed and stray tags are borne as browsers do."""
    out: list[tuple[str, _Node, int]] = []
    node, part, linked, link = _Node("html", "", None), [], 0, False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            if text:
                out.append((text, node, linked))
            part.clear()
        linked = 0

    while at < end:
        found = _TAG.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            piece = page[at:stop]
            if not found and (broken := re.search(r"<[/!a-zA-Z][^>]*\Z", piece)):
                piece = piece[: broken.start()]  # the page ends inside a tag
            part.append(piece)
            if link:
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = (found[1] or found[4]) == "/", found[3] or found[6] or ""
        if name in _SKIP and not closing:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == "br":
            part.append(" ")
        elif name == "a":
            link = not closing
        elif name in _BLOCK:
            flush()
            link = False
            if closing:
                up = node
                while up and up.name != name:
                    up = up.parent
                if up and up.parent:
                    node = up.parent
            elif name not in _EMPTY and not (name in ("html", "body") and node.name == name):
                if name in _CLOSES_P and node.name == "p":
                    node = node.parent
                if name in ("li", "dt", "dd", "tr", "td", "th") and node.name in ("p",):
                    node = node.parent
                if node.name == name and name in ("li", "tr", "td", "th", "dt", "dd", "p"):
                    node = node.parent
                if node.name == "head" and name != "head":
                    node = node.parent
                node = _Node(name, attributes, node)
    flush()
    return out


def _score(text: str, node: _Node, linked: int) -> float:
    """Log odds that a block is content, by its words and links alone."""
    words, dense = text.count(" ") + 1, linked / max(1, len(text))
    score = -1.0 + min(words, 40) / 10 - 5 * dense
    if node.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 1.0
    if node.name == "li" and dense > 0.5:
        score -= 2.0
    if re.search(r"[.!?…。](?:[\"')\]]*)$", text):
        score += 1.0
    return score


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut: the source's arc to a node carries its score above 0, the
    sink's arc its score below 0, edges carry their weight both ways. Dinic's algorithm without recursion."""
    n = len(scores)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, s in enumerate(scores):
        if s > 0:
            arc(source, k, s, 0.0)
        elif s < 0:
            arc(k, sink, -s, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for u in queue:
            for e in out[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        tried, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                tried[u] += 1
            else:
                if u == source:
                    break
                u = to[path.pop() ^ 1]
                tried[u] += 1


def network(found: list[tuple[str, _Node, int]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores and edges of the graph: first the blocks, then the elements that say something of them.

    Blocks have the capacities of their text, elements those of their kind and names. A block is joined to the nearest such element
    around it, an element to the next one around it, and blocks in a row to each other.
    """
    scores, edges = [_score(*b) for b in found], []
    number: dict[int, int] = {}
    elements: list[_Node] = []
    for k, (_, node, _) in enumerate(found):
        inner, at = k, node.of
        if at:
            at.own += 1
        strength = _INSIDE
        while at:
            new = id(at) not in number
            if new:
                number[id(at)] = len(found) + len(elements)
                elements.append(at)
            edges.append((inner, number[id(at)], strength))
            if not new:
                break
            inner, at = number[id(at)], at.parent.of if at.parent else None
            strength = _AROUND if at and at.weight[0] else _AROUND / 6  # what merely leans holds nothing together
        if k:
            before = found[k - 1][1]
            near = before is node or before.parent is node.parent
            edges.append((k - 1, k, _ROW if near else _ROW / 2 if before.parent and node.parent and before.parent.parent is node.parent.parent else _ROW / 8))
    scores += [e.weight[0] + e.own * e.weight[1] for e in elements]
    return scores, edges


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kept = min_cut(*network(found))
    return "\n".join(b[0] for b, yes in zip(found, kept, strict=False) if yes)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([main_text(page) for page in batch.column("html").to_pylist()], pa.string())
        yield pa.record_batch([batch.column("rest"), text], names=["rest", "text"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (a column of pages of such a name is replaced).

    Each block (paragraph, heading, list item, cell ...) is a node, and so is each element whose kind or names say something.
    A classifier's costs are the arcs to the terminals: of a block by its words and links, of an element by its kind and names. Edges join
    a block to such an element around it, these to one another up the tree, and neighbours on the page. The minimum cut labels all;
    blocks on the source's side are the text. So a menu's long line goes with its menu, an article's short line stays with its article,
    and a name that merely leans against yields to enough text.

    Null or empty html, or a page without content: an empty text. Unclosed tags and cut-off pages are read as far as they go.
    Rows that repeat are extracted each. Empty table: no rows.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")] or [html_col]
    rows = pages.select(F.struct(*others).alias("rest"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_extract, f"rest {rows.schema['rest'].dataType.simpleString()}, text string")
    return out.select("rest.*", "text").withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
