"""Main text of web pages by a graphical model on the tree of page elements.

A page is parsed to a tree whose nodes are its block elements; inline elements belong to the block around them. Every
node has a hidden state, content or not. Hashed features of a node (its tag, names in class, id and role, tags above
it, length, link share and marks of its own text, place in the page) add up to a log odds; a 2 x 2 table of
parent-child potentials joins each node to its parent. Sum-product messages, first from the leaves up, then from the root
down, give every node's exact marginal, and the text of nodes with a marginal of at least one half is the main text.
All trees of a batch pass messages together, one numpy step for each depth.

Weights and potentials are trained by exact likelihood (gradient: observed minus expected counts, from the same
messages) on labelled pages made from templates, see pages. Script, style and the like are never text; where one of them
other than script and style has no end tag, only its start tag is left out.

Pages are read by the states of HTML's own tokenizer, in linear time: quotes, slashes and letter case in tags, comments,
elements of raw text, a tag that the page's end cuts off. One thing differs: a quote that nothing on the rest of the page
closes does not swallow the page but belongs to a value without quotes.

Null html counts as empty, which gives an empty text. Pages without any content node give an empty text. White space
inside a block (Unicode white space, br too) becomes one space, empty blocks vanish, blocks are joined in page order.
Rows that repeat stay, null page_id and url too; an empty table gives an empty result. Further columns are ignored,
also if they are named like outputs.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages, scratch

BITS = 14
# Element names as HTML defines their roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("noscript template svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: A start of the key ends an open element of the value, unless one of the stops stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
# The white space of HTML's syntax.
_WS = "\\t\\n\\f\\r "
_SKIP = re.compile(f"[{_WS}/]*")
_TAG_NAME = re.compile(f"[A-Za-z][^{_WS}/>]*")
_ATTRIBUTE = re.compile(f"(=?[^{_WS}/>=]*)(?:[{_WS}]*(=)[{_WS}]*)?")
_BARE = re.compile(f"[^{_WS}>]*")
_EMPTY_COMMENT, _COMMENT_END = re.compile("!---?>"), re.compile("--!?>")
NAME = re.compile(r"[a-z]+")
WANTED = frozenset(("class", "id", "role", "data-label"))
#: Elements whose content is characters up to their end tag: never text, and text.
TO_END = frozenset(("script", "style"))
RAW_TEXT, PLAIN_TEXT = frozenset("script style iframe noembed noframes xmp".split()), frozenset(("title", "textarea"))


class Source:
    """A page read from left to right. Searches that failed once are not made again, so any page takes linear time."""

    def __init__(self, text: str):
        self.text, self.absent, self.closed = text, set(), {}

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        out = self.text.find(what, at)
        if out < 0:
            self.absent.add(what)
        return out

    def tag(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """End of the tag whose name ends at this place (-1: the page ends first), wanted attributes, a slash at its end.

        A quote that nothing closes on the rest of the page is part of a value without quotes.
        """
        text, out = self.text, []
        if self.find(">", at) < 0:
            return -1, out, False
        while True:
            at = _SKIP.match(text, at).end()
            if at >= len(text):
                return -1, out, False
            if text[at] == ">":
                return at + 1, out, text[at - 1] == "/"
            m = _ATTRIBUTE.match(text, at)
            at, value = m.end(), ""
            if m[2]:
                quote = text[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end < 0:
                    end = _BARE.match(text, at).end()
                    value, at = text[at:end], end
                else:
                    value, at = text[at + 1 : end], end + 1
            if m[1].lower() in WANTED:
                out.append((m[1].lower(), value))

    def end_of(self, tag: str, at: int) -> tuple[int, int] | None:
        """Start and end of the first end tag of this name."""
        if tag in self.absent:
            return None
        m = _end_tag(tag).search(self.text, at)
        if not m:
            self.absent.add(tag)
            return None
        end = self.text.find(">", m.end())
        return m.start(), end + 1 if end >= 0 else len(self.text)

    def closing(self, tag: str, start: int) -> int | None:
        """End of the element of this name that starts here; elements of one name nest."""
        if tag not in self.closed:
            pairs, open_ = {}, []
            for m in _either_tag(tag).finditer(self.text):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    end = self.text.find(">", m.end())
                    pairs[open_.pop()] = end + 1 if end >= 0 else len(self.text)
            self.closed[tag] = pairs
        return self.closed[tag].get(start)


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[{_WS}/>]|\\Z)", re.I | re.A)


@lru_cache(maxsize=64)
def _either_tag(tag: str) -> re.Pattern:
    return re.compile(f"<(/?){tag}(?=[{_WS}/>])", re.I | re.A)


class Node:
    __slots__ = ("tag", "parent", "depth", "names", "label", "text", "linked", "own")

    def __init__(self, tag: str, parent: int, depth: int, names: list[str], label: int):
        self.tag, self.parent, self.depth, self.names, self.label = tag, parent, depth, names, label
        self.text, self.linked, self.own = 0, 0, 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents before children, and the blocks of text in page order with their node."""
    nodes, blocks = [Node("#root", -1, 0, [], -1)], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # tag, node (an inline element has its block's)
    # Where each name stands on the stack, and where blocks do: no tag makes a search of the stack.
    opened: defaultdict[str, list[int]] = defaultdict(list)
    solid = [0]
    parts: list[str] = []
    source, at = Source(page), 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.text += len(text)
                node.own += 1
                blocks.append((stack[-1][1], text))

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if opened["a"]:
                nodes[stack[-1][1]].linked += len(text)

    def pop(to: int) -> None:
        if solid[-1] >= to:
            flush()
        while solid[-1] >= to:
            solid.pop()
        for tag, _ in stack[to:]:
            opened[tag].pop()
        del stack[to:]

    def push(tag: str, node: int) -> None:
        opened[tag].append(len(stack))
        if tag not in INLINE:
            solid.append(len(stack))
        stack.append((tag, node))

    def last(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def end(tags: set[str], stops: set[str]) -> None:
        at = last(tags)
        if at > last(stops):
            pop(at)

    def block(tag: str, attributes: list[tuple[str, str]]) -> int:
        flush()
        names, label = [], -1
        for name, value in attributes:
            if name == "data-label":
                label = int(value) if value in ("0", "1") else -1
            else:
                names += NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
        nodes.append(Node(tag, stack[-1][1], nodes[stack[-1][1]].depth + 1, names, label))
        return len(nodes) - 1

    n = len(page)
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        at, mark = begin + 1, page[begin + 1 : begin + 2]
        if mark == "!" or mark == "?":
            if page.startswith("!--", at):
                m = _EMPTY_COMMENT.match(page, at) or _COMMENT_END.search(page, at + 3)
                at = m.end() if m else n
            else:
                close = source.find(">", at)
                at = close + 1 if close >= 0 else n
            continue
        closing = mark == "/"
        m = _TAG_NAME.match(page, at + closing)
        if not m:
            if closing and at + 1 < n:
                # "</>" and the like are comments.
                close = source.find(">", at)
                at = close + 1 if close >= 0 else n
            else:
                parts.append("<")
            continue
        tag = m[0].lower()
        at, attributes, slash = source.tag(m.end())
        if at < 0:
            break  # the page ends in a tag
        if closing:
            if tag in ("br", "p") and not opened[tag]:
                continue
            # An inline end tag does not reach out of its block.
            if opened[tag] and (tag not in INLINE or opened[tag][-1] > solid[-1]):
                pop(opened[tag][-1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW_TEXT:
            place = source.end_of(tag, at)
            if place:
                at = place[1]
            elif tag in TO_END:
                break
            continue
        if tag in RAW:
            if not (slash and tag in ("svg", "math")):
                at = source.closing(tag, begin) or at
            continue
        if tag in CLOSES_P:
            end({"p"}, {"table", "button", "td", "th", "blockquote", "div", "article", "section", "li", "body"} - {tag} if tag != "p" else {"table", "button"})
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in PLAIN_TEXT and (place := source.end_of(tag, at)):
            push(tag, block(tag, attributes))
            say(page[at : place[0]])
            pop(len(stack) - 1)
            at = place[1]
        elif tag in INLINE:
            if tag not in VOID:
                push(tag, stack[-1][1])
        else:
            node = block(tag, attributes)
            if tag not in VOID:
                push(tag, node)
    flush()
    return nodes, blocks


@lru_cache(maxsize=1 << 16)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(nodes: list[Node]) -> list[list[int]]:
    out = []
    above: list[tuple[str, ...]] = []
    n = len(nodes)
    for k, x in enumerate(nodes):
        up = nodes[x.parent] if x.parent >= 0 else None
        chain = (*above[x.parent][-2:], up.tag) if up else ()
        above.append(chain)
        f = ["bias", "t:" + x.tag, "d:" + str(min(x.depth, 6))]
        if up:
            f += ["p:" + up.tag, "pt:" + up.tag + ">" + x.tag]
        f += ["c:" + c for c in x.names]
        if x.names:
            f.append("named")
        f.append("l:" + str(min(x.text, 4000).bit_length()))
        if x.text:
            f.append("a:" + str(min(4, 4 * x.linked // x.text)) + x.tag)
        out.append([_feature(s) for s in f] + [_feature("w:" + str(4 * k // n))])
    return out


class Forest:
    """The trees of many pages as arrays, level by level."""

    def __init__(self, trees: list[list[Node]]):
        base = np.cumsum([0, *(len(t) for t in trees)])
        self.parent = np.array([x.parent + b if x.parent >= 0 else -1 for t, b in zip(trees, base) for x in t], np.int64)
        depth = np.array([x.depth for t in trees for x in t], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        rows = [f for t in trees for f in features(t)]
        self.counts = np.array([len(f) for f in rows], np.int64)
        self.ids = np.fromiter((i for f in rows for i in f), np.int64, int(self.counts.sum()))
        self.begin = np.cumsum(self.counts) - self.counts

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and for each node with a parent the expected table (parent state, own state)."""
        n = len(self.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = np.add.reduceat(w[self.ids], self.begin)
        below = np.zeros((n, 2))  # messages from all children
        up = np.zeros((n, 2))  # message to the parent
        for level in self.levels[:0:-1]:
            own = (unary[level] + below[level])[:, None, :] + pair[None]
            m = np.logaddexp(own[:, :, 0], own[:, :, 1])
            m -= m.max(axis=1, keepdims=True)
            up[level] = m
            for s in (0, 1):
                below[:, s] += np.bincount(self.parent[level], m[:, s], n) if len(level) * 8 > n else 0
            if len(level) * 8 <= n:
                np.add.at(below, self.parent[level], m)
        down = np.zeros((n, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = (unary[p] + below[p] - up[level] + down[p])[:, :, None] + pair[None]
            m = np.logaddexp(rest[:, 0], rest[:, 1])
            down[level] = m - m.max(axis=1, keepdims=True)
        belief = unary + below + down
        p1 = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40)))
        has = np.flatnonzero(self.parent >= 0)
        up_p = self.parent[has]
        joint = (unary[up_p] + below[up_p] - up[has] + down[up_p])[:, :, None] + pair[None] + (unary[has] + below[has])[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        return p1, joint / joint.sum(axis=(1, 2), keepdims=True)


@lru_cache(maxsize=1)
def train(n_pages: int = 700, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and parent-child potentials by exact likelihood on made pages; the same in every process."""
    forest_nodes = [parse(p)[0] for p in pages.labelled(n_pages)]
    for t in forest_nodes:
        for x in t:
            if x.label < 0:
                x.label = t[x.parent].label if x.parent >= 0 else 1
    forest = Forest(forest_nodes)
    y = np.array([x.label for t in forest_nodes for x in t], float)
    has = np.flatnonzero(forest.parent >= 0)
    seen = np.bincount((2 * y[forest.parent[has]] + y[has]).astype(int), minlength=4).reshape(2, 2)
    k = 1 << BITS
    p = np.zeros(k + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        p1, joint = forest.marginals(p[:k], p[k:].reshape(2, 2))
        g = np.concatenate([np.bincount(forest.ids, np.repeat(y - p1, forest.counts), k), (seen - joint.sum(axis=0)).ravel()]) / n_pages - decay * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:k], p[k:].reshape(2, 2)


def main_texts(sources: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    parsed = [parse(s or "") for s in sources]
    if not parsed:
        return []
    p1, _ = Forest([t for t, _ in parsed]).marginals(*model)
    out, base = [], 0
    for nodes, blocks in parsed:
        out.append(" ".join(text for k, text in blocks if p1[base + k] >= 0.5))
        base += len(nodes)
    return out


def extract(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of docs (page_id, url, html)."""
    spark = docs.sparkSession
    scratch.ship(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = docs.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
