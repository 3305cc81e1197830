"""A lenient reader of HTML into block nodes and text runs, and the nodes' features."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np

# --- Fixed values: HTML element kinds --------------------------------------------
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style template iframe textarea select button title".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style template noscript head".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                  "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table body html".split())

# Kinds of tags and of class, id and role tokens that features tell apart
TAG_GROUPS = ("p", "h1 h2", "h3 h4 h5 h6", "li", "ul ol menu dl", "div", "section", "article", "main", "nav", "header", "footer",
              "aside", "form fieldset", "table tbody thead tfoot tr td th", "blockquote pre figure figcaption", "body html", "#text")
TOKEN_GROUPS = ("content article post entry story body text main", "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc",
                "header masthead banner top logo", "footer copyright bottom legal", "sidebar aside related widget recommended rail more",
                "ad ads advert advertisement sponsor sponsored promo", "comment comments reply replies respond discussion disqus",
                "share social follow", "cookie consent notice newsletter subscribe popup modal alert gdpr", "form search login signup contact",
                "meta byline author tags date")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|x-keep)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_GROUP_OF_TAG = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group.split()}
_GROUP_OF_TOKEN = {token: i for i, group in enumerate(TOKEN_GROUPS) for token in group.split()}


@dataclass
class Node:
    """A block element, or a run of text between block borders (tag ``#text``)."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[int, ...] = ()
    keep: str | None = None
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    children: list[int] = field(default_factory=list)
    text: str = ""


def parse(source: str) -> list[Node]:
    """Nodes in page order, the root first; every text run is a leaf with its white space collapsed.

    An open head ends where content begins. A button or list of options that is never closed hides nothing, one that is closed
    late ends with its parent.
    """
    nodes = [Node("#root", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: tag and block node, -1 for inline
    block, run, links = 0, -1, 0

    def close(position: int) -> None:
        nonlocal block, run, links
        for tag, node in stack[position:]:
            links -= tag == "a"
            if node >= 0:
                run = -1
        del stack[position:]
        block = next(node for _, node in reversed(stack) if node >= 0)

    dropped, dropped_depth = None, 0
    last_end = {tag: max((m.start() for m in re.finditer(f"</{tag}\\b", source, re.I)), default=-1) for tag in ("button", "select", "template")}
    for token in _TOKEN.finditer(source):
        raw = token.group()
        if raw[0] != "<" or raw == "<":
            if dropped == "head" and not raw.isspace():
                dropped = None
            if dropped:
                continue
            text = html.unescape(raw) if "&" in raw else raw
            if run < 0:
                if text.isspace():
                    continue
                run = len(nodes)
                nodes.append(Node("#text", block, nodes[block].depth + 1))
                nodes[block].children.append(run)
            nodes[run].pieces.append(text)
            if links:
                nodes[run].linked += len(text)
            continue
        tag = (token.group(3) or "").lower()
        if not tag:
            continue  # a comment, a declaration, or an element without readable text
        if dropped == "head" and not token.group(2) and tag not in IN_HEAD:
            dropped = None
        if dropped:
            parent_ends = token.group(2) and tag != dropped and any(name == tag for name, _ in stack)
            if tag == dropped:
                dropped_depth += -1 if token.group(2) else 1
            if not dropped_depth or parent_ends:
                dropped = None
            if not parent_ends:
                continue
        if tag in ("html", "body"):  # may be left out: a page reads the same with and without them
            continue
        if token.group(2):  # an end tag
            for position in range(len(stack) - 1, 0, -1):
                if stack[position][0] == tag:
                    close(position)
                    break
                if stack[position][0] in SCOPES and tag not in BLOCKS:
                    break
            continue
        if tag in DROPPED:
            if not token.group(4).endswith("/") and last_end.get(tag, token.start()) >= token.start():
                dropped, dropped_depth = tag, 1
            continue
        if tag in VOID and tag != "hr":
            if tag == "br" and run >= 0:
                nodes[run].pieces.append(" ")
            continue
        if tag in BLOCKS:
            closes = CLOSED_BY_SAME.get(tag, ())
            for position in range(len(stack) - 1, 0, -1):
                name = stack[position][0]
                if name == "p" or name in closes:
                    close(position)
                    break
                if name in SCOPES or (name in BLOCKS and not closes):
                    break
            run = -1
            if tag == "hr":
                continue
            tokens, keep = (), None
            if "=" in token.group(4):
                for name, value in _ATTRIBUTE.findall(token.group(4)):
                    if name.lower() == "x-keep":
                        keep = value.strip("\"'")
                    else:
                        tokens += tuple({_GROUP_OF_TOKEN[t] for t in _SPLIT.split(value.lower()) if t in _GROUP_OF_TOKEN})
            parent, block = block, len(nodes)
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens, keep))
            nodes[parent].children.append(block)
            stack.append((tag, block))
        elif not token.group(4).endswith("/"):
            links += tag == "a"
            stack.append((tag, -1))
    for node in nodes:
        if node.pieces:
            node.text = " ".join("".join(node.pieces).split())
    return nodes


FEATURES = 14 + 2 * len(TAG_GROUPS) + 2 * len(TOKEN_GROUPS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node: subtree density, links, place, siblings, tag kind, attribute tokens of the node and its parent."""
    count = len(nodes)
    size, linked, inner, marks = [0] * count, [0] * count, [0] * count, [0] * count
    for i in range(count - 1, -1, -1):
        node = nodes[i]
        if node.text:
            size[i] += len(node.text)
            linked[i] += min(node.linked, len(node.text))
            marks[i] += node.text.count(".") + node.text.count(",")
        if node.parent >= 0:
            p = node.parent
            size[p] += size[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            inner[p] += inner[i] + 1
    rows = np.zeros((count, FEATURES))
    whole, seen = max(size[0], 1), 0
    first_tag, first_token = 14, 14 + 2 * len(TAG_GROUPS)
    same = [0] * count
    place = [0] * count
    for node in nodes:
        tags: dict[str, int] = {}
        for position, child in enumerate(node.children):
            tags[nodes[child].tag] = tags.get(nodes[child].tag, 0) + 1
            place[child] = position
        for child in node.children:
            same[child] = tags[nodes[child].tag]
    for i, node in enumerate(nodes):
        parent = max(node.parent, 0)
        siblings = len(nodes[parent].children)
        own = sum(len(nodes[c].text) for c in node.children if nodes[c].tag == "#text") + len(node.text)
        rows[i, :14] = (
            math.log1p(size[i]), linked[i] / max(size[i], 1), math.log1p(own), math.log1p(inner[i]), size[i] / (inner[i] + 1),
            node.depth, size[i] / whole, seen / whole, marks[i] / max(size[i], 1), place[i] / max(siblings, 1), math.log1p(siblings),
            same[i] / max(siblings, 1), size[parent] / whole, linked[parent] / max(size[parent], 1))
        seen += len(node.text)
        group = _GROUP_OF_TAG.get(node.tag)
        if group is not None:
            rows[i, first_tag + group] = 1
        group = _GROUP_OF_TAG.get(nodes[parent].tag)
        if group is not None:
            rows[i, first_tag + len(TAG_GROUPS) + group] = 1
        for token in node.tokens:
            rows[i, first_token + token] = 1
        for token in nodes[parent].tokens:
            rows[i, first_token + len(TOKEN_GROUPS) + token] = 1
    return rows
