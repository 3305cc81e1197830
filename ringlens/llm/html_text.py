"""Main text of web pages by boosted trees over DOM nodes.

A page becomes a tree of block elements and text runs. Trees score every node from its subtree density, links, place,
siblings, tag kind and attribute tokens. Decoding is hierarchical: a node can only be kept inside kept ancestors, and of
all choices that obey this the one with the largest sum of scores is taken (one pass up and one down the
tree), so an article never loses its wrapper and nothing survives inside a removed menu.

The trees are trained on a bounded sample: ``PAGES`` pages by smallest hash. Pages that mark their article (an
``article`` or ``main`` element, nested navigation, asides, forms, headers and footers excepted) label their own nodes;
each also lends its paragraphs to ``LAYOUTS`` pages built from common layouts with other tags and class names and with
menus, notices, sidebars, adverts, comments and forms, so that no single template is learned by heart.

Text runs are the blocks of the output: character references decoded, white space (also a line break) made one space,
trimmed, joined by a line feed. Null or empty html gives an empty text; null ids and urls stay; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringlens.llm.boosting import BoostedTrees
from ringlens.llm.dom import FEATURES, Node, features, parse
from ringlens.llm.words import text_slices

PAGES = 200
LAYOUTS = 3
LONGEST = 40_000  # characters of a page used for training
SCORE_LIMIT = 6.0
_NESTED = frozenset("nav aside form footer header".split())


def labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes of the marked article and for the path to it, 0 for others; None if the page marks none."""
    roots = [i for i, n in enumerate(nodes) if n.keep == "1"] or [i for i, n in enumerate(nodes) if n.tag == "article"] \
        or [i for i, n in enumerate(nodes) if n.tag == "main"]
    if not roots:
        return None
    keep = np.zeros(len(nodes))
    keep[roots] = 1
    for i, node in enumerate(nodes):
        marked = node.keep == "0" or (node.keep is None and node.tag in _NESTED)
        if node.parent >= 0 and keep[node.parent] and not marked:
            keep[i] = 1
    for root in roots:
        at = nodes[root].parent
        while at >= 0:
            keep[at] = 2
            at = nodes[at].parent
    return np.minimum(keep, 1)


def decode(nodes: list[Node], scores: np.ndarray) -> list[bool]:
    """The best choice of nodes in which everything kept has kept ancestors.

    A run that is all its block has shares the block's fate.
    """
    total = np.clip(scores, -SCORE_LIMIT, SCORE_LIMIT).tolist()
    for i, node in enumerate(nodes):
        if node.tag == "#text" and len(nodes[node.parent].children) == 1:
            total[node.parent] = (total[node.parent] + total[i]) / 2
            total[i] = 1e-9
    for i in range(len(nodes) - 1, 0, -1):
        if total[i] > 0:
            total[nodes[i].parent] += total[i]
    kept = [False] * len(nodes)
    for i, node in enumerate(nodes):
        kept[i] = total[i] > 0 and (node.parent < 0 or kept[node.parent])
    return kept


class Extractor:
    def __init__(self, pages: list[str]) -> None:
        rows, answers, paragraphs = [], [], []
        for page in pages:
            nodes = parse(page)
            own = labels(nodes)
            if own is not None:
                rows.append(features(nodes))
                answers.append(own)
                texts = [n.text for n, k in zip(nodes, own) if k and n.text]
            else:
                texts = [n.text for n in nodes if len(n.text) > 80]
            if texts:
                paragraphs.append(texts)
        chance = random.Random(7)
        for number in range(LAYOUTS * len(paragraphs)):
            nodes = parse(layout(paragraphs[number % len(paragraphs)], paragraphs, chance))
            rows.append(features(nodes))
            answers.append(labels(nodes))
        self.trees = BoostedTrees()
        x = np.concatenate(rows) if rows else np.zeros((1, FEATURES))
        self.trees.fit(x, np.concatenate(answers) if answers else np.zeros(1))

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        if not parsed:
            return []
        scores = self.trees.margins(np.concatenate([features(nodes) for nodes in parsed]))
        ends = np.cumsum([len(nodes) for nodes in parsed])
        return ["\n".join([n.text for n, k in zip(nodes, decode(nodes, scores[end - len(nodes) : end])) if k and n.text])
                for nodes, end in zip(parsed, ends)]


def layout(article: list[str], others: list[list[str]], chance: random.Random) -> str:
    """A page with a marked article in one of many common layouts."""
    say = html.escape

    def words(low: int, high: int) -> str:
        some = chance.choice(chance.choice(others)).split() or ["a"]
        at = chance.randrange(len(some))
        return say(" ".join(some[at : at + chance.randint(low, high)]))

    def links(count: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{i}">{words(1, 4)}</a></{wrap}>' for i in range(count))

    def box(kinds: str, inner: str, tags: str = "div") -> str:
        tag, name = chance.choice(tags.split()), chance.choice(kinds.split())
        return f'<{tag} {chance.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    def prose(count: int) -> str:
        return "".join(f"<p>{words(4, 40)}</p>" for _ in range(count))

    head, *rest = article
    if chance.random() < 0.3:
        rest = rest[: chance.randint(0, 2)]
    body = "".join(f"<p>{say(t)}</p>" if chance.random() < 0.9 else
                   chance.choice(("<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<pre>{}</pre>")).format(say(t))
                   for t in rest)
    inside = [box("share social-share", links(3, "span")), box("ad advert sponsored", prose(1)), box("related", f"<ul>{links(3)}</ul>", "aside div"),
              box("newsletter subscribe-form", f"<form><label>{words(2, 8)}</label><input></form>")]
    extra = chance.choice(inside).replace("<", '<', 1) if chance.random() < 0.4 else ""
    extra = extra.replace(" class=", ' x-keep="0" class=', 1).replace(" id=", ' x-keep="0" id=', 1)
    content = f"<h1>{say(head)}</h1>{body}{extra}"
    tag = chance.choice(("article", "div", "div", "section", "main"))
    name = chance.choice(("content", "post-content", "entry-content", "article-body", "main-content", "story", "post", ""))
    content = f'<{tag} x-keep="1"' + (f' class="{name}"' if name else "") + f">{content}</{tag}>"
    if chance.random() < 0.5:
        content = f'<div class="{chance.choice(("container", "wrapper", "page", "main", "column"))}">{content}</div>'
    before = [box("header masthead site-header", f"<p>{words(2, 8)}</p>" + (f"<ul>{links(4)}</ul>" if chance.random() < 0.5 else ""), "header div"),
              box("nav menu navbar main-nav", f"<ul>{links(chance.randint(3, 9))}</ul>", "nav div"), box("breadcrumb", links(3, "span"), "nav div"),
              box("cookie-notice consent alert notice", f"<p>{words(6, 30)}</p>"), box("ad ads advertisement promo", words(4, 40)),
              box("search login", f"<form><label>{words(1, 4)}</label><input></form>", "div form")]
    after = [box("sidebar widget rail", f"<h3>{words(1, 4)}</h3>" + (prose(2) if chance.random() < 0.5 else f"<ul>{links(5)}</ul>"), "aside div"),
             box("comments comment-list discussion", "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(5, 40)}</p></div>'
                                                              for _ in range(chance.randint(1, 5))), "div section"),
             box("related more recommended", f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>", "div section aside"),
             box("ad sponsor promo", prose(1)), box("newsletter subscribe", f"<p>{words(4, 20)}</p><form><input></form>"),
             box("footer copyright legal site-footer", f"<p>{words(3, 25)}</p>" if chance.random() < 0.5 else words(3, 25), "footer div")]
    front = [b for b in before if chance.random() < 0.5]
    back = [b for b in after if chance.random() < 0.5]
    return f"<html><head><title>x</title></head><body>{''.join(front)}{content}{''.join(back)}</body></html>"


def sample_pages(pages: DataFrame, limit: int = PAGES) -> list[str]:
    """The html of ``limit`` pages by smallest hash: ids are chosen first, then their pages are read."""
    usable = pages.where(F.col("html").isNotNull() & (F.length("html") <= LONGEST)).select(F.col("page_id").alias("_id"), "html")
    chosen = usable.select("_id").where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = usable.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "html").limit(limit).collect()
    return [r.html for r in rows]


def main_text(pages: DataFrame, sample: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    sample = sample_pages(pages) if sample is None else sample
    shipped = pages.sparkSession.sparkContext.broadcast(Extractor(sample))  # trees of a fixed number and depth

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = shipped.value.texts([h or "" for h in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(of, "page_id bigint, url string, text string, n_chars bigint")
