"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

Training pages come from a bounded sample of the table (SAMPLE pages, by hash of the id):
pages whose markup names the article are taken as they are, and from the sentences of all
sampled pages other layouts are composed, with articles, menus, adverts, notices, forms,
sidebars, comments and footers under telling, untelling and invented names. Spark fits the trees; they
are then plain arrays that every task applies to the nodes of whole pages. A node's label is
whether its subtree holds main text. Decoding picks the likeliest labels of a page in
which nothing below a left-out node is kept.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arbora.llm.common import hash_sample
from arbora.llm.dom import FEATURES, HINTS, MARK, TEXT, decoded, features, labels, main_text, parse
from arbora.llm.vectors import list_column
from arbora.session import cut_lineage

#: Sampled pages, composed layouts, trees and their depth.
SAMPLE, LAYOUTS, TREES, DEPTH = 120, 480, 24, 5
NEUTRAL = ["box", "block", "wrap", "inner", "row", "col", "c1", "x9", "unit", "grid"]
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass
class Trees:
    """The sum of regression trees, each level of a tree one step of array look-ups."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[t, at]] <= self.cut[t, at], self.left[t, at], self.right[t, at])
            margin += self.value[t, at]
        return 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))


class Layouts:
    """Composes pages from sentences; every element of the main part carries the training mark."""

    def __init__(self, sentences: list[str], seed: int, names: dict[str, str] = HINTS, invented: float = 0.3):
        self.rng = random.Random(seed)
        self.sentences = sentences or ["A short text."]
        self.known, self.invented = names, invented

    def sentence(self) -> str:
        return self.rng.choice(self.sentences)

    def words(self, n: int) -> str:
        return html.escape(" ".join(self.sentence().split()[:n]) or "more", quote=False)

    def prose(self, least: int = 1, most: int = 8) -> str:
        out = []
        for _ in range(self.rng.randint(least, most)):
            s = html.escape(self.sentence(), quote=False)
            if self.rng.random() < 0.1:
                s = f"<a href='/x'>{s}</a>" if len(s) < 60 else f"<b>{s[:20]}</b>{s[20:]}"
            out.append(s)
        return " ".join(out)

    def names(self, kind: str, telling: float = 0.75) -> str:
        r = self.rng
        if r.random() < telling:
            word = r.choice(self.known[kind].split())
            if r.random() < self.invented:  # a name that says nothing: the page's form must do
                word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9)))
            return r.choice([f' class="{word}"', f' id="{word}"', f' class="{r.choice(NEUTRAL)} {word}-{r.choice(NEUTRAL)}"'])
        return r.choice(["", f' class="{r.choice(NEUTRAL)}"'])

    def box(self, kind: str, inner: str, tags: tuple[str, ...], telling: float = 0.75, main: int | None = None) -> str:
        tag = self.rng.choice(tags)
        # a tag that tells what it is may go without names
        mark = f' {MARK}="{main}"' if main is not None else ""
        return f"<{tag}{self.names(kind, telling if tag in ('div', 'section', 'ul', 'td') else 0.4)}{mark}>{inner}</{tag}>"

    def links(self, least: int, most: int, words: int = 3) -> str:
        items = [f'<a href="/{k}">{self.words(self.rng.randint(1, words))}</a>' for k in range(self.rng.randint(least, most))]
        return self.rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def article(self) -> str:
        r = self.rng
        out = [f"<h1>{self.words(10)}</h1>"] if r.random() < 0.85 else []
        style = r.choice(["p", "p", "p", "div", "open", "bold"])
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            t = self.prose(1, r.choice([1, 3, 8]))
            out.append({"p": f"<p>{t}</p>", "div": f"<div>{t}</div>", "open": f"<p>{t}", "bold": f"<p><b>{t}<br>"}[style])
            x = r.random()
            if x < 0.05:
                out.append(f"<h2>{self.words(6)}</h2>")
            elif x < 0.1:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.13:
                out.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.15:
                out.append("<table>" + "".join(f"<tr><td>{self.words(3)}</td><td>{self.words(4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.17:
                out.append(f"<figure><img src=x><figcaption>{self.words(9)}</figcaption></figure>")
            elif x < 0.2:
                out.append(f"<pre>{self.prose(1, 2)}</pre>")
            elif x < 0.27:
                out.append(r.choice([self.advert, self.share, self.side])(main=0))
        return "".join(out)

    def advert(self, main=None) -> str:
        return self.box("advert", self.rng.choice([self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f'<a href="/buy">{self.words(6)}</a>']), ("div", "aside", "section"), 0.9, main)

    def share(self, main=None) -> str:
        return self.box("share", self.links(2, 5, 1), ("div", "ul", "section"), 0.9, main)

    def side(self, main=None) -> str:
        inner = f"<h3>{self.words(3)}</h3>" + self.rng.choice([self.links(3, 8, 8), "".join(f"<p>{self.words(12)}</p>" for _ in range(3)), f"<p>{self.prose(1, 3)}</p>"])
        return self.box("side", inner, ("aside", "div", "section"), 0.85, main)

    def menu(self) -> str:
        return self.box("menu", self.links(3, 10), ("nav", "div", "ul"))

    def head(self) -> str:
        return self.box("header", self.rng.choice([self.words(4), f"<h2>{self.words(3)}</h2>", self.links(1, 3), f"<p>{self.prose(1, 1)}</p>"]), ("header", "div"), 0.85)

    def notice(self) -> str:
        return self.box("notice", f"<p>{self.prose(1, 3)}</p><button>{self.words(1)}</button>", ("div", "section", "dialog"), 0.9)

    def form(self) -> str:
        return self.box("form", f"<form><label>{self.words(4)}</label><input name=q><p>{self.prose(1, 2)}</p><button>{self.words(1)}</button></form>", ("div", "section"), 0.6)

    def comments(self) -> str:
        r = self.rng
        one = lambda: f"<div{self.names('comment', 0.8)}><b>{self.words(2)}</b> <span>{r.randint(1, 28)}.{r.randint(1, 12)}.</span><p>{self.prose(1, 4)}</p></div>"
        return self.box("comment", f"<h3>{self.words(2)}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6))), ("section", "div"), 0.95)

    def footer(self) -> str:
        return self.box("footer", self.rng.choice([f"&copy; {self.words(3)} &middot; {self.prose(1, 1)}", self.links(2, 6), f"<p>{self.prose(1, 2)}</p>"]), ("footer", "footer", "div"), 0.9)

    def page(self) -> str:
        r = self.rng
        inner = self.article()
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f"<div{self.names('main', 0.3)}>{inner}</div>"
        main = self.box("main", inner, ("article", "article", "main", "div", "section"), 0.7, 1) if r.random() < 0.96 else ""
        before = [f() for f in (self.head, self.menu, self.notice, self.advert, self.side, self.form) if r.random() < 0.4]
        after = [f() for f in (self.comments, self.side, self.advert, self.form, self.notice, self.share) if r.random() < 0.4]
        if r.random() < 0.75:
            after.append(self.footer())
        r.shuffle(before)
        body = "".join(before) + main + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div class="{r.choice(NEUTRAL)}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(5)}</title></head><body>{body}</body></html>"


def marked(page: str) -> str | None:
    """A page whose markup has one article element, with the training marks; else null."""
    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return None
    page = re.sub(r"<article\b", f'<article {MARK}="1"', page, flags=re.I)
    return re.sub(r"<(nav|aside|footer|form)\b", rf'<\1 {MARK}="0"', page, flags=re.I)


def training_pages(pages: list[str], layouts: int = LAYOUTS, seed: int = 3) -> list[str]:
    """Marked pages: those of the sample that name their article, and composed ones."""
    taken = [m for p in pages if (m := marked(p))]
    texts = [x.text for p in pages for x in parse(p) if x.tag == TEXT]
    sentences = sorted({s for t in texts for s in _SENTENCE.split(t) if 0 < len(s) <= 400})
    make = Layouts(sentences, seed)
    return taken + [make.page() for _ in range(layouts)]


def train(pages: DataFrame, key: str = "page_id", text: str = "html") -> Trees:
    """Trees fitted on a sample of ``pages``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    sample = hash_sample(pages.where(F.col(text).isNotNull()), F.col(key), SAMPLE).select(text).collect()  # SAMPLE pages
    xs, ys = [], []
    for page in training_pages([r[0] for r in sample]):
        nodes = parse(page)  # one page's nodes at a time: the driver keeps their features only
        xs.append(features(nodes)[1:])
        ys.append(labels(nodes)[1:])
    rows = pa.Table.from_arrays([pa.array(np.concatenate(ys)), list_column(np.concatenate(xs), pa.float32())], names=["label", "x"])
    del xs, ys
    data = pages.sparkSession.createDataFrame(rows).select("label", array_to_vector("x").alias("features")).coalesce(4)
    del rows
    data = cut_lineage(data).cache()  # rows of the driver would go out anew with every task of every tree
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=48, seed=5, subsamplingRate=0.8).fit(data)
    data.unpersist()
    return _arrays(model)


def _arrays(model) -> Trees:
    """The fitted trees as arrays; leaves point to themselves."""
    size = 2 << DEPTH
    n = len(model.trees)
    feature, left, right = (np.zeros((n, size), dtype=np.int64) for _ in range(3))
    cut, value = np.zeros((n, size)), np.zeros((n, size))
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        todo, used = [(tree._java_obj.rootNode(), 0)], 1
        while todo:
            node, k = todo.pop()
            value[t, k] = node.prediction() * weight
            left[t, k] = right[t, k] = k
            if node.subtreeDepth() > 0:
                feature[t, k], cut[t, k] = node.split().featureIndex(), node.split().threshold()
                left[t, k], right[t, k] = used, used + 1
                todo += [(node.leftChild(), used), (node.rightChild(), used + 1)]
                used += 2
    return Trees(feature, cut, left, right, value)


def page_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """Main texts of whole pages; the nodes of all of them are scored at once."""
    nodes = [parse(p) for p in pages]
    x = [features(n) for n in nodes]
    p = trees.probabilities(np.concatenate([*x, np.zeros((0, len(FEATURES)), dtype=np.float32)]))
    out, at = [], 0
    for n in nodes:
        mine = p[at:at + len(n)].copy()
        mine[0] = 1.0  # the root is always open
        out.append(main_text(n, decoded(n, mine)))
        at += len(n)
    return out


def extract(pages: DataFrame, trees: Trees, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page.

    One row for each input row; null and empty pages, and pages without main text, have an
    empty text. Character references are decoded, white space within a block is one blank,
    blocks are joined in page order by a line feed. Repeated rows are each extracted; an
    empty table gives an empty result.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = page_texts([x.as_py() for x in part.column("html")], trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(text).alias("html"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
