"""A light DOM of block elements and text blocks, with features of each node."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

# Elements of HTML by role.
RAW = {"script", "style", "iframe", "title"}
#: Elements whose content isn't shown as text; one that is never closed holds nothing back.
HIDDEN = {"noscript", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
          "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select",
          "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "ul"}
CONTROLS = {"button", "input", "select", "textarea", "label", "option", "legend"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Start tags that end an open element of these names, up to one of the names that hold it in.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
        "option": ({"option"}, {"select"})}
# Words of class, id, role and tag names, by what they hint at.
HINTS = {
    "main": "article articlebody body content entry main mainentity post story text prose copy markdown news lead",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs crumb crumbs pagination pager toc tabs topbar toolbar",
    "advert": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted adbox dfp",
    "footer": "footer foot copyright colophon legal bottom imprint",
    "header": "header head masthead hero logo brand site top",
    "side": "sidebar aside side widget related recommended recirc more trending popular rail complementary teaser teasers links",
    "comment": "comment comments reply replies respond disqus discussion thread reader readers",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe subscription paywall dialog",
    "form": "form login signup search searchform input contact register search-form",
    "share": "share sharing social follow facebook twitter tools meta byline author tags",
}
_HINT_OF = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
#: Buckets of the hashed words of attributes: what the list above lacks can be learned, too.
BUCKETS = 32
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)"
                    # attributes: a quote counts where a value begins, nowhere else
                    r"((?>[\s/]+|=?[^\s/>=]+(?>\s*=\s*(?>\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))?|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in RAW}
_HIDDEN_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN}
#: An attribute that marks what training pages hold as main text.
MARK = "data-is-main"
TEXT = "#text"


class Node:
    __slots__ = ("tag", "parent", "depth", "hints", "words", "text", "links", "main", "last", "control", "index")

    def __init__(self, tag, parent, depth, hints, words, main):
        self.tag, self.parent, self.depth, self.hints, self.words, self.main = tag, parent, depth, hints, words, main
        self.text, self.links, self.last, self.control, self.index = "", 0, 0, 0, 0


def _hints(tag: str, attributes: str) -> tuple[list[int], list[int], bool | None]:
    """Hints and hash buckets of the words of a tag and its attributes, and its training mark."""
    found, main = [0] * len(HINTS), None
    names = [tag]
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name = name.lower()
        if name == MARK:
            main = "1" in values
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            # camelCase and runs of letters give words
            names += _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower())
    for w in names:
        k = _HINT_OF.get(w)
        if k is not None:
            found[k] += 1
    return found, [zlib.crc32(w.encode()) % BUCKETS for w in names[1:]], main


def parse(page: str | None) -> list[Node]:
    """Nodes in page order, the root first: block elements, and as leaves the text blocks within them."""
    page = page or ""
    root = Node("html", -1, 0, [0] * len(HINTS), [], None)
    nodes, stack = [root], [0]  # stack: open block elements
    run, link_chars, anchors = [], 0, 0

    def close_run():
        nonlocal run, link_chars
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                parent = nodes[stack[-1]]
                leaf = Node(TEXT, stack[-1], parent.depth + 1, [0] * len(HINTS), [], None)
                leaf.text, leaf.links = text, min(link_chars, len(text))
                nodes.append(leaf)
        run, link_chars = [], 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            run.append(page[at:end])
            if anchors:
                link_chars += end - at
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                run.append(html.escape(m.group()[9:].removesuffix("]]>"), quote=False))
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
            continue
        if tag in RAW:
            if not closing:
                at = _RAW_END[tag].search(page, at).end()
            continue
        if tag in HIDDEN:
            end_tag = None if closing or m.group().endswith("/>") else _HIDDEN_END[tag].search(page, at)
            at = end_tag.end() if end_tag else at
            continue
        if tag == "head":
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in CONTROLS and not closing:
            nodes[stack[-1]].control += 1
        if tag not in BLOCKS:
            if tag == "button":
                run.append(" ")
            continue
        close_run()
        anchors = 0
        if tag in ("html", "body"):
            if not closing:
                _, _, main = _hints(tag, m.group(3))
                root.main = main if main is not None else root.main
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        names, within = ENDS.get(tag, ({"p"}, {"td", "th", "li", "div", "section", "article", "body", "blockquote"}))
        for k in range(len(stack) - 1, 0, -1):
            open_tag = nodes[stack[k]].tag
            if open_tag == "p" or open_tag in names:
                del stack[k:]
                if open_tag not in names:
                    continue
                if tag not in ("tr", "tbody", "tfoot"):
                    break
            elif open_tag in within:
                break
        if tag in VOID:
            continue
        hints, words, main = _hints(tag, m.group(3))
        parent = nodes[stack[-1]]
        nodes.append(Node(tag, stack[-1], parent.depth + 1, hints, words, main if main is not None else parent.main))
        stack.append(len(nodes) - 1)
    close_run()
    return nodes


FEATURES = ["chars", "link_share", "blocks", "mean_block", "longest_block", "depth", "start", "middle", "page_share", "children", "place",
            "siblings", "before", "after", "parent_share", "stops", "commas", "controls", "heading", "paragraph", "item", "cell", "text",
            *[f"own_{h}" for h in HINTS], *[f"above_{h}" for h in HINTS], *[f"below_{h}" for h in HINTS],
            *[f"words_{k}" for k in range(BUCKETS)]]


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: densities of its subtree, hints of its attributes and those around it, depth and siblings,
    and the hashed words of its attributes and its ancestors'."""
    n, h = len(nodes), len(HINTS)
    parent = np.array([x.parent for x in nodes])
    chars, links = np.zeros(n), np.zeros(n)
    blocks, longest, stops, commas, controls = (np.zeros(n) for _ in range(5))
    start, children, place = np.zeros(n), np.zeros(n), np.zeros(n)
    own = np.array([x.hints for x in nodes], dtype=float)
    above, below = own.copy(), own.copy()
    words = np.zeros((n, BUCKETS))
    seen = 0
    before, last_child = np.zeros(n), {}
    after = np.zeros(n)
    for k, x in enumerate(nodes):
        start[k] = seen
        controls[k] = x.control
        if x.tag == TEXT:
            c = len(x.text)
            chars[k], links[k], blocks[k], longest[k] = c, x.links, 1, c
            stops[k] = x.text.count(". ") + x.text.count("! ") + x.text.count("? ") + (x.text[-1] in ".!?…")
            commas[k] = x.text.count(",")
            seen += c
        if k:
            words[k] = words[x.parent]
        words[k, x.words] = 1
        if k:
            place[k] = children[x.parent]
            children[x.parent] += 1
            above[k] = np.minimum(above[k] + above[x.parent], 3) if above[x.parent].any() else above[k]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        blocks[p] += blocks[k]
        stops[p] += stops[k]
        commas[p] += commas[k]
        controls[p] += controls[k]
        if longest[k] > longest[p]:
            longest[p] = longest[k]
        if below[k].any():
            below[p] += below[k]
    for k in range(1, n):
        p = parent[k]
        if p in last_child:
            before[k] = chars[last_child[p]]
            after[last_child[p]] = chars[k]
        last_child[p] = k
    total = max(1.0, chars[0])
    kind = [x.tag for x in nodes]
    some = np.maximum(chars, 1)
    up = np.maximum(parent, 0)
    columns = [np.log1p(chars), links / some, np.log1p(blocks), np.log1p(chars / np.maximum(blocks, 1)), np.log1p(longest),
               np.array([min(x.depth, 30) for x in nodes]), start / total, (start + chars / 2) / total, chars / total, np.log1p(children),
               (place + 1) / np.maximum(children[up], 1), np.log1p(children[up]), np.log1p(before), np.log1p(after),
               chars / np.maximum(chars[up], 1), stops / some * 100, commas / some * 100, controls,
               np.array([t in HEADINGS for t in kind]), np.array([t == "p" for t in kind]), np.array([t in ("li", "dt", "dd") for t in kind]),
               np.array([t in ("td", "th") for t in kind]), np.array([t == TEXT for t in kind])]
    return np.column_stack([*columns, np.minimum(own, 3), above, np.minimum(below - own, 5), words]).astype(np.float32)


def labels(nodes: list[Node]) -> np.ndarray:
    """Of a page with marks: 1 where the subtree holds main text."""
    y = np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        if x.tag == TEXT and nodes[x.parent].main:
            y[k] = 1
        if k and y[k]:
            y[x.parent] = 1
    return y


def decoded(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The likeliest choice in which nothing below a left-out node is kept.

    For each subtree the best log-probability with its root kept (each child at its own best)
    is compared with leaving all of it out.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    out, kept = np.log1p(-p), np.log(p)
    best = kept.copy()
    choice = np.zeros(len(nodes), dtype=bool)
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        choice[k] = best[k] > out[k]
        if k:
            parent = nodes[k].parent
            out[parent] += out[k]
            best[parent] += max(best[k], out[k])
    for k in range(1, len(nodes)):
        choice[k] &= choice[nodes[k].parent]
    return choice


def main_text(nodes: list[Node], choice: np.ndarray) -> str:
    return "\n".join(x.text for x, c in zip(nodes, choice) if c and x.tag == TEXT)

