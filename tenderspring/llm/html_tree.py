"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with text leaves. Each node is content or not; a node's features and
the tie between parent and child are the potentials. Sum-product messages, up from the leaves and down from
the root, give each leaf's exact content marginal, and the leaves above one half are the text. Weights are
learned from labelled pages by gradient ascent on the exact likelihood, with the same messages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main|aria-label|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCKS = frozenset(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside "
    "form fieldset legend blockquote pre figure figcaption address details summary dialog menu center hr select option optgroup button label textarea ins search".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: What an opening tag ends if it is open, and what it must not look beyond.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_INSIDE_P = frozenset("button label select option textarea ins".split())
#: Hashed features: tag, words of class, id and role, shape of the text.
FEATURES = 4096
_TAG = {t: k + 1 for k, t in enumerate(sorted(_BLOCKS))}


@lru_cache(maxsize=1 << 15)
def _element(tag: str, attributes: str) -> tuple[tuple[int, ...], int]:
    """Features of an element, and its label: -1 unless it says data-main."""
    found, label = {_TAG.get(tag, 0)}, -1
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "data-main":
            label = int(value == "1")
        else:
            found |= {128 + zlib.crc32((("role " if name == "role" else "") + w.lower()).encode()) % (FEATURES - 192) for w in [*_WORDS.findall(value), *([name] if name == "hidden" else [])]}
    return tuple(found), label


@dataclass
class Trees:
    """Nodes of several pages, parents before children; -1 is the parent of a root. texts has the leaves."""

    parent: list[int]
    depth: list[int]
    kind: list[int]
    label: list[int]
    at: list[int]
    feature: list[int]
    texts: list[tuple[int, str]]
    _ready: tuple | None = None

    def add(self, page: str) -> None:
        """Parses a page, however deep. Broken markup is read as browsers do in the plain cases: unclosed elements
        end with their parents, a block ends an open paragraph, an end tag without a start is passed over. An
        element whose only content is one other element is one node with it, so that bare wrappers don't loosen
        the ties between a block and what it lies in."""
        # Of this page: parent, kind, label, features of each node; the texts of leaves.
        parent, kind, label, features, texts = [-1], [0], [-1], [set()], {}
        under: dict[int, tuple[int, int]] = {}
        features[0].add(0)
        stack, names, open_tags = [0], ["#"], Counter("#")
        run: list[str] = []
        links = linked = 0

        def close_run() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                texts[len(parent)] = text
                label.append(label[stack[-1]])
                parent.append(stack[-1]), kind.append(1), features.append(set(_shape(text, linked)))
                under[len(parent) - 1] = (len(text), min(linked, len(text)))
            linked = 0

        def pop_to(k: int) -> None:
            close_run()
            open_tags.subtract(names[k:])
            del stack[k:], names[k:]

        def last_open(tag: str) -> int:
            k = len(names) - 1
            while names[k] != tag:
                k -= 1
            return k

        def words(raw: str) -> None:
            nonlocal linked
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                run.append(text)
                if links:
                    linked += len(text)

        last = 0
        for m in _PIECE.finditer(page):
            words(page[last : m.start()])
            last = m.end()
            tag = m[3]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    words(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if tag not in _BLOCKS:
                if tag == "br":
                    run.append(" ")
                elif tag == "a":
                    links = max(0, links - 1) if m[2] else links + 1
                continue
            if m[2]:
                if open_tags[tag] > 0:
                    pop_to(last_open(tag))
                elif tag == "p":
                    close_run()
                continue
            if tag not in _INSIDE_P and open_tags["p"] > 0:
                k = last_open("p")
                if not {"td", "th", "table", "button", "ins"} & set(names[k:]):
                    pop_to(k)
            if tag in _ENDS and any(open_tags[x] > 0 for x in _ENDS[tag][0]):
                ends, stop = _ENDS[tag]
                k = len(names) - 1
                while k > 0 and names[k] not in stop:
                    if names[k] in ends:
                        pop_to(k)
                    k -= 1
                    k = min(k, len(names) - 1)
            close_run()
            if tag == "hr":
                continue
            found, own = _element(tag, m[4])
            up = stack[-1]
            if tag not in _VOID:
                stack.append(len(parent)), names.append(tag)
                open_tags[tag] += 1
            parent.append(up), kind.append(0), label.append(own if own >= 0 else label[up]), features.append(set(found))
        words(page[last:])
        close_run()
        _weigh(parent, kind, features, under)
        self._merge(parent, kind, label, features, texts)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """parent, kind, at and feature as arrays, and by depth: nodes, their parents, where each parent's children begin.
        Parents come before their children and are gone through in order, so that children of one stand side by side."""
        if self._ready is None or len(self._ready[0]) != len(self.parent):
            parent, depth = np.array(self.parent, int), np.array(self.depth, int)
            order = np.argsort(depth, kind="stable")
            cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else np.zeros(1, int)
            levels = [(x, parent[x], np.flatnonzero(np.concatenate(([True], np.diff(parent[x]) != 0)))) for x in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
            self._ready = parent, np.array(self.kind, int), np.array(self.at, int), np.array(self.feature, int), levels
        return self._ready

    def _merge(self, parent: list[int], kind: list[int], label: list[int], features: list[set[int]], texts: dict[int, str]) -> None:
        """Takes over a page's nodes, an only child that is an element as one with its parent."""
        children = Counter(parent)
        to: list[int] = []
        for k, up in enumerate(parent):
            if up >= 0 and kind[k] != 1 and children[up] == 1:
                to.append(to[up])
                if label[k] >= 0:
                    self.label[to[up]] = label[k]
            else:
                to.append(len(self.parent))
                self.parent.append(to[up] if up >= 0 else -1), self.kind.append(kind[k]), self.label.append(label[k])
                self.depth.append(self.depth[to[up]] + 1 if up >= 0 else 0)
            if k in texts:
                self.texts.append((to[k], texts[k]))
        for node, f in sorted({(to[k], f) for k, own in enumerate(features) for f in own}):
            self.at.append(node), self.feature.append(f)


def _weigh(parent: list[int], kind: list[int], features: list[set[int]], under: dict[int, tuple[int, int]]) -> None:
    """Features by the text under an element: how much, how much of the page's, how much of it in links; of a text, how much
    of the page's it is."""
    size, linked = [0] * len(parent), [0] * len(parent)
    for k in range(len(parent) - 1, -1, -1):
        own = under.get(k, (0, 0))
        size[k], linked[k] = size[k] + own[0], linked[k] + own[1]
        if parent[k] >= 0:
            size[parent[k]] += size[k]
            linked[parent[k]] += linked[k]
    for k, n in enumerate(size):
        if n:
            share, links = n / size[0], linked[k] / n
            large = 0 if share < 0.05 else 1 if share < 0.2 else 2 if share < 0.5 else 3 if share < 0.8 else 4
            if kind[k] != 1:
                kind[k] = 2 * (large >= 2)
                features[k] |= {102 + min(7, n.bit_length() // 2), 110 + (0 if links < 0.1 else 1 if links < 0.35 else 2 if links < 0.7 else 3), 114 + large}
            else:
                features[k].add(119 + large)


def _shape(text: str, linked: int) -> tuple[int, ...]:
    size, share = len(text), linked / len(text)
    return (
        80 + min(7, size.bit_length() // 2 if size < 64 else size.bit_length() - 3), 90 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3),
        96 + (text[-1] in ".!?…:;\"'»”"), 98 + (", " in text) + 2 * (". " in text),
    )


def trees(pages: list[str]) -> Trees:
    out = Trees([], [], [], [], [], [], [])
    for p in pages:
        out.add(p)
    return out


@dataclass
class Model:
    """unary[f]: weight of feature f for content. tie[kind]: 2 x 2 log potentials of (parent, child), by the
    child's kind: element, text, or element with a fifth of the page's text or more."""

    unary: np.ndarray
    tie: np.ndarray

    def beliefs(self, t: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log beliefs (node, state), each child's message up, what comes to it from its parent without it, and its own part."""
        parent, kind, at, feature, levels = t.arrays()
        n = len(parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(at, weights=self.unary[feature], minlength=n)
        tie = self.tie[kind]
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        for nodes, above, starts in levels[:0:-1]:
            up[nodes] = np.logaddexp(tie[nodes, :, 0] + own[nodes, :1], tie[nodes, :, 1] + own[nodes, 1:])
            own[above[starts]] += np.add.reduceat(up[nodes], starts)
        belief = own.copy()
        for nodes, above, _ in levels[1:]:
            down[nodes] = belief[above] - up[nodes]
            belief[nodes] += np.logaddexp(tie[nodes, 0] + down[nodes, :1], tie[nodes, 1] + down[nodes, 1:])
        return belief, up, down, own

    def marginals(self, t: Trees) -> np.ndarray:
        belief = self.beliefs(t)[0]
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def fit(pages: list[str], steps: int = 280, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Maximum likelihood on labelled pages, in which elements say data-main="1" or "0" for themselves and all
    below them up to the next that says. An element that says nothing counts as content if most characters
    under it do. Adam steps from zero, so that the result is the same each time."""
    t = trees(pages)
    parent, kind, at, feature, _ = t.arrays()
    n = len(parent)
    main, size = np.zeros(n), np.zeros(n)
    for node, text in t.texts:
        size[node], main[node] = len(text), len(text) * (t.label[node] == 1)
    for node in range(n - 1, -1, -1):
        if parent[node] >= 0:
            size[parent[node]] += size[node]
            main[parent[node]] += main[node]
    y = (main * 2 > size).astype(int)
    model = Model(np.zeros(FEATURES), np.zeros((3, 2, 2)))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    slow, fast = np.zeros(FEATURES + 12), np.zeros(FEATURES + 12)
    for step in range(1, steps + 1):
        belief, _, down, own = model.beliefs(t)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        unary = np.bincount(feature, weights=(y - p)[at], minlength=FEATURES)
        joint = model.tie[kind[child]] + down[child][:, :, None] + own[child][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, kind[child], joint)
        gradient = np.concatenate((unary, (seen - expected).ravel())) / len(pages) - decay * np.concatenate((model.unary, model.tie.ravel()))
        slow, fast = 0.9 * slow + 0.1 * gradient, 0.999 * fast + 0.001 * gradient**2
        move = rate * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.999**step)) + 1e-8)
        model.unary += move[:FEATURES]
        model.tie += move[FEATURES:].reshape(3, 2, 2)
    return model


def main_text(pages: list[str], model: Model) -> list[tuple[str, float, int]]:
    """(text, mean marginal of its blocks, number of blocks) of each page."""
    t = Trees([], [], [], [], [], [], [])
    ends = []
    for p in pages:
        t.add(p)
        ends.append(len(t.texts))
    p = model.marginals(t) if t.parent else np.zeros(0)
    out, begin = [], 0
    for end in ends:
        kept = [(text, p[node]) for node, text in t.texts[begin:end] if p[node] >= 0.5]
        out.append(("\n\n".join(x for x, _ in kept), float(np.mean([m for _, m in kept])) if kept else 0.0, len(kept)))
        begin = end
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, confidence, n_blocks for each row of pages.

    text: the blocks whose content marginal is one half or more, in page order, two line feeds between;
    character references decoded, white space within a block made one space. Null or empty html: empty text.
    Text outside any element is a block too. Repeated rows and null ids are kept as they are; an empty table
    gives no rows. Elements may be nested to any depth, and pages of any length are read whole; a batch takes
    about 1 MB of pages, or one longer page. The model is learned from `labelled` pages: by default those that
    html_pages.labelled_pages() makes up by rules, as the corpus has no labelled ones.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled or labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") < 1 << 20):
                    size += len(texts[b] or "")
                    b += 1
                found = main_text([x or "" for x in texts[a:b]], shared.value)
                columns = [pa.array([x[0] for x in found], pa.string()), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[1] for x in found]), pa.array([x[2] for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["page_id", "url", "text", "n_chars", "confidence", "n_blocks"])
                a = b

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, confidence double, n_blocks long")
