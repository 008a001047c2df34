"""Licence scans: a generalised suffix automaton of licence words, matching statistics, and chains of long matches.

The automaton has a state for each set of runs of words that end at the same places of the templates. A text
is streamed through it: after each word it tells the longest run of words, up to here, that stands in some
template. Phrases are templates too and end wherever they are a suffix of that run. Runs that can't be made
longer are chained, in the order of a template's words, into the spans that cover most of it.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordhash as W
from .licence_texts import PHRASES, TEMPLATES

#: Words of the shortest run that is chained, of the widest gap within a chain; the share of a template that names it.
LONG, GAP, SHARE = 4, 40, 0.7
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INNER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


class Match(NamedTuple):
    """A run of `size` words of the text that can't be longer, from word `start`, and the state it ends in."""

    start: int
    size: int
    state: int


class Automaton:
    """The suffix automaton of several sequences of numbers from 1; state 0 is empty. link[v] is the state of the longest
    suffix that v's runs share with more places; size[v] is the length of v's longest run."""

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: Places where a state's runs end, (sequence, words up to there), of the state itself; ends() adds those below it.
        self._own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            at = 0
            for upto, word in enumerate(sequence, 1):
                at = self._extended(at, word)
                self._own[at].append((number, upto))
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self._below = below

    def _state(self, size: int, steps: dict[int, int], link: int) -> int:
        self.next.append(steps), self.size.append(size), self.link.append(link), self._own.append([])
        return len(self.next) - 1

    def _extended(self, last: int, word: int) -> int:
        """The state of the longest run at `last` with one more word, with the suffixes made that lack it."""
        found = self.next[last].get(word)
        if found is not None:
            return found if self.size[found] == self.size[last] + 1 else self._split(last, word, found)
        new, at = self._state(self.size[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            found = self.next[at][word]
            self.link[new] = found if self.size[found] == self.size[at] + 1 else self._split(at, word, found)
        return new

    def _split(self, at: int, word: int, found: int) -> int:
        """A state of its own for the shorter runs of `found`: those that end in word after a run of `at`."""
        short = self._state(self.size[at] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = short
        while at >= 0 and self.next[at].get(word) == found:
            self.next[at][word] = short
            at = self.link[at]
        return short

    def ends(self, state: int) -> list[tuple[int, int]]:
        """All places (sequence, words up to there) where this state's runs end."""
        out, open_ = [], [state]
        while open_:
            at = open_.pop()
            out += self._own[at]
            open_ += self._below[at]
        return out

    def step(self, state: int, size: int, word: int) -> tuple[int, int]:
        """The longest run that ends with this word: its state and size."""
        while state and word not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, size + 1)


class Scanner:
    """Templates and phrases made ready; built once a task."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        split = lambda text: WORDS.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        self.phrases = [(tuple(split(p)), label) for p, label in phrases.items()]
        self.labels = [label for label, _ in templates]
        texts = [split(text) for _, text in templates]
        self.lengths = [len(t) for t in texts]
        self.vocabulary: dict[str, int] = {}
        every = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in [*texts, *(p for p, _ in self.phrases)]]
        self.automaton = Automaton(every)
        self.ends = [[p for p in self.automaton.ends(v) if p[0] < len(texts)] for v in range(len(self.automaton.next))]
        # Phrases that end in a state's runs: all of a phrase's state and of the states below it have it as a suffix.
        self.stands: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for number, words in enumerate(every[len(texts) :]):
            state = 0
            for word in words:
                state = self.automaton.next[state][word]
            below = [state]
            while below:
                at = below.pop()
                self.stands[at].append((len(words), number))
                below += self.automaton._below[at]
        n = len(self.vocabulary) + 1
        self.pairs = np.zeros((n, n), bool)
        self.of_phrase = np.zeros((n, n), bool)
        for words in every:
            self.pairs[words[:-1], words[1:]] = True
        for words in every[len(texts) :]:
            self.of_phrase[words[:-1], words[1:]] = True

    def streamed(self, words: Sequence[int], first: int) -> tuple[list[Match], list[tuple[int, int]]]:
        """(matches that can't be longer, places (phrase, start)) of words that begin at word `first` of the text."""
        step, stands = self.automaton.step, self.stands
        state = size = 0
        matches, places = [], []
        for at, word in enumerate(words):
            was, had = state, size
            state, size = step(state, size, word)
            if had >= LONG and size <= had:
                matches.append(Match(first + at - had, had, was))
            for length, phrase in stands[state]:
                if length <= size:
                    places.append((phrase, first + at + 1 - length))
        if size >= LONG:
            matches.append(Match(first + len(words) - size, size, state))
        return matches, places

    def spans(self, matches: Sequence[Match], share: float = SHARE, gap: int = GAP) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, share covered) of chains that cover `share` of a template or more.

        Within a template, a match follows one that ends before it in text and template, at most `gap` words apart
        in either; words in which two overlap are counted once. Of chains that share words the fullest is taken.
        """
        links = defaultdict(list)
        for m in matches:
            for template, upto in self.ends[m.state]:
                links[template].append((m.start, m.start + m.size, upto - m.size, upto))
        found = []
        for template, own in links.items():
            best: list[tuple[int, int]] = []
            near: deque[int] = deque()
            for i, (a, b, c, d) in enumerate(own):
                while near and own[near[0]][1] < a - gap:
                    near.popleft()
                covered, begin = b - a, a
                for j in near:
                    p, q, r, s = own[j]
                    over = max(0, q - a, s - c)
                    if p < a and r < c and q < b and s < d and c - s <= gap and best[j][0] + b - a - over > covered:
                        covered, begin = best[j][0] + b - a - over, best[j][1]
                best.append((covered, begin))
                near.append(i)
            chains = sorted(((-n, begin, own[i][1]) for i, (n, begin) in enumerate(best) if n >= share * self.lengths[template]), key=lambda x: x)
            kept: dict[int, int] = {}
            for n, begin, end in chains:
                if begin not in kept:
                    kept[begin] = end
                    found.append((template, begin, end - 1, -n / self.lengths[template]))
        return sorted(_disjoint(found))

    def text_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, 0 for those of no template; first word of each text and the end)."""
        raw, ends = W.bytes_of(texts)
        raw = _LOWER[raw]
        inner = _INNER[raw]
        border = np.zeros(len(raw) + 1, bool)
        border[ends] = True
        starts = np.flatnonzero(inner & (border[:-1] | np.concatenate(([True], ~inner[:-1]))))
        stops = np.flatnonzero(inner & (border[1:] | np.concatenate((~inner[1:], [True])))) + 1
        offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inner])]).dictionary_encode()
        known = np.array([self.vocabulary.get(w, 0) for w in words.dictionary.to_pylist()], np.int32)
        return known[words.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int32), np.searchsorted(starts, ends)

    def scanned(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]]:
        """(words, places, spans) of each text. Only stretches whose neighbouring words are neighbours in a template are
        streamed: everywhere else no run of two words matches."""
        words, begins = self.text_words(texts)
        hit = self.pairs[words[:-1], words[1:]] if len(words) > 1 else np.zeros(0, bool)
        inner = begins[(begins > 0) & (begins < len(words))]
        hit[inner - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        marked = np.concatenate(([0], np.cumsum(hit & self.of_phrase[words[:-1], words[1:]]))) if len(words) > 1 else np.zeros(1, np.int64)
        worth = (stops - starts >= LONG - 1) | (marked[stops] > marked[starts])
        out = [([], []) for _ in range(len(texts))]
        owner = np.searchsorted(begins, starts, "right") - 1
        for start, stop, text in zip(starts[worth].tolist(), stops[worth].tolist(), owner[worth].tolist(), strict=True):
            matches, places = self.streamed(words[start : stop + 1].tolist(), start - int(begins[text]))
            out[text][0].extend(matches)
            out[text][1].extend(places)
        return [(int(begins[i + 1] - begins[i]), places, self.spans(matches) if matches else []) for i, (matches, places) in enumerate(out)]


def _disjoint(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of the spans of one template that share words, the fullest, then the first."""
    kept: list[tuple[int, int, int, float]] = []
    for template in {s[0] for s in spans}:
        taken: list[tuple[int, int]] = []
        for span in sorted((s for s in spans if s[0] == template), key=lambda s: (-s[3], s[1], s[2])):
            at = int(np.searchsorted([b for _, b in taken], span[1])) if taken else 0
            if at == len(taken) or taken[at][0] > span[2]:
                taken.insert(at, (span[1], span[2]))
                kept.append(span)
    return kept


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places array<struct<phrase, label, start>>, spans array<struct<template, label, first_word, last_word,
    share>>) of every whole text.

    places are all starts of the base phrases, from word 0; spans the stretches that cover SHARE of a template or
    more. Null and empty texts have no words. Repeated rows are scanned each and null ids kept. No rows: none.
    Extra columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = [" ".join(words) for words, _ in scanner.phrases]
        for batch in batches:
            at = 0
            for texts in W.chunks(batch.column(1), 4 << 20):
                found = scanner.scanned(texts)
                places = [[{"phrase": names[p], "label": scanner.phrases[p][1], "start": s} for p, s in x] for _, x, _ in found]
                spans = [[{"template": t, "label": scanner.labels[t], "first_word": a, "last_word": b, "share": share} for t, a, b, share in x] for _, _, x in found]
                columns = [batch.column(0).slice(at, len(texts)), pa.array([n for n, _, _ in found], pa.int64()), pa.array(places, kinds[0]), pa.array(spans, kinds[1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "places", "spans"])
                at += len(texts)

    kinds = (
        pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("start", pa.int64())])),
        pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])),
    )
    schema = "id long, n_words long, places array<struct<phrase string, label string, start long>>, spans array<struct<template int, label string, first_word long, last_word long, share double>>"
    return docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text").mapInArrow(run, schema)
