import random
import re

import pyarrow as pa

from tenderspring.llm import licence_scan as L
from tenderspring.llm.licence_texts import PHRASES, TEMPLATES
from tenderspring.llm.queries import op12_licence_scan
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def places(text):
    own = words(text)
    return sorted((p, i) for p in PHRASES for i in range(len(own)) if own[i : i + len(p.split())] == p.split())


def test_matching_statistics_against_brute_force():
    rng = random.Random(5)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    auto = L.Automaton(sequences)
    runs = {}
    for t, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                runs.setdefault(tuple(s[i:j]), set()).add((t, j))
    for _ in range(200):
        text, state, size = [rng.randint(1, 4) for _ in range(30)], 0, 0
        for i, word in enumerate(text):
            state, size = auto.step(state, size, word)
            longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs), default=0)
            assert size == longest
            if size:
                assert set(auto.ends(state)) == runs[tuple(text[i + 1 - size : i + 1])]


def test_stretches_give_what_the_whole_text_gives():
    scanner, rng = L.Scanner(), random.Random(6)
    vocabulary = [*scanner.vocabulary, "zzz"]
    texts = []
    for _ in range(60):
        parts = [rng.choice([rng.choice(TEMPLATES)[1], " ".join(rng.choices(vocabulary, k=8)), rng.choice([*PHRASES]), "xq. zz"]) for _ in range(6)]
        texts.append(" / ".join(parts))
    texts += ["", "MIT", "mit license", "the mit license mit license", "general public license" * 2]
    for text, (n, found, spans) in zip(texts, scanner.scanned(pa.array(texts, pa.large_string())), strict=True):
        own = words(text)
        matches, all_places = scanner.streamed([scanner.vocabulary.get(w, 0) for w in own], 0)
        assert n == len(own) and sorted(found) == sorted(all_places) and spans == scanner.spans(matches)
        names = [" ".join(p) for p, _ in scanner.phrases]
        assert sorted((names[p], i) for p, i in found) == places(text)


def test_spans_of_whole_broken_and_partial_texts():
    scanner = L.Scanner()
    mit = dict((t[:20], t) for _, t in TEMPLATES)["Permission is hereby"]
    broken = mit.replace("without restriction", "with no limits").replace("\n", " ")
    half = " ".join(mit.split()[:20])
    got = scanner.scanned(pa.array([f"begin {mit} end", f"a b {broken}", half, " ".join(reversed(mit.split())), f"{mit} and {mit}"], pa.large_string()))
    labels = [[(scanner.labels[t], a, round(share, 1)) for t, a, _, share in spans] for _, _, spans in got]
    assert labels == [[("mit", 1, 1.0)], [("mit", 2, 1.0)], [], [], [("mit", 0, 1.0), ("mit", len(words(mit)) + 1, 1.0)]]


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in op12_licence_scan(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    seen = set()
    for d in docs:
        r, own = got[d.doc_id], places(d.text)
        at = [i for _, i in own]
        base = sorted({PHRASES[p] for p, _ in own})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words(d.text)), len(own), min(at, default=None), max(at, default=None), ",".join(base))
        assert set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))
        assert (r.labels == "") == (r.score == 0) and (not own or r.score == 1)
        # A notice that stands whole in the text is found, and no label comes of nothing.
        text = " ".join(words(d.text))
        assert {label for label, t in TEMPLATES if f" {' '.join(words(t))} " in f" {text} "} <= set(r.labels.split(","))
        seen |= set(r.labels.split(","))
    assert {"mit", "apache", "cc-by-nc"} <= seen


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "MIT License", 3), (3, "MIT-License, mit license " * 20_000, 3), (4, "émit license", 3)]
    got = L.scanned(spark.createDataFrame(rows, "doc_id long, text string, places int").repartition(2))
    assert sorted((r.id or 0, r.n_words, len(r.places)) for r in got.collect()) == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 2, 1), (3, 80_000, 40_000), (4, 2, 0)]
    assert L.scanned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
