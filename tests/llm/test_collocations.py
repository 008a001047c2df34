import re
from collections import Counter

import pytest

from tenderspring.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, k int"


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        often = {p: n for p, n in own.items() if n >= least}
        found = []
        for p, a in often.items():
            inside = any(100 * n >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in often.items())
            if len(p) > 1 and not inside:
                score, _, left, right = min((2000000 * a // (own[p[:j]] + own[p[j:]]), j, own[p[:j]], own[p[j:]]) for j in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows():
    base = "New York is big; New YORK city is\tin new york. é Ü É, à la carte à la carte! a a a a a a b\x0bb b b c:d\x00e \x00 "
    texts = [base * (1 + i % 3) for i in range(12)] + [None, "", " ", ".", "new york", "z" * 5000, "k̈ k̈ " * 40]
    return [(i, t, ("en", "fr", None, "und")[i % 4], "x", 1) for i, t in enumerate(texts)] + [(0, base, "en", "x", 1)] * 2


@pytest.mark.parametrize(("least", "top", "width"), [(5, 2000, None), (5, 3, 1 << 12), (30, 2000, 1 << 12), (1, 2000, None)])
def test_against_brute_force(spark, least, top, width):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    assert sorted(map(tuple, C.mined(frame, least=least, top=top, width=width).collect())) == brute(rows(), least, top)


def test_rare_phrases_are_not_sent(spark):
    """What passes the sketch is little more than what is frequent; a sketch that is too narrow lets more through."""
    texts = [(i, " ".join(f"w{i}x{j} often here" for j in range(50)), "en", "x", 1) for i in range(40)]
    frame = spark.createDataFrame(texts, SCHEMA)
    got = C.counted(frame).collect()
    assert {(r.k, r.phrase): r.a for r in got} == {(0, ""): 6000, (1, "often"): 2000, (1, "here"): 2000, (2, "often here"): 2000}


def test_large_products_are_exact(spark):
    n = 4_611_686_018_427_387_903
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "a", n), ("en", 1, "b", n - 1), ("en", 2, "a b", n - 2)], "lang string, k int, phrase string, a long")
    assert [tuple(r) for r in C.ranked(counts).collect()] == [("en", 1, "a b", n - 2, n, n - 1, n, 2000000 * (n - 2) // (2 * n - 1))]


def test_no_rows(spark):
    assert C.mined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_of_a_task_are_sent_in_parts(spark, monkeypatch):
    """Lists of few phrases each, sent whenever some are held, add up to the same counts; what goes over the wire is packed."""
    rows = [(("en", "fr", None)[i % 3], f"the tender of city {i % 5}, a b {i % 11} été. " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = {tuple(r) for r in C.counted(docs, width=4096).collect()}
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        # With more than are different, what is held is added up now and then; with few, each batch is sent.
        for held in (20, 1000):
            monkeypatch.setattr(C, "HELD", held)
            assert {tuple(r) for r in C.counted(docs, width=4096).collect()} == want and len(want) > 50
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
