import random

import pytest
from pyspark.sql import functions as F

from tenderspring.operators import names as N
from tenderspring.operators import ocr


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def brute(names, known, least, margin):
    out = {}
    for name in {n for n in names if n and n.strip()}:
        best = {}
        for alias, code in known:
            best[code] = max(best.get(code, 0.0), ratio("".join(name.split()), "".join(alias.split())))
        ranked = sorted(((-v, c) for c, v in best.items()))
        if ranked and -ranked[0][0] >= least and -ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0) >= margin:
            out[name] = (ranked[0][1], -ranked[0][0])
    return out


@pytest.mark.parametrize(("least", "letters"), [(90.0, "abcdefghij"), (84.0, "abcd"), (75.0, "abcdefgh")])
def test_closest_against_all_pairs(spark, least, letters):
    rng = random.Random(int(least))
    known = [("".join(rng.choices(letters, k=rng.randint(1, 24))), f"C{k // 2}") for k in range(80)] + [("shared name", "C0"), ("shared name", "C1")]
    names = ["shared nam", "", " ", None, known[0][0], known[0][0]]
    for alias, _ in known * 3:
        x = list(alias)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x)) if x else 0
            rng.choice((lambda: x and x.pop(min(at, len(x) - 1)), lambda: x.insert(at, rng.choice(letters)), lambda: x and x.__setitem__(min(at, len(x) - 1), rng.choice(letters))))()
        names.append("".join(x))
    got = N.closest(spark.createDataFrame([(n,) for n in names], "raw string").repartition(4), spark.createDataFrame(known, "alias string, code string"), least=least).collect()
    want = brute(names, known, least, 4.0)
    assert {r.raw: (r.code, round(r.likeness, 9)) for r in got} == {k: (c, round(v, 9)) for k, (c, v) in want.items()} and len(got) == len(want) > 20


def test_numbers_are_mended(spark):
    cases = [
        ("예산 35O,OOO천원", True, "예산 350,000천원"), ("350.000", True, "350,000"), ("350.000", False, "350.000"), ("1.234.567 원", True, "1,234,567 원"), ("350, 000", True, "350,000"),
        ("SOS Is lost", True, "SOS Is lost"), ("3억 5천만윈", True, "3억 5천만원"), ("3월 5윈,", True, "3월 5원,"), ("l2,S00 l|", True, "12,500 l|"), ("A12O", True, "A12O"), ("", True, ""), (None, True, None), ("1O2l", True, "1021"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, said string, t boolean, want string")
    assert [(r.said, r.got) for r in rows.select("said", "want", ocr.fixed_numbers(F.col("said"), F.col("t")).alias("got")).collect() if r.got != r.want] == []


def test_words_are_mended(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("세부사업", "산출기초", "스마트쉘터", "스마트폴", "세출예산")], "word string")
    cases = ["세부샤업: 스마트쉘티를 설치", "산출기쵸 및 세부사업", "스마트폴구축", "가나다라 마바사", "세출예산을", "", None, "산출기쵸로 산출기쵸에서, 산출기쵸"]
    got = ocr.corrected(spark.createDataFrame(list(enumerate(cases)), "id int, text string").repartition(3), lexicon, "id", "text").collect()
    assert {r.id: r.corrected for r in got} == dict(enumerate(["세부사업: 스마트쉘터를 설치", "산출기초 및 세부사업", "스마트폴구축", "가나다라 마바사", "세출예산", "", None, "산출기초 산출기초에서, 산출기초"]))


def test_blocks_and_long_names_against_all_pairs(spark, monkeypatch):
    """Labels that share most of their words, of 20 to 150 letters, in many small blocks: none is compared as a row of its own."""
    monkeypatch.setattr(N, "BLOCK", 16), monkeypatch.setattr(N, "KNOWN", 10), monkeypatch.setattr(N, "CHUNK", 3)
    rng = random.Random(5)
    known = [(" ".join(rng.choice(("large", "small", "blue", "ring", "bolt", "plate")) for _ in range(rng.choice((4, 5, 13, 27)))) + f" #{k % 7}", f"C{k % 45}") for k in range(60)]
    names = [x[:at] + x[at + 1 :] for x, _ in known for at in (rng.randrange(len(x)), rng.randrange(len(x)))]
    got = N.closest(spark.createDataFrame([(n,) for n in names], "raw string"), spark.createDataFrame(known, "alias string, code string"), margin=1.0).collect()
    want = brute(names, known, N.LEAST, 1.0)
    assert {r.raw: (r.code, round(r.likeness, 9)) for r in got} == {k: (c, round(v, 9)) for k, (c, v) in want.items()} and len(got) == len(want) > 50
