import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tenderspring.llm import probminhash as P
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.001"


def plain_classes(texts):
    """Brute force: classes of plain Jaccard 0.8 over 5-word shingles."""
    sets, root = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i], root[i] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (texts[a] == texts[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_classes_are_those_of_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    base = " ".join(f"w{k}" for k in range(120))
    for k in range(12):
        words = base.split()
        words[9 * k + 3] = f"new{k}"
        texts[10_000 + k] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in P.near_duplicates(rows).collect()} == plain_classes(texts)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    a = Counter({f"a{k}": int(rng.integers(1, 6)) for k in range(120)})
    b = Counter({f"a{k}": int(rng.integers(1, 6)) for k in range(30, 150)})
    keys = sorted(set(a) | set(b))
    code = {k: np.uint64(P.W.word_hash(k)) for k in keys}
    sides = []
    for c in (a, b):
        s = np.array(sorted(code[k] for k in c), np.uint64)
        back = {v: k for k, v in code.items()}
        sides.append((s, np.array([c[back[x]] for x in s], float)))
    exact = P.probability_jaccard(*sides[0], *sides[1])
    brute = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in keys if a[d] and b[d])
    assert abs(exact - brute) < 1e-9
    m = 4096
    sigs = [P.signatures(s, w, np.array([0, len(s)]), m)[0] for s, w in sides]
    assert abs((sigs[0] == sigs[1]).mean() - exact) < 4 * (exact * (1 - exact) / m) ** 0.5


def test_far_members_of_one_band_still_meet(spark):
    """A chain whose ends aren't near each other is one class, whatever its smallest id."""
    words = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(6):
        for j in range(4):
            words[30 * k + 6 * j] = f"x{k}{j}"
        texts.append((k, " ".join(words)))
    found = P.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0} and all(r.n_links >= 1 for r in found)


def test_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (6, "a b"), (6, "a b"), (7, "a c"), (None, "z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(list)
    for r in P.near_duplicates(df).collect():
        found[r.doc_id].append(r.class_id)
    assert found[1] == [1] and found[2] == [2] and found[4] == [3] and found[6] == [5, 5] and found[7] == [7] and len(found[None]) == 2
    kept = [r.doc_id for r in P.keep_one(df.selectExpr("*", "1 as id", "text as same")).collect()]
    assert Counter(kept) == Counter([1, 2, 3, 5, 7, None, None])
    assert P.near_duplicates(df.limit(0)).count() == 0 and P.keep_one(df.limit(0)).count() == 0


def test_one_is_kept_whatever_the_columns_are_called(spark):
    rows = [(1, "a b c", 7, 8, 9), (2, "a b c", 1, 2, 3), (3, "d e f", 4, 5, 6), (3, "d e f", 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, _digest long, _n long").selectExpr("*", "11 as _same", "12 as key", "13 as row", "14 as nth", "15 as _id", "16 as `a.b`")
    got = sorted(map(tuple, P.keep_one(df).collect()))
    assert P.keep_one(df).columns == df.columns
    assert got == [(1, "a b c", 7, 8, 9, *range(11, 17)), (3, "d e f", 4, 5, 6, *range(11, 17))]


def test_words_end_where_the_pattern_says():
    h, begins, _, _ = P.W.words(pa.array(["a\tb\x0bc", "", " d ", "é é"], pa.large_string()))
    assert list(np.diff(begins)) == [3, 0, 1, 1] and int(h[3]) == P.W.word_hash("d")


def repeated(k, times):
    """Two texts with the same shingles but for four; the second repeats a line."""
    words = [f"v{k}x{j}" for j in range(100)]
    return " ".join(words), " ".join(words + words[20:32] * times)


def test_copies_that_repeat_a_line_are_found(spark):
    texts = {2 * k + j: t for k in range(12) for j, t in enumerate(repeated(k, 50))}
    found = P.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == plain_classes(texts) == {i: i - i % 2 for i in texts}


def test_fine_filter_keeps_pairs_that_are_near_by_either_measure(spark):
    rows = spark.createDataFrame([(j, t, 5, 9, j, 2, j == 1, [k + 100 * j for k in range(P.BANDS)]) for j, t in enumerate(repeated(0, 50))], "id long, text string, band int, value long, root long, n long, stray boolean, bands array<long>")
    fine = P._fine(rows.select("id", "text"), rows.select("id"), 5).join(rows.select("id", "bands"), "id")
    got = P._further_pairs(rows.select("band", "value", "id", "root", "n", "stray"), fine, 0.8, True).collect()
    assert [(r.a, r.b) for r in got] == [(1, 0)]
