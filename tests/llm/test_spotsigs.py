import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa

from tenderspring.llm import spotsigs as S
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.001"


def sets(texts):
    s, at = S.signatures(pa.array(texts, pa.large_string()), S.anchor_hashes())
    return [set(s[a:b].tolist()) for a, b in itertools.pairwise(at)]


def read(text):
    return np.frombuffer(base64.b64decode(text), "<u4")


def test_chains_follow_anchors():
    a, b, c = sets(["The quick fox is at home today", "THE quick, fox at rest... is at home today!", "nothing here whatever"])
    assert len(a & b) >= 1 and not a & c and len(c) == 1


def test_every_row_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.orderBy(docs.doc_id.desc()).collect()
    found = {r.id: r for r in S.edited_comparison(docs).collect()}
    prints = {r.id: np.array(r.fingerprint) for r in S.fingerprints(docs).collect()}
    assert len(found) == len(rows)
    for k, r in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after.text[:half]
        x = found[r.doc_id]
        assert x.n_chars == len(r.text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (read(x.fingerprint) == prints[r.doc_id]).all()
        assert x.near_next == S.likeness(read(x.fingerprint), read(found[after.doc_id].fingerprint))
        assert x.near_edited == S.likeness(read(x.fingerprint), read(x.edited_fingerprint))


def test_pairs_are_those_of_brute_force(spark):
    docs = table(spark, SF, "documents")
    prints = {}
    for r in S.fingerprints(docs).orderBy("id").collect():
        if r.fingerprint:
            prints.setdefault(tuple(r.fingerprint), r.id)
    brute = set()
    for (a, x), (b, y) in itertools.combinations(sorted((i, set(f)) for f, i in prints.items()), 2):
        if len(x & y) >= 0.8 * len(x | y):
            brute.add((a, b))
    assert {(r.a, r.b) for r in S.similar_pairs(docs).collect()} == brute


def test_edges(spark):
    rows = [(1, None), (2, "the"), (2, "Hello world, foo the bar"), (None, "!!"), (None, ""), (5, "the"), (6, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as part", "2 as key")
    found = S.edited_comparison(df).collect()
    assert len(found) == 7 and {r.n_chars for r in found if r.id == 1} == {0}
    same = [r.fingerprint for r in found if r.n_chars == 3]
    assert len(set(same)) == 1
    assert S.edited_comparison(df.limit(0)).count() == 0
    one = S.edited_comparison(df.where("id = 1 and text = 'Hello world, foo the bar'")).first()
    assert one.near_next == 1.0


def test_classes_and_pairs_cover_every_link(spark):
    """Copies are told by their class, links by pairs of representatives: together all that brute force finds."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 5000", "text")).union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the"), (9004, "the")], docs.schema))
    prints = {r.id: frozenset(r.fingerprint) for r in S.fingerprints(docs).collect()}
    twin = {r.id: r.twin for r in S.classes(docs).collect()}
    firsts = {}
    for i, f in prints.items():
        firsts[f] = min(i, firsts.get(f, i))
    assert twin == {i: firsts[f] for i, f in prints.items()}
    linked = {(r.a, r.b) for r in S.similar_pairs(docs).collect()}
    for x, y in itertools.combinations(sorted(i for i in prints if prints[i]), 2):
        near = len(prints[x] & prints[y]) >= 0.8 * len(prints[x] | prints[y])
        assert near == (twin[x] == twin[y] or tuple(sorted((twin[x], twin[y]))) in linked)
    asked = {(r.a, r.b) for r in S.similar_pairs(docs, queries=S.F.col("id") % 10 == 0).collect()}
    assert asked == {p for a, b in linked for p in ((a, b), (b, a)) if p[0] % 10 == 0}
    assert S.similar_pairs(docs.limit(0)).count() == 0 and S.classes(docs.limit(0)).count() == 0


def test_any_order_of_signatures_gives_the_same_pairs(spark):
    docs, before = table(spark, SF, "documents"), S.COMMON
    one = {(r.a, r.b) for r in S.similar_pairs(docs).collect()}
    S.COMMON = 3
    try:
        assert {(r.a, r.b) for r in S.similar_pairs(docs).collect()} == one
    finally:
        S.COMMON = before
