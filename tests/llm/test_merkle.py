import hashlib
import zlib

import pytest

from tenderspring.llm import merkle as M
from tenderspring.llm.queries import op11_merkle_manifest
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """{position: (leaf, subroot, root, proof, path as indices)} of rows as tuples of COLUMNS, by plain loops."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            last = out[-1]
            out.append([h("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
        return out

    def siblings(tree, i):
        return [(i >> k, level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else "") for k, level in enumerate(tree[:-1])]

    groups = {}
    for at, r in enumerate(rows):
        groups.setdefault(r[2], []).append(at)
    order = sorted(groups, key=lambda g: b"" if g is None else b"." + g.encode())
    own = {g: sorted(groups[g], key=lambda a: (rows[a][0] is not None, rows[a][0] or 0, leaf(rows[a]))) for g in order}
    trees = {g: levels([leaf(rows[a]) for a in own[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = {}
    for k, g in enumerate(order):
        for i, at in enumerate(own[g]):
            out[at] = (leaf(rows[at]), trees[g][-1][0], top[-1][0], siblings(trees[g], i) + siblings(top, k))
    return out


def fold(digest, path):
    for i, other in path:
        digest = h(other + digest if i & 1 else digest + other)
    return digest


def odd_rows():
    rows = [(i, f"s{i % 3}", ("en", "fr", None)[i % 3], i if i % 5 else None, "é" * (i % 7) if i % 4 else None) for i in range(43)]
    return rows + [(None, None, "en", None, None), (None, "x", "en", 1, ""), (50, None, "öl", 3, "alone"), (7, "s1", "fr", 7, "é" * 0), (3, "a", "zz", 1, "x"), (3, "a", "zz", 1, "x")]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_every_column_against_plain_loops(spark, bits):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' as key", "1 as path", "2 as index", "3 as n").repartition(5)
    got = M.manifest(frame, COLUMNS, bits=bits).select("id", "leaf", "subroot", "root", M.proof_digest(M.F.col("path")).alias("proof"), M.folded(M.F.col("leaf"), M.F.col("path")).alias("folded"))
    want = [(rows[at][0], a, b, c, h("".join(s for _, s in path)), c) for at, (a, b, c, path) in plain(rows).items()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_query_with_tampered_rows(spark):
    docs = table(spark, SF, "documents").select(*COLUMNS).collect()
    expected = plain([tuple(r) for r in docs])
    got = {r.doc_id: r for r in op11_merkle_manifest(spark, SF).collect()}
    assert len(got) == len(docs)
    for at, r in enumerate(docs):
        own, subroot, root, path = expected[at]
        bad = zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        folded = fold(leaf((*r[:3], r.n_chars + bad, r.text)), path)
        assert tuple(got[r.doc_id]) == (r.doc_id, own, subroot, root, h("".join(s for _, s in path)), folded, not bad)


def test_no_rows_and_a_single_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert M.manifest(spark.createDataFrame([], schema), COLUMNS).collect() == []
    one = M.manifest(spark.createDataFrame([(None, None, None, None, None)], schema), COLUMNS).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in one] == [(h("-----"), h("-----"), h("-----"), [])]
