import numpy as np
import pyarrow as pa

from tenderspring.llm import neighbour_quality as Q
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_votes_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows, voters = unit(rng.normal(size=(300, 8))), unit(rng.normal(size=(90, 8)))
    y, w = rng.integers(0, 2, 90).astype(float), rng.random(90) + 0.5
    got = Q.vote(rows, voters, y, w, 7)
    for i in range(300):
        s = rows[i] @ voters.T
        near = np.argsort(-s)[:7]
        v = np.maximum(s[near], 0) * w[near]
        assert abs(got[i] - (v * y[near]).sum() / v.sum()) < 1e-5


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = Q.scored(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    assert len(rows) > 60 and sum((r.score >= 0.7) == (r.quality == 1) for r in rows) / len(rows) > 0.93


def test_scores_use_the_text_alone(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = {r.id: r.score for r in Q.scored(docs, labels).collect()}
    b = {r.id: r.score for r in Q.scored(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "1 as id", "2 as y"), labels).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-3


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (None, "hello there"), (4, "\n \n"), (3, "a b c")], "doc_id long, text string")
    found = Q.scored(df, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in Q.scored(df, labels.limit(0)).collect()} == {0.0}
    assert Q.scored(df.limit(0), labels).count() == 0


def test_terms_of_a_long_text():
    x = Q.term_weights(pa.array(["ab " * 200_000, "", "ab"], pa.large_string()))
    assert np.isfinite(x).all() and not x[1].any() and x[0, 256 + Q.TRIGRAMS + 1] > x[2, 256 + Q.TRIGRAMS + 1]


def test_equally_near_voters_count_in_order():
    rows = np.array([[1.0, 0.0]], np.float32)
    voters = np.array([[0.5, 0.5], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], np.float32)
    assert Q.vote(rows, voters, np.array([1.0, 0, 1, 1, 1]), np.ones(5), 2)[0] == 0.5
    assert Q.vote(rows, voters, np.array([1.0, 0, 1, 1, 1]), np.ones(5), 3)[0] == 0.666667


def test_term_weights_against_plain_counts():
    texts = ["a b a\nline here now\nline here now", "héllo wörld", "x"]
    got = Q.term_weights(pa.array(texts, pa.large_string()))
    for t, row in zip(texts, got, strict=True):
        raw, words = t.encode(), t.split()
        want = np.zeros(Q.TERMS)
        for c in raw:
            want[c] += 1
        at = 256 + Q.TRIGRAMS
        want[at] = sum(x == y for x, y in zip(words, words[1:], strict=False))
        want[at + 1] = len(words) - len(set(words))
        lines = [x for x in t.split("\n") if x]
        want[at + 2] = 10 * (len(lines) - len(set(lines)))
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        want[at + 3] = len(runs) - len(set(runs))
        for w in words:
            want[Q.TERMS - Q.WORDS + Q.W.word_hash(w) % Q.WORDS] += 1
        want = np.rint(64 * np.log1p(1000 * want / max(200, len(raw)))) / 64
        trigrams = slice(256, 256 + Q.TRIGRAMS)
        assert (np.delete(row, np.r_[trigrams]) == np.delete(want, np.r_[trigrams])).all() and (row[trigrams] > 0).sum() <= max(0, len(raw) - 2)


def test_the_whole_query_against_brute_force_and_in_any_order(spark):
    """Every score from the definition: tf-idf Gram matrix of all texts, its leading eigenvectors, cosines with
    the sampled voters, the nearest of them; the same to the last digit however rows are dealt out."""
    docs, labels = table(spark, SF, "documents").where("doc_id < 300").select("doc_id", "text"), table(spark, SF, "labels")
    got = {r.id: r.score for r in Q.scored(docs, labels).collect()}
    assert got == {r.id: r.score for r in Q.scored(docs.repartition(7), labels).collect()}
    rows = docs.collect()
    x = {r.doc_id: Q.term_weights(pa.array([r.text], pa.large_string()))[0] for r in rows}
    every = np.array(list(x.values()))
    idf = np.log((1 + len(rows)) / (1 + (every > 0).sum(axis=0))) + 1
    _, v = np.linalg.eigh((every.T @ every) * idf[:, None] * idf[None, :])
    axes = v[:, ::-1][:, : Q.LATENT]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(Q.LATENT)] < 0, -1, 1)

    def latent(w):
        z = np.array([(w * idf * axes[:, k]).sum() for k in range(Q.LATENT)])
        return np.rint(2048 * z / max(np.linalg.norm(z), 1e-12)) / 2048

    import zlib

    marked = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    voters = [(tuple(latent(x[r.doc_id])), r.quality) for r in marked if r.doc_id in x]
    stands_for = {y: sum(r.quality == y for r in marked) / sum(q == y for _, q in voters) for y in (0, 1)}
    wrong = 0
    for i, w in x.items():
        z = latent(w)
        near = sorted(((-float(np.dot(z, t)), t[::-1], y) for t, y in voters))
        least = near[Q.NEIGHBOURS - 1][0]
        # Which of several equally near voters vote is told by their order; here only rows without such ties count.
        if near[Q.NEIGHBOURS][0] != least:
            votes = [(max(0.0, -s) * stands_for[y], y) for s, _, y in near[: Q.NEIGHBOURS]]
            want = sum(s * y for s, y in votes) / sum(s for s, _ in votes)
            wrong += abs(got[i] - want) > 2e-3
    assert wrong <= 3
