import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderspring.llm import kneser_ney as K
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.01"


def symbols(text):
    out = [0, 0, 0]
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
        elif out[-1] != 0:
            out.append(0)
    return out if len(out) > 3 and out[-1] == 0 else [*out, 0] if len(out) > 3 else out


def brute(texts):
    """log P of interpolated Kneser-Ney over 4-grams, from plain counts."""
    counts = {4: Counter(tuple(s[i : i + 4]) for t in texts for s in [symbols(t)] for i in range(len(s) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, total, types = {}, {}, {}
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = max(0.1, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.75)
        total[k], types[k] = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[k][g[:-1]] += v
            types[k][g[:-1]] += 1

    def p(g):
        q = 1 / (len(counts[1]) + 1)
        for k in range(1, 5):
            h = g[4 - k :]
            if total[k].get(h[:-1]):
                q = max(0, counts[k].get(h, 0) - d[k]) / total[k][h[:-1]] + min(1, d[k] * types[k][h[:-1]] / total[k][h[:-1]]) * q
        return math.log(q)

    return p


def test_probabilities_are_those_of_brute_force(spark):
    texts = ["The cat sat on the mat.", "A hat, that cat!", "tattoo TATTOO; cat"]
    model = K.fit(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"))
    p = brute(texts)
    for test in ("the cat", "zebra that sat"):
        s = symbols(test)
        grams = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
        hi, lo = (np.array([g[i] << 21 | g[i + 1] for g in grams]) for i in (0, 2))
        assert K.in_memory(model).log_probabilities(hi, lo, 0).tolist() == pytest.approx([p(g) for g in grams], rel=1e-5)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["abcab cabba", "bacca abc"]
    model = K.fit(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    a = [0, *map(ord, "abc")]
    hi, lo = np.full(4, ord("a") << 21 | ord("b")), np.array([ord("c") << 21 | x for x in a])
    # One part in symbols + 1 of the shortest back-off is for symbols never seen.
    assert 0.95 < np.exp(K.in_memory(model).log_probabilities(hi, lo, 0)).sum() <= 1.0 + 1e-6


def test_symbols_of_one_text_at_a_time_and_together():
    texts = ["Ab, cd!", "", "  x", "9 9", "É", None, "a\0b"]
    got, begins, letters = K._symbols(pa.array(texts, pa.large_string()).fill_null(""))
    for i, t in enumerate(texts):
        assert got[begins[i] : begins[i + 1]].tolist() == symbols(t or "") and letters[i] == sum(c.isalpha() for c in (t or "").lower())


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = K.identified(docs, carry=["doc_id", "lang"]).where(K.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200 and sum(r.lang == r.found.lang_pred for r in rows) / len(rows) > 0.99
    assert sum(r.found.rejected for r in rows) / len(rows) < 0.01


def test_rejects_languages_that_were_not_learned(spark):
    """Made-up words, another script, and languages in the same letters; the corpus's own words in two of its languages stay."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = [
        "xqzj kvwx qqzx jjkq zxvw qkjx " * 20, "Это русский текст, и он длинный. " * 20,
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
        "Het was de beste der tijden, het was de slechtste der tijden, het was de eeuw van wijsheid en dwaasheid.",
        "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan.",
    ]
    clean = {r.lang: r.text for r in docs.where("length(text) between 1500 and 3000").orderBy("doc_id").collect()}
    both = [clean["de"] + "\n" + clean["es"], clean["en"] + "\n" + clean["fr"]]
    rows = spark.createDataFrame([(2_000_000 + 4 * k, t, None) for k, t in enumerate([*odd, *both])], docs.schema)
    got = {r.doc_id: r.found.rejected for r in K.identified(docs.union(rows)).where("doc_id >= 2000000").collect()}
    assert [got[2_000_000 + 4 * k] for k in range(8)] == [True] * 6 + [False] * 2


def test_joins_give_what_a_broadcast_gives(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(9_000_001, None, "en"), (9_000_002, "", None), (9_000_004, "5 %", "de"), (9_000_005, "Ж" * 200, None), (9_000_005, "Ж" * 200, None)], docs.schema)
    one, two = (sorted((r.doc_id, r.found.lang_pred, r.found.rejected, r.found.n_letters, round(r.found.score, 9)) for r in K.identified(docs.union(more), most_broadcast=n).collect()) for n in (K.MOST_BROADCAST, 0))
    assert one == two and len(one) == docs.count() + 5


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 $$", "fr"), (4, "the and of the", None), (None, "the one", "en"), (5, "le un", "fr"), (5, "le un", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as row", "'x' as found", "2 as nats")
    got = K.identified(df).collect()
    assert len(got) == 7
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert r.found.lang_pred == "und" and r.found.rejected and r.found.score == 0
    assert K.identified(df.limit(0)).count() == 0
    unlearned = K.identified(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.found.lang_pred for r in unlearned} == {"und"}


def test_rare_grams_of_a_large_language_are_kept(spark):
    """More than 2**20 4-grams, and some seen once."""
    texts = ["the cat sat on the mat and " * 50] * 900 + ["a zebu, a zebra"]
    model = K.fit(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"))
    p, s = brute(texts), symbols("zebu zebra the cat")
    grams = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
    hi, lo = (np.array([g[i] << 21 | g[i + 1] for g in grams]) for i in (0, 2))
    assert K.in_memory(model).log_probabilities(hi, lo, 0).tolist() == pytest.approx([p(g) for g in grams], rel=1e-5, abs=1e-6)
    c = list(map(ord, "zeb"))
    nexts = sorted({x for t in texts[-2:] for x in symbols(t)})
    hi, lo = np.full(len(nexts), c[0] << 21 | c[1]), np.array([c[2] << 21 | x for x in nexts])
    assert 0.95 < np.exp(K.in_memory(model).log_probabilities(hi, lo, 0)).sum() <= 1.0 + 1e-6


def test_limits_come_from_every_text_left_out(spark, monkeypatch):
    class Seen(Exception):
        pass

    def entropies(docs, *_):
        raise Seen(docs.count())

    monkeypatch.setattr(K, "entropies", entropies)
    held = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    with pytest.raises(Seen) as seen:
        K.calibrated(held, K.Model(["en"], [9], held, 9), "doc_id", "text", "lang", 6.0)
    assert seen.value.args == (25_000,)


def test_grams_of_any_alphabet_in_little_memory():
    """A batch of 75 letters, in which few pairs occur, and one of thousands; tables once took 160 MB in each Python worker."""
    random = np.random.default_rng(1)
    for letters, n in ((75, 500_000), (5_000, 200_000)):
        step = random.integers(0, 12, n) if letters == 75 else random.integers(0, letters, n)
        s = np.concatenate((np.zeros(3, np.int64), 0x4E00 + np.cumsum(step) % letters, np.zeros(4, np.int64)))
        begins = np.array([0, n + 4, n + 7])
        tracemalloc.start()
        hi, lo, which, at = K._grams(s, begins)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80_000_000 and at.tolist() == [0, n + 1, n + 1]
        assert (hi[which] == s[: n + 1] << 21 | s[1 : n + 2]).all() and (lo[which] == s[2 : n + 3] << 21 | s[3 : n + 4]).all()
        both = list(zip(hi.tolist(), lo.tolist(), strict=True))
        assert both == sorted(set(both))


def test_a_carried_text_goes_to_the_tasks_once(spark, monkeypatch):
    sent, kept = [], K._scored_in_memory
    monkeypatch.setattr(K, "_scored_in_memory", lambda rows, *more: sent.append(rows.schema.simpleString()) or kept(rows, *more))
    rows = [(1, "the cat sat", "en"), (3, "le chat", "fr"), (4, None, "en"), (5, "", None), (6, "the mat, le sol", "en")]
    df = spark.createDataFrame(rows, "doc_id long, body string, lang string")
    with_text, without = ({r.doc_id: r for r in K.identified(df, text_col="body", carry=c).collect()} for c in (["lang", "body", "doc_id"], ["doc_id"]))
    assert [x.count("string") for x in sent[1::2]] == [2, 1]
    assert {k: r.found for k, r in with_text.items()} == {k: r.found for k, r in without.items()} and len(with_text) == 5
    assert {(r.doc_id, r.body, r.lang) for r in with_text.values()} == set(rows)
