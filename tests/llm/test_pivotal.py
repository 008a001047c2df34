import numpy as np
import pytest

from tenderspring.llm import pivotal as V
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights=V.WEIGHTS, share=V.SHARE, most=V.MOST):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), list(order), share * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / whole for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    return {r.source: r.target for r in V.source_plan(rows).collect()}


def test_targets(spark):
    t = targets(spark, {"b": 100, "a": 100, None: 100})
    assert t == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert targets(spark, {}) == {} and targets(spark, {"a": 0}) == {"a": 0.0}
    rng = np.random.default_rng(3)
    for n in (1, 4, 9, 30):
        sizes = {**{f"s{k:02}\U0001F600": int(rng.integers(0, 1000) ** 2) for k in range(n)}, "Z": 5, "é": 70, None: 0}
        assert targets(spark, sizes) == pytest.approx(brute_targets(sizes))


def test_rounding_keeps_words_and_chances():
    rng = np.random.default_rng(0)
    size, chance = np.sort(rng.integers(1, 50, 40).astype(float))[::-1].copy(), rng.random(40)
    sums = np.zeros(40)
    for seed in range(4000):
        out, held = V._round_block(size, chance, seed)
        assert (out * size).sum() == pytest.approx((chance * size).sum())
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != held)
        sums += out
    assert np.abs(sums / 4000 - chance).max() < 0.04


def test_trades_keep_every_chance():
    size, chance = np.array([10.0, 4.0, 3.0]), np.array([0.5, 0.9, 0.1])
    got = np.array([V._round_block(size, chance, seed)[0] for seed in range(20_000)])
    assert np.abs(got.mean(axis=0) - chance).max() < 0.012
    assert got @ size == pytest.approx(np.full(20_000, chance @ size))


def test_rates_over_many_levels(spark):
    """Ids drawn anew: over sources of 600 documents each, three levels deep with blocks of 8, rates are the chances."""
    before, V.BLOCK = V.BLOCK, 8
    try:
        docs = spark.range(60_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 + 20 * int(id % 50 = 0) as int)) as text", "cast(id % 100 as string) as source")
        rows = V.mixed(docs).selectExpr("mix.*").toPandas()
    finally:
        V.BLOCK = before
    rows["wanted"] = rows.target / rows.source_size
    rates = rows.groupby("size").agg(copies=("copies", "mean"), wanted=("wanted", "mean"), n=("copies", "size"))
    assert len(rates) > 7 and ((rates.copies - rates.wanted).abs() < 2.5 / rates.n**0.5).all()
    sums = rows.groupby(["source_size", "target"]).taken.sum()
    assert len(rows) == 60_000 and rows.taken.le(2 * rows["size"]).all() and abs(rows.taken.sum() - 1.5 * rows["size"].sum()) < 100 * 27 and len(sums)


def test_mix(spark):
    docs = table(spark, SF, "documents")
    a = {r.doc_id: r.mix for r in V.mixed(docs).collect()}
    b = {r.doc_id: r.mix for r in V.mixed(docs.repartition(7)).collect()}
    assert a == b and len(a) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, most = {}, {}, {}
    for k, m in a.items():
        s = source[k]
        taken[s], target[s], most[s] = taken.get(s, 0) + m.taken, m.target, max(most.get(s, 0), m.size)
        assert m.taken == m.copies * m.size <= 2 * m.size
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)


def test_a_hot_source_goes_through_several_levels(spark):
    docs = spark.range(70_000).selectExpr("id as doc_id", "'w w w' as text", "if(id % 10 = 0, 'b', 'a') as source")
    rows = V.mixed(docs, carry=["doc_id", "source"]).selectExpr("source", "mix.*").groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 3 for r in rows)


def test_repeated_rows_are_taken_in_a_stated_order(spark):
    rows = [(7, f"w{k} x", "a") for k in range(40)] * 3 + [(8, "y z", "b")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.text, r.mix.copies) for r in V.mixed(d, carry=["doc_id", "text"]).collect()) for d in (df, df.repartition(5)))
    assert one == two and len(one) == 150
    target = {r.mix.target for r in V.mixed(df).where("doc_id = 7").collect()}.pop()
    assert abs(2 * sum(c for t, c in one if t != "y z") - target) <= 2


def test_edges(spark):
    rows = [(1, None, "a"), (2, "b c", None), (2, "b c", None), (3, "", "b"), (None, "x", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as block", "3 as chance", "4 as mix")
    got = V.mixed(df, carry=df.columns, result="_mix").collect()
    assert len(got) == 5 and sorted(r._mix["size"] for r in got) == [0, 0, 1, 2, 2]
    assert V.mixed(df.limit(0)).count() == 0
    assert {r.mix.target for r in V.mixed(df.where("text is null")).collect()} == {0.0}
