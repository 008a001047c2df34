import random

from tenderspring.operators import matching


def sequential(pairs):
    best = {}
    for a, b, s in pairs:
        if a is not None and b is not None and s is not None:
            best[a, b] = max(best.get((a, b), s), s)
    used_a, used_b, out = set(), set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), out.add((a, b, s))
    return out


def test_rounds_are_the_sequential_greedy(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(60), rng.choice([0.25, 0.5, 0.75, 1.0])) for _ in range(500)] + [(None, 1, 1.0), (1, None, 1.0), (1, 1, None)]
    rows += [(100 + k, 100 + k, 1000.0 - 2 * k) for k in range(12)] + [(101 + k, 100 + k, 999.0 - 2 * k) for k in range(12)]  # a chain: each round settles its head
    got = matching.matched(spark.createDataFrame(rows, "p long, q long, s double").repartition(3), "p", "q", "s")
    assert {tuple(r) for r in got.collect()} == sequential(rows) and got.columns == ["p", "q", "s"]
    assert matching.matched(spark.createDataFrame([], "p long, q long, s double"), "p", "q", "s").collect() == []


def test_codes_are_followed(spark):
    moves = [(f"c{k:03}", f"c{k + 1:03}") for k in range(100)] + [("x", "y"), ("y", "z"), ("z", "y"), ("a", "a"), ("b", None), ("t", "u"), ("t", "s")]
    got = {r.code: (r.last, r.steps, r.cyclic) for r in matching.followed(spark.createDataFrame(moves, "code string, new_code string")).collect()}
    want = {f"c{k:03}": ("c100", 100 - k, False) for k in range(100)} | {c: (None, None, True) for c in "xyz"} | {"t": ("s", 1, False)}
    assert got == want


def test_curated_rows_win(spark):
    schema = "code string, name string, aliases array<string>"
    curated = spark.createDataFrame([("1", "own", ["a", "b"]), ("3", "only", None)], schema)
    generated = spark.createDataFrame([("1", "made", ["b", "c"]), ("2", "new", ["d"])], schema)
    assert sorted(map(tuple, matching.curated_first(curated, generated).collect())) == [("1", "own", ["a", "b", "c"]), ("2", "new", ["d"]), ("3", "only", [])]
