import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from tenderspring.llm import decision_list, shared
from tenderspring.llm.shared import settle, table

sys.path.insert(0, str(Path(__file__).parent))

from test_decision_list import WORD, brute as statistics  # noqa: E402
from test_pivotal import brute_targets  # noqa: E402
from test_probminhash import plain_classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def settled(df):
    return settle(df, "stage")


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    rows, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = settled(stage(spark, rows, SF))
        assert rows.columns == docs.columns
        seen.append(Counter(r.doc_id for r in rows.select("doc_id").collect()))
    assert set(seen[0]) < set(docs.toPandas().doc_id) and set(seen[1]) <= set(seen[0]) and set(seen[2]) < set(seen[1]) and set(seen[3]) <= set(seen[2])
    assert max(seen[2].values()) == 1 and max(seen[3].values()) == 2
    pieces = corpus_pipeline.packed(spark, rows, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == seen[3]


def test_each_stage_against_brute_force(spark):
    """Every stage on documents with nulls, repeats and foreign texts, against plain Python on the same rows."""
    given = table(spark, SF, "documents")
    foreign = [
        "xqzj kvwx qqzx jjkq zxvw qkjx wqxj zzkq jxwq kvvq zqxx zqjj vqkz",
        "Questa mattina abbiamo camminato lungo il fiume, perché il cielo era limpido e ogni cosa sembrava già più vicina; nessuno voleva tornare a casa prima di mezzogiorno.",
        "Vanochtend liepen wij langs de rivier omdat het weer zo helder was en iedereen graag buiten bleef; niemand wilde vóór twaalf uur terug naar huis.",
    ]
    more = [(90_001, None, "en", "web", 0), (90_001, "", "en", None, 0), *((90_003 + i, text, None, None, 9) for i, text in enumerate(foreign))]
    twice = given.where("doc_id in (3, 5, 7)")
    docs = settled(given.union(twice).union(spark.createDataFrame(more, given.schema)))
    key = lambda rows: Counter((r.doc_id, r.text, r.source) for r in rows.collect())
    # Quality rules: the statistics by brute force, the learned list read from its text.
    learned = decision_list.learn(docs, table(spark, SF, "labels"))
    rejects = [[(c.feature, c.above, c.threshold) for c in rule] for rule in learned.rules]

    def keeps(text):
        n, chars, symbols, dup, repeated = statistics(text)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        words = WORD.findall(text or "")
        bare = "".join(words)
        share = lambda a, b: a / b if b else 0.0
        value = dict(zip(decision_list.FEATURES, (n, share(chars, n), share(symbols, n), share(dup, len(lines)), share(repeated, n), share(len(set(words)), n), share(sum("A" <= c <= "Z" for c in bare), chars), share(n, len(lines))), strict=True))
        rejected = any(all(value[f] > t if above else value[f] <= t for f, above, t in rule) for rule in rejects)
        return not (n < 10 or 100 * repeated > 20 * n) and not rejected

    rows = settled(corpus_pipeline.quality_rules(spark, docs, SF))
    assert key(rows) == Counter({k: n for k, n in key(docs).items() if keeps(k[1])})
    # Language: the foreign texts go, all of the corpus's own texts stay.
    after = settled(corpus_pipeline.language_id(spark, rows, SF))
    assert key(rows) - key(after) == Counter({(90_003 + i, text, None): 1 for i, text in enumerate(foreign)})
    # Near-duplicates: of each class by brute force the smallest id.
    rows, before = settled(corpus_pipeline.near_duplicates(spark, after, SF)), key(after)
    classes = plain_classes({i: t for i, t, _ in before})
    assert key(rows) == Counter({k: 1 for k in before if classes[k[0]] == k[0]})
    # Mixing: words near the targets, no text more than twice.
    mixed, size = key(settled(corpus_pipeline.source_mixing(spark, rows, SF))), lambda t: len(WORD.findall(t))
    sizes = Counter()
    for _, t, s in key(rows):
        sizes[s] += size(t)
    taken = Counter()
    for (_, t, s), n in mixed.items():
        taken[s] += n * size(t)
    assert set(mixed) <= set(key(rows)) and max(mixed.values()) <= 2
    assert all(abs(taken[s] - target) <= max(size(t) for _, t, x in key(rows) if x == s) for s, target in brute_targets(dict(sizes)).items())


def test_run_on_null_columns_and_an_empty_table(spark, tmp_path):
    good = ["Kiten ramo lus vira sen talo miri pan dos, el kora finu.", "Se ramu kiten los vora, sin tali mera pun das el kira."]
    some = [(1, None, None, None, None), (2, good[0], "en", None, 5), (None, good[1], "en", "s", 1), (4, "x", "en", "s", 1)]
    for name, rows, want in (("some", some, {2, None}), ("none", [], set())):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} <= want and all(r.start == 0 and r.length == r.doc_tokens for r in got) and len(got) >= len(want)


def test_a_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    n = corpus_pipeline.run(spark, SF).count()
    left = [p.name.rsplit("-", 1)[0] for p in tmp_path.glob("tenderspring/*/*")]
    assert n > 100 and left.count("packing") == 1
    # What the packing stage reads lazily was dropped with its scope, and so was every table of earlier stages.
    assert left == ["packing"]
