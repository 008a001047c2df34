import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderspring.llm import decision_list as D
from tenderspring.llm.shared import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def stats(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (r.s.n_words, r.s.word_chars, r.s.n_symbols, r.s.n_dup_lines, r.s.n_repeat_words) for r in df.select("doc_id", D.statistics(F.col("text")).alias("s")).collect()}


def test_statistics_are_those_of_brute_force(spark):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + [None, "", " \n\x0b", "a a a a a a", "é　é b\n\nb\nb", "x " * 3000, "#|<> 𝒳"]
    assert stats(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_statistics_of_made_up_texts(spark):
    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.text(alphabet="ab \n\t#é", max_size=80), min_size=20, max_size=40))
    def hold(texts):
        assert stats(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}

    hold()


def test_verdicts(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows, learned = D.judged(docs, labels)
    assert learned.rules and "reject if" in str(learned)
    got = {r.doc_id: r.verdict for r in rows.collect()}
    assert len(got) == docs.count()
    for v in got.values():
        assert v.base_failed == (v.n_words < 10 or 100 * v.n_repeat_words > 20 * v.n_words) and v.kept == (not v.base_failed and v.rule == 0)
    marked = [(r.quality, got[r.doc_id]) for r in labels.where(D.held_out(F.col("doc_id"))).collect()]
    good = [v for q, v in marked if q == 1 and not v.base_failed]
    bad = [v for q, v in marked if q == 0]
    assert sum(v.kept for v in good) / len(good) > 0.97 and sum(not v.kept for v in bad) / len(bad) > 0.9


def test_a_rule_that_is_there_is_found(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.repeat(F.lit("w% "), 20)).otherwise(F.concat(F.repeat(F.lit("word "), 1), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("t"), k.cast("string"))), " "))).alias("text"))
    labels = rows.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    judged, learned = D.judged(rows, labels)
    assert len(learned.rules) == 1 and len(learned.rules[0]) == 1
    assert judged.where("(verdict.rule > 0) <> (doc_id % 5 = 0)").count() == 0


def test_edges_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k")], "doc_id long, text string").selectExpr("*", "1 as id", "'x' as s", "2 as verdict", "3 as row")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows, learned = D.judged(df, labels, carry=df.columns[:5])
    assert not learned.rules and rows.count() == 4 and D.judged(df.limit(0), labels)[0].count() == 0
    plan = df.select(D.statistics(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
