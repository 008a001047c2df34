import datetime as dt

from pyspark.sql import functions as F

from tenderspring.operators import linkage, ranking, relational
from korean_world import WORLD


def test_threads(spark):
    rows = {r.signal_id: r for r in WORLD["link_world"](spark).collect()}
    assert {s: r.opportunity_id for s, r in rows.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 6, 9: 6, 10: 6, 11: 11}
    assert rows[4].method == "ref" and rows[8].method == "ref" and rows[5].method == "seed"


def test_opportunities(spark):
    rows = {r.opportunity_id: r for r in WORLD["opportunities_world"](spark).collect()}
    a, c = rows[1], rows[6]
    assert (a.status, a.stage, a.title, a.signal_count, a.conversion_prob, a.best_commitment) == ("bid_open", "bid_notice", "스마트쉘터 구축", 4, 1.0, "committed")
    # The tender was withdrawn: the pre-specification is what is left.
    assert c.stage == "prespec" and c.bid_published_at is None and c.est_budget_krw == 205_000_000


def test_withdrawn_numbers():
    d = [dt.date(2026, 1, k) for k in range(1, 5)]
    f = linkage.withdrawn_numbers
    assert f([("A", None, d[1]), ("A", "A", d[2]), ("B", None, d[1])]) == {"A"}
    assert f([("A", None, d[1]), ("A", "A", d[2]), ("A", None, d[3])]) == set()
    assert f([("A", "A", d[2]), ("A", None, d[2])]) == {"A"} and f([(None, None, d[0])]) == set()


def test_ledger(spark):
    rows = [("x", 1, "k1", 10), ("x", 2, "k2", -15), ("x", 3, "k1", 10), ("x", 4, "k3", -4), ("y", 1, "k1", 3)]
    got = {(r.account, r.seq): (r.status, r.balance_after) for r in relational.replay_ledger(spark.createDataFrame(rows, "account string, seq int, idempotency_key string, delta int")).collect()}
    assert got == {("x", 1): ("applied", 10), ("x", 2): ("rejected", 10), ("x", 3): ("repeated", 10), ("x", 4): ("applied", 6), ("y", 1): ("applied", 3)}


def test_top_rows_of_a_hot_key_are_exact(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 1, id) as k", "id * 7919 % 10007 as v")
    got = sorted(r.id for r in relational.top_per_key(df, "k", [F.col("v").desc(), F.col("id")], 3).where("k = 1").collect())
    assert got == sorted(r.id for r in df.where("k = 1").orderBy(F.col("v").desc(), "id").limit(3).collect())


def test_ranking_parts(spark):
    r = spark.range(1).select(
        ranking.region_match(F.array(F.lit("11")), F.lit("11680")).alias("a"), ranking.region_match(F.array(F.lit("26")), F.lit("11680")).alias("b"), ranking.retry_delay(F.lit(3)).alias("c"), ranking.retry_delay(F.lit(5)).alias("d"),
        ranking.keyword_hits(F.array(F.lit("스마트 쉘터"), F.lit("드론")), F.lit("스마트쉘터 설치")).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.k) == (1.0, 0.0, 20, None, ["스마트 쉘터"])


def test_chunks(spark):
    kinds = [r.kind for r in WORLD["minutes_chunks"](spark).orderBy("start").collect()]
    assert kinds == ["procedure", "exchange", "procedure"]
    blocks = WORLD["budget_chunks"](spark).orderBy("start").collect()
    assert [b.department for b in blocks] == ["교통과", "안전과"] and blocks[0].end - blocks[0].start > 40
    verdicts = {r.claim: (r.verdict, r.method) for r in WORLD["ground_quote"](spark).collect()}
    assert verdicts == {"a": ("accepted", "exact"), "b": ("needs_review", "exact"), "c": ("rejected", "missing"), "d": ("accepted", "fuzzy")}


def test_recommend_has_all_candidate_sources(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from tenderspring.operators import ranking

    rows = [(1, "초대형CCTV설치", [], "x", [0.0, 1.0]), (2, "스마트 쉘터 조성", [], "x", [0.0, 1.0]), (3, "other", [], "x", [1.0, 0.0]), (4, "other", [], "y", None), (5, "other", ["cctv"], "x", None), (6, "other", [], "x", None)]
    live = spark.createDataFrame(rows, "opportunity_id long, title string, keywords array<string>, category string, embedding array<double>")
    live = live.selectExpr("*", "'open' as status", "'11' as region_code", "100000000L as est_budget_krw", "0.5D as conversion_prob", "date'2026-01-01' as bid_window_start", "date'2026-02-01' as bid_window_end")
    given = [(1, ["CCTV", " "], [], None), (2, ["스마트쉘터"], [], None), (3, ["마트 쉘"], [], None), (4, [], [], [1.0, 0.1]), (5, [], ["y"], None)]
    profiles = spark.createDataFrame(given, "org_id long, p_keywords array<string>, p_categories array<string>, p_embedding array<double>").selectExpr("*", "cast(array() as array<string>) as p_exclude", "cast(array() as array<string>) as p_regions", "cast(null as long) as p_budget_min", "cast(null as long) as p_budget_max")
    got = {}
    for r in ranking.recommend(profiles, live, F.lit(date(2025, 11, 20))).collect():
        got.setdefault(r.org_id, set()).add(r.opportunity_id)
    assert got == {1: {1, 5}, 2: {2}, 3: {2}, 4: {1, 2, 3}, 5: {4}}


def test_recommend_scores_few_of_many_pairs(spark, monkeypatch):
    """The best by score and id of all that share a key, with ties, nulls and blocks of a few rows, and no row for each pair."""
    import random
    from datetime import date, timedelta

    rng, scored, pairs = random.Random(3), ranking._scored, []
    monkeypatch.setattr(ranking, "ASKING", 4), monkeypatch.setattr(ranking, "BLOCK", 60), monkeypatch.setattr(ranking, "NEAREST", 2)
    monkeypatch.setattr(ranking, "_scored", lambda rows: pairs.append(rows.count()) or scored(rows))
    vector = lambda: rng.choice([None, [0.0, 0.0], [1.0, float("nan")], [1.0], *([rng.choice([1.0, 0.5, -1.0]), rng.random()] for _ in range(9))])
    some = lambda *values: rng.choice(values)
    live = [(k, f"{some('CCTV', '주차 안내', '누리집')} {k % 9}", some([], ["kw"], None), some("x", "x", "y", None), vector(), some("open", "bid_open"), some("11680", "26", "", None), some(None, 10**8, 3 * 10**8, 0), some(None, 0.5, 0.5, 0.85), date(2026, 1, 1) + timedelta(some(0, 50, 300)), None) for k in range(240)]
    live = spark.createDataFrame(live, "opportunity_id long, title string, keywords array<string>, category string, embedding array<double>, status string, region_code string, est_budget_krw long, conversion_prob double, bid_window_start date, bid_window_end date")
    given = [(k, some(["cctv"], ["주차안내", "KW"], ["ㅈ", None]), some([], ["누리집"], ["3", " "], None), some(["x"], ["x", "y"], ["y", None]), some([], ["11"], ["11680", None], None), some(None, 2 * 10**8), some(None, 2 * 10**8), vector()) for k in range(25)]
    profiles = spark.createDataFrame(given, "org_id long, p_keywords array<string>, p_exclude array<string>, p_categories array<string>, p_regions array<string>, p_budget_min long, p_budget_max long, p_embedding array<double>")
    today = F.lit(date(2025, 11, 20))
    found = ranking.recommend(profiles, live, today, 6, 4, 2)
    got = {(r.org_id, r.rank): (r.opportunity_id, r.score, str(r.features)) for r in found.collect()}
    bare = F.lower(F.regexp_replace("title", " ", ""))
    shared = F.exists("p_keywords", lambda k: F.contains(bare, F.lower(k)) | F.exists(F.coalesce("keywords", F.array()), lambda own: F.lower(own) == F.lower(k)))
    every = ranking.scored(profiles.crossJoin(live).where(F.coalesce(F.array_contains("p_categories", F.col("category")), F.lit(False)) | F.coalesce(shared, F.lit(False))), today)
    want = {}
    for r in every.orderBy("org_id", F.col("score").desc(), "opportunity_id").collect():
        want.setdefault(r.org_id, []).append((r.opportunity_id, r.score, str(r.features)))
    # What is only near by embedding comes besides.
    near = {(r.query_id, r.row_id) for r in ranking.ann.exactly(profiles, ranking.ann.built(live, 4, "opportunity_id"), 2, 2, "org_id", "p_embedding").collect()}
    more = ranking.scored(profiles.crossJoin(live), today).collect()
    for r in more:
        if (r.org_id, r.opportunity_id) in near and all(r.opportunity_id != o for o, *_ in want.get(r.org_id, [])):
            want.setdefault(r.org_id, []).append((r.opportunity_id, r.score, str(r.features)))
    order = lambda x: (x[1] is None, -(x[1] or 0), x[0])
    assert got == {(org, i): x for org, own in want.items() for i, x in enumerate(sorted(own, key=order)[:6], 1)}
    assert len(got) == 150 and any(x[1] is None for own in want.values() for x in own)
    assert pairs[0] < every.count() / 2


def test_long_exchanges_are_cut_after_a_full_stop(spark):
    from tenderspring.operators import chunking

    speech = "○위원 이영희 " + "예산을 반영해 주십시오. " * 300 + "\n○과장 박민수 " + "가" * 5000
    docs = spark.createDataFrame([(1, "council_minutes", speech), (2, "council_minutes", "말이 없는 회의"), (3, "budget_book", "부서: 안전과\n세부사업: CCTV 설치  120,000"), (4, "bid_notice", "공고"), (5, None, "x" * 2000), (6, "etc", " "), (7, None, None)], "doc_id long, doc_type string, text string")
    got = {}
    for r in chunking.by_type(docs).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r)
    parts = got[1]
    assert [p.start for p in parts[1:]] == [p.end for p in parts[:-1]] and parts[0].start == 0 and parts[-1].end == len(speech)
    assert all(p.kind == "exchange" and p.labels == ["위원 이영희", "과장 박민수"] and p.end - p.start <= chunking.MOST and p.text == speech[p.start : p.end] for p in parts)
    assert parts[0].text.endswith(".") and not parts[-2].text.endswith(".")
    assert [(k, [(r.kind, r.start, r.end) for r in v]) for k, v in got.items() if k > 1] == [(2, [("text", 0, 8)]), (3, [("budget_line", 8, 30)]), (4, [("record", 0, 2)]), (5, [("text", 0, 1500), ("text", 1300, 2000)])]
    assert got[3][0].labels == ["안전과"]


def test_measured_conversion_takes_the_place_of_priors(spark):
    from korean_world import TODAY, Spark, signals

    df = signals(Spark(spark))
    links = linkage.link(df)
    rates = spark.createDataFrame([("council_mention:reviewing", 0.5), ("order_plan:none", 0.4)], "cohort string, rate double")
    got = {r.opportunity_id: r.conversion_prob for r in linkage.opportunities(df, links, F.lit(TODAY), rates).collect()}
    assert got == {1: 1.0, 5: 0.5, 6: 0.98, 7: 0.4, 11: 0.35}
    means = {r.opportunity_id: r.embedding for r in linkage.mean_embeddings(df, links).collect()}
    assert set(means) == set(got) and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in means.values())


def test_documents_are_taken_apart_where_they_are_read(spark):
    from tenderspring.operators import chunking

    docs = spark.createDataFrame([(1, "council_minutes", "앞\n○위원 이영희  질문\n(웃음)\n○과장 박민수 답변\n\n○의장 김철수 끝"), (1, "budget_book", "부서: 교통과\n세부사업: 쉘터 1,000\nㅇ 산출\n\n기타"), (None, "council_minutes", None), (2, "council_minutes", "말 없음")], "doc_id long, doc_type string, text string")
    got = sorted((r.doc_id, r.kind, r.labels, r.start, r.end, r.text) for r in chunking.by_type(docs).collect())
    assert got == [
        (1, "budget_line", ["교통과"], 8, 27, "세부사업: 쉘터 1,000\nㅇ 산출"), (1, "exchange", ["위원 이영희", "과장 박민수"], 2, 29, "○위원 이영희  질문\n(웃음)\n○과장 박민수 답변"),
        (1, "procedure", ["의장 김철수"], 31, 40, "○의장 김철수 끝"), (2, "text", [], 0, 4, "말 없음"),
    ]
    for rows in (chunking.by_type(docs), chunking.minutes(docs), chunking.budget_blocks(docs)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_a_part_of_an_expression_is_computed_once(spark):
    from tenderspring.functions import dates, text

    rows = spark.range(2).select(F.concat(F.lit("교통 CCTV "), F.col("id").cast("string")).alias("words"), F.lit("2025-11-20").cast("date").alias("day"))
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(text.category_votes(F.col("words"))).count("lower(") == 1
    assert plan(dates.timing(F.col("words"), F.col("day"))).count("regexp_extract_all(") == 1
