"""Small made-up Korean records for tests, and what the domain operators make of them: name -> (rows, what was worked out by hand)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspring.functions import dates, money, text, vectors
from tenderspring.operators import chunking, entities, extraction, grounding, linkage, ranking
from tenderspring.sources import records

TODAY = date(2026, 9, 25)
WORLD, EXPECTED = {}, {}


class Spark:
    """Stands where queries have their tables: here there are none."""

    def __init__(self, spark) -> None:
        self.spark = spark


def query(sql=None):
    def add(f):
        WORLD[f.__name__] = lambda spark: f(Spark(spark))
        if sql:
            EXPECTED[f.__name__] = sql
        return f

    return add



#: signal, document, institution, stage, title, category, department, won, year, half, commitment, keywords, day, plan, spec, bid, listed bids, cancelled bid
_SIGNALS = [
    (1, 1, "LG-11680", "council_mention", "스마트쉘터 설치", "smart_city", "교통과", 350_000_000, 2026, None, "committed", ["스마트쉘터"], date(2025, 11, 20), None, None, None, [], None),
    (2, 2, "LG-11680", "budget_line", "스마트 버스정류장 조성사업", "smart_city", "교통과", 352_000_000, 2026, None, None, ["버스정류장"], date(2025, 12, 20), None, None, None, [], None),
    (3, 3, "LG-11680", "order_plan", "2026년 스마트쉘터 구축사업", "smart_city", "교통과", 350_000_000, 2026, "H2", None, ["스마트쉘터", "구축"], date(2026, 3, 2), "P-1", None, None, ["R26BK00000001"], None),
    (4, 4, "LG-11680", "bid_notice", "[긴급] 스마트쉘터 구축 (협상에 의한 계약)", "smart_city", "재무과", 345_000_000, None, None, None, [], date(2026, 9, 10), None, None, "R26BK00000001", [], None),
    (5, 5, "LG-11680", "council_mention", "공공도서관 리모델링", "facility", None, 900_000_000, 2027, "H1", "reviewing", ["도서관"], date(2026, 2, 1), None, None, None, [], None),
    (6, 6, "LG-41130", "order_plan", "CCTV 통합관제 고도화", "safety_cctv", "안전과", 200_000_000, 2026, "H2", None, ["CCTV"], date(2026, 4, 1), "P-2", None, None, [], None),
    (7, 7, "LG-41130", "order_plan", "CCTV 통합관제 고도화", "safety_cctv", "안전과", 210_000_000, 2026, "H2", None, ["CCTV"], date(2026, 4, 2), "P-3", None, None, [], None),
    (8, 8, "LG-41130", "prespec", "통합관제 고도화 용역", "safety_cctv", None, 205_000_000, None, None, None, [], date(2026, 5, 2), "P-2", "S-1", None, [], None),
    (9, 9, "LG-41130", "bid_notice", "통합관제 고도화", "safety_cctv", None, 205_000_000, None, None, None, [], date(2026, 6, 1), None, "S-1", "R26BK00000009", [], None),
    (10, 10, "LG-41130", "bid_notice", "통합관제 고도화 취소", "safety_cctv", None, None, None, None, None, [], date(2026, 6, 5), None, "S-1", "R26BK00000009", [], "R26BK00000009"),
    (11, 11, None, "council_mention", "태양광 설치", "energy_env", None, None, None, None, None, ["태양광"], date(2024, 1, 5), None, None, None, [], None),
]
_CALM = [
    ("a", "내년도 본예산에 스마트쉘터 7개소 추가 설치 사업비 3억 5천만원을 반영하겠습니다.", "스마트쉘터 7개소 추가 설치 사업비 3억 5천만원을 반영하겠습니다", 350_000_000, 2026, "내년도 본예산에", 0.8),
    ("b", "내년도 본예산에 스마트쉘터 7개소 추가 설치 사업비 3억 5천만원을 반영하겠습니다.", "스마트쉘터 7개소 추가 설치 사업비 3억 5천만원을 반영하겠습니다", 3_500_000_000, 2027, "내년도 본예산에", 0.8),
    ("c", "내년도 본예산에 스마트쉘터 7개소 추가 설치 사업비 3억 5천만원을 반영하겠습니다.", "드론 배송 시범사업에 10억원을 편성했습니다", None, None, None, 0.3),
    ("d", "내년도 본예산에 스마트쉘터 7개소  추가 설지 사업비 3억 5천만원을 반영하겠습니다.", "스마트쉘터 7개소 추가 설치 사업비 3억 5천만원", 350_000_000, None, None, 0.8),
]
_MINUTES = """○위원장 김철수  의사일정을 상정합니다.
○위원 이영희  스마트쉘터는 언제 설치합니까?
예산은 얼마입니까?
○교통과장 박민수  내년도에 3억 5천만원을 반영하겠습니다.
(의사봉 3타)
○위원장 김철수  산회를 선포합니다."""
_BUDGET = """부서: 교통과
세부사업: 스마트쉘터 설치  350,000  0  350,000
ㅇ 쉘터 7개소 50,000
기타 설명
부서: 안전과
세부사업: CCTV 설치  120,000  0  120,000"""


def signals(t: Spark) -> DataFrame:
    schema = linkage.SIGNAL.replace(", embedding array<double>", "")
    rows = t.spark.createDataFrame(_SIGNALS, schema)
    embed = vectors.hashed_features(64)
    return rows.withColumn("embedding", embed(F.concat_ws(" ", "title", F.concat_ws(" ", "keywords"))))


@query("""SELECT * FROM (VALUES (1, 1, 1.0::DOUBLE, 'seed', false), (1, 2, 0.8182::DOUBLE, 'similarity', false), (1, 3, 0.9811::DOUBLE, 'similarity', false), (1, 4, 1.0::DOUBLE, 'ref', false), (5, 5, 1.0::DOUBLE, 'seed', false), (6, 6, 1.0::DOUBLE, 'seed', false), (7, 7, 1.0::DOUBLE, 'seed', false), (6, 8, 1.0::DOUBLE, 'ref', false), (6, 9, 1.0::DOUBLE, 'ref', false), (6, 10, 1.0::DOUBLE, 'ref', false), (11, 11, 1.0::DOUBLE, 'seed', false)) v(opportunity_id, signal_id, score, method, tentative)""")
def link_world(t: Spark) -> DataFrame:
    return linkage.link(signals(t))


@query()
def opportunities_world(t: Spark) -> DataFrame:
    rows = signals(t)
    return linkage.opportunities(rows, linkage.link(rows), F.lit(TODAY))


@query()
def recommend_world(t: Spark) -> DataFrame:
    rows = signals(t)
    open_ones = linkage.opportunities(rows, linkage.link(rows), F.lit(TODAY)).withColumns({"region_code": F.substring_index("institution_code", "-", -1), "embedding": vectors.hashed_features(64)("title")})
    profiles = t.spark.createDataFrame([(1, ["스마트쉘터", "CCTV"], ["드론"], ["smart_city"], ["11"], 100_000_000, 500_000_000), (2, ["도서관"], ["리모델링"], [], [], None, None)], "org_id long, p_keywords array<string>, p_exclude array<string>, p_categories array<string>, p_regions array<string>, p_budget_min long, p_budget_max long")
    profiles = profiles.withColumn("p_embedding", vectors.hashed_features(64)(F.concat_ws(" ", "p_keywords")))
    return ranking.recommend(profiles, open_ones, F.lit(TODAY))


@query("""SELECT claim, found, score::DOUBLE AS score, start, "end", method, issues, verdict, budget_parsed, year_resolved FROM (VALUES ('a', true, 100.0, 9, 45, 'exact', []::VARCHAR[], 'accepted', 350000000, 2026), ('b', true, 100.0, 9, 45, 'exact', ['budget_mismatch', 'year_unverified'], 'needs_review', 350000000, 2026), ('c', false, 0.0, NULL, NULL, 'missing', ['evidence_not_found', 'low_confidence'], 'rejected', NULL, NULL), ('d', true, 96.3, 9, 37, 'fuzzy', []::VARCHAR[], 'accepted', 350000000, NULL)) v(claim, found, score, start, "end", method, issues, verdict, budget_parsed, year_resolved)""")
def ground_quote(t: Spark) -> DataFrame:
    rows = t.spark.createDataFrame(_CALM, "claim string, source string, quote string, budget long, year int, timing string, confidence double")
    rows = rows.withColumn("at", grounding.locate_quote("source", "quote"))
    rows = rows.withColumn("span", F.when(F.col("at.found"), F.substring("source", F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))))
    rows = rows.withColumn("amounts", F.coalesce(F.transform(money.find_amounts("span"), lambda a: a["value"]), F.array().cast("array<long>")))
    verdict = grounding.verified(F.col("at"), F.col("span"), F.col("budget"), F.col("amounts"), F.col("year"), F.col("timing"), F.lit(date(2025, 11, 20)), F.col("confidence"))
    return rows.select("claim", "at.*", verdict.alias("v")).select("claim", "found", "score", "start", "end", "method", "v.*")


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, kind, labels, start, "end", text FROM (VALUES (1, 'procedure', ['위원장 김철수'], 0, 22, '○위원장 김철수  의사일정을 상정합니다.'), (1, 'exchange', ['위원 이영희', '교통과장 박민수'], 23, 93, '○위원 이영희  스마트쉘터는 언제 설치합니까?' || chr(10) || '예산은 얼마입니까?' || chr(10) || '○교통과장 박민수  내년도에 3억 5천만원을 반영하겠습니다.'), (1, 'procedure', ['위원장 김철수'], 103, 123, '○위원장 김철수  산회를 선포합니다.')) v(doc_id, kind, labels, start, "end", text)""")
def minutes_chunks(t: Spark) -> DataFrame:
    return chunking.minutes(t.spark.createDataFrame([(1, _MINUTES)], "doc_id long, text string"))


@query()
def budget_chunks(t: Spark) -> DataFrame:
    return chunking.budget_blocks(t.spark.createDataFrame([(1, _BUDGET)], "doc_id long, text string"))


@query("""SELECT said, CAST(won AS BIGINT) AS won FROM (VALUES ('3억 5천만원', 350000000), ('1조 2천', 1200000000000), ('2억 8천 5백원', 200008500), ('금 일억이천삼백원정', 100002300), ('이천시와 일부 구간', NULL)) v(said, won)""")
def money_parse(t: Spark) -> DataFrame:
    rows = t.spark.createDataFrame([("3억 5천만원",), ("1조 2천",), ("2억 8천 5백원",), ("금 일억이천삼백원정",), ("이천시와 일부 구간",)], "said string")
    return rows.select("said", money.parse_won("said", F.lit(1)).alias("won"))


@query("""SELECT * FROM (VALUES ('내년도 본예산에', 2026, NULL, '내년'), ('''27년 하반기 발주', 2027, 'H2', '''27년'), ('상반기 중 착수', 2026, 'H1', '상반기')) v(said, year, half, basis)""")
def timing_parse(t: Spark) -> DataFrame:
    rows = t.spark.createDataFrame([("내년도 본예산에", date(2025, 11, 20)), ("'27년 하반기 발주", date(2025, 11, 20)), ("상반기 중 착수", date(2025, 9, 1))], "said string, day date")
    return rows.select("said", dates.timing(F.col("said"), F.col("day")).alias("t")).select("said", "t.*")


@query("""SELECT CAST(signal_id AS BIGINT) AS signal_id, title, terms, category, confidence::DOUBLE AS confidence FROM (VALUES (1, '스마트쉘터 설치', ['스마트쉘터'], 'smart_city', 1.0), (2, '스마트 버스정류장 조성사업', ['스마트쉘터'], 'mobility', 1.0), (3, '스마트쉘터 구축사업', ['스마트쉘터'], 'smart_city', 1.0), (4, '스마트쉘터 구축', ['스마트쉘터'], 'smart_city', 1.0), (5, '공공도서관 리모델링', ['리모델링'], 'facility', 0.533), (6, 'CCTV 통합관제 고도화', ['CCTV'], 'safety_cctv', 0.884), (7, 'CCTV 통합관제 고도화', ['CCTV'], 'safety_cctv', 0.884), (8, '통합관제 고도화 용역', [], 'safety_cctv', 0.792), (9, '통합관제 고도화', [], 'safety_cctv', 0.792), (10, '통합관제 고도화 취소', [], 'safety_cctv', 0.792), (11, '태양광 설치', ['태양광'], 'energy_env', 1.0)) v(signal_id, title, terms, category, confidence)""")
def titles_and_categories(t: Spark) -> DataFrame:
    rows = signals(t).select("signal_id", "title")
    return rows.select("signal_id", text.canonical_title(F.col("title")).alias("title"), text.canonical_terms(F.col("title")).alias("terms"), text.category_votes(F.col("title")).alias("c")).select("signal_id", "title", "terms", "c.*")

_INSTITUTIONS = [
    ("LG-11680", "서울특별시 강남구", "local_gov", "서울특별시", "강남구", ["강남구청"]), ("CN-11680", "서울특별시 강남구의회", "council", "서울특별시", "강남구", ["강남구의회"]),
    ("LG-41110", "경기도 수원시", "local_gov", "경기도", "수원시", ["수원시청"]), ("LG-36110", "세종특별자치시", "local_gov", "세종특별자치시", None, ["세종시청", "세종시"]), ("LG-26230", "부산광역시 부산진구", "local_gov", "부산광역시", "부산진구", []),
    ("LG-41610", "경기도 광주시", "local_gov", "경기도", "광주시", []), ("LG-51110", "강원특별자치도 춘천시", "local_gov", "강원특별자치도", "춘천시", ["춘천시청"]), ("LG-30140", "대전광역시 중구", "local_gov", "대전광역시", "중구", []),
    ("LG-11140", "서울특별시 중구", "local_gov", "서울특별시", "중구", []), ("LG-26350", "부산광역시 해운대구", "local_gov", "부산광역시", "해운대구", ["해운대구청"]),
]
_NAMES = [
    ("서울특별시 강남구청 스마트도시과", None), ("강남구의회", None), ("수원특례시 정보통신과", None), ("세종시청", None), ("부산진구청", None), ("경기도 광주시", None), ("강원도 춘천시청 정보통신과", None),
    ("중구청 기획예산과", None), ("중구청 기획예산과", "대전광역시"), ("서울교통공사", None), ("경기도 신성중학교", None), ("진주시 시설관리공단", None), (None, None),
]
_RESPONSE = '{"response":{"header":{"resultCode":"00"},"body":{"items":[{"orderPlanUntyNo":"P-9","bizNm":"쉘터 구축","nticeDt":"20260302","sumOrderAmt":"29,315,000","bidNtceNoList":"R26BK00000001000, R26BK00000002000","deptNm":""},{"bizNm":"no id"}],"totalCount":2}}}'


@query("""SELECT raw, hint, code, method, department, candidates FROM (VALUES ('서울특별시 강남구청 스마트도시과', NULL, 'LG-11680', 'exact', '스마트도시과', []::VARCHAR[]), ('강남구의회', NULL, 'CN-11680', 'exact', NULL, []), ('수원특례시 정보통신과', NULL, 'LG-41110', 'exact', '정보통신과', []), ('세종시청', NULL, 'LG-36110', 'exact', NULL, []), ('부산진구청', NULL, 'LG-26230', 'exact', NULL, []), ('경기도 광주시', NULL, 'LG-41610', 'exact', NULL, []), ('강원도 춘천시청 정보통신과', NULL, 'LG-51110', 'exact', '정보통신과', []), ('중구청 기획예산과', NULL, NULL, 'ambiguous', '기획예산과', ['LG-11140', 'LG-30140']), ('중구청 기획예산과', '대전광역시', 'LG-30140', 'context', '기획예산과', []), ('서울교통공사', NULL, NULL, 'none', NULL, []), ('경기도 신성중학교', NULL, NULL, 'none', NULL, []), ('진주시 시설관리공단', NULL, NULL, 'none', '시설관리공단', []), (NULL, NULL, NULL, 'none', NULL, [])) v(raw, hint, code, method, department, candidates)""")
def resolve_institution(t: Spark) -> DataFrame:
    institutions = t.spark.createDataFrame(_INSTITUTIONS, "code string, name string, kind string, sido string, sigungu string, aliases array<string>")
    return entities.resolve(t.spark.createDataFrame(_NAMES, "raw string, hint string"), institutions, "raw", "hint")


@query("""SELECT raw, code, likeness::DOUBLE AS likeness FROM (VALUES ('해운데구청', 'LG-26350', 91.6666666666667), ('강남구정', 'LG-11680', 90.9090909090909)) v(raw, code, likeness)""")
def misread_institution(t: Spark) -> DataFrame:
    institutions = t.spark.createDataFrame(_INSTITUTIONS, "code string, name string, kind string, sido string, sigungu string, aliases array<string>")
    return entities.misread(t.spark.createDataFrame([("해운데구청",), ("강남구정",), ("아무개청",)], "raw string"), institutions)


@query()
def procurement_records(t: Spark) -> DataFrame:
    landed = t.spark.createDataFrame([(_RESPONSE,)], "value string").select(F.try_parse_json("value").alias("body"))
    items = landed.select(F.explode(records.envelope_items(F.col("body"))).alias("item"))
    rows = records.mapped(items, "order_plan")
    return rows.withColumn("content_hash", records.content_hash(F.col("title"), F.lit(None).cast("string"), F.col("structured"))).drop("structured")


#: chunk, council, day, text
_EXCHANGES = [
    (1, "강남구의회", date(2025, 11, 20), "○위원 이영희 스마트쉘터 확대 계획이 있습니까?\n○교통과장 박민수 내년도 본예산에 스마트쉘터 설치 사업비 3억 5천만원을 반영하겠습니다. 감사합니다."),
    (2, "강남구의회", date(2025, 11, 20), "○위원 이영희 공공도서관은 어떻습니까?\n○문화과장 김하나 내부에서 살펴보겠습니다."),
    (3, "수원시의회", date(2025, 9, 1), "○의원 정다운 CCTV 통합관제 고도화를 서둘러 주십시오.\n○안전과장 최가람 예산이 부족하여 추진이 어렵습니다."),
    (4, "수원시의회", date(2025, 9, 1), "○위원장 김철수 산회를 선포합니다."),
    (5, "수원시의회", date(2025, 9, 1), None),
]
_LINES = [
    (1, "세부사업: 스마트쉘터 설치  350,000  0  350,000\nㅇ 쉘터 7개소", 1000, 2026), (2, "세부사업 CCTV 운영  20,000  0", 1000, 2026), (3, "세부사업: 보건소 운영 시스템 구축  1200000", 1, 2027),
    (4, "세부사업: 이름만 있음", 1000, 2026), (5, "기타 경비 10,000", 1000, 2026), (6, None, 1000, 2026),
]
_RECORDS = [
    (1, "order_plan", "2026년 스마트쉘터 구축사업", "LG-11680", 350_000_000, 2026, 9, None, None, date(2026, 3, 2)), (2, "bid_notice", "[긴급] CCTV 설치 (긴급)", "CN-11680", None, None, None, "취소공고", "R26BK00000001", date(2026, 5, 2)),
    (3, "prespec", "무엇인가", None, 5, None, 6, None, None, date(2026, 5, 3)),
]


@query("""SELECT * FROM (VALUES (1, '스마트쉘터 설치', 'smart_city', 'committed', 350000000, 2026, NULL, '내년도 본예산에 스마트쉘터 설치 사업비 3억 5천만원을 반영하겠습니다.', 0.8::DOUBLE), (3, 'CCTV 통합관제 고도화', 'safety_cctv', 'declined', NULL, NULL, NULL, '예산이 부족하여 추진이 어렵습니다.', 0.54)) v(chunk, title, category, commitment, budget_krw, year, half, evidence, confidence)""")
def council_signals(t: Spark) -> DataFrame:
    """Signals read off exchanges of council minutes; the SQL has the rows that were worked out by hand."""
    rows = extraction.council_signals(t.spark.createDataFrame(_EXCHANGES, "chunk long, council string, day date, text string"))
    return rows.select("chunk", "title", "category", "commitment", "budget_krw", "timing.year", "timing.half", F.array_join("evidence", " / ").alias("evidence"), "confidence")


@query("""SELECT * FROM (VALUES (1, '스마트쉘터 설치', 'smart_city', 350000000, 2026, '세부사업: 스마트쉘터 설치  350,000  0  350,000'), (3, '보건소 운영 시스템 구축', 'welfare_care', 1200000, 2027, '세부사업: 보건소 운영 시스템 구축  1200000')) v(block, title, category, budget_krw, expected_year, evidence)""")
def budget_signals(t: Spark) -> DataFrame:
    rows = extraction.budget_signals(t.spark.createDataFrame(_LINES, "block long, text string, unit long, fiscal_year int"))
    return rows.select("block", "title", "category", "budget_krw", "expected_year", F.array_join("evidence", " / ").alias("evidence"))


@query("""SELECT * FROM (VALUES (1, 'order_plan', 'LG-11680', '스마트쉘터 구축사업', 'smart_city', 350000000, 2026, 'H2', 0.99::DOUBLE, 'accepted', NULL, DATE '2026-03-02'), (2, 'bid_notice', 'LG-11680', 'CCTV 설치', 'safety_cctv', NULL, 2026, NULL, 0.99, 'accepted', 'R26BK00000001', DATE '2026-05-02'), (3, 'prespec', NULL, '무엇인가', 'other', 5, 2026, 'H1', 0.6, 'needs_review', NULL, DATE '2026-05-03')) v(doc_id, stage, institution_code, title, category, budget_krw, expected_year, expected_half, confidence, verdict, cancels_bid_notice_no, observed_at)""")
def record_signals(t: Spark) -> DataFrame:
    docs = t.spark.createDataFrame(_RECORDS, "doc_id long, doc_type string, title string, institution_code string, amount_krw long, order_year int, order_month int, notice_kind string, bid_notice_no string, published_at date")
    return extraction.record_signals(docs, t.spark.createDataFrame([("CN-11680", "LG-11680")], "code string, executive_code string"))


@query("""SELECT * FROM (VALUES ('2026년도 본예산서', 2026, 'main'), ('2025년도 제1회 추경 예산서', 2025, 'supplementary'), ('예산서', NULL, 'main')) v(title, fiscal_year, budget_kind)""")
def budget_title_facts(t: Spark) -> DataFrame:
    rows = t.spark.createDataFrame([("2026년도 본예산서",), ("2025년도 제1회 추경 예산서",), ("예산서",)], "title string")
    return rows.select("title", text.title_facts(F.col("title")).alias("x")).select("title", "x.*")


@query("""SELECT * FROM (VALUES ('CCTV 교통 버스', 'mobility', 0.6::DOUBLE), ('스마트쉘터', 'smart_city', 1.0), ('아무 말', 'other', 0.0)) v(said, category, confidence)""")
def category_vote(t: Spark) -> DataFrame:
    """CCTV weighs 2, 교통 and 버스 1.5 each."""
    rows = t.spark.createDataFrame([("CCTV 교통 버스",), ("스마트쉘터",), ("아무 말",)], "said string")
    return rows.select("said", text.category_votes(F.col("said")).alias("x")).select("said", "x.*")


@query("""SELECT * FROM (VALUES (1, '강남구'), (2, '수원시'), (3, NULL)) v(id, said)""")
def decoded_text(t: Spark) -> DataFrame:
    """The same script in two encodings, and nothing."""
    raw = [(1, bytearray("강남구".encode())), (2, bytearray("수원시".encode("cp949"))), (3, None)]
    return t.spark.createDataFrame(raw, "id int, raw binary").select("id", text.decoded(F.col("raw")).alias("said"))


@query("""SELECT * FROM (VALUES (1, 'exchange', '위원 이영희', 0, 12), (2, 'record', '', 0, 4), (3, 'budget_line', '교통과', 8, 31), (4, 'text', '', 0, 1500), (4, 'text', '', 1300, 1600)) v(doc_id, kind, labels, start, "end")""")
def chunks_by_type(t: Spark) -> DataFrame:
    docs = t.spark.createDataFrame([(1, "council_minutes", "○위원 이영희 예산은?"), (2, "bid_notice", "입찰공고"), (3, "budget_book", "부서: 교통과\n세부사업: 스마트쉘터 설치  350,000"), (4, "other", "가" * 1600), (5, "other", " ")], "doc_id long, doc_type string, text string")
    return chunking.by_type(docs).select("doc_id", "kind", F.array_join("labels", ",").alias("labels"), "start", "end")
