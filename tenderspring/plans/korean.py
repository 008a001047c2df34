"""Domain operators on Korean texts and records that are built from every row of the given tables, by arithmetic on
its key; the SQL works out from the same key what must come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text, vectors
from ..operators import chunking, entities, extraction, grounding, linkage, names, process, ranking
from ..sources import records
from .registry import Tables, query


def said(*parts: Column | str) -> Column:
    """Columns and words in one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def one_of(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def dealt(t: Tables, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to all cores before the work on each: what is small to read isn't small to work on, and would be
    one task for each part of a file."""
    return rows.repartition(3 * t.spark.sparkContext.defaultParallelism, key)


def order_signals(t: Tables) -> DataFrame:
    """Every order as a signal of one of 2,000 institutions, by arithmetic on its key: four in a row are a plan, its
    pre-specification, its notice and a mention in a council."""
    key, names = F.col("o_orderkey"), F.array(*map(F.lit, ("스마트쉘터 구축", "CCTV 통합관제", "주차안내 시스템", "누리집 개편", "태양광 설치", "도서관 리모델링", "디지털트윈 구축", "챗봇 도입")))
    project, step = F.floor(key / 4), F.pmod(key, F.lit(4))
    number = lambda kind, k: F.when(step == k, F.concat(F.lit(kind), project.cast("string")))
    title = F.concat_ws(" ", F.get(names, F.pmod(project, F.lit(8)).cast("int")), F.concat(F.pmod(project, F.lit(97)).cast("string"), F.lit("호")))
    rows = dealt(t, t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey").select(
        key.alias("signal_id"), key.alias("document_id"), F.concat(F.lit("LG-"), F.pmod(project, F.lit(2000)).cast("string")).alias("institution_code"),
        F.get(F.array(*map(F.lit, ("order_plan", "prespec", "bid_notice", "council_mention"))), step.cast("int")).alias("stage"), title.alias("title"), text.category_votes(title)["category"].alias("category"),
        F.lit(None).cast("string").alias("department"), (F.pmod(project, F.lit(50)) * 10_000_000 + 50_000_000).alias("budget_krw"), F.year("o_orderdate").alias("expected_year"), F.lit(None).cast("string").alias("expected_half"),
        F.lit(None).cast("string").alias("commitment"), F.array(title).alias("keywords"), F.to_date("o_orderdate").alias("observed_at"), F.when(step <= 1, F.concat(F.lit("P"), project.cast("string"))).alias("order_plan_no"),
        F.when((step == 1) | (step == 2), F.concat(F.lit("S"), project.cast("string"))).alias("prespec_no"), number("B", 2).alias("bid_notice_no"), F.array().cast("array<string>").alias("bid_notice_nos"), F.lit(None).cast("string").alias("cancels_bid_notice_no"),
    )
    return rows.withColumn("embedding", vectors.hashed_features(64)("title"))


@query()
def link_orders(t: Tables) -> DataFrame:
    """The opportunities that all orders, as signals, come to."""
    return linkage.link(order_signals(t))


@query()
def chunk_plain(t: Tables) -> DataFrame:
    places = chunking.windows(F.col("text"))
    return t.documents.select("doc_id", F.posexplode(places).alias("seq", "at"), "text").select("doc_id", "seq", "at.start", "at.end", F.substring("text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")).alias("text"))

_THINGS = ("스마트쉘터 구축", "CCTV 통합관제", "주차안내 시스템", "누리집 개편", "태양광 설치", "도서관 리모델링", "디지털트윈 구축", "챗봇 도입")
#: What each of _THINGS is bought as, in SQL.
_KIND_SQL = "['smart_city', 'safety_cctv', 'mobility', 'public_sw', 'energy_env', 'facility', 'smart_city', 'public_sw'][1 + CAST(o_orderkey % 8 AS INT)]"


def _won(t: Tables) -> tuple[Column, Column]:
    """(words for an amount, in one of four forms by the order's key, its whole price)."""
    key, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    comma = F.format_number(v, 0)
    words = F.when(key % 4 == 0, said((v / 1000).cast("long") + 1, "억 ", v % 1000 + 1, "만원")).when(key % 4 == 1, said(comma, "천원")).when(key % 4 == 2, said("금 ", comma, "원")).otherwise(said(v % 90 + 10, "백만원"))
    return words, v


_WON_SQL = "CASE o_orderkey % 4 WHEN 0 THEN (v // 1000 + 1) * 100000000 + (v % 1000 + 1) * 10000 WHEN 1 THEN v * 1000 WHEN 2 THEN v ELSE (v % 90 + 10) * 1000000 END"
_ORDERS_SQL = "(SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query(f"SELECT o_orderkey, {_WON_SQL} AS won FROM {_ORDERS_SQL}")
def money_parse(t: Tables) -> DataFrame:
    words, _ = _won(t)
    return t.orders.select("o_orderkey", money.parse_won(words, F.lit(1)).alias("won"))


@query("""SELECT o_orderkey, year(o_orderdate) + [1, 0, 2, CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END, 0, 1][1 + o_orderkey % 6] AS year, [NULL, 'H2', 'H1', 'H1', 'H2', 'H1'][1 + CAST(o_orderkey % 6 AS INT)] AS half FROM orders""")
def timing_parse(t: Tables) -> DataFrame:
    """Phrases for when something will be bought, said on the day of the order."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    short = F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0")
    phrases = ("내년도 본예산에", "하반기에 발주할 예정", said(year + 2, "년 상반기"), "상반기 중 착수", "제2회 추경에", said("'", short, "년 3월 발주"))
    words = F.get(F.array(*(F.lit(p) if isinstance(p, str) else p for p in phrases)), (key % 6).cast("int"))
    rows = t.orders.where(year.between(1900, 2098)).select("o_orderkey", "o_orderdate", F.when((key % 6 != 5) & (key % 6 != 2) | (year >= 1999), words).otherwise(F.lit(None)).alias("w"))
    # A year is read as one of this century.
    found = dates.timing(F.col("w"), F.to_date("o_orderdate"))
    return rows.select("o_orderkey", F.when(F.col("w").isNull(), F.year("o_orderdate") + F.when(key % 6 == 2, 2).otherwise(1)).otherwise(found["year"]).alias("year"), F.when(F.col("w").isNull(), F.lit("H1")).otherwise(found["half"]).alias("half"))


@query(f"""SELECT o_orderkey, ['스마트쉘터 구축', 'CCTV 통합관제', '주차안내 시스템', '누리집 개편', '태양광 설치', '도서관 리모델링', '디지털트윈 구축', '챗봇 도입'][1 + o_orderkey % 8] || ' ' || (o_orderkey % 97) || '호' AS title, ['스마트쉘터', 'CCTV', '주차안내', '누리집', '태양광', '리모델링', '디지털트윈', '챗봇'][1 + CAST(o_orderkey % 8 AS INT)] AS terms, {_KIND_SQL} AS category, CASE WHEN o_orderkey % 8 = 5 THEN 0.533 ELSE 1.0 END::DOUBLE AS confidence FROM orders""")
def titles_and_categories(t: Tables) -> DataFrame:
    """Titles of records: what surrounds them goes, and the words tell what is bought, and how
    surely: a library's remodelling is of two kinds, 2 to 1.75."""
    key = F.col("o_orderkey")
    title = said(one_of(("", "[긴급] ", "2027년 "), key), one_of(_THINGS, key), " ", key % 97, "호", one_of(("", " (협상에 의한 계약)"), key))
    plain = dealt(t, t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", text.canonical_title(title).alias("title"))
    return plain.select("o_orderkey", "title", F.array_join(text.canonical_terms(F.col("title")), ",").alias("terms"), text.category_votes(F.col("title")).alias("c")).select("o_orderkey", "title", "terms", "c.*")


@query("""SELECT o_orderkey, 2000 + CAST(o_orderkey % 50 AS INT) AS fiscal_year, CASE WHEN o_orderkey % 3 = 1 THEN 'supplementary' ELSE 'main' END AS budget_kind FROM orders""")
def budget_title_facts(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    title = said(2000 + key % 50, "년도 ", one_of(("본예산서", "제1회 추경 예산서", "예산서"), key))
    return t.orders.select("o_orderkey", text.title_facts(title).alias("x")).select("o_orderkey", "x.*")


@query("""SELECT p_partkey, ['mobility', 'smart_city', 'other'][1 + p_partkey % 3] AS category, [0.6, 1.0, 0.0][1 + p_partkey % 3]::DOUBLE AS confidence FROM part""")
def category_vote(t: Tables) -> DataFrame:
    """CCTV weighs 2, 교통 and 버스 1.5 each."""
    words = said(F.col("p_partkey"), " ", one_of(("CCTV 교통 버스", "스마트쉘터", "아무 말"), F.col("p_partkey")))
    return t.part.select("p_partkey", text.category_votes(words).alias("x")).select("p_partkey", "x.*")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN '강남구 ' || c_custkey END AS said FROM customer""")
def decoded_text(t: Tables) -> DataFrame:
    """The same script in two encodings by the customer's key, and nothing."""
    key = F.col("c_custkey")
    raw = F.when(key % 3 == 0, said("강남구 ", key).cast("binary")).when(key % 3 == 1, F.concat(F.unhex(F.lit("B0ADB3B2B1B8")), said(" ", key).cast("binary")))
    return t.customer.select("c_custkey", text.decoded(raw).alias("said"))


def _minutes(key: Column, amount: Column) -> Column:
    return said("○위원장 김철수  의사일정을 상정합니다.\n○위원 이영희  ", one_of(_THINGS, key), "은 언제 합니까?\n예산은 얼마입니까?\n○교통과장 박민수  내년도 본예산에 ", one_of(_THINGS, key), " 사업비 ", amount, "을 반영하겠습니다. 감사합니다.\n(의사봉 3타)\n○위원장 김철수  산회를 선포합니다.")


_MINUTES_SQL = f"""(SELECT o_orderkey, day, v, thing, won, '○위원장 김철수  의사일정을 상정합니다.' AS first, '○위원 이영희  ' || thing || '은 언제 합니까?' || chr(10) || '예산은 얼마입니까?' || chr(10) || '○교통과장 박민수  내년도 본예산에 ' || thing || ' 사업비 ' || won || '을 반영하겠습니다. 감사합니다.' AS exchange, '○위원장 김철수  산회를 선포합니다.' AS last
FROM (SELECT *, ['스마트쉘터 구축', 'CCTV 통합관제', '주차안내 시스템', '누리집 개편', '태양광 설치', '도서관 리모델링', '디지털트윈 구축', '챗봇 도입'][1 + o_orderkey % 8] AS thing, (v % 90 + 10) || '백만원' AS won FROM {_ORDERS_SQL}))"""


def _dealt(t: Tables) -> DataFrame:
    return dealt(t, t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey")


def _minuted(t: Tables) -> DataFrame:
    return _dealt(t).select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"), _minutes(F.col("o_orderkey"), said(F.floor("o_totalprice") % 90 + 10, "백만원")).alias("text"))


@query(f"""SELECT o_orderkey AS doc_id, unnest(['procedure', 'exchange', 'procedure']) AS kind, unnest(['위원장 김철수', '위원 이영희,교통과장 박민수', '위원장 김철수']) AS labels, unnest([0, length(first) + 1, length(first) + length(exchange) + 11]) AS start, unnest([length(first), length(first) + length(exchange) + 1, length(first) + length(exchange) + 11 + length(last)]) AS "end", unnest([first, exchange, last]) AS text FROM {_MINUTES_SQL}""")
def minutes_chunks(t: Tables) -> DataFrame:
    """Minutes of a session for every order: what the chair says, a question with its answer, the chair again."""
    return chunking.minutes(_minuted(t)).select("doc_id", "kind", F.array_join("labels", ",").alias("labels"), "start", "end", "text")


@query(f"""SELECT o_orderkey AS doc_id, '내년도 본예산에 ' || thing || ' 사업비 ' || won || '을 반영하겠습니다.' AS evidence, 'committed' AS commitment, (v % 90 + 10) * 1000000 AS budget_krw, year(day) + 1 AS year, {_KIND_SQL} AS category FROM {_MINUTES_SQL} WHERE o_orderkey % 8 NOT IN (1, 3)""")
def council_signals(t: Tables) -> DataFrame:
    """The signal that the exchange of every order's minutes gives; two of eight things have no name that ends as a project's."""
    chunks = chunking.minutes(_minuted(t), carry=("day",)).where("kind = 'exchange'")
    found = extraction.council_signals(chunks.select("doc_id", "day", "text"))
    return found.select("doc_id", F.array_join("evidence", " / ").alias("evidence"), "commitment", "budget_krw", "timing.year", "category")


def _booked() -> Column:
    key, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    return said("부서: ", one_of(("교통과", "안전과"), key), "\n세부사업: ", one_of(_THINGS, key), "  ", F.format_number(v + 1000, 0), "  0  ", F.format_number(v, 0), "\nㅇ ", v % 9 + 1, "개소\n기타 설명")


def _book(t: Tables) -> DataFrame:
    return _dealt(t).select(F.col("o_orderkey").alias("doc_id"), _booked().alias("text"))


def _both(t: Tables) -> DataFrame:
    """(doc_id, day, text, book): every order's minutes and its budget book."""
    minutes = _minutes(F.col("o_orderkey"), said(F.floor("o_totalprice") % 90 + 10, "백만원"))
    return _dealt(t).select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"), minutes.alias("text"), _booked().alias("book"))


_BOOK_SQL = f"""(SELECT *, '세부사업: ' || ['스마트쉘터 구축', 'CCTV 통합관제', '주차안내 시스템', '누리집 개편', '태양광 설치', '도서관 리모델링', '디지털트윈 구축', '챗봇 도입'][1 + o_orderkey % 8] || '  ' || format('{{:,}}', v + 1000) || '  0  ' || format('{{:,}}', v) AS line FROM {_ORDERS_SQL})"""


@query(f"""SELECT o_orderkey AS doc_id, ['교통과', '안전과'][1 + o_orderkey % 2] AS department, 8 AS start, 8 + length(line) + 1 + length('ㅇ 1개소') AS "end" FROM {_BOOK_SQL}""")
def budget_chunks(t: Tables) -> DataFrame:
    return chunking.budget_blocks(_book(t)).select("doc_id", "department", "start", "end")


@query(f"""SELECT o_orderkey AS doc_id, (v + 1000) * 1000 AS budget_krw, {_KIND_SQL} AS category, 2027 AS expected_year, line AS evidence FROM {_BOOK_SQL}""")
def budget_signals(t: Tables) -> DataFrame:
    """The signal of the block of every order's budget book."""
    blocks = chunking.budget_blocks(_book(t)).select("doc_id", "text", F.lit(1000).alias("unit"), F.lit(2027).alias("fiscal_year"))
    return extraction.budget_signals(blocks).select("doc_id", "budget_krw", "category", "expected_year", F.array_join("evidence", " / ").alias("evidence"))


@query(f"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'budget_mismatch' ELSE 'evidence_not_found' END AS issues, CASE WHEN o_orderkey % 3 < 2 THEN length(first) + 1 + strpos(exchange, '내년도') - 1 END AS start, CASE WHEN o_orderkey % 3 < 2 THEN (v % 90 + 10) * 1000000 END AS budget_parsed FROM {_MINUTES_SQL}""")
def ground_quote(t: Tables) -> DataFrame:
    """Claims about every order's minutes: a true one, one with ten times the amount, and one with a quote that isn't there."""
    key, v = F.col("doc_id"), F.floor("o_totalprice") % 90 + 10
    rows = _dealt(t).select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"), "o_totalprice", _minutes(F.col("o_orderkey"), said(v, "백만원")).alias("text"))
    quote = F.when(key % 3 == 2, "드론 배송 시범사업에 열 배의 예산을 편성하였다고 하였습니다").otherwise(said("내년도  본예산에 ", one_of(_THINGS, key), " 사업비 ", v, "백만원을 반영하겠습니다."))
    rows = rows.select("doc_id", "day", "text", quote.alias("quote"), (v * 1_000_000 * F.when(key % 3 == 1, 10).otherwise(1)).cast("long").alias("budget")).withColumn("at", grounding.locate_quote("text", "quote"))
    rows = rows.withColumn("span", F.when(F.col("at.found"), F.substring("text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))))
    rows = rows.withColumn("amounts", F.coalesce(F.transform(money.find_amounts("span"), lambda a: a["value"]), F.array().cast("array<long>")))
    budget = F.when(key % 3 < 2, F.col("budget"))
    verdict = grounding.verified(F.col("at"), F.col("span"), budget, F.col("amounts"), F.year("day") + 1, F.lit("내년도 본예산에"), F.col("day"), F.lit(0.8))
    return rows.select("doc_id", "at.start", verdict.alias("v")).select("doc_id", "v.verdict", F.array_join("v.issues", ",").alias("issues"), "start", "v.budget_parsed")


#: code, name, kind, province, district, aliases
_INSTITUTIONS = [
    ("LG-11680", "서울특별시 강남구", "local_gov", "서울특별시", "강남구", ["강남구청"]), ("CN-11680", "서울특별시 강남구의회", "council", "서울특별시", "강남구", ["강남구의회"]),
    ("LG-41110", "경기도 수원시", "local_gov", "경기도", "수원시", ["수원시청"]), ("LG-36110", "세종특별자치시", "local_gov", "세종특별자치시", None, ["세종시청", "세종시"]), ("LG-26230", "부산광역시 부산진구", "local_gov", "부산광역시", "부산진구", []),
    ("LG-30140", "대전광역시 중구", "local_gov", "대전광역시", "중구", []), ("LG-11140", "서울특별시 중구", "local_gov", "서울특별시", "중구", []), ("LG-26350", "부산광역시 해운대구", "local_gov", "부산광역시", "해운대구", ["해운대구청"]),
]
_SCHEMA = "code string, name string, kind string, sido string, sigungu string, aliases array<string>"


@query("""SELECT c_custkey, CASE WHEN n = 5 AND hinted THEN 'LG-30140' ELSE ['LG-11680', 'CN-11680', 'LG-41110', 'LG-36110', 'LG-26230', NULL, NULL][1 + n] END AS code, CASE WHEN n = 5 AND hinted THEN 'context' ELSE ['exact', 'exact', 'exact', 'exact', 'exact', 'ambiguous', 'none'][1 + n] END AS method, ['스마트도시과', NULL, '정보통신과', NULL, NULL, '기획예산과', NULL][1 + n] AS department, CASE WHEN n = 5 AND NOT hinted THEN 'LG-11140,LG-30140' ELSE '' END AS candidates FROM (SELECT c_custkey, CAST(c_custkey % 7 AS INT) AS n, c_custkey % 2 = 0 AS hinted FROM customer)""")
def resolve_institution(t: Tables) -> DataFrame:
    """Customers under names of institutions, by their keys; every other one says its province besides."""
    names_ = ("서울특별시 강남구청 스마트도시과", "강남구의회", "수원특례시 정보통신과", "세종시청", "부산진구청", "중구청 기획예산과", "서울교통공사")
    rows = t.customer.select("c_custkey", one_of(names_, F.col("c_custkey")).alias("raw"), F.when(F.col("c_custkey") % 2 == 0, "대전광역시").alias("hint"))
    found = entities.resolve(rows, t.spark.createDataFrame(_INSTITUTIONS, _SCHEMA), "raw", "hint")
    return found.select("c_custkey", "code", "method", "department", F.array_join("candidates", ",").alias("candidates"))


@query("""SELECT c_custkey, ['LG-26350', 'LG-41110'][1 + CAST(c_custkey % 3 AS INT)] AS code FROM customer WHERE c_custkey % 3 < 2""")
def misread_institution(t: Tables) -> DataFrame:
    """Customers under names that a letter is misread in, and one that is no institution's."""
    rows = t.customer.select("c_custkey", one_of(("부산광역시 해운데구", "경기도 수윈시", "아무개청"), F.col("c_custkey")).alias("raw"))
    return rows.join(entities.misread(rows, t.spark.createDataFrame(_INSTITUTIONS, _SCHEMA)), "raw").select("c_custkey", "code")


def _labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("label"))


@query()
def misread_labels(t: Tables) -> DataFrame:
    """Labels of parts with a letter lost and one misread, by the part's key, and the label they are closest to."""
    at = F.pmod(F.col("p_partkey") * 7, F.length("label")).cast("int")
    lost = F.concat(F.substring("label", F.lit(1), at), F.substring("label", at + 2, F.length("label")))
    rows = _labels(t).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, lost).otherwise(F.regexp_replace(lost, "mall", "rnall")).alias("raw"))
    known = _labels(t).select(F.col("label").alias("alias"), F.col("label").alias("code")).distinct()
    return rows.join(names.closest(rows, known), "raw", "left").select("p_partkey", "raw", "code", F.round("likeness", 6).alias("likeness"))


@query(f"""SELECT 'P' || o_orderkey AS external_id, thing || ' ' || o_orderkey AS title, day AS published_at, CASE WHEN v >= 10000 THEN v END AS amount_krw, 'R26BK' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS bid FROM {_MINUTES_SQL}""")
def procurement_records(t: Tables) -> DataFrame:
    """Orders as landed responses of ten items each, taken apart and mapped."""
    key, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    item = F.struct(said("P", key).alias("orderPlanUntyNo"), said(one_of(_THINGS, key), " ", key).alias("bizNm"), F.date_format("o_orderdate", "yyyyMMdd").alias("nticeDt"), F.format_number(v, 0).alias("sumOrderAmt"), said("R26BK", F.lpad(key.cast("string"), 8, "0"), "000").alias("bidNtceNoList"))
    pages = t.orders.groupBy(F.floor(key / 10).alias("page")).agg(F.collect_list(item).alias("items"))
    body = F.to_json(F.struct(F.struct(F.struct(F.lit("00").alias("resultCode")).alias("header"), F.struct("items").alias("body")).alias("response")))
    items = pages.select(F.try_parse_json(body).alias("body")).select(F.explode(records.envelope_items(F.col("body"))).alias("item"))
    return records.mapped(items, "order_plan").select("external_id", "title", "published_at", "amount_krw", F.array_join("bid_notice_nos", ",").alias("bid"))


@query(f"""SELECT o_orderkey AS doc_id, ['order_plan', 'prespec', 'bid_notice'][1 + CAST(o_orderkey % 3 AS INT)] AS stage, CASE WHEN o_orderkey % 5 > 0 THEN 'LG-' || (o_orderkey % 5) END AS institution_code, v AS budget_krw, CASE WHEN month(day) <= 6 THEN 'H1' ELSE 'H2' END AS expected_half, CASE WHEN o_orderkey % 5 > 0 THEN 'accepted' ELSE 'needs_review' END AS verdict, CASE WHEN o_orderkey % 7 = 0 THEN 'R' || o_orderkey END AS cancels_bid_notice_no, {_KIND_SQL} AS category FROM {_ORDERS_SQL}""")
def record_signals(t: Tables) -> DataFrame:
    """Orders as records of three kinds, some of councils, whose demand is their executives', some without an owner."""
    key = F.col("o_orderkey")
    code = F.when(key % 5 == 0, F.lit(None)).when(key % 2 == 0, said("CN-", key % 5)).otherwise(said("LG-", key % 5))
    docs = t.orders.select(
        key.alias("doc_id"), one_of(("order_plan", "prespec", "bid_notice"), key).alias("doc_type"), one_of(_THINGS, key).alias("title"), code.alias("institution_code"), F.floor("o_totalprice").cast("long").alias("amount_krw"), F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"), F.when(key % 7 == 0, "취소공고").alias("notice_kind"), said("R", key).alias("bid_notice_no"), F.to_date("o_orderdate").alias("published_at"),
    )
    owners = t.spark.range(1, 5).select(said("CN-", F.col("id")).alias("code"), said("LG-", F.col("id")).alias("executive_code"))
    return extraction.record_signals(docs, owners).select("doc_id", "stage", "institution_code", "budget_krw", "expected_half", "verdict", "cancels_bid_notice_no", "category")


@query(f"""SELECT o_orderkey AS doc_id, kind, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM (
SELECT o_orderkey, 'budget_line' AS kind, 8 AS start, 8 + length(line) + 1 + length('ㅇ 1개소') AS "end" FROM {_BOOK_SQL} WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'record', 0, 7 + length(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, unnest(['procedure', 'exchange', 'procedure']), unnest([0, length(first) + 1, length(first) + length(exchange) + 11]), unnest([length(first), length(first) + length(exchange) + 1, length(first) + length(exchange) + 11 + length(last)]) FROM {_MINUTES_SQL} WHERE o_orderkey % 4 = 2
UNION ALL SELECT o_orderkey, 'text', unnest([0, 1300]), unnest([1500, 1501 + o_orderkey % 300]) FROM orders WHERE o_orderkey % 4 = 3)""")
def chunks_by_type(t: Tables) -> DataFrame:
    """Every order as a document of one of four types."""
    key = F.col("doc_id")
    both = _both(t)
    words = F.when(key % 4 == 0, F.col("book")).when(key % 4 == 1, said("입찰공고 번호", key)).when(key % 4 == 2, F.col("text")).otherwise(F.repeat(F.lit("가"), (1501 + key % 300).cast("int")))
    docs = both.select("doc_id", one_of(("budget_book", "bid_notice", "council_minutes", "other"), key).alias("doc_type"), words.alias("text"))
    return chunking.by_type(docs).select("doc_id", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query()
def opportunities_of_orders(t: Tables) -> DataFrame:
    """What the opportunities of all orders come to on a day after the last of them."""
    rows = order_signals(t)
    return linkage.opportunities(rows, linkage.link(rows), F.lit("2001-09-01").cast("date"))


@query()
def recommend_to_customers(t: Tables) -> DataFrame:
    """The best 20 orders, as open opportunities, of every tenth customer, by a keyword, a region and an embedding made of the key."""
    key = F.col("o_orderkey")
    live = order_signals(t).select(
        F.col("signal_id").alias("opportunity_id"), "title", "keywords", "category", "embedding", F.lit("open").alias("status"), F.lpad(F.pmod("signal_id", F.lit(17)).cast("string"), 2, "0").alias("region_code"),
        F.col("budget_krw").alias("est_budget_krw"), F.lit(0.85).alias("conversion_prob"), F.col("observed_at").alias("bid_window_start"), F.date_add("observed_at", 90).alias("bid_window_end"),
    )
    k = F.col("c_custkey")
    word = said(F.pmod(k, F.lit(97)), "호")
    profiles = t.customer.where("c_custkey % 10 = 0").select(
        k.alias("org_id"), F.array(word).alias("p_keywords"), F.array(one_of(_THINGS, k + 1)).alias("p_exclude"), F.array().cast("array<string>").alias("p_categories"), F.array(F.lpad(F.pmod(k, F.lit(17)).cast("string"), 2, "0")).alias("p_regions"),
        F.lit(None).cast("long").alias("p_budget_min"), F.lit(None).cast("long").alias("p_budget_max"), said(one_of(_THINGS, k), " ", word).alias("_words"),
    ).withColumn("p_embedding", vectors.hashed_features(64)("_words")).drop("_words")
    return ranking.recommend(profiles, live, F.lit("1998-01-01").cast("date"), 20, 32, 4).select("org_id", "opportunity_id", "score")


@query(f"""SELECT doc_id, stage, owner_code, budget_krw, expected_year, category, start, CASE WHEN owner_code IS NULL THEN 'institution_unresolved' ELSE '' END AS issues, CASE WHEN owner_code IS NULL THEN 'needs_review' ELSE 'accepted' END AS verdict FROM (
SELECT o_orderkey AS doc_id, 'council_mention' AS stage, CASE WHEN o_orderkey % 5 > 0 THEN 'LG-' || (o_orderkey % 5) END AS owner_code, (v % 90 + 10) * 1000000 AS budget_krw, year(day) + 1 AS expected_year, {_KIND_SQL} AS category, length(first) + 1 + strpos(exchange, '내년도') - 1 AS start FROM {_MINUTES_SQL} WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'budget_line', CASE WHEN o_orderkey % 5 > 0 THEN 'LG-' || (o_orderkey % 5) END, (v + 1000) * 1000, 2027, {_KIND_SQL}, 8 FROM {_BOOK_SQL} WHERE o_orderkey % 2 = 1)""")
def signals_of_documents(t: Tables) -> DataFrame:
    """Every order as minutes of a council or as a budget book, from document to checked signal."""
    key = F.col("doc_id")
    both = _both(t)
    code = F.when(key % 5 > 0, said(F.when(key % 2 == 0, "CN-").otherwise("LG-"), key % 5))
    docs = both.select("doc_id", F.when(key % 2 == 0, "council_minutes").otherwise("budget_book").alias("doc_type"), code.alias("institution_code"), "day", F.when(key % 2 == 1, 2027).alias("fiscal_year"), F.lit(1000).alias("unit"), F.when(key % 2 == 0, F.col("text")).otherwise(F.col("book")).alias("text"))
    owners = t.spark.range(1, 5).select(said("CN-", F.col("id")).alias("code"), said("LG-", F.col("id")).alias("executive_code"))
    found = process.text_signals(docs, owners)
    return found.select("doc_id", "stage", "owner_code", "budget_krw", "expected_year", "category", F.get("at", F.lit(0))["start"].alias("start"), F.array_join("issues", ",").alias("issues"), "verdict")
