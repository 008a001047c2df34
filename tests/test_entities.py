from korean_world import WORLD


def test_names(spark):
    got = {(r.raw, r.hint): (r.code, r.method, r.department) for r in WORLD["resolve_institution"](spark).collect()}
    assert got["서울특별시 강남구청 스마트도시과", None] == ("LG-11680", "exact", "스마트도시과")
    assert got["강남구의회", None][0] == "CN-11680" and got["세종시청", None][0] == "LG-36110" and got["부산진구청", None][0] == "LG-26230"
    assert got["중구청 기획예산과", None][:2] == (None, "ambiguous") and got["중구청 기획예산과", "대전광역시"][:2] == ("LG-30140", "context")
    assert all(got[n, None][0] is None for n in ("서울교통공사", "경기도 신성중학교", "진주시 시설관리공단", None))


def test_misread_names(spark):
    assert {(r.raw, r.code) for r in WORLD["misread_institution"](spark).collect()} == {("해운데구청", "LG-26350"), ("강남구정", "LG-11680")}


def test_records(spark):
    rows = WORLD["procurement_records"](spark).collect()
    assert len(rows) == 1 and rows[0].amount_krw == 29_315_000 and rows[0].bid_notice_nos == ["R26BK00000001", "R26BK00000002"]
