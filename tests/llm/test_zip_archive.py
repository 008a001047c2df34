import base64
import hashlib
import io
import zipfile

import pytest

from tenderspring.llm import zip_archive as Z
from tenderspring.llm.shared import new_path, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("always64", [False, True])
def test_directories_are_those_of_zipfile(always64):
    out = io.BytesIO()
    z = Z.ZipWriter(out, always64)
    for name, data in ((Z.DATA, b"x" * 1000), ("b", b""), (Z.INDEX, b"y\n")):
        z.begin(name), z.write(data), z.end()
    z.close()
    found = Z.directory(out, len(out.getvalue()))
    with zipfile.ZipFile(out) as f:
        assert f.testzip() is None
        for name in f.namelist():
            at, size = found[name]
            assert out.getvalue()[at : at + size] == f.read(name)


def test_reads_archives_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("stored", b"abc")
        f.writestr("packed", b"abc" * 50, zipfile.ZIP_DEFLATED)
        f.comment = b"a comment"
    found = Z.directory(out, len(out.getvalue()))
    at, size = found["stored"]
    assert out.getvalue()[at : at + size] == b"abc" and "packed" not in found
    with pytest.raises(ValueError):
        Z.directory(io.BytesIO(b"no zip at all"), 13)


def test_round_trip(spark):
    pages = table(spark, SF, "pages")
    rows = pages.union(pages.where("page_id % 7 = 0").selectExpr("page_id + 1000", "url", "html")).union(spark.createDataFrame([(None, None, None), (-5, "u", ""), (-4, "a\r\nb", None)], pages.schema))
    given = {r.page_id: (r.html or "").encode() for r in rows.collect()}
    firsts = {}
    for k, v in given.items():
        if k is not None:
            firsts[v] = min(k, firsts.get(v, k))
    found = Z.round_trip(rows.withColumnsRenamed({}).selectExpr("*", "1 as digest", "2 as sha1")).collect()
    assert len(found) == rows.count()
    for r in found:
        payload = given[r.page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        is_first = r.page_id == firsts[payload]
        assert r.record_type == ("response" if is_first else "revisit") and r.refers_to == (None if is_first else firsts[payload])
        assert r.payload == (payload if is_first else b"")


def test_archives_are_zip_files_and_empty_tables_make_none(spark):
    pages = table(spark, SF, "pages")
    archives = Z.write_archives(Z.planned(pages), new_path(spark, "wacz")).collect()
    assert sum(a.records for a in archives) == pages.count()
    for a in archives:
        with zipfile.ZipFile(a.path.removeprefix("file://")) as f:
            assert f.testzip() is None and f.namelist() == [Z.DATA, Z.INDEX, Z.PACKAGE]
    assert Z.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    rows = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    found = {r.page_id: r.record_type for r in Z.round_trip(rows, least_bytes=5).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_read_back_is_dealt_out_to_several_tasks(spark):
    rows = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, '', concat('page ', id)) as html")
    found = Z.round_trip(rows.repartition(2))
    assert found.rdd.getNumPartitions() > 1 and found.count() == 3000
