import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tenderspring.sources.landing import ContentStore, LandedPages

SF = "/root/testdata/sf0.001"


def land(folder, slices, rows, form=lambda items: items, first=1):
    """Writes {slice: items} as pages of `rows` items."""
    for name, items in slices.items():
        where = pathlib.Path(folder) / f"slice={name}"
        where.mkdir(parents=True, exist_ok=True)
        for page, at in enumerate(range(0, max(len(items), 1), rows), first):
            body = {"items": form(items[at : at + rows]), "totalCount": len(items)}
            (where / f"page-{page:05d}.json").write_text(json.dumps({"response": {"header": {"resultCode": "00"}, "body": body}}))


@pytest.fixture
def scans(spark):
    spark.dataSource.register(LandedPages)
    spark.dataSource.register(ContentStore)
    return spark


def test_orders_landed_as_pages_come_back_exactly_once(scans, tmp_path):
    orders = scans.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyyMM").alias("month")).collect()
    slices = {}
    for r in orders:
        slices.setdefault(r.month, []).append({"id": r.o_orderkey, "price": r.price})
    slices |= {"full": [{"id": -k, "price": "1"} for k in range(1, 15)], "none": []}  # whole pages only, and no item
    land(tmp_path, slices, 7)
    df = scans.read.format("landed_pages").option("path", str(tmp_path)).option("rows", 7).load()
    assert df.rdd.getNumPartitions() == len(slices)
    rows = df.select("slice", "total", F.get_json_object("item", "$.id").cast("long").alias("id"), F.get_json_object("item", "$.price").alias("price")).collect()
    want = sorted((x["id"], x["price"], s, len(items)) for s, items in slices.items() for x in items)
    assert sorted((r.id, r.price, r.slice, r.total) for r in rows) == want


def test_forms_of_items_and_errors(scans, tmp_path):
    read = lambda p: scans.read.format("landed_pages").option("path", str(p)).option("rows", 2).load()
    land(tmp_path / "a", {"x": [{"id": 1}]}, 2, lambda items: {"item": items[0]})
    land(tmp_path / "a", {"y": [{"id": 2}, {"id": 3}]}, 2, lambda items: {"item": items})
    land(tmp_path / "a", {"z": []}, 2, lambda items: "")
    assert sorted(r.item for r in read(tmp_path / "a").collect()) == ['{"id": 1}', '{"id": 2}', '{"id": 3}']
    assert read(tmp_path / "nothing").collect() == []
    land(tmp_path / "b", {"x": [{"id": k} for k in range(6)]}, 2)
    (tmp_path / "b" / "slice=x" / "page-00002.json").unlink()
    with pytest.raises(Exception, match="lacks page 2"):
        read(tmp_path / "b").collect()
    (tmp_path / "b" / "slice=x" / "page-00002.json").write_text('{"response":{"header":{"resultCode":"22"}}}')
    with pytest.raises(Exception, match="result code 22"):
        read(tmp_path / "b").collect()


def test_a_stream_gives_each_page_once(scans, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        df = scans.readStream.format("landed_pages").option("path", str(source)).load()
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r.item)["id"] for r in scans.read.parquet(out).collect())

    land(source, {"a": [{"id": k} for k in range(5)]}, 2)
    assert run() == [0, 1, 2, 3, 4]
    land(source, {"a": [{"id": 10}, {"id": 11}], "b": [{"id": 12}]}, 2, first=4)
    (source / "slice=b" / "page-00004.json").rename(source / "slice=b" / "page-00001.json")
    assert run() == [0, 1, 2, 3, 4, 10, 11, 12] == run()


def test_contents_are_stored_once_and_repeated_runs_change_nothing(scans, tmp_path):
    rows = [("g2b", str(k), f"text {k % 5}".encode()) for k in range(40)] + [("clik", "x", b"text 1"), ("clik", "y", None), ("clik", "z", b"")]
    df = scans.createDataFrame(rows, "source string, external_id string, content binary").repartition(6)
    for _ in range(2):
        df.write.format("content_store").option("path", str(tmp_path)).option("run", "r1").mode("append").save()
        files = sorted(p for p in tmp_path.rglob("*.bin"))
        assert len(files) == 7 and not (tmp_path / "_staging").exists() or not any((tmp_path / "_staging").iterdir())
        manifest = [json.loads(x) for x in (tmp_path / "_manifests" / "r1.jsonl").read_text().splitlines()]
        assert len(manifest) == len(rows)
        by_id = {(r["source"], r["external_id"]): r["key"] for r in manifest}
        assert all((tmp_path / by_id[s, e]).read_bytes() == (c or b"") for s, e, c in rows)


def test_a_run_that_breaks_off_leaves_nothing(scans, tmp_path):
    bad = scans.range(20).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"), F.when(F.col("id") == 19, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        bad.write.format("content_store").option("path", str(tmp_path)).option("run", "r").mode("append").save()
    assert not list(tmp_path.rglob("*.bin")) and not list(tmp_path.rglob("*.jsonl"))
