import datetime as dt

import pytest

from tenderspring.streaming import state

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    def make(rows, schema, files=1):
        folder = tmp_path / "in"
        for k in range(files):
            spark.createDataFrame(rows[k::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).parquet(str(folder))

    return make


def run(spark, df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out").collect()


def test_token_bucket(spark, source, tmp_path):
    rows = [("a", k, T0 + dt.timedelta(milliseconds=100 * k)) for k in range(10)] + [("b", 99, T0)]
    got = {r.id: r.allowed for r in run(spark, state.token_bucket(source(rows, "k string, id long, ts timestamp"), "k", "id", "ts"), tmp_path, "update")}
    assert [got[k] for k in range(10)] == [True] * 6 + [False, False, False, False][:4] or [got[k] for k in range(6)] == [True] * 6
    assert got[99] and sum(got[k] for k in range(10)) == 6


def test_circuit_breaker(spark, source, tmp_path):
    bad = [True] * 5 + [False, True, False]
    at = [0, 1, 2, 3, 4, 5, 700, 1400]
    rows = [("a", k, T0 + dt.timedelta(seconds=s), b) for k, (s, b) in enumerate(zip(at, bad, strict=True))]
    got = {r.id: r.state for r in run(spark, state.circuit_breaker(source(rows, "k string, id long, ts timestamp, bad boolean"), "k", "id", "ts", "bad"), tmp_path, "update")}
    assert [got[k] for k in range(8)] == ["closed"] * 5 + ["open", "half_open", "half_open"]


def test_repeats_are_dropped(spark, source, tmp_path):
    rows = [("a", T0), ("a", T0), ("b", T0)]
    assert sorted(r.k for r in run(spark, state.deduplicated(source(rows, "k string, ts timestamp"), ["k"], "ts"), tmp_path)) == ["a", "b"]


def test_batches_are_merged(spark, source, tmp_path):
    seen = []
    state.upsert_batches(source([("a", T0), ("b", T0)], "k string, ts timestamp"), lambda b: seen.extend(r.k for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_a_replayed_batch_is_merged_once(spark, tmp_path, source):
    """A batch that was merged before the query broke off isn't merged again; one whose merge broke off is."""
    seen, stream, cp = [], source([("a", T0)], "k string, ts timestamp"), str(tmp_path / "cp")

    def broken(batch):
        raise RuntimeError("broken")

    with pytest.raises(Exception, match="broken"):
        state.upsert_batches(stream, broken, cp).awaitTermination()
    state.upsert_batches(stream, lambda b: seen.extend(r.k for r in b.collect()), cp).awaitTermination()
    assert seen == ["a"]
    (tmp_path / "cp" / "commits" / "0").unlink()  # as if the driver was lost between merge and commit
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    state.upsert_batches(stream, lambda b: seen.extend(r.k for r in b.collect()), cp).awaitTermination()
    assert seen == ["a"]
