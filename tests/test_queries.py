"""Every registered query against its SQL on the small tables; those without are run."""

import datetime as dt
import math

import duckdb
import pytest
from korean_world import EXPECTED, WORLD

from tenderspring.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_made_up_records_give_what_was_worked_out(spark, duck, name):
    df = WORLD[name](spark)
    names = sorted(df.columns)
    found = duck.execute(EXPECTED[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())


@pytest.mark.parametrize("name", ["opportunities_of_orders", "recommend_to_customers", "chunk_plain"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_ngram_jaccard_compares_all_items(spark, tmp_path):
    texts = {k: f"item {k % 7} of {k * k} {'abc' * (k % 3)}" for k in range(60)} | {70: "", 71: "zq"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bare = {k: "".join(v.split()) for k, v in texts.items()}
    grams = {k: {v[i : i + 3] for i in range(len(v) - 2)} for k, v in bare.items()}
    wanted = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b and grams[a] | grams[b]}
    got = {(r.a, r.b): r.jaccard for r in QUERIES["ngram_jaccard"](spark, str(tmp_path)).collect()}
    assert len(got) == 62 * 61 // 2 and {k: got[k] for k in wanted} == pytest.approx(wanted)


def test_percentiles_gather_no_values(spark, tmp_path):
    rows = [("one", 4.0)] + [("many", (k * 37 % 101 - 50) / 7) for k in range(200)] + [("same", 2.5)] * 9
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["latency_percentiles"](spark, str(tmp_path))
    many = sorted(v for k, v in rows if k == "many")
    assert {r.event_type: (r.p95, r.p50) for r in df.collect()} == {"one": (4.0, None), "many": (many[189], many[99]), "same": (2.5, 2.5)}
    for name in ("latency_percentiles", "lead_time_quartiles"):
        assert "collect_list" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_results_tell_all_that_their_operators_find(spark):
    assert {"terms", "category", "confidence"} < set(QUERIES["titles_and_categories"](spark, SF).columns)
    found = QUERIES["resolve_institution"](spark, SF)
    assert {"department", "candidates"} < set(found.columns)
    assert {"exact", "context", "ambiguous", "none"} == {r.method for r in found.select("method").distinct().collect()}


def test_titles_are_dealt_out_before_they_are_read(spark, capsys):
    """One file of orders is few tasks; the work on each is not."""
    QUERIES["titles_and_categories"](spark, SF).explain()
    assert "REPARTITION" in capsys.readouterr().out
