"""States, alerts, reviews, budgets and checks on the star-schema tables, as plans/core.py stands in for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import extraction, workflow as W
from .core import cents
from .registry import Tables, query

STAGES_SQL = "['council_mention', 'budget_line', 'order_plan', 'prespec', 'bid_notice', 'award']"


@query("""SELECT o_orderkey, CASE WHEN cancelled THEN 'ended' WHEN paid THEN 'active' WHEN f < 3 THEN 'past_due' ELSE 'ended' END AS status, CAST(CASE WHEN cancelled OR paid THEN 0 ELSE f + 1 END AS INT) AS failures, CASE WHEN cancelled THEN NULL WHEN paid THEN CAST(d + INTERVAL 1 MONTH AS DATE) WHEN f < 3 THEN d + CAST([1, 3, 7][f + 1] AS INT) END AS next_at FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus = 'F' AS paid, o_orderkey % 11 = 0 AS cancelled, CAST(o_orderkey % 5 AS INT) AS f FROM orders)""")
def subscription_renewal(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    after = W.renewal(F.lit("active"), (key % 5).cast("int"), F.col("o_orderstatus") == "F", F.to_date("o_orderdate"), key % 11 == 0)
    return t.orders.select("o_orderkey", after.alias("x")).select("o_orderkey", "x.*")


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS period, CAST(date_trunc('day', ts) + INTERVAL 1 MONTH AS DATE) AS ends FROM events")
def billing_periods(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.period_key(F.col("ts")).alias("period"), F.add_months(F.to_date("ts"), 1).alias("ends"))


@query("""SELECT source, CAST(sum(CAST((CAST(n_chars AS DECIMAL(18, 0)) * 3.0000 + CAST(doc_id % 500 AS DECIMAL(18, 0)) * 0.3000 + CAST(900 AS DECIMAL(18, 0)) * 15.0000) * 100 AS BIGINT)) AS BIGINT) AS cost FROM documents GROUP BY 1""")
def extraction_cost(t: Tables) -> DataFrame:
    """What reading each document costs, by source, in hundred-millionths."""
    cost = W.token_cost(F.col("n_chars"), F.col("doc_id") % 500, F.lit(900), ("3.0", "0.3", "15.0"))
    return t.documents.groupBy("source").agg(F.sum((cost * 100_000_000).cast("bigint")).alias("cost"))


@query("""SELECT event_id, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS spent, coalesce(sum(c) OVER w, 0) + c <= 100000 AS allowed FROM (SELECT *, CAST(round(value * 100, 0) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id, CAST(ts + INTERVAL 9 HOUR AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def spend_guard(t: Tables) -> DataFrame:
    rows = W.within_budget(t.events.withColumn("c", cents("value")), [F.col("user_id"), dates.business_day(F.col("ts"))], ["ts", "event_id"], "c", 100_000)
    return rows.select("event_id", "spent", "allowed")


@query("""SELECT o_custkey, o_orderkey, place, CAST(greatest(n - 3, 0) AS BIGINT) AS more FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_totalprice >= 1000) WHERE place <= 3""")
def alert_batches(t: Tables) -> DataFrame:
    rows = W.alert_batches(t.orders, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], F.col("o_totalprice") >= 1000, 3)
    return rows.select("o_custkey", "o_orderkey", "place", "more")


@query("""SELECT o_custkey, substr(sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)), 1, 16) AS digest FROM orders GROUP BY 1""")
def alert_digest(t: Tables) -> DataFrame:
    """A digest of a batch, in which a batch that was sent before is known again."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"]))
    return t.orders.groupBy("o_custkey").agg(F.left(F.sha2(F.array_join(parts, ","), 256), F.lit(16)).alias("digest"))


@query("""SELECT o.o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(p, o_orderpriority) AS o_orderpriority, concat_ws(',', CASE WHEN s IS NOT NULL AND s IS DISTINCT FROM o_orderstatus THEN 'o_orderstatus' END, CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM o_orderpriority THEN 'o_orderpriority' END) AS changed FROM orders o LEFT JOIN (SELECT l_orderkey AS k, l_linestatus AS s, CASE WHEN l_returnflag = 'R' THEN '1-URGENT' END AS p FROM lineitem WHERE l_linenumber = 1) d ON k = o.o_orderkey""")
def review_decisions(t: Tables) -> DataFrame:
    said = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), F.when(F.col("l_returnflag") == "R", "1-URGENT").alias("o_orderpriority"))
    rows = W.reviewed(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), said, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return rows.withColumn("changed", F.array_join("changed", ","))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'""")
def replace_derivations(t: Tables) -> DataFrame:
    new = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    return W.replaced(t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice"), new, "k").drop("k")


@query("""SELECT o_orderkey, sha256(concat_ws(chr(31), 'm1', o_orderpriority, CAST(o_custkey % 50 AS VARCHAR))) AS key, answer FROM orders LEFT JOIN (SELECT sha256(concat_ws(chr(31), 'm1', p_priority, CAST(k AS VARCHAR))) AS key, p_priority || k AS answer FROM (SELECT DISTINCT o_orderpriority AS p_priority, o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F')) c USING (key)""".replace("USING (key)", "ON c.key = sha256(concat_ws(chr(31), 'm1', o_orderpriority, CAST(o_custkey % 50 AS VARCHAR)))"))
def response_cache(t: Tables) -> DataFrame:
    asked = t.orders.withColumns({"model": F.lit("m1"), "k": F.col("o_custkey") % 50})
    parts = ["model", "o_orderpriority", "k"]
    seen = asked.where("o_orderstatus = 'F'").select(*parts).distinct().select(F.sha2(F.concat_ws("\x1f", *parts), 256).alias("key"), F.concat("o_orderpriority", F.col("k").cast("string")).alias("answer"))
    return W.answered(asked, seen, parts).select("o_orderkey", "key", "answer")


@query("SELECT o_orderkey, 'score' AS s, CAST(CAST(round(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR) AS v, CAST(o_custkey % 100 AS DOUBLE) / 4 AS p, o_orderkey AS i, DATE '2026-09-25' AS d FROM orders")
def cursor_round_trip(t: Tables) -> DataFrame:
    told = W.cursor(F.lit("score"), cents("o_totalprice"), F.col("o_custkey") % 100 / 4.0, F.col("o_orderkey"), F.lit("2026-09-25").cast("date"))
    return t.orders.select("o_orderkey", W.read_cursor(told).alias("x")).select("o_orderkey", "x.*")


@query("""WITH e AS (SELECT *, CAST(epoch(ts) AS BIGINT) AS s FROM events) SELECT c.event_id, p.event_id AS purchase_id FROM e c JOIN e p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND c.s >= p.s AND c.s < p.s + 86400""")
def point_in_interval(t: Tables) -> DataFrame:
    """Clicks within a day after a purchase of the same user."""
    rows = t.events.withColumn("s", F.unix_timestamp("ts"))
    spans = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("s").alias("begin"), (F.col("s") + 86_400).alias("end"))
    clicks = rows.where("event_type = 'click'").select("user_id", "event_id", "s")
    return W.within(clicks, spans, ["user_id"], F.col("s"), F.col("begin"), F.col("end"), 86_400).select("event_id", "purchase_id")


@query("""SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE p AND e)::DOUBLE / nullif(count(*) FILTER (WHERE p), 0), 3) AS precision, round(count(*) FILTER (WHERE p AND e)::DOUBLE / nullif(count(*) FILTER (WHERE e), 0), 3) AS recall, round(2 * count(*) FILTER (WHERE p AND e)::DOUBLE / nullif(count(*) FILTER (WHERE p) + count(*) FILTER (WHERE e), 0), 3) AS f1 FROM (SELECT lang, n_chars > 400 AS p, quality = 1 AS e FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def precision_recall(t: Tables) -> DataFrame:
    """How well a length of more than 400 characters tells the quality label, by language."""
    return W.precision_recall(t.documents.join(t.labels, "doc_id"), F.col("n_chars") > 400, F.col("quality") == 1, ["lang"])


@query("SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INT) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def counts_by_label(t: Tables) -> DataFrame:
    """Labels, the most common first."""
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "event_type")))


@query("""SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal < 0), s_name LIKE '%7%' DESC, s_suppkey DESC) AS INT) AS place FROM supplier""")
def multi_key_sort(t: Tables) -> DataFrame:
    order = (F.col("s_acctbal") < 0, F.col("s_name").contains("7").desc(), F.col("s_suppkey").desc())
    return t.supplier.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*order)).alias("place"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_returnflag = 'R') OR coalesce(list_position({STAGES_SQL}, {STAGES_SQL}[1 + l_linenumber % 6]) >= 5, false) AS is_out FROM lineitem""")
def tender_out(t: Tables) -> DataFrame:
    stage = F.get(F.array(*map(F.lit, dates.STAGES)), F.col("l_linenumber") % 6)
    published = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.tender_out(published, stage).alias("is_out"))


@query("SELECT n_name, r_name, levenshtein(n_name, r_name)::DOUBLE / length(r_name) AS cer FROM nation JOIN region ON n_regionkey = r_regionkey")
def character_error_rate(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", text.character_error_rate(F.col("n_name"), F.col("r_name")).alias("cer"))


@query("SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_brand, p_type, 'size ' || p_size) AS words FROM part")
def profile_text(t: Tables) -> DataFrame:
    """What a profile is embedded by: its description, its keywords twice, its categories."""
    twice = F.flatten(F.array_repeat(F.array("p_brand", "p_type"), 2))
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", twice, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("words"))


@query("""SELECT n_name AS key, min(k) AS place FROM (SELECT * FROM (VALUES (0, 'ASIA'), (1, 'FRANCE'), (2, 'EUROPE'), (3, 'ASIA')) v(k, name)) v JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) s ON v.name = s.r_name OR v.name = s.n_name GROUP BY 1""")
def source_expansion(t: Tables) -> DataFrame:
    """Names of adapters stand for all their sources, other names for one; each once, where it was first named."""
    named = t.spark.createDataFrame([(0, "ASIA"), (1, "FRANCE"), (2, "EUROPE"), (3, "ASIA")], "k int, name string")
    sources = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    by_name = sources.select("n_name", F.explode(F.array("n_name", "r_name")).alias("name"))
    return named.join(by_name, "name").groupBy(F.col("n_name").alias("key")).agg(F.min("k").alias("place"))


@query("""SELECT event_type, n, coverage FROM (SELECT event_type, count(*) AS n, round(avg(CASE WHEN CAST(props->>'k' AS BIGINT) > 90 THEN 1.0 ELSE 0.0 END), 3) AS coverage FROM events GROUP BY 1) WHERE n > 0 AND coverage < 0.1""")
def source_problems(t: Tables) -> DataFrame:
    """Sources that gave items of which too few could be read."""
    mapped = F.when(F.get_json_object("props", "$.k").cast("bigint") > 90, 1.0).otherwise(0.0)
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(mapped), 3).alias("coverage"))
    return rows.where("n > 0 and coverage < 0.1")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def pending_sweep(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey")


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS INT) AS step, l_shipdate AS day, CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS cents FROM lineitem WHERE l_extendedprice > 0""")
def budget_trajectory(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_extendedprice > 0")
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"))
    return rows.select("l_orderkey", step.alias("step"), F.col("l_shipdate").alias("day"), cents("l_extendedprice").alias("cents"))


@query("""SELECT o_orderkey, CASE WHEN n = 0 THEN 0.0 ELSE round(f::DOUBLE / n, 3) END AS ratio FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def evidence_ratio(t: Tables) -> DataFrame:
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_returnflag") == "R").alias("found"))
    return t.orders.select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", extraction.evidence_ratio(F.coalesce("found", F.array().cast("array<boolean>"))).alias("ratio"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'A' AND p > 0 THEN p ELSE c END AS amount FROM (SELECT *, CAST(round(l_extendedprice, 0) AS BIGINT) AS c, CASE WHEN l_linenumber % 2 = 0 THEN CAST(round(l_quantity * 1000, 0) AS BIGINT) END AS p FROM lineitem)""")
def settled_amounts(t: Tables) -> DataFrame:
    claimed, parsed = F.round("l_extendedprice", 0).cast("bigint"), F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_quantity") * 1000, 0).cast("bigint"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", extraction.settled_amount(claimed, parsed, F.col("l_returnflag") == "A").alias("amount"))


@query("""SELECT k * 8 + j AS opportunity_id, (k * 8 + j) % 2000 AS org, 100000000 + ((k * 8 + j) * 7919) % 900000007 AS budget, DATE '2026-01-01' + CAST(((k * 8 + j) * 31) % 365 AS INT) AS day, ['open', 'bid_open', 'closed', 'dormant'][1 + j % 4] AS status FROM (SELECT o_orderkey AS k, unnest(range(8)) AS j FROM orders)""")
def bulk_opportunities(t: Tables) -> DataFrame:
    """Eight opportunities of every order, for measuring, by arithmetic on its key."""
    k = F.col("o_orderkey") * 8 + F.col("j")
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(k * 31, F.lit(365)).cast("int"))
    status = F.get(F.array(*map(F.lit, ("open", "bid_open", "closed", "dormant"))), F.pmod("j", F.lit(4)).cast("int"))
    rows = t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return rows.select(k.alias("opportunity_id"), (k % 2000).alias("org"), (100_000_000 + (k * 7919) % 900_000_007).alias("budget"), day.alias("day"), status.alias("status"))


@query("""SELECT o_orderkey, concat_ws(' | ', 'order', o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN 'status: ' || o_orderstatus END, 'customer: ' || c_name) AS line FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def record_text(t: Tables) -> DataFrame:
    """A record in one line: a label and the parts that it has."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.concat_ws(" | ", F.lit("order"), "o_orderpriority", F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("status: "), "o_orderstatus")), F.concat(F.lit("customer: "), F.col("c_name"))).alias("line"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey > 20 THEN 'regions' END, CASE WHEN c_acctbal < 0 THEN 'budget' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'categories' END) AS problems, c_name || '|x' AS keywords FROM customer""")
def profile_problems(t: Tables) -> DataFrame:
    regions = F.array_repeat(F.lit("11"), F.col("c_nationkey"))
    words = F.array(F.concat(F.lit(" "), "c_name"), F.lit("x"), F.col("c_name"), F.lit(" "), F.lit("x "))
    found = W.valid_profile(regions, F.lit(0.0), F.col("c_acctbal"), F.array("c_mktsegment"), words, ("BUILDING", "MACHINERY", "HOUSEHOLD"), 20)
    return t.customer.select("c_custkey", found.alias("x")).select("c_custkey", F.array_join("x.problems", ",").alias("problems"), F.array_join("x.keywords", "|").alias("keywords"))


@query("""SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, event_type AS seen FROM events""")
def json_merge(t: Tables) -> DataFrame:
    """A field put into an object, the others kept."""
    given = F.from_json("props", "map<string,string>")
    merged = F.to_json(F.map_concat(F.map_filter(given, lambda k, v: k != "seen"), F.create_map(F.lit("seen"), F.col("event_type"))))
    return t.events.select("event_id", merged.alias("m")).select("event_id", F.get_json_object("m", "$.k").cast("bigint").alias("k"), F.get_json_object("m", "$.seen").alias("seen"))
