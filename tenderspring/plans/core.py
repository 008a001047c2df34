"""Filters, joins, aggregates, orders and sets of the pipeline, on the star-schema tables.

Stand-ins: an opportunity is an order, a signal a line item, an organisation a customer, an institution a
nation, a stream of notices the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text, vectors
from ..operators import relational as R
from ..sources import records
from .registry import Tables, query

DAY = "1998-09-02"


def cents(c: str):
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(F.col(c) * 100, 0).cast("bigint")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def group_count_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount >= 0.05) AS discounted FROM lineitem GROUP BY 1""")
def filtered_counts_one_pass(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") >= 0.05).alias("discounted"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def usage_by_day_type(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(cents("value")).alias("cents"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, 1.0::DOUBLE * (count(*) FILTER (WHERE event_type = 'purchase')) / nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS purchases_per_click FROM events GROUP BY 1""")
def null_safe_ratios(t: Tables) -> DataFrame:
    of = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.groupBy("user_id").agg(of("error").alias("errors"), F.count("*").alias("n"), F.try_divide(of("purchase").cast("double"), of("click").cast("double")).alias("purchases_per_click"))


@query("""SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 1000 AND 200000""")
def inner_join_feed(t: Tables) -> DataFrame:
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P") & F.col("o_totalprice").between(1000, 200000))
    return rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_unlinked(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def semi_join_ids(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity >= 45"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderstatus, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 0 WHERE l_quantity > 30""")
def four_way_detail(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_quantity > 30").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = lines.join(t.nation.where("n_regionkey <> 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "o_orderstatus", "c_name", "n_name")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def region_lookup(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR list_contains(['PROMO', 'ECONOMY'], p_type)")
def substring_or_member(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%RED%") | F.array_contains(F.array(F.lit("PROMO"), F.lit("ECONOMY")), F.col("p_type"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def not_dismissed(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isNull() | ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_mktsegment, 'B') AND c_name NOT LIKE '%9'")
def prefix_and_not_like(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").startswith("B") & ~F.col("c_name").like("%9")).select("c_custkey", "c_name")


@query("""WITH best AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), p AS (SELECT sum(n * (n - 1) / 2) AS tp FROM best), q AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM best GROUP BY quality)), r AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM best GROUP BY toxic)) SELECT CAST(tp AS BIGINT) AS tp, CAST(x - tp AS BIGINT) AS fp, CAST(y - tp AS BIGINT) AS fn FROM p, q, r""")
def pair_confusion(t: Tables) -> DataFrame:
    return R.pairwise_counts(t.labels, "quality", "toxic")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 5")
def top_n_per_org(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_key(rows, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


def _page(t: Tables, order: list) -> DataFrame:
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    soon = F.greatest(F.coalesce(F.to_date("o_orderdate"), F.lit("9999-12-31").cast("date")), F.lit(DAY).cast("date")).alias("soon")
    return rows.select("o_orderkey", "c_name", "o_totalprice", "o_orderdate", soon).orderBy(*order).limit(21).drop("o_orderdate")


_PAGE = f"SELECT o_orderkey, c_name, o_totalprice, greatest(coalesce(CAST(o_orderdate AS DATE), DATE '9999-12-31'), DATE '{DAY}') AS soon FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') ORDER BY {{}} LIMIT 21"


@query(_PAGE.format("o_totalprice DESC, o_orderkey DESC"))
def keyset_page_score(t: Tables) -> DataFrame:
    return _page(t, [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()])


@query(_PAGE.format("soon, o_totalprice DESC, o_orderkey DESC"))
def keyset_page_soon(t: Tables) -> DataFrame:
    return _page(t, [F.col("soon"), F.col("o_totalprice").desc(), F.col("o_orderkey").desc()])


@query(_PAGE.format("o_orderdate DESC, o_totalprice DESC, o_orderkey DESC"))
def keyset_page_recent(t: Tables) -> DataFrame:
    return _page(t, [F.col("o_orderdate").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey").desc()])


@query(f"""WITH cut AS (SELECT o_totalprice AS p, o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1 OFFSET 20) SELECT o_orderkey, o_totalprice FROM orders, cut WHERE o_totalprice < p OR (o_totalprice = p AND o_orderkey < k) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 21""")
def keyset_next_page(t: Tables) -> DataFrame:
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()]
    cut = t.orders.orderBy(*order).limit(21).agg(F.min(F.struct(F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k"))).alias("cut"))
    beyond = t.orders.join(F.broadcast(cut), F.struct(F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k")) < F.col("cut"))
    return beyond.select("o_orderkey", "o_totalprice").orderBy(*order).limit(21)


@query("""SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 300) UNION SELECT p_partkey FROM (SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_partkey LIMIT 300) UNION SELECT p_partkey FROM (SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL') ORDER BY p_size DESC, p_partkey LIMIT 300)""")
def candidate_union_distinct(t: Tables) -> DataFrame:
    a = t.part.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(300)
    b = t.part.where(F.col("p_name").ilike("%ring%")).orderBy("p_partkey").limit(300)
    c = t.part.where(F.col("p_type").isin("PROMO", "SMALL")).orderBy(F.col("p_size").desc(), "p_partkey").limit(300)
    return a.unionByName(b).unionByName(c).select("p_partkey").distinct()


@query("""WITH e AS (SELECT vec_id FROM embeddings WHERE label < 5), a AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) SELECT count(*) AS hits, (SELECT count(*) FROM e) AS n, count(*)::DOUBLE / (SELECT count(*) FROM e) AS recall FROM (SELECT vec_id FROM e INTERSECT SELECT vec_id FROM a)""")
def set_recall(t: Tables) -> DataFrame:
    exact, approximate = t.embeddings.where("label < 5").select("vec_id"), t.embeddings.where("vec_id % 3 <> 0").select("vec_id")
    n = exact.agg(F.count("*").alias("n"))
    return exact.intersect(approximate).agg(F.count("*").alias("hits")).crossJoin(n).withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")))


@query("""SELECT user_id, event_type = 'error' AS withdrawn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, (event_type = 'error') DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_with_tiebreak(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("withdrawn"), "event_id")
    return R.latest_by(rows, "user_id", ["day", "withdrawn", "event_id"], ["withdrawn"])


@query("""WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_partkey * 100000 + l_orderkey) AS f FROM lineitem GROUP BY 1, 2) SELECT l.l_suppkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(DISTINCT l_orderkey) AS documents, any_value(k.l_returnflag) AS mode_flag FROM lineitem l JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) = 1) k ON l.l_suppkey = k.l_suppkey GROUP BY 1""")
def stage_rank_aggregate(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("position", F.col("l_partkey") * 100000 + F.col("l_orderkey"))
    modes = R.first_seen_mode(rows, "l_suppkey", "l_returnflag", ["position"]).withColumnRenamed("l_returnflag", "mode_flag")
    sums = rows.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count_distinct("l_orderkey").alias("documents"))
    return sums.join(modes, "l_suppkey")


_FIRSTS = """WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type IN ('view', 'click')) AS early, min(ts) FILTER (WHERE event_type = 'purchase') AS bid, arg_min(event_type, ts) AS first_type, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1)"""


def _firsts(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.min(F.when(kind.isin("view", "click"), F.col("ts"))).alias("early"), F.min(F.when(kind == "purchase", F.col("ts"))).alias("bid"),
        F.min_by("event_type", "ts").alias("first_type"), F.count_if(kind == "click").alias("clicks"),
    )


@query(_FIRSTS + """, c AS (SELECT first_type, CASE WHEN clicks >= 14 THEN 'strong' ELSE 'weak' END AS level, bid IS NOT NULL AND bid - early > INTERVAL 1 DAY AS ok FROM f WHERE first_type IN ('view', 'click', 'signup')) SELECT cohort, count(*) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_converted FROM (SELECT first_type || ':' || level AS cohort, ok FROM c UNION ALL SELECT first_type || ':*', ok FROM c) GROUP BY 1""")
def conversion_cohorts(t: Tables) -> DataFrame:
    rows = _firsts(t).where(F.col("first_type").isin("view", "click", "signup")).withColumn("level", F.when(F.col("clicks") >= 14, "strong").otherwise("weak"))
    ok = F.coalesce(F.col("bid") - F.col("early") > F.expr("INTERVAL 1 DAY"), F.lit(False))
    return R.cohort_rates(rows, "first_type", "level", ok)


@query(_FIRSTS + """, x AS (SELECT first_type, list_sort(list(CAST(datediff('day', CAST(early AS DATE), CAST(bid AS DATE)) AS BIGINT))) AS d FROM f WHERE bid > early GROUP BY 1), n AS (SELECT *, len(d) AS n FROM x) SELECT first_type, n, CASE WHEN n % 2 = 1 THEN d[(n + 1) // 2]::DOUBLE ELSE (d[n // 2] + d[n // 2 + 1]) / 2.0::DOUBLE END AS median, CASE WHEN n >= 4 THEN (d[(n + 1) // 4] * (4 - (n + 1) % 4) + d[least((n + 1) // 4 + 1, n)] * ((n + 1) % 4)) / 4.0::DOUBLE END AS p25, CASE WHEN n >= 4 THEN (d[3 * (n + 1) // 4] * (4 - 3 * (n + 1) % 4) + d[least(3 * (n + 1) // 4 + 1, n)] * (3 * (n + 1) % 4)) / 4.0::DOUBLE END AS p75 FROM n""")
def lead_time_quartiles(t: Tables) -> DataFrame:
    days = F.datediff(F.to_date("bid"), F.to_date("early")).cast("bigint")
    whole = lambda x: F.floor(x).cast("bigint")
    places = {"m1": lambda n: whole((n + 1) / 2), "m2": lambda n: whole(n / 2) + 1}
    for k in (1, 3):
        places |= {f"q{k}": lambda n, k=k: whole(k * (n + 1) / 4), f"r{k}": lambda n, k=k: F.least(whole(k * (n + 1) / 4) + 1, n)}
    rows = R.at_places(_firsts(t).where("bid > early").select("first_type", days.alias("d")), "first_type", "d", places)
    n = F.col("n")
    part = lambda k: F.pmod(k * (n + 1), F.lit(4))
    p25, p75 = (F.when(n >= 4, (F.col(f"q{k}") * (4 - part(k)) + F.col(f"r{k}") * part(k)) / F.lit(4.0)) for k in (1, 3))
    return rows.select("first_type", "n", ((F.col("m1") + F.col("m2")) / 2.0).alias("median"), p25.alias("p25"), p75.alias("p75"))


@query(_FIRSTS + "SELECT count(*) FILTER (WHERE bid IS NOT NULL) AS tenders, count(*) FILTER (WHERE early < bid) AS early, (count(*) FILTER (WHERE early < bid))::DOUBLE / nullif(count(*) FILTER (WHERE bid IS NOT NULL), 0) AS rate FROM f")
def early_coverage(t: Tables) -> DataFrame:
    tenders, early = F.count_if(F.col("bid").isNotNull()), F.count_if(F.col("early") < F.col("bid"))
    return _firsts(t).agg(tenders.alias("tenders"), early.alias("early"), F.try_divide(early.cast("double"), tenders.cast("double")).alias("rate"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5 AND event_type <> 'error'")
def having_min_samples(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 5")


@query("""SELECT event_type, list_sort(list(value))[CAST(round_even(0.95 * count(*), 0) AS BIGINT)] AS p95, list_sort(list(value))[CAST(round_even(0.5 * count(*), 0) AS BIGINT)] AS p50 FROM events GROUP BY 1""")
def latency_percentiles(t: Tables) -> DataFrame:
    at = lambda p: lambda n: F.bround(F.lit(p) * n, 0).cast("bigint")
    return R.at_places(t.events, "event_type", "value", {"p95": at(0.95), "p50": at(0.5)}).select("event_type", "p95", "p50")


@query("""SELECT event_id, user_id, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after FROM (SELECT *, CAST(round(value * 100, 0) AS BIGINT) * CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS d FROM events)""")
def running_balance(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", (cents("value") * F.when(F.col("event_type") == "purchase", -1).otherwise(1)).alias("delta"))
    return R.running_balance(rows, "user_id", ["ts", "event_id"], "delta").select("event_id", "user_id", "balance_after")


@query("""SELECT user_id, CAST(greatest(0, least(b, g - s)) AS BIGINT) AS lapsed FROM (SELECT user_id, coalesce(sum(c) FILTER (WHERE event_type = 'signup'), 0) AS g, coalesce(sum(c) FILTER (WHERE event_type = 'purchase' AND CAST(ts AS DATE) >= DATE '2024-01-10'), 0) AS s, coalesce(sum(c) FILTER (WHERE event_type <> 'purchase'), 0) - coalesce(sum(c) FILTER (WHERE event_type = 'purchase'), 0) AS b FROM (SELECT *, CAST(round(value * 100, 0) AS BIGINT) AS c FROM events) GROUP BY 1)""")
def expiry_formula(t: Tables) -> DataFrame:
    c, kind = cents("value"), F.col("event_type")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    sums = t.events.groupBy("user_id").agg(of(kind == "signup").alias("g"), of((kind == "purchase") & (F.to_date("ts") >= F.lit("2024-01-10").cast("date"))).alias("s"), (of(kind != "purchase") - of(kind == "purchase")).alias("b"))
    return sums.select("user_id", R.expiry(F.col("b"), F.col("g"), F.col("s")).cast("bigint").alias("lapsed"))


@query("""SELECT event_id, n > 10 AS refused FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(ts + INTERVAL 9 HOUR AS DATE) ORDER BY ts, event_id) AS n FROM events)""")
def daily_quota(t: Tables) -> DataFrame:
    day = dates.business_day(F.col("ts"))
    n = F.row_number().over(Window.partitionBy("event_type", day).orderBy("ts", "event_id"))
    return t.events.select("event_id", (n > 10).alias("refused"))


@query("""SELECT doc_id, sha256(text || chr(31) || lang) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text || chr(31) || lang) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedupe_keep_first(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2(F.concat_ws("\x1f", "text", "lang"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^.?!]+[.?!]?')) AS n_sentences, regexp_extract(text, '[^.?!]+[.?!]?') AS first_sentence FROM documents""")
def sentence_split(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"([^.?!]+[.?!]?)"), 1)
    return t.documents.select("doc_id", F.size(found).cast("bigint").alias("n_sentences"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_sentence"))


@query("""SELECT doc_id, (least(3, CAST(contains(text, ' the ') AS INT) + CAST(contains(text, ' and ') AS INT) + CAST(contains(text, ' of ') AS INT) + CAST(contains(text, ' that ') AS INT)) * 0.55 - 2.4 + 0.9 * CAST(contains(text, '%') AS INT)) > 0 - 1.0 AS passed FROM documents""")
def triage_logistic(t: Tables) -> DataFrame:
    z = text.words_present(F.col("text"), (" the ", " and ", " of ", " that "), 3) * 0.55 - 2.4 + 0.9 * F.col("text").contains("%").cast("int")
    return t.documents.select("doc_id", (1 / (1 + F.exp(-z)) > 1 / (1 + F.exp(F.lit(1.0)))).alias("passed"))


@query("""WITH v AS (SELECT * FROM (VALUES ('en', ' the '), ('en', ' and '), ('de', ' der '), ('de', ' und '), ('fr', ' les '), ('fr', ' dans '), ('es', ' los '), ('es', ' para ')) v(l, w)), s AS (SELECT doc_id, l, sum(1 + len(w) / 4.0) AS x FROM documents, v WHERE contains(lower(text), w) GROUP BY 1, 2) SELECT d.doc_id, coalesce(b.l, 'other') AS vote FROM documents d LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, l) = 1) b ON d.doc_id = b.doc_id""")
def lexicon_vote(t: Tables) -> DataFrame:
    lower, lists = F.lower("text"), {"de": (" der ", " und "), "en": (" the ", " and "), "es": (" los ", " para "), "fr": (" les ", " dans ")}
    votes = F.array(*(F.struct(sum((F.when(lower.contains(w), 1 + len(w) / 4.0).otherwise(0.0) for w in words), F.lit(0.0)).alias("x"), F.lit(-k).alias("o"), F.lit(name).alias("l")) for k, (name, words) in enumerate(lists.items())))
    best = F.array_max(votes)
    return t.documents.select("doc_id", F.when(best["x"] > 0, best["l"]).otherwise("other").alias("vote"))


@query("""WITH g AS (SELECT item_id, list_distinct([substring(x, i, 3) for i in range(1, length(x) - 1)]) AS s FROM (SELECT item_id, regexp_replace(text, '[ \\t\\n]+', '', 'g') AS x FROM benchmark)) SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM g a JOIN g b ON a.item_id < b.item_id""".replace("\\\\", "\\"))
def ngram_jaccard(t: Tables) -> DataFrame:
    """Of all items with each other. The SQL names only items under 40, which are all up to sf0.01."""
    grams = t.benchmark.select("item_id", F.array_distinct(text.ngrams(F.col("text"), 3)).alias("s"))
    a, b = grams.toDF("a", "sa"), grams.toDF("b", "sb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", text.jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, coalesce(nullif(regexp_extract(url, '/(\d{4})', 1), ''), '') AS number FROM pages""")
def title_facts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", r"/(\d{4})", 1).alias("number"))


@query(r"""SELECT page_id, lower(regexp_extract(b, '^[a-zA-Z]+://[^/]*')) || regexp_extract(regexp_replace(b, '\?.*$', ''), '^[a-zA-Z]+://[^/]*(.*)$', 1) || CASE WHEN regexp_matches(b, '[?&]page=') THEN '?page=' || regexp_extract(b, '[?&]page=([^&]*)', 1) ELSE '' END AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages)""")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.canonical_url(F.col("url"), ("page",)).alias("url"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_extract_prop(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) = 42 OR json_exists(props, '$.zz')")
def json_containment(t: Tables) -> DataFrame:
    props = F.try_parse_json("props")
    return t.events.where((F.try_variant_get(props, "$.k", "bigint") == 42) | F.try_variant_get(props, "$.zz", "string").isNotNull()).select("event_id")


@query("""SELECT o_orderkey, CASE WHEN v <= 0 THEN '0원' ELSE concat_ws(' ', CASE WHEN v // 100000000 > 0 THEN format('{:,}', v // 100000000) || '억' END, CASE WHEN v % 100000000 // 10000 > 0 THEN format('{:,}', v % 100000000 // 10000) || '만' END, CASE WHEN v % 10000 > 0 AND v // 100000000 = 0 THEN format('{:,}', v % 10000) END) || '원' END AS amount FROM (SELECT o_orderkey, CAST(round(o_totalprice * 1000, 0) AS BIGINT) AS v FROM orders)""")
def money_format(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", money.format_won(F.round(F.col("o_totalprice") * 1000, 0)).alias("amount"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, a, b, abs(a - b) <= 0.01 * greatest(a, b) AS agree FROM (SELECT *, CAST(round(l_extendedprice, 0) AS BIGINT) AS a, CAST(round(l_quantity * 1000, 0) AS BIGINT) AS b FROM lineitem) WHERE a > 0 AND b > 0")
def money_agree(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumns({"a": F.round("l_extendedprice", 0).cast("bigint"), "b": F.round(F.col("l_quantity") * 1000, 0).cast("bigint")}).where("a > 0 and b > 0")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "a", "b", money.agree(F.col("a"), F.col("b")).alias("agree"))


@query("""SELECT vec_id, q AS query_id, rank FROM (SELECT e.vec_id, q.vec_id AS q, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INT) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 12""")
def cosine_topk(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest(queries, t.embeddings, 12).select("query_id", "vec_id", "rank")


@query("""SELECT label, list(m ORDER BY d) AS mean FROM (SELECT label, d, round(avg(x), 6) + 0.0 AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
def centroid_per_label(t: Tables) -> DataFrame:
    means = vectors.mean_vectors(t.embeddings, "label", "embedding")
    return means.select("label", F.transform("mean", lambda x: F.round(x, 6) + 0.0).alias("mean"))


@query("""SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'created' WHEN b.k IS NULL THEN 'untouched' WHEN a.h = b.h THEN 'skipped' ELSE 'updated' END AS action FROM (SELECT o_orderkey AS k, md5(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 4 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN md5(o_orderstatus || 'x') ELSE md5(o_orderstatus || o_orderpriority) END AS h FROM orders WHERE o_orderkey % 3 <> 0) b ON a.k = b.k""")
def upsert_classify(t: Tables) -> DataFrame:
    same = F.md5(F.concat("o_orderstatus", "o_orderpriority").cast("binary"))
    old = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", same.alias("digest"))
    new = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.md5(F.concat("o_orderstatus", F.lit("x")).cast("binary"))).otherwise(same).alias("digest"))
    return R.upsert_actions(old, new, ["o_orderkey"], "digest")


@query("""SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN a.score ELSE b.score END AS score, CASE WHEN a.k IS NULL THEN b.feedback ELSE a.feedback END AS feedback FROM (SELECT o_orderkey AS k, o_totalprice AS score, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS feedback FROM orders WHERE o_orderkey % 4 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_totalprice * 2 AS score, CAST(NULL AS VARCHAR) AS feedback FROM orders WHERE o_orderkey % 3 <> 0) b ON a.k = b.k WHERE NOT (b.k IS NULL AND a.feedback IS NULL)""")
def merge_keep_feedback(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("feedback"))
    new = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("score"), F.lit(None).cast("string").alias("feedback"))
    return R.merged(old, new, ["o_orderkey"], ["feedback"], F.col("feedback").isNull())


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def insert_if_absent(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name")
    return R.insert_absent(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name")), ["c_custkey"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    """An extra: the reference has no event-time windows."""
    w = F.window(F.col("ts"), "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS exchange FROM conversations""")
def exchange_grouping(t: Tables) -> DataFrame:
    is_question = F.when(F.col("role") == "user", 1).otherwise(0)
    return t.conversations.select("conv_id", "turn", F.sum(is_question).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("exchange"))


@query("SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS BIGINT), CASE WHEN month(o_orderdate) > 6 THEN 7 ELSE 1 END, 1) AS begin_day, CASE WHEN month(o_orderdate) > 6 THEN make_date(CAST(year(o_orderdate) AS BIGINT), 12, 31) ELSE make_date(CAST(year(o_orderdate) AS BIGINT), 6, 30) END AS end_day FROM orders")
def half_year_window(t: Tables) -> DataFrame:
    half = F.when(F.month("o_orderdate") > 6, "H2").otherwise("H1")
    begin, end = dates.half_window(F.year("o_orderdate"), half)
    return t.orders.select("o_orderkey", begin.alias("begin_day"), end.alias("end_day"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN s WHEN e < DATE '{DAY}' THEN s ELSE greatest(s, DATE '{DAY}') END AS start_day, CASE WHEN o_orderstatus = 'P' THEN s ELSE e END AS end_day, o_orderstatus <> 'P' AND e < DATE '{DAY}' AS passed FROM (SELECT *, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 90 AS e FROM orders)""")
def remaining_window(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    w = dates.remaining_window(day, F.date_add(day, 90), F.lit(DAY).cast("date"), F.when(F.col("o_orderstatus") == "P", day))
    return t.orders.select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.start").alias("start_day"), F.col("w.end").alias("end_day"), F.col("w.passed").alias("passed"))


@query("""SELECT event_id, CASE WHEN h >= 22 THEN date_trunc('day', l) + INTERVAL 1 DAY - INTERVAL 1 HOUR WHEN h < 8 THEN date_trunc('day', l) - INTERVAL 1 HOUR END AS resumes FROM (SELECT event_id, ts + INTERVAL 9 HOUR AS l, hour(ts + INTERVAL 9 HOUR) AS h FROM events)""")
def quiet_hours(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.quiet_until(F.col("ts").cast("timestamp"), F.lit(22), F.lit(8)).cast("timestamp_ntz").alias("resumes"))


@query("""WITH s AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(value * 60 AS BIGINT) AS b, event_type FROM events), p AS (SELECT x.event_id, y.event_id AS other, least(x.b, y.b) - greatest(x.a, y.a) AS shared FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type = 'view' AND y.event_type = 'click' AND least(x.b, y.b) > greatest(x.a, y.a)) SELECT event_id, other, shared FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY shared DESC, other) = 1""")
def interval_overlap_best(t: Tables) -> DataFrame:
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = t.events.select("event_id", "user_id", "event_type", a.alias("a"), (a + F.rint(F.col("value") * 60).cast("bigint")).alias("b"))
    x = spans.where("event_type = 'view'")
    y = spans.where("event_type = 'click'").toDF("other", "user_id", "kind", "c", "d")
    shared = F.least("b", "d") - F.greatest("a", "c")
    pairs = x.join(y, "user_id").where(shared > 0).select("event_id", "other", shared.alias("shared"))
    best = pairs.groupBy("event_id").agg(F.max(F.struct("shared", (-F.col("other")).alias("o"))).alias("x"))
    return best.select("event_id", (-F.col("x.o")).alias("other"), F.col("x.shared").alias("shared"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begin_at, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    """An extra: the reference has no session windows."""
    w = F.session_window(F.col("ts"), "6 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin_at"), "n")


@query("SELECT o_orderpriority, count(*) AS n, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS priced FROM orders GROUP BY 1")
def field_coverage(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("priced", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    return records.field_coverage(rows, "o_orderpriority", ["priced"])


@query("SELECT page_id, url || '&serviceKey=***&page=2' AS url FROM pages")
def masked_parameters(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.redact(F.concat("url", F.lit("&serviceKey=abc123&page=2"))).alias("url"))


@query("SELECT user_id, n, digest_day FROM (SELECT user_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS digest_day, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2)")
def digest_windows(t: Tables) -> DataFrame:
    day = dates.business_day(F.col("ts"))
    return t.events.where("event_type <> 'error'").groupBy("user_id", day.alias("digest_day")).agg(F.count("*").alias("n")).select("user_id", "n", "digest_day")


@query("""SELECT c_custkey, list_sort(list_distinct(list(o_orderpriority)))[1:3] AS kinds, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def ordered_distinct_lists(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_custkey").agg(F.slice(F.sort_array(F.collect_set("o_orderpriority")), 1, 3).alias("kinds"), F.count("*").alias("n"))


@query("""SELECT user_id, max(run) AS longest_failure_run FROM (SELECT user_id, grp, count(*) FILTER (WHERE event_type = 'error') AS run FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM events) GROUP BY 1, 2) GROUP BY 1""")
def failure_runs(t: Tables) -> DataFrame:
    group = F.sum((F.col("event_type") != "error").cast("int")).over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    runs = t.events.withColumn("grp", group).groupBy("user_id", "grp").agg(F.count_if(F.col("event_type") == "error").alias("run"))
    return runs.groupBy("user_id").agg(F.max("run").alias("longest_failure_run"))
