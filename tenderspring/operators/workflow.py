"""What changes around documents and opportunities: billing states, alerts, reviews, budgets of calls, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days after a failed charge until the next attempt; after the last the subscription ends.
DUNNING_DAYS = (1, 3, 7)
#: Opportunities in an instant alert and in a digest.
INSTANT, DIGEST = 20, 15


def renewal(status: Column, failures: Column, paid: Column, period_end: Column, cancel: Column) -> Column:
    """What a due subscription becomes: a struct of status, failures, next_at. A paid one gets a month (the day
    clamped to its length), a cancelled one ends, a failed charge is tried again after DUNNING_DAYS, then it ends."""
    again = F.get(F.array(*map(F.lit, DUNNING_DAYS)), failures)
    made = lambda s, n, at: F.struct(F.lit(s).alias("status"), n.cast("int").alias("failures"), at.alias("next_at"))
    none = F.lit(None).cast("date")
    return (
        F.when(status == "ended", made("ended", failures, none)).when(cancel, made("ended", F.lit(0), none))
        .when(paid, made("active", F.lit(0), F.add_months(period_end, 1))).when(again.isNotNull(), made("past_due", failures + 1, F.date_add(period_end, again)))
        .otherwise(made("ended", failures + 1, none))
    )


def token_cost(fresh: Column, cached: Column, written: Column, prices: tuple[str, str, str]) -> Column:
    """Cost of a model's call in decimals: tokens read, read from a cache and written, at prices per million."""
    parts = [n.cast("decimal(18,0)") * F.lit(p).cast("decimal(10,4)") for n, p in zip((fresh, cached, written), prices, strict=True)]
    return (sum(parts[1:], parts[0]) / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(24,8)")


def within_budget(calls: DataFrame, by: list[Column], order: list[str], cost: str, most: int) -> DataFrame:
    """calls with `spent` (of the group, before the call) and `allowed`: spent and cost together don't exceed
    `most`. What is refused still counts as projected, as a guard that looks ahead does."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("spent", before).withColumn("allowed", F.col("spent") + F.col(cost) <= most)


def alert_batches(rows: DataFrame, org: str, order: list[Column], threshold: Column, most: int = INSTANT) -> DataFrame:
    """rows above the threshold with `place` (1 to `most`) and `more`, how many further ones the alert only counts."""
    above = rows.where(threshold)
    n = above.groupBy(org).agg(F.count("*").alias("_n"))
    placed = above.withColumn("place", F.row_number().over(Window.partitionBy(org).orderBy(*order))).where(F.col("place") <= most)
    return placed.join(n, org).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def reviewed(rows: DataFrame, decisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields that a decision names put in place, and `changed`: the names of those that differ."""
    said = decisions.select(F.col(key), *(F.col(f).alias(f"_{f}") for f in fields))
    both = rows.join(said, key, "left")
    differs = F.array_compact(F.array(*(F.when(F.col(f"_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)))
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return both.select(*kept, differs.alias("changed"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows of keys that new has, and new: derivations of a document that is processed again."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def answered(requests: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """requests with the answer of the same request in the cache(key, answer), null for those to be asked."""
    key = F.sha2(F.concat_ws("\x1f", *(F.col(p).cast("string") for p in parts)), 256)
    return requests.withColumn("key", key).join(cache, "key", "left")


def cursor(sort: Column, value: Column, score: Column, row_id: Column, day: Column) -> Column:
    """Where a page ended, as URL-safe text; read_cursor() reads it back."""
    told = F.to_json(F.struct(sort.alias("s"), value.cast("string").alias("v"), score.alias("p"), row_id.alias("i"), day.cast("string").alias("d")))
    return F.translate(F.base64(told.cast("binary")), "+/=\r\n", "-_")


def read_cursor(text: Column) -> Column:
    """A struct of s, v, p, i, d; null for anything that isn't a cursor."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int")))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "s string, v string, p double, i bigint, d date")


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: Column, begin: Column, end: Column, step: int) -> DataFrame:
    """points joined with the intervals [begin, end) of their keys that hold `at`; all three are whole numbers.
    Intervals are dealt out to cells of `step`, so that a point meets those of its cell alone."""
    cells = F.explode(F.sequence(F.floor(begin / step), F.floor((end - 1) / step)))
    spread = intervals.where(end > begin).withColumn("_cell", cells)
    return points.withColumn("_cell", F.floor(at / step)).join(spread, [*keys, "_cell"]).where((at >= begin) & (at < end)).drop("_cell")


def precision_recall(rows: DataFrame, predicted: Column, expected: Column, by: list[str]) -> DataFrame:
    """For each group n, precision, recall and f1 of a predicted against an expected condition, three digits; null
    where nothing is predicted or expected."""
    both = F.count_if(predicted & expected)
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 3)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ratio(both, F.count_if(predicted)).alias("precision"), ratio(both, F.count_if(expected)).alias("recall"), ratio(2 * both, F.count_if(predicted) + F.count_if(expected)).alias("f1"))


def valid_profile(regions: Column, least: Column, most: Column, categories: Column, keywords: Column, known: tuple[str, ...], most_regions: int = 17) -> Column:
    """A struct of problems (names, empty if it may be kept) and keywords (trimmed, once each, in their order)."""
    problems = F.array_compact(F.array(
        F.when(F.size(regions) > most_regions, "regions"), F.when(least > most, "budget"), F.when(F.exists(categories, lambda c: ~c.isin(*known)), "categories"),
    ))
    return F.struct(problems.alias("problems"), F.array_distinct(F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != "")).alias("keywords"))
