"""Building blocks of the pipeline's tables: top rows, latest rows, modes, cohorts, upserts, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank", slices: int = 32) -> DataFrame:
    """The first n rows of each key. Each slice of a key gives its own first n before they meet, so that a
    key with very many rows is not sorted by one task."""
    tie = F.xxhash64(*(F.col(c) for c in rows.columns))
    part = rows.withColumn("_slice", F.pmod(tie, F.lit(slices))).withColumn(rank, F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order))).where(F.col(rank) <= n)
    return part.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n).drop("_slice")


def latest_by(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """For each key the columns `keep` of the row with the largest `order`, combined before the shuffle."""
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in keep))).alias("best"))
    return best.select(key, *(F.col("best")[f"_{c}"].alias(c) for c in keep))


def first_seen_mode(rows: DataFrame, key: str, value: str, position: list[str]) -> DataFrame:
    """(key, value): the most frequent non-null value of each key; ties go to the value seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value))


def cohort_rates(rows: DataFrame, group: str, detail: str, converted: Column) -> DataFrame:
    """(cohort, n, n_converted): counts for each `group:detail` and each `group:*`."""
    each = rows.select(F.explode(F.array(F.concat_ws(":", group, detail), F.concat(F.col(group), F.lit(":*")))).alias("cohort"), converted.cast("long").alias("c"))
    return each.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("c").alias("n_converted"))


def exclusive_quartiles(sorted_values: Column) -> tuple[Column, Column]:
    """25 % and 75 % points of a sorted array of four values or more by the exclusive rule, else null: the
    point k lies at place k (n + 1) / 4."""
    n = F.size(sorted_values)

    def at(k: int) -> Column:
        j, d = F.floor(k * (n + 1) / 4).cast("int"), F.pmod(k * (n + 1), F.lit(4))
        return F.when(n >= 4, (F.element_at(sorted_values, j) * (4 - d) + F.element_at(sorted_values, F.least(j + 1, n)) * d) / F.lit(4.0))

    return at(1), at(3)


def at_places(rows: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, n, one column for each of `places`): the value at a place, counted from 1, among a key's n values in
    ascending order, nulls first; null where the place is outside. `places` are functions of n. Rows are counted
    by value and the counts added up within narrow ranges of values and over them, so that no key's values
    are gathered."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    x = F.col(value).cast("double")
    # Ranges grow by a 256th of an octave; their number rises with the value.
    cell = F.when(x.isNull(), F.lit(float("-inf"))).when(F.isnan(x), F.lit(float("inf"))).otherwise(F.signum(x) * F.floor(F.log1p(F.abs(x)) * 256 / F.log(F.lit(2.0))).cast("double"))
    counts = counts.withColumn("_cell", cell + F.lit(0.0))
    of_key = Window.partitionBy(key)
    cells = counts.groupBy(key, "_cell").agg(F.sum("_c").alias("_m"))
    cells = cells.withColumns({"_before": F.sum("_m").over(of_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"), "n": F.sum("_m").over(of_key)})
    cells = cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), "_before", "n")
    both = counts.join(cells, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_at")))
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "_cell").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("_last", last)
    holds = lambda place: (place > F.col("_last") - F.col("_c")) & (place <= F.col("_last"))
    return ranked.groupBy(key).agg(F.max("n").alias("n"), *(F.max(F.when(holds(f(F.col("n"))), F.col(value))).alias(name) for name, f in places.items()))


def upsert_actions(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, action): created, updated or skipped for the rows of `new`, untouched for others of `old`."""
    a, b = old.select(*key, F.col(digest).alias("_old")), new.select(*key, F.col(digest).alias("_new"))
    both = a.join(b, key, "full")
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "untouched").when(F.col("_old") == F.col("_new"), "skipped").otherwise("updated")
    return both.select(*key, action.alias("action"))


def merged(old: DataFrame, new: DataFrame, key: list[str], kept: list[str], drop_missing: Column | None = None) -> DataFrame:
    """old with the rows of new put in: new columns win but for `kept`, which users own. Old rows that new
    lacks stay, unless drop_missing holds for them."""
    names = [c for c in old.columns if c not in key]
    a = old.select(*key, F.lit(True).alias("_had"), *(F.col(c).alias(f"_old_{c}") for c in names))
    b = new.select(*key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") if c in new.columns else F.lit(None).alias(f"_new_{c}") for c in names))
    both = a.join(b, key, "full")
    pick = [F.when(F.col("_had").isNotNull() & (F.col("_new").isNull() | F.lit(c in kept)), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c) for c in names]
    gone = F.lit(False) if drop_missing is None else F.col("_new").isNull() & drop_missing
    return both.select(*key, "_new", *pick).where(~F.coalesce(gone, F.lit(False))).drop("_new")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def running_balance(entries: DataFrame, account: str, order: list[str], delta: str) -> DataFrame:
    """entries with balance_after, the sum of an account's deltas so far. The entries of an account
    are ordered in one task, which holds one at a time; `order` must be a total order within an account."""
    within = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance_after", F.sum(delta).over(within))


def replay_ledger(entries: DataFrame, account: str = "account", key: str = "idempotency_key", delta: str = "delta", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Entries in order with status (applied, repeated, rejected) and balance_after: a key used before does
    nothing, a delta that would take the balance below zero is rejected. Each depends on the outcome of those
    before, so an account is folded in order; accounts are independent."""
    import pandas as pd

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(list(order), kind="stable").copy()
        balance, seen, status, after = 0, set(), [], []
        for k, d in zip(own[key], own[delta], strict=True):
            what = "repeated" if k in seen else "rejected" if balance + d < 0 else "applied"
            if what == "applied":
                balance += int(d)
                seen.add(k)
            status.append(what)
            after.append(balance)
        own["status"], own["balance_after"] = status, after
        return own

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in entries.schema)}, status string, balance_after long"
    return entries.groupBy(account).applyInPandas(fold, schema)


def expiry(balance: Column, granted: Column, spent: Column) -> Column:
    """Credits of a period that lapse: what was granted and not spent, at most the balance, at least none."""
    return F.greatest(F.lit(0), F.least(balance, granted - spent))


def pairwise_counts(rows: DataFrame, found: str, truth: str) -> DataFrame:
    """One row: pairs of rows that are together in both partitions (tp), only found (fp), only true (fn).
    Counted from the sizes of the cells, without making pairs."""
    pairs = lambda c: (c * (c - 1) / 2).cast("long")
    cells = rows.groupBy(found, truth).agg(F.count("*").alias("n"))
    both = cells.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias("tp"))
    one = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias(name)) for c, name in ((found, "pf"), (truth, "pt"))]
    out = both.crossJoin(one[0]).crossJoin(one[1])  # three tables of one row
    return out.select("tp", (F.col("pf") - F.col("tp")).alias("fp"), (F.col("pt") - F.col("tp")).alias("fn"))
