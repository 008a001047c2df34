"""One-to-one matching of scored pairs, and codes followed to what they became."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release, written


def matched(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, score): the pairs that are taken if all are gone through from the highest score on, ties by a and b, and one
    is taken when neither side was.

    Each round takes all pairs that are the first of both their sides and leaves out those they rule out; as the first
    of all that are left is among them, every round takes some. Pairs with a null side or score are left out,
    repeated pairs are one; of equal pairs with several scores the highest counts.
    """
    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("score")).where("a is not null and b is not null and score is not null")
    left = written(rows.groupBy("a", "b").agg(F.max("score").alias("score")), "pairs")
    order = F.struct((-F.col("score")).alias("s"), "a", "b")
    taken = None
    while True:
        of_a, of_b = left.groupBy("a").agg(F.min(order).alias("m")), left.groupBy("b").agg(F.min(order).alias("n"))
        # A pair is first of its sides if both sides' firsts are the same pair.
        now = of_a.join(of_b, F.col("m") == F.col("n")).select("m.a", "m.b", (-F.col("m.s")).alias("score"))
        now = written(now if taken is None else taken.union(now), "taken")
        rest = written(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"), "pairs")
        release(left)
        if taken is not None:
            release(taken)
        left, taken = rest, now
        if not left.limit(1).count():
            return taken.select(F.col("a").alias(a), F.col("b").alias(b), F.col("score").alias(score))


def followed(moves: DataFrame, old: str = "code", new: str = "new_code") -> DataFrame:
    """(old, last, steps, cyclic): where each code's renames and moves end, by pointer doubling; a code of a cycle, or that
    leads into one, has no last.

    moves(old, new): one successor a code; of several the smallest is taken. A code that becomes itself, or null, ends
    there. After as many doublings as a chain of all codes needs, what hasn't ended is cyclic.
    """
    rows = moves.where(F.col(old).isNotNull() & F.col(new).isNotNull() & (F.col(old) != F.col(new))).groupBy(F.col(old).alias("code")).agg(F.min(new).alias("last"))
    now = written(rows.withColumn("steps", F.lit(1).cast("long")), "moves")
    for _ in range(max(now.count(), 1).bit_length() + 1):
        ahead = now.select(F.col("code").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        step = now.join(ahead, "last", "left").select("code", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "moves")
        release(now)
        now = step.drop("moved")
        now._tenderspring_path = step._tenderspring_path
        if not step.where("moved").limit(1).count():
            break
    cyclic = now.select("last").distinct().join(rows.select(F.col("code").alias("last")), "last", "left_semi").withColumn("cyclic", F.lit(True))
    out = now.join(cyclic, "last", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return out.select(F.col("code").alias(old), F.when(~F.col("cyclic"), F.col("last")).alias("last"), F.when(~F.col("cyclic"), F.col("steps")).alias("steps"), "cyclic")


def curated_first(curated: DataFrame, generated: DataFrame, key: str = "code", aliases: str = "aliases") -> DataFrame:
    """Rows of two tables of the same columns by key: curated ones win, with the aliases of both, their own first. Keys
    must be distinct within a table."""
    more = generated.select(F.col(key), F.col(aliases).alias("_more"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(aliases, none), F.coalesce("_more", none))
    first = curated.join(more, key, "left").select(*(both.alias(c) if c == aliases else F.col(c) for c in curated.columns))
    return first.unionByName(generated.join(curated.select(key), key, "left_anti").select(*curated.columns))
