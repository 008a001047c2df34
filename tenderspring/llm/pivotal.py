"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is to be taken target / source size times. The whole part is sure; the fractions are
rounded in pairs: two documents trade probability, weighed by their sizes so that the words expected from
both stay the same, until one of them is in or out for sure; the other trades with the next. Which way a
trade goes is drawn so that each document's chance stays what it was. One document of a block may stay
undecided; those of many blocks form the blocks of the next level, up to one block for a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, scratch, settle

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows of a block on average, and undecided documents that meet in one block of a higher level.
BLOCK = 256


def words(text: Column) -> Column:
    """The number of words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, blocks) of sizes(source, size). target: words wanted from the source, share
    of all words by weights that repeat over the sources in code point order (null last), each at most `most`
    times its size; what is cut off goes to the others by weight until none is above. blocks: of about BLOCK rows.

    Two sums come to the driver in each round, however many sources there are.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    found = settle(found.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights))), "sources")
    most_words, level, full = most * F.col("source_size"), 0.0, -1
    whole = share * (found.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        at_most = most_words < level * F.col("weight")
        sums = found.agg(F.count_if(at_most), F.sum(F.when(at_most, most_words).otherwise(0.0)), F.sum(F.when(at_most, 0.0).otherwise(F.col("weight")))).first()
        if sums[0] <= full or not sums[2]:
            break
        full, level = sums[0], (whole - sums[1]) / sums[2]
    target = F.when(most_words < level * F.col("weight"), most_words).otherwise(level * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).alias("blocks"))


def _round_block(size: np.ndarray, chance: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Chances after rounding in the given order, and the place of the one that stays undecided (-1: none)."""
    draws, s = np.random.default_rng(seed).random(len(size)).tolist(), size.tolist()
    x, held = [float(round(v)) if v < 1e-9 or v > 1 - 1e-9 else v for v in chance.tolist()], -1
    for j, y in enumerate(x):
        if y in (0.0, 1.0):
            continue
        if held < 0:
            held = j
            continue
        i = held
        own, other = x[i] * s[i], y * s[j]
        up, down = min(s[i] - own, other), min(own, s[j] - other)
        # up * down is what the first gains or loses on average: nothing, so that chances stay.
        own, other = (own + up, other - up) if draws[j] * (up + down) < down else (own - down, other + down)
        x[i], x[j] = own / s[i], other / s[j]
        for k in (i, j):
            if x[k] < 1e-9 or x[k] > 1 - 1e-9:
                x[k] = float(round(x[k]))
        held = next((k for k in (i, j) if x[k] not in (0.0, 1.0)), -1)
    return np.array(x), held


def _level(rows: DataFrame, last: Column) -> DataFrame:
    """Rounds each (source, block), largest first. `chance` becomes 0 or 1 but for one row of a block, and for
    that too where `last` says that its source has no other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                rest = pa.concat_tables([*([rest] if rest else []), pa.Table.from_batches([batch])])
                key = rest["key"].to_numpy()
                edge = int(np.searchsorted(key, key[-1]))  # rows of one key may go on in the next batch
                if edge:
                    yield from rounded(rest.slice(0, edge))
                    rest = rest.slice(edge)
        if rest:
            yield from rounded(rest)

    def rounded(part: pa.Table) -> list[pa.RecordBatch]:
        key, chance, size, ends = part["key"].to_numpy(), part["chance"].to_numpy().copy(), part["size"].to_numpy().astype(float), part["last"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out, held = _round_block(size[a:b], chance[a:b], int(key[a]) & 0x7FFFFFFFFFFFFFFF)
            if held >= 0 and ends[a]:
                out[held] = float(np.random.default_rng(int(key[a]) & 0x7FFFFFFFFFFFFFFE).random() < out[held])
            chance[a:b] = out
        return part.set_column(part.column_names.index("chance"), "chance", pa.array(chance)).to_batches()

    keyed = rows.withColumns({"key": F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "block"), "last": last})
    dealt = keyed.repartition("key").sortWithinPartitions("key", F.col("size").desc(), "place")
    return dealt.mapInArrow(run, dealt.schema)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, result: str = "mix") -> DataFrame:
    """Each row of docs with the columns in `carry` (the id by default) and a struct named `result`: size (words),
    source_size, target (its source's), copies (0, 1 or 2), taken (copies times size).

    Draws depend on ids, sizes and sources alone, so that reruns agree. Taken words of a source differ from
    its target by less than one document. Null text: size 0, taken 0. Null source is a source of its own, the
    last. Rows that repeat are rounded each for itself; of rows with the same id, source and size those whose
    texts have the smaller hash (then the smaller text) are taken more often. No words at all: targets 0. No
    rows: none. Extra columns don't matter. Texts aren't carried through the rounding but joined to its result.
    """
    carry = carry or [id_col]
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), words(F.col(f"`{text_col}`")).alias("size"))
    with scratch():
        given = settle(_decided(settle(docs.select(key.alias("key")).select("key.*"), "sizes")), "mix", outer=True)
    mix = F.struct(*(F.col(c) for c in ("size", "source_size", "target")), F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    if carry == [id_col]:
        return given.select(F.col("id").alias(id_col), mix.alias(result))
    each = given.groupBy(F.struct("id", "source", "size").alias("key")).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.min("copies").alias("least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    row = F.struct(*(F.col(f"`{c}`") for c in carry))
    text = F.col(f"`{text_col}`")
    rows = docs.select(row.alias("row"), key.alias("key"), F.xxhash64(text).alias("hash"), text.alias("text")).join(each, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("hash", "text"))
    made = rows.withColumn("copies", F.col("least") + (nth <= F.col("more")).cast("int")).select("row", "key.size", "source_size", "target", "copies")
    return made.select(*(F.col("row")[c].alias(c) for c in carry), mix.alias(result))


def _decided(rows: DataFrame) -> DataFrame:
    """rows(id, source, size) with source_size, target and copies."""
    plan = settle(source_plan(rows), "plan")
    most_blocks = plan.agg(F.max("blocks")).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    start = joined.withColumn("ratio", ratio).withColumns({"sure": F.floor("ratio"), "chance": F.col("ratio") - F.floor("ratio"), "place": F.xxhash64("id", "size")})
    names = ["id", "source", "size", "source_size", "target"]
    # Rows of size 0 have nothing to take: they are as often in the mix as is sure.
    done = [start.where("size = 0").select(*names, F.col("sure").alias("copies"))]
    now = start.where("size > 0").select(*names, "sure", "chance", "place", "blocks", F.pmod("place", F.col("blocks")).alias("block"))
    while True:
        now = settle(_level(now, F.col("blocks") == 1).drop("key", "last"), "level")
        done.append(now.where("chance in (0.0, 1.0)").select(*names, (F.col("sure") + F.col("chance").cast("long")).alias("copies")))
        if most_blocks == 1:
            break
        most_blocks = -(-most_blocks // BLOCK)
        now = now.where("chance not in (0.0, 1.0)").withColumns({"block": F.floor(F.col("block") / BLOCK), "blocks": F.ceil(F.col("blocks") / BLOCK)})
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out
