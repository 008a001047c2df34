"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

The fingerprint is the set of a text's signatures, written as sorted 32-bit numbers in base64; two are
compared by Jaccard. For pairs, fingerprints are partitioned by set length, so that only those whose lengths
allow the threshold meet, and their common signatures are counted.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import settle

U = np.uint64
#: Frequent words of English, German, French and Spanish.
ANCHORS = tuple(
    "a an and are as at be by for from has have he in is it of on or that the this to was were with you "
    "aber als auch auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al con del el en es las lo los más no para pero por se su una uno y".split()
)
#: Content words in a chain; signatures, the most frequent, that are told to all tasks by similar_pairs().
CHAIN, COMMON = 3, 100_000


def signatures(texts: pa.Array, anchors: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of each text and where each text's begin.

    Words are lower-case and end at ASCII punctuation too. A signature is an anchor with the `chain` content
    words after it, fewer at the end of the text. The first word starts a chain as well, so that texts
    without anchors have one; a text without words but with characters has one for the whole text.
    """
    lower = pa.array([x.lower() for x in texts.to_pylist()], pa.large_string())
    hashes, begins, _, _ = W.words(lower, punctuation_ends=True)
    is_anchor = np.isin(hashes, anchors)
    content = np.flatnonzero(~is_anchor)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    start = is_anchor.copy()
    start[begins[:-1][np.diff(begins) > 0]] = True
    at = np.flatnonzero(start)
    # A first word that is content begins its own chain; an anchor's begins after it.
    rank = np.searchsorted(content, at, "left")
    value = np.where(is_anchor[at], hashes[at], U(1))
    padded = np.append(content, np.full(chain, len(hashes)))
    owners, words = np.append(owner, -1), np.append(hashes, U(0))
    found = np.zeros(len(at), bool)
    for k in range(chain):
        place = padded[rank + k]
        inside = owners[place] == owner[at]
        found |= inside
        value = W.mix(value * U(0x9E3779B97F4A7C15) + np.where(inside, words[place], U(k)))
    # Chains without any content word tell nothing, unless the text has only such.
    alone = np.bincount(owner[at[found]], minlength=len(texts)) == 0
    keep = found | alone[owner[at]]
    sig, own = (value[keep] >> U(32)).astype(np.uint32), owner[at[keep]]
    bare = [(i, int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")) for i, x in enumerate(texts.to_pylist()) if begins[i] == begins[i + 1] and x]
    if bare:
        own, sig = np.append(own, [i for i, _ in bare]), np.append(sig, np.array([v for _, v in bare], np.uint32))
    both = np.unique(own.astype(np.uint64) << U(32) | sig.astype(np.uint64))
    return (both & U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(both >> U(32), np.arange(len(texts) + 1, dtype=np.uint64))


def anchor_hashes(words: tuple[str, ...] = ANCHORS) -> np.ndarray:
    return np.array([W.word_hash(w) for w in words], U)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets: 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sets(texts: list[str], anchors: np.ndarray) -> list[np.ndarray]:
    out = []
    for part in W.chunks(pa.array(texts, pa.large_string())):
        s, at = signatures(part, anchors)
        out += [s[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _written(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint array<long>) for each row: the signatures of its whole text; null and empty texts have none."""
    anchors = anchor_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(1)):
                s, begins = signatures(part, anchors)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(s.astype(np.int64)))], ["id", "fingerprint"])
                at += len(part)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint array<long>")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, twin) for each row: the smallest id whose text has the same fingerprint. A null id is its own twin
    only if no row of its fingerprint has an id. Empty fingerprints are one class. No rows: none."""
    prints = fingerprints(docs, id_col, text_col).select("id", F.sha2(F.array_join("fingerprint", ","), 256).alias("print"))
    prints = settle(prints, "fingerprints")
    return prints.join(prints.groupBy("print").agg(F.min("id").alias("twin")), "print").select("id", "twin")


def _partition(n: Column, threshold: float) -> Column:
    """Set lengths n fall into partitions so that two sets only reach the threshold in one or in neighbours."""
    return F.floor(F.log(n.cast("double")) / -np.log(threshold) + 1e-9).cast("int")


def _prefixes(sets: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(id, n, part, s) of sets(id, fingerprint): the signatures that look for partners, as many as a set can miss
    and one more, those first that aren't in `common`(s, df), then by df. Two sets that reach the threshold share one."""
    frequent = common.sparkSession.sparkContext.broadcast({r["s"]: r["df"] for r in common.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(frequent.value), np.int64)
        df = np.array([frequent.value[k] for k in keys.tolist()], np.int64)
        for batch in batches:
            lists = batch.column(1)
            s, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
            order = np.lexsort((s, np.where(keys[at] == s, df[at], 0) if len(keys) else np.zeros(len(s)), owner))
            take = np.maximum(1, n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)
            rank = np.arange(len(s)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else [], n).astype(np.int64)
            keep = rank < take[owner]
            chosen, of = s[order][keep], owner[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(chosen)], ["id", "n", "s"])

    rows = sets.select("id", "fingerprint").mapInArrow(run, "id long, n int, s long")
    return rows.withColumn("part", _partition(F.col("n"), threshold))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, queries: Column | None = None) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints with Jaccard of threshold or more, each named by the
    smallest id that has it (classes() tells which rows those stand for). a < b; with `queries`, a condition on
    `id`, a is a fingerprint for which it holds and b any other.

    Fingerprints are partitioned by set length, and only the rarest signatures of a set, as many as it can miss
    and one more, look for partners in its partition and the neighbours; of two sets found only the intersection
    is counted. At most COMMON signatures, the most frequent, are told to all tasks to rank by; any order gives
    the same pairs. Nulls, texts without signatures and rows without an id have no pairs; no rows: none.
    """
    prints = fingerprints(docs, id_col, text_col).where("id is not null").where(F.size("fingerprint") > 0)
    sets = settle(prints.groupBy("fingerprint").agg(F.min("id").alias("id")).select("id", "fingerprint"), "sets")
    often = sets.select(F.explode("fingerprint").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    common = settle(often.orderBy(F.col("df").desc(), "s").limit(COMMON), "common")
    prefix = settle(_prefixes(sets, common, threshold), "prefixes")
    asking = prefix if queries is None else prefix.where(queries)
    x = asking.select("s", F.col("id").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"))
    y = prefix.select("s", F.col("id").alias("b"), F.col("n").alias("n_b"), "part")
    apart = F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")
    pairs = x.join(y, ["s", "part"]).where(apart & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)).select("a", "b").distinct()
    met = pairs.join(sets.toDF("a", "fa"), "a").join(sets.toDF("b", "fb"), "b")
    both = F.size(F.array_intersect("fa", "fb"))
    return met.select("a", "b", (both / (F.size("fa") + F.size("fb") - both)).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def edited_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its fingerprint and that of its edited text, and how like they are.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next
    row by descending id (after the last: the first). Rows are dealt out by ranges of the id; the first row
    of the following range is sent along with each. Null text counts as empty. Null ids come last. Repeated
    ids follow each other by text. A single row is its own next row. Empty tables give no rows.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark, anchors = docs.sparkSession, anchor_hashes()
    lowest = -(2**63)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b > F.col("key")))
    dealt = rows.withColumns({"part": part, "visits": F.lit(False)})
    # The largest key of each range, at most as many as there are ranges: the row that follows the range before.
    tops = [(r["part"], r["key"]) for r in dealt.groupBy("part").agg(F.max("key").alias("key")).orderBy("part").collect()]
    if not tops:
        tops = [(0, lowest)]
    visits = spark.createDataFrame([(tops[k - 1][0], key) for k, (_, key) in enumerate(tops)], "part int, key long")
    visitors = rows.join(F.broadcast(visits), "key").select("id", "key", "text", "part", F.lit(True).alias("visits"))
    order = (F.col("visits"), F.col("key").desc(), F.xxhash64("text"), F.col("text"))
    ordered = dealt.union(visitors).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", *order).select("id", "text", "visits")

    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all texts but the last, each with the one after it."""
        edited = []
        for t, after in zip(texts[:-1], texts[1:], strict=True):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + after[:half])
        own, new = _sets(texts, anchors), _sets(edited, anchors)
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([_written(s) for s in own[:-1]]), pa.array([_written(s) for s in new]),
            pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)]), pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, over = [], [], 0, False
        for batch in batches:
            for row_id, text, visits in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if over:
                    continue
                texts.append(text)
                size += len(text)
                over = visits
                if over or size > 2 << 20 and len(texts) > 1:
                    yield compared(ids, texts)
                    ids, texts, size = [], texts[-1:], len(text)
                ids.append(row_id)

    return ordered.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
