"""Near-duplicates by ProbMinHash: weighted word shingles, banded signatures, exact verification, classes.

A shingle of weight w has a Poisson process of rate w: its arrivals each hit one random register, and a
register keeps the shingle that came first. Two texts agree in a register with the probability Jaccard
similarity of their weighted shingles. An element's process stops once its next arrival comes after every
register of the text is taken by an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .components import components
from .shared import scratch, settle

U = np.uint64
#: 80 registers as 20 bands of 4: a pair at 0.8 is missed with probability (1 - 0.8**4)**20, about 3e-5.
BANDS, ROWS = 20, 4
#: Registers, of four bits each, that decide which further members of a band are compared; members of a block.
FINE, BLOCK = 2048, 256
#: So many ids at most are broadcast, to pick their texts; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 500
_EQUAL = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def weighted_shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, how often each occurs, where each text's begin."""
    hashes, begins, _, _ = W.words(texts)
    runs, at = W.shingles(hashes, begins, size)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.concatenate(([True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]))) if len(runs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return runs[first], np.diff(np.append(first, len(runs))), np.searchsorted(owner[first], np.arange(len(at)))


def signatures(shingles: np.ndarray, weights: np.ndarray, begins: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """A row of m register winners for each text; rows of texts without shingles stay zero."""
    n = len(begins) - 1
    came = np.full(n * m, np.inf)
    winner = np.zeros(n * m, U)
    owner = np.repeat(np.arange(n), np.diff(begins))
    alive, time, k = np.arange(len(shingles)), np.zeros(len(shingles)), 0
    while len(alive):
        k += 1
        draw = W.mix(shingles[alive] + U(k * 0xD1342543DE82EF95 % 2**64))
        time = time + -np.log(((draw >> U(11)).astype(np.float64) + 0.5) / 2**53) / weights[alive]
        slot = owner[alive] * m + (W.mix(draw) >> U(32)).astype(np.int64) % m
        np.minimum.at(came, slot, time)
        won = came[slot] == time
        winner[slot[won]] = shingles[alive[won]]
        go = time < came.reshape(n, m).max(axis=1)[owner[alive]]
        alive, time = alive[go], time[go]
    return winner.reshape(n, m)


def both_signatures(shingles: np.ndarray, weights: np.ndarray, begins: np.ndarray, m: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures by the counts, those with all counts 1, and which texts repeat a shingle; for the others both are the same."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    weighted = signatures(shingles, weights.astype(float), begins, m)
    plain, repeats = weighted.copy(), np.bincount(owner[weights > 1], minlength=len(begins) - 1) > 0
    if repeats.any():
        own = shingles[repeats[owner]]
        plain[repeats] = signatures(own, np.ones(len(own)), np.concatenate(([0], np.cumsum(np.diff(begins)[repeats]))), m)
    return weighted, plain, repeats


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets with sorted distinct elements: the sum over
    shared d of 1 / sum over all e of max(wa_e / wa_d, wb_e / wb_d)."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    # The inner sum depends only on the ratio r = (wa_d / wb_d): sum of max(wa_e, r wb_e) / wa_d.
    xa = np.concatenate((wa[ia], np.delete(wa, ia), np.zeros(len(b) - len(ib)))).astype(float)
    xb = np.concatenate((wb[ib], np.zeros(len(a) - len(ia)), np.delete(wb, ib))).astype(float)
    ratio, back = np.unique(wa[ia] / wb[ib], return_inverse=True)
    # max(xa, r xb) is r xb for elements whose own ratio lies below r: prefix sums over the sorted ratios.
    own = np.divide(xa, xb, out=np.full(len(xa), np.inf), where=xb > 0)
    order = np.argsort(own, kind="stable")
    below = np.searchsorted(own[order], ratio, "left")
    sb, sa = np.concatenate(([0], np.cumsum(xb[order]))), np.concatenate(([0], np.cumsum(xa[order][::-1])))[::-1]
    return float((wa[ia] / (ratio * sb[below] + sa[below])[back]).sum())


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, same, bands): BANDS values by the counts and, of texts that repeat a shingle, BANDS with all counts 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in W.chunks(batch.column(1)):
                s, w, begins = weighted_shingles(part, size)
                weighted, plain, repeats = both_signatures(s, w, begins)
                rows = np.hstack((weighted, plain)).reshape(-1, 2 * BANDS, ROWS)
                bands = np.zeros((len(part), 2 * BANDS), U)
                for r in range(ROWS):
                    bands = W.mix(bands + rows[:, :, r] + U(r + 1))
                many = np.where(np.diff(begins) > 0, BANDS * (1 + repeats), 0)
                given = np.arange(2 * BANDS) < many[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(bands[given].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), batch.column(2).slice(at, len(part)), lists], ["id", "same", "bands"])
                at += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("same"))
    return rows.mapInArrow(run, "id long, same string, bands array<long>")


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids."""
    ids = settle(ids.distinct(), "ids")
    return texts.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """pairs(a, b) with the exact plain and weighted similarity of their texts, and `linked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, 0
            while at < n:
                to = min(n, at + 64)
                own = batch.slice(at, to - at)
                left, right = (weighted_shingles(c.cast(pa.large_string()).fill_null(""), size) for c in (own.column(2), own.column(3)))
                plains, weighted = [], []
                for i in range(own.num_rows):
                    (a, wa), (b, wb) = ((x[0][x[2][i] : x[2][i + 1]], x[1][x[2][i] : x[2][i + 1]]) for x in (left, right))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    plains.append(both / max(1, len(a) + len(b) - both))
                    weighted.append(plains[-1] if (wa == 1).all() and (wb == 1).all() else probability_jaccard(a, wa, b, wb))
                linked = np.maximum(plains, weighted) >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(plains), pa.array(weighted), pa.array(linked)], ["a", "b", "plain", "weighted", "linked"])
                at = to

    pairs = settle(pairs, "pairs")
    texts = _of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(run, "a long, b long, plain double, weighted double, linked boolean")


def _open(met: DataFrame, found: DataFrame) -> DataFrame:
    """Members (band, value, id, root, n, stray) of the bands whose members aren't all in one class; n of them
    are in the band, and stray ones are outside the class of the band's head."""
    members = met.join(found.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    kinds = members.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.max(F.when(F.col("id") == F.col("head"), F.col("root"))).alias("head_root"))
    mixed = members.join(kinds.where("lo < hi"), ["band", "value"])
    return settle(mixed.select("band", "value", "id", "root", "n", (F.col("root") != F.col("head_root")).alias("stray")), "open")


def _fine(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, fine): signatures of FINE registers of four bits each, by the counts and, of texts that repeat a
    shingle, with all counts 1."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(1), 1 << 18):
                s, w, begins = weighted_shingles(part, size)
                weighted, plain, repeats = both_signatures(s, w, begins, FINE)
                four = (np.hstack((weighted, plain)) >> U(60)).astype(np.uint8)
                packed = four[:, ::2] << 4 | four[:, 1::2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([r[: FINE // 2 * (1 + twice)].tobytes() for r, twice in zip(packed, repeats, strict=True)], pa.binary())], ["id", "fine"])
                at += len(part)

    # Long signatures take far longer than reading a text: they are dealt out evenly, however few files hold the texts.
    dealt = _of(texts, ids).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return settle(dealt.mapInArrow(signed, "id long, fine binary"), "fine", TEXT_ROWS)


def _further_pairs(mixed: DataFrame, fine: DataFrame, threshold: float, every: bool) -> DataFrame:
    """Pairs (a, b, equal registers, larger root), a > b, that may still be links although they share a band
    and lie in different classes: all, or the likeliest of each stray text in a block.

    In each band the members outside the head's class meet all members, in blocks of texts with their `fine`
    signatures and bands. Given back are only pairs of which an estimate, by the counts or of the distinct
    shingles, comes within four deviations of the threshold, each from the first band that it shares. So a band with many members makes few rows, although
    each is compared.
    """
    strays = mixed.where("stray").groupBy("band", "value").agg(F.count("*").alias("k"))
    # Registers of different elements agree by chance once in 16 times.
    share = threshold + (1 - threshold) / 16
    least = int(FINE * (share - 4 * (share * (1 - share) / FINE) ** 0.5))

    def met(block: pa.Table) -> pa.Table:
        ids, roots, left, stray = (np.array(block.column(c).to_pylist()) for c in ("id", "root", "left", "stray"))
        own = np.array([x if len(x) > BANDS else x * 2 for x in block.column("bands").to_pylist()]).reshape(-1, 2, BANDS)
        bits = block.column("fine").to_pylist()
        repeats = np.array([len(x) > FINE // 2 for x in bits])
        fine = np.frombuffer(b"".join(x if len(x) > FINE // 2 else x * 2 for x in bits), np.uint8).reshape(-1, 2, FINE // 2)
        band = block.column("band")[0].as_py()
        columns = np.flatnonzero(~left)
        a, b, equal, larger = [], [], [], []
        for i in np.flatnonzero(left):
            other = columns[(roots[columns] != roots[i]) & ~(stray[columns] & (ids[columns] < ids[i]))]
            other = other[~(own[other, :, :band] == own[i, :, :band]).any(axis=(1, 2))]
            same = _EQUAL[fine[other, 0] ^ fine[i, 0]].sum(axis=1, dtype=np.int64)
            two = np.flatnonzero(repeats[other] | repeats[i])
            same[two] = np.maximum(same[two], _EQUAL[fine[other[two], 1] ^ fine[i, 1]].sum(axis=1, dtype=np.int64))
            close = np.flatnonzero(same >= least)
            if not every and len(close):
                close = close[[same[close].argmax()]]
            near = other[close]
            equal += same[close].tolist()
            larger += np.maximum(roots[near], roots[i]).tolist()
            a += np.maximum(ids[near], ids[i]).tolist()
            b += np.minimum(ids[near], ids[i]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "equal": pa.array(equal, pa.int64()), "root": pa.array(larger, pa.int64())})

    rows = mixed.join(strays, ["band", "value"]).withColumns({"n_left": F.ceil(F.col("k") / BLOCK), "n_right": F.ceil(F.col("n") / BLOCK)})
    left = rows.where("stray").select("*", F.pmod(F.xxhash64("id"), "n_left").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right") - 1)).alias("j"), F.lit(True).alias("left"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "n_right").alias("j"), F.lit(False).alias("left"))
    columns = ["band", "value", "i", "j", "id", "root", "left", "stray"]
    blocks = left.select(*columns).union(right.select(*columns)).join(fine, "id")
    return blocks.groupBy("band", "value", "i", "j").applyInArrow(met, "a long, b long, equal long, root long").distinct()


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends aren't in one class yet."""
    roots_a, roots_b = found.toDF("a", "root_a"), found.toDF("b", "root_b")
    rows = pairs.join(roots_a, "a", "left").join(roots_b, "b", "left")
    root_a, root_b = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    return rows.where(root_a != root_b).select(*pairs.columns)


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(id, same, class_id, n_links) for each row; `same` is the digest of its text. Written once; what it took goes."""
    with scratch():
        rows = settle(_signed(docs, id_col, text_col, size), "signed", TEXT_ROWS)
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        firsts = settle(rows.where("same is not null").groupBy("same").agg(F.min("id").alias("first"), F.max_by("bands", -F.col("id")).alias("bands")), "firsts")
        banded = firsts.where("first is not null and size(bands) > 0").select(F.col("first").alias("id"), F.explode(F.array_distinct(F.transform("bands", lambda v, i: F.struct((i % BANDS).alias("band"), v.alias("value"))))).alias("b")).select("id", "b.*")
        heads = banded.groupBy("band", "value").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
        met = settle(banded.join(heads, ["band", "value"]).select("band", "value", "id", "head"), "met")
        texts = settle(_of(texts, met.select("id")), "candidates")
        stars = settle(met.where("id > head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "stars")
        links = settle(_verified(stars.groupBy("a").agg(F.min("b").alias("b")), texts, size, threshold), "head-links", TEXT_ROWS)
        found = settle(components(links.where("linked").select("a", "b")), "head-classes")
        apart = _apart(stars.join(links, ["a", "b"], "left_anti"), found)
        links = settle(links.union(_verified(apart, texts, size, threshold)), "links", TEXT_ROWS)
        found = settle(components(links.where("linked").select("a", "b")), "classes")
        mixed = _open(met, found)
        fine = _fine(texts, mixed.select("id"), size).join(firsts.select(F.col("first").alias("id"), "bands"), "id")
        for every in (False, True):
            more = settle(_further_pairs(mixed, fine, threshold, every), "more")
            if more.isEmpty():
                break
            more = more.join(links.select("a", "b"), ["a", "b"], "left_anti")
            if not every:
                more = more.groupBy("root").agg(F.max_by(F.struct("a", "b"), F.struct("equal", "a", "b")).alias("pair")).select("pair.*")
            links = settle(links.union(_verified(more.select("a", "b"), texts, size, threshold)), "links", TEXT_ROWS)
            found = settle(components(links.where("linked").select("a", "b")), "classes")
            mixed = mixed if every else _open(met, found)
        ends = links.where("linked").select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("n_links"))
        known = firsts.select("same", "first").join(found.withColumnRenamed("node", "first"), "first", "left").join(ends, "first", "left")
        known = known.select("same", F.coalesce("root", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        out = rows.select("id", "same").join(known, "same", "left")
        out = out.select("id", "same", F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        return settle(out, "classified", outer=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: `id_col`, class_id (smallest id of its class), n_links (verified links of its
    text to different texts). A link: exact probability Jaccard of the two texts' shingle counts, or plain
    Jaccard of their distinct shingles, of at least `threshold`.

    Equal texts are one class before any comparing and only the text with the smallest id goes on. Texts that
    share a band are candidates. Each is compared with the smallest id of all its bands, then with the smallest
    of each band where both still lie in different classes, and then those that still lie in different classes
    of one band are compared, first by longer signatures in blocks and then exactly: of each class the likeliest
    pair, then all that are left. Every candidate pair is compared, or lies in one class by verified links, or
    is ruled out by a signature of FINE registers (a pair at the threshold is ruled out with probability 3e-5).
    Texts that repeat a shingle have bands and signatures both by the counts and of their distinct shingles, so
    that a link by either measure is found with the same probability.

    Null text: a class of its own. Empty or all-space texts: equal ones are one class, without links. A null
    id is kept as a row, its class_id that of its text. Repeated ids: each row is returned, with the class of
    its own text. Texts shorter than `size` words have one shingle of all their words. Empty table: no rows.
    Extra columns aren't read.
    """
    return _classes(docs, id_col, text_col, size, threshold).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without near-duplicates, all columns kept: of each class the row whose id is the class's.

    Of rows that repeat both that id and its text one stays, that with the smallest hash; of repeated ids with different texts of one
    class, the text with the smallest SHA-256. Rows with null text stay. Null ids stay only if no row of
    their class has an id, one for each text.
    """
    named = _classes(docs, id_col, text_col, size, threshold).where("same is not null and id <=> class_id")
    stay = named.groupBy("id").agg(F.min("same").alias("same")).select(F.struct("id", "same").alias("key"))
    text = F.col(f"`{text_col}`")
    key = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.sha2(text, 256).alias("same"))
    rows = docs.where(text.isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    once = rows.join(stay, "key", "left_semi").withColumn("nth", nth).where("nth = 1")
    return once.select(*(F.col("row")[c].alias(c) for c in docs.columns)).union(docs.where(text.isNull()))
