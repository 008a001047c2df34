"""Collocations: merged count-min sketches rule out rare n-grams, a second pass counts the survivors exactly.

A sketch has ROWS rows of `width` cells for each n-gram length. Tasks send their sketches in slabs of cells,
slabs are summed, and of the sums one bit a cell is kept: whether it reached `least`. An n-gram with a zero
bit in any row is rarer than that, and so is each longer one that contains it, which the sketch of longer ones
leaves out. All others are counted by their words. Too narrow a sketch lets more n-grams through, never fewer, and counts don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import settle

U = np.uint64
#: Words in the longest candidate, the fewest occurrences of one, rows reported a language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Lengths that are sketched together; the later ones without what the earlier rule out.
PASSES = ((1, 2), (3, 4))
#: Rows of the sketch; bytes of text a cell; bounds of the width as powers of two (bits to all tasks: 8 x width at most).
ROWS, BYTES_A_CELL, NARROWEST, WIDEST = 2, 128, 16, 27
#: A row of a sketch is sent in so many slabs.
SLABS = 256
_CHUNK, _PART = 2 << 20, 2 << 20
#: Different phrases that a task holds at most before it sends half as many or more; how lists of them are packed.
HELD = 1 << 21
_ZSTD = pa.Codec("zstd", compression_level=6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: of a word, 1: ends a word, 2: ends a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*range(10, 14), *b".,;:!?"]] = 2


class Grams:
    """Words and n-grams of some texts, exact within them: equal numbers mean equal words of one language."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, lang_hashes: np.ndarray) -> None:
        raw, ends = W.bytes_of(texts)
        raw = _LOWER[raw]
        kind = _KIND[raw]
        inner = kind == 0
        border = np.zeros(len(raw) + 1, bool)
        border[ends] = True
        starts = np.flatnonzero(inner & (border[:-1] | np.concatenate(([True], ~inner[:-1]))))
        stops = np.flatnonzero(inner & (border[1:] | np.concatenate((~inner[1:], [True])))) + 1
        owner = np.searchsorted(ends, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
        offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inner])]).dictionary_encode()
        self.words = words.dictionary
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = langs[owner]
        #: Whether the next word goes on in the same piece.
        self.on = np.zeros(len(starts), bool)
        self.on[:-1] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
        self._of_word = W.words(self.words)[0] if len(self.words) else np.zeros(0, U)
        self._of_lang = lang_hashes

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, where such n-grams begin, their hashes), by length."""
        word = self._of_word[self.word]
        at, hashes = np.arange(len(word)), W.mix(word ^ self._of_lang[self.lang])
        for k in range(1, LONGEST + 1):
            yield k, at, hashes
            go = self.on[at + k - 1]
            at = at[go]
            hashes = W.mix(hashes[go] * U(0x9E3779B97F4A7C15) + word[at + k])

    def counted(self, k: int, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first place of each different n-gram, counts, number of each n-gram in `at`) for n-grams of k words that begin
        at `at`; ids are the numbers of their first k - 1 words, or languages."""
        _, first, number, counts = np.unique((ids << 32) | self.word[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
        return at[first], counts, number

    def phrases(self, k: int, at: np.ndarray) -> pa.Array:
        columns = [self.words.take(pa.array(self.word[at + j])) for j in range(k)]
        return columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Grams, list[str]]]:
    """Of batches (lang, text): texts of about 2 MB at a time, and the languages that langs number."""
    for batch in batches:
        langs = batch.column(0).fill_null("und").dictionary_encode()
        names = langs.dictionary.to_pylist()
        number = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.array([W.word_hash("lang:" + x) for x in names], U)
        at = 0
        for texts in W.chunks(batch.column(1), _CHUNK):
            yield Grams(texts, number[at : at + len(texts)], hashes), names
            at += len(texts)


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((hashes + U(row) * ((hashes >> U(32)) | U(1))) & U(width - 1)).astype(np.uint32)


#: Whether n-grams of so many words, by their hashes, may be frequent; only asked for lengths that were sketched.
May = Callable[[int, np.ndarray], np.ndarray]


def _open(found: Grams, lengths: Sequence[int], may: May) -> Iterator[tuple[int, np.ndarray]]:
    """(words, hashes) of the n-grams of these lengths all of whose n-grams of fewer words than these may be frequent."""
    live, known = np.ones(len(found.word) + 1, bool), 1
    for k, at, hashes in found.levels():
        ok = np.logical_and.reduce([live[at + j] for j in range(k - known + 1)]) if k > 1 else live[at]
        if k in lengths:
            yield k, hashes[ok]
        elif k < min(lengths):
            ok[ok] = may(k, hashes[ok])
            live, known = np.zeros(len(live), bool), k
            live[at[ok]] = True


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """(bytes a value, the values), as narrow as the largest allows."""
    width = 1 if values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return width, values.astype(f"<u{width}").tobytes()


def _sketched(texts: DataFrame, width: int, lengths: Sequence[int], may: May) -> DataFrame:
    """(level, row, slab, n, steps, counts, packed) of texts(lang, text): a sketch of n-grams of these lengths, but for those
    that contain a shorter one that is ruled out, for about 2 million words, by slabs. packed has n distances between a
    slab's filled cells, then n counts, in so many bytes each."""
    slab_cells = width // SLABS
    names = ["level", "row", "slab", "n", "steps", "counts", "packed"]

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (level, row), parts in held.items():
            cell, count = np.unique(np.concatenate(parts), return_counts=True)
            slab = cell // slab_cells
            cuts = np.flatnonzero(np.concatenate(([True], slab[1:] != slab[:-1], [True]))) if len(cell) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                (steps, first), (counts, then) = _packed(np.diff(cell[a:b] % slab_cells, prepend=0)), _packed(count[a:b])
                out.append((level, row, int(slab[a]), int(b - a), steps, counts, pa.compress(first + then, codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, [pa.int32()] * 6 + [pa.binary()], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for found, _ in grams(batches):
            for level, hashes in _open(found, lengths, may):
                for row in range(ROWS):
                    held.setdefault((level, row), []).append(cells(hashes, row, width))
            n += len(found.word)
            if n >= _PART:
                yield from flushed(held)
                held, n = {}, 0
        if n:
            yield from flushed(held)

    return texts.mapInArrow(run, "level int, row int, slab int, n int, steps int, counts int, packed binary")


def _merged(sketches: DataFrame, width: int, least: int) -> DataFrame:
    """(level, row, slab, bits): which cells of the summed sketches reach `least`. A slab's sketches come in a row."""
    slab_cells = width // SLABS

    def reached(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["level", "row", "slab", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(slab_cells, np.int64)
        for batch in batches:
            for *key, n, steps, counts, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now:
                        yield reached(now, total)
                    now, total = key, np.zeros(slab_cells, np.int64)
                raw = pa.decompress(packed, n * (steps + counts), "zstd", asbytes=True)
                where = np.cumsum(np.frombuffer(raw, f"<u{steps}", n), dtype=np.int64)
                total[where] += np.frombuffer(raw, f"<u{counts}", n, n * steps)
        if now:
            yield reached(now, total)

    return sketches.repartition("level", "row", "slab").sortWithinPartitions("level", "row", "slab").mapInArrow(run, "level int, row int, slab int, bits binary")


def _ruling(spark: SparkSession, bits: dict[tuple[int, int], np.ndarray], width: int) -> May:
    """Asks the bits, which are told to all tasks."""
    shared = spark.sparkContext.broadcast(dict(bits))

    def may(level: int, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for row in range(ROWS):
            cell = cells(hashes, row, width)
            ok &= (shared.value[level, row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return ok

    return may


def counted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, width: int | None = None) -> DataFrame:
    """(lang, k, phrase, a): how often each phrase of 1 to 4 words occurs in its language, if `least` times or more,
    and as k = 0 with an empty phrase, how many words the language has.

    Null texts are empty, a null language is `und`. Repeated rows count each. A text of any length is taken
    whole. No documents: no rows. Extra columns aren't read. width: cells of a sketch's row, a power of two from
    4096 on; by itself, a cell for each 128 bytes of text or fewer, 2**27 at most, so that at most 128 MB of bits go to all tasks.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if width is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = 1 << min(WIDEST, max(NARROWEST, (size // BYTES_A_CELL).bit_length()))
    bits: dict[tuple[int, int], np.ndarray] = {}
    may = _ruling(docs.sparkSession, bits, width)
    for lengths in PASSES:
        merged = _merged(_sketched(texts, width, lengths, may), width, least).toArrow()
        bits |= {(level, row): np.zeros(width // 8, np.uint8) for level in lengths for row in range(ROWS)}
        for level, row, slab, own in zip(*(c.to_pylist() for c in merged.columns), strict=True):
            at, own = slab * (width // SLABS // 8), np.frombuffer(own, np.uint8)
            bits[level, row][at : at + len(own)] = own
        may = _ruling(docs.sparkSession, bits, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for found, names in grams(batches):
            n, langs = len(found.word), pa.array(names, pa.string())
            numbers, totals = np.unique(found.lang, return_counts=True)
            out = [(0, langs.take(pa.array(numbers)), pa.array([b""] * len(numbers), pa.large_binary()), totals, np.zeros(len(numbers), U))]
            live, ids = np.ones(n + 1, bool), found.lang
            for k, at, hashes in found.levels():
                ok = may(k, hashes) & live[at] & live[np.minimum(at + (k > 1), n)]
                at, own = at[ok], np.zeros(n, U)
                own[at] = hashes[ok]
                live = np.zeros(n + 1, bool)
                live[at] = True
                first, counts, number = found.counted(k, at, ids[at])
                out.append((k, langs.take(pa.array(found.lang[first])), found.phrases(k, first).cast(pa.large_binary()), counts, own[first] >> U(58)))
                ids = np.zeros(n, np.int64)
                ids[at] = number
            held += [pa.table({"lang": lang, "k": np.full(len(a), k, np.int32), "bucket": bucket.astype(np.int32), "phrase": phrase, "a": a.astype(np.int64)}) for k, lang, phrase, a, bucket in out]
            if sum(len(x) for x in held) >= HELD:
                held = [_summed(held)]
                if len(held[0]) >= HELD // 2:
                    yield from _listed(held.pop())
        if held:
            yield from _listed(_summed(held))

    return _added(texts.mapInArrow(run, "lang string, k int, bucket int, n int, size int, packed binary"), least)


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by(["lang", "k", "bucket", "phrase"], use_threads=False).aggregate([("a", "sum")]).rename_columns({"a_sum": "a"})


def _listed(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    """(lang, k, bucket, n, size, packed) of counts: n phrases in order, a line each (none has a line's end), and their counts of 8
    bytes; size bytes when unpacked. Phrases that begin alike stand together, so that they take little room."""
    counts = counts.sort_by([(c, "ascending") for c in ("lang", "k", "bucket", "phrase")])
    keys = list(zip(*(counts.column(c).to_pylist() for c in ("lang", "k", "bucket")), strict=True))
    phrases, numbers, out, at = counts.column("phrase").to_pylist(), counts.column("a").to_numpy(), [], 0
    for to in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)] * bool(keys):
        # Bytes of one place together: nearly all are zero.
        raw = b"\n".join(phrases[at:to]) + np.ascontiguousarray(numbers[at:to].astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
        out.append((*keys[at], to - at, len(raw), _ZSTD.compress(raw, asbytes=True)))
        at = to
    for i in range(0, len(out), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), [pa.string(), *[pa.int32()] * 4, pa.binary()], strict=True)], ["lang", "k", "bucket", "n", "size", "packed"])


def _added(lists: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, a): the lists of all tasks added up; phrases of fewer than `least` occurrences are left out."""

    def whole(key: list, total: dict[bytes, int]) -> pa.RecordBatch:
        kept = [(p, a) for p, a in total.items() if a >= least or key[1] == 0]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(kept), pa.string()), pa.array([key[1]] * len(kept), pa.int32()), pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()), pa.array([a for _, a in kept], pa.int64())], ["lang", "k", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, {}
        for batch in batches:
            for *key, n, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now:
                        yield whole(now, total)
                    now, total = key, {}
                raw = pa.decompress(packed, size, "zstd", asbytes=True)
                counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, size - 8 * n).reshape(8, n).T).view("<u8").ravel()
                for phrase, a in zip(raw[: size - 8 * n].split(b"\n"), counts.tolist(), strict=True):
                    total[phrase] = total.get(phrase, 0) + a
        if now:
            yield whole(now, total)

    order = ("lang", "k", "bucket")
    return lists.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "lang string, k int, phrase string, a long")


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("w", start, size), " ")


def _decimal(x: str) -> Column:
    return F.col(x).cast("decimal(20,0)")


def ranked(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` candidates of each language by score, of a written table as counted() gives it.

    A candidate's score is its lowest over all cuts (ties: the shortest first part). One that lies in a longer
    candidate with 80 % of its occurrences is dropped, whether that one is or not. Products are decimals. Scores
    that tie are ordered by occurrences, then by the phrase's bytes. No candidates: no rows.
    """
    words = counts.where("k >= 2").withColumn("w", F.split("phrase", " ")).select("lang", "k", "w", "phrase", "a")
    within = words.where("k >= 3").select("lang", "k", "w", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n")).select("lang", "w", "a", "n", F.explode(F.expr("sequence(1, k - n + 1)")).alias("at"))
    longer = within.select("lang", _part(F.col("at"), F.col("n")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = words.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_decimal("longer") * 100 < _decimal("a") * 80))
    cuts = kept.select("lang", "phrase", "k", "w", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    parts = counts.where("k between 1 and 3")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part])
    scored = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.score", "s.a", "s.l", "s.r")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # First within slices of a language, so that no task sorts all of a language's candidates.
    sliced = best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("a").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, width: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases; see counted() and ranked()."""
    return ranked(settle(counted(docs, lang_col, text_col, least, width), "phrases"), top)

