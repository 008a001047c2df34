"""Packing token documents into fixed-length sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut at multiples of the sequence length; what is left of each is an item.
The plan is made from counts of items by length alone: lengths are placed longest first, each on the packs
with the least in them; where no pack has room but packs have gaps, items are cut to fill the gaps. Items
then find their places by their rank among items of their length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

LENGTH = 2048
END = 1
#: Tokens of the vocabulary that are told by their text.
SPECIAL = {"<|endoftext|>": 50256}
#: Gaps below this aren't filled by cutting an item, and no cut leaves less of one.
LEAST_CUT = 32
#: Part of the documents whose ranks are counted together.
_SLICE = 4096


def encoder(vocabulary: str | None = None):
    """text -> ids of the public byte-level BPE with 50,257 ids, its vocabulary as ranks: the ids that `tokenizers`
    gives with the JSON file of the same vocabulary and its defaults, in which SPECIAL in a text is an id of its
    own (a test holds them against each other), several times faster."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: made.encode(text, allowed_special="all") if any(x in text for x in SPECIAL) else made.encode_ordinary(text)


def plan(counts: dict[int, int], length: int = LENGTH, least_cut: int = LEAST_CUT) -> dict[int, list[tuple[int, int, list[tuple[int, int, int, int]]]]]:
    """Places for counts[l] items of each length l up to `length`: for each l ranges [a, b) of ranks that
    cover 0..counts[l], each with its pieces (start, length, sequence of rank a, offset); the item of rank
    a + j goes to sequence + j. Sequences are numbered from 0. Works on counts only, so that its time and
    result don't grow with the number of items.
    """
    packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # filled length -> [first sequence, how many)
    # waiting[l]: runs of items (own length, first rank, how many, start within the item, pieces so far)
    waiting: dict[int, list[tuple[int, int, int, int, list]]] = defaultdict(list)
    for size, n in counts.items():
        if n:
            waiting[size].append((size, 0, n, 0, []))
    done: dict[int, list[tuple[int, int, list]]] = defaultdict(list)
    n_sequences = 0
    for size in range(length, 0, -1):
        queue = waiting.pop(size, [])
        while queue:
            own, rank, n, start, pieces = queue.pop()
            roomy = [f for f in packs if packs[f] and f + size <= length]
            if roomy:
                filled = min(roomy)
                at, many = packs[filled].pop()
                take, piece = min(n, many), size
            else:
                gaps = [f for f in packs if packs[f] and length - f >= least_cut and size - (length - f) >= least_cut]
                if gaps:
                    filled = min(gaps)
                    at, many = packs[filled].pop()
                    take, piece = min(n, many), length - filled
                else:
                    filled, at, many, take, piece = 0, n_sequences, n, n, size
                    n_sequences += n
            if many > take:
                packs[filled].append((at + take, many - take))
            if n > take:
                queue.append((own, rank + take, n - take, start, pieces))
            if filled + piece < length:
                packs[filled + piece].append((at, take))
            now = [*pieces, (start, piece, at, filled, rank)]
            if piece == size:
                done[own].append((rank, rank + take, now))
            else:
                waiting[size - piece].append((own, rank, take, start + piece, now))
    # A piece's sequence was noted for the first rank of the run it was then in; a later split moves it on.
    return {size: sorted((a, b, [(s, k, at + a - first, off) for s, k, at, off, first in pieces]) for a, b, pieces in runs) for size, runs in done.items()}


def tokenised(docs: DataFrame, id_col: str, text_col: str, length: int, vocabulary: str | None, end: int) -> DataFrame:
    """(id, row, slice, tokens, ids): ids as little-endian 16-bit integers with the end id, tokens their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            at, size, ids, tokens = 0, 0, [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = encode(text or "")
                own.append(end)
                ids.append(np.array(own, "<u2").tobytes())
                tokens.append(len(own))
                size += len(ids[-1])
                if size > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), batch.column(1).slice(at, len(ids)), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())], ["id", "row", "tokens", "ids"])
                    at, size, ids, tokens = i + 1, 0, [], []

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, row long, tokens long, ids binary")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """A row for each piece: `id_col`, start, length, ids (little-endian 16-bit), doc_tokens, sequence_id, offset.

    Each id of a document, the end id included, lies in exactly one piece; the pieces of a sequence follow
    each other from offset 0 without a gap. Null and empty texts have the end id alone. Repeated rows are
    packed each. A null id is kept. Empty tables give no rows. Extra columns aren't read.
    """
    rows = settle(tokenised(docs, id_col, text_col, length, vocabulary, end), "tokens")
    # Ranks of items by (length, slice): counted within a slice, after the items of slices before it.
    n_slices = F.lit(max(64, -(-rows.count() // _SLICE)))
    items = rows.select("row", "tokens", (F.col("tokens") % length).cast("int").alias("size"), F.floor(F.col("tokens") / length).alias("whole"), F.pmod(F.xxhash64("row"), n_slices).alias("slice"))
    within = Window.partitionBy("slice").orderBy("size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.row_number().over(Window.partitionBy("slice", "size").orderBy("row")) - 1
    ranked = settle(items.withColumns({"before": before, "whole_before": F.coalesce(F.sum("whole").over(within), F.lit(0))}), "ranked")
    sums = ranked.groupBy("slice", "size").agg(F.count("*").alias("n"))
    base = sums.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("slice")) - F.col("n")).drop("n")
    counts = {r["size"]: r["n"] for r in sums.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    wholes = ranked.groupBy("slice").agg(F.sum("whole").alias("w"))
    # One row a slice of 4096 documents: the running sum goes over groups of slices and then within them.
    grouped = wholes.withColumn("g", F.floor(F.col("slice") / _SLICE))
    of_group = grouped.groupBy("g").agg(F.sum("w").alias("gw")).withColumn("g_base", F.sum("gw").over(Window.orderBy("g")) - F.col("gw")).drop("gw")
    whole_base = grouped.withColumn("in_g", F.sum("w").over(Window.partitionBy("g").orderBy("slice")) - F.col("w")).join(of_group, "g").select("slice", (F.col("in_g") + F.col("g_base")).alias("whole_base"))
    made = plan(counts, length)
    shared = docs.sparkSession.sparkContext.broadcast(made)
    placed = ranked.join(base, ["slice", "size"]).join(whole_base, "slice").select("row", "size", "whole", (F.col("before") + F.col("base")).alias("rank"), (F.col("whole_before") + F.col("whole_base")).alias("whole_rank"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {size: [a for a, _, _ in runs] for size, runs in shared.value.items()}
        # Sequences of whole pieces are the odd numbers, the others the even ones.
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size_out = 0
            for doc, tokens, ids, size, whole, rank, whole_rank in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                pieces = [(k * length, length, 2 * (whole_rank + k) + 1, 0) for k in range(whole)]
                if size:
                    a, _, own = shared.value[size][bisect_right(begins[size], rank) - 1]
                    pieces += [(whole * length + s, n, 2 * (at + rank - a), off) for s, n, at, off in own]
                for s, n, at, off in pieces:
                    for column, value in zip(out, (doc, s, n, ids[2 * s : 2 * (s + n)], tokens, at, off), strict=True):
                        column.append(value)
                size_out += len(ids)
                if size_out > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
                    out, size_out = [[] for _ in range(7)], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    joined = rows.join(placed, "row").select("id", "tokens", "ids", "size", "whole", "rank", "whole_rank")
    return joined.mapInArrow(cut, f"`{id_col}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, of the ids as little-endian 32-bit integers, in place of ids."""
    columns = [c for c in pieces.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sums, pa.int64())], [*columns, "ids_crc32"])

    return pieces.mapInArrow(run, ", ".join(f"`{c}` long" for c in columns) + ", ids_crc32 long")
