"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of term weights; terms are words (hashed, so that the dimension is fixed), bytes, hashed
byte trigrams and repetitions. The latent space comes from the eigenvectors of the corpus's tf-idf Gram matrix,
which tasks add up over all texts. A bounded sample of labelled vectors is broadcast, and every text is
compared with all of it, in blocks of exact cosine products.

Term weights are multiples of 1/64 and latent coordinates of 1/2048: sums of their products are then exact in
floating point, in whatever order tasks and matrix products add them up, and a run gives what another gave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as W
from .shared import held_out, settle

U = np.uint64
TRIGRAMS = 124
#: Words equal to the word before, words seen before in the text, lines seen before, and words in runs of five seen before.
REPEATS = 4
#: Buckets of hashed words.
WORDS = 640
TERMS = 256 + TRIGRAMS + REPEATS + WORDS
#: Texts whose weights are held at once, however short they are: 8 MB.
ROWS = 1024
#: Latent dimensions; neighbours that vote; labelled rows of each class at most, those with the smallest hash of the id.
LATENT, NEIGHBOURS, SAMPLE = 48, 15, 2048


def _seen_before(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners, how many of its values are equal to another one before."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    return np.bincount(o[1:][(v[1:] == v[:-1]) & (o[1:] == o[:-1])], minlength=n)


def term_weights(texts: pa.Array) -> np.ndarray:
    """A row of log term frequencies, per 1000 bytes, for each text; zeros for one without a word."""
    raw, ends = W.bytes_of(texts)
    n = len(texts)
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, TERMS))
    out[:, :256] = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        three = ((wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77)) + wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
        inside = owner[:-2] == owner[2:]
        out[:, 256 : 256 + TRIGRAMS] = np.bincount(owner[:-2][inside] * TRIGRAMS + (three % TRIGRAMS)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    hashes, begins, _, _ = W.words(texts)
    word_owner = np.repeat(np.arange(n), np.diff(begins))
    runs, at = W.shingles(hashes, begins, 5)
    lines, line_begins, _, _ = _lines(raw, ends)
    same = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    at_repeats = 256 + TRIGRAMS
    out[:, at_repeats] = np.bincount(word_owner[1:][same], minlength=n)
    out[:, at_repeats + 1] = _seen_before(hashes, word_owner, n)
    out[:, at_repeats + 2] = 10 * _seen_before(lines, np.repeat(np.arange(n), np.diff(line_begins)), n)
    out[:, at_repeats + 3] = _seen_before(runs, np.repeat(np.arange(n), np.diff(at)), n)
    out[:, -WORDS:] = np.bincount(word_owner * WORDS + (hashes % U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[np.diff(begins) == 0] = 0
    return np.rint(64 * np.log1p(1000 * out / np.maximum(sizes, 200)[:, None])) / 64


def _lines(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lines of each text that aren't empty."""
    n = len(raw)
    value = W._VALUE[raw]
    total = np.zeros(n + 1, U)
    np.cumsum(value * W._power(n + 1, False)[:n], out=total[1:])
    gap = raw == 10
    cut = np.unique(np.concatenate((ends, np.flatnonzero(gap), np.flatnonzero(gap) + 1)))
    starts, stops = cut[:-1], cut[1:]
    keep = (stops > starts) & ~gap[np.minimum(starts, max(n - 1, 0))] if n else np.zeros(len(starts), bool)
    starts, stops = starts[keep], stops[keep]
    return W.mix((total[stops] - total[starts]) * W._power(n + 1, True)[starts]), np.searchsorted(starts, ends), starts, stops


@dataclass(frozen=True)
class Space:
    idf: np.ndarray
    axes: np.ndarray

    def latent(self, weights: np.ndarray) -> np.ndarray:
        """Unit vectors, rounded to 1/2048; a row of zeros stays zero. Each coordinate is a sum of its own, in one order."""
        z = np.einsum("ij,jk->ik", weights * self.idf, self.axes)
        return (np.rint(2048 * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)) / 2048).astype(np.float32)


def fit_space(docs: DataFrame, text_col: str = "text", latent: int = LATENT) -> Space:
    """The latent space of all texts of docs. Tasks add up Gram matrices, then a tree of tasks does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, df, n = np.zeros((TERMS, TERMS)), np.zeros(TERMS), 0
        for batch in batches:
            for part in W.chunks(batch.column(0), most_texts=ROWS):
                x = term_weights(part)
                gram += x.T @ x
                df += (x > 0).sum(axis=0)
                n += len(part)
        yield _blob(gram, df, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS * TERMS + TERMS + 1)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "sums binary")
    many = sums.rdd.getNumPartitions()
    while many > 4:
        many = -(-many // 16)
        sums = sums.repartition(many).mapInArrow(add, "sums binary")
    total = sum((np.frombuffer(r[0]) for r in sums.collect()), np.zeros(TERMS * TERMS + TERMS + 1))
    gram, df, n = total[: TERMS * TERMS].reshape(TERMS, TERMS), total[TERMS * TERMS : -1], total[-1]
    idf = np.log((1 + n) / (1 + df)) + 1
    _, vectors = np.linalg.eigh(gram * idf[:, None] * idf[None, :])
    axes = vectors[:, ::-1][:, :latent]
    return Space(idf, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1))


def _blob(gram: np.ndarray, df: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate((gram.ravel(), df, [n])).tobytes()], pa.binary())], ["sums"])


def _vectors(rows: DataFrame, space: Space) -> DataFrame:
    """(y, vector) of rows(y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(1), most_texts=ROWS):
                z = space.latent(term_weights(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([v.tobytes() for v in z], pa.binary())], ["y", "vector"])
                at += len(part)

    return rows.mapInArrow(run, "y int, vector binary")


def vote(latent: np.ndarray, labelled: np.ndarray, y: np.ndarray, weight: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of unit vectors: the share of label 1 among the nearest labelled vectors, weighted by similarity
    and by how many rows a labelled row stands for; of equally near ones the first in order. 0 for zero vectors,
    and where nothing is similar."""
    out = np.zeros(len(latent))
    k = min(neighbours, len(labelled))
    for a in range(0, len(latent) if k else 0, 256):
        similar = latent[a : a + 256] @ labelled.T
        least = np.partition(similar, len(labelled) - k, axis=1)[:, len(labelled) - k, None]
        above, tied = similar > least, similar == least
        taken = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))
        near = np.nonzero(taken)[1].reshape(-1, k)
        votes = np.maximum(np.take_along_axis(similar, near, axis=1), 0).astype(float) * weight[near]
        whole = votes.sum(axis=1)
        out[a : a + 256] = np.divide((votes * y[near]).sum(axis=1), whole, out=np.zeros(len(whole)), where=whole > 0)
    return np.round(out, 6)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score) for each row of docs.

    The space comes from all texts; voters are, of labelled ids that held_out() doesn't name, the `sample`
    of each class with the smallest hashes of their ids. Null and empty texts, and those without a word:
    score 0. Rows that repeat are scored alike. Of labelled texts that are equally near, the first by vector (then
    label) vote. Without labels all scores are 0. Texts of any length count whole. No rows: none. Extra columns
    aren't read.
    """
    spark: SparkSession = docs.sparkSession
    marked = labels.where(~held_out(F.col(id_col)) & F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    order = (F.xxhash64("id"), F.col("id"))
    chosen = marked.where("y = 0").orderBy(*order).limit(sample).union(marked.where("y = 1").orderBy(*order).limit(sample))
    space = fit_space(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most 2 * sample ids are broadcast, and as many vectors collected.
    got = _vectors(rows.join(F.broadcast(settle(chosen, "voters")), "id").select("y", "text"), space).collect()
    y = np.array([r["y"] for r in got], float)
    z = np.array([np.frombuffer(r["vector"], np.float32) for r in got], np.float32).reshape(len(got), LATENT)
    order_of = np.lexsort((y, *z.T)) if len(got) else []
    y, z = y[order_of], z[order_of]
    weight = np.array([counts[int(v)] / max(1, (y == v).sum()) for v in y])
    shared = spark.sparkContext.broadcast((space, z, y, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, *voters = shared.value
        for batch in batches:
            at = 0
            for part in W.chunks(batch.column(1), most_texts=ROWS):
                score = vote(own.latent(term_weights(part)), *voters)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(score)], ["id", "score"])
                at += len(part)

    return rows.mapInArrow(run, "id long, score double").select("id", held_out(F.col("id")).alias("held_out"), "score")
