"""Word hashes of many texts at once, with numpy on Arrow's string buffers.

A word is a maximal run of bytes that are not separators. Its hash is a sum of byte values times powers of
an odd number, modulo 2**64, and so comes from two prefix sums; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also ends words where punctuation doesn't count: all ASCII but letters and digits.
_PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 finaliser); returns a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers[inverse]
    if len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _INV if inverse else _BASE, U)
        steps[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(steps)
    return have


def chunks(texts: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20, most_texts: int = 1 << 30) -> Iterator[pa.Array]:
    """The texts in pieces of about most_bytes and at most most_texts, one text at least; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = min(at + most_texts, max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1))
        yield texts.slice(at, to - at)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array, and where each text begins and the last ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def words(texts: pa.Array, punctuation_ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end, starts and ends in bytes)."""
    raw, ends = bytes_of(texts)
    n = len(raw)
    gap = (_PUNCT if punctuation_ends else _SPACE)[raw]
    first = np.zeros(n, bool)
    first[ends[:-1][ends[:-1] < n]] = True
    starts = np.flatnonzero(~gap & (np.concatenate(([True], gap[:-1])) | first)) if n else np.zeros(0, np.int64)
    last = np.zeros(n, bool)
    last[ends[1:][ends[1:] > 0] - 1] = True
    stops = np.flatnonzero(~gap & (np.concatenate((gap[1:], [True])) | last)) + 1 if n else np.zeros(0, np.int64)
    total = np.zeros(n + 1, U)
    np.cumsum(_VALUE[raw] * _power(n + 1, False)[:n], out=total[1:])
    hashes = mix((total[stops] - total[starts]) * _power(n + 1, True)[starts] + (stops - starts).astype(U))
    return hashes, np.searchsorted(starts, ends), starts, stops


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    return int(words(pa.array([word], pa.large_string()))[0][0])


def shingles(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text and where each text's runs begin; a text with fewer
    words, one at least, has one run of all its words."""
    counts = np.diff(begins)
    n_runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n_runs)))
    owner = np.repeat(np.arange(len(counts)), n_runs)
    pos = np.arange(at[-1]) - at[owner] + begins[owner]
    length = np.minimum(counts[owner], size)
    out = length.astype(U)
    padded = np.concatenate((hashes, np.zeros(size, U)))
    for k in range(size):
        word = np.where(k < length, padded[pos + k], U(0))
        out = mix(out * U(0x9E3779B97F4A7C15) + word + U(k))
    return out, at
