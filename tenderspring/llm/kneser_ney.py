"""Language identification by interpolated Kneser-Ney character models, one for each language.

Counts of character 4-grams come from all learning documents; discounts, continuation counts and backed-off
probabilities are joins and sums over the table of distinct n-grams. A model is stored as arrays of sorted
64-bit n-gram hashes with log probabilities beside them, found by binary search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_out, scratch, settle
from .wordhash import chunks, mix

U = np.uint64
ORDER = 4
#: Symbols of a text that are scored together: each window counts with the language that tells it best.
WINDOW = 64
#: One in so many learning texts, by the hash of its id, is left out of a second model, under which the rejection
#: limits come from all such texts.
TRIAL = 8
#: A language's limits also count so many texts of a deviation of 0.2, for languages with few texts.
PRIOR = 4
#: Entries of a model (n-grams and contexts of all languages, 12 bytes each) that are sent to all tasks; a larger
#: model stays a table and is joined.
MOST_BROADCAST = 16_000_000
#: Cells of a table that numbers values (5 bytes each, in every Python worker); beyond it they are sorted.
MOST_CELLS = 1 << 22
#: Bytes of text that a Python worker takes apart at once.
CHUNK = 1 << 18
#: Texts that go to a Python worker at once where a step writes its own table.
BATCH = 1024
_LOW = (1 << 21) - 1


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of the texts as code points, any run of other characters as one 0; each text begins
    with ORDER - 1 zeros and ends with one. Returns (symbols, where texts begin and the last ends, letters of each)."""
    whole = [x.lower() for x in texts.to_pylist()]
    raw = np.frombuffer("".join(f"\0\0\0{x}\0" for x in whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    used = np.flatnonzero(np.bincount(raw, minlength=1))
    letter = np.zeros(int(raw.max()) + 1, bool)
    letter[[c for c in used if chr(c).isalpha()]] = True
    is_letter = letter[raw]
    begins = np.concatenate(([0], np.cumsum([len(x) + ORDER for x in whole])))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    for k in range(ORDER - 1):
        keep[begins[:-1] + k] = True
    after_pad = begins[:-1] + ORDER - 1
    keep[after_pad] = is_letter[after_pad]
    place = np.concatenate(([0], np.cumsum(keep)))
    return np.where(is_letter, raw, 0)[keep], place[begins], np.diff(np.concatenate(([0], np.cumsum(is_letter)))[begins])


def _numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and which one each is, of values from 0 to bound - 1."""
    if bound > MOST_CELLS:
        return np.unique(values, return_inverse=True)
    there = np.zeros(bound, bool)
    there[values] = True
    once = np.flatnonzero(there)
    number = np.zeros(bound, np.int32)
    number[once] = np.arange(len(once))
    return once, number[values].astype(np.int64)


def _grams(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every 4-gram: (two characters, two characters) packed, once each; which one each position has; where texts begin.

    Pairs of symbols are numbered first, then pairs of pairs: few pairs occur, so the tables stay small."""
    alphabet, code = _numbered(symbols, int(symbols.max(initial=0)) + 1)
    k = len(alphabet)
    twos, two = _numbered(code[:-1] * k + code[1:], k * k)
    m = len(twos)
    inside = np.ones(len(code), bool)
    for i in range(ORDER - 1):
        inside[begins[:-1] + i] = False
    once, which = _numbered((two[:-2] * m + two[2:])[inside[ORDER - 1 :]], m * m)
    packed = alphabet[twos // k] << 21 | alphabet[twos % k]
    at = begins - (ORDER - 1) * np.arange(len(begins))
    return packed[once // m], packed[once % m], which, at


def _counted(docs: DataFrame, text_col: str, lang_col: str, trial: Column) -> DataFrame:
    """(lang, trial, hi, lo, n): how often each 4-gram occurs in each language's texts, those of `trial` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], list[tuple[np.ndarray, ...]]] = {}

        def merge(lang: tuple[str, bool]) -> None:
            hi, lo, n = (np.concatenate(x) for x in zip(*sums[lang], strict=True))
            order = np.lexsort((lo, hi))
            hi, lo, n = hi[order], lo[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
            sums[lang] = [(hi[first], lo[first], np.add.reduceat(n, first))]

        def given() -> Iterator[pa.RecordBatch]:
            for lang in sums:
                merge(lang)
                hi, lo, n = sums[lang][0]
                yield pa.RecordBatch.from_arrays([pa.array([lang[0]] * len(hi), pa.string()), pa.array([lang[1]] * len(hi)), pa.array(hi), pa.array(lo), pa.array(n)], ["lang", "trial", "hi", "lo", "n"])
            sums.clear()

        for batch in batches:
            at = 0
            for part in chunks(batch.column(0), CHUNK):
                symbols, begins, _ = _symbols(part)
                hi, lo, which, where = _grams(symbols, begins)
                langs = np.empty(len(part), object)
                langs[:] = list(zip(*(batch.column(k).slice(at, len(part)).to_pylist() for k in (1, 2)), strict=True))
                at += len(part)
                owner = np.repeat(np.arange(len(part)), np.diff(where))
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])
                    n = np.bincount(which[own[owner]], minlength=len(hi))
                    seen = np.flatnonzero(n)
                    if len(seen):
                        sums.setdefault(lang, []).append((hi[seen], lo[seen], n[seen].astype(np.int64)))
                        if len(sums[lang]) >= 32:
                            merge(lang)
            if sum(len(x[0]) for parts in sums.values() for x in parts) > 4_000_000:
                yield from given()
        yield from given()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(trial, F.lit(False)).alias("trial"))
    return rows.mapInArrow(run, "lang string, trial boolean, hi long, lo long, n long").groupBy("lang", "trial", "hi", "lo").agg(F.sum("n").alias("n"))


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), U)
    for p in parts:
        out = mix(out * U(0x9E3779B97F4A7C15) + p.astype(U))
    return out


def _hashed(rows: DataFrame, k: int, gram: bool, names: list[str], p: Column) -> DataFrame:
    """(lang, k, gram, hash, p) of rows whose symbols are the columns `names`; 0 is the hash of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = batch.num_rows, [batch.column(2 + i).to_numpy() for i in range(len(names))]
            hashes = (_hash(*parts) if parts else np.zeros(n, U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, gram)), pa.array(hashes), batch.column(1)], ["lang", "k", "gram", "hash", "p"])

    return rows.select("lang", p.cast("float").alias("p"), *(F.col(c).cast("long") for c in names)).mapInArrow(run, "lang string, k int, gram boolean, hash long, p float")


@dataclass(frozen=True)
class Model:
    """langs in code point order, the symbols of each, and the table (lang, k, gram, hash, p): discounted
    probabilities of k-grams (gram) and back-off weights of contexts, by the hash of their symbols."""

    langs: list[str]
    symbols: list[int]
    entries: DataFrame
    n_entries: int


@dataclass(frozen=True)
class Arrays:
    """A model in memory. For each language and order k: sorted hashes of k-grams and their discounted
    probabilities; sorted hashes of contexts and their back-off weights."""

    langs: list[str]
    grams: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    contexts: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    symbols: list[int]

    def log_probabilities(self, hi: np.ndarray, lo: np.ndarray, lang: int) -> np.ndarray:
        """Natural log of P(last character | the three before it), interpolated over all orders."""
        c = [hi >> 21, hi & _LOW, lo >> 21, lo & _LOW]
        p = np.full(len(hi), 1.0 / (self.symbols[lang] + 1))
        for k in range(1, ORDER + 1):
            back = _find(self.contexts[lang][k], _hash(*c[ORDER - k : ORDER - 1]) if k > 1 else np.zeros(len(hi), U), 1.0)
            p = _find(self.grams[lang][k], _hash(*c[ORDER - k :]), 0.0) + back * p
        return np.log(p)


def _find(sorted_array: tuple[np.ndarray, np.ndarray], keys: np.ndarray, otherwise: float) -> np.ndarray:
    at, values = sorted_array
    if not len(at):
        return np.full(len(keys), otherwise)
    place = np.minimum(np.searchsorted(at, keys), len(at) - 1)
    return np.where(at[place] == keys, values[place], otherwise)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages of docs; rows with null language or text are not used. Every n-gram seen is
    kept, in a table that grows with the corpus; nothing of it comes to the driver but the languages."""
    with scratch():
        return _model(settle(_counted(docs, text_col, lang_col, F.lit(False)), "grams", BATCH))


def _model(grams: DataFrame) -> Model:
    """The model of counts (lang, hi, lo, n); its table outlives the innermost scratch(). Each order is written
    before the next, so that no plan grows with the orders below it."""
    c1, c2 = F.shiftright("hi", 21), F.col("hi").bitwiseAND(F.lit(_LOW))
    c3, c4 = F.shiftright("lo", 21), F.col("lo").bitwiseAND(F.lit(_LOW))
    level = grams.select("lang", c1.alias("c1"), c2.alias("c2"), c3.alias("c3"), c4.alias("c4"), "n")
    parts: list[DataFrame] = []
    for k in range(ORDER, 0, -1):
        names = [f"c{i}" for i in range(ORDER - k + 1, ORDER + 1)]
        if k < ORDER:
            level = level.groupBy("lang", *names).agg(F.count("*").alias("n"))
        level = settle(level, f"order-{k}", outer=True)
        found = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        discount = F.greatest(F.lit(0.1), F.coalesce(F.try_divide(F.col("n1").cast("double"), F.col("n1") + 2.0 * F.col("n2")), F.lit(0.75)))
        whole = F.broadcast(settle(found.select("lang", discount.alias("d")), "discounts", outer=True))
        # Dealt out by its contexts once: counting contexts and joining them needs no other exchange.
        dealt = level.repartition("lang", *names[:-1])
        context = dealt.groupBy("lang", *names[:-1]).agg(F.sum("n").alias("sum"), F.count("*").alias("types"))
        each = dealt.join(context, ["lang", *names[:-1]]).join(whole, "lang")
        seen = _hashed(each, k, True, names, F.greatest(F.lit(0.0), F.col("n") - F.col("d")) / F.col("sum"))
        back = _hashed(context.join(whole, "lang"), k, False, names[:-1], F.least(F.lit(1.0), F.col("d") * F.col("types") / F.col("sum")))
        parts.append(settle(seen.union(back), "model", outer=True))
    entries = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    found = sorted((r["lang"], r["symbols"], r["n"]) for r in entries.groupBy("lang").agg(F.count_if(F.col("gram") & (F.col("k") == 1)).alias("symbols"), F.count("*").alias("n")).collect())
    return Model([f[0] for f in found], [f[1] for f in found], entries, sum(f[2] for f in found))


def in_memory(model: Model) -> Arrays:
    """The model's sorted arrays; 12 bytes for each of its n_entries come to the driver."""
    got, out = model.entries.toArrow(), Arrays(model.langs, [], [], model.symbols)
    for lang in model.langs:
        own = got.filter(pc.equal(got["lang"], lang))
        pair: tuple[dict, dict] = ({}, {})
        for k in range(1, ORDER + 1):
            for gram, to in ((True, pair[0]), (False, pair[1])):
                part = own.filter(pc.and_(pc.equal(own["k"], k), pc.equal(own["gram"], gram)))
                hashes = part["hash"].to_numpy().view(U)
                order = np.argsort(hashes)
                to[k] = hashes[order], part["p"].to_numpy()[order]
        out.grams.append(pair[0])
        out.contexts.append(pair[1])
    return out


def entropies(docs: DataFrame, model: Model, text_col: str, carry: list[Column], most_broadcast: int = MOST_BROADCAST, within: tuple[int, ...] = ()) -> DataFrame:
    """The carried columns with n_letters, `nats` (for each language of the model the cross-entropy a symbol of
    the text) and `mixed` (the same with the best language of each WINDOW symbols). within: where the text lies
    in the carried columns, by number, if it is one of them or in a struct; it then goes to the tasks once.

    A model of most_broadcast entries at most is sent to the tasks; a larger one is joined with the texts'
    n-grams, with the same result but for the last digits.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*carry).alias("row"))
    if model.n_entries > most_broadcast:
        return _scored_by_joins(rows, model)
    return _scored_in_memory(rows.select("row") if within else rows, model, within)


def _windows(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and the first window of each text and the end, of texts that begin at `where`."""
    many = -(-np.diff(where) // WINDOW)
    first = np.concatenate(([0], np.cumsum(many)))
    owner = np.repeat(np.arange(len(many)), many)
    return where[:-1][owner] + WINDOW * (np.arange(first[-1]) - first[owner]), first


def _scored_in_memory(rows: DataFrame, model: Model, within: tuple[int, ...] = ()) -> DataFrame:
    """rows: text and row, or row alone where the text lies within it."""
    shared = rows.sparkSession.sparkContext.broadcast(in_memory(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at, row = 0, batch.column("row")
            text = row if within else batch.column("text")
            for k in within:
                text = text.field(k)
            for part in chunks(text, CHUNK):
                symbols, begins, letters = _symbols(part)
                hi, lo, which, where = _grams(symbols, begins)
                begin, first = _windows(where)
                some, size = np.diff(where) > 0, np.diff(where)
                sums = np.zeros((len(begin), len(m.langs)))
                for j in range(len(m.langs) if len(begin) else 0):
                    sums[:, j] = -np.add.reduceat(m.log_probabilities(hi, lo, j)[which], begin)
                nats, mixed = np.zeros((len(part), len(m.langs))), np.zeros(len(part))
                if some.any() and m.langs:
                    nats[some] = np.add.reduceat(sums, first[:-1][some]) / size[some, None]
                    mixed[some] = np.add.reduceat(sums.min(axis=1), first[:-1][some]) / size[some]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(m.langs), pa.int32()), pa.array(nats.ravel()))
                yield pa.RecordBatch.from_arrays([row.slice(at, len(part)), pa.array(letters.astype(np.int64)), lists, pa.array(mixed)], ["row", "n_letters", "nats", "mixed"])
                at += len(part)

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_letters long, nats array<double>, mixed double").select("row.*", "n_letters", "nats", "mixed")


def _scored_by_joins(rows: DataFrame, model: Model) -> DataFrame:
    """n-grams of each distinct text, counted by window, meet the table of the log probabilities of all n-grams
    that occur; the texts themselves are only read."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column(0), CHUNK):
                symbols, begins, letters = _symbols(part)
                hi, lo, which, where = _grams(symbols, begins)
                begin, first = _windows(where)
                window = np.searchsorted(begin, np.arange(len(which)), "right") - 1
                cell, n = np.unique(window * max(1, len(hi)) + which, return_counts=True)
                w, g = np.divmod(cell, max(1, len(hi)))
                owner = np.searchsorted(first, w, "right") - 1
                same = batch.column(1).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([same.take(pa.array(owner)), pa.array(letters[owner].astype(np.int64)), pa.array(w - first[owner]), pa.array(hi[g]), pa.array(lo[g]), pa.array(n)], ["same", "n_letters", "w", "hi", "lo", "n"])
                at += len(part)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            c = [hi >> 21, hi & _LOW, lo >> 21, lo & _LOW]
            both = [_hash(*c[ORDER - k :]) for k in range(1, ORDER + 1)] + [_hash(*c[ORDER - k : ORDER - 1]) if k > 1 else np.zeros(len(hi), U) for k in range(1, ORDER + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x.view(np.int64)) for x in both)], ["hi", "lo", *names])

    names = [f"g{k}" for k in range(1, ORDER + 1)] + [f"c{k}" for k in range(1, ORDER + 1)]
    symbols = rows.sparkSession.createDataFrame(list(zip(model.langs, model.symbols, strict=True)), "lang string, symbols long")
    with scratch():
        texts = rows.select("text", F.sha2("text", 256).alias("same")).where("text is not null").dropDuplicates(["same"])
        found = settle(texts.mapInArrow(counted, "same string, n_letters long, w long, hi long, lo long, n long"), "text-grams")
        probable = found.select("hi", "lo").distinct().mapInArrow(hashes, "hi long, lo long, " + ", ".join(f"{n} long" for n in names)).join(F.broadcast(symbols))
        p = 1.0 / (F.col("symbols") + 1)
        for k in range(1, ORDER + 1):
            for gram, name in ((False, f"c{k}"), (True, f"g{k}")):
                own = model.entries.where((F.col("k") == k) & (F.col("gram") == gram)).select("lang", F.col("hash").alias(name), F.col("p").cast("double").alias(f"p_{name}"))
                probable = probable.join(own, ["lang", name], "left")
            p = F.coalesce(f"p_g{k}", F.lit(0.0)) + F.coalesce(f"p_c{k}", F.lit(1.0)) * p
        each = settle(probable.select("hi", "lo", "lang", (-F.log(p)).alias("nats")), "log-probabilities")
        # One row for each n-gram, with as many values as there are languages.
        by_gram = each.groupBy("hi", "lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "nats"))), lambda x: x["nats"]).alias("nats"))
        sums = [F.sum(F.col("n") * F.col("nats")[j]).alias(f"s{j}") for j in range(len(model.langs))]
        windows = found.join(by_gram, ["hi", "lo"]).groupBy("same", "n_letters", "w").agg(F.sum("n").alias("n"), *sums)
        least = F.array_min(F.array(*(F.col(f"s{j}") for j in range(len(model.langs)))))
        told = windows.groupBy("same", "n_letters").agg(F.array(*(F.sum(f"s{j}") / F.sum("n") for j in range(len(model.langs)))).alias("nats"), (F.sum(least) / F.sum("n")).alias("mixed"))
        told = settle(told, "told", outer=True)
    zeros = F.array(*[F.lit(0.0)] * len(model.langs))
    joined = rows.select("row", F.sha2("text", 256).alias("same")).join(told, "same", "left")
    return joined.select("row.*", F.coalesce("n_letters", F.lit(0)).alias("n_letters"), F.coalesce("nats", zeros).alias("nats"), F.coalesce("mixed", F.lit(0.0)).alias("mixed"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, spread: float = 6.0, result: str = "found", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Each row of docs with the columns in `carry` (the id by default) and a struct named `result`: lang_pred, score,
    rejected, n_letters.

    Learns from rows that held_out() doesn't name and that have a language and a text. lang_pred has the
    lowest cross-entropy a symbol (ties: the first by code point), `und` for a null text or one without a
    letter, or if nothing was learned. score: the softmax of minus the cross-entropies of the whole text,
    tempered to at most 64 symbols; 0 for und. rejected: und, or a text whose cross-entropy, with the best
    language of each window of it, lies above the limit that calibrated() finds for lang_pred. So texts in several of the
    languages stay. Empty tables give no rows; extra columns don't matter. Very long texts count whole.
    """
    carry = carry or [id_col]
    learnt = ~held_out(F.col(f"`{id_col}`")) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()
    trial = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(TRIAL)) == 0
    with scratch():
        grams = settle(_counted(docs.where(learnt), text_col, lang_col, trial), "grams", BATCH)
        model = _model(grams.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
        with scratch():
            without = _model(grams.where("not trial"))
        limits = calibrated(docs.where(learnt & trial), without, id_col, text_col, lang_col, spread, most_broadcast)
    row = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    scored = entropies(docs, model, text_col, [row], most_broadcast, (0, carry.index(text_col)) if text_col in carry else ())
    names = F.array(*map(F.lit, model.langs)).cast("array<string>")
    some = (F.col("n_letters") > 0) & F.lit(bool(model.langs))
    best = scored.withColumns({"pred": F.when(some, F.get(names, F.array_position("nats", F.array_min("nats")).cast("int") - 1)), "low": F.when(some, F.array_min("nats"))})
    limit = F.lit(math.inf)
    for lang, (mean, long, short) in limits.items():
        limit = F.when(F.col("pred") == lang, mean + spread * F.sqrt(long + short / F.col("n_letters"))).otherwise(limit)
    weight = F.least(F.col("n_letters"), F.lit(64)).cast("double")
    score = 1.0 / F.aggregate("nats", F.lit(0.0), lambda a, x: a + F.exp((F.col("low") - x) * weight))
    found = F.struct(
        F.coalesce("pred", F.lit("und")).alias("lang_pred"), F.when(F.col("pred").isNotNull(), score).otherwise(0.0).alias("score"),
        F.coalesce(F.when(F.col("pred").isNotNull(), F.col("mixed") > limit), F.lit(True)).alias("rejected"), F.col("n_letters").alias("n_letters"),
    )
    return best.select(*(F.col("row")[c].alias(c) for c in carry), found.alias(result))


def calibrated(held: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str, spread: float, most_broadcast: int = MOST_BROADCAST) -> dict[str, tuple[float, float, float]]:
    """For each language (mean, long, short) of the cross-entropy with the best language of each window: texts of
    n letters deviate from the mean by the variance long + short / n, by least squares over texts `held` out of
    the model that it tells right, and 1 / n at least. Texts more than `spread` deviations above are left out of
    a second fit, as mislabelled or garbled ones would widen the limit. A language of which none is held has no limit."""
    if not model.langs:
        return {}
    with scratch():
        rows = settle(entropies(held, model, text_col, [F.col(f"`{lang_col}`").alias("lang")], most_broadcast), "calibration", BATCH).where("n_letters > 0")
        names = F.array(*map(F.lit, model.langs)).cast("array<string>")
        told = rows.where(F.get(names, F.array_position("nats", F.array_min("nats")).cast("int") - 1) == F.col("lang")).select("lang", (1.0 / F.col("n_letters")).alias("x"), F.col("mixed").alias("y"))
        out: dict[str, tuple[float, float, float]] = {}
        for _ in range(2):
            kept = told
            for lang, (mean, long, short) in out.items():
                kept = kept.where(~((F.col("lang") == lang) & (F.col("y") > mean + spread * F.sqrt(long + short * F.col("x")))))
            means = {r["lang"]: r["m"] for r in kept.groupBy("lang").agg(F.avg("y").alias("m")).collect()}
            mean = F.lit(0.0)
            for lang, m in means.items():
                mean = F.when(F.col("lang") == lang, m).otherwise(mean)
            square = kept.withColumn("z", (F.col("y") - mean) ** 2)
            sums = square.groupBy("lang").agg(F.count("*").alias("k"), F.avg("z").alias("z"), F.avg("x").alias("x"), F.covar_pop("x", "z").alias("xz"), F.var_pop("x").alias("xx")).collect()
            out = {}
            for r in sums:
                short = max(1.0, r["xz"] / r["xx"] if r["xx"] else 0.0)
                out[r["lang"]] = means[r["lang"]], (r["k"] * max(1e-4, r["z"] - short * r["x"]) + PRIOR * 0.04) / (r["k"] + PRIOR), short
        return out
