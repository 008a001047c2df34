"""Quality rules as a learned decision list, all in DataFrame functions.

Sequential covering: a rule is grown, one threshold at a time, to cover rejected labels and few others among
the rows that no earlier rule covers; it is then pruned on rows kept from growing, and joins the list while
it stays precise there. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, held_out, scratch, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Smallest number of words, and the largest share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Labelled rows that rules are learned from at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
FEATURES = ("n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "words_per_line")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(hashes: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more."""

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            twin = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(twin, lambda e: e["i"]))

        def length(p: Column) -> Column:
            each = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, k + 1) - x)).otherwise(F.lit(WINDOW)))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(F.coalesce(h, F.lit(0)).alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(pairs, lambda s: _let(places(s), length)))

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; null and empty texts have zeros.

    Words end at white space (x20, x09-x0D). A line counts as duplicate if it has a word and equals an
    earlier line. n_repeat_words counts the words that lie in a window of five words found twice or more.
    """
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        bare = F.translate(t, SPACES, "")
        hashes = F.transform(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
        lines = F.filter(F.split(t, "\n"), lambda line: F.translate(line, SPACES, "") != "")

        def word_part(h: Column) -> Column:
            return F.struct(F.size(h).cast("long").alias("n"), F.size(F.array_distinct(h)).cast("long").alias("distinct"), _repeated_words(h).alias("repeated"))

        def line_part(x: Column) -> Column:
            return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

        return F.struct(
            _let(hashes, word_part).alias("w"),
            _let(lines, line_part).alias("l"),
            _let(bare, lambda b: F.struct(F.length(b).cast("long").alias("chars"), (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias("symbols"), (F.length(b) - F.length(F.translate(b, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("upper"))).alias("c"),
        )

    def named(s: Column) -> Column:
        return F.struct(
            s["w"]["n"].alias("n_words"), s["c"]["chars"].alias("word_chars"), s["c"]["symbols"].alias("n_symbols"), s["l"]["dup"].alias("n_dup_lines"),
            s["w"]["repeated"].alias("n_repeat_words"), s["w"]["distinct"].alias("n_distinct"), s["l"]["n"].alias("n_lines"), s["c"]["upper"].alias("n_upper"),
        )

    return _let(text, lambda t: _let(of(t), named))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    n = s["n_words"]
    values = (n.cast("double"), share(s["word_chars"], n), share(s["n_symbols"], n), share(s["n_dup_lines"], s["n_lines"]), share(s["n_repeat_words"], n), share(s["n_distinct"], n), share(s["n_upper"], s["word_chars"]), share(n, s["n_lines"]))
    return dict(zip(FEATURES, values, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        v = values[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a row that meets one of them is rejected by the first that it meets."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self, s: Column) -> Column:
        """The 1-based number of the first rule that rejects, 0 if none does."""
        out, values = None, features(s)
        for k, conditions in enumerate(self.rules, 1):
            met = _all(conditions, values)
            out = (F if out is None else out).when(met, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules)


def _all(conditions: list[Condition], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.holds(values)
    return out


def _below(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))


def _gain(p: float, n: float, whole_p: float, whole_n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(whole_p / (whole_p + whole_n))) if p else 0.0


def fit(labelled: DataFrame, s: str, quality: str, grow: str, n_thresholds: int = 24, most_rules: int = 8, most_conditions: int = 4, least_precision: float = 0.9, least_covered: int = 2, most_failures: int = 4) -> DecisionList:
    """Learns from labelled rows: the statistics struct s, quality (1 keep, 0 reject) and grow (else prune).

    Thresholds are n_thresholds quantiles of each feature in either class. A rule is kept if it covers
    least_covered rejected rows or more of the pruning part with least_precision. After one that doesn't,
    growing begins with another feature; most_failures of them end the list. Rows with null quality are ignored. No rows of one class: an empty list, which rejects nothing.
    """
    values = features(F.col(s))
    rows = labelled.where(F.col(quality).isin(0, 1)).select(*(v.alias(k) for k, v in values.items()), F.col(quality).alias("y"), F.col(grow).alias("g"))
    rows = settle(rows, "labelled")
    marks = [k / n_thresholds for k in range(n_thresholds + 1)]
    found = rows.groupBy("y").agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES)).collect()
    if len(found) < 2:
        return DecisionList()
    cuts = {f: sorted({float(v) for r in found for v in r[f]}) for f in FEATURES}
    out, plain = DecisionList(), {f: F.col(f) for f in FEATURES}
    # The bin of a value is the number of cuts below it: value <= cuts[k] exactly if bin <= k.
    bins = [_below(cuts[f], F.col(f)).alias(f) for f in FEATURES]
    left, barred = F.lit(True), set()
    while len(out.rules) < most_rules and len(barred) < most_failures:
        rule: list[Condition] = []
        open_rows = rows.where(left)
        while len(rule) < most_conditions:
            part = open_rows.where(F.col("g") & _all(rule, plain))
            counts = part.select(F.posexplode(F.array(*bins)).alias("f", "b"), "y").groupBy("f", "b").agg(F.count_if(F.col("y") == 0).alias("p"), F.count_if(F.col("y") == 1).alias("n")).collect()
            whole = [sum(r[k] for r in counts if r["f"] == 0) for k in "pn"]
            if not whole[0] or not whole[1]:
                break
            best = (0.0, None)
            for i, f in enumerate(FEATURES):
                if not rule and f in barred:
                    continue
                p = n = 0
                at = {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == i}
                for k, cut in enumerate(cuts[f]):
                    p, n = p + at.get(k, (0, 0))[0], n + at.get(k, (0, 0))[1]
                    for above, (a, b) in ((False, (p, n)), (True, (whole[0] - p, whole[1] - n))):
                        best = max(best, (_gain(a, b, *whole), (f, above, cut)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(Condition(*best[1]))
        if not rule:
            break
        tests = [F.count_if(_all(rule[: k + 1], plain) & (F.col("y") == y)).alias(f"c{k}_{y}") for k in range(len(rule)) for y in (0, 1)]
        got = open_rows.where(~F.col("g")).agg(*tests).first()
        score, keep = max(((got[f"c{k}_0"] - got[f"c{k}_1"]) / max(1, got[f"c{k}_0"] + got[f"c{k}_1"]), -k) for k in range(len(rule)))
        keep = -keep
        p, n = got[f"c{keep}_0"], got[f"c{keep}_1"]
        if p < least_covered or p < least_precision * (p + n):
            barred.add(rule[0].feature)
            continue
        out.rules.append(rule[: keep + 1])
        left = left & ~_all(rule[: keep + 1], plain)
    return out


def verdict(text: Column, learned: DecisionList) -> Column:
    """A struct of the statistics, base_failed, rule (0, or the rule that rejects) and kept; one pass over the text."""

    def judge(s: Column) -> Column:
        failed, rule = base_failed(s), learned.rule(s)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper")
        return F.struct(*(s[n].alias(n) for n in names), failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))

    return _let(statistics(text), judge)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DecisionList:
    """The list learned from the texts of at most `sample` labels of ids that held_out() doesn't name; a third
    of them prunes. Labels without a document, with another quality than 0 or 1, or without an id are ignored."""
    marked = labels.where(~held_out(F.col(id_col)) & F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
    with scratch():
        chosen = settle(marked.orderBy(F.xxhash64("id"), "id", "quality").limit(sample), "labels")
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        rows = settle(rows.select("id", "quality", statistics(F.col("text")).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(3)) != 0).alias("grow")), "statistics")
        return fit(rows, "s", "quality", "grow")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, result: str = "verdict") -> tuple[DataFrame, DecisionList]:
    """(rows, list). rows: for each row of docs the columns in `carry` (the id by default) and a struct
    named `result`: the statistics, base_failed, rule (0, or the rule that rejects) and kept.

    The list comes from learn(); every row is then judged by its own text, in the scan of docs. Null text has
    no words and isn't kept. Repeated ids: each row is judged by its own text. An empty table gives no rows,
    and no rules. Extra columns don't matter, also one named like a statistic.
    """
    learned = learn(docs, labels, id_col, text_col)
    return docs.select(*(F.col(f"`{c}`") for c in carry or [id_col]), verdict(F.col(f"`{text_col}`"), learned).alias(result)), learned
