"""Signals read off chunks by rules: questions and answers, project names, commitments, budget lines, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.text import let as _let
from ..lexicon import CATEGORIES, COMMITMENT, VERBS
from .chunking import _speaker

# What a project's name ends in, words that don't begin one, roles that ask, words of running costs.
SUFFIXES = ("설치", "구축", "조성", "도입", "교체", "보급", "전환", "확충", "리모델링", "고도화", "플랫폼", "시스템", "서비스", "사업")
FILLERS = ("예산", "사업비", "기본계획", "사업", "내년도", "올해", "현재", "위원님", "말씀")
ASKING = ("위원", "의원", "위원장", "의장")
OPERATING = ("운영", "유지관리", "급여", "업무추진비", "개최", "인건비", "수당", "지원")
BUYING = ("설치", "구축", "조성", "도입", "교체", "보급", "전환", "리모델링")
# Parts of the confidence of a council signal, and its most.
CONFIDENCE = {"base": 0.45, "committed": 0.15, "amount": 0.1, "category": 0.1, "most": 0.85}
CANCEL_NOTICE = "취소공고"
#: Particles after a name, and endings of words that a name doesn't go back over.
_PARTICLES, _BREAKS = r"[은는이가을를의에도]?[,.]?$", r"(?:[은는을를이가도고]|에|에서|로|으로|[,.!?])$"
_NAME_WORDS = 5


def sentences(words: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(words, F.lit(r"([^.?!。]+[.?!。]?)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def sides(chunk: Column) -> Column:
    """A struct of question and answer: lines go to the side of the speaker before them, those before any to the question."""
    empty = F.struct(F.lit(True).alias("asks"), F.array().cast("array<string>").alias("q"), F.array().cast("array<string>").alias("a"))

    def step(state: Column, line: Column) -> Column:
        who = _let(_speaker(F.trim(line)), lambda w: F.struct(w["role"].alias("role"), w.isNotNull().alias("new")))
        said = _let(who, lambda w: F.struct(
            F.when(w["new"], w["role"].isin(*ASKING)).otherwise(state["asks"]).alias("asks"), F.when(w["new"], F.regexp_replace(F.trim(line), r"^.\s*\S+\s+\S+\s*", "")).otherwise(line).alias("spoken"),
        ))
        return _let(said, lambda x: F.struct(x["asks"].alias("asks"), F.when(x["asks"], F.array_append(state["q"], x["spoken"])).otherwise(state["q"]).alias("q"), F.when(x["asks"], state["a"]).otherwise(F.array_append(state["a"], x["spoken"])).alias("a")))

    return F.aggregate(F.split(F.coalesce(chunk, F.lit("")), "\n"), empty, step, lambda s: F.struct(F.array_join(s["q"], " ").alias("question"), F.array_join(s["a"], " ").alias("answer")))


def project_name(words: Column) -> Column:
    """The longest name (the first of equals) of up to five words that ends in a suffix of SUFFIXES and says what is
    bought or done; null without one. It begins after the last word before it that a particle ends."""
    known = F.array(*map(F.lit, [k.lower() for ks in CATEGORIES.values() for k in ks] + list(VERBS)))

    def named(both: Column) -> Column:
        parts, bare = both["parts"], both["bare"]
        is_end = lambda w: F.exists(F.array(*map(F.lit, SUFFIXES)), lambda x: w.endswith(x))

        def name(w: Column, i: Column) -> Column:
            first = F.greatest(F.lit(0), i - (_NAME_WORDS - 1))
            breaks = F.filter(F.sequence(first, i), lambda j: (j < i) & (F.get(parts, j).rlike(_BREAKS) | F.get(bare, j).isin(*FILLERS) | F.get(parts, j).rlike(r"^['’]?\d+[가-힣]*$")))
            joined = lambda start: F.array_join(F.concat(F.slice(bare, start + 1, i - start), F.array(w)), " ")
            return F.when(is_end(w) & ~w.isin(*FILLERS), _let(F.coalesce(F.array_max(breaks) + 1, first), joined))

        said = F.filter(F.array_compact(F.transform(bare, name)), lambda x: (F.length(x) >= 3) & _let(F.lower(x), lambda low: F.exists(known, lambda k: low.contains(k))))
        return F.array_max(F.transform(said, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]

    def bared(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), F.transform(parts, lambda w: F.regexp_replace(w, _PARTICLES, "")).alias("bare"))

    return _let(_let(F.split(F.trim(F.regexp_replace(words, r"\s+", " ")), " "), bared), named)


def keywords(words: Column, most: int = 6) -> Column:
    """The words of the categories that the text has, in the order of the lists, `most` at most."""
    every = tuple(dict.fromkeys(k for ks in CATEGORIES.values() for k in ks))
    return F.slice(F.filter(F.array(*map(F.lit, every)), lambda k: words.contains(k)), 1, most)


def council_signals(chunks: DataFrame, chunk: str = "text", day: str = "day") -> DataFrame:
    """chunks of which a signal can be read, with title, category, commitment, budget_krw, timing, keywords, evidence
    (three sentences at most: those of a commitment, then the first with an amount) and confidence. An answer
    without a commitment, a project or a category gives none."""
    rows = chunks.withColumn("_s", sides(F.col(chunk))).withColumn("_amounts", money.find_amounts("_s.answer"))
    phrases = F.array(*(F.lit(p) for ps in COMMITMENT.values() for p in ps))
    amounts = F.col("_amounts")

    def read(x: Column) -> Column:
        """x has answer, both (with the question), level and title."""
        vote = _let(text.category_votes(x["title"]), lambda own: F.when(own["confidence"] >= 0.5, own).otherwise(text.category_votes(x["both"])))
        return _let(vote, lambda v: F.when(v["category"] != "other", told(x, v)))

    def told(x: Column, vote: Column) -> Column:
        best = F.array_max(F.transform(amounts, lambda a: F.struct(a["value"], a["raw"])))
        return _let(F.struct(best.alias("best"), sentences(x["answer"]).alias("said")), lambda y: signal(x, vote, y["best"], y["said"]))

    def signal(x: Column, vote: Column, best: Column, said: Column) -> Column:
        sure = x["level"].isin("committed", "planned")
        promised = F.filter(said, lambda s: F.exists(phrases, lambda p: s.contains(p)))
        priced = F.filter(said, lambda s: F.exists(amounts, lambda a: s.contains(F.trim(a["raw"]))))
        evidence = F.slice(F.array_distinct(F.concat(promised, F.slice(priced, 1, 1))), 1, 3)
        confidence = CONFIDENCE["base"] + CONFIDENCE["committed"] * sure.cast("int") + CONFIDENCE["amount"] * best.isNotNull().cast("int") + CONFIDENCE["category"] * F.least(vote["confidence"], F.lit(1.0))
        return F.struct(
            x["title"].alias("title"), vote["category"].alias("category"), x["level"].alias("commitment"), best["value"].alias("budget_krw"), F.when(sure, dates.timing(x["answer"], F.col(day))).alias("timing"),
            _let(keywords(x["both"]), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(x["title"]))).alias("keywords"), evidence.alias("evidence"), F.round(F.least(confidence, F.lit(CONFIDENCE["most"])), 2).alias("confidence"),
        )

    answer, question = F.col("_s.answer"), F.col("_s.question")
    given = F.struct(answer.alias("answer"), F.concat_ws(" ", question, answer).alias("both"), text.commitment_level(answer).alias("level"), F.coalesce(project_name(answer), project_name(question)).alias("title"))
    found = _let(given, lambda x: F.when(x["level"].isNotNull() & x["title"].isNotNull(), read(x)))
    # A generator, so that the one expression isn't computed again for a filter.
    return rows.select(*chunks.columns, F.explode(F.array_compact(F.array(found))).alias("_signal")).select(*chunks.columns, "_signal.*")


def budget_signals(blocks: DataFrame, block: str = "text", unit: str = "unit", fiscal_year: str = "fiscal_year") -> DataFrame:
    """Budget blocks whose first line names a 세부사업 with an amount, as signals: title, category, budget_krw (in the
    table's unit), expected_year, evidence. Running costs count only with a word of BUYING in the name."""
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))

    def parted(first: Column) -> Column:
        return _let(F.trim(F.regexp_replace(first, r"^.*?세\s*부\s*사\s*업\s*[:：]?", "")), lambda after: F.struct(first.alias("first"), after.alias("after"), F.regexp_extract(after, r"\s(\d{1,3}(?:,\d{3})+|\d{4,})", 1).alias("amount")))

    def named(x: Column) -> Column:
        title = F.when((x["amount"] != "") & F.regexp_replace(x["first"], r"\s", "").contains("세부사업"), F.trim(F.split_part(x["after"], x["amount"], F.lit(1))))
        return F.struct(title.alias("title"), x["amount"].alias("amount"), x["first"].alias("first"), text.category_votes(F.col(block))["category"].alias("category"))

    def read(x: Column) -> Column:
        fit = x["title"].isNotNull() & (~has(x["title"], OPERATING) | has(x["title"], BUYING)) & (x["category"] != "other")
        return F.when(fit, F.struct(
            x["title"].alias("title"), x["category"].alias("category"), F.lit("committed").alias("commitment"), (F.replace(x["amount"], F.lit(","), F.lit("")).try_cast("bigint") * F.col(unit)).alias("budget_krw"),
            F.col(fiscal_year).alias("expected_year"), F.array(x["first"]).alias("evidence"),
        ))

    signal = _let(_let(_let(F.trim(F.split_part(F.col(block), F.lit("\n"), F.lit(1))), parted), named), read)
    return blocks.select(*blocks.columns, F.explode(F.array_compact(F.array(signal))).alias("_signal")).select(*blocks.columns, "_signal.*")


def record_signals(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """One signal for each record of docs(doc_id, doc_type, title, institution_code, amount_krw, order_year,
    order_month, notice_kind, bid_notice_no, published_at). owners(code, executive_code) names whose demand a
    council's record is. Without an owner a record is to be reviewed; a cancelling notice names the bid it withdraws."""
    rows = docs.join(owners.select(F.col("code").alias("institution_code"), "executive_code"), "institution_code", "left").withColumn("owner", F.coalesce("executive_code", "institution_code"))
    # A column of its own, so that it isn't computed again for every word that is looked for in it.
    rows = rows.withColumn("_plain", text.canonical_title(F.col("title")))
    title = F.col("_plain")
    known = F.col("owner").isNotNull()
    return rows.select(
        "doc_id", F.col("doc_type").alias("stage"), F.col("owner").alias("institution_code"), F.coalesce(F.nullif(title, F.lit("")), F.col("title")).alias("title"), text.category_votes(title)["category"].alias("category"),
        F.col("amount_krw").alias("budget_krw"), F.coalesce("order_year", F.year("published_at")).alias("expected_year"), F.when(F.col("order_month") <= 6, "H1").when(F.col("order_month") > 6, "H2").alias("expected_half"),
        F.when(known, 0.99).otherwise(0.6).alias("confidence"), F.when(known, "accepted").otherwise("needs_review").alias("verdict"),
        F.when(F.col("notice_kind") == CANCEL_NOTICE, F.col("bid_notice_no")).alias("cancels_bid_notice_no"), F.col("published_at").alias("observed_at"),
    )


def evidence_ratio(found: Column) -> Column:
    """The share of an array of booleans that is true, three digits; 0 of none."""
    return F.when(F.size(found) > 0, F.round(F.size(F.filter(found, lambda x: x)) / F.size(found), 3)).otherwise(0.0)


def settled_amount(claimed: Column, parsed: Column, grounded: Column) -> Column:
    """The amount to keep: what the parser read where the claim isn't borne out and something was read, else the claim."""
    return F.when((grounded == F.lit(False)) & (parsed > 0), parsed).otherwise(claimed)


def expected_year(doc_type: Column, claimed: Column, fiscal_year: Column) -> Column:
    """A budget book's lines are expected in its fiscal year, if they don't say another."""
    return F.when(doc_type == "budget_book", F.coalesce(claimed, fiscal_year)).otherwise(claimed)
